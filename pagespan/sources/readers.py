"""Element files and page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan import schema as S

IMAGES = ["jpg", "jpeg", "png", "bmp", "tiff", "webp"]


def read_elements_json(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON files, an array a file; page_id is the last number of the file's name where the rows have none."""
    rows = spark.read.schema(S.ELEMENT).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_name"))
    named = F.nullif(F.regexp_extract("_file", "(\\d+)\\D*$", 1), F.lit("")).cast("long")
    return rows.withColumn("page_id", F.coalesce("page_id", named)).drop("_file")


# What files begin with, in hexadecimal digits.
MAGIC = {"89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "25504446": "pdf", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff", "52494646": "webp", "50415231": "parquet"}
#: Tasks read files of up to this size whole, as their reader has no way to read a part of one. Of larger ones the driver reads the first HEAD bytes.
MAGIC_BYTES, HEAD = 256 << 20, 24


def register_page_files(spark: SparkSession, path: str, look: bool = False, kinds: dict[str, str] | None = None) -> DataFrame:
    """path, name, size_bytes, modificationTime, kind of accepted files: image, pdf, or what ``kinds`` says of suffixes.

    Contents are not read, unless ``look`` asks for it: then ``format`` is what a file begins as (null: unknown), ``fault`` whether
    that is not what its suffix says, and PNG images have their width and height.
    Empty files are not listed, as Spark leaves them out.
    """
    kinds = kinds or {"pdf": "pdf", **dict.fromkeys(IMAGES, "image")}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(*[F.when(suffix == s, k) for s, k in kinds.items()])
    named = files.withColumns({"size_bytes": F.col("length"), "name": F.regexp_extract("path", "([^/]+)$", 1), "kind": kind}).filter("kind is not null")
    columns = ["path", "size_bytes", "modificationTime", "name", "kind"]
    if not look:
        return named.select(*columns)
    head = F.hex(F.substring("content", 1, 8))
    is_ = F.coalesce(*[F.when(head.startswith(m), f) for m, f in MAGIC.items()])
    wanted = F.when(suffix == "jpg", "jpeg").otherwise(suffix)
    side = lambda at: F.when(F.col("format") == "png", F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int"))
    large = named.filter(F.col("length") > MAGIC_BYTES)
    heads = spark.createDataFrame([(r["path"], _head(spark, r["path"])) for r in large.select("path").toLocalIterator()], "path string, content binary")
    both = named.filter(F.col("length") <= MAGIC_BYTES).select(*columns, "content").unionByName(large.select(*columns).join(heads, "path"))
    looked = both.withColumns({"format": is_, "fault": ~F.equal_null(is_, wanted)}).withColumns({"image_width": side(17), "image_height": side(21)})
    return looked.select(*columns, "format", "fault", "image_width", "image_height")


def _head(spark: SparkSession, path: str) -> bytes:
    """The first HEAD bytes of a file of any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, HEAD))
    finally:
        stream.close()
