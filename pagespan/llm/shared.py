"""Helpers of the corpus operators: shared tables, guarded joins, array chunks."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: A side of a join is broadcast only when this many rows were counted at most.
BROADCAST_ROWS = 20_000
#: The same for rows of one or two numbers.
NARROW_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context was given."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if getattr(_stages, "recording", False):
        _stages.tables.append(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that stages wrote, and whether one is being built: each thread's own, so that pipelines side by side keep theirs.
_stages = threading.local()


@contextlib.contextmanager
def stage_of(docs: DataFrame) -> Iterator[None]:
    """Around a stage's code: tables of earlier stages go, once ``docs`` no longer reads them.

    A stage's result is lazy and reads its tables; when it was written and read again, the next
    stage's ``docs`` does not name them any more.
    """
    made = getattr(_stages, "tables", [])
    read = docs.inputFiles() if made else []
    gone = [p for p in made if not any(p.rsplit("/", 1)[-1] in f for f in read)]
    for path in gone:
        _delete(docs.sparkSession, path)
    _stages.tables, _stages.recording = [p for p in made if p not in gone], True
    try:
        yield
    finally:
        _stages.recording = False


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing names any more; it does so only after the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 64, size: str = "count(1)") -> DataFrame:
    """Join on ``key`` with a side that is usually small but may not be.

    ``small`` (a written table, one row a key) is counted (by ``size``, where rows are long): up to
    BROADCAST_ROWS it is broadcast, beyond that both sides are shuffled on key and salt, so that
    a key with a third of all rows is dealt to ``salts`` partitions.
    """
    if (small.agg(F.expr(size)).first()[0] or 0) <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    (salt,) = fresh(big, "salt")
    dealt = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).join(dealt, [key, salt], how).drop(salt)


def unit_hash(seed: int | str, *cols: Column) -> Column:
    """Uniform in [0, 1) from md5 of seed and columns; DuckDB can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def in_train(doc_id: Column) -> Column:
    """The rows whose labels may be learnt: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` whose texts have about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        at = 0
        ends = _sizes(batch.column(column)).cumsum()
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(ends.searchsorted(done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _sizes(texts: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
