"""Stored tables changed by ranges, the relational store read in ranges, the text index, and files told by what they hold."""

import struct

import pytest
from pyspark.sql import functions as F

from pagespan.operators import lookups
from pagespan.sources import readers
from pagespan.sources.stored import StoredTable
from pagespan.sources.tables import STORED, read_jdbc, read_store


def files_of(table):
    return {r.p for r in table.spark.read.parquet(table.path).select(F.col("_metadata.file_path").alias("p")).distinct().collect()}


def test_a_patch_of_one_page_rewrites_one_partition(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), span=10)
    rows = [(p, e, f"c{e}") for p in range(-20, 60) for e in range(2)]
    table.create(spark.createDataFrame(rows, "page_id long, element_id long, class_name string"))
    before = files_of(table)
    patch = spark.createDataFrame([(33, "new", ["class_name"])], "page_id long, class_name string, fields_set array<string>")
    assert table.patch(patch, ["class_name"]) == 1
    assert len(before - files_of(table)) == 1 and len(before) == 8
    got = {(r.page_id, r.element_id): r.class_name for r in table.read().collect()}
    assert got == {(p, e): "new" if p == 33 else c for p, e, c in rows}
    # a whole range goes, rows come to a new one, others stay as they are
    gone = spark.createDataFrame([(p,) for p in range(-20, -10)], "page_id long")
    assert table.delete(gone) == 1
    new = spark.createDataFrame([(905, 1, "x")], "page_id long, element_id long, class_name string")
    table.change(new, lambda old, n: old.unionByName(n))
    assert table.read().count() == 160 - 20 + 1 and len(before & files_of(table)) == 6
    with pytest.raises(ValueError, match="did not name"):
        table.change(gone.limit(1), lambda old, g: old.withColumn("page_id", F.col("page_id") + 100).unionByName(new))


def test_relational_store_read_back(spark):
    """All 12 tables of an embedded database, by ranges with bounds of their own; nulls and empty tables too."""
    url = "jdbc:derby:memory:pagespan_test;create=true"
    wide = spark.range(-7, 500).select(F.col("id").alias("page_id"), F.col("id").cast("string").alias("content"))
    made = {}
    for k, (name, column) in enumerate(STORED.items()):
        n = (column or "page_id", "content")
        df = wide.toDF(*n).limit(0) if k == 5 else wide.toDF(*n).filter(F.col(n[0]) % (k + 1) == 0)
        if k == 4:
            df = df.withColumn(n[0], F.when(F.col(n[0]) != 10, F.col(n[0])))
        df.write.jdbc(url, name)
        made[name] = sorted(map(str, df.collect()))
    got = read_store(spark, url, 8)
    assert len(got) == 12 and {n: sorted(map(str, df.collect())) for n, df in got.items()} == made
    assert got["pages"].rdd.getNumPartitions() == 8 and got["users"].rdd.getNumPartitions() == 8
    sizes = [len(p) for p in got["layout_elements"].rdd.glom().collect()]
    assert min(sizes) > 5 and max(sizes) < 30  # bounds are the table's own
    assert read_jdbc(spark, url, "text_contents", "element_id").count() == 0


def test_text_index(spark, tmp_path):
    texts = [(1, "The Family Tree"), (2, "fam ILY"), (3, "no"), (4, None), (5, ""), (6, "가족 나무 가족"), (7, "f"), (8, "lyfa milyfamily")]
    df = spark.createDataFrame(texts, "element_id long, ocr_text string")
    index = lookups.TextIndex(spark, str(tmp_path / "i"), parts=16)
    index.add(df.filter("element_id < 5"))
    index.add(df.filter("element_id >= 4"))
    for phrase in ("family", "가족 나무", "zz", "f", "Tree no"):
        assert list(map(tuple, index.search(phrase).collect())) == list(map(tuple, lookups.text_search(df, phrase).collect())), phrase
    assert index.search("family", 1).count() == 1
    plan = index.search("fa")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(gram)" in plan


def test_text_index_holds_copies_once(spark, tmp_path):
    """Posting lists grow with the different texts; characters are code points, and phrases may have many grams."""
    import pathlib

    long = "".join(chr(0x4E00 + k) for k in range(150))
    texts = ["Aé😀b\x0b c", "aÉ😀BC", "\u00a0x", long, f"q{long[:70]}", "😀b"]
    df = spark.createDataFrame([(10 * k + i, x) for k in range(9) for i, x in enumerate(texts)], "element_id long, ocr_text string")
    for n in (1, 2, 3):
        index = lookups.TextIndex(spark, str(tmp_path / f"i{n}"), n, parts=4)
        index.add(df)
        for phrase in ("É😀 b", "😀bc", "\u00a0X", long, "x"):
            assert list(map(tuple, index.search(phrase, 50).collect())) == list(map(tuple, lookups.text_search(df, phrase, n, 50).collect())), phrase
        postings = next(p for p in pathlib.Path(index.path).glob("*") if any(p.glob("part=*")))
        assert spark.read.parquet(str(postings)).count() < len(texts) * 150


def test_text_index_keeps_lists_of_places(spark, tmp_path, monkeypatch):
    """A posting is a small number in a gram's list of a block, not a row with a text's hash; blocks and loads do not mix."""
    import pathlib

    monkeypatch.setattr(lookups, "A_BLOCK_CHARS", 300)
    df = spark.createDataFrame([(k, f"text {k % 50} family {'x' * (k % 7)}") for k in range(400)], "element_id long, ocr_text string")
    index = lookups.TextIndex(spark, str(tmp_path / "i"), parts=4)
    for load in (df.filter("element_id < 250"), df.filter("element_id >= 200")):
        index.add(load)
    for phrase in ("Family", "xx", "49f", "t 1"):
        assert list(map(tuple, index.search(phrase, 1000).collect())) == list(map(tuple, lookups.text_search(df, phrase, 2, 1000).collect())), phrase
    tables = [spark.read.parquet(str(p)) for p in pathlib.Path(index.path).glob("*") if any(p.glob("part=*"))]
    assert all(dict(t.dtypes)["places"] == "array<int>" for t in tables)
    assert tables[0].groupBy("load", "block", "gram").count().filter("count > 1").isEmpty() and tables[0].select("block").distinct().count() > 5


def test_files_are_told_by_what_they_hold(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 2480, 3508) + b"\x08\x02\x00\x00\x00"
    files = {"a.PNG": png, "b.png": b"%PDF-1.7", "c.pdf": b"%PDF-1.4\n", "d.jpg": b"\xff\xd8\xff\xe0..", "e.jpeg": b"??", "f.txt": b"%PDF", "g.webp": b"RIFF....WEBP", "h.tiff": b"II*\0", "i.bmp": b"BM"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: (r["kind"], r["format"], r["fault"], r["image_width"], r["image_height"]) for r in readers.register_page_files(spark, str(tmp_path), look=True).collect()}
    assert got == {
        "a.PNG": ("image", "png", False, 2480, 3508), "b.png": ("image", "pdf", True, None, None), "c.pdf": ("pdf", "pdf", False, None, None), "d.jpg": ("image", "jpeg", False, None, None),
        "e.jpeg": ("image", None, True, None, None), "g.webp": ("image", "webp", False, None, None), "h.tiff": ("image", "tiff", False, None, None), "i.bmp": ("image", "bmp", False, None, None),
    }
