"""Files in and out, resuming, and streams that are run twice."""

import json

from pagespan.operators import layout, stats
from pagespan.sources import readers, writers
from pagespan.sources.tables import Tables
from pagespan.streaming import streams
from pyspark.sql import functions as F


def test_element_files(spark, tmp_path):
    one = {"element_id": 1, "class_name": "figure", "confidence": 0.5, "bbox_x": 1, "bbox_y": 2, "bbox_width": 3, "bbox_height": 4}
    (tmp_path / "page_12.json").write_text(json.dumps([one, one | {"element_id": 2}]))
    got = readers.read_elements_json(spark, str(tmp_path)).collect()
    assert {(r.element_id, r.page_id) for r in got} == {(1, 12), (2, 12)}


def test_page_files(spark, tmp_path):
    for name in ("a.PNG", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.name: r.kind for r in readers.register_page_files(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": "image", "b.pdf": "pdf"}


def test_groups_written_twice_replace_their_pages(spark, sf, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    t = Tables(spark, sf)
    some = lambda cond: layout.reading_order(t.layout_elements.filter(cond))
    for cond in ("page_id < 40", "page_id between 20 and 30"):
        s = some(cond)
        writers.write_groups(stats.build_groups(s), stats.group_map(s), str(tmp_path / "g"), 4)
    got = spark.read.parquet(str(tmp_path / "g" / "question_groups"))
    assert got.count() == some("page_id < 40").count()


def test_texts_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "project_id long, combined_text string")
    writers.write_project_text(df, str(tmp_path / "t"))
    assert {r.project_id for r in spark.read.text(str(tmp_path / "t")).collect()} == {1, 2}
    writers.write_json_results(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_edit_stream_goes_on_and_takes_each_edit_once(spark, tmp_path):
    schema = "edit_id string, page_id long, seq long, content string"
    first = spark.createDataFrame([(1, 1, "original", "", True)], "page_id long, version_number int, version_type string, content string, is_current boolean")
    log = streams.VersionLog(spark, str(tmp_path / "v"), first)
    for k, rows in enumerate(([("e1", 1, 1, "x"), ("e1", 1, 1, "x")], [("e1", 1, 1, "x"), ("e2", 1, 2, "y")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        got = streams.stream_edits(df, log, str(tmp_path / "c"))
        assert got.count() == 2 + k
    assert [(r.version_number, r.content) for r in got.filter("is_current").collect()] == [(3, "y")]
    again = log.read(log.last)
    log.append(log.last, spark.createDataFrame([(1, 9, "user_edited", "z")], "page_id long, seq long, version_type string, content string"))  # a batch that is run again changes nothing
    assert log.latest().count() == again.count()


def test_status_stream(spark, tmp_path):
    rows = [(1, "2024-01-01", 7, "pending"), (2, "2024-01-02", 7, "completed"), (3, "2024-01-01", 8, "failed")]
    df = spark.createDataFrame(rows, "event_id long, ts string, page_id long, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    got = streams.stream_job_status(streams.file_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "c"))
    assert {r.page_id: r.status for r in got.collect()} == {7: "completed", 8: "failed"}


def test_status_stream_merges_and_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "MERGED", 2)
    schema = "event_id long, ts timestamp, page_id long, status string"
    at, want = str(tmp_path / "in"), {}
    for k in range(5):
        rows = [(10 * k + p, f"2024-01-{9 - k if p == 3 else 1 + k:02d}", p, f"s{k}") for p in range(k % 2, 4)]
        spark.createDataFrame(rows, "event_id long, ts string, page_id long, status string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(at)
        for e, ts, p, status in rows:
            want[p] = max(want.get(p, ("",)), (ts, e, status))
        df = streams.file_stream(spark, at, spark.createDataFrame([], schema).schema)
        got = streams.stream_job_status(df, str(tmp_path / "out"), str(tmp_path / "c"))
        assert {r.page_id: r.status for r in got.collect()} == {p: w[2] for p, w in want.items()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] in "bm") == ["b4", "m3"]


def test_edits_within_a_time(spark, tmp_path):
    first = spark.createDataFrame([(1, 1, "original", "", True)], "page_id long, version_number int, version_type string, content string, is_current boolean")
    log = streams.VersionLog(spark, str(tmp_path / "v"), first)
    rows = [("e1", 1, 1, "x"), ("e1", 1, 1, "x"), ("e2", 1, 2, "y")]
    df = spark.createDataFrame(rows, "edit_id string, page_id long, seq long, content string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    got = streams.stream_edits(streams.file_stream(spark, str(tmp_path / "in"), df.schema), log, str(tmp_path / "c"), within="7 days")
    assert got.count() == 3
