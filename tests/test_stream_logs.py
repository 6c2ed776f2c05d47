"""Pages that come in pieces, invalidated caches, and logs whose batches read no more as they go on."""

import time

from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.streaming import logs, streams
from pagespan.sources import dimensions
from pagespan.sources.tables import Tables

VERSIONS = "page_id long, version_number int, version_type string, content string, is_current boolean"
NEW = "page_id long, seq int, version_type string, content string"


def pieces(spark, tmp_path, t, parts, files=1):
    """A stream of some pages' elements in ``parts`` files, a file a batch."""
    at = str(tmp_path / "in")
    for k in range(parts):
        t.layout_elements.filter(F.col("element_id") % parts == k).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)
    return streams.file_stream(spark, at, t.layout_elements.schema, files=files)


def test_a_page_in_three_batches_gives_one_version(spark, sf, tmp_path):
    t = Tables(spark, sf)
    t.layout_elements = t.layout_elements.filter("page_id < 6")
    expected = t.layout_elements.groupBy("page_id").agg(F.count(F.lit(1)).alias("expected"))
    log = logs.VersionLog(spark, str(tmp_path / "v"), spark.createDataFrame([], VERSIONS))
    args = (t.doc_pages, t.text_contents, t.ai_descriptions, dimensions.formatting_rules(spark), log, str(tmp_path / "c"), expected)
    got = streams.stream_pages(pieces(spark, tmp_path, t, 3), *args).collect()
    pages = {r.page_id for r in expected.collect()}
    assert {r.page_id for r in got} == pages and len(got) == len(pages) and {r.version_number for r in got} == {1}
    assert all(r.content.strip() for r in got)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")  # as it was


def gathered(spark, stream, expected, at, checkpoint, wait_s):
    with streams.with_rocksdb(spark):
        streams.run(streams.gathered_pages(stream, expected, wait_s).writeStream.format("parquet").option("path", at), checkpoint)
    return spark.read.schema("element_id long, page_id long, class_name string, complete boolean").parquet(at)


def test_waiting_has_an_end(spark, tmp_path):
    """A page that stays short goes when its time is up; one of unknown size goes at once; repeated elements count once."""
    at, rows = str(tmp_path / "in"), lambda page, *ids: [(i, page, "figure", None, 1, 2, 3, 4) for i in ids]
    expected = spark.createDataFrame([(1, 3), (2, 2), (4, 9)], "page_id long, expected long")
    add = lambda *r: spark.createDataFrame([*r], S.ELEMENT).coalesce(1).write.mode("append").parquet(at)
    go = lambda wait: {(r.page_id, r.element_id, r.complete) for r in gathered(spark, streams.file_stream(spark, at, spark.createDataFrame([], S.ELEMENT).schema, files=1), expected, str(tmp_path / "out"), str(tmp_path / "c"), wait).collect()}
    add(*rows(1, 10, 11), *rows(2, 20, 20), *rows(3, 30))
    assert go(9999) == {(3, 30, False)}
    add(*rows(2, 21), *rows(1, 11), *rows(4, 40))
    two = {(3, 30, False), (2, 20, True), (2, 21, True)}
    assert go(1) == two
    time.sleep(2)
    add(*rows(5, 50))
    three = two | {(5, 50, False), (4, 40, False)}
    assert go(1) == three
    add(*rows(1, 12))
    assert go(1) == three | {(1, i, True) for i in (10, 11, 12)}


def test_batches_read_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    """Of numbers so far, a batch reads its pages' parts of the last merge and of the few tables after it."""
    log = logs.VersionLog(spark, str(tmp_path / "v"), spark.createDataFrame([(p, 7, "original", "", True) for p in range(40)], VERSIONS), merged=3)
    read, numbers = [], logs.VersionLog.numbers
    monkeypatch.setattr(logs.VersionLog, "numbers", lambda self, batch, parts: read.append((len(parts), len((df := numbers(self, batch, parts)).inputFiles()))) or df)
    want = {}
    for n in range(14):
        rows = [(p, s, "auto", f"{n}") for p in (n % 5, 41 + n % 2) for s in range(2)]
        for p, *_ in rows:
            want[p] = want.get(p, 7 if p < 40 else 0) + 1
        log.append(n, spark.createDataFrame(rows, NEW))
    assert all(files <= 4 * parts for parts, files in read) and max(f for _, f in read[9:]) <= 8, read
    got = {r.page_id: r.version_number for r in log.latest().filter("is_current").collect()}
    assert {p: v for p, v in got.items() if p in want} == want and len(got) == 42
    assert len(log.tables("nm")) <= 3
    again = logs.VersionLog(spark, str(tmp_path / "v"), spark.createDataFrame([], VERSIONS), merged=3)
    before = again.latest().count()
    again.append(13, spark.createDataFrame([(1, 0, "auto", "twice")], NEW))
    assert again.last == 13 and again.latest().count() == before == 40 + 14 * 4


def test_a_batch_that_stopped_between_its_tables_is_done_again(spark, tmp_path):
    log = logs.VersionLog(spark, str(tmp_path / "v"), spark.createDataFrame([(1, 4, "original", "", True)], VERSIONS))
    log.append(0, spark.createDataFrame([(1, 0, "auto", "x")], NEW))
    (tmp_path / "v" / "v0" / "_SUCCESS").unlink()  # its numbers stand, its versions do not
    log = logs.VersionLog(spark, str(tmp_path / "v"), spark.createDataFrame([], VERSIONS))
    assert log.last == -1
    log.append(0, spark.createDataFrame([(1, 0, "auto", "x")], NEW))
    assert sorted((r.version_number, r.is_current) for r in log.latest().collect()) == [(4, False), (5, True)]


def test_edits_make_cached_texts_stale(spark, tmp_path):
    """Projects of edited pages lose what was cached before the edit; batches that run again change nothing."""
    pages = spark.createDataFrame([(p, p // 10) for p in range(50)], "page_id long, project_id long")
    log = logs.VersionLog(spark, str(tmp_path / "v"), spark.createDataFrame([], VERSIONS))
    stale = logs.InvalidationLog(spark, str(tmp_path / "i"), merged=2)
    at = str(tmp_path / "in")
    schema = "edit_id string, page_id long, seq long, content string, ts timestamp"

    def add(*rows):
        df = spark.createDataFrame([(e, p, 1, "x", ts) for e, p, ts in rows], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(at)
        return streams.stream_edits(streams.file_stream(spark, at, spark.createDataFrame([], schema).schema), log, str(tmp_path / "c"), pages=pages, stale=stale)

    cached = spark.createDataFrame([(k, ts, "text") for k, ts in enumerate(["2024-01-02", "2024-01-02", "2024-01-09", None, "2024-01-02"])], "project_id long, updated_at string, combined_text string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    left = lambda: {r.project_id for r in stale.valid(cached).collect()}
    assert left() == {0, 1, 2, 3, 4}
    assert add(("e1", 3, "2024-01-05"), ("e1", 3, "2024-01-05"), ("e2", 21, "2024-01-05")).count() == 2
    assert left() == {1, 2, 3, 4}  # project 2 was rendered after its edit
    add(("e3", 35, "2024-01-03"), ("e2", 21, "2024-01-12"))
    assert left() == {1, 2, 4}
    add(("e4", 22, "2024-01-10"))
    assert left() == {1, 4} and len(stale.tables("ij")) <= 2
    state = sorted(map(tuple, stale.latest().collect()))
    stale.append(1, spark.createDataFrame([(4, None)], logs.InvalidationLog.SCHEMA))
    assert sorted(map(tuple, stale.latest().collect())) == state


def test_state_is_called_once_a_range_of_pages(spark):
    """Not once a row: 64 pages of 30 elements in three pieces; two stay short, one of them with rows that come twice."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: bool(self.held), "get": lambda: iter(self.held), "put": lambda rows: setattr(self, "held", rows), "clear": lambda: setattr(self, "held", [])}[name]

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return State()

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

        def listTimers(self):  # noqa: N802
            return []

    class Now:
        getCurrentProcessingTimeInMs = getExpiryTimeInMs = lambda self: 1000  # noqa: N815

    rows = pd.DataFrame([(1000 * p + i, p, "figure", 0.5 if i % 2 else None, i, 2, 3, None if i == 4 else 4, 31 if p < 2 else 30) for p in range(64) for i in range(30)], columns=[*S.ELEMENT_COLUMNS, "expected"])
    schema = _parse_datatype_string(S.ELEMENT) if isinstance(S.ELEMENT, str) else S.ELEMENT
    gathering = streams.Gathering(0, schema)
    gathering.init(Handle())
    out = []
    for k in range(3):
        batch = rows[(rows.element_id % 3 == k) | ((rows.page_id == 1) & (rows.element_id == 1000))]
        out += list(gathering.handleInputRows((0,), iter([batch[:100], batch[100:]]), Now()))
    got = pd.concat(out)
    assert set(got.page_id) == set(range(2, 64)) and len(got) == 62 * 30 == got.element_id.nunique() and got.complete.all()
    late = pd.concat(gathering.handleExpiredTimer((0,), Now(), Now()))
    assert sorted(late.element_id) == [*range(30), *range(1000, 1030)] and not late.complete.any()
    assert len(calls) < 20, len(calls)
