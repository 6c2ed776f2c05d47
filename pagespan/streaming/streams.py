"""Streams: new pages, job statuses, edits. Each runs to its input's end, and goes on from its checkpoint."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from pagespan import schema as S
from pagespan.operators.render import format_page
from pagespan.operators.strategies import sort_adaptive
from pagespan.sources.scratch import cut, shared_folder
from pagespan.streaming.logs import MERGED, InvalidationLog, StatusLog, VersionLog


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema, form: str = "parquet", files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files).load(path)


def run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Waiting pages are kept in ranges of 2**TOGETHER page numbers, so that Python and the state store are called once a range, not a row.
TOGETHER = 6
#: Waiting rows of a range are kept in chunks of so many.
CHUNK = 10_000


class Gathering(StatefulProcessor):
    """Elements of pages (the key is a range of them) until a page has its number ``expected``, or has waited too long since its first.

    Elements that come twice count once, the later one. A page without a known number goes with the batch that brings it.
    What comes after a page went is gathered anew.
    """

    def __init__(self, wait_ms: int, element: StructType):
        self.wait_ms, self.element = wait_ms, element

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def _held(self) -> list:
        """What waits: elements and until when their page does, as frames."""
        import pyarrow as pa

        return [pa.ipc.open_stream(rows).read_pandas() for (rows,) in self.waiting.get()] if self.waiting.exists() else []

    def _keep(self, rows) -> None:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if rows.empty:
            self.waiting.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return
        schema, chunks = to_arrow_schema(StructType([*self.element.fields, StructField("until", LongType())])), []
        for at in range(0, len(rows), CHUNK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as out:
                out.write_table(pa.Table.from_pandas(rows.iloc[at : at + CHUNK][schema.names], schema, preserve_index=False))
            chunks.append((sink.getvalue().to_pybytes(),))
        self.waiting.put(chunks)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        import pandas as pd

        end = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        held, names = self._held(), self.element.names
        both = pd.concat([*held, *[pdf[[*names, "expected"]].assign(come=True) for pdf in rows]], ignore_index=True)
        if not held:
            both["until"] = float("nan")
        of = both.groupby("page_id", dropna=False)
        both["until"] = of["until"].transform("min").fillna(end).astype("int64")
        both["expected"], both["come"] = of["expected"].transform("max"), of["come"].transform("count") > 0
        both = both.drop_duplicates(["page_id", "element_id"], keep="last")
        known = both["expected"].notna()
        goes = both["come"] & (~known | (both.groupby("page_id", dropna=False)["come"].transform("size") >= both["expected"]))
        if goes.any():
            yield both.loc[goes, names].assign(complete=known[goes])
        left = both[~goes]
        self._keep(left)
        if (left["until"] == end).any():
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        held = self._held()
        if held:
            rows = pd.concat(held, ignore_index=True)
            over = rows["until"] <= expiredTimerInfo.getExpiryTimeInMs()
            if over.any():
                yield rows.loc[over, self.element.names].assign(complete=False)
                self._keep(rows[~over])


def gathered_pages(elements: DataFrame, expected: DataFrame, wait_s: int = 600) -> DataFrame:
    """A stream of the elements of whole pages, with ``complete`` (false: the wait was over). ``expected``: page_id, expected.

    Needs the RocksDB state store (``with_rocksdb``).
    """
    kept = StructType([f for f in elements.schema.fields if f.name in S.ELEMENT_COLUMNS])
    counted = elements.select(*kept.names).join(expected.select("page_id", "expected"), "page_id", "left")
    schema = StructType([*kept.fields, StructField("complete", BooleanType())])
    counted = counted.withColumn("pages", F.shiftright("page_id", TOGETHER))
    return counted.groupBy("pages").transformWithStateInPandas(Gathering(wait_s * 1000, kept), schema, "Append", "ProcessingTime")


#: For keyed state with timers. Without batches that have no data, as a stream with timers would never be at its input's end.
KEYED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams that are started within can keep keyed state with timers; these go off in batches with data."""
    before = {name: spark.conf.get(name) for name in KEYED}
    for name, value in KEYED.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stream_pages(elements: DataFrame, pages: DataFrame, texts: DataFrame, ai: DataFrame, rules: DataFrame, log: VersionLog, checkpoint: str, expected: DataFrame | None = None, wait_s: int = 600) -> DataFrame:
    """Elements of new pages are sorted, rendered, and appended as versions.

    A page's elements all come in one batch, unless ``expected`` (page_id, expected) says how many a page has: then they may come in
    pieces over several batches, and the page waits for the rest, ``wait_s`` seconds at most.
    """

    def batch(df: DataFrame, n: int) -> None:
        if log.has(n) or df.isEmpty():
            return
        df = cut(df)
        text = format_page(sort_adaptive(df.select(*S.ELEMENT_COLUMNS), pages), texts, ai, rules)
        log.append(n, text.select("page_id", F.lit(0).alias("seq"), F.lit("auto_formatted").alias("version_type"), F.col("text").alias("content")))

    with with_rocksdb(elements.sparkSession) if expected is not None else contextlib.nullcontext():
        whole = elements if expected is None else gathered_pages(elements, expected, wait_s)
        run(whole.writeStream.foreachBatch(batch), checkpoint)
    return log.latest()


def stream_job_status(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The latest status of each page: page_id, status, ts. ``events``: event_id, ts, page_id, status.

    A batch adds a table of the pages that it changed; MERGED such tables become one. A batch that is run again
    writes its own table anew, and no table is overwritten that its result reads.
    """
    latest = events.groupBy("page_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"))
    log = StatusLog(events.sparkSession, path, latest.schema, MERGED)
    run(latest.writeStream.outputMode("update").foreachBatch(lambda df, n: log.append(n, df)), checkpoint)
    return log.latest().select("page_id", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"))


def stream_edits(edits: DataFrame, log: VersionLog, checkpoint: str, within: str | None = None, ts: str = "ts", pages: DataFrame | None = None, stale: InvalidationLog | None = None) -> DataFrame:
    """Edits (edit_id, page_id, seq, content), each once, become user_edited versions.

    Ids are kept for ever, unless ``within`` (such as '7 days', of the event time ``ts``) bounds how late a repeated edit comes.
    With ``pages`` (page_id, project_id) and ``stale``, a batch has a second output: the projects of the edited pages, whose cached texts no
    longer hold, with the time ``ts`` of their newest edit (or now, where edits have no such column).
    """

    def batch(df: DataFrame, n: int) -> None:
        if log.has(n) and stale is None:
            return
        df = cut(df)
        if stale is not None:  # first: a batch counts once its versions are complete
            at = F.max(F.col(ts)) if ts in df.columns else F.current_timestamp()
            touched = df.groupBy("page_id").agg(at.cast("timestamp").alias("at"))
            stale.append(n, touched.join(pages.select("page_id", "project_id"), "page_id").groupBy("project_id").agg(F.max("at").alias("at")))
        log.append(n, df.select("page_id", "seq", F.lit("user_edited").alias("version_type"), "content"))

    once = edits.withWatermark(ts, within).dropDuplicatesWithinWatermark(["edit_id"]) if within else edits.dropDuplicates(["edit_id"])
    run(once.writeStream.foreachBatch(batch), checkpoint)
    return log.latest()
