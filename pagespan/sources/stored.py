"""Tables in folders, in ranges of their key, that are changed range by range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.operators import maintenance as M
from pagespan.sources.scratch import cut

#: Up to so many touched ranges are named to the reader; beyond that a join finds them.
NAMED = 10_000


class StoredTable:
    """A table under ``path``, partitioned by ranges of ``span`` values of ``key`` (such as page_id).

    ``change`` reads and writes only the ranges that its rows touch. Ranges are replaced each as a whole when the
    new files are complete; a reader meanwhile may see old and new ranges side by side.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "page_id", span: int = 4096):
        self.spark, self.path, self.key, self.span = spark, path, key, span

    def _ranged(self, df: DataFrame) -> DataFrame:
        return df.withColumn("key_range", F.floor(F.col(self.key) / self.span).cast("long"))

    def _write(self, df: DataFrame, mode: str) -> None:
        df.repartition("key_range").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("key_range").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(self._ranged(rows), "static")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("key_range")

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the ranges that ``changes`` (rows with the key) touch by what ``apply`` makes of their rows and the changes; how many.

        ``apply`` gets and returns rows as the table has them. A range that it leaves empty keeps no rows.
        """
        changes = cut(self._ranged(changes))
        ranges = cut(changes.select("key_range").distinct())
        named = [r["key_range"] for r in ranges.limit(NAMED + 1).collect()]
        stored = self._stored()
        few = len(named) <= NAMED
        old = stored.filter(F.col("key_range").isin(named)) if few else stored.join(ranges, "key_range", "left_semi")
        new = cut(self._ranged(apply(old.drop("key_range"), changes.drop("key_range")).select(*[c for c in stored.columns if c != "key_range"])))
        strays = new.join(ranges, "key_range", "left_anti")
        if not strays.isEmpty():
            raise ValueError("a change moved rows to ranges that it did not name")
        emptied = ranges.join(new.select("key_range").distinct(), "key_range", "left_anti")
        self._write(new, "dynamic")
        self._delete([r["key_range"] for r in emptied.toLocalIterator()])
        return ranges.count()

    def replace_pages(self, new: DataFrame) -> int:
        """The pages of ``new`` (elements without ids) lose their elements and get these, with ids after the table's largest (one column is read for it)."""
        top = M.largest_id(self.read())
        return self.change(new, lambda old, rows: M.replace_page_elements(old, rows, top))

    def upsert(self, new: DataFrame, key: str) -> int:
        """Rows of ``new`` replace those of equal ``key`` in their ranges."""
        return self.change(new, lambda old, rows: M.upsert(old, rows, key))

    def patch(self, patch: DataFrame, fields: list[str]) -> int:
        """``patch``: the table's key, fields, and fields_set (the names that were given)."""
        return self.change(patch, lambda old, rows: M.patch_rows(old, rows, self.key, fields))

    def delete(self, gone: DataFrame) -> int:
        """All rows of the keys of ``gone`` go."""
        return self.change(gone.select(self.key), lambda old, rows: old.join(rows, self.key, "left_anti"))

    def _delete(self, ranges: list[int]) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for k in ranges:
            at = path(f"{self.path}/key_range={k}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
