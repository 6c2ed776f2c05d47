"""Sinks: groups, JSON results, project texts; and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.sources.scratch import cut


def write_groups(groups: DataFrame, members: DataFrame, path: str, buckets: int = 64) -> None:
    """Groups and element map, partitioned by hash of the page. Pages written again replace what they had:
    a bucket's other pages are carried over, and only buckets with new pages are rewritten."""
    for name, df in (("question_groups", groups), ("question_elements", members)):
        at, df = f"{path}/{name}", df.withColumn("bucket", F.pmod(F.hash("page_id"), F.lit(buckets)))
        try:
            old = df.sparkSession.read.schema(df.schema).parquet(at)
            keep = old.join(df.select("bucket").distinct(), "bucket", "left_semi").join(df.select("page_id").distinct(), "page_id", "left_anti")
            df = cut(df.unionByName(keep.select(*df.columns)))
        except Exception as e:  # the first write
            if "PATH_NOT_FOUND" not in str(e):
                raise
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)


def write_json_results(results: DataFrame, path: str) -> None:
    """Nested results, one JSON object a line, in compressed files (.json.gz)."""
    results.write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)


def write_project_text(combined: DataFrame, path: str, span: int = 1) -> None:
    """combined_text of each project, as text under project_id=<id>; with a ``span`` over 1, as JSON lines (project_id,
    combined_text) under project_range=<project_id / span>, so that files grow with the ranges of ids instead of the projects."""
    if span > 1:
        ranged = combined.select("project_id", "combined_text", F.floor(F.col("project_id") / span).cast("long").alias("project_range"))
        ranged.repartition("project_range").write.mode("overwrite").partitionBy("project_range").json(path)
    else:
        combined.select("project_id", F.col("combined_text").alias("value")).write.mode("overwrite").partitionBy("project_id").text(path)


def read_project_text(spark: SparkSession, path: str) -> DataFrame:
    """project_id and combined_text of what was written in ranges; ``project_range`` finds a project's file."""
    return spark.read.schema("project_id long, combined_text string, project_range long").json(path)


def resume_remaining(inputs: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Inputs whose key is not done."""
    return inputs.join(done.select(key), key, "left_anti")
