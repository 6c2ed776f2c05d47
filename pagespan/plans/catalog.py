"""Every query of the library by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagespan.plans import cleaning, layout, tables_queries
from pagespan.plans.registered import ORACLES, QUERIES
from pagespan.sources.tables import Tables


MODULES = (cleaning, tables_queries, layout)

#: Queries that run a whole sorter, or streams and stages upon it: they come last, so that a time limit reaches all others.
DEAR = [
    "l07_zone_tree", "l10_group_one_column", "l13_sort_layout", "l17_sort_local_first", "l18_sort_hybrid", "l19_sort_adaptive", "a08_group_stats", "a09_build_groups", "u03_unassigned_after_sort",
    "d02_render_numbered", "d05_format_page", "d05_format_page_adaptive", "d07_format_questions_text", "e21_nested_questions", "r01_gathered_pages", "r01_stream_pages",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries, the cheap ones first."""
    return {n: QUERIES[n] for n in sorted(QUERIES, key=DEAR.__contains__)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and question groups of every page."""
    return layout.flagship(Tables(spark, sf_dir))
