"""Zones are split until no split applies, however deep."""

from pagespan import schema as S
from pagespan.operators import layout

SCHEMA = "page_id long, element_id long, class_name string, bbox_x long, bbox_y long, bbox_width long, bbox_height long"


def number() -> str:
    return next(c for c in S.ANCHORS if c != S.SEPARATOR)


def test_twenty_levels(spark):
    """Every wide separator takes one level."""
    rows = [(1, k, S.SEPARATOR, 0, 100 * (k + 1), 1000, 10) for k in range(20)]
    rows += [(1, 100 + k, number(), 10, 5000 + 300 * k, 50, 20) for k in range(4)]
    page = layout.page_extent(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, 1000, 100_000)], "page_id long, image_width long, image_height long"))
    got = {r["element_id"]: r["path"] for r in layout.zone_tree(page).collect()}
    assert got == {k: "2" * k + "1" for k in range(20)} | {100 + k: "2" * 20 for k in range(4)}
