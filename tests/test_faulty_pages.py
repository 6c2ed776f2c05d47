"""A page whose boxes cannot be computed with keeps its elements in (y, x) order; other pages are as without it."""

import pytest
from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.operators import layout, strategies
from pagespan.sources.tables import Tables

BIG = 2**31 - 1
FAULTS = {
    "whole numbers": [(None, 10, 5, 5), (3, None, 5, 5), (3, 4, None, 5), (3, 4, 5, None), (BIG, 10, 5, 5), (3, 4, 100_000, 100_000), (3, BIG, 5, BIG), (-BIG - 1, 4, 5, 5)],
    "nan": [(float("nan"), 10.0, 5.0, 5.0), (1.0, 2.0, float("nan"), 5.0), (float("inf"), 3.0, 5.0, 5.0)],
}


def rows_of(df):
    return {tuple(r) for r in df.select("page_id", "element_id", "order_in_question", "group_id", "order_in_group", "anchor_id").collect()}


@pytest.mark.parametrize(("kind", "sorter"), [("nan", strategies.sort_global_first), ("whole numbers", strategies.sort_adaptive)])
def test_faults_stay_within_their_page(spark, sf, kind, sorter):
    t = Tables(spark, sf)
    good = t.layout_elements.filter("page_id < 6")
    number = "double" if kind == "nan" else "int"
    if kind == "nan":
        good = good.withColumns({c: F.col(c).cast("double") for c in S.ELEMENT_COLUMNS[4:]})
    bad, want = [], {}
    for k, fault in enumerate(FAULTS[kind]):
        page, one = 900 + k, 1.0 if kind == "nan" else 1
        boxes = [(100 * one, 50 * one, 9 * one, 9 * one), fault, (90 * one, 50 * one, 9 * one, 9 * one), (7 * one, 7 * one, 0 * one, 9 * one)]
        bad += [(page * 10 + i, page, "question number" if i else "figure", 0.5, *b) for i, b in enumerate(boxes)]
        place = lambda i: tuple((v is None, v) for v in (boxes[i][1], boxes[i][0]))  # noqa: E731, B023
        want[page] = [page * 10 + i for i in sorted(range(3), key=lambda i: (place(i)[0][0], place(i)[0][1] or 0, place(i)[1][0], place(i)[1][1] or 0, i))]  # the last has no area
    schema = S.ELEMENT.replace("int", number)
    both = good.unionByName(spark.createDataFrame(bad, schema))
    got = sorter(both, t.doc_pages)
    got = rows_of(got)
    alone = rows_of(sorter(good, t.doc_pages))
    assert {r for r in got if r[0] < 900} == alone and len(alone) > 50
    for page, ids in want.items():
        mine = sorted((r[2], r[1], r[3], r[4], r[5]) for r in got if r[0] == page)
        assert [r[1] for r in mine] == ids and [r[0] for r in mine] == [r[2] for r in mine] == list(range(len(ids)))
        assert all(r[3] == 0 and r[4] is None for r in mine)


def test_far_boxes_within_bounds_are_sorted(spark):
    """The largest sides that count as sound do not overflow in any step."""
    far = layout.FARTHEST
    rows = [(k, 1, c, 0.5, x, y, w, h) for k, (c, x, y, w, h) in enumerate([("question number", far, far, 3, far), ("figure", far, far, far, 3), ("question text", -far, -far, 4, 5), ("question number", 0, far, far, 1), ("question type", 1, 1, 2, 2)])]
    out = layout.sort_layout(spark.createDataFrame(rows, S.ELEMENT)).collect()
    assert len(out) == 5 and any(r.anchor_id is not None for r in out)
