"""Sorting against a plain model of one page, and properties of its results."""

import collections
import random

import plain_model
import pytest

from pagespan.operators import clean, joins, layout, strategies
from pagespan.sources.tables import Tables


def rows_of(t):
    pages = collections.defaultdict(list)
    for e in t.layout_elements.collect():
        pages[e.page_id].append(dict(id=e.element_id, c=e.class_name, x=e.bbox_x, y=e.bbox_y, w=e.bbox_width, h=e.bbox_height))
    return pages


@pytest.fixture(scope="module")
def t(spark, sf):
    return Tables(spark, sf)


@pytest.fixture(scope="module")
def ordered(t):
    return layout.sort_layout(t.layout_elements, t.doc_pages).collect()


def by_page(rows):
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.page_id, r.order_in_question)):
        got[r.page_id].append((r.element_id, r.group_id, r.order_in_group))
    return got


def test_plain_model(t, ordered):
    got = by_page(ordered)
    for page, elements in rows_of(t).items():
        assert got.get(page, []) == plain_model.sort_page(elements, 2480, 3508), page


def test_each_element_once_and_orders_dense(ordered):
    assert len({r.element_id for r in ordered}) == len(ordered)
    for page, rows in by_page(ordered).items():
        groups = [g for _, g, _ in rows]
        assert groups == sorted(groups) and set(groups) == set(range(max(groups) + 1)), page
        assert all(rows[i][2] == (0 if i == 0 or rows[i - 1][1] != rows[i][1] else rows[i - 1][2] + 1) for i in range(len(rows)))
    assert all(r.order_in_group == 0 for r in ordered if r.element_id == r.anchor_id)


def test_partitioning_does_not_matter(t, ordered):
    again = layout.sort_layout(t.layout_elements.repartition(7, "element_id"), t.doc_pages).collect()
    assert by_page(again) == by_page(ordered)


def test_detections_keep_none_that_overlap(t):
    kept = clean.dedupe_detections(t.layout_elements)
    assert clean.iou_pairs(kept).count() == 0
    pages = collections.defaultdict(list)
    for e in t.layout_elements.collect():
        pages[e.page_id].append(e)
    want = set()
    for es in pages.values():
        stay = []
        for e in sorted(es, key=lambda e: (-e.confidence, e.element_id)):
            if all(overlap(e, k) <= 0.7 for k in stay):
                stay.append(e)
        want |= {e.element_id for e in stay}
    assert {r.element_id for r in kept.collect()} == want


def overlap(a, b):
    w = max(0, min(a.bbox_x + a.bbox_width, b.bbox_x + b.bbox_width) - max(a.bbox_x, b.bbox_x))
    h = max(0, min(a.bbox_y + a.bbox_height, b.bbox_y + b.bbox_height) - max(a.bbox_y, b.bbox_y))
    return w * h / (a.bbox_width * a.bbox_height + b.bbox_width * b.bbox_height - w * h)


def test_adaptive_takes_each_page_from_its_strategy(t):
    profile = {r.page_id: r.strategy for r in strategies.layout_profile(t.layout_elements, t.doc_pages).collect()}
    got = by_page(strategies.sort_adaptive(t.layout_elements, t.doc_pages).collect())
    one = by_page(strategies.sort_global_first(t.layout_elements, t.doc_pages).collect())
    two = by_page(strategies.sort_local_first(t.layout_elements, t.doc_pages).collect())
    for page, strategy in profile.items():
        if strategy == strategies.GLOBAL:
            assert got[page] == one[page]
        elif strategy == strategies.LOCAL:
            assert got[page] == two[page]
        else:
            assert got[page] in (one[page], two[page])


def test_registered_strategy_can_be_forced(t):
    strategies.register_strategy("READING", lambda e, p: layout.reading_order(e))
    got = strategies.sort_adaptive(t.layout_elements, t.doc_pages, force="READING")
    assert got.count() == t.layout_elements.count()
    del strategies.STRATEGIES["READING"]


def test_two_hand_worked_questions(spark):
    rows = [(1, "question number", 120, 110, 70, 50), (2, "question text", 180, 200, 520, 160), (3, "question number", 150, 450, 70, 50), (4, "question text", 210, 540, 520, 170)]
    e = spark.createDataFrame([(i, 1, c, 0.9, x, y, w, h) for i, c, x, y, w, h in rows], "element_id long, page_id long, class_name string, confidence double, bbox_x int, bbox_y int, bbox_width int, bbox_height int")
    pages = spark.createDataFrame([(1, 1240, 1754)], "page_id long, image_width int, image_height int")
    got = {r.element_id: r.anchor_id for r in layout.sort_layout(e, pages).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_empty_table(t):
    none = t.layout_elements.filter("false")
    assert layout.sort_layout(none, t.doc_pages).count() == 0
    assert strategies.sort_adaptive(none, t.doc_pages).count() == 0


def test_spatial_joins_over_bands(spark):
    """Boxes and questions on and across the edges of bands, against all pairs."""
    rng = random.Random(3)
    boxes = [(k % 3, k, rng.choice([0, 40, 512, 1023, 1024]) - rng.choice([0, 0, 7]), rng.choice([3, 512, 700, 1500])) for k in range(150)]
    df = spark.createDataFrame([(p, k, 10 * (k % 4), y, 30, h) for p, k, y, h in boxes] + [(0, 900, None, None, None, None)], "page_id long, element_id long, bbox_x int, bbox_y int, bbox_width int, bbox_height int")
    got = {(r.a, r.b): r.iou for r in clean.iou_pairs(df, 0.3).collect()}
    want = {}
    for p, a, ay, ah in boxes:
        for q, b, by, bh in boxes:
            w, h = 30 - abs(10 * (a % 4) - 10 * (b % 4)), min(ay + ah, by + bh) - max(ay, by)
            if p == q and a < b and w > 0 and h > 0 and w * h / (30 * ah + 30 * bh - w * h) > 0.3:
                want[a, b] = w * h / (30 * ah + 30 * bh - w * h)
    assert got.keys() == want.keys() and len(want) > 100
    questions = [(p, q, y) for p in range(3) for q, y in enumerate((-3, 499, 500, 1900))]
    asked = spark.createDataFrame(questions, "page_id long, question long, q_y int")
    near = {r.element_id: r.question for r in joins.nearest_question(df, asked).collect()}
    for p, k, y, _ in boxes:
        d, _, q = min((abs(y - qy), qy, q) for page, q, qy in questions if page == p)
        assert near[k] == (str(q) if d <= 500 else "unknown")
    assert near[900] == "unknown"


def test_arrays_and_joins_choose_alike(spark, t, ordered, monkeypatch):
    """Small zones' arrays and large zones' joins give the same groups; formerly all zones were joined."""
    from pagespan.operators import spatial

    zoned = layout.zone_tree(layout.page_extent(layout.preprocess(t.layout_elements), t.doc_pages))
    groups = lambda: {(r.element_id, r.path, r.anchor_id, r.orphans) for r in layout.group_zones(zoned).collect()}
    want = groups()
    plan = layout.group_zones(zoned)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    monkeypatch.setattr(spatial, "FEW", 6)
    assert groups() == want
