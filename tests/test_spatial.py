"""Sweeps, cells and rounds against all pairs and plain loops; dense pages in seconds."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.operators import clean, joins, layout, spatial

ELEMENT = "element_id long, page_id long, class_name string, confidence double, bbox_x int, bbox_y int, bbox_width int, bbox_height int"


def page(spark, boxes):
    return spark.createDataFrame(boxes, ELEMENT)


def scattered(rng, pages=(1, 2, 3), sizes=(30, 200, 60)):
    out, k = [], 0
    for p, n in zip(pages, sizes):
        for _ in range(n):
            k += 1
            h = rng.choice([0, 1, 30, 40, 50, 120, 900])
            out.append((k, p, rng.choice([*S.ANCHORS, *S.CHILDREN]), 0.5, rng.randrange(-60, 900), rng.randrange(-300, 1200), rng.choice([10, 55, 200, 700]), h))
    return out


def centre(e):
    return e[4] + e[6] / 2, e[5] + e[7] / 2


def beside(a, c, either):
    right, left = abs(c[4] - (a[4] + a[6])) < 50, abs(a[4] - (c[4] + c[6])) < 50
    return abs(centre(a)[1] - centre(c)[1]) < (a[7] + c[7]) / 2 * 0.7 and (right or (either and left))


@pytest.mark.parametrize("either", [True, False])
@pytest.mark.parametrize("few", [64, 0])
def test_side_by_side(spark, monkeypatch, either, few):
    """A zone of 200 rows in cells, or all zones; boxes without height, high ones and negative places."""
    monkeypatch.setattr(spatial, "FEW", few)
    rows = scattered(random.Random(1))
    got = collections.Counter((r.anchor_id, r.child_id) for r in layout.adjacent_pairs(page(spark, rows), either, ("page_id",)).collect())
    want = {(a[0], c[0]) for a in rows for c in rows if a[1] == c[1] and a[2] in S.ANCHORS and c[2] in S.CHILDREN and beside(a, c, either)}
    assert set(got) == want and max(got.values()) == 1 and len(want) > 60


@pytest.mark.parametrize("few", [64, 4, 1])
def test_nearest_above(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW", few)
    rows = scattered(random.Random(2), sizes=(3, 250, 70))
    got = {r.child_id: (r.anchor_id, r.distance) for r in layout.nearest_anchor(page(spark, rows), keep_top=False, keys=("page_id",)).collect()}
    want = {}
    for c in rows:
        near = [(((0.2 * (centre(c)[0] - centre(a)[0])) ** 2 + (centre(c)[1] - centre(a)[1]) ** 2) ** 0.5, a[5], a[0]) for a in rows if a[1] == c[1] and a[2] in S.ANCHORS and centre(a)[1] <= centre(c)[1]]
        if c[2] in S.CHILDREN and near and min(near)[0] < 250:
            want[c[0]] = min(near)[2], min(near)[0]
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_ranges(spark):
    """Ranges that overlap, are empty, open, reversed, equal or on a page without points; points at their ends and without place."""
    rng = random.Random(3)
    ranges = [(p, f"q{k}", rng.randrange(0, 40), rng.choice([None, 5, 20, 39, 40])) for p in range(4) for k in range(25)] + [(0, "twin", 3, 9), (0, "twin", 3, 9), (9, "alone", 0, None), (0, "none", None, 5)]
    points = [(p, 100 * p + k, rng.choice([None, *range(40)])) for p in range(3) for k in range(60)]
    got = joins.elements_in_question_range(spark.createDataFrame(ranges, "page_id long, question string, q_y int, next_q_y int"), spark.createDataFrame(points, "page_id long, element_id long, bbox_y int"))
    want = collections.Counter((p, q, e) for p, q, lo, hi in ranges for pp, e, y in points if p == pp and y is not None and lo is not None and lo <= y and (hi is None or y < hi))
    assert collections.Counter(tuple(r) for r in got.collect()) == want and len(want) > 500


@pytest.mark.parametrize("few", [64, 0])
def test_turns(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW", few)
    rng = random.Random(4)
    pairs = {(p, a, 1000 + c): (p, 1000 * p + a, 1000 * p + c + 500, a // 3, rng.randrange(6) / 2) for p, n in ((1, 6), (2, 30), (3, 1)) for a in range(n) for c in range(n) if rng.random() < 0.5}
    df = spark.createDataFrame([*pairs.values()], "page_id long, anchor_id long, child_id long, anchor_y int, dy double")
    got = sorted((r.anchor_id, r.child_id) for r in layout.adjacent_assign(df, ("page_id",)).collect())
    want, used = [], set()
    for p, a, c, _, _ in sorted(pairs.values(), key=lambda r: (r[3], r[1], r[4], r[2])):
        if (a, 0) not in used and (c, 1) not in used:
            used |= {(a, 0), (c, 1)}
            want.append((a, c))
    assert got == sorted(want)


def greedy(rows, most):
    stay = collections.defaultdict(list)
    for e in sorted(rows, key=lambda e: (-e[3], e[0])):
        for k in stay[e[1]]:
            w = min(e[4] + e[6], k[4] + k[6]) - max(e[4], k[4])
            h = min(e[5] + e[7], k[5] + k[7]) - max(e[5], k[5])
            if w > 0 and h > 0 and w * h / (e[6] * e[7] + k[6] * k[7] - w * h) > most:
                break
        else:
            stay[e[1]].append(e)
    return {e[0] for es in stay.values() for e in es}


@pytest.mark.parametrize(("few", "crowded", "most"), [(64, 2048, 0.7), (0, 2048, 0.7), (3, 50, 0.7), (1, 0, 0.7), (2, 0, 0.3)])
def test_greedy_suppression(spark, monkeypatch, few, crowded, most):
    """Folds, rounds over pairs, and rounds over neighbourhoods all equal the plain loop; equal boxes and confidences, boxes without area."""
    monkeypatch.setattr(spatial, "FEW", few)
    monkeypatch.setattr(clean, "CROWDED", crowded)
    rng = random.Random(5)
    rows = [(k, k % 3, "figure", rng.randrange(5) / 4, rng.choice([0, 400]) + rng.randrange(40), rng.choice([0, 300]) + rng.randrange(30), rng.choice([0, 100, 103, 120, 150]), rng.choice([80, 90, 118])) for k in range(300)]
    got = {r.element_id for r in clean.dedupe_detections(page(spark, rows), most).collect()}
    want = greedy(rows, most)
    assert got == want and 60 < len(want) < 200


def test_dense_pages_take_seconds(spark):
    """A page of 100,000 elements for each join, and 50,000 overlapping boxes of one page for each choice."""
    n = 100_000
    k = F.col("element_id")
    mixed = F.pmod(F.xxhash64(k, F.lit(1)), F.lit(2479)).cast("int").alias("bbox_x"), F.pmod(F.xxhash64(k, F.lit(2)), F.lit(3507)).cast("int").alias("bbox_y")
    name = F.when(k % 2 == 0, "question number").otherwise("figure").alias("class_name")
    df = spark.range(n).select(F.col("id").alias("element_id"), F.lit(1).cast("long").alias("page_id")).select("page_id", "element_id", name, *mixed, F.lit(30).alias("bbox_width"), F.lit(20).alias("bbox_height")).repartition(4)
    took = {}

    def timed(what, make):
        began = time.time()
        count = make().count()
        took[what] = time.time() - began
        return count

    assert timed("side by side", lambda: layout.adjacent_pairs(df, keys=("page_id",))) > n
    assert timed("nearest", lambda: layout.nearest_anchor(df, keep_top=False, keys=("page_id",))) > n // 3
    ranges = spark.range(20_000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("question"), (F.col("id") % 3500).cast("int").alias("q_y"), (F.col("id") % 3500 + 1).cast("int").alias("next_q_y"))
    assert timed("ranges", lambda: joins.elements_in_question_range(ranges, df)) > n
    boxes = spark.range(50_000).select(F.col("id").alias("element_id"), F.lit(1).cast("long").alias("page_id"), F.lit("figure").alias("class_name"), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)) / 1000).alias("confidence"), F.pmod(F.xxhash64("id"), F.lit(40)).cast("int").alias("bbox_x"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(30)).cast("int").alias("bbox_y"), (F.lit(400) + F.pmod(F.xxhash64("id", F.lit(4)), F.lit(20))).cast("int").alias("bbox_width"), (F.lit(300) + F.pmod(F.xxhash64("id", F.lit(5)), F.lit(20))).cast("int").alias("bbox_height"))
    assert 1 <= timed("suppression", lambda: clean.dedupe_detections(boxes)) < 30
    one = df.limit(1).select(F.lit(1).cast("long").alias("page_id"))
    links = one.crossJoin(spark.range(300).select(F.col("id").alias("anchor_id"))).crossJoin(spark.range(160).select(F.col("id").alias("child_id"))).withColumns({"anchor_y": F.col("anchor_id").cast("int"), "dy": F.pmod(F.xxhash64("anchor_id", "child_id"), F.lit(1000)) / 10})
    assert timed("turns", lambda: layout.adjacent_assign(links, ("page_id",))) == 160
    assert max(took.values()) < 90, took
