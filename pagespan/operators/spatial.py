"""Joins and choices within a page whose work follows what they find, not the square of the page.

Zones of up to FEW rows are compared pair by pair in one cell; larger ones are cut into cells, so that a page of very many
elements is many small joins. Ranges are met by a sweep. Greedy choices run in rounds: in each, what nothing better can
change any more is settled, for all pages at once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.operators.sides import dealt, tasks
from pagespan.sources.scratch import cut

#: Zones of so many rows are one cell; choices among so many pairs of a zone are a fold over one array.
FEW = 64
#: Cells for neighbours side by side are so high at least; the tallest row of a zone covers this many at most.
CELL_HEIGHT, CELLS_A_ROW = 256, 16


def points_in_ranges(ranges: DataFrame, points: DataFrame, low: str, high: str, y: str, by: Iterable[str] = ("page_id",)) -> DataFrame:
    """``ranges`` joined with the points of equal ``by`` from ``low`` to before ``high`` (null: no end), by a sweep.

    Points are numbered in their order of y. A running count of the points before a range's ends, over points and ranges
    together, gives the numbers that it holds; so the join makes just the rows of the result, however ranges overlap.
    Ranges with a null begin and points with a null y meet nothing.
    """
    by = list(by)
    points = points.filter(F.col(y).isNotNull())
    numbered = points.withColumn("_nr", F.row_number().over(Window.partitionBy(*by).orderBy(y)))
    marks = points.select(*by, F.col(y).alias("_from"), F.col(y).alias("_to"), F.lit(1).alias("_point"))
    ends = ranges.filter(F.col(low).isNotNull()).withColumns({"_from": F.col(low), "_to": F.col(high), "_point": F.lit(0)})
    both = ends.unionByName(marks, allowMissingColumns=True)
    # at equal places ranges come first, since points before them count alone; open ends come last
    until = lambda c: F.sum("_point").over(Window.partitionBy(*by).orderBy(c, "_point").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_before", until(F.col("_from").asc())).withColumn("_held", until(F.col("_to").asc_nulls_last()))
    held = both.filter("_point = 0 and _held > _before").withColumn("_nr", F.explode(F.sequence(F.col("_before") + 1, F.col("_held")))).select(*ranges.columns, F.col("_nr").cast("int").alias("_nr"))
    return held.join(numbered, [*by, "_nr"]).drop("_nr")


def _sized(df: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """``df`` with _many (the zone has more than FEW rows) and values of its zone."""
    zone = Window.partitionBy(*keys)
    return df.withColumns({"_many": F.count(F.lit(1)).over(zone) > FEW, **{k: c.over(zone) for k, c in more.items()}})


def side_by_side(both: DataFrame, keys: Iterable[str], either_side: bool) -> DataFrame:
    """keys, anchor_id, child_id, anchor_y, dy of boxes (``both``, _a: anchors) side by side: centres in y nearer than ADJACENT_Y of the mean height, facing edges than ADJACENT_X.

    In cells, an anchor meets the children whose facing edge is in its own or a neighbouring strip of ADJACENT_X pixels, in the
    cells of height that both cover; a pair counts where its common part begins, and once if both sides are near.
    """
    keys = list(keys)
    box = ["bbox_x", "bbox_y", "bbox_width", "bbox_height"]
    both = both.select(*keys, "element_id", *box, "_a")
    n = tasks(both)
    both = both.withColumns({"_cy": F.col("bbox_y") + F.col("bbox_height") / 2, "_e": F.abs(F.col("bbox_height")) / 2 * S.ADJACENT_Y})
    both = _sized(both, keys, _tallest=F.max("_e")).withColumn("_cell", F.greatest(F.lit(float(CELL_HEIGHT)), F.col("_tallest") * 2 / CELLS_A_ROW))
    top, bottom = F.col("_cy") - F.col("_e"), F.col("_cy") + F.col("_e")
    both = both.withColumns({"_top": F.floor(top / F.col("_cell")), "_rows": F.sequence(F.floor(top / F.col("_cell")), F.floor(bottom / F.col("_cell")))})
    left, right = F.col("bbox_x"), F.col("bbox_x") + F.col("bbox_width")
    strip = lambda x, d=0: F.floor(x / S.ADJACENT_X) + d
    cell = lambda side, x: F.struct(F.lit(side).alias("side"), x.cast("long").alias("x"))
    one = F.array(cell(0, F.lit(0)))
    of_anchor = F.array(*[cell(1, strip(right, d)) for d in (-1, 0, 1)], *([cell(2, strip(left, d)) for d in (-1, 0, 1)] if either_side else []))
    of_child = F.array(cell(1, strip(left)), *([cell(2, strip(right))] if either_side else []))
    rows = F.when(F.col("_many"), F.col("_rows")).otherwise(F.array(F.lit(0).cast("long")))

    def side(p: str, wanted: Column, cells: Column) -> DataFrame:
        df = both.filter(wanted).withColumn("_s", F.explode(F.when(F.col("_many"), cells).otherwise(one))).withColumn("_row", F.explode(rows))
        df = df.select(*keys, F.col("_s.side").alias("_side"), F.col("_s.x").alias("_strip"), "_row", *[F.col(c).alias(f"{p}{c}") for c in ("element_id", *box, "_cy", "_top")])
        return dealt(df, n, *keys, "_side", "_strip", "_row")

    met = side("a_", F.col("_a"), of_anchor).join(side("c_", ~F.col("_a"), of_child), [*keys, "_side", "_strip", "_row"])
    on_right = F.abs(F.col("c_bbox_x") - (F.col("a_bbox_x") + F.col("a_bbox_width"))) < S.ADJACENT_X
    on_left = F.abs(F.col("a_bbox_x") - (F.col("c_bbox_x") + F.col("c_bbox_width"))) < S.ADJACENT_X
    dy = F.abs(F.col("a__cy") - F.col("c__cy"))
    near = dy < (F.col("a_bbox_height") + F.col("c_bbox_height")) / 2 * S.ADJACENT_Y
    facing = F.when(F.col("_side") == 0, (on_right | on_left) if either_side else on_right).when(F.col("_side") == 1, on_right).otherwise(on_left & ~on_right)
    here = (F.col("_side") == 0) | (F.greatest("a__top", "c__top") == F.col("_row"))
    return met.filter(near & facing & here).select(*keys, F.col("a_element_id").alias("anchor_id"), F.col("c_element_id").alias("child_id"), F.col("a_bbox_y").alias("anchor_y"), dy.alias("dy"))


def beside(anchors: Column, children: Column) -> Column:
    """anchor_y, anchor_id, dy, child_id of the boxes of two arrays that ``side_by_side`` (either side) finds, in this order."""

    def near(a: Column, c: Column) -> Column:
        dy = F.abs(a["cy"] - c["cy"]) < (a["bbox_height"] + c["bbox_height"]) / 2 * S.ADJACENT_Y
        on_right = F.abs(c["bbox_x"] - (a["bbox_x"] + a["bbox_width"])) < S.ADJACENT_X
        return dy & (on_right | (F.abs(a["bbox_x"] - (c["bbox_x"] + c["bbox_width"])) < S.ADJACENT_X))

    of = lambda a, c: F.struct(a["bbox_y"].alias("anchor_y"), a["element_id"].alias("anchor_id"), F.abs(a["cy"] - c["cy"]).alias("dy"), c["element_id"].alias("child_id"))
    return F.sort_array(F.flatten(F.transform(anchors, lambda a: F.transform(F.filter(children, lambda c: near(a, c)), lambda c: of(a, c)))))


def nearest_of(anchors: Column, x: Column, y: Column) -> Column:
    """Id of the nearest of the anchors of an array that are not below a point, if nearer than NEAR (``nearest_above``)."""
    far = lambda a: F.sqrt(F.pow(S.NEAR_X * (x - a["cx"]), F.lit(2)) + F.pow(y - a["cy"], F.lit(2)))
    met = F.transform(F.filter(anchors, lambda a: a["cy"] <= y), lambda a: F.struct(far(a).alias("d"), a["bbox_y"].alias("ay"), a["element_id"].alias("id")))
    return F.array_min(F.filter(met, lambda m: m["d"] < S.NEAR))["id"]


def nearest_above(anchors: DataFrame, children: DataFrame, keys: Iterable[str]) -> DataFrame:
    """keys, anchor_id, child_id, distance: of the anchors (anchor_id, ay, ax, acy) not below a child (child_id, cx, cy) the nearest, if nearer than NEAR.

    In zones of many anchors children first look only as far as the anchors lie dense; whoever finds one there has its
    nearest. The others look through cells of NEAR (a cluster of children far below a cluster of anchors still meets all of it).
    """
    keys = list(keys)
    one = {"_many": F.lit(False), "_reach": F.lit(float(S.NEAR))}
    crowded = cut(anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW))
    if crowded.isEmpty():
        return _within(anchors.withColumns(one), children.withColumns(one), keys)
    narrow = F.pow(F.lit(2.0), F.least(F.lit(5.0), F.ceil(F.log2(F.col("_n") / FEW) / 2)))
    zone = crowded.select(*keys, F.lit(True).alias("_many"), (S.NEAR / narrow).alias("_reach"))
    dealt = lambda df: df.join(zone, keys, "left").withColumns({"_many": F.coalesce("_many", F.lit(False)), "_reach": F.coalesce("_reach", F.lit(float(S.NEAR)))})
    a, c = cut(dealt(anchors)), cut(dealt(children))
    first = cut(_within(a, c, keys))
    far = c.filter("_many").join(first.select(*keys, "child_id"), [*keys, "child_id"], "left_anti")
    wide = lambda df: df.withColumn("_reach", F.lit(float(S.NEAR)))
    return first.unionByName(_within(wide(a.filter("_many")), wide(far), keys))


def _within(a: DataFrame, c: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest anchor of each child within its zone's reach."""
    across = F.col("_reach") / S.NEAR_X
    row, column = lambda y: F.floor(F.col(y) / F.col("_reach")), lambda x: F.floor(F.col(x) / across)
    none = F.lit(0).cast("long")
    around = F.array(*[F.struct((column("ax") + i).alias("x"), (row("acy") + j).alias("y")) for i in (-1, 0, 1) for j in (0, 1)])
    a = a.withColumn("_c", F.explode(F.when(F.col("_many"), around).otherwise(F.array(F.struct(none.alias("x"), none.alias("y"))))))
    a = a.select(*keys, F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"), "anchor_id", "ay", "ax", "acy")
    c = c.withColumns({"_x": F.when(F.col("_many"), column("cx")).otherwise(none), "_y": F.when(F.col("_many"), row("cy")).otherwise(none)}).drop("_many")
    far = F.sqrt(F.pow(S.NEAR_X * (F.col("cx") - F.col("ax")), F.lit(2)) + F.pow(F.col("cy") - F.col("acy"), F.lit(2)))
    both = c.join(a, [*keys, "_x", "_y"]).filter("acy <= cy").withColumn("distance", far).filter(F.col("distance") < F.col("_reach"))
    best = both.groupBy(*keys, "child_id").agg(F.min(F.struct("distance", "ay", "anchor_id")).alias("b"))
    return best.select(*keys, F.col("b.anchor_id").alias("anchor_id"), "child_id", F.col("b.distance").alias("distance"))


def turns(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, anchor_id, child_id: each anchor, from the top, takes its best free child.

    In rounds: every anchor asks for the best child that it has left, and a child that was asked drops its pairs with anchors
    below the topmost one that asks. When nothing is dropped any more, anchors have what they ask for. All zones' rounds
    run together; zones of up to FEW pairs are folds over one array.
    """
    pairs = cut(pairs.select(*keys, "anchor_y", "anchor_id", "dy", "child_id", (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > FEW).alias("_many")))
    few = _turns_folded(pairs.filter("not _many"), keys)
    left = pairs.filter("_many").drop("_many")
    if left.isEmpty():
        return few
    place = F.struct("anchor_y", "anchor_id")
    asks = F.row_number().over(Window.partitionBy(*keys, "anchor_id").orderBy("dy", "child_id")) == 1
    while True:
        asked = left.withColumn("_asks", asks).withColumn("_first", F.min(F.when(F.col("_asks"), place)).over(Window.partitionBy(*keys, "child_id")))
        asked = cut(asked.withColumn("_drop", F.coalesce(place > F.col("_first"), F.lit(False))).drop("_first"))
        if asked.filter("_drop").isEmpty():
            return few.unionByName(asked.filter("_asks").select(*keys, "anchor_id", "child_id"))
        left = asked.filter("not _drop").drop("_asks", "_drop")


def turns_of(pairs: Column) -> Column:
    """The pairs (a, c) of ids that ``turns`` takes of an array of pairs in their order."""
    return F.aggregate(
        pairs,
        F.expr("cast(array() as array<struct<a: bigint, c: bigint>>)"),
        lambda acc, p: F.when(F.exists(acc, lambda x: (x["a"] == p["anchor_id"]) | (x["c"] == p["child_id"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(p["anchor_id"].alias("a"), p["child_id"].alias("c"))))
        ),
    )


def _turns_folded(pairs: DataFrame, keys: list[str]) -> DataFrame:
    listed = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("anchor_y", "anchor_id", "dy", "child_id"))).alias("ps"))
    return listed.select(*keys, F.explode(turns_of(F.col("ps"))).alias("p")).select(*keys, F.col("p.a").alias("anchor_id"), F.col("p.c").alias("child_id"))


def outshone(pairs: DataFrame) -> DataFrame:
    """page_id, element_id of the boxes that go: ``pairs`` (page_id, better, worse) are boxes that exclude each other.

    A box that is the worse of no pair left stays, and the worse ones of its pairs go, with all their pairs.
    """
    left = cut(pairs.select("page_id", "better", "worse"))
    gone = left.select("page_id", F.col("worse").alias("element_id")).filter("false")
    while not left.isEmpty():
        beaten = left.select("page_id", F.col("worse").alias("better")).distinct()
        lost = cut(left.join(beaten, ["page_id", "better"], "left_anti").select("page_id", F.col("worse").alias("element_id")).distinct())
        gone = gone.unionByName(lost)
        of = lambda c: lost.select("page_id", F.col("element_id").alias(c))
        left = cut(left.join(of("worse"), ["page_id", "worse"], "left_anti").join(of("better"), ["page_id", "better"], "left_anti").select("page_id", "better", "worse"))
    return gone


_SPOT = ["_kw", "_kh", "_x", "_y"]


def _spots(df: DataFrame, least: float, around: bool) -> DataFrame:
    """``df`` with cells (_SPOT) such that boxes whose common part is over ``least`` of their union meet: one has its own cell, the other those around.

    Such boxes differ by less than a factor of 1 / least in width and height, so by one class of sizes at most, and the
    cells of a class are as wide as the places of such boxes can differ.
    """
    q = 1 / least
    wide = lambda k: F.pow(F.lit(q), k + 2) * (1 - least)
    size = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.log(F.lit(q)))
    df = df.withColumns({"_kw": size("bbox_width"), "_kh": size("bbox_height")})
    step = lambda df, c: df.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("_d")).drop("_d") if around else df
    df = step(step(df, "_kw"), "_kh").withColumns({"_x": F.floor(F.col("bbox_x") / wide(F.col("_kw"))), "_y": F.floor(F.col("bbox_y") / wide(F.col("_kh")))})
    return step(step(df, "_x"), "_y")


def _meeting(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """page_id, a, ra, b, rb (ids and ranks) of boxes of the two tables that overlap by more than ``least``."""
    from pagespan.operators.clean import iou

    names = {"element_id": "", "rank": "r", "bbox_x": "x", "bbox_y": "y", "bbox_width": "w", "bbox_height": "h"}
    side = lambda df, p, around: _spots(df, least, around).select("page_id", *_SPOT, *[F.col(c).alias(f"{n}{p}" if n in ("", "r") else f"{p}{n}") for c, n in names.items()])
    both = side(a, "a", True).join(side(b, "b", False), ["page_id", *_SPOT]).filter("a <> b")
    return both.filter(iou("a", "b") > least).select("page_id", "a", "ra", "b", "rb")


def crowded_out(boxes: DataFrame, least: float) -> DataFrame:
    """page_id, element_id of the boxes that greedy suppression drops from pages of very many boxes. ``boxes``: page_id, element_id, rank (least first), box.

    Of equal boxes only the first can stay. While some cell holds more than FEW boxes, the first box of a whole neighbourhood
    stays and drops what it overlaps, in all neighbourhoods at once and without pairs among the others. Then pairs are few
    for each box, and are settled in rounds.
    """
    box = ["bbox_x", "bbox_y", "bbox_width", "bbox_height"]
    best = F.row_number().over(Window.partitionBy("page_id", *box).orderBy("rank")) == 1
    live = cut(boxes.filter("bbox_width > 0 and bbox_height > 0").select("page_id", "element_id", "rank", *box, best.alias("_first")))
    parts = [live.filter("not _first").select("page_id", "element_id")]
    live = live.filter("_first").drop("_first")
    while True:
        heads = cut(_spots(live, least, False).groupBy("page_id", *_SPOT).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("element_id", *box), "rank").alias("top"), F.min("rank").alias("rank")))
        if heads.filter(F.col("n") > FEW).isEmpty():
            break
        around = _spots(heads.select("page_id", "rank", "top.*"), least, True).groupBy("page_id", *_SPOT).agg(F.min("rank").alias("_least"))
        sure = cut(heads.join(around, ["page_id", *_SPOT]).filter(F.col("rank") == F.col("_least")).select("page_id", "rank", "top.*"))
        lost = cut(_meeting(sure, live, least).select("page_id", F.col("b").alias("element_id")).distinct())
        parts.append(lost)
        settled = lost.unionByName(sure.select("page_id", "element_id"))
        live = cut(live.join(settled, ["page_id", "element_id"], "left_anti"))
    pairs = _meeting(live, live, least).filter("ra < rb").select("page_id", F.col("a").alias("better"), F.col("b").alias("worse"))
    parts.append(outshone(pairs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
