"""Page layout: zones, groups of an anchor and its children, reading order.

Everything is keyed by page_id first, so that one exchange on it serves all windows. Elements
carry their zone: ``path`` ('' for the page, one digit a split below it, in reading order),
its edges zx0, zy0, zx1, zy1 and its type. ``local`` tells which sorter a row is for, so that a
page which both of them sort goes through the same stages twice. Ties always end at element_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.operators import spatial
from pagespan.operators.sides import dealt, tasks
from pagespan.sources.scratch import cut, passing

# Columns and windows are made on call: they need a session.
def cx() -> Column:
    return F.col("bbox_x") + F.col("bbox_width") / 2


def cy() -> Column:
    return F.col("bbox_y") + F.col("bbox_height") / 2


def anchor() -> Column:
    return F.col("class_name").isin(S.ANCHORS)


def child() -> Column:
    return F.col("class_name").isin(S.CHILDREN)


def visual() -> Column:
    return F.col("class_name").isin(S.VISUALS)


#: What a sorter's page is, and a zone of it.
PAGE = ["page_id", "local"]
ZONE = [*PAGE, "path"]


def zone():
    return Window.partitionBy(*ZONE)


#: Sides of boxes that are further out than this make a page faulty: sums of three of them must fit 32 bits.
FARTHEST = 1 << 29


def faulty() -> Column:
    """Whether a row's box cannot be computed with: a side is null, NaN or out of bounds, or the area overflows."""
    sound = [F.abs(F.col(c).cast("double")) <= FARTHEST for c in ("bbox_x", "bbox_y", "bbox_width", "bbox_height")]  # NaN is above all
    return ~F.coalesce(sound[0] & sound[1] & sound[2] & sound[3] & F.try_multiply("bbox_width", "bbox_height").isNotNull(), F.lit(False))


def set_apart(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors and children with an area of pages without a faulty row, and those of the other pages, where an area that is not known counts."""
    area = F.col("bbox_width").cast("double") * F.col("bbox_height").cast("double")
    rows = elements.filter((anchor() | child()) & ~F.coalesce(area <= 0, F.lit(False)))
    rows = cut(rows.withColumn("_bad", F.max(faulty()).over(Window.partitionBy("page_id"))))
    return rows.filter("not _bad").drop("_bad"), rows.filter("_bad").drop("_bad")


def preprocess(elements: DataFrame, document_type: str = "question_based") -> DataFrame:
    """Elements with an area; of question pages only anchors and children."""
    sized = elements.filter(F.col("bbox_width").cast("double") * F.col("bbox_height").cast("double") > 0)
    return sized.filter(anchor() | child()) if document_type == "question_based" else sized


def page_extent(elements: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Elements with page_width and page_height: the page's, or its elements' far edges where null or 0."""
    by = Window.partitionBy("page_id")
    far_x = F.max(F.col("bbox_x") + F.col("bbox_width")).over(by)
    far_y = F.max(F.col("bbox_y") + F.col("bbox_height")).over(by)
    if pages is None:
        return elements.withColumns({"page_width": far_x, "page_height": far_y})
    sized = elements.join(pages.select("page_id", "image_width", "image_height"), "page_id", "left")
    own = lambda c, far: F.coalesce(F.nullif(F.col(c), F.lit(0)), far)
    return sized.withColumns({"page_width": own("image_width", far_x), "page_height": own("image_height", far_y)}).drop("image_width", "image_height")


def two_means(df: DataFrame, by: list[str], value: Column, among: Column, tie: str = "element_id") -> DataFrame:
    """Adds c0 and c1, the centres of the best split of ``value`` (of rows ``among``) in two.

    Exact: every cut of the sorted values is scored from running sums; equal scores go to the
    smaller left part. Null where fewer than two rows count.
    """
    every = Window.partitionBy(*by)
    order = every.orderBy((~among).cast("int"), value, tie).rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(among, value)
    df = df.withColumns({"_k": F.count(v).over(order), "_s": F.sum(v).over(order), "_n": F.count(v).over(every), "_t": F.sum(v).over(every)})
    rest, n = F.col("_t") - F.col("_s"), F.col("_n") - F.col("_k")
    score = F.round(F.col("_s") * F.col("_s") / F.col("_k") + rest * rest / n, 6)
    cut_here = F.when(among & (n > 0), F.struct(score.alias("score"), (-F.col("_k")).alias("left"), (F.col("_s") / F.col("_k")).alias("c0"), (rest / n).alias("c1")))
    return df.withColumn("_best", F.max(cut_here).over(every)).withColumns({"c0": F.col("_best.c0"), "c1": F.col("_best.c1")}).drop("_k", "_s", "_n", "_t", "_best")


def with_zone(elements: DataFrame, local: bool = False) -> DataFrame:
    """The page as one zone, for the local sorter or the global one; needs page_width and page_height."""
    return elements.withColumns({"local": F.lit(local), "path": F.lit(""), "zx0": F.lit(0.0), "zy0": F.lit(0.0), "zx1": F.col("page_width").cast("double"), "zy1": F.col("page_height").cast("double")})


def detect_layout_type(zoned: DataFrame) -> DataFrame:
    """Adds layout_type, n_anchors, c0 and c1 of each row's zone."""
    width, height = F.col("zx1") - F.col("zx0"), F.col("zy1") - F.col("zy0")
    df = two_means(zoned, ZONE, cx(), anchor())
    wide = (F.col("class_name") == S.SEPARATOR) & (F.col("bbox_y") < S.SEPARATOR_TOP * height) & (width > 0) & (F.col("bbox_width") / width >= S.SEPARATOR_WIDTH)
    mid, top = F.when(anchor(), cx()), F.when(anchor(), cy() < S.SPLIT_Y * height)
    many = lambda side: (F.count(F.when(side, mid)).over(zone()) > 1) & (F.stddev_pop(F.when(side, mid)).over(zone()) > S.SPREAD_X * width)
    df = df.withColumns(
        {
            "n_anchors": F.count(mid).over(zone()),
            "_wide": F.max(wide.cast("int")).over(zone()) == 1,
            "_two": (F.min(mid).over(zone()) < F.max(mid).over(zone())) & (F.col("c1") - F.col("c0") >= S.MIN_COLUMN_GAP),
            "_one_side": (F.count_if(top).over(zone()) == 0) | (F.count_if(~top).over(zone()) == 0),
            "_top": many(top),
            "_bottom": many(~top),
        }
    )
    kind = (
        F.when(F.col("n_anchors") < S.MIN_ANCHORS, "STANDARD_1_COLUMN")
        .when(F.col("_wide"), "HORIZONTAL_SEP_PRESENT")
        .when(~F.coalesce(F.col("_two"), F.lit(False)), "STANDARD_1_COLUMN")
        .when(F.col("_one_side"), "STANDARD_2_COLUMN")
        .when(~F.col("_top") & F.col("_bottom"), "MIXED_TOP1_BOTTOM2")
        .when(F.col("_top") & ~F.col("_bottom"), "MIXED_TOP2_BOTTOM1")
        .when(F.col("_top") & F.col("_bottom"), "STANDARD_2_COLUMN")
        .otherwise("UNKNOWN")
    )
    return df.withColumn("layout_type", kind).drop("_wide", "_two", "_one_side", "_top", "_bottom")


def with_separator(df: DataFrame) -> DataFrame:
    """Adds sep (y, element_id, h): the zone's topmost separator, where it splits the zone."""
    width = F.col("zx1") - F.col("zx0")
    wide = (F.col("class_name") == S.SEPARATOR) & (width > 0) & (F.col("bbox_width") / width >= S.SEPARATOR_WIDTH)
    sep = F.min(F.when(wide, F.struct(F.col("bbox_y").alias("y"), "element_id", F.col("bbox_height").alias("h")))).over(zone())
    df = df.withColumn("sep", sep)
    fits = (F.col("sep.y") > F.col("zy0")) & (F.col("sep.y") < F.col("zy1")) & (F.col("sep.y") + F.col("sep.h") < F.col("zy1"))
    return df.withColumn("sep", F.when(fits, F.col("sep")))


def anchor_gaps(df: DataFrame, keys: tuple[str, ...] = tuple(ZONE)) -> DataFrame:
    """Adds gap and gap_y: the widest gap between consecutive anchors' centres, where it reaches the threshold, and its middle."""
    by = Window.partitionBy(*keys)
    order = by.orderBy((~anchor()).cast("int"), "bbox_y", "element_id")
    df = df.withColumns({"_cy": F.lead(cy()).over(order), "_y": F.lead("bbox_y").over(order), "_a": F.lead(anchor()).over(order), "_r": F.row_number().over(order)})
    here = F.when(anchor() & F.col("_a"), F.struct((F.col("_cy") - cy()).alias("gap"), (-F.col("_r")).alias("r"), ((F.col("bbox_y") + F.col("bbox_height") + F.col("_y")) / 2).alias("y")))
    height = F.coalesce(F.avg(F.when(anchor() & (F.col("bbox_height") > 0), F.col("bbox_height"))).over(by), F.lit(float(S.DEFAULT_ANCHOR_HEIGHT)))
    df = df.withColumns({"_g": F.max(here).over(by), "_t": F.greatest(height * S.GAP_RATIO, F.lit(float(S.GAP_PIXELS)))})
    ok = F.col("_g.gap") >= F.col("_t")
    return df.withColumns({"gap": F.when(ok, F.col("_g.gap")), "gap_y": F.when(ok, F.col("_g.y"))}).drop("_cy", "_y", "_a", "_r", "_g", "_t")


def with_gutter(df: DataFrame) -> DataFrame:
    """Adds gutter: where columns part (before the right column; of the local sorter midway), if centres are far enough apart."""
    at = F.when(F.col("local"), (F.col("c0") + F.col("c1")) / 2).otherwise(F.col("c1") - S.COLUMN_MARGIN)
    fits = (F.col("n_anchors") >= S.MIN_ANCHORS) & (F.col("c1") - F.col("c0") >= S.MIN_COLUMN_GAP) & (at > F.col("zx0")) & (at < F.col("zx1"))
    return df.withColumn("gutter", F.when(fits, at))


def split_zones(df: DataFrame) -> DataFrame:
    """One level: every zone that a split applies to becomes its parts; ``done`` marks the final ones."""
    df = with_gutter(anchor_gaps(with_separator(df)).withColumn("gap_y", F.when((F.col("gap_y") > F.col("zy0")) & (F.col("gap_y") < F.col("zy1")), F.col("gap_y"))))
    kind = F.col("layout_type")
    has_sep, has_gap, has_col = F.col("sep").isNotNull(), F.col("gap_y").isNotNull(), F.col("gutter").isNotNull()
    how = (
        F.when(kind == "STANDARD_1_COLUMN", "none")
        .when(kind == "STANDARD_2_COLUMN", F.when(has_col, "columns").otherwise("none"))
        .when(kind.startswith("MIXED"), F.when(has_gap, "gap").when(has_sep, "separator").when(has_col, "columns").otherwise("none"))
        .otherwise(F.when(has_sep, "separator").when(has_col, "columns").when(has_gap, "gap").otherwise("none"))
    )
    df = df.withColumn("_how", how)
    is_sep = (F.col("_how") == "separator") & (F.col("element_id") == F.col("sep.element_id"))
    first = F.when(F.col("_how") == "separator", cy() < F.col("sep.y") + F.col("sep.h") / 2).when(F.col("_how") == "gap", cy() < F.col("gap_y")).when(F.col("_how") == "columns", cx() < F.col("gutter"))
    df = df.withColumns({"_sep": is_sep, "_first": first})
    # a gap above all elements, at the zone's own edge, leaves the zone as it is: there the zone is final
    stuck = (F.col("_how") == "gap") & (F.floor("gap_y") == F.col("zy0")) & (F.max(F.col("_first").cast("int")).over(zone()) == 0)
    df = df.withColumn("_how", F.when(stuck, "none").otherwise(F.col("_how")))
    rows, columns = F.col("_how").isin("separator", "gap"), F.col("_how") == "columns"
    top = F.when(F.col("_how") == "separator", F.col("sep.y").cast("double")).otherwise(F.floor("gap_y").cast("double"))
    bottom = F.when(F.col("_how") == "separator", (F.col("sep.y") + F.col("sep.h")).cast("double")).otherwise(F.floor("gap_y").cast("double"))
    middle = F.floor("gutter").cast("double")
    return df.withColumns(
        {
            "path": F.when(F.col("_how") == "none", F.col("path")).when(F.col("_sep"), F.concat("path", F.lit("1"))).when(F.col("_first"), F.concat("path", F.lit("0"))).otherwise(F.concat("path", F.lit("2"))),
            "zy1": F.when(rows & F.col("_first") & ~F.col("_sep"), top).otherwise(F.col("zy1")),
            "zy0": F.when(rows & ~F.col("_first") & ~F.col("_sep"), bottom).otherwise(F.col("zy0")),
            "zx1": F.when(columns & F.col("_first"), middle).otherwise(F.col("zx1")),
            "zx0": F.when(columns & ~F.col("_first"), middle).otherwise(F.col("zx0")),
            "done": (F.col("_how") == "none") | F.col("_sep") | (kind == "STANDARD_2_COLUMN"),
            "layout_type": F.when(F.col("_sep") | (kind == "STANDARD_2_COLUMN"), "STANDARD_1_COLUMN").otherwise(kind),
        }
    ).drop("_how", "_sep", "_first", "sep", "gap", "gap_y", "gutter", "c0", "c1", "n_anchors")


def zone_tree(elements: DataFrame, local: bool = False) -> DataFrame:
    """Elements with their final zone; needs page_width and page_height."""
    return split_to_end(detect_layout_type(with_zone(elements, local)))


def split_to_end(todo: DataFrame) -> DataFrame:
    """Pages with their layout type as final zones. All pages' zones of a level are split together, until no split applies.

    A level's result is cut, since the plan would otherwise double with each level.
    """
    parts: list[DataFrame] = []
    while True:
        split = cut(split_zones(todo))
        parts.append(split.filter("done").drop("done"))
        rest = split.filter("not done").drop("done", "layout_type")
        if rest.isEmpty():
            break
        todo = detect_layout_type(rest)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adjacent_pairs(zoned: DataFrame, either_side: bool = True, keys: tuple[str, ...] = tuple(ZONE)) -> DataFrame:
    """anchor_id, child_id, anchor_y, dy of anchors and children side by side in one zone."""
    return spatial.side_by_side(zoned.filter(anchor() | child()).withColumn("_a", anchor()), keys, either_side)


def adjacent_assign(pairs: DataFrame, keys: tuple[str, ...] = tuple(ZONE)) -> DataFrame:
    """Each anchor, from the top, takes its best free adjacent child."""
    return spatial.turns(pairs, list(keys))


def nearest_anchor(zoned: DataFrame, taken: DataFrame | None = None, keep_top: bool = True, keys: tuple[str, ...] = tuple(ZONE)) -> DataFrame:
    """anchor_id, child_id, distance: the nearest anchor not below a child, closer than the limit."""
    a = zoned.filter(anchor()).select(*keys, F.col("element_id").alias("anchor_id"), F.col("bbox_y").alias("ay"), cx().alias("ax"), cy().alias("acy"))
    c = zoned.filter(child())
    if taken is not None:
        c = c.join(taken.select(*keys, F.col("child_id").alias("element_id")), [*keys, "element_id"], "left_anti")
    if keep_top:
        first = a.groupBy(*keys).agg(F.min("ay").alias("first_y"))
        high = F.col("bbox_y") < F.col("zy0") + S.TOP_ORPHANS * (F.col("zy1") - F.col("zy0"))
        c = c.join(first, list(keys)).filter(~(high & (cy() < F.col("first_y") - S.NEAR / 2)))
    c = c.select(*keys, F.col("element_id").alias("child_id"), cx().alias("cx"), cy().alias("cy"))
    return spatial.nearest_above(a, c, keys)


def carry_anchor(df: DataFrame, order_y: Column, boundary: Column) -> DataFrame:
    """Adds anchor_id: for rows without, the last anchor in (y, x) order; before the first anchor, rows
    above ``boundary`` (by ``order_y``) are orphans 'top', others the first anchor's; without any
    anchor they are orphans 'top' and 'bottom'. Needs own (anchor already known, or null)."""
    order = _downwards()
    first = F.min(F.when(anchor(), F.struct("bbox_y", "bbox_x", "element_id"))).over(zone())["element_id"]
    last = F.last(F.when(anchor(), F.col("element_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_last": last, "_first": first, "_top": order_y < boundary})
    found = F.coalesce(F.col("own"), F.col("_last"), F.when(~F.col("_top"), F.col("_first")))
    kind = F.when(found.isNull(), F.when(F.col("_top"), "top").otherwise("bottom"))
    return df.withColumns({"anchor_id": found, "orphans": kind}).drop("_last", "_first", "_top")


def group_zones(zoned: DataFrame, proximity: bool = True) -> DataFrame:
    """Elements with anchor_id (null for orphans) and orphans ('top', 'bottom'), by their zone's base case.

    The nearest anchor is looked for in the global sorter's zones only; without ``proximity`` there are none. Zones of up to
    spatial.FEW rows carry their anchors and children as arrays, beside the rows; only larger ones are joined.
    """
    mixed = F.col("layout_type").startswith("MIXED")
    crowded = cut(zoned.filter(~mixed).groupBy(*ZONE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > spatial.FEW))
    n = tasks(zoned)
    # by page: windows over zones and over pages need no other exchange
    df = _known_in_arrays(zoned.repartition("page_id") if n is None else dealt(zoned, n, "page_id"), mixed, proximity)
    if not crowded.isEmpty():
        known = _known_by_joins(zoned.filter(~mixed).join(crowded.select(*ZONE), ZONE, "left_semi"), proximity)
        df = df.join(known.withColumnRenamed("known", "_joined"), [*ZONE, "element_id"], "left").withColumn("known", F.coalesce("known", "_joined")).drop("_joined")
    own = F.when(anchor(), F.col("element_id")).otherwise(F.col("known"))
    height = F.col("zy1") - F.col("zy0")
    return carry_anchor(
        df.withColumn("own", own).drop("known"),
        F.when(mixed, cy()).otherwise(F.col("bbox_y").cast("double")),
        F.col("zy0") + height * F.when(mixed, S.SPLIT_Y).otherwise(S.TOP_ORPHANS),
    ).drop("own")


def _known_by_joins(plain: DataFrame, proximity: bool) -> DataFrame:
    """ZONE, element_id and known (the anchor beside or near it) of children, for zones of any size."""
    taken = adjacent_assign(adjacent_pairs(plain))
    found = [*ZONE, F.col("child_id").alias("element_id"), F.col("anchor_id").alias("known")]
    known = taken.select(*found)
    if proximity:
        known = known.unionByName(nearest_anchor(plain.filter(~F.col("local")), taken).select(*found))
    return known


def _known_in_arrays(zoned: DataFrame, mixed: Column, proximity: bool) -> DataFrame:
    """``zoned`` with known, the same for zones of up to spatial.FEW rows: each zone's pairs are chosen in its first row, without a join."""
    box = F.struct("element_id", "bbox_x", "bbox_y", "bbox_width", "bbox_height", cx().alias("cx"), cy().alias("cy"))
    few = ~mixed & (F.col("_n") <= spatial.FEW)
    df = zoned.withColumns({"_n": F.count(F.lit(1)).over(zone()), "_r": F.row_number().over(_downwards())})
    df = df.withColumns({"_as": F.collect_list(F.when(few & anchor(), box)).over(zone()), "_cs": F.collect_list(F.when(few & child() & ~anchor(), box)).over(zone())})
    df = df.withColumn("_taken", F.when(F.col("_r") == 1, spatial.turns_of(spatial.beside(F.col("_as"), F.col("_cs"))))).drop("_cs")
    df = df.withColumn("_taken", F.first("_taken", ignorenulls=True).over(zone()))
    known = F.get(F.filter("_taken", lambda p: p["c"] == F.col("element_id")), F.lit(0))["a"]
    if proximity:
        high = F.col("bbox_y") < F.col("zy0") + S.TOP_ORPHANS * (F.col("zy1") - F.col("zy0"))
        first = F.array_min(F.transform("_as", lambda a: a["bbox_y"]))
        near = ~F.col("local") & ~(high & (cy() < first - S.NEAR / 2))
        known = F.coalesce(known, F.when(near, spatial.nearest_of(F.col("_as"), cx(), cy())))
    return df.withColumn("known", F.when(few & child() & ~anchor() & (F.size("_as") > 0), known)).drop("_n", "_r", "_as", "_taken")


def _downwards():
    return zone().orderBy("bbox_y", "bbox_x", (~anchor()).cast("int"), "element_id")


GROUP = [*ZONE, "anchor_id", "orphans"]


def _headed(grouped: DataFrame) -> DataFrame:
    """Adds _head (y, x of the group's anchor) and _least (its least y)."""
    by = Window.partitionBy(*GROUP)
    head = F.min(F.when(F.col("element_id") == F.col("anchor_id"), F.struct(F.col("bbox_y").alias("y"), F.col("bbox_x").alias("x")))).over(by)
    return grouped.withColumns({"_head": head, "_least": F.min("bbox_y").over(by)})


def _aimed(headed: DataFrame, whole_page: bool) -> DataFrame:
    """Adds _to (path, y, x, id of an anchor) to visuals that one of the next groups of the zone (or page, anchor groups only) is much closer to.

    Groups come in the order of their heads; read backwards, the last head seen is that of the next group. So no row meets another by a join.
    """
    by = Window.partitionBy(*(PAGE if whole_page else ZONE))
    y, x = F.coalesce(F.col("_head.y"), F.col("_least")), F.coalesce(F.col("_head.x"), F.lit(-1))
    is_head = F.coalesce(F.col("element_id") == F.col("anchor_id"), F.lit(False))
    back = by.orderBy(F.col("path").desc(), y.desc(), x.desc(), F.col("anchor_id").desc_nulls_last(), is_head.cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    head = F.struct("path", F.col("_head.y").alias("y"), F.col("_head.x").alias("x"), F.col("anchor_id").alias("id"))
    df, before = headed, head
    for k in range(1, S.LOOKAHEAD + 1):
        df = df.withColumn(f"_h{k}", F.last(F.when(is_head, F.struct(before.alias("h"))), ignorenulls=True).over(back)["h"])
        before = F.col(f"_h{k}")
    if not whole_page:  # a zone's orphans are a group too, and take a place
        df = df.withColumn("_o", F.min(F.when(F.col("anchor_id").isNull(), F.col("bbox_y"))).over(by))
    d = F.col("bbox_y") - F.col("_head.y")
    off = lambda h: F.abs(F.col("bbox_y") - h["y"])
    for k in range(1, S.LOOKAHEAD + 1):
        h = F.col(f"_h{k}")
        ok = h.isNotNull() & (d > S.MOVE_FROM) & (off(h) < S.MOVE_RATIO * d)
        if k == S.LOOKAHEAD and not whole_page:
            after_own = (F.col("_head.y") < F.col("_o")) | ((F.col("_head.y") == F.col("_o")) & (F.col("_head.x") < -1))
            before_it = (F.col("_o") < h["y"]) | ((F.col("_o") == h["y"]) & (h["x"] >= -1))
            ok = ok & ~F.coalesce(after_own & before_it, F.lit(False))
        # the nearer one, the later on ties
        df = df.withColumn(f"_b{k}", F.when(ok, h) if k == 1 else F.when(ok & F.coalesce(off(h) <= off(F.col(f"_b{k - 1}")), F.lit(True)), h).otherwise(F.col(f"_b{k - 1}")))
    to = F.when(visual() & F.col("anchor_id").isNotNull(), F.col(f"_b{S.LOOKAHEAD}"))
    return df.withColumn("_to", to).drop("_o", *[f"_{c}{k}" for c in "hb" for k in range(1, S.LOOKAHEAD + 1)])


def lookahead_target(grouped: DataFrame, whole_page: bool = False) -> DataFrame:
    """element_id and target anchor of visuals that one of the next two groups is much closer to."""
    to = _aimed(_headed(grouped), whole_page).filter("_to is not null")
    return to.select(*PAGE, "element_id", F.col("_to.id").alias("target"), *([F.col("_to.path").alias("target_path")] if whole_page else []))


def _moved(headed: DataFrame, whole_page: bool) -> DataFrame:
    """All moves found, then applied; _head is that of the new group."""
    df = _aimed(headed, whole_page)
    return df.withColumns(
        {
            "anchor_id": F.coalesce("_to.id", "anchor_id"),
            "path": F.coalesce("_to.path", "path"),
            "_head": F.when(F.col("_to").isNotNull(), F.struct(F.col("_to.y").alias("y"), F.col("_to.x").alias("x"))).otherwise(F.col("_head")),
        }
    ).drop("_to")


def reassign_visuals(grouped: DataFrame, whole_page: bool = False) -> DataFrame:
    """All moves found, then applied."""
    return _moved(_headed(grouped), whole_page).drop("_head", "_least")


def flatten_groups(grouped: DataFrame) -> DataFrame:
    """Adds order_in_question, group_id, order_in_group (all from 0): orphan groups by their top, then anchors' in zone order."""
    return _flattened(_headed(grouped))


def _flattened(headed: DataFrame) -> DataFrame:
    orphan = F.col("anchor_id").isNull()
    group = [
        (~orphan).cast("int"),
        F.when(orphan, F.col("_least")),
        F.col("path"),
        F.col("_head.y"),
        F.col("_head.x"),
        F.col("anchor_id"),
        F.col("orphans").desc(),
    ]
    inner = [(F.col("element_id") != F.coalesce(F.col("anchor_id"), F.lit(-1))).cast("int"), "bbox_y", "bbox_x", "element_id"]
    # one order serves all: a group's rows follow one another, so its number and places are counts from where groups begin
    order = Window.partitionBy(*PAGE).orderBy(*group, *inner)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = headed.withColumns({"order_in_question": F.row_number().over(order) - 1, "_same": F.lag(F.struct("path", "anchor_id", "orphans")).over(order).eqNullSafe(F.struct("path", "anchor_id", "orphans"))})
    df = df.withColumns({"group_id": F.count_if(~F.col("_same")).over(so_far).cast("int") - 1, "_began": F.max(F.when(~F.col("_same"), F.col("order_in_question"))).over(so_far)})
    return df.withColumn("order_in_group", F.col("order_in_question") - F.col("_began")).drop("_same", "_began", "_head", "_least")


SORTED = [*S.ELEMENT_COLUMNS, "order_in_question", "group_id", "order_in_group", "anchor_id"]


def reading_order(elements: DataFrame) -> DataFrame:
    """Rank by (y, x, id); each element is its own group."""
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("bbox_y").asc_nulls_last(), F.col("bbox_x").asc_nulls_last(), "element_id")) - 1
    return elements.withColumn("order_in_question", order).withColumns({"group_id": F.col("order_in_question"), "order_in_group": F.lit(0), "anchor_id": F.lit(None).cast("long")}).select(*SORTED)


def sort_layout(elements: DataFrame, pages: DataFrame | None = None, document_type: str = "question_based", local: bool = False) -> DataFrame:
    """Elements in reading order and question groups, by the global sorter or the local one.

    Pages with a row that cannot be computed with are not sorted: their elements come in (y, x) order (nulls last), each its own group.
    """
    if document_type != "question_based":
        return reading_order(preprocess(elements, document_type))
    sound, other = set_apart(elements)
    return sort_zoned(typed(sound, pages, local), proximity=not local).select(*SORTED).unionByName(reading_order(other))


def typed(kept: DataFrame, pages: DataFrame | None, local: bool = False) -> DataFrame:
    """Anchors and children of pages without a fault, each page one zone with its layout type."""
    return detect_layout_type(with_zone(page_extent(dealt(kept, tasks(kept), "page_id"), pages), local))


def sort_zoned(whole: DataFrame, proximity: bool = True) -> DataFrame:
    """Rows of ``typed`` in order, each by the sorter that its ``local`` tells: SORTED and local."""
    # the levels of zones are cut, and the result; what lies between is windows over a page's rows
    with passing() as keep:
        zoned = split_to_end(whole.drop("page_width", "page_height"))
        grouped = group_zones(zoned, proximity)
        moved = _moved(_moved(_headed(grouped), whole_page=False), whole_page=True)
        return keep(cut(_flattened(moved).select(*SORTED, "local")))
