"""Cleaning detections and elements: boxes, classes, validation, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.operators import spatial
from pagespan.operators.sides import if_small
from pagespan.sources.scratch import cut


def with_geometry(elements: DataFrame) -> DataFrame:
    """Adds area, x_position, y_position, the centre, and the far corner."""
    return elements.withColumns(
        {
            "area": F.col("bbox_width") * F.col("bbox_height"),
            "x_position": F.col("bbox_x"),
            "y_position": F.col("bbox_y"),
            "cx": F.col("bbox_x") + F.col("bbox_width") / 2,
            "cy": F.col("bbox_y") + F.col("bbox_height") / 2,
            "x2": F.col("bbox_x") + F.col("bbox_width"),
            "y2": F.col("bbox_y") + F.col("bbox_height"),
        }
    )


def xyxy_to_xywh(detections: DataFrame) -> DataFrame:
    """Corners x1..y2, cut to whole pixels, as bbox_x, bbox_y, bbox_width, bbox_height."""
    c = {k: F.col(k).cast("int") for k in ("x1", "y1", "x2", "y2")}
    return detections.withColumns({"bbox_x": c["x1"], "bbox_y": c["y1"], "bbox_width": c["x2"] - c["x1"], "bbox_height": c["y2"] - c["y1"]})


def class_table(spark) -> DataFrame:
    return spark.createDataFrame([*S.CLASS_NAMES.items()], "class_id int, class_name string")


def resolve_class_name(detections: DataFrame, names: DataFrame) -> DataFrame:
    """Adds class_name from a table of ids (a model's classes, small by nature); unknown ids are unknown_<id>."""
    named = detections.join(if_small(names.select("class_id", F.col("class_name").alias("_name"))), "class_id", "left")
    return named.withColumn("class_name", F.coalesce("_name", F.concat(F.lit("unknown_"), F.col("class_id").cast("string")))).drop("_name")


def drop_small(elements: DataFrame, least: int = 100) -> DataFrame:
    return elements.filter(F.col("bbox_width") * F.col("bbox_height") >= least)


def clamp_to_page(elements: DataFrame, width: Column, height: Column, keep_pixel: bool = False) -> DataFrame:
    """Boxes cut at the page's edges; empty ones go, or keep one pixel."""
    x1, y1 = F.greatest(F.col("bbox_x"), F.lit(0)), F.greatest(F.col("bbox_y"), F.lit(0))
    if keep_pixel:
        x1, y1 = F.least(x1, width - 1), F.least(y1, height - 1)
    x2, y2 = F.least(F.col("bbox_x") + F.col("bbox_width"), width), F.least(F.col("bbox_y") + F.col("bbox_height"), height)
    w, h = x2 - x1, y2 - y1
    if keep_pixel:
        w, h = F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1))
    out = elements.withColumns({"bbox_x": x1, "bbox_y": y1, "bbox_width": w, "bbox_height": h})
    return out if keep_pixel else out.filter("bbox_width > 0 and bbox_height > 0")


def box_ratios(elements: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds width_ratio and height_ratio (of the image's; null where that is 0 or null) and the whole-pixel centre."""
    return elements.withColumns(
        {
            "width_ratio": F.col("bbox_width") / F.nullif(width, F.lit(0)),
            "height_ratio": F.col("bbox_height") / F.nullif(height, F.lit(0)),
            "center_x": F.floor(F.col("bbox_x") + F.col("bbox_width") / 2).cast("int"),
            "center_y": F.floor(F.col("bbox_y") + F.col("bbox_height") / 2).cast("int"),
        }
    )


def physical_size(pages: DataFrame, dpi: Column | None = None) -> DataFrame:
    """Adds effective_dpi and the page's size in inches."""
    given = F.lit(None).cast("double") if dpi is None else dpi
    by_height = F.when(F.col("image_height") > 0, F.least(F.greatest(F.col("image_height") / S.PAGE_INCHES, F.lit(S.MIN_DPI)), F.lit(S.MAX_DPI)))
    pages = pages.withColumn("effective_dpi", F.coalesce(F.when(given > 0, given), by_height, F.lit(S.DPI)))
    return pages.withColumns({"width_inches": F.col("image_width") / F.col("effective_dpi"), "height_inches": F.col("image_height") / F.col("effective_dpi")})


def scale_boxes(elements: DataFrame, from_size: tuple[Column, Column], to_size: tuple[Column, Column]) -> DataFrame:
    """Adds the box on a display of another size, the fitting scale, and the stroke's width."""
    sx, sy = to_size[0] / from_size[0], to_size[1] / from_size[1]
    return elements.withColumns(
        {
            "scaled_x": F.col("bbox_x") * sx,
            "scaled_y": F.col("bbox_y") * sy,
            "scaled_width": F.col("bbox_width") * sx,
            "scaled_height": F.col("bbox_height") * sy,
            "fit_scale": F.least(sx, sy),
            "stroke_width": F.least(F.greatest(F.lit(2.0) / ((sx + sy) / 2), F.lit(1.0)), F.lit(4.0)),
        }
    )


def element_faults(elements: DataFrame) -> DataFrame:
    """Adds faults: what is wrong with a row, empty for valid ones."""
    rules = {
        "element_id": F.col("element_id") >= 1,
        "class_name": F.length("class_name").between(1, 100),
        "confidence": F.col("confidence").between(0, 1),
        "position": (F.col("bbox_x") >= 0) & (F.col("bbox_y") >= 0),
        "size": (F.col("bbox_width") >= 1) & (F.col("bbox_height") >= 1),
    }
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return elements.withColumn("faults", F.array_compact(F.array(*named)))


def validate_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their faults."""
    judged = element_faults(elements)
    return judged.filter(F.size("faults") == 0).drop("faults"), judged.filter(F.size("faults") > 0)


def canonical_class(name: Column) -> Column:
    """Lower case with blanks; second_question_number keeps its underscores, as the rules name it."""
    spaced = F.translate(F.lower(name), "_", " ")
    under = F.translate(F.lower(name), " ", "_")
    return F.when(under.isin("second_question_number", "figure_caption", "formula_caption", "isolated_formula"), under).otherwise(spaced)


def map_doc_type(projects: DataFrame, overrides: Column | None = None) -> DataFrame:
    """Adds sorting_method and model_name by doc_type_id; an override outside the known models is refused (null and faults)."""
    models = [m for _, _, m, _ in S.DOCUMENT_TYPES]
    wanted = F.lit(None).cast("string") if overrides is None else overrides
    by_type = F.when(F.col("doc_type_id") == 2, models[1]).otherwise(models[0])
    return projects.withColumns(
        {
            "sorting_method": F.when(F.col("doc_type_id").isin(2, 3), "reading_order").otherwise("question_based"),
            "model_name": F.when(wanted.isNull(), by_type).when(wanted.isin(models), wanted),
            "model_fault": wanted.isNotNull() & ~wanted.isin(models),
        }
    )


def route_ocr(elements: DataFrame, general: bool = True) -> DataFrame:
    """Elements to recognise, with their engine: number classes go to 'tesseract', others to 'vision' if enabled."""
    rest = "vision" if general else "tesseract"
    return elements.filter(F.col("class_name").isin(S.OCR_CLASSES)).withColumn("engine", F.when(F.col("class_name").isin(S.NUMBER_CLASSES), "tesseract").otherwise(rest))


def coalesce_ocr(elements: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary text or else the fallback's, and whose it is; only texts of more than one character."""
    from pagespan.functions.text import strip

    p = primary.select("element_id", F.nullif(strip(F.col("ocr_text")), F.lit("")).alias("_p"))
    f = fallback.select("element_id", F.nullif(strip(F.col("ocr_text")), F.lit("")).alias("_f"))
    both = elements.join(p, "element_id", "left").join(f, "element_id", "left")
    both = both.withColumns({"text": F.coalesce("_p", "_f"), "engine": F.when(F.col("_p").isNotNull(), "primary").when(F.col("_f").isNotNull(), "fallback")})
    return both.filter(F.length("text") > 1).drop("_p", "_f")


def ai_targets(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("class_name").isin(S.VISUALS) & (F.col("bbox_width") > 0) & (F.col("bbox_height") > 0))


def parse_bbox_variant(rows: DataFrame, listed: str = "bbox", struct: str = "box") -> DataFrame:
    """Boxes given as [x, y, w, h] or as a struct, as columns; sizes are one pixel at least."""
    part = lambda i, name: F.coalesce(F.get(F.col(listed), F.lit(i)), F.col(f"{struct}.{name}"))
    return rows.withColumns({"bbox_x": part(0, "x"), "bbox_y": part(1, "y"), "bbox_width": F.greatest(F.lit(1), part(2, "w")), "bbox_height": F.greatest(F.lit(1), part(3, "h"))})


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes (prefixes of x, y, w, h columns or struct fields)."""
    c = lambda p, n: F.col(f"{p}{n}")
    return box_iou(*[c(a, n) for n in "xywh"], *[c(b, n) for n in "xywh"])


def box_iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = w * h
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


#: Boxes are compared within horizontal bands of their page, so high: a page of very many boxes is many small joins.
GRID = 512


def iou_pairs(elements: DataFrame, least: float = S.IOU) -> DataFrame:
    """Pairs of one page whose boxes overlap more than ``least``: page_id, a, b (ids, a < b), iou."""
    top, bottom = F.floor(F.col("bbox_y") / GRID), F.floor((F.col("bbox_y") + F.col("bbox_height")) / GRID)
    dealt = elements.filter(bottom >= top).withColumn("band", F.explode(F.sequence(top, bottom)))
    side = lambda p: dealt.select("page_id", "band", F.col("element_id").alias(p), *[F.col(f"bbox_{n}").alias(f"{p}{k}") for k, n in zip("xywh", ("x", "y", "width", "height"), strict=True)])
    a, b = side("a"), side("b")
    # boxes that overlap that much start within one box's size of another: a cheap test before the ratio
    touch = (F.col("ax") < F.col("bx") + F.col("bw")) & (F.col("bx") < F.col("ax") + F.col("aw")) & (F.col("ay") < F.col("by") + F.col("bh")) & (F.col("by") < F.col("ay") + F.col("ah"))
    # a pair counts in the band where its common part begins, so once
    here = F.floor(F.greatest("ay", "by") / GRID) == F.col("band")
    pairs = a.join(b, ["page_id", "band"]).filter((F.col("a") < F.col("b")) & touch & here)
    return pairs.withColumn("iou", iou("a", "b")).filter(F.col("iou") > least).select("page_id", "a", "b", "iou")


#: Pages of more boxes than this are compared in cells of box size.
CROWDED = 2048


def _rank() -> Column:
    """Best first: by confidence, then id."""
    return F.struct((-F.col("confidence")).alias("c"), F.col("element_id").alias("id"))


def dedupe_detections(elements: DataFrame, most: float = S.IOU) -> DataFrame:
    """Greedy suppression: by confidence (then id), a box goes if it overlaps a kept one by more than ``most``.

    Only boxes in some overlapping pair can go or make others go, so that the fold runs over these
    alone, a page's at a time; all other boxes stay without being collected. Pages with many such boxes are settled in
    rounds over their pairs, and pages of more than CROWDED boxes do not form all pairs of overlapping boxes either.
    """
    crowded = cut(elements.groupBy("page_id").count().filter(F.col("count") > CROWDED).select("page_id"))
    gone = []
    if not crowded.isEmpty():
        gone.append(spatial.crowded_out(elements.join(crowded, "page_id", "left_semi").withColumn("rank", _rank()), most))
    plain = elements.join(crowded, "page_id", "left_anti") if gone else elements
    pairs = cut(iou_pairs(plain, most).select("page_id", "a", "b"))
    in_pair = pairs.select("page_id", F.explode(F.array("a", "b")).alias("element_id")).distinct()
    in_pair = in_pair.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("page_id")) > spatial.FEW)
    boxes = plain.join(in_pair, ["page_id", "element_id"])
    gone.append(_folded(boxes.filter("not _many"), most))
    many = cut(boxes.filter("_many").select("page_id", "element_id", _rank().alias("rank")))
    if not many.isEmpty():
        ranked = lambda c: many.select("page_id", F.col("element_id").alias(c), F.col("rank").alias(f"r{c}"))
        both = pairs.join(ranked("a"), ["page_id", "a"]).join(ranked("b"), ["page_id", "b"])
        first = F.col("ra") < F.col("rb")
        gone.append(spatial.outshone(both.select("page_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"))))
    out = elements
    for part in gone:
        out = out.join(part, ["page_id", "element_id"], "left_anti")
    return out.select(*elements.columns)


def _folded(boxes: DataFrame, most: float) -> DataFrame:
    """page_id, element_id of the boxes that go, by a fold over each page's sorted boxes."""
    box = F.struct((-F.col("confidence")).alias("c"), F.col("element_id").alias("id"), F.col("bbox_x").alias("x"), F.col("bbox_y").alias("y"), F.col("bbox_width").alias("w"), F.col("bbox_height").alias("h"))
    listed = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("bs"))
    over = lambda p, q: box_iou(p["x"], p["y"], p["w"], p["h"], q["x"], q["y"], q["w"], q["h"]) > most
    kept = F.aggregate("bs", F.slice("bs", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: over(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return listed.select("page_id", F.explode(F.array_except(F.transform("bs", lambda b: b["id"]), F.transform(kept, lambda b: b["id"]))).alias("element_id"))
