"""Joins of pages, elements, texts and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan.operators.sides import dealt, if_small, tasks
from pagespan.operators.spatial import points_in_ranges
from pagespan.sources.scratch import cut


def page_with_content(elements: DataFrame, texts: DataFrame, ai: DataFrame) -> DataFrame:
    """Elements with their texts, each at most one."""
    return elements.join(texts.select("element_id", "ocr_text"), "element_id", "left").join(ai.select("element_id", "description"), "element_id", "left")


def nested_pages(content: DataFrame) -> DataFrame:
    """One row a page with its elements in (y, x) order."""
    item = F.struct("bbox_y", "bbox_x", "element_id", "class_name", "ocr_text", "description")
    return by_page(content, F.array_sort(F.collect_list(item)).alias("elements"))


#: Elements of so many consecutive ids lie in one range.
RANGE_BITS = 16


def content_in_ranges(elements: DataFrame, texts: DataFrame, ai: DataFrame, pages: bool = True) -> DataFrame:
    """The rows of ``page_with_content``, dealt by ranges of element ids, with what ``in_pages`` needs to leave there pages that lie in one range (without ``pages``: the rows alone).

    Texts are shuffled once, and again only those of pages that lie in several ranges; joins would shuffle all by element and then by page.
    Elements are numbers, and are written once: whether any page lies in several ranges is asked before texts are moved.
    """
    number = F.col("element_id").cast("long")
    found = F.coalesce(F.shiftright(number, RANGE_BITS), F.lit(1 << 62))  # elements without an id: a range that no id has
    page, own, several = Window.partitionBy("page_id"), elements.withColumn("_range", found), False
    if pages:
        own = cut(own.withColumn("_whole", F.min("_range").over(page) == F.max("_range").over(page)))
        several = not own.filter("not _whole").isEmpty()
    said = lambda df, column: df.filter("element_id is not null").select("element_id", found.alias("_range"), column)
    rows = own.withColumn("_own", F.lit(True))
    for side, column in ((texts, "ocr_text"), (ai, "description")):
        rows = rows.unionByName(said(side, column).withColumn(f"_{column}", F.struct(column)).drop(column), allowMissingColumns=True)
    element = Window.partitionBy("_range", "element_id")
    n = tasks(own)
    rows = rows.repartition("_range") if n is None else dealt(rows, n, "_range")
    rows = rows.withColumns({c: F.collect_list(f"_{c}").over(element) for c in ("ocr_text", "description")}).filter("_own")
    kept = [*elements.columns, *(["_range"] if pages else []), *(["_whole"] if several else [])]
    return rows.select(*kept, F.explode_outer("ocr_text").alias("_t"), "description").select(
        *kept, F.col("_t.ocr_text").alias("ocr_text"), F.explode_outer("description").alias("_d")
    ).select(*elements.columns, "ocr_text", F.col("_d.description").alias("description"), *kept[len(elements.columns) :])


def in_pages(content: DataFrame, make: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """What ``make`` makes of rows and the columns that tell their page. Of ``content_in_ranges``, pages within one range stay where they are."""
    if "_range" not in content.columns:
        return make(content, ["page_id"])
    if "_whole" not in content.columns:
        return make(content, ["_range", "page_id"]).drop("_range")
    there = make(content.filter("_whole"), ["_range", "page_id"]).drop("_range")
    return there.unionByName(make(content.filter("not _whole").drop("_range"), ["page_id"]))


def by_page(content: DataFrame, *aggregates: Column) -> DataFrame:
    """One row a page, as ``in_pages``."""
    return in_pages(content, lambda rows, page: rows.groupBy(*page).agg(*aggregates))


def project_details(projects: DataFrame, pages: DataFrame, types: DataFrame, combined: DataFrame) -> DataFrame:
    per = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_pages"))
    return (
        projects.join(per, "project_id", "left")
        .join(if_small(types.select("doc_type_id", "type_name", "sorting_method")), "doc_type_id", "left")
        .join(combined.select("project_id", "combined_text"), "project_id", "left")
        .withColumn("total_pages", F.coalesce("total_pages", F.lit(0)))
    )


def attach_text(elements: DataFrame, texts: DataFrame, last_wins: bool = False) -> DataFrame:
    """Elements with the first (or last) non-blank row of ``texts`` (element_id, seq, text)."""
    filled = texts.filter(F.trim("text") != "")
    pick = F.max_by if last_wins else F.min_by
    return elements.join(filled.groupBy("element_id").agg(pick("text", "seq").alias("text")), "element_id", "left")


def sync_sorted(elements: DataFrame, sorted_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with the order and group found for them; and sorted ids that have no element."""
    found = sorted_.select("element_id", "order_in_question", "group_id", "order_in_group")
    return elements.join(found, "element_id"), found.join(elements.select("element_id"), "element_id", "left_anti")


def elements_in_question_range(questions: DataFrame, elements: DataFrame) -> DataFrame:
    """page_id, question, element_id: elements from a question's y to before the next one's.

    ``questions``: page_id, question, q_y, next_q_y (null: to the page's end).
    """
    e = elements.select("page_id", "element_id", "bbox_y")
    return points_in_ranges(questions.select("page_id", "question", "q_y", "next_q_y"), e, "q_y", "next_q_y", "bbox_y").select("page_id", "question", "element_id")


def nearest_question(results: DataFrame, questions: DataFrame, most: int = 500) -> DataFrame:
    """page_id, element_id, question: the one least far in y; 'unknown' beyond ``most`` or without coordinates.

    Elements meet the questions of their own and the neighbouring bands of ``most`` pixels only.
    """
    band = lambda y: F.floor(F.col(y) / most)
    asked = questions.select("page_id", "question", "q_y", F.explode(F.sequence(band("q_y") - 1, band("q_y") + 1)).alias("band"))
    d = F.abs(F.col("bbox_y") - F.col("q_y"))
    best = results.select("page_id", "element_id", "bbox_y", band("bbox_y").alias("band")).join(asked, ["page_id", "band"]).groupBy("element_id").agg(F.min(F.struct(d.alias("d"), "q_y", "question")).alias("b"))
    out = results.select("page_id", "element_id").join(best, "element_id", "left")
    return out.select("page_id", "element_id", F.when(F.col("b.d") <= most, F.col("b.question").cast("string")).otherwise("unknown").alias("question"))


def apply_rule_overrides(base: DataFrame, stored: DataFrame, document_type: str) -> DataFrame:
    """Base rules with the stored ones of the type over them; an empty stored suffix is a line end."""
    own = stored.filter(F.col("document_type") == document_type).select("class_name", F.coalesce("prefix", F.lit("")).alias("_p"), F.coalesce(F.nullif("suffix", F.lit("")), F.lit("\n")).alias("_s"), F.coalesce("indent", F.lit(0)).alias("_i"))
    both = base.filter(F.col("document_type") == document_type).join(if_small(own), "class_name", "left")
    return both.withColumns({"prefix": F.coalesce("_p", "prefix"), "suffix": F.coalesce("_s", "suffix"), "indent": F.coalesce("_i", "indent")}).drop("_p", "_s", "_i")


def current_versions_for_pages(versions: DataFrame, pages: DataFrame) -> DataFrame:
    return versions.filter("is_current").join(pages.select("page_id"), "page_id", "left_semi")


def coverage_gaps(inputs: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which: 'no expectation' or 'no input'."""
    a = inputs.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("gap", F.lit("no expectation"))
    return a.unionByName(expected.select(key).distinct().join(inputs.select(key), key, "left_anti").withColumn("gap", F.lit("no input")))


def merge_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old pages and the new ones with unseen ids, by page number."""
    return old.unionByName(new.dropDuplicates(["page_id"]).join(old.select("page_id"), "page_id", "left_anti").select(*old.columns)).orderBy("page_number", "page_id")


def union_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("class_name").union(b.select("class_name")).distinct()


def unassigned(elements: DataFrame, sorted_: DataFrame) -> DataFrame:
    """Anchors that head no group and children in no anchor's group: page_id, element_id, kind."""
    from pagespan.operators.layout import anchor, child

    kind = F.when(anchor(), "anchor").when(child(), "child")
    rows = elements.select("page_id", "element_id", kind.alias("kind")).filter("kind is not null")
    served = F.array_compact(F.array(F.when(F.col("element_id") == F.col("anchor_id"), F.lit("anchor")), F.when(F.col("anchor_id").isNotNull(), F.lit("child"))))
    return rows.join(sorted_.select("element_id", F.explode(served).alias("kind")), ["element_id", "kind"], "left_anti").select("page_id", "element_id", "kind")


def in_order(*parts: DataFrame, by: list) -> DataFrame:
    """Parts one after the other, each in the order ``by``: adds place, from 0 a page."""
    tagged = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("_part", *by)) - 1).drop("_part")
