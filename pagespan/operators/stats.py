"""Counts and statistics of pages, classes, projects, groups and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan.operators import layout as L


def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def project_statistics(pages: DataFrame, elements: DataFrame) -> DataFrame:
    per_page = elements.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    done = n_if(F.col("analysis_status") == "completed")
    out = pages.join(per_page, "page_id", "left").groupBy("project_id").agg(F.count(F.lit(1)).alias("total_pages"), done.alias("completed_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_elements"))
    return out.withColumn("pending_pages", F.col("total_pages") - F.col("completed_pages"))


STAT_ANCHORS = ["question number", "question type"]


def page_stats(elements: DataFrame) -> DataFrame:
    """Per page: elements, anchors, and maps class -> count and class -> mean confidence."""
    named = elements.withColumn("class_name", F.coalesce("class_name", F.lit("unknown")))
    by = named.groupBy("page_id", "class_name").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", v))))
    return by.groupBy("page_id").agg(
        F.sum("n").alias("total_elements"),
        F.sum(F.when(F.col("class_name").isin(STAT_ANCHORS), F.col("n")).otherwise(0)).alias("anchor_elements"),
        entry("n").alias("class_distribution"),
        entry("c").alias("confidence_scores"),
    )


def class_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "class_name")


def class_counts_by_source(ocr: DataFrame, ai: DataFrame) -> DataFrame:
    both = ocr.select("class_name", F.lit(1).alias("o"), F.lit(0).alias("a")).unionByName(ai.select("class_name", F.lit(0).alias("o"), F.lit(1).alias("a")))
    return both.groupBy("class_name").agg(F.sum("o").alias("ocr_count"), F.sum("a").alias("ai_count"), F.count(F.lit(1)).alias("total"))


def counts_per_image(rows: DataFrame) -> DataFrame:
    """Per file, or per page of a PDF: label, n. ``rows``: file_name, page_number."""
    label = F.when(F.lower("file_name").endswith(".pdf"), F.concat("file_name", F.lit(" (페이지 "), F.col("page_number").cast("string"), F.lit(")"))).otherwise(F.col("file_name"))
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def image_stats(images: DataFrame) -> DataFrame:
    return images.agg(F.count(F.lit(1)).alias("images"), F.round(F.sum(F.coalesce("size_bytes", F.lit(0))) / (1024 * 1024), 6).alias("total_mb"))


def document_counts(content: DataFrame) -> DataFrame:
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return content.groupBy("page_id").agg(
        n_if(F.contains("class_name", F.lit("text"))).alias("text_regions"),
        n_if(F.col("class_name") == "figure").alias("figures"),
        n_if(F.col("class_name") == "table").alias("tables"),
        n_if(filled("ocr_text")).alias("with_text"),
        n_if(filled("description")).alias("with_ai"),
    )


def build_groups(sorted_: DataFrame) -> DataFrame:
    """One row a group: anchor (null for orphans), kind, first element, extent, count."""
    return sorted_.groupBy("page_id", "group_id").agg(
        F.max("anchor_id").alias("anchor_element_id"),
        F.when(F.max("anchor_id").isNull(), "orphan").otherwise("anchor").alias("group_type"),
        F.min_by("element_id", "order_in_group").alias("first_element_id"),
        F.min("bbox_y").alias("start_y"),
        F.max(F.col("bbox_y") + F.col("bbox_height")).alias("end_y"),
        F.count(F.lit(1)).alias("element_count"),
    )


def group_map(sorted_: DataFrame) -> DataFrame:
    """Elements of groups, orders stored from 1."""
    return sorted_.select("page_id", "group_id", "element_id", (F.col("order_in_question") + 1).alias("order_in_question"), (F.col("order_in_group") + 1).alias("order_in_group"))


def group_stats(groups: DataFrame) -> DataFrame:
    kind = F.col("group_type")
    return groups.groupBy("page_id").agg(F.count(F.lit(1)).alias("groups"), n_if(kind == "anchor").alias("anchor_groups"), n_if(kind == "orphan").alias("orphan_groups"), F.sum("element_count").alias("mapped_elements"))


def batch_summary(pages: DataFrame, results: DataFrame, older: bool = False) -> DataFrame:
    """Per project of a batch: pages processed, ok and failed, and the batch's status. ``results``: page_id, ok."""
    by = pages.join(results, "page_id", "left").groupBy("project_id").agg(F.count("ok").alias("processed"), n_if(F.col("ok")).alias("ok"), n_if(~F.col("ok")).alias("failed"))
    part = "partial" if older else "in_progress"
    status = F.when(F.col("processed") == 0, "no_pending_pages").when(F.col("failed") == 0, "completed").when(F.col("ok") == 0, "error").otherwise(part)
    return by.withColumn("status", status)


def combined_stats(pages: DataFrame) -> DataFrame:
    """Per project: pages, words, characters. ``pages``: project_id, content."""
    from pagespan.functions.text import words

    text = F.coalesce("content", F.lit(""))
    return pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum(words(text)).alias("total_words"), F.sum(F.length(text)).alias("total_characters"))


def recount_pages(projects: DataFrame, pages: DataFrame) -> DataFrame:
    per = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_pages"))
    return projects.select("project_id").join(per, "project_id", "left").withColumn("total_pages", F.coalesce("total_pages", F.lit(0)))


def latest_timestamp(versions: DataFrame) -> DataFrame:
    return versions.filter("is_current").groupBy("page_id").agg(F.max("created_at").alias("latest"))


def anchor_dispersion(elements: DataFrame, width: float) -> DataFrame:
    x, y = F.when(L.anchor(), L.cx()), F.when(L.anchor(), L.cy())
    out = elements.groupBy("page_id").agg(F.count(x).alias("n_anchors"), F.stddev_pop(x).alias("x_std"), F.var_pop(y).alias("y_var"))
    steady = F.when((F.col("n_anchors") > 1) & (width > 0), F.greatest(F.lit(0.0), 1 - F.col("x_std") / (0.3 * width))).otherwise(F.lit(0.5))
    return out.withColumns({"x_std": F.coalesce("x_std", F.lit(0.0)), "y_var": F.coalesce("y_var", F.lit(0.0)), "consistency": steady})


def adjacency_ratio(elements: DataFrame) -> DataFrame:
    """Share of a page's anchors with a child close to their right."""
    pairs = L.adjacent_pairs(elements, either_side=False, keys=("page_id",)).select(F.col("anchor_id").alias("element_id")).distinct().withColumn("near", F.lit(1))
    anchors = elements.select("page_id", F.when(L.anchor(), F.col("element_id")).alias("element_id"))
    by = anchors.join(pairs, "element_id", "left").groupBy("page_id").agg(F.count("element_id").alias("n"), F.count("near").alias("k"))
    return by.select("page_id", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(0.0)).alias("adjacency_ratio"))


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(n_if(F.col("ok")).alias("succeeded"), n_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"))


def distinct_classes(elements: DataFrame) -> DataFrame:
    return elements.select("class_name").distinct().orderBy("class_name")


def class_share_of_max(elements: DataFrame) -> DataFrame:
    by = elements.groupBy("page_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy("page_id"))
    return by.withColumn("share", F.when(top > 0, 100.0 * F.col("n") / top).otherwise(F.lit(0.0)))

