"""Table maintenance in bulk: replaced, upserted, patched and deleted rows, versions, cached texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_A_RANGE = 100_000


def replace_page_elements(elements: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """The pages of ``new`` (without element_id) lose their elements and get these, with ids after the largest (``top``, if it is known).

    Ids are given per page: a page's first id is the old maximum plus the rows of smaller pages.
    """
    kept = elements.join(new.select("page_id").distinct(), "page_id", "left_anti")
    top = largest_id(elements) if top is None else top
    # rows of smaller pages, in two steps: within a range of pages, and over the (far fewer) ranges
    per = new.groupBy("page_id").count().withColumn("_range", F.floor(F.col("page_id") / PAGES_A_RANGE))
    ranges = per.groupBy("_range").agg(F.sum("count").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    first = per.join(ranges, "_range").select("page_id", (F.col("_start") + F.coalesce(F.sum("count").over(within), F.lit(0))).alias("_before"))
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("bbox_y", "bbox_x", "class_name", "confidence"))
    fresh = new.join(first, "page_id").withColumn("element_id", F.lit(top) + F.col("_before") + at).select(*elements.columns)
    return kept.unionByName(fresh)


def largest_id(elements: DataFrame) -> int:
    return elements.agg(F.coalesce(F.max("element_id"), F.lit(0)).alias("m")).first()["m"]


def upsert(base: DataFrame, new: DataFrame, key: str = "element_id") -> DataFrame:
    """Rows of ``new`` replace those of equal key; others stay."""
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


VERSION = ["page_id", "version_number", "version_type", "content", "is_current"]


def numbered(versions: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (page_id, seq, version_type, content) numbered after each page's last; is_current is still null."""
    top = versions.groupBy("page_id").agg(F.max("version_number").alias("_top"))
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))
    fresh = new.join(top, "page_id", "left").withColumn("version_number", (F.coalesce("_top", F.lit(0)) + at).cast("int"))
    return fresh.withColumn("is_current", F.lit(None).cast("boolean")).select(*VERSION)


def with_current(versions: DataFrame) -> DataFrame:
    """Pages with a row whose is_current is null have just their newest row current."""
    by = Window.partitionBy("page_id")
    touched = F.max(F.col("is_current").isNull()).over(by)
    newest = F.col("version_number") == F.max("version_number").over(by)
    return versions.withColumn("is_current", F.when(touched, newest).otherwise(F.col("is_current")))


def number_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """``versions`` and the numbered ``new`` ones; only a page's newest row is current."""
    return with_current(versions.select(*VERSION).unionByName(numbered(versions, new)))


def current_version(versions: DataFrame) -> DataFrame:
    """A page's current version of highest number; without a current one, its newest."""
    order = Window.partitionBy("page_id").orderBy(F.col("is_current").desc(), F.col("version_number").desc())
    return versions.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def number_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (project_id, seq) with page numbers after each project's last."""
    top = pages.groupBy("project_id").agg(F.max("page_number").alias("_top"))
    at = F.row_number().over(Window.partitionBy("project_id").orderBy("seq"))
    return new.join(top, "project_id", "left").withColumn("page_number", (F.coalesce("_top", F.lit(0)) + at).cast("int")).drop("_top")


def set_current_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: page_id, version_number. Its pages have just that version current."""
    w = wanted.select("page_id", F.col("version_number").alias("_v"))
    out = versions.join(w, "page_id", "left")
    return out.withColumn("is_current", F.when(F.col("_v").isNull(), F.col("is_current")).otherwise(F.col("version_number") == F.col("_v"))).drop("_v")


def delete_versions(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Without the wanted versions, except current ones."""
    gone = wanted.select("page_id", "version_number").join(versions.filter("not is_current"), ["page_id", "version_number"], "left_semi")
    return versions.join(gone, ["page_id", "version_number"], "left_anti").select(*versions.columns)


def save_edits(versions: DataFrame, edits: DataFrame, pages: DataFrame, combined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits (page_id, seq, content) as new versions; and the cached texts without those projects'."""
    new = edits.select("page_id", "seq", F.lit("user_edited").alias("version_type"), "content")
    touched = pages.join(edits.select("page_id"), "page_id", "left_semi").select("project_id").distinct()
    return number_versions(versions, new), combined.join(touched, "project_id", "left_anti").select(*combined.columns)


def upsert_combined(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Fresh texts over cached ones; generated_at keeps its first value."""
    first = cached.select("project_id", F.col("generated_at").alias("_g"))
    dated = new.join(first, "project_id", "left").withColumn("generated_at", F.coalesce("_g", "generated_at")).drop("_g")
    return upsert(cached, dated, "project_id")


def cascade_delete(tables: dict[str, DataFrame], projects: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (projects, pages, elements, and others by element_id or page_id) without ``projects`` and all below them."""
    gone = projects.select("project_id").distinct()
    pages = tables["pages"].join(gone, "project_id", "left_semi").select("page_id")
    elements = tables["elements"].join(pages, "page_id", "left_semi").select("element_id")
    out = {}
    for name, df in tables.items():
        key, ids = ("project_id", gone) if "project_id" in df.columns else ("page_id", pages) if "page_id" in df.columns else ("element_id", elements)
        out[name] = df.join(ids, key, "left_anti").select(*df.columns)
    return out


def patch_rows(base: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``patch``: key, fields, and fields_set (names that were given: a given null is a null)."""
    p = patch.select(key, "fields_set", *[F.col(f).alias(f"_{f}") for f in fields])
    out = base.join(p, key, "left")
    given = lambda f: F.coalesce(F.array_contains("fields_set", f), F.lit(False))
    return out.select(*[F.when(given(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def update_page_status(pages: DataFrame, updates: DataFrame, at: Column, batch: bool = False) -> DataFrame:
    """``updates``: page_id, status, processing_time. Completed pages (of a batch also failed ones) get analyzed_at."""
    u = updates.select("page_id", F.col("status").alias("_s"), F.col("processing_time").alias("_t"))
    out = pages.join(u, "page_id", "left")
    ended = F.col("_s").isin(["completed", "error"] if batch else ["completed"])
    return out.withColumns({"analysis_status": F.coalesce("_s", "analysis_status"), "processing_time": F.coalesce("_t", "processing_time"), "analyzed_at": F.when(ended, at).otherwise(F.col("analyzed_at"))}).drop("_s", "_t")


def cache_freshness(combined: DataFrame, pages: DataFrame, versions: DataFrame, strict: bool = False) -> DataFrame:
    """project_id and fresh: the cached text is no older than any current version (``strict``: and there is one)."""
    newest = pages.select("project_id", "page_id").join(versions.filter("is_current").select("page_id", "created_at"), "page_id", "left").groupBy("project_id").agg(F.max("created_at").alias("newest"))
    out = combined.select("project_id", "updated_at").join(newest, "project_id", "left")
    fresh = F.when(F.col("newest").isNull(), F.lit(not strict)).otherwise(F.col("updated_at") >= F.col("newest"))
    return out.select("project_id", F.coalesce(fresh, F.lit(False)).alias("fresh"))


def project_status_view(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """Projects with their pages' statuses in page order."""
    by = pages.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "analysis_status"))).alias("pages"))
    return projects.join(by, "project_id", "left")
