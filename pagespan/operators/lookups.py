"""Filtered and ordered lookups, paging, top-k."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagespan.operators.sides import dealt
from pagespan.sources.scratch import cut, passing


def page_through(df: DataFrame, order: list, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows skip.. in order; at least 1 and at most 1000."""
    if skip < 0 or not 1 <= limit <= 1000:
        raise ValueError("skip is 0 or more, limit 1 to 1000")
    return df.orderBy(*order).offset(skip).limit(limit)


def search_users(users: DataFrame, role: str | None = None, search: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """By role and by part of name or e-mail (case ignored), newest first."""
    if role is not None:
        users = users.filter(F.col("role") == role)
    if search:
        users = users.filter(F.contains(F.lower("name"), F.lit(search.lower())) | F.contains(F.lower("email"), F.lit(search.lower())))
    return page_through(users, [F.col("created_at").desc(), F.col("user_id").desc()], skip, limit)


def list_projects(projects: DataFrame, user_id: int | None = None, status: str | None = None, doc_type_id: int | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """Newest (largest id) first."""
    for column, value in (("user_id", user_id), ("status", status), ("doc_type_id", doc_type_id)):
        if value is not None:
            projects = projects.filter(F.col(column) == value)
    return page_through(projects, [F.col("project_id").desc()], skip, limit)


def list_pages(pages: DataFrame, project_id: int, status: str | None = None, include_error: bool = False) -> DataFrame:
    pages = pages.filter(F.col("project_id") == project_id)
    if status is not None:
        pages = pages.filter(F.col("analysis_status") == status)
    elif not include_error:
        pages = pages.filter(F.col("analysis_status") != "error")
    return pages.orderBy("page_number")


def elements_of_page(elements: DataFrame, page_id: int, class_name: str | None = None) -> DataFrame:
    elements = elements.filter(F.col("page_id") == page_id)
    if class_name is not None:
        elements = elements.filter(F.col("class_name") == class_name)
    return elements.orderBy("bbox_y", "bbox_x", "element_id")


def doc_types_by_method(types: DataFrame, sorting_method: str) -> DataFrame:
    return types.filter(F.col("sorting_method") == sorting_method).orderBy("type_name")


def versions_of_page(versions: DataFrame, page_id: int | None = None, current_only: bool = False, version_type: str | None = None) -> DataFrame:
    if page_id is not None:
        versions = versions.filter(F.col("page_id") == page_id)
    if current_only:
        versions = versions.filter("is_current")
    if version_type is not None:
        versions = versions.filter(F.col("version_type") == version_type)
    return versions.orderBy(F.col("version_number").desc())


def groups_of_page(groups: DataFrame, page_id: int) -> DataFrame:
    return groups.filter(F.col("page_id") == page_id).orderBy("start_y", "group_id")


def elements_of_group(members: DataFrame, page_id: int, group_id: int) -> DataFrame:
    return members.filter((F.col("page_id") == page_id) & (F.col("group_id") == group_id)).orderBy("order_in_question")


def pending_pages(pages: DataFrame, retry_errors: bool = True) -> DataFrame:
    wanted = ["pending", "error"] if retry_errors else ["pending"]
    return pages.filter(F.col("analysis_status").isin(wanted)).orderBy("project_id", "page_number")


def visible_classes(elements: DataFrame, classes: list[str] | None) -> DataFrame:
    """None shows all, an empty list nothing."""
    return elements if classes is None else elements.filter(F.col("class_name").isin(classes) if classes else F.lit(False))


def rules_for_type(rules: DataFrame, document_type: str, class_name: str | None = None) -> DataFrame:
    rules = rules.filter(F.col("document_type") == document_type)
    return rules if class_name is None else rules.filter(F.col("class_name") == class_name)


def grams_of(phrase: str, n: int) -> list[str]:
    """The different n-grams of a phrase: lower case, without white space."""
    flat = "".join(phrase.lower().split())
    return sorted({flat[i : i + n] for i in range(len(flat) - n + 1)})


def text_search(texts: DataFrame, phrase: str, n: int = 2, limit: int = 20) -> DataFrame:
    """The texts that share the most n-grams with a phrase: element_id, hits.

    N-grams are of lower-cased text without blanks. Only those of the phrase leave a text, once each.
    """
    flat = F.regexp_replace(F.lower("ocr_text"), "\\s", "")
    hits = sum((F.contains(flat, F.lit(g)).cast("int") for g in grams_of(phrase, n)), F.lit(0))
    return texts.withColumn("hits", hits).filter("hits > 0").orderBy(F.col("hits").desc(), "element_id").limit(limit).select("element_id", "hits")


#: Texts of about so many characters are a block of an index; a task takes the n-grams of so many blocks.
A_BLOCK_CHARS, A_TASK_BLOCKS = 2_000_000, 3


class TextIndex:
    """An inverted index of texts in a folder: posting lists of the different texts, in parts by gram and sorted by it, and the elements of each text.

    Different texts (without case and white space, told by 128 bits of hash) are dealt to blocks and numbered there. A gram has a list of
    places a block, so that a posting is a small number; lists are made where a block's texts are, and only they are shuffled.
    A search reads the parts of the phrase's grams alone, and of these the row groups that hold them. Texts are added in
    further loads; a text that is added again counts with all its grams.
    """

    def __init__(self, spark: SparkSession, path: str, n: int = 2, parts: int = 64):
        self.spark, self.path, self.n, self.parts = spark, path, n, parts

    def _part(self, gram: Column) -> Column:
        return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(self.parts)).cast("int")

    def _grams(self, text: Column) -> Column:
        """Its different n-grams: from an array of characters, since finding a place in a text takes as long as the place is far."""
        gram = lambda cs, i: F.concat(*[F.get(cs, i + k) for k in range(self.n)])
        return F.transform(F.array(F.split(text, "")), lambda cs: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(cs) - self.n), lambda i: gram(cs, i))))[0]

    def add(self, texts: DataFrame) -> None:
        """Index element_id and ocr_text."""
        flat = F.lower("ocr_text")
        for space in " \t\n\x0b\f\r":  # what \\s is, without a pattern
            flat = F.replace(flat, F.lit(space), F.lit(""))
        load, order = F.lit(uuid.uuid4().hex).alias("load"), Window.partitionBy("block").orderBy("h1", "h2")
        with passing():
            rows = cut(texts.select("element_id", flat.alias("t"))).filter(F.length("t") >= self.n)
            blocks = -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 1) // A_BLOCK_CHARS)
            rows = rows.select("element_id", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), "t").withColumn("block", F.pmod("h1", F.lit(blocks)).cast("int"))
            by_block = lambda *columns: dealt(rows.select("block", "h1", "h2", *columns), -(-blocks // A_TASK_BLOCKS), "block")
            by_block("element_id").select(load, "block", F.dense_rank().over(order).alias("place"), "element_id").write.mode("append").parquet(f"{self.path}/elements")
            once = by_block("t").groupBy("block", "h1", "h2").agg(F.first("t").alias("t")).withColumn("place", F.row_number().over(order))
            lists = once.select("block", "place", F.explode(self._grams(F.col("t"))).alias("gram")).groupBy("block", "gram").agg(F.collect_list("place").alias("places"))
            lists = lists.withColumn("part", self._part(F.col("gram"))).repartition("part").sortWithinPartitions("part", "gram", "block")
            lists.select("gram", load, "block", "places", "part").write.mode("append").partitionBy("part").parquet(f"{self.path}/grams")

    def search(self, phrase: str, limit: int = 20) -> DataFrame:
        """The same rows as ``text_search``."""
        import zlib

        wanted = grams_of(phrase, self.n)
        parts = sorted({zlib.crc32(g.encode()) % self.parts for g in wanted})
        found = self.spark.read.schema("gram string, load string, block int, places array<int>, part int").parquet(f"{self.path}/grams").filter(F.col("part").isin(parts) & F.col("gram").isin(wanted))
        # a bit for each of the phrase's grams, 63 in a number
        sets = [wanted[i : i + 63] for i in range(0, len(wanted), 63)] or [[]]
        bit = lambda grams: F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << k).cast("long")) for k, g in enumerate(grams)], F.lit(0).cast("long"))
        text = ["load", "block", "place"]
        each = found.select("gram", "load", "block", F.explode("places").alias("place")).groupBy(*text).agg(*[F.bit_or(bit(grams)).alias(f"b{i}") for i, grams in enumerate(sets)])
        held = self.spark.read.schema("load string, block int, place int, element_id long").parquet(f"{self.path}/elements").join(each, text)
        hits = sum((F.bit_count(F.bit_or(f"b{i}")) for i in range(len(sets))), F.lit(0))
        return held.groupBy("element_id").agg(hits.cast("int").alias("hits")).orderBy(F.col("hits").desc(), "element_id").limit(limit)


def top_classes(elements: DataFrame, n: int = 5) -> DataFrame:
    return elements.groupBy("class_name").count().orderBy(F.col("count").desc(), "class_name").limit(n)


def first_n_per_page(elements: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy("element_id")
    return elements.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")
