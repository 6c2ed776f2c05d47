"""Rendering: elements and their texts become page and project texts by a rule table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.functions import text as X
from pagespan.operators.joins import content_in_ranges, in_pages, page_with_content
from pagespan.operators.sides import dealt, if_small, tasks
from pagespan.sources.scratch import cut

#: Transforms that rules name: (text, ai text) -> text. ``register_transform`` adds to them.
TRANSFORMS: dict[str, Callable[[Column, Column], Column]] = {
    "normalize_choices": lambda t, ai: X.normalize_choices(t),
    "normalize_list": lambda t, ai: X.normalize_list(t),
    "normalize_reading_list": lambda t, ai: X.normalize_reading_list(t),
    "merge_visual_description": X.merge_visual,
    "isolate_formula": lambda t, ai: X.strip(t),
    "uppercase_title": lambda t, ai: X.strip(t),
}
#: Transforms that need a Python worker; only rows whose rule names them go there.
PYTHON_TRANSFORMS: dict[str, Callable[[Column, Column], Column]] = {"normalize_question_type": lambda t, ai: X.normalize_question_type(t)}


def with_texts(elements: DataFrame, texts: DataFrame, ai: DataFrame) -> DataFrame:
    """Adds ocr and ai, trimmed, empty where missing."""
    return _trimmed(page_with_content(elements, texts, ai))


def _trimmed(content: DataFrame) -> DataFrame:
    """Rows with ocr_text and description, which become ocr and ai."""
    clean = lambda c: X.strip(F.coalesce(c, F.lit("")))
    return content.withColumns({"ocr": clean(F.col("ocr_text")), "ai": clean(F.col("description"))}).drop("ocr_text", "description")


def with_rules(content: DataFrame, rules: DataFrame, document_type: str) -> DataFrame:
    """Adds the class's rule; a class without one gets just a line end."""
    own = rules.filter(F.col("document_type") == document_type).select("class_name", "prefix", "suffix", "indent", "transform", "allow_empty")
    out = content.join(if_small(own), "class_name", "left")
    return out.withColumns({"prefix": F.coalesce("prefix", F.lit("")), "suffix": F.coalesce("suffix", F.lit("\n")), "indent": F.coalesce("indent", F.lit(0)), "allow_empty": F.coalesce("allow_empty", F.lit(False))})


def python_transforms(rules: DataFrame, document_type: str) -> list[str]:
    """The Python transforms that a type's rules name: pages of other types need no Python stage."""
    named = rules.filter((F.col("document_type") == document_type) & F.col("transform").isin([*PYTHON_TRANSFORMS])).select("transform").distinct()
    return [r["transform"] for r in named.collect()]  # as many as there are such transforms at most


def with_body(content: DataFrame, python: list[str] | None = None) -> DataFrame:
    """Adds body: the chosen text through the rule's transform; visuals fall back to their description. ``python``: which Python transforms rules name (null: any)."""
    visual = F.col("class_name").isin(S.VISUALS)
    base = F.when(visual, F.col("ocr")).when(F.col("ocr") != "", F.col("ocr")).otherwise(F.col("ai"))
    content = content.withColumn("base", base)
    body = X.strip(F.col("base"))
    chain = None
    for name, fn in TRANSFORMS.items():
        hit = F.col("transform") == name
        done = fn(F.col("base"), F.col("ai"))
        chain = F.when(hit, done) if chain is None else chain.when(hit, done)
    content = content.withColumn("body", chain.otherwise(body))
    for name in PYTHON_TRANSFORMS if python is None else python:
        fn = PYTHON_TRANSFORMS[name]
        hit = F.col("transform") == name
        content = content.withColumn("body", F.when(hit, fn(F.when(hit, F.col("base")), F.col("ai"))).otherwise(F.col("body")))
    return content.withColumn("body", F.when(F.col("body") == "", F.when(visual, F.col("ai")).otherwise(F.lit(""))).otherwise(F.col("body"))).drop("base")


def format_element(content: DataFrame) -> DataFrame:
    """Adds rendered: the body through the rule."""
    return content.withColumn("rendered", X.apply_rule(F.col("body"), F.col("prefix"), F.col("suffix"), F.col("indent"), F.col("allow_empty")))


def rendered_elements(elements: DataFrame, texts: DataFrame, ai: DataFrame, rules: DataFrame, document_type: str) -> DataFrame:
    content = with_rules(with_texts(elements, texts, ai), rules, document_type)
    return format_element(with_body(content, python_transforms(rules, document_type)))


def format_bundles(sorted_: DataFrame) -> DataFrame:
    """Adds bundle (place of its group on the page) and is_head: the group's first anchor.

    Elements without an order come after all others, by y; each without a group is its own bundle.
    """
    order = F.coalesce(F.col("order_in_question").cast("long"), 10_000_000 + F.col("bbox_y"))
    # by page: windows over bundles and over pages need no other exchange
    df = sorted_.repartition("page_id").withColumn("_o", F.struct(order.alias("o"), F.coalesce("order_in_group", F.lit(0)).alias("g"), "bbox_y", "bbox_x", "element_id"))
    key = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("o"), F.col("element_id").cast("string")))
    df = df.withColumn("_k", key)
    by = Window.partitionBy("page_id", "_k")
    head = F.struct(F.coalesce("order_in_group", F.lit(0)).alias("g"), "bbox_y", "bbox_x", "element_id")
    df = df.withColumns({"_first": F.min("_o").over(by), "_head": F.min(F.when(F.col("class_name").isin(S.ANCHORS), head)).over(by)})
    df = df.withColumn("bundle", F.dense_rank().over(Window.partitionBy("page_id").orderBy("_first")) - 1)
    return df.withColumns({"is_head": F.coalesce(F.col("element_id") == F.col("_head.element_id"), F.lit(False)), "place": F.col("_o")}).drop("_o", "_k", "_first", "_head")


def render_numbered(head: Column, children: Column, rule: Column) -> Column:
    """A question: its number and the first line of its text on one line, the rest, then other children.

    ``head`` and the array ``children`` (in order) hold class_name, ocr, ai, body, rendered, prefix,
    suffix, indent, allow_empty; ``rule`` is the question text's rule or null.
    """
    main = F.get(F.filter(children, lambda c: c["class_name"] == "question text"), F.lit(0))
    text = F.when(head["ocr"] != "", head["ocr"]).otherwise(head["ai"])
    line = F.when((text != "") | head["allow_empty"], F.regexp_replace(X.apply_rule(text, head["prefix"], head["suffix"], head["indent"], head["allow_empty"]), "\\n+\\z", "")).otherwise(head["prefix"])

    cut_end = lambda part: F.regexp_replace(part, "\\n+\\z", "")
    # the last part that is there ends in a blank line before other children
    close = lambda part: F.when(part.endswith("\n\n"), part).otherwise(F.concat(cut_end(part), F.lit("\n\n")))

    def parts(x: Column) -> Column:
        others = F.filter(children, lambda c: (x["main"].isNull() | (c["element_id"] != x["main"]["element_id"])) & (X.strip(c["rendered"]) != ""))
        return F.struct(x["line"], X.first_of(x["ls"]).alias("first"), X.rest_of(x["ls"]).alias("rest"), F.array_join(F.transform(others, lambda c: c["rendered"]), "").alias("others"))

    def joined(x: Column) -> Column:
        lead = F.regexp_extract(x["line"], "^(\\n*)", 1)
        combined = F.when(x["line"] != "", F.concat(lead, X.rstrip(F.concat(F.regexp_replace(x["line"], "^\\n+", ""), x["first"])))).otherwise(x["first"])
        more = F.when(x["rest"] == "", F.lit("")).when(rule.isNull(), x["rest"]).otherwise(cut_end(X.apply_rule(x["rest"], rule["prefix"], rule["suffix"], rule["indent"], rule["allow_empty"])))
        return F.struct(combined.alias("combined"), more.alias("more"), x["others"], ((x["line"] != "") | (x["first"] != "")).alias("has_line"))

    def whole(x: Column) -> Column:
        return (
            F.when(x["others"] == "", F.concat(x["combined"], x["more"])).when(x["more"] != "", F.concat(x["combined"], close(x["more"]), x["others"]))
            .when(x["has_line"], F.concat(close(x["combined"]), x["others"])).otherwise(x["others"])
        )

    first = F.struct(main.alias("main"), line.alias("line"))
    lined = lambda x: F.struct(x["main"], x["line"], X.lines(F.coalesce(x["main"]["body"], F.lit(""))).alias("ls"))
    return X.let(first, lambda x: X.let(lined(x), lambda x: X.let(parts(x), lambda x: X.let(joined(x), whole))))


def render_section(members: Column) -> Column:
    """Rendered members that are not blank, joined."""
    return F.array_join(F.filter(F.transform(members, lambda c: c["rendered"]), lambda r: X.strip(r) != ""), "")


PART = ["element_id", "class_name", "ocr", "ai", "body", "rendered", "prefix", "suffix", "indent", "allow_empty"]


def render_bundles(rendered: DataFrame, rules: DataFrame, document_type: str = "question_based") -> DataFrame:
    """page_id, bundle, text of every group."""
    return _bundles(rendered, ["page_id"], rules, document_type)


def _bundles(rendered: DataFrame, page: list[str], rules: DataFrame, document_type: str) -> DataFrame:
    item = F.struct("place", *PART)
    by = rendered.groupBy(*page, "bundle").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_head"), item))).alias("children"),
        F.max(F.when(F.col("is_head"), item)).alias("head"),
    )
    rule = rules.filter((F.col("document_type") == document_type) & (F.col("class_name") == "question text")).select(F.struct("prefix", "suffix", "indent", "allow_empty").alias("rule"), F.lit(1).alias("_one"))
    by = by.withColumn("_one", F.lit(1)).join(if_small(rule), "_one", "left").drop("_one")
    numbered = F.col("head.class_name").isin("question number", "second_question_number")
    text = F.when(F.col("head").isNull(), render_section(F.col("children"))).when(numbered, render_numbered(F.col("head"), F.col("children"), F.col("rule"))).otherwise(
        F.concat(F.when(X.strip(F.col("head.rendered")) != "", F.col("head.rendered")).otherwise(F.lit("")), render_section(F.col("children")))
    )
    return by.select(*page, "bundle", text.alias("text"))


def bundle_texts(sorted_: DataFrame, texts: DataFrame, ai: DataFrame, rules: DataFrame, document_type: str = "question_based") -> DataFrame:
    """page_id, bundle, text of every group of sorted elements."""
    return _rendered_pages(format_bundles(sorted_), texts, ai, rules, document_type, lambda rendered, page: _bundles(rendered, page, rules, document_type))


#: What later steps need of a row beside its texts: of pages in bundles, and in reading order.
BUNDLED = ["page_id", "element_id", "class_name", "bundle", "is_head", "place"]
ORDERED = ["page_id", "element_id", "class_name", "bbox_y", "bbox_x"]


def _rendered_pages(placed: DataFrame, texts: DataFrame, ai: DataFrame, rules: DataFrame, document_type: str, make: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """What ``make`` makes of rendered elements and the columns that tell their page.

    Places within a page are numbers, and found before; texts meet them in ranges of element ids, and are rendered where their page is.
    Rows lose their place by a Python stage: after it bodies go to their pages, of heads the texts as well.
    """
    python, names = python_transforms(rules, document_type), BUNDLED if "bundle" in placed.columns else ORDERED
    placed = placed.select(*names)
    ruled = lambda rows: with_rules(rows, rules, document_type)
    if not python:
        return in_pages(content_in_ranges(placed, texts, ai), lambda rows, page: make(format_element(with_body(ruled(_trimmed(rows)), python)), page))
    placed = cut(placed)
    n = tasks(placed)
    bodies = with_body(ruled(_trimmed(content_in_ranges(placed, texts, ai, pages=False))), python)
    texts_of_heads = [F.when(F.col("is_head"), F.col(c)).alias(c) for c in ("ocr", "ai")] if names is BUNDLED else []
    bodies = bodies.select(*names, *texts_of_heads, "body")
    bodies = bodies.repartition("page_id") if n is None else dealt(bodies, n, "page_id")
    return make(format_element(ruled(bodies)), ["page_id"])


def render_reading_order(rendered: DataFrame) -> DataFrame:
    """page_id and raw text: elements by (y, x, id)."""
    return _in_reading_order(rendered, ["page_id"])


def _in_reading_order(rendered: DataFrame, page: list[str]) -> DataFrame:
    item = F.struct("bbox_y", "bbox_x", "element_id", "rendered")
    return rendered.groupBy(*page).agg(render_section(F.array_sort(F.collect_list(item))).alias("text"))


def format_page(sorted_: DataFrame, texts: DataFrame, ai: DataFrame, rules: DataFrame, document_type: str = "question_based") -> DataFrame:
    """page_id and the page's clean text."""

    def whole(rendered: DataFrame, page: list[str]) -> DataFrame:
        if document_type == "question_based":
            by = _bundles(rendered, page, rules, document_type)
            raw = by.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bundle", "text"))), lambda x: x["text"]), "").alias("text"))
        else:
            raw = _in_reading_order(rendered, page)
        return raw.select(*page, X.limit_blank_runs(F.col("text")).alias("text"))

    placed = format_bundles(sorted_) if document_type == "question_based" else sorted_
    return _rendered_pages(placed, texts, ai, rules, document_type, whole)


# Prefix and suffix of the simple document formatter, by class (blanks as underscores).
SIMPLE_RULES = {
    "title": ("", "\n\n"),
    "question_number": ("", ". "),
    "question_type": ("   ", "\n"),
    "question_text": ("   ", "\n"),
    "plain_text": ("", "\n"),
    "table_caption": ("\n", "\n"),
    "table_footnote": ("", "\n\n"),
    "isolated_formula": ("\n", "\n\n"),
    "formula_caption": ("", "\n"),
    "abandon_text": ("[삭제됨] ", "\n"),
    "figure": ("\n[그림 설명] ", "\n\n"),
    "table": ("\n[표 설명] ", "\n\n"),
}


def format_document_simple(content: DataFrame, same_line: bool = False) -> DataFrame:
    """page_id and text by SIMPLE_RULES in (y, x) order: the recognised text, else the description; at most one blank line.

    ``same_line`` drops the prefix of a text that follows its number.
    """
    prefix = F.create_map(*[F.lit(x) for k, v in SIMPLE_RULES.items() for x in (k, v[0])])
    suffix = F.create_map(*[F.lit(x) for k, v in SIMPLE_RULES.items() for x in (k, v[1])])
    name = F.translate(F.lower("class_name"), " ", "_")
    rows = content.select("page_id", "bbox_y", "bbox_x", "element_id", name.alias("name"), F.when(F.col("ocr") != "", F.col("ocr")).otherwise(F.col("ai")).alias("body")).filter("body <> ''")
    before = F.lag("name").over(Window.partitionBy("page_id").orderBy("bbox_y", "bbox_x", "element_id"))
    joined = (F.col("name") == "question_text") & (before == "question_number") if same_line else F.lit(False)
    piece = F.concat(F.when(F.coalesce(joined, F.lit(False)), "").otherwise(F.coalesce(prefix[F.col("name")], F.lit(""))), F.col("body"), F.coalesce(suffix[F.col("name")], F.lit("\n")))
    by = rows.withColumn("piece", piece).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("bbox_y", "bbox_x", "element_id", "piece"))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["piece"]), "")
    blank = lambda x: X.strip(x) == ""
    once = X.let(F.split(text, "\n"), lambda ls: F.array_join(F.filter(ls, lambda x, i: ~(blank(x) & (i > 0) & blank(F.coalesce(F.get(ls, i - 1), F.lit("-"))))), "\n"))
    return by.select("page_id", X.strip(once).alias("text"))


def combine_project_text(pages: DataFrame, current: DataFrame) -> DataFrame:
    """project_id, combined_text, and stats (total_pages, total_words, total_characters): a section a page, in order.

    A section is the page's header, a blank line and its content, cut at the right; words and characters are the content's.
    """
    both = pages.select("project_id", "page_id", "page_number").join(current.select("page_id", "version_number", "version_type", "content"), "page_id", "left")
    body = F.coalesce("content", F.lit(""))
    header = X.section_header(F.col("page_number"), F.col("version_number"), F.col("version_type"))
    both = both.withColumns({"section": X.rstrip(F.concat(header, F.lit("\n\n"), body)), "words": X.words(body), "chars": F.length(body)})
    return both.groupBy("project_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "section"))), lambda x: x["section"]), "\n\n").alias("combined_text"),
        F.struct(F.count(F.lit(1)).alias("total_pages"), F.sum("words").alias("total_words"), F.sum("chars").alias("total_characters")).alias("stats"),
    )


def text_blocks(texts: DataFrame, key: str = "project_id", text: str = "combined_text") -> DataFrame:
    """Rows of a document: key, block (the line's number), kind (heading, paragraph, blank), level, text.

    ``[x]`` is a heading of level 2; a line of digits, dots and blanks with a digit and a dot is one of level 3;
    blank lines count where the last line that is not blank was a paragraph.
    """
    rows = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("block", "line")).withColumn("line", X.strip(F.col("line")))
    line = F.col("line")
    level = F.when(line.startswith("[") & line.endswith("]"), 2).when(line.rlike("^[\\p{Nd}. ]+$") & line.contains(".") & line.rlike("\\p{Nd}"), 3).otherwise(0)
    rows = rows.withColumn("level", F.when(line != "", level))
    last = F.last("level", ignorenulls=True).over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("last", last).filter("line <> '' or last = 0")
    kind = F.when(line == "", "blank").when(F.col("level") > 0, "heading").otherwise("paragraph")
    shown = F.when(F.col("level") == 2, F.regexp_replace(line, "^[\\[\\]]+|[\\[\\]]+$", "")).otherwise(line)
    return rows.select(key, "block", kind.alias("kind"), F.coalesce("level", F.lit(0)).alias("level"), shown.alias("text"))


def document_blocks(combined: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows of a project's document: key, section, block, kind (heading, paragraph, page_break), level, text.

    Sections begin at page headers; each is a heading of level 2, its filled lines are paragraphs, and
    a page break stands between sections.
    """
    parts = F.filter(F.transform(F.split(F.col("combined_text"), "─── 페이지 "), X.strip), lambda s: s != "")
    rows = combined.select(key, F.size(parts).alias("n"), F.posexplode(parts).alias("section", "part"))
    lines = F.split(F.col("part"), "\n")
    first = F.concat(F.lit("페이지 "), F.get(F.filter(F.split(F.get(lines, F.lit(0)), f"{X.SPACE}+"), lambda w: w != ""), F.lit(0)))
    item = lambda kind, level, text: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), text.alias("text"))
    body = F.transform(F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), X.strip), lambda x: x != ""), lambda x: item("paragraph", 0, x))
    end = F.when(F.col("section") < F.col("n") - 1, F.array(item("page_break", 0, F.lit("")))).otherwise(F.slice(F.array(item("page_break", 0, F.lit(""))), 1, 0))
    rows = rows.select(key, "section", F.posexplode(F.concat(F.array(item("heading", 2, first)), body, end)).alias("block", "b"))
    return rows.select(key, "section", "block", "b.kind", "b.level", "b.text")


def list_source_texts(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """``[class]\\ntext\\n\\n`` of rows (key, seq, class_name, text), in order."""
    piece = F.concat(F.lit("["), F.col("class_name"), F.lit("]\n"), F.col("text"), F.lit("\n\n"))
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", piece.alias("p")))).alias("xs"))
    return by.select(key, F.array_join(F.transform("xs", lambda x: x["p"]), "").alias("listing"))


def register_transform(name: str, fn: Callable[[Column, Column], Column], python: bool = False) -> None:
    """Make ``fn(text, ai_text)`` known to rules as ``name``; ``python`` where it is a pandas UDF."""
    (PYTHON_TRANSFORMS if python else TRANSFORMS)[name] = fn
