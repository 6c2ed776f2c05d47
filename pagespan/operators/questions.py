"""Question extraction from recognised texts.

``content`` holds page_id, element_id, class_name, text, bbox_x, bbox_y (rows' order is element_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan.functions import text as X
from pagespan.operators.joins import by_page, content_in_ranges, in_pages, page_with_content
from pagespan.operators.spatial import points_in_ranges
from pagespan.sources.scratch import cut

# How question numbers and sections are written.
NUMBERS = ["(\\d+)번", "(\\d+)\\.", "문제\\s*(\\d+)", "(\\d+)\\s*(?:\\)|）)", "Q\\s*(\\d+)", "(\\d{2,3})"]
SECTIONS = ["([A-Z])\\s*섹션", "([A-Z])\\s*부분", "([A-Z])\\s+"]
# What a text must hold for a pattern to be found in it.
NEEDS = {"(\\d+)번": "번", "문제\\s*(\\d+)": "문제", "Q\\s*(\\d+)": "Q", "([A-Z])\\s*섹션": "섹션", "([A-Z])\\s*부분": "부분"}


def _where_possible(pattern: str, text: Column, found: Column) -> Column:
    return F.when(F.contains(text, F.lit(NEEDS[pattern])), found) if pattern in NEEDS else found


def _all_found(patterns: list[str], text: Column | None = None) -> Column:
    text = X.strip(F.col("text")) if text is None else text
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(_where_possible(p, text, F.regexp_extract_all(text, F.lit(p), 1)), F.when(text.isNotNull(), none)) for p in patterns]))


def _first_found(patterns: list[str], text: Column) -> Column:
    """The first of ``_all_found``, null where there is none."""
    return F.coalesce(*[_where_possible(p, text, F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in patterns])


def extract_question_numbers(content: DataFrame) -> DataFrame:
    """page_id, question (text), distinct."""
    # every pattern wants a digit: most texts have none
    return content.filter(F.col("text").rlike("\\d")).select("page_id", F.explode(_all_found(NUMBERS)).alias("question")).distinct()


def extract_sections(content: DataFrame) -> DataFrame:
    """page_id, section, y of the last text that names it."""
    return content.select("page_id", "element_id", "bbox_y", F.explode(_all_found(SECTIONS)).alias("section")).groupBy("page_id", "section").agg(F.max_by("bbox_y", "element_id").alias("section_y"))


def first_section(content: DataFrame) -> DataFrame:
    """page_id and the section that is named first: all questions of the page belong to it."""
    return content.select("page_id", "element_id", F.posexplode(_all_found(SECTIONS)).alias("at", "section")).groupBy("page_id").agg(F.min_by("section", F.struct("element_id", "at")).alias("section"))


def question_boxes(content: DataFrame, numbers: DataFrame) -> DataFrame:
    """page_id, question, q_y: the first number element whose text is, or begins with, the number."""
    return _placed(content, numbers).filter("q_y is not null").drop("exact_y")


def _placed(content: DataFrame, numbers: DataFrame) -> DataFrame:
    """All numbers with q_y and, of a number element whose whole text is the number, exact_y (null: none)."""
    marks = content.filter(F.col("class_name") == "question number").select("page_id", "element_id", F.col("bbox_y").alias("q_y"), X.strip(F.col("text")).alias("t"))
    # a mark begins with at most as many numbers as it has characters: an equi-join instead of all pairs of a page
    marks = marks.select("page_id", "element_id", "q_y", "t", F.explode(F.transform(F.sequence(F.lit(1), F.length(F.regexp_extract("t", "^\\d*", 0))), lambda k: F.substring("t", F.lit(1), k))).alias("question")).filter("question <> ''")
    first = marks.groupBy("page_id", "question").agg(F.min_by("q_y", "element_id").alias("q_y"), F.min_by(F.when(F.col("t") == F.col("question"), F.col("q_y")), F.when(F.col("t") == F.col("question"), F.col("element_id"))).alias("exact_y"))
    return numbers.join(first, ["page_id", "question"], "left")


def next_question_y(boxes: DataFrame) -> DataFrame:
    """Adds next_q_y: the y of the next number present among the ten that follow (null: none)."""
    n = F.col("question").try_cast("long")
    order = Window.partitionBy("page_id").orderBy("n").rangeBetween(1, 10)
    there = F.when(F.col("q_y").isNotNull() & F.col("n").isNotNull(), F.struct("n", "question", "q_y"))
    return boxes.withColumn("n", n).withColumn("next_q_y", F.when(F.col("n").isNotNull(), F.min(there).over(order)["q_y"])).drop("n")


def layout_label(questions: DataFrame) -> DataFrame:
    """page_id, total_questions and the page's kind. ``questions``: page_id, question, section."""
    n = F.count(F.lit(1))
    return questions.groupBy("page_id").agg(n.alias("total_questions"), _label(n, F.count("section")).alias("layout_label"))


def _label(n: Column, in_sections: Column) -> Column:
    return F.when(n <= 2, "simple").when(in_sections > 0, "sectioned").when(n > 5, "multiple_choice").otherwise("standard")


def _within(boxes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a page (with bbox_y) that lie from a question's y to before the next one's."""
    return points_in_ranges(boxes.select("page_id", "question", "q_y", "next_q_y"), rows, "q_y", "next_q_y", "bbox_y").drop("q_y", "next_q_y")


def question_elements(content: DataFrame) -> DataFrame:
    """page_id, question, element_id, kind, text (stripped), bbox_y: the texts of each question's range."""
    boxes = next_question_y(question_boxes(content, extract_question_numbers(content)))
    return _within(boxes, _kinds(content))


def _kinds(content: DataFrame) -> DataFrame:
    text = X.strip(F.col("text"))
    rows = content.select("page_id", "element_id", text.alias("text"), "bbox_y").filter("text <> ''")
    return rows.select("page_id", "element_id", X.classify_text(F.col("text")).alias("kind"), "text", "bbox_y")


def main_question_text(parts: DataFrame) -> DataFrame:
    """The longest question text, the first on ties."""
    return parts.filter("kind = 'question_text'").groupBy("page_id", "question").agg(F.max_by("text", F.struct(F.length("text"), -F.col("element_id"))).alias("main_question"))


def join_texts(parts: DataFrame, kind: str, name: str) -> DataFrame:
    """A kind's texts of a question joined by blanks, in y order."""
    listed = F.array_sort(F.collect_list(F.struct("bbox_y", "element_id", "text")))
    return parts.filter(F.col("kind") == kind).groupBy("page_id", "question").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias(name))


def nested_questions(content: DataFrame, ai: DataFrame, elements: DataFrame) -> DataFrame:
    """One row a question: section, main question, passage, choices, images, tables, explanations, AI lists.

    ``ai``: page_id, element_id, class_name, description, bbox_y. ``elements``: page_id, element_id,
    class_name, confidence and box; figures and tables of a question's range are its images and tables, described by
    the question's first AI result of their class. Questions without a number element have no parts.
    """
    content = content.select("page_id", "element_id", "class_name", "text", "bbox_y")
    boxes = cut(next_question_y(_placed(content, extract_question_numbers(content))))
    nothing = lambda kind: F.lit(None).cast(kind)
    texts = _kinds(content).withColumn("confidence", nothing("double"))
    drawn = elements.filter(F.col("class_name").isin("figure", "table")).select("page_id", "element_id", F.col("class_name").alias("kind"), nothing("string").alias("text"), "bbox_y", "confidence")
    held = _within(boxes, texts.unionByName(drawn)).select("page_id", "question", "kind", "bbox_y", "element_id", "text", "confidence")
    from pagespan.operators.joins import nearest_question

    exact = boxes.filter("exact_y is not null").select("page_id", "question", F.col("exact_y").alias("q_y"))
    said = nearest_question(ai, exact).join(ai.select("page_id", "element_id", "class_name", "description", "bbox_y"), ["page_id", "element_id"])
    sort = F.when(F.col("class_name").isin("figure", "table"), F.concat(F.lit("ai "), "class_name")).otherwise(F.lit("ai other"))
    said = said.select("page_id", "question", sort.alias("kind"), "bbox_y", "element_id", F.col("description").alias("text"), nothing("double").alias("confidence"))

    def listed(kind: str, *names: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*names))))

    joined = lambda kind: F.array_join(F.transform(listed(kind, "bbox_y", "element_id", "text"), lambda x: x["text"]), " ")
    question = F.col("kind") == "question_text"
    parts = held.unionByName(said).groupBy("page_id", "question").agg(
        F.max_by(F.when(question, F.col("text")), F.when(question, F.struct(F.length("text"), -F.col("element_id")))).alias("main_question"),
        joined("passage").alias("passage"),
        joined("explanations").alias("explanations"),
        listed("choices", "bbox_y", "element_id", "text").alias("choices"),
        listed("figure", "element_id", "bbox_y", "confidence").alias("images"),
        listed("table", "element_id", "bbox_y", "confidence").alias("tables"),
        *[listed(f"ai {k}", "element_id", F.col("text").alias("description")).alias(name) for k, name in (("figure", "image_descriptions"), ("table", "table_analysis"), ("other", "problem_analysis"))],
    )
    out = boxes.select("page_id", "question").join(first_section(content), "page_id", "left").join(parts, ["page_id", "question"], "left")
    described = lambda xs, by: F.transform(xs, lambda x: F.struct(x["element_id"], x["bbox_y"], F.coalesce(F.get(F.col(by), F.lit(0))["description"], F.lit("")).alias("description"), x["confidence"]))
    return out.withColumns(
        {
            **{c: F.coalesce(c, F.lit("")) for c in ("main_question", "passage", "explanations")},
            "choices": F.transform("choices", lambda c: F.struct(c["bbox_y"], c["element_id"], X.choice_number(c["text"]).alias("choice_number"), c["text"].alias("choice_text"))),
            "images": described(F.col("images"), "image_descriptions"),
            "tables": described(F.col("tables"), "table_analysis"),
        }
    )


#: Pages of up to so many elements carry them as arrays; in larger ones questions and elements are joined.
A_PAGE = 1024


def questions_of_elements(elements: DataFrame, texts: DataFrame, ai: DataFrame) -> DataFrame:
    """``nested_questions`` of elements with their texts and descriptions, each at most one: texts are shuffled once, and nothing is joined."""
    return _of_elements(elements, texts, ai, lambda questions, page: questions)


def questions_text_of_elements(elements: DataFrame, texts: DataFrame, ai: DataFrame) -> DataFrame:
    """``format_questions_text`` of these, in the same tasks."""
    return _of_elements(elements, texts, ai, _formatted)


def _of_elements(elements: DataFrame, texts: DataFrame, ai: DataFrame, make: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    large = cut(elements.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > A_PAGE).select("page_id"))
    if large.isEmpty():
        return in_pages(content_in_ranges(elements, texts, ai), lambda rows, page: make(_asked(rows, page), page))
    few, many = elements.join(large, "page_id", "left_anti"), cut(page_with_content(elements.join(large, "page_id", "left_semi"), texts, ai))
    joined = nested_questions(many.withColumn("text", F.col("ocr_text")).filter("text is not null"), many.filter("description is not null"), many)
    return in_pages(content_in_ranges(few, texts, ai), lambda rows, page: make(_asked(rows, page), page)).unionByName(make(joined, ["page_id"]))


def _asked(content: DataFrame, page: list[str]) -> DataFrame:
    """The questions of elements with ocr_text and description, a page's (``page``: its key) in one row, in which its questions choose among arrays."""
    rows = content.withColumn("text", F.col("ocr_text")).withColumn("t", X.strip(F.col("text")))
    rows = rows.withColumns({"lead": F.regexp_extract("t", "^\\d*", 0), "named": F.when(F.col("t").rlike("\\d"), _all_found(NUMBERS, F.col("t"))), "section": _first_found(SECTIONS, F.col("t"))})
    drawn = F.col("class_name").isin("figure", "table")
    listed = lambda among, *items: F.array_sort(F.collect_list(F.when(among, F.struct(*items))))
    pages = rows.groupBy(*page).agg(
        F.array_distinct(F.flatten(F.collect_list("named"))).alias("named"),
        F.min_by("section", F.when(F.col("section").isNotNull(), F.struct("element_id"))).alias("section"),
        listed((F.col("class_name") == "question number") & (F.col("lead") != "") & F.col("element_id").isNotNull(), "element_id", "bbox_y", "lead", (F.col("lead") == F.col("t")).alias("alone")).alias("marks"),
        listed((F.col("t") != "") & F.col("bbox_y").isNotNull(), "bbox_y", "element_id", F.col("t").alias("text"), X.classify_text(F.col("t")).alias("kind")).alias("texts"),
        listed(drawn & F.col("bbox_y").isNotNull(), "element_id", "bbox_y", "confidence", "class_name").alias("drawn"),
        listed(F.col("description").isNotNull(), "element_id", "description", "bbox_y", F.when(drawn, F.col("class_name")).otherwise("other").alias("kind")).alias("told"),
    )
    first = lambda marks: F.get(marks, F.lit(0))["bbox_y"]
    placed = F.transform("named", lambda q: F.struct(q.alias("question"), q.try_cast("long").alias("n"), first(F.filter("marks", lambda m: m["lead"].startswith(q))).alias("q_y"), first(F.filter("marks", lambda m: m["alone"] & (m["lead"] == q))).alias("exact_y")))
    pages = pages.withColumn("placed", placed)
    follows = lambda b: F.filter("placed", lambda c: c["q_y"].isNotNull() & (c["n"] - b["n"]).between(1, 10))
    next_y = lambda b: F.array_min(F.transform(follows(b), lambda c: F.struct(c["n"], c["question"], c["q_y"])))["q_y"]
    away = lambda a, b: F.abs(a["bbox_y"].cast("long") - b["exact_y"])
    near = lambda a: F.array_min(F.transform(F.filter("placed", lambda b: away(a, b) <= 500), lambda b: F.struct(away(a, b), b["exact_y"], b["question"])))["question"]
    pages = pages.select(
        *page, "section", "texts", "drawn",
        F.transform("told", lambda a: F.struct(a["element_id"], a["description"], a["kind"], near(a).alias("question"))).alias("told"),
        F.explode(F.transform("placed", lambda b: F.struct(b["question"], b["q_y"], next_y(b).alias("next_q_y")))).alias("b"),
    )
    within = lambda x: (x["bbox_y"] >= F.col("b.q_y")) & (F.col("b.next_q_y").isNull() | (x["bbox_y"] < F.col("b.next_q_y")))
    asked = pages.select(*page, F.col("b.question").alias("question"), "section", F.filter("texts", within).alias("texts"), F.filter("drawn", within).alias("drawn"), F.filter("told", lambda a: a["question"] == F.col("b.question")).alias("told"))
    of = lambda xs, kind, name="kind": F.filter(xs, lambda x: x[name] == kind)
    joined = lambda kind: F.array_join(F.transform(of("texts", kind), lambda x: x["text"]), " ")
    longest = F.array_max(F.transform(of("texts", "question_text"), lambda x: F.struct(F.length(x["text"]), -x["element_id"], x["text"].alias("text"))))["text"]
    some = F.size("texts") + F.size("drawn") + F.size("told") > 0
    said = lambda kind: F.transform(of("told", kind), lambda a: F.struct(a["element_id"], a["description"]))
    seen = lambda kind: F.transform(of("drawn", kind, "class_name"), lambda x: F.struct(x["element_id"], x["bbox_y"], F.coalesce(F.get(of("told", kind), F.lit(0))["description"], F.lit("")).alias("description"), x["confidence"]))
    return asked.select(
        *page, "question", "section", F.coalesce(longest, F.lit("")).alias("main_question"), joined("passage").alias("passage"), joined("explanations").alias("explanations"),
        *[F.when(some, xs).alias(name) for name, xs in {
            "choices": F.transform(of("texts", "choices"), lambda c: F.struct(c["bbox_y"], c["element_id"], X.choice_number(c["text"]).alias("choice_number"), c["text"].alias("choice_text"))),
            "images": seen("figure"), "tables": seen("table"), "image_descriptions": said("figure"), "table_analysis": said("table"), "problem_analysis": said("other"),
        }.items()],
    )


def format_questions_text(questions: DataFrame) -> DataFrame:
    """page_id and a readable text of its questions in numeric order, titled by their place."""
    return _formatted(questions, ["page_id"])


def _formatted(questions: DataFrame, page: list[str]) -> DataFrame:
    part = lambda title, c: F.when(X.strip(c) != "", F.concat(F.lit(title), X.strip(c), F.lit("\n\n"))).otherwise(F.lit(""))
    line = lambda c: F.when(c["choice_text"] == "", "").otherwise(F.concat(F.lit("   "), F.when(c["choice_number"] != "", c["choice_number"]).otherwise(F.lit("•")), F.lit(" "), c["choice_text"], F.lit("\n")))
    some = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
    told = lambda c, lead: F.array_join(F.transform(F.filter(F.transform(F.col(c), lambda x: X.strip(F.coalesce(x["description"], F.lit("")))), lambda d: d != ""), lambda d: F.concat(F.lit(lead), d, F.lit("\n"))), "")
    listed = lambda title, c, lines: F.when(some(c), F.concat(F.lit(title), lines, F.lit("\n"))).otherwise(F.lit(""))
    says = F.concat(F.coalesce(told("image_descriptions", "   [이미지] "), F.lit("")), F.coalesce(told("table_analysis", "   [표] "), F.lit("")))
    body = F.concat(
        part("📖 지문:\n", F.col("passage")),
        part("❓ 문제:\n", F.col("main_question")),
        listed("📝 선택지:\n", "choices", F.array_join(F.transform("choices", line), "")),
        listed("🖼️ 이미지 설명:\n", "images", told("images", "   ")),
        listed("📊 표 설명:\n", "tables", told("tables", "   ")),
        part("💡 해설:\n", F.col("explanations")),
        F.when(some("image_descriptions") | some("table_analysis"), F.concat(F.lit("🤖 AI 분석:\n"), says, F.lit("\n"))).otherwise(F.lit("")),
    )
    item = F.struct(F.col("question").try_cast("long").alias("n"), "question", "section", body.alias("body"))
    by = questions.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("xs"), F.count("section").alias("in_sections"))
    label = _label(F.size("xs"), F.col("in_sections"))
    head = F.concat(F.lit("📋 문서 분석 결과\n총 문제 수: "), F.size("xs").cast("string"), F.lit("개\n레이아웃 유형: "), label, F.lit("\n\n" + "=" * 50 + "\n\n"))
    section = lambda x: F.when(x["section"].isNotNull(), F.concat(F.lit(" ("), x["section"], F.lit(")"))).otherwise(F.lit(""))
    titled = F.transform("xs", lambda x, i: F.concat(F.lit("🔸 문제"), (i + 1).cast("string"), section(x), F.lit("\n\n"), x["body"]))
    return by.select(*page, X.strip(F.concat(head, F.array_join(titled, "-" * 30 + "\n\n"))).alias("text"))


def nested_document(content: DataFrame) -> DataFrame:
    """page_id and the page as one JSON object: elements with their texts, and counts."""
    item = F.struct("element_id", "class_name", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "ocr_text", "description")
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    by = by_page(content, F.array_sort(F.collect_list(item)).alias("elements"), F.count(F.lit(1)).alias("total_elements"), F.count_if(filled("ocr_text")).alias("text_elements"), F.count_if(filled("description")).alias("ai_elements"))
    return by.select("page_id", F.to_json(F.struct("page_id", "total_elements", "text_elements", "ai_elements", "elements")).alias("document"))
