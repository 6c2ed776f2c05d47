"""Rendering: hand-worked pages."""

from pagespan.functions import text as X
from pagespan.operators import layout, render
from pagespan.sources import dimensions
from pyspark.sql import functions as F

E = "element_id long, page_id long, class_name string, confidence double, bbox_x int, bbox_y int, bbox_width int, bbox_height int, order_in_question int, group_id int, order_in_group int, anchor_id long"


def page(spark, rows, kind="question_based"):
    """rows: class, text, ai, group, order in group."""
    e = spark.createDataFrame([(k + 1, 1, c, 0.9, 0, 10 * k, 5, 5, k, g, o, None) for k, (c, _, _, g, o) in enumerate(rows)], E)
    t = spark.createDataFrame([(k + 1, x) for k, (_, x, _, _, _) in enumerate(rows) if x], "element_id long, ocr_text string")
    a = spark.createDataFrame([(k + 1, x) for k, (_, _, x, _, _) in enumerate(rows) if x], "element_id long, description string")
    return render.format_page(e, t, a, dimensions.formatting_rules(spark), kind).first()["text"]


def test_question_block(spark):
    rows = [
        ("question type", "객관식", None, 0, 0),
        ("question number", "1", None, 1, 0),
        ("question text", "다음 중 올바른 것은?", None, 1, 1),
        ("choices", "① 가\n② 나", None, 1, 2),
        ("figure", None, "설명", 1, 3),
        ("second_question_number", "(1)", None, 2, 0),
        ("question text", "설명형 문항", None, 2, 1),
    ]
    assert page(spark, rows) == "[객관식]\n\n\n1. 다음 중 올바른 것은?\n\n   ① 가\n   ② 나\n\n   [그림 설명]\n   설명\n\n\n   (1)설명형 문항".replace("(1)", "   (1)")


def test_orphan(spark):
    assert page(spark, [("plain text", " hello ", None, None, None)]) == "hello"


def test_figure_without_text_prints_its_heading(spark):
    assert page(spark, [("figure", None, None, None, None)]) == "[그림 설명]"


def test_reading_order(spark):
    rows = [("title", "제목", None, None, None), ("plain text", "문단", None, None, None), ("list", "- 항목1\n2. 항목2", None, None, None)]
    assert page(spark, rows, "reading_order") == "제목\n\n문단\n\n• 항목1\n• 항목2"


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb c\n",), ("",), ("  x  ",), (None,)], "t string")
    got = [tuple(r) for r in df.select(X.first_line(F.col("t")), X.remainder(F.col("t")), F.size(X.lines(F.col("t")))).collect()]
    assert got[:3] == [("a", "b\nc", 3), ("", "", 0), ("  x  ", "", 1)]
    assert df.limit(1).select(X.wrap_text(F.lit("one two three four five six seven"), )).first()[0] == "one two three four five\nsix seven"
    assert df.limit(1).select(X.normalize_question_type(F.lit("ＡＢ\r\nＣ"))).first()[0] == "AB C"
    assert df.limit(1).select(X.limit_blank_runs(F.lit("a \n\n\n\n\nb\n"))).first()[0] == "a\n\n\nb"


def test_registered_transform(spark):
    render.register_transform("shout", lambda t, ai: F.upper(t))
    rules = spark.createDataFrame([("reading_order", "title", "", "!", 0, "shout", False)], "document_type string, class_name string, prefix string, suffix string, indent int, transform string, allow_empty boolean")
    e = spark.createDataFrame([(1, 1, "title", 0.9, 0, 0, 5, 5)], "element_id long, page_id long, class_name string, confidence double, bbox_x int, bbox_y int, bbox_width int, bbox_height int")
    t = spark.createDataFrame([(1, "hey")], "element_id long, ocr_text string")
    a = spark.createDataFrame([], "element_id long, description string")
    assert render.format_page(layout.reading_order(e), t, a, rules, "reading_order").first()["text"] == "HEY!"
    del render.TRANSFORMS["shout"]


def test_values_as_given(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert [one(X.choice_number(F.lit(x))) for x in ("③ a", "（ 2 ）b", "4 ．c", " (1) d", "⑪", "6.")] == ["③", "2", "4", "", "", ""]
    assert [one(X.classify_text(F.lit(x))) for x in ("(1) a", "위의 글", "답: 3", "정답 3", "다음 글", "(7)")] == ["choices", "passage", "explanations", "question_text", "question_text", "question_text"]
    assert one(X.wrap_text(F.lit("1. a list line that is longer than twenty-five signs\n\n" + "x" * 30 + " y\n- \n"))) == "1. a list line that is longer than twenty-five signs\n\n" + "x" * 25 + "\nxxxxx y\n-\n"
    assert one(X.wrap_text(F.lit(" a "))) == "" and one(X.wrap_text(F.lit(None).cast("string"))) == ""
    assert [one(X.duration_label(F.lit(x).cast("double"))) for x in (None, 0.25, 1.5)] == ["-", "250ms", "1.50초"]
    assert one(X.safe_filename(F.lit("a b/페이지 1?.pdf"))) == "ab페이지1.pdf"
    assert one(X.section_header(F.lit(3), F.lit(None).cast("int"), F.lit(None).cast("string"))) == "─── 페이지 3 (내용 없음) ───"


def test_project_text_and_blocks(spark):
    pages = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "project_id long, page_id long, page_number int")
    current = spark.createDataFrame([(11, 2, "original", "  a b \n[c]\n")], "page_id long, version_number int, version_type string, content string")
    got = render.combine_project_text(pages, current).first()
    assert got["combined_text"] == "─── 페이지 1 (Version: 2 - original) ───\n\n  a b \n[c]\n\n─── 페이지 2 (내용 없음) ───"
    assert tuple(got["stats"]) == (2, 3, 11)
    blocks = render.document_blocks(render.combine_project_text(pages, current)).orderBy("section", "block").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in blocks] == [("heading", 2, "페이지 1"), ("paragraph", 0, "a b"), ("paragraph", 0, "[c]"), ("page_break", 0, ""), ("heading", 2, "페이지 2")]
    rows = render.text_blocks(spark.createDataFrame([(1, "\n[x]\n\n1. 2\ntext\n\n\n3")], "project_id long, combined_text string")).orderBy("block").collect()
    assert [(r["block"], r["kind"], r["level"], r["text"]) for r in rows] == [(1, "heading", 2, "x"), (3, "heading", 3, "1. 2"), (4, "paragraph", 0, "text"), (5, "blank", 0, ""), (6, "blank", 0, ""), (7, "paragraph", 0, "3")]


def test_simple_document(spark):
    rows = [(1, "question number", 0, "1", ""), (2, "question text", 1, "Why?", ""), (3, "figure", 2, "", "a cat"), (4, "table caption", 3, "T1", "x"), (5, "list", 4, " ", "")]
    content = spark.createDataFrame([(1, k, c, 0, y, o.strip(), a) for k, c, y, o, a in rows], "page_id long, element_id long, class_name string, bbox_x int, bbox_y int, ocr string, ai string")
    assert render.format_document_simple(content).first()["text"] == "1.    Why?\n\n[그림 설명] a cat\n\nT1"
    assert render.format_document_simple(content, same_line=True).first()["text"].startswith("1. Why?")


def test_ends_are_trimmed_in_one_pass(spark):
    """As the pattern of white space would; a long run within a text takes no time that grows with its square."""
    import time

    from pagespan.functions import text as X
    from pyspark.sql import functions as F

    odd = [None, "", " ", "a", "\n a \n", "a\r\n", *[f"{chr(c)}a{chr(c)}b{chr(c)}" for c in (*range(0x100), 0x1680, 0x180E, *range(0x1FFF, 0x2030), 0x205F, 0x3000, 0xFEFF)], "가 나　", "  "]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    pattern = lambda p: F.regexp_replace("t", p, "")
    assert df.filter(~X.strip(F.col("t")).eqNullSafe(pattern(f"^{X.SPACE}+|{X.SPACE}+$"))).collect() == []
    assert df.filter(~X.rstrip(F.col("t")).eqNullSafe(pattern(f"{X.SPACE}+$"))).collect() == []
    long = spark.createDataFrame([(f" x{' ' * 400_000}y ",)], "t string")
    began = time.time()
    assert long.select(F.length(X.strip(F.col("t"))).alias("n")).first()["n"] == 400_002
    assert time.time() - began < 10
