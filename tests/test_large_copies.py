"""What larger tables need: cuts that are small and go, tasks by rows, files of any size."""

import pathlib

import pytest

from pagespan.operators import layout, sides, stats, strategies
from pagespan.sources import readers, scratch
from pagespan.sources.tables import Tables
from pyspark.sql import functions as F


@pytest.fixture
def shared(spark):
    return pathlib.Path(scratch.shared_folder(spark).removeprefix("file:"))


def cuts(folder):
    return {p for p in folder.rglob("*") if p.is_dir() and p.name.startswith(("cut-", "rdd-"))}


def test_sorters_leave_two_tables(spark, sf, shared):
    """Of each sorter's cuts only the rows and the last one are left, as columns; formerly all, as rows."""
    t = Tables(spark, sf)
    before = cuts(shared)
    assert strategies.sort_hybrid(t.layout_elements, t.doc_pages).count() == t.layout_elements.filter("class_name <> 'plain text'").count()
    left = cuts(shared) - before
    assert len(left) <= 3 and all(p.name.startswith("cut-") for p in left)


def test_kept_tables_outlive_their_step(spark, shared):
    before = cuts(shared)
    with scratch.passing() as keep_outer:
        with scratch.passing() as keep:
            scratch.cut(spark.range(3))
            kept = keep(scratch.cut(spark.range(5)))
        assert kept.count() == 5 and len(cuts(shared) - before) == 1
        keep_outer(scratch.cut(spark.range(7)))
    assert len(cuts(shared) - before) == 1


def test_large_tables_are_dealt_by_rows(spark, sf, monkeypatch):
    t = Tables(spark, sf)
    ratio = lambda: {r.page_id: r.adjacency_ratio for r in stats.adjacency_ratio(t.layout_elements).collect()}
    profile = lambda: {tuple(r) for r in strategies.layout_profile(t.layout_elements, t.doc_pages).select("page_id", "layout_type", F.round("adjacency_ratio", 6), "strategy").collect()}
    want = ratio(), profile()
    monkeypatch.setattr(sides, "MANY", 100)
    monkeypatch.setattr(sides, "A_TASK", 500)
    assert (ratio(), profile()) == want
    kept = layout.preprocess(t.layout_elements)
    n = kept.count()
    assert layout.typed(kept, t.doc_pages).rdd.getNumPartitions() == -(-n // 500)


def test_beginnings_of_large_files(spark, tmp_path, monkeypatch):
    """Files over the size that is read whole have their format too."""
    (tmp_path / "a b.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + bytes(8) + (7).to_bytes(4) + (9).to_bytes(4) + bytes(80))
    (tmp_path / "c.pdf").write_bytes(b"PAR1" + bytes(99))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    monkeypatch.setattr(readers, "MAGIC_BYTES", 50)
    got = {r.name: (r.format, r.fault, r.image_width, r.image_height) for r in readers.register_page_files(spark, str(tmp_path), look=True).collect()}
    assert {k.replace("%20", " "): v for k, v in got.items()} == {"a b.png": ("png", False, 7, 9), "c.pdf": ("parquet", True, None, None), "d.pdf": ("pdf", False, None, None)}


def test_element_files_hold_many_pages(spark, sf):
    """The query's files grow with the pages' numbers over 256, not one folder a page."""
    from pagespan.plans import catalog

    got = catalog.queries()["s02_read_elements_json"](spark, sf)
    pages = Tables(spark, sf).layout_elements.select("page_id").distinct().count()
    assert len(got.inputFiles()) <= pages // 256 + 2


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_content_in_ranges(spark, monkeypatch, bits):
    """The rows of the joins, and their pages, whatever the ids: pages over several ranges, repeated and null ids, rows without a partner."""
    from pagespan.operators import joins, questions

    monkeypatch.setattr(joins, "RANGE_BITS", bits)
    ids = [(0, 5), (0, 6), (0, 7), (1, 8), (1, 900), (2, None), (2, 9), (2, None), (3, -1), (3, -2), (None, 10), (None, 70000), (4, 11), (4, 11)]
    elements = spark.createDataFrame([(e, p, f"c{k % 3}", k, 9 - k, 1, None) for k, (p, e) in enumerate(ids)], "element_id long, page_id long, class_name string, bbox_x int, bbox_y int, bbox_width int, bbox_height int")
    texts = spark.createDataFrame([(5, "a"), (7, None), (8, "b"), (8, "b"), (8, None), (None, "n"), (900, ""), (-2, "m"), (70000, " "), (12, "none"), (11, "t")], "element_id int, ocr_text string")
    ai = spark.createDataFrame([(5, "x"), (5, "y"), (8, "z"), (None, "n"), (6, None), (11, "u")], "element_id long, description string")
    joined, dealt = joins.page_with_content(elements, texts, ai), joins.content_in_ranges(elements, texts, ai)
    told = lambda df: sorted(map(repr, df.collect()))
    assert told(dealt.select(*joined.columns)) == told(joined)
    assert told(questions.nested_document(dealt)) == told(questions.nested_document(joined))
    assert told(joins.nested_pages(dealt)) == told(joins.nested_pages(joined))


def test_nested_pages_shuffle_texts_once(spark, sf, monkeypatch):
    """Pages are put together where the texts met their elements, and the elements are worked out once."""
    from pagespan.plans import catalog

    for name in ("j01_nested_pages", "e20_nested_document"):
        df = catalog.queries()[name](spark, sf)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [_range" in plan and "lineitem" not in plan


def test_questions_move_texts_once(spark, sf):
    """Questions choose among their page's arrays where its texts met its elements: no join, and no second computation of texts."""
    from pagespan.plans import catalog

    for name in ("e21_nested_questions", "d07_format_questions_text"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression [_range") == 1 and plan.count("documents") <= 3 and "lineitem" not in plan


@pytest.mark.parametrize("bits, most", [(16, 1024), (1, 1024), (16, 7), (3, 7)])
def test_questions_of_elements_are_those_of_joins(spark, monkeypatch, bits, most):
    """Pages in one range and in several, large and small: gaps, repeated and missing numbers, equal places, null boxes, texts and ids without a partner."""
    from pagespan.operators import joins, questions

    monkeypatch.setattr(joins, "RANGE_BITS", bits)
    monkeypatch.setattr(questions, "A_PAGE", most)
    said = ["1", "12", "A 섹션 3번", " 2. B 12) x", "문제 4 Q5", None, "", "① 하나", "다음을 C 부분", "해설 001", "7 7", "99999999999999999999", "13", "2", "Z  끝", "글"]
    kinds = ["question number", "question text", "figure", "table", "choices", "plain text", "flowchart"]
    rows = [(100 * p + k if p != 4 or k else None, p, kinds[(3 * k + p) % 7], None if (p, k) == (1, 3) else (k * 370 + p * 90) % 2600, 0.5 + k / 100) for p in range(6) for k in range(4 + 3 * p)]
    elements = spark.createDataFrame(rows, "element_id long, page_id long, class_name string, bbox_y int, confidence double")
    texts = spark.createDataFrame([(r[0], said[(i * 5) % 16]) for i, r in enumerate(rows) if i % 6] + [(77777, "8")], "element_id long, ocr_text string")
    ai = spark.createDataFrame([(r[0], f"d{i}") for i, r in enumerate(rows) if i % 3 == 0] + [(77777, "none")], "element_id long, description string")
    content = elements.join(texts, "element_id").withColumn("text", F.col("ocr_text"))
    joined = questions.nested_questions(content, elements.join(ai, "element_id"), elements)
    told = lambda df: sorted(map(repr, df.select(*joined.columns).collect()))
    want = told(joined)
    assert len(want) > 20 and told(questions.questions_of_elements(elements, texts, ai)) == want
    pages = lambda df: {r.page_id: r.text for r in df.collect()}
    assert pages(questions.questions_text_of_elements(elements, texts, ai)) == pages(questions.format_questions_text(joined))


def test_strategies_of_pages_are_not_broadcast(spark, sf):
    """A table with a row a page is small in its files, but not in the driver's memory."""
    t = Tables(spark, sf)
    plan = strategies.sort_adaptive(t.layout_elements, t.doc_pages)._jdf.queryExecution().executedPlan().toString()
    kinds = {j for j in ("SortMergeJoin [page_id", "BroadcastHashJoin [page_id") for line in plan.splitlines() if j in line and ("LeftAnti" in line or "LeftSemi" in line)}
    assert kinds == {"SortMergeJoin [page_id"}


def test_rendering_moves_numbers_and_bodies(spark, sf):
    """Places are found before texts are moved; then texts move once, and after a Python stage bodies alone."""
    from pagespan.operators import render
    from pagespan.sources import dimensions

    t = Tables(spark, sf)
    e = layout.reading_order(t.layout_elements)
    rules = dimensions.formatting_rules(spark)
    plans = {kind: render.format_page(e, t.text_contents, t.ai_descriptions, rules, kind)._jdf.queryExecution().executedPlan().toString() for kind in ("question_based", "reading_order")}
    moves = {kind: [line for line in plan.splitlines() if "Exchange hashpartitioning(page_id" in line or "Exchange hashpartitioning(_range" in line] for kind, plan in plans.items()}
    last = {kind: plan.index("Exchange hashpartitioning(_range") for kind, plan in plans.items()}
    assert plans["question_based"][: last["question_based"]].count("Exchange hashpartitioning(") == 1 and moves["question_based"]
    assert "Exchange hashpartitioning(" not in plans["reading_order"][: last["reading_order"]] and "_whole" not in plans["reading_order"][: last["reading_order"]]


def test_bundles_take_one_exchange(spark, sf):
    """Windows over bundles and over pages share it."""
    from pagespan.operators import render

    plan = render.format_bundles(scratch.cut(layout.reading_order(Tables(spark, sf).layout_elements)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


@pytest.mark.parametrize("bits", [1, 16])
def test_rendered_pages_in_ranges(spark, monkeypatch, bits):
    """Pages over several ranges, without texts, and with ids that are null are rendered as by joins on the element."""
    from pagespan.operators import joins, render
    from pagespan.sources import dimensions

    monkeypatch.setattr(joins, "RANGE_BITS", bits)
    kinds = ["question type", "question number", "question text", "list", "choices", "figure", "plain text"]
    rows = [(None if (p, k) == (2, 3) else 10 * p + k, p, kinds[(p + 2 * k) % 7], 30 * (k % 4), 50 * k, 10, 10, 0.5) for p in range(7) for k in range(9)]
    elements = spark.createDataFrame(rows, "element_id long, page_id long, class_name string, bbox_x int, bbox_y int, bbox_width int, bbox_height int, confidence double")
    texts = spark.createDataFrame([(r[0], ["①\n하나", " a\n\n\n\nb ", "- x\n2. y", "", None][i % 5]) for i, r in enumerate(rows) if i % 4] + [(None, "n"), (9999, "n")], "element_id long, ocr_text string")
    ai = spark.createDataFrame([(r[0], f"d{i}") for i, r in enumerate(rows) if i % 3 == 0], "element_id long, description string")
    rules = dimensions.formatting_rules(spark)
    sorted_ = layout.reading_order(elements).withColumn("group_id", F.floor(F.col("order_in_question") / 3).cast("int"))
    bundled = render.render_bundles(render.format_bundles(render.rendered_elements(sorted_, texts, ai, rules, "question_based")), rules)
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(render.bundle_texts(sorted_, texts, ai, rules)) == told(bundled)
    plain = render.render_reading_order(render.rendered_elements(sorted_, texts, ai, rules, "reading_order"))
    pages = lambda df: {r.page_id: r.text.strip() for r in df.collect()}
    got = pages(render.format_page(sorted_, texts, ai, rules, "reading_order"))
    assert {p: x.replace("\n\n\n\n", "\n\n\n") for p, x in pages(plain).items()} == {p: x.replace("\n\n\n\n", "\n\n\n") for p, x in got.items()}


def test_project_texts_lie_in_ranges(spark, sf, tmp_path):
    """Files grow with the projects' ids over 256, not one folder a project; any text comes back as it was."""
    from pagespan.plans import catalog
    from pagespan.sources import writers

    t = Tables(spark, sf)
    ranges = t.doc_pages.select(F.floor(F.col("project_id") / 256)).distinct().count()
    assert len(catalog.queries()["s07_write_project_text"](spark, sf).inputFiles()) <= ranges
    rows = [(-1, 'a\r\n\n"b"\\n\u2028\x00\x85'), (0, ""), (255, " "), (256, "\n"), (None, "없음"), (1 << 60, "x")]
    writers.write_project_text(spark.createDataFrame(rows, "project_id long, combined_text string"), str(tmp_path / "t"), 256)
    back = writers.read_project_text(spark, str(tmp_path / "t"))
    assert {(r.project_id, r.combined_text) for r in back.collect()} == set(rows)
    assert back.filter("project_range = 0").count() == 2


def test_page_kernel_sends_batches_of_pages(spark):
    """Python is called for many pages at once, with the frames that it would get page by page; pages go over batches' ends."""
    rows = [(p, k, None if (p or 0) % 3 == 0 and k == 1 else (1 << 60) + k, None if p == 4 else k % 2 == 0, f"{p}") for p in [None, 0, *range(-2, 9)] for k in range(7 if p != 5 else 60)]
    df = spark.createDataFrame(rows, "page_id long, k int, n long, b boolean, t string").repartition(3)

    def told(pdf):
        import pandas as pd

        page = pdf.page_id.iloc[0]
        return pd.DataFrame({"p": [str(page)], "rows": [len(pdf)], "total": [str(sum(int(x) for x in pdf.n.dropna()))], "kinds": [" ".join(map(str, pdf.dtypes))], "bs": [str(sorted(map(str, pdf.b)))]})

    schema = "p string, rows int, total string, kinds string, bs string"
    want = sorted(map(tuple, df.groupBy("page_id").applyInPandas(told, schema).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("10", "9999"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = strategies.page_kernel(df, told, schema)
            assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
