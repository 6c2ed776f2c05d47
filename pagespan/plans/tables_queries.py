"""Queries of lookups, joins, statistics and set operations, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagespan import schema as S
from pagespan.operators import joins as J
from pagespan.operators import layout as L
from pagespan.operators import lookups as K
from pagespan.operators import stats as A
from pagespan.plans import sorter_sql as Z
from pagespan.plans.registered import query
from pagespan.sources import dimensions, writers
from pagespan.sources.tables import RAW


@query("s01_read_tables", " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in RAW))
def _(t):
    out = None
    for n in RAW:
        one = getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("s03_register_page_files", " union all ".join(f"select '{n}' as source, 'table' as kind, 'parquet' as format, false as fault" for n in RAW))
def _(t):
    """The given tables' own files: kind by suffix, format by what they begin with."""
    from pagespan.sources.readers import register_page_files

    files = register_page_files(t.spark, f"{t.sf_dir}/*.parquet", look=True, kinds={"parquet": "table"})
    return files.select(F.regexp_extract("path", "/(\\w+)\\.parquet", 1).alias("source"), "kind", "format", "fault").distinct()


def in_sql(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("\n", "'||chr(10)||'") + "'"


RULES_SQL = "(values " + ", ".join(f"({', '.join(map(in_sql, r))})" for r in S.FORMATTING_RULES) + ") r(document_type, class_name, prefix, suffix, indent, transform, allow_empty)"
TYPES_SQL = "(values " + ", ".join(f"({', '.join(map(in_sql, r))})" for r in S.DOCUMENT_TYPES) + ") k(doc_type_id, type_name, model_name, sorting_method)"


@query("s04_seed_dimensions", f"select e.element_id, document_type, prefix, suffix, indent, transform, allow_empty from layout_elements e join {RULES_SQL} using (class_name)")
def _(t):
    rules = dimensions.formatting_rules(t.spark)
    return t.layout_elements.join(rules, "class_name").select("element_id", "document_type", "prefix", "suffix", "indent", "transform", "allow_empty")


@query("s05_write_groups", "select page_id, element_id as first_element_id, bbox_y as start_y from layout_elements where class_name<>'plain text'")
def _(t):
    from pagespan.streaming.streams import scratch_dir

    at = f"{scratch_dir(t.spark)}/groups"
    rows = L.reading_order(L.preprocess(t.layout_elements))
    writers.write_groups(A.build_groups(rows), A.group_map(rows), at, buckets=4)
    return t.spark.read.parquet(f"{at}/question_groups").select("page_id", "first_element_id", "start_y")


#: Every element of a page in its place, with its texts.
NESTED = """select e.page_id, cast(row_number() over (partition by e.page_id order by bbox_y, bbox_x, e.element_id)-1 as int) as place, e.element_id, class_name, bbox_x, bbox_y, ocr_text, description
 from layout_elements e left join text_contents t on t.element_id=e.element_id left join ai_descriptions a on a.element_id=e.element_id"""
ITEM = ["element_id", "class_name", "bbox_x", "bbox_y", "ocr_text", "description"]


def kept(t):
    return t.keep("layout_elements", "page_id", "element_id", "class_name", "bbox_x", "bbox_y")


def unnested(pages):
    return pages.select("page_id", F.posexplode("elements").alias("place", "e")).select("page_id", "place", *[f"e.{c}" for c in ITEM])


@query("s06_write_json_results", NESTED)
def _(t):
    from pagespan.streaming.streams import scratch_dir

    at = f"{scratch_dir(t.spark)}/json"
    t = kept(t)
    nested = J.nested_pages(J.content_in_ranges(t.layout_elements, t.text_contents, t.ai_descriptions))
    writers.write_json_results(nested, at)
    return unnested(t.spark.read.schema(nested.schema).json(at))


@query("s08_resume_remaining", "select page_id, project_id || '_page_' || page_number as key from doc_pages where not (analysis_status='completed')")
def _(t):
    keyed = t.doc_pages.select("page_id", "analysis_status", F.concat_ws("_page_", "project_id", "page_number").alias("key"))
    return writers.resume_remaining(keyed, keyed.filter("analysis_status = 'completed'")).select("page_id", "key")


@query("f01_search_users", "select user_id, name from users where role='user' and (contains(lower(name),'an') or contains(lower(email),'an')) order by created_at desc, user_id desc limit 5")
def _(t):
    return K.search_users(t.users, "user", "AN", limit=5).select("user_id", "name")


@query("f02_list_projects", "select project_id, project_name from projects where status='completed' and doc_type_id=1 order by project_id desc limit 20 offset 10")
def _(t):
    return K.list_projects(t.projects, status="completed", doc_type_id=1, skip=10, limit=20).select("project_id", "project_name")


@query("f03_list_pages", "select page_id, page_number from doc_pages where project_id=3 and analysis_status<>'error' order by page_number")
def _(t):
    return K.list_pages(t.doc_pages, 3).select("page_id", "page_number")


@query("f04_elements_of_page", "select element_id, bbox_y, bbox_x from layout_elements where page_id=7 and class_name='figure' order by 2,3")
def _(t):
    return K.elements_of_page(t.layout_elements, 7, "figure").select("element_id", "bbox_y", "bbox_x")


@query("f05_doc_types_by_method", f"select project_id, type_name, model_name, sorting_method from projects join {TYPES_SQL} using (doc_type_id) where sorting_method='question_based'")
def _(t):
    kinds = K.doc_types_by_method(dimensions.document_types(t.spark), "question_based")
    return t.projects.join(kinds, "doc_type_id").select("project_id", "type_name", "model_name", "sorting_method")


@query("f06_versions_of_page", "select page_id, version_number from text_versions where is_current and version_type='user_edited' order by version_number desc")
def _(t):
    return K.versions_of_page(t.text_versions, current_only=True, version_type="user_edited").select("page_id", "version_number")


@query("f07_groups_of_page", "select element_id, row_number() over (order by bbox_y, bbox_x, element_id)-1 as group_id, bbox_y as start_y from layout_elements where page_id=5 order by 3")
def _(t):
    groups = A.build_groups(L.reading_order(t.layout_elements.filter("page_id = 5")))
    return K.groups_of_page(groups, 5).select(F.col("first_element_id").alias("element_id"), "group_id", "start_y")


@query("f07_elements_of_group", "select element_id from (select element_id, row_number() over (order by bbox_y, bbox_x, element_id) as r from layout_elements where page_id=5) where r=3")
def _(t):
    members = A.group_map(L.reading_order(t.layout_elements.filter("page_id = 5")))
    return K.elements_of_group(members, 5, 2).select("element_id")


@query("f08_pending_pages", "select page_id, project_id, page_number from doc_pages where analysis_status in ('pending','error') order by 2,3")
def _(t):
    return K.pending_pages(t.doc_pages).select("page_id", "project_id", "page_number")


@query("f09_visible_classes", "select element_id from layout_elements where class_name in ('figure','table')")
def _(t):
    return K.visible_classes(t.layout_elements, ["figure", "table"]).select("element_id")


F10 = "with x as (select element_id, " + " + ".join(f"cast(contains(regexp_replace(lower(ocr_text), '\\s', '', 'g'), '{g}') as int)" for g in ("fa", "am", "mi", "il", "ly")) + " as hits from text_contents) select element_id, hits from x where hits > 0 order by hits desc, element_id limit 20"


@query("f10_text_search", F10)
def _(t):
    return K.text_search(t.text_contents, "Family")


@query("f10_text_index", F10)
def _(t):
    from pagespan.streaming.streams import scratch_dir

    index = K.TextIndex(t.spark, f"{scratch_dir(t.spark)}/index")
    index.add(t.text_contents)
    return index.search("Family")


@query("f11_rules_for_type", f"select element_id, prefix, suffix, indent, transform, allow_empty from layout_elements join {RULES_SQL} using (class_name) where document_type='question_based' and class_name='choices'")
def _(t):
    rules = K.rules_for_type(dimensions.formatting_rules(t.spark), "question_based", "choices")
    return t.layout_elements.join(rules, "class_name").select("element_id", "prefix", "suffix", "indent", "transform", "allow_empty")


@query("t01_page_through", "select orders.o_orderkey from orders order by o_orderkey limit 1000 offset 500")
def _(t):
    return K.page_through(t.orders.select("o_orderkey"), ["o_orderkey"], 500, 1000)


@query("t03_top_classes", "select class_name, count(*) as n from layout_elements group by 1 order by 2 desc, 1 limit 5")
def _(t):
    return K.top_classes(t.layout_elements).select("class_name", F.col("count").alias("n"))


@query("t04_first_n_per_page", "select element_id, page_id from (select *, row_number() over (partition by page_id order by element_id) as r from layout_elements) where r<=3")
def _(t):
    return K.first_n_per_page(t.layout_elements).select("element_id", "page_id")


@query("j01_page_with_content", "select e.element_id, e.page_id, ocr_text, description from layout_elements e left join text_contents t on t.element_id=e.element_id left join ai_descriptions a on a.element_id=e.element_id")
def _(t):
    return J.page_with_content(t.layout_elements, t.text_contents, t.ai_descriptions).select("element_id", "page_id", "ocr_text", "description")


@query("j01_nested_pages", NESTED)
def _(t):
    t = kept(t)
    return unnested(J.nested_pages(J.content_in_ranges(t.layout_elements, t.text_contents, t.ai_descriptions)))


@query("j02_project_details", "select p.project_id, count(d.page_id) as total_pages, case doc_type_id when 1 then 'worksheet' else 'document' end as type_name, max(d.page_number) as combined_text from projects p left join doc_pages d using (project_id) group by p.project_id, doc_type_id")
def _(t):
    combined = t.doc_pages.groupBy("project_id").agg(F.max("page_number").alias("combined_text"))
    return J.project_details(t.projects, t.doc_pages, dimensions.document_types(t.spark), combined).select("project_id", "total_pages", "type_name", "combined_text")


@query("j03_attach_text", "select conv_id as element_id, arg_min(text, turn) as text from conversations where trim(text)<>'' group by 1")
def _(t):
    texts = t.conversations.select(F.col("conv_id").alias("element_id"), F.col("turn").alias("seq"), "text")
    return J.attach_text(texts.select("element_id").distinct(), texts).filter("text is not null")


@query("j04_sync_sorted", "select element_id, row_number() over (partition by page_id order by bbox_y, bbox_x, element_id)-1 as group_id from layout_elements")
def _(t):
    both, _ = J.sync_sorted(t.layout_elements, L.reading_order(t.layout_elements))
    return both.select("element_id", "group_id")


@query("j04_sync_missing", "select element_id from layout_elements where element_id%10=0")
def _(t):
    return J.sync_sorted(t.layout_elements.filter("element_id % 10 <> 0"), L.reading_order(t.layout_elements))[1].select("element_id")


PAIR = "abs((a.bbox_y+a.bbox_height/2)-(c.bbox_y+c.bbox_height/2)) < (a.bbox_height+c.bbox_height)/2*0.7 and (abs(c.bbox_x-(a.bbox_x+a.bbox_width))<50 or abs(a.bbox_x-(c.bbox_x+c.bbox_width))<50)"
IN_A = "('question type','question number','second_question_number')"
IN_C = "('question text','list','choices','figure','table','flowchart')"


@query("j06_adjacent_pairs", f"select a.page_id, a.element_id as anchor_id, c.element_id as child_id from layout_elements a join layout_elements c on a.page_id=c.page_id and a.class_name in {IN_A} and c.class_name in {IN_C} where {PAIR}")
def _(t):
    return L.adjacent_pairs(t.layout_elements, keys=("page_id",)).select("page_id", "anchor_id", "child_id")


@query(
    "j07_nearest_anchor",
    f"""with a as (select page_id, element_id, bbox_y, bbox_x+bbox_width/2 as cx, bbox_y+bbox_height/2 as cy from layout_elements where class_name in {IN_A}),
    c as (select page_id, element_id, bbox_x+bbox_width/2 as cx, bbox_y+bbox_height/2 as cy from layout_elements where class_name in {IN_C}),
    b as (select c.element_id as child_id, min((sqrt(power(0.2*(c.cx-a.cx),2)+power(c.cy-a.cy,2)), a.bbox_y, a.element_id)) as m from a join c on a.page_id=c.page_id and a.cy<=c.cy group by 1)
    select child_id, m[3] as anchor_id, m[1] as distance from b where m[1]<250""",
)
def _(t):
    return L.nearest_anchor(t.layout_elements, keep_top=False, keys=("page_id",)).select("child_id", "anchor_id", "distance")


QUESTIONS = "select page_id, element_id as question, bbox_y as q_y, lead(bbox_y) over (partition by page_id order by bbox_y, element_id) as next_q_y from layout_elements where class_name='question number'"


@query("j08_elements_in_question_range", f"with q as ({QUESTIONS}) select q.page_id, question, e.element_id from q join layout_elements e on e.page_id=q.page_id and e.bbox_y>=q_y and (next_q_y is null or e.bbox_y<next_q_y)")
def _(t):
    return J.elements_in_question_range(t.sql(QUESTIONS), t.layout_elements)


@query(
    "j09_nearest_question",
    f"""with q as ({QUESTIONS}), r as (select e.page_id, e.element_id, case when e.element_id%9=0 then null else e.bbox_y end as y from layout_elements e join ai_descriptions using (element_id)),
    b as (select r.element_id, min((abs(y-q_y), q_y, question)) as m from r join q on q.page_id=r.page_id where y is not null group by 1)
    select r.page_id, r.element_id, case when m[1]<=500 then cast(m[3] as varchar) else 'unknown' end as question from r left join b using (element_id)""",
)
def _(t):
    results = t.layout_elements.join(t.ai_descriptions, "element_id").withColumn("bbox_y", F.when(F.col("element_id") % 9 != 0, F.col("bbox_y")))
    return J.nearest_question(results, t.sql(QUESTIONS))


@query("j10_apply_rule_overrides", "select element_id, case class_name when 'list' then '* ' when 'choices' then '' end as prefix, case class_name when 'list' then 2 when 'choices' then 3 end as indent from layout_elements where class_name in ('list','choices')")
def _(t):
    base = dimensions.formatting_rules(t.spark)
    stored = t.spark.createDataFrame([("question_based", "list", "* ", "", 2), ("question_based", "no such class", "x", "x", 9), ("reading_order", "choices", "y", "y", 7)], "document_type string, class_name string, prefix string, suffix string, indent int")
    rules = J.apply_rule_overrides(base, stored, "question_based").filter("suffix = '\n'")
    return t.layout_elements.filter("class_name in ('list','choices')").join(rules, "class_name").select("element_id", "prefix", "indent")


@query("j11_current_versions_for_pages", "select page_id, version_number from text_versions where is_current and page_id in (select page_id from doc_pages)")
def _(t):
    return J.current_versions_for_pages(t.text_versions, t.doc_pages).select("page_id", "version_number")


@query("j12_coverage_gaps", "select page_id, 'no expectation' as gap from doc_pages where page_id not in (select page_id from text_versions) union all select distinct page_id, 'no input' from text_versions where page_id not in (select page_id from doc_pages)")
def _(t):
    return J.coverage_gaps(t.doc_pages, t.text_versions, "page_id")


@query("a01_project_statistics", "select project_id, count(*) as total_pages, count(*) filter (analysis_status='completed') as completed_pages, count(*)-count(*) filter (analysis_status='completed') as pending_pages, cast(sum(n) as bigint) as total_elements from (select d.*, (select count(*) from layout_elements e where e.page_id=d.page_id) as n from doc_pages d) group by 1")
def _(t):
    return A.project_statistics(t.doc_pages, t.layout_elements)


@query(
    "a02_page_stats",
    """with n as (select page_id, count(*) as total_elements, count(*) filter (class_name in ('question number','question type')) as anchor_elements from layout_elements group by 1)
 select page_id, total_elements, anchor_elements, class_name, count(*) as n, avg(confidence) as confidence from layout_elements join n using (page_id) group by all""",
)
def _(t):
    s = A.page_stats(t.layout_elements)
    each = s.select("page_id", "total_elements", "anchor_elements", "confidence_scores", F.explode("class_distribution").alias("class_name", "n"))
    return each.select("page_id", "total_elements", "anchor_elements", "class_name", "n", F.col("confidence_scores")[F.col("class_name")].alias("confidence"))


@query("a03_class_counts", "select class_name, count(*) as n from layout_elements group by 1 order by 2 desc, 1")
def _(t):
    return A.class_counts(t.layout_elements)


@query("a04_class_counts_by_source", "select class_name, count(t.element_id) as ocr_count, count(a.element_id) as ai_count, count(t.element_id)+count(a.element_id) as total from layout_elements e left join text_contents t using (element_id) left join ai_descriptions a using (element_id) group by 1")
def _(t):
    e = t.layout_elements.select("element_id", "class_name")
    return A.class_counts_by_source(e.join(t.text_contents, "element_id"), e.join(t.ai_descriptions, "element_id"))


@query("a05_counts_per_image", "select case when project_id%2=0 then 'p'||project_id||'.pdf (페이지 '||page_number||')' else 'p'||project_id||'.png' end as label, count(*) as n from doc_pages join layout_elements using (page_id) group by 1")
def _(t):
    rows = t.doc_pages.join(t.layout_elements.select("page_id"), "page_id").select(F.concat(F.lit("p"), "project_id", F.when(F.col("project_id") % 2 == 0, ".pdf").otherwise(".png")).alias("file_name"), "page_number")
    return A.counts_per_image(rows)


@query("a06_image_stats", "select count(*) as images, round(sum(case when page_id%7=0 then 0 else length(html) end)/1048576, 6) as total_mb from pages")
def _(t):
    return A.image_stats(t.pages.select(F.when(F.col("page_id") % 7 != 0, F.length("html")).alias("size_bytes")))


@query("a07_document_counts", "select page_id, count(*) filter (contains(class_name,'text')) as text_regions, count(*) filter (class_name='figure') as figures, count(*) filter (class_name='table') as tables, count(*) filter (trim(coalesce(ocr_text,''))<>'') as with_text, count(description) as with_ai from layout_elements e left join text_contents t on t.element_id=e.element_id left join ai_descriptions a on a.element_id=e.element_id group by 1")
def _(t):
    return A.document_counts(J.page_with_content(t.layout_elements, t.text_contents, t.ai_descriptions))


GROUPS_SQL = Z.query("", Z.sorter(), "gr as (select page_id, group_id, max(anchor_id) as anchor_element_id, case when max(anchor_id) is null then 'orphan' else 'anchor' end as group_type, arg_min(element_id, order_in_group) as first_element_id, min(y) as start_y, max(y+h) as end_y, count(*) as element_count from so group by 1,2)").rstrip()


@query("a08_group_stats", GROUPS_SQL + " select page_id, count(*) as groups, count(*) filter (group_type='anchor') as anchor_groups, count(*) filter (group_type='orphan') as orphan_groups, cast(sum(element_count) as bigint) as mapped_elements from gr group by 1")
def _(t):
    return A.group_stats(A.build_groups(L.sort_layout(t.layout_elements, t.doc_pages)))


@query("a09_build_groups", GROUPS_SQL + " select * from gr")
def _(t):
    return A.build_groups(L.sort_layout(t.layout_elements, t.doc_pages))


@query("a09_groups_in_reading_order", "select page_id, element_id as first_element_id, bbox_y as start_y, bbox_y+bbox_height as end_y, 'orphan' as group_type from layout_elements where class_name<>'plain text'")
def _(t):
    return A.build_groups(L.reading_order(L.preprocess(t.layout_elements))).select("page_id", "first_element_id", "start_y", "end_y", "group_type")


@query("a10_batch_summary", "select project_id, count(*) filter (analysis_status<>'pending') as processed, count(*) filter (analysis_status='completed') as ok, count(*) filter (analysis_status='error') as failed, case when count(*) filter (analysis_status<>'pending')=0 then 'no_pending_pages' when count(*) filter (analysis_status='error')=0 then 'completed' when count(*) filter (analysis_status='completed')=0 then 'error' else 'in_progress' end as status from doc_pages group by 1")
def _(t):
    results = t.doc_pages.filter("analysis_status <> 'pending'").select("page_id", (F.col("analysis_status") == "completed").alias("ok"))
    return A.batch_summary(t.doc_pages.select("page_id", "project_id"), results)


@query("a11_combined_stats", "select source as project_id, count(*) as total_pages, cast(sum(len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>''))) as bigint) as total_words, cast(sum(length(text)) as bigint) as total_characters from documents group by 1")
def _(t):
    return A.combined_stats(t.documents.select(F.col("source").alias("project_id"), F.col("text").alias("content")))


@query("a12_recount_pages", "select project_id, count(page_id) as total_pages from projects left join doc_pages using (project_id) group by 1")
def _(t):
    return A.recount_pages(t.projects, t.doc_pages)


@query("a13_latest_timestamp", "select user_id as page_id, max(ts) as latest from events where event_type<>'error' group by 1")
def _(t):
    return A.latest_timestamp(t.events.select(F.col("user_id").alias("page_id"), F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("is_current")))


@query("a14_anchor_dispersion", f"with a as (select page_id, case when class_name in {IN_A} then bbox_x+bbox_width/2 end as cx, case when class_name in {IN_A} then bbox_y+bbox_height/2 end as cy from layout_elements) select page_id, count(cx) as n_anchors, round(coalesce(stddev_pop(cx),0),6) as x_std, round(coalesce(var_pop(cy),0),4) as y_var, round(case when count(cx)>1 then greatest(0, 1-stddev_pop(cx)/(0.3*2480)) else 0.5 end,6) as consistency from a group by 1")
def _(t):
    return A.anchor_dispersion(t.layout_elements, 2480.0).select("page_id", "n_anchors", F.round("x_std", 6).alias("x_std"), F.round("y_var", 4).alias("y_var"), F.round("consistency", 6).alias("consistency"))


RIGHT = "abs((a.bbox_y+a.bbox_height/2)-(c.bbox_y+c.bbox_height/2)) < (a.bbox_height+c.bbox_height)/2*0.7 and abs(c.bbox_x-(a.bbox_x+a.bbox_width))<50"


@query("a15_adjacency_ratio", f"select page_id, case when count(*) filter (class_name in {IN_A})=0 then 0 else count(*) filter (class_name in {IN_A} and element_id in (select a.element_id from layout_elements a join layout_elements c on a.page_id=c.page_id and a.class_name in {IN_A} and c.class_name in {IN_C} where {RIGHT}))/count(*) filter (class_name in {IN_A}) end as adjacency_ratio from layout_elements group by 1")
def _(t):
    return A.adjacency_ratio(t.layout_elements)


@query("a16_run_summary", "select count(*) filter (analysis_status='completed') as succeeded, count(*) filter (analysis_status<>'completed') as failed, cast(sum(case when analysis_status='completed' then page_number else 0 end) as bigint) as objects from doc_pages")
def _(t):
    ok = F.col("analysis_status") == "completed"
    return A.run_summary(t.doc_pages.select(ok.alias("ok"), F.when(ok, F.col("page_number")).otherwise(0).alias("objects")))


@query("a17_distinct_classes", "select distinct class_name from layout_elements order by 1")
def _(t):
    return A.distinct_classes(t.layout_elements)


@query("a18_class_share_of_max", "with c as (select page_id, class_name, count(*) as n from layout_elements group by 1,2) select page_id, class_name, n, 100.0*n/max(n) over (partition by page_id) as share from c")
def _(t):
    return A.class_share_of_max(t.layout_elements)


@query("u01_merge_pages", "select page_id, page_number from doc_pages")
def _(t):
    p = t.doc_pages.select("page_id", "page_number")
    return J.merge_pages(p.filter("page_id % 3 <> 0"), p.filter("page_id % 3 <> 1"))


@query("u02_union_classes", "select distinct class_name from layout_elements")
def _(t):
    e = t.layout_elements
    return J.union_classes(e.filter("class_name like '%question%'"), e.filter("class_name not like '%type%'"))


@query("u03_unassigned", "select page_id, element_id, case when class_name in ('question type','question number','second_question_number') then 'anchor' else 'child' end as kind from layout_elements where class_name<>'plain text'")
def _(t):
    return J.unassigned(t.layout_elements, L.reading_order(t.layout_elements))


UNASSIGNED_SQL = Z.query(
    f"select page_id, element_id, 'anchor' as kind from layout_elements where class_name in {Z.A} and element_id not in (select element_id from so where element_id=anchor_id) union all select page_id, element_id, 'child' from layout_elements where class_name in {Z.C} and element_id not in (select element_id from so where anchor_id is not null)",
    Z.sorter(),
)


@query("u03_unassigned_after_sort", UNASSIGNED_SQL)
def _(t):
    return J.unassigned(t.layout_elements, L.sort_layout(t.layout_elements, t.doc_pages))


ORDERED = "select page_id, element_id, row_number() over (partition by page_id order by case when {0} then 0 else 1 end, bbox_y, bbox_x, element_id)-1 as place from layout_elements"


@query("u04_concat_zones", ORDERED.format("bbox_x+bbox_width/2 < 1240"))
def _(t):
    left = L.cx() < 1240
    return J.in_order(t.layout_elements.filter(left), t.layout_elements.filter(~left), by=["bbox_y", "bbox_x", "element_id"]).select("page_id", "element_id", "place")


@query("u05_orphan_union", ORDERED.format("class_name='plain text'"))
def _(t):
    orphan = F.col("class_name") == "plain text"
    return J.in_order(t.layout_elements.filter(orphan), t.layout_elements.filter(~orphan), by=["bbox_y", "bbox_x", "element_id"]).select("page_id", "element_id", "place")
