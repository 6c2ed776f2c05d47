"""Queries of cleaning, derived columns and text functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagespan.functions import text as X
from pagespan.operators import clean as C
from pagespan.operators import layout as L
from pagespan.plans.registered import query

KEY = ["element_id"]


@query("p01_with_geometry", "select element_id, bbox_width*bbox_height as area, bbox_x as x_position, bbox_y as y_position, bbox_x+bbox_width/2 as cx, bbox_y+bbox_height/2 as cy, bbox_x+bbox_width as x2, bbox_y+bbox_height as y2 from layout_elements")
def _(t):
    return C.with_geometry(t.layout_elements).select("element_id", "area", "x_position", "y_position", "cx", "cy", "x2", "y2")


@query("p02_xyxy_to_xywh", "select det_id, cast(trunc(x1) as int) as bbox_x, cast(trunc(y1) as int) as bbox_y, cast(trunc(x2) as int)-cast(trunc(x1) as int) as bbox_width, cast(trunc(y2) as int)-cast(trunc(y1) as int) as bbox_height from raw_detections")
def _(t):
    return C.xyxy_to_xywh(t.raw_detections).select("det_id", "bbox_x", "bbox_y", "bbox_width", "bbox_height")


NAMES_SQL = "case class_id when 0 then 'question type' when 1 then 'question number' when 2 then 'second_question_number' when 3 then 'question text' when 4 then 'list' when 5 then 'choices' when 6 then 'figure' when 7 then 'table' when 8 then 'flowchart' when 9 then 'plain text' when 10 then 'title' when 11 then 'unit' else concat('unknown_', cast(class_id as varchar)) end"


@query("p03_resolve_class_name", f"select det_id, class_id, {NAMES_SQL} as class_name from raw_detections")
def _(t):
    return C.resolve_class_name(t.raw_detections, C.class_table(t.spark)).select("det_id", "class_id", "class_name")


@query("p04_drop_small", "select element_id from layout_elements where bbox_width*bbox_height >= 20000")
def _(t):
    return C.drop_small(t.layout_elements, 20000).select("element_id")


@query(
    "p05_clamp_to_page",
    """with b as (select element_id, greatest(bbox_x,0) as x1, greatest(bbox_y,0) as y1, least(bbox_x+bbox_width, image_width) as x2, least(bbox_y+bbox_height, image_height) as y2 from layout_elements join doc_pages using (page_id))
    select element_id, x1 as bbox_x, y1 as bbox_y, x2-x1 as bbox_width, y2-y1 as bbox_height from b where x2>x1 and y2>y1""",
)
def _(t):
    both = t.layout_elements.join(t.doc_pages.select("page_id", "image_width", "image_height"), "page_id")
    return C.clamp_to_page(both, F.col("image_width"), F.col("image_height")).select("element_id", "bbox_x", "bbox_y", "bbox_width", "bbox_height")


@query("p06_box_ratios", "select element_id, bbox_width/image_width as width_ratio, bbox_height/image_height as height_ratio, cast(floor(bbox_x+bbox_width/2) as int) as center_x, cast(floor(bbox_y+bbox_height/2) as int) as center_y from layout_elements join doc_pages using (page_id)")
def _(t):
    both = t.layout_elements.join(t.doc_pages.select("page_id", "image_width", "image_height"), "page_id")
    return C.box_ratios(both, F.col("image_width"), F.col("image_height")).select("element_id", "width_ratio", "height_ratio", "center_x", "center_y")


@query(
    "p07_page_extent",
    """with s as (select page_id, case when page_id%3=0 then 0 when page_id%3=1 then null else image_width end as w, case when page_id%3=2 then image_height else 0 end as h from doc_pages)
    select e.page_id, coalesce(nullif(max(w),0), max(bbox_x+bbox_width)) as page_width, coalesce(nullif(max(h),0), max(bbox_y+bbox_height)) as page_height from layout_elements e left join s on s.page_id=e.page_id group by e.page_id""",
)
def _(t):
    k = F.col("page_id") % 3
    pages = t.doc_pages.select("page_id", F.when(k == 0, 0).when(k == 2, F.col("image_width")).alias("image_width"), F.when(k == 2, F.col("image_height")).otherwise(0).alias("image_height"))
    return L.page_extent(t.layout_elements, pages).select("page_id", "page_width", "page_height").distinct()


@query(
    "p08_physical_size",
    """with d as (select page_id, image_width, image_height, coalesce(case when page_id%4=0 then 200.0 end, case when image_height>0 then least(greatest(image_height/11.69,120.0),600.0) end, 300.0) as effective_dpi from doc_pages)
    select page_id, effective_dpi, image_width/effective_dpi as width_inches, image_height/effective_dpi as height_inches from d""",
)
def _(t):
    return C.physical_size(t.doc_pages, F.when(F.col("page_id") % 4 == 0, F.lit(200.0))).select("page_id", "effective_dpi", "width_inches", "height_inches")


@query(
    "p09_scale_boxes",
    "select element_id, bbox_x*(620/2480) as scaled_x, bbox_y*(1000/3508) as scaled_y, bbox_width*(620/2480) as scaled_width, bbox_height*(1000/3508) as scaled_height, least(620/2480, 1000/3508) as fit_scale, least(greatest(2.0/((620/2480+1000/3508)/2),1.0),4.0) as stroke_width from layout_elements",
)
def _(t):
    size = lambda a, b: (F.lit(a).cast("double"), F.lit(b).cast("double"))
    return C.scale_boxes(t.layout_elements, size(2480, 3508), size(620, 1000)).select("element_id", "scaled_x", "scaled_y", "scaled_width", "scaled_height", "fit_scale", "stroke_width")


@query(
    "p10_validate_elements",
    "select element_id, (case when confidence > 0.95 then 'confidence' else '' end) || (case when bbox_x < 0 or bbox_y - 200 < 0 then 'position' else '' end) as faults from layout_elements where confidence > 0.95 or bbox_y - 200 < 0",
)
def _(t):
    shifted = t.layout_elements.withColumns({"bbox_y": F.col("bbox_y") - 200, "confidence": F.when(F.col("confidence") > 0.95, F.lit(2.0)).otherwise(F.col("confidence"))})
    return C.validate_elements(shifted)[1].select("element_id", F.array_join("faults", "").alias("faults"))


@query("p11_preprocess_elements", "select element_id from layout_elements where class_name <> 'plain text' and bbox_width*bbox_height > 0")
def _(t):
    return L.preprocess(t.layout_elements).select("element_id")


@query("p12_canonical_class", "select element_id, class_name as canonical from layout_elements")
def _(t):
    drifted = F.when(F.col("element_id") % 3 == 0, F.upper(F.translate("class_name", " ", "_"))).when(F.col("element_id") % 3 == 1, F.initcap("class_name")).otherwise(F.col("class_name"))
    return t.layout_elements.select("element_id", C.canonical_class(drifted).alias("canonical"))


@query(
    "p13_map_doc_type",
    "select project_id, case when doc_type_id in (2,3) then 'reading_order' else 'question_based' end as sorting_method, case when project_id%10=0 then null when project_id%5=0 then 'document-layout' when doc_type_id=2 then 'document-layout' else 'worksheet-layout' end as model_name, project_id%10=0 as model_fault from projects",
)
def _(t):
    given = F.when(F.col("project_id") % 10 == 0, "no such model").when(F.col("project_id") % 5 == 0, "document-layout")
    return C.map_doc_type(t.projects, given).select("project_id", "sorting_method", "model_name", "model_fault")


@query("p14_route_ocr", "select element_id, case when class_name in ('question number','second_question_number') then 'tesseract' else 'vision' end as engine from layout_elements where class_name not in ('figure','table','flowchart')")
def _(t):
    return C.route_ocr(t.layout_elements).select("element_id", "engine")


@query(
    "p15_coalesce_ocr",
    """with p as (select element_id, trim(ocr_text, ' \t\n\r') as x from text_contents where ocr_engine='primary'), f as (select element_id, trim(ocr_text, ' \t\n\r') as x from text_contents where ocr_engine='fallback')
    select e.element_id, coalesce(nullif(p.x,''), nullif(f.x,'')) as text, case when nullif(p.x,'') is not null then 'primary' else 'fallback' end as engine from layout_elements e left join p using (element_id) left join f using (element_id)
    where length(coalesce(nullif(p.x,''), nullif(f.x,''))) > 1""",
)
def _(t):
    texts = t.text_contents
    return C.coalesce_ocr(t.layout_elements.select("element_id"), texts.filter("ocr_engine = 'primary'"), texts.filter("ocr_engine = 'fallback'")).select("element_id", "text", "engine")


@query("p16_ai_targets", "select element_id from layout_elements where class_name in ('figure','table','flowchart') and bbox_width>0 and bbox_height>0")
def _(t):
    return C.ai_targets(t.layout_elements).select("element_id")


@query("p17_preview", "select doc_id, case when length(text)>80 then substring(replace(text, chr(10), ' '),1,80) || '...' else replace(text, chr(10), ' ') end as preview from documents")
def _(t):
    return t.documents.select("doc_id", X.preview(F.col("text"), 80).alias("preview"))


@query("p18_format_metrics", "select element_id, cast(cast(floor(confidence*100+0.5) as int) as varchar) || '%' as confidence, case when element_id%9=0 then '-' when bbox_y<1024 then printf('%.0f', floor(bbox_y/1024*1000+0.5))||'ms' else printf('%.2f', floor(bbox_y/1024*100+0.5)/100)||'초' end as duration from layout_elements")
def _(t):
    seconds = F.when(F.col("element_id") % 9 != 0, F.col("bbox_y") / 1024)
    return t.layout_elements.select("element_id", X.confidence_label(F.col("confidence")).alias("confidence"), X.duration_label(seconds).alias("duration"))


@query("p19_normalise_path", "select page_id, replace(replace(url, '/', '\\'), '\\', '/') as path, substring(regexp_replace(url || '페이지 1', '[^\\p{L}\\p{N}._-]', '', 'g'),1,50) as file_name from pages")
def _(t):
    return t.pages.select("page_id", X.normalise_path(F.translate("url", "/", "\\")).alias("path"), X.safe_filename(F.concat("url", F.lit("페이지 1"))).alias("file_name"))


@query("p20_parse_bbox_variant", "select element_id, bbox_x, bbox_y, greatest(1, bbox_width-100) as bbox_width, greatest(1, bbox_height-100) as bbox_height from layout_elements")
def _(t):
    w, h = F.col("bbox_width") - 100, F.col("bbox_height") - 100
    listed = F.when(F.col("element_id") % 2 == 0, F.array("bbox_x", "bbox_y", w, h))
    struct = F.when(F.col("element_id") % 2 == 1, F.struct(F.col("bbox_x").alias("x"), F.col("bbox_y").alias("y"), w.alias("w"), h.alias("h")))
    return C.parse_bbox_variant(t.layout_elements.select("element_id", listed.alias("bbox"), struct.alias("box"))).select("element_id", "bbox_x", "bbox_y", "bbox_width", "bbox_height")


IOU_SQL = """with e as (select page_id, element_id, bbox_x as x, bbox_y as y, bbox_width as w, bbox_height as h from layout_elements),
 p as (select a.page_id, a.element_id as a, b.element_id as b, greatest(0, least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0, least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) as i, a.w*a.h as s, b.w*b.h as u from e a join e b on a.page_id=b.page_id and a.element_id<b.element_id)
 select page_id, a, b, i/(s+u-i) as iou from p where i/(s+u-i) > {}"""


@query("j05_iou_pairs", IOU_SQL.format(0.3))
def _(t):
    return C.iou_pairs(t.layout_elements, 0.3)


GREEDY = """with recursive e as (select page_id, element_id, row_number() over (partition by page_id order by confidence desc, element_id) as r, bbox_x as x, bbox_y as y, bbox_width as w, bbox_height as h from layout_elements),
 p as (select a.page_id, a.element_id as a, b.element_id as b, greatest(0, least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0, least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) as i, a.w*a.h as s, b.w*b.h as u from e a join e b on a.page_id=b.page_id and a.r>b.r),
 o as (select e.page_id, e.element_id, e.r, list(p.b) filter (p.b is not null) as over from e left join p on p.a=e.element_id and i/(s+u-i)>0.7 group by 1,2,3),
 f as (select page_id, r, [element_id] as kept from o where r=1 union all select f.page_id, o.r, case when list_has_any(kept, coalesce(over, [])) then kept else list_append(kept, o.element_id) end from f join o on o.page_id=f.page_id and o.r=f.r+1)
 select page_id, unnest(arg_max(kept, r)) as element_id from f group by page_id"""


@query("l01_dedupe_detections", GREEDY)
def _(t):
    return C.dedupe_detections(t.layout_elements).select("element_id", "page_id")


L_SQL = "regexp_split_to_array(ocr_text, chr(10))"


@query("e01_split_first_line", "select element_id, split_part(ocr_text, chr(10), 1) as first_line, case when contains(ocr_text, chr(10)) then trim(substr(ocr_text, instr(ocr_text, chr(10))+1), ' \n\t\r') else '' end as remainder from text_contents")
def _(t):
    c = F.col("ocr_text")
    return t.text_contents.select("element_id", X.first_line(c).alias("first_line"), X.remainder(c).alias("remainder"))


FILLED = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' \t\r')), lambda x: x <> '')"
MESSY = "concat('1) ', ocr_text, chr(10), '② two', chr(10), ' - three', chr(10), '4. four')"


@query("e02_normalize_choices", f"select element_id, array_to_string(list_transform({FILLED.format(MESSY)}, lambda x: case when regexp_matches(x, '^(\\(?\\d{{1,2}}[\\).]|[①-⑳]|[A-Z][\\).])\\s*.+$') then regexp_extract(x, '^(\\(?\\d{{1,2}}[\\).]|[①-⑳]|[A-Z][\\).])\\s*(.+)$', 1) || ' ' || trim(regexp_extract(x, '^(\\(?\\d{{1,2}}[\\).]|[①-⑳]|[A-Z][\\).])\\s*(.+)$', 2)) else '• ' || x end), chr(10)) as choices from text_contents")
def _(t):
    return t.text_contents.select("element_id", X.normalize_choices(F.concat(F.lit("1) "), "ocr_text", F.lit("\n② two\n - three\n4. four"))).alias("choices"))


@query("e03_normalize_list", f"select element_id, array_to_string(list_transform({FILLED.format(MESSY)}, lambda x: '- ' || case when regexp_matches(x, '^([-•]|\\d+\\.)\\s*.+$') then trim(regexp_extract(x, '^([-•]|\\d+\\.)\\s*(.+)$', 2)) else x end), chr(10)) as listed from text_contents")
def _(t):
    return t.text_contents.select("element_id", X.normalize_list(F.concat(F.lit("1) "), "ocr_text", F.lit("\n② two\n - three\n4. four"))).alias("listed"))


@query("e04_normalize_reading_list", f"select element_id, array_to_string(list_transform({FILLED.format(MESSY)}, lambda x: '• ' || case when regexp_matches(x, '^([-•]|\\d+\\.)\\s*.+$') then trim(regexp_extract(x, '^([-•]|\\d+\\.)\\s*(.+)$', 2)) else x end), chr(10)) as listed from text_contents")
def _(t):
    return t.text_contents.select("element_id", X.normalize_reading_list(F.concat(F.lit("1) "), "ocr_text", F.lit("\n② two\n - three\n4. four"))).alias("listed"))


@query("e05_merge_visual", "select e.element_id, case when description is not null and e.element_id%2=0 then description || chr(10) || class_name when description is not null then description when e.element_id%2=0 then class_name else '' end as merged from layout_elements e left join ai_descriptions using (element_id)")
def _(t):
    both = t.layout_elements.join(t.ai_descriptions, "element_id", "left")
    return both.select("element_id", X.merge_visual(F.when(F.col("element_id") % 2 == 0, F.col("class_name")), F.col("description")).alias("merged"))


@query("e06_trim_text", "select doc_id, trim(text, ' \t\n\r') as trimmed from documents")
def _(t):
    return t.documents.select("doc_id", X.strip(F.concat(F.lit(" \n"), "text", F.lit("　\t"))).alias("trimmed"))


@query("e07_normalize_question_type", "select doc_id, replace(text, chr(10), ' ') as normal from documents")
def _(t):
    return t.documents.select("doc_id", X.normalize_question_type(F.col("text")).alias("normal"))


@query(
    "e08_apply_rule",
    """with t as (select element_id, case when element_id%5=0 then '' else regexp_replace(ocr_text, '\\n$', '') end as x from text_contents),
    b as (select element_id, array_to_string(list_transform(string_split(regexp_replace(x, '\\n$', ''), chr(10)), lambda x: case when trim(x, ' \t\r')='' then '' else '   ' || x end), chr(10)) as y from t) select element_id, case when y='' then '[' else '[' || y || ']' end as ruled from b""",
)
def _(t):
    text = F.when(F.col("element_id") % 5 == 0, "").otherwise(F.regexp_replace("ocr_text", "\\n\\z", ""))
    return t.text_contents.select("element_id", X.apply_rule(text, F.lit("["), F.lit("]"), F.lit(3), F.lit(True)).alias("ruled"))


@query("e09_strip_inputs", "select element_id, trim(ocr_text, ' \t\n\r') as text from text_contents where trim(ocr_text, ' \t\n\r') <> '' and element_id%3<>0")
def _(t):
    blank = F.when(F.col("element_id") % 3 == 0, F.lit(" \n")).otherwise(F.col("ocr_text"))
    return t.text_contents.select("element_id", X.strip(blank).alias("text")).filter("text <> ''")


@query("e10_wrap_text")
def _(t):
    return t.text_contents.select("element_id", X.wrap_text(F.col("ocr_text")).alias("wrapped"))


LABELLED = "case element_id%7 when 0 then '③ ' when 1 then '( 2 ) ' when 2 then '4 ．' when 3 then '(7) ' when 4 then '⑪ ' when 5 then ' 5.' else '（1）' end || ocr_text"


@query("e11_choice_number", f"select element_id, coalesce(nullif(regexp_extract({LABELLED}, '^([①②③④⑤⑥⑦⑧⑨⑩])', 1), ''), nullif(regexp_extract({LABELLED}, '^[(（]\\s*([1-5])\\s*[)）]', 1), ''), nullif(regexp_extract({LABELLED}, '^([1-5])\\s*[.．]', 1), ''), '') as label from text_contents where ocr_text is not null")
def _(t):
    return t.text_contents.filter("ocr_text is not null").select("element_id", X.choice_number(F.expr(LABELLED)).alias("label"))


KEYWORD = "case element_id%6 when 0 then ocr_text when 1 then ocr_text || ' 다음을' when 2 then '해설 ' || ocr_text when 3 then '② ' || ocr_text when 4 then '（ 3）' || ocr_text else '답: ' || ocr_text end"
KIND_SQL = "case when regexp_matches({0}, '^[①②③④⑤⑥⑦⑧⑨⑩]|^[(（]\\s*[1-5]\\s*[)）]|^[1-5]\\s*[.．]') then 'choices' when regexp_matches({0}, '다음을|아래의|위의|그림을|표를') then 'passage' when regexp_matches({0}, '설명|해설|풀이|답:') then 'explanations' else 'question_text' end"


@query("e12_classify_text", f"select element_id, {KIND_SQL.format(KEYWORD)} as kind from text_contents")
def _(t):
    return t.text_contents.select("element_id", X.classify_text(F.expr(KEYWORD)).alias("kind"))


@query("e17_word_count", "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as int) as word_count, cast(length(text) as int) as char_count from documents")
def _(t):
    return t.documents.select("doc_id", X.words(F.col("text")).alias("word_count"), F.length("text").alias("char_count"))


@query("e18_section_header", "select page_id, version_number, '─── 페이지 ' || page_id || case when version_number%2=0 then ' (내용 없음) ───' else ' (Version: ' || version_number || ' - ' || version_type || ') ───' end as header from text_versions")
def _(t):
    version = F.when(F.col("version_number") % 2 != 0, F.col("version_number"))
    return t.text_versions.select("page_id", "version_number", X.section_header(F.col("page_id"), version, F.col("version_type")).alias("header"))


@query("e22_date_label", "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as file_label, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso_label, strftime(ts, '%Y-%m-%d %H:%M') as minute_label from events")
def _(t):
    return t.events.select("event_id", X.date_label(F.col("ts")).alias("file_label"), X.date_label(F.col("ts"), "iso").alias("iso_label"), X.date_label(F.col("ts"), "minute").alias("minute_label"))


@query("e23_numeric_map_only", "select page_id, cast(count(*) filter (mean is not null) as int) as classes, round(sum(mean),6) as total from (select page_id, class_name, case when class_name='list' then null else avg(confidence) end as mean from layout_elements group by 1,2) group by page_id")
def _(t):
    mean = F.when(F.col("class_name") == "list", F.lit(float("nan"))).otherwise(F.col("mean"))
    by = t.layout_elements.groupBy("page_id", "class_name").agg(F.avg("confidence").alias("mean")).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("class_name", mean.alias("m")))).alias("m"))
    kept = X.numeric_map_only(F.col("m"))
    return by.select("page_id", F.size(kept).alias("classes"), F.round(F.when(F.size(kept) > 0, F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


@query("w12_limit_blank_runs", "select doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(10), chr(10)||chr(10)||chr(10)||' '||chr(10)), chr(10)), lambda x: rtrim(x, ' \t\r')), chr(10)), '\\n{3}\\n+', chr(10)||chr(10)||chr(10), 'g'), ' \n\t\r') as cleaned from documents")
def _(t):
    return t.documents.select("doc_id", X.limit_blank_runs(F.regexp_replace("text", "\n", "\n\n\n \n")).alias("cleaned"))
