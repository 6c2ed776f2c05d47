"""The engine's tables over a folder of parquet files: raw ones, and those derived by SQL.

The derivations are plain SQL that Spark and DuckDB both run, so that oracles use the same text.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagespan.operators.sides import dealt, tasks
from pagespan.sources.scratch import cut

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DERIVED = {
    "layout_elements": """
select page_id*1000+rn as element_id, page_id,
 case k when 0 then 'question type' when 1 then 'question number' when 2 then 'question number'
        when 3 then 'second_question_number' when 4 then 'question text' when 5 then 'question text'
        when 6 then 'list' when 7 then 'choices' when 8 then 'figure' when 9 then 'table'
        when 10 then 'flowchart' else 'plain text' end as class_name,
 1.0-l_discount as confidence,
 cast(case when page_id%8=4 and k=0 then 100 when page_id%4=0 then 150+l_partkey%20
      when page_id%4=1 then (l_suppkey%2)*1240+100+l_partkey%80
      when page_id%4=2 then case when y<1400 then 150+l_partkey%20 else (l_suppkey%2)*1240+100+l_partkey%80 end
      else case when y>=1400 then 150+l_partkey%20 else (l_suppkey%2)*1240+100+l_partkey%80 end end as int) as bbox_x,
 y as bbox_y,
 cast(case when page_id%8=4 and k=0 then 2100 when k<=3 then 60+l_partkey%30 else 300+l_partkey%700 end as int) as bbox_width,
 cast(20+l_quantity*4 as int) as bbox_height
from (select *,
   row_number() over (partition by page_id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as rn,
   cast((l_partkey+l_linenumber)%12 as int) as k,
   cast((l_suppkey*31+l_partkey*13)%3300 as int) as y
  from (select *, cast(floor(l_orderkey/8) as bigint) as page_id from lineitem) r) q""",
    "doc_pages": """
select page_id, cast(floor(page_id/12) as bigint) as project_id, cast(page_id%12+1 as int) as page_number,
 2480 as image_width, 3508 as image_height,
 case when page_id%5=0 then 'pending' when page_id%5=1 then 'error' else 'completed' end as analysis_status,
 cast(page_id%17 as double)*0.5 as processing_time, analyzed_at
from (select cast(floor(o_orderkey/8) as bigint) as page_id, max(o_orderdate) as analyzed_at from orders group by 1) t""",
    "projects": """
select c_custkey as project_id, c_nationkey as user_id, cast(c_custkey%2+1 as int) as doc_type_id, c_name as project_name,
 case c_mktsegment when 'BUILDING' then 'completed' when 'MACHINERY' then 'in_progress' when 'HOUSEHOLD' then 'error' else 'created' end as status
from customer""",
    "users": """
select n_nationkey as user_id, n_name as name, concat(lower(n_name), '@example.org') as email,
 case n_regionkey when 0 then 'admin' when 1 then 'teacher' when 2 then 'student' else 'user' end as role,
 timestamp '2024-01-01 00:00:00' + n_nationkey * interval '1' day as created_at
from nation""",
    "text_contents": """
select e.element_id,
 case when own=0 then cast(e.element_id%60+1 as varchar(10))
      else substring(d.text, cast((place-1)*floor((length(d.text)+parts-1)/parts)+1 as int), cast(floor((length(d.text)+parts-1)/parts) as int)) end as ocr_text,
 case when e.element_id%7=0 then 'fallback' else 'primary' end as ocr_engine, d.lang as language
from (select element_id, own, sum(own) over (partition by page_id order by element_id) as place, greatest(sum(own) over (partition by page_id), 1) as parts,
   page_id % (select max(doc_id)+1 from documents) as of_doc
  from (select element_id, page_id, case when class_name in ('question number','second_question_number') then 0 else 1 end as own
   from layout_elements where class_name not in ('figure','table','flowchart')) t) e
join documents d on d.doc_id = e.of_doc""",
    "ai_descriptions": """
select element_id, concat('description ', cast(element_id as varchar(20))) as description
from layout_elements where class_name in ('figure','table','flowchart') and element_id%3<>0""",
    "text_versions": """
select conv_id as page_id, cast(turn+1 as int) as version_number,
 case role when 'system' then 'original' when 'assistant' then 'auto_formatted' else 'user_edited' end as version_type,
 text as content, turn = max(turn) over (partition by conv_id) as is_current
from conversations""",
    "page_status_events": """
select event_id, ts, user_id as page_id,
 case event_type when 'signup' then 'pending' when 'view' then 'processing' when 'error' then 'failed' else 'completed' end as status,
 value as processing_time
from events""",
    "raw_detections": """
select element_id as det_id, page_id, cast(element_id%13 as int) as class_id, confidence,
 cast(bbox_x+0.25 as double) as x1, cast(bbox_y+0.5 as double) as y1,
 cast(bbox_x+bbox_width+0.75 as double) as x2, cast(bbox_y+bbox_height+0.5 as double) as y2
from layout_elements""",
}


def needed(sql: str, bodies: dict[str, str] = DERIVED) -> list[str]:
    """Derived tables that a text names, those they rest on first."""
    out: list[str] = []
    for name, body in bodies.items():
        if re.search(rf"\b{name}\b", sql):
            out += [n for n in [*needed(body, bodies), name] if n not in out]
    return out


def with_tables(sql: str, bodies: dict[str, str] = DERIVED) -> str:
    """``sql`` with the derived tables it names in front (for DuckDB, where raw tables are views)."""
    ctes = ", ".join(f"{n} as ({bodies[n]})" for n in needed(sql, bodies))
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {sql[14:]}"
    return f"with {ctes}, {sql[4:]}" if sql.lower().startswith("with") else f"with {ctes} {sql}"


class Tables:
    """Tables by attribute: ``Tables(spark, folder).layout_elements``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.bodies = spark, sf_dir, dict(DERIVED)

    def keep(self, name: str, *columns: str) -> Tables:
        """These tables, of which the derived table ``name`` is worked out once (``columns`` alone): for several uses in one query.

        Large ones are dealt to tasks by the first column and the number of rows: what a use makes of few numbers may be long texts.
        """
        out, view = Tables(self.spark, self.sf_dir), f"kept_{uuid.uuid4().hex}"
        once = cut(getattr(self, name).select(*columns))
        dealt(once, tasks(once), columns[0]).createOrReplaceTempView(view)
        out.bodies = self.bodies | {name: f"select * from {view}"}
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in DERIVED:
            raise AttributeError(name)
        return self.sql(self.bodies[name])

    def sql(self, text: str) -> DataFrame:
        """SQL over raw and derived tables; only the files named are read."""
        text = with_tables(text, self.bodies)
        for name in RAW:
            text = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 parquet.`{self.sf_dir}/{name}.parquet`", text, flags=re.I)
        return self.spark.sql(text)


def read_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables (or ``names``) by name, nothing read yet."""
    tables = Tables(spark, sf_dir)
    return {n: getattr(tables, n) for n in names or [*RAW, *DERIVED]}


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 64, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a relational store; with ``partition_column`` (whole numbers) in parallel ranges between its least and greatest value.

    Rows whose column is null come with the first range. The bounds are asked of the store, one row.
    """
    properties = properties or {}
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    column = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(partition_column)
    ends = spark.read.jdbc(url, f"(select min({column}) as low, max({column}) as high from {table}) ends", properties=properties)
    low, high = (None if v is None else int(v) for v in ends.first())
    if low is None or low == high:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=low, upperBound=high + 1, numPartitions=max(1, min(partitions, high + 1 - low)), properties=properties)


#: The relational store's tables, and the column by whose ranges each is read.
STORED = {
    "users": "user_id", "document_types": None, "projects": "project_id", "pages": "page_id", "layout_elements": "page_id", "text_contents": "element_id",
    "ai_descriptions": "element_id", "question_groups": "page_id", "question_elements": "page_id", "text_versions": "page_id", "formatting_rules": None, "combined_results": "project_id",
}


def read_store(spark: SparkSession, url: str, partitions: int = 64, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables of a relational store by name."""
    return {name: read_jdbc(spark, url, name, column, partitions, properties) for name, column in STORED.items()}
