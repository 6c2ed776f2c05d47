"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is ``size * weight / (number of its documents)``. Every
document draws its count from the Poisson distribution of that mean, by inverting it at a
uniform number hashed from seed and id; it is exploded by the count, and all copies are put
in one global order by another hash.

Defined results: a null source is a source of its own (named ''); null ids hash as empty; repeated
rows draw the same count, as they have the same id; an empty table gives an empty one; sources
without a target weight get weight 0 (they go), unless no weights are given, when all are equal.
Any rate that follows from the documents and weights is inverted exactly: a source's table spans
all counts whose probability the hash can tell from 0. Only a caller's own ``size`` is refused if
it asks for more than ``MAX_RATE`` copies of a source's documents on average.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagespan.llm.shared import fresh, join_small, unit_hash, written

#: Largest mean of copies that a caller's size may ask for; P(count > MAX_COPIES) is then under 2**-32, which the SQL relies on.
MAX_RATE, MAX_COPIES = 64.0, 128
SEED = 20


def repetition_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, size: float | None = None) -> DataFrame:
    """One row a source: its documents, weight, and target repetition rate.

    ``size`` is the number of documents wanted in all; the input's by default. Weights are a
    caller's short dictionary; without them every source gets the same weight.
    """
    counts = written(docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([*weights.items()], "mix_source string, weight double")
        weighted = counts.join(given, "mix_source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = weighted.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    wanted = float(size if size is not None else total["n"] or 0)
    rates = weighted.withColumn("rate", F.lit(wanted) * F.col("weight") / (F.col("n") * F.lit(float(total["w"] or 1.0))))
    rates = written(rates, "rates")
    if size is not None and (top := rates.agg(F.max("rate")).first()[0] or 0.0) > MAX_RATE:
        raise ValueError(f"a source would be repeated {top:.1f} times on average; at most {MAX_RATE:g} is allowed")
    return rates


def poisson_tables(rates: DataFrame) -> DataFrame:
    """mix_source, rate, first, table: the Poisson distribution function at first, first + 1, .. of every positive rate.

    Counts beyond 12 standard deviations (and 64) have less than exp(-72) of probability on either side,
    the hash's steps are 2**-32. Terms are relative to the largest, so that none underflows.
    """
    width = 12 * F.sqrt("rate") + 64
    ends = rates.filter("rate > 0").select("mix_source", "rate", F.greatest(F.floor(F.col("rate") - width), F.lit(0)).cast("long").alias("first"), F.ceil(F.col("rate") + width).cast("long").alias("last"))
    of = Window.partitionBy("mix_source")
    to = of.orderBy("k")
    terms = ends.select("mix_source", "rate", "first", F.explode(F.sequence("first", "last")).alias("k"))
    terms = terms.withColumn("log", F.sum(F.when(F.col("k") > F.col("first"), F.log(F.col("rate") / F.col("k"))).otherwise(0.0)).over(to))
    terms = terms.withColumn("p", F.exp(F.col("log") - F.max("log").over(of)))
    terms = terms.withColumn("c", F.sum("p").over(to) / F.sum("p").over(of))
    rows = terms.groupBy("mix_source", "rate", "first").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("t"))
    return rows.select("mix_source", "rate", "first", F.col("t.c").alias("table"))


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: dict[str, float] | None = None, size: float | None = None, seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """Copies of documents in global order; also the names of copy number, count and order key."""
    rates = repetition_rates(docs, source, weights, size)
    key, rate, least, table, n, copy, order = fresh(docs, "mix_source", "mix_rate", "mix_first", "mix_table", "n_copies", "copy", "mix_key")
    # the table is computed once a source; a document compares its hash with it
    small = written(poisson_tables(rates).toDF(key, rate, least, table), "poisson")
    u = unit_hash(seed, F.col(doc_id))
    drawn = join_small(docs.withColumn(key, F.coalesce(F.col(source), F.lit(""))), small, key, "inner", size=f"ceil(sum(size(`{table}`)) / {MAX_COPIES})")
    # at 0 the count is 0, as no rate's distribution function is 0 there
    drawn = drawn.withColumn(n, F.when(u > 0, F.col(least).cast("int") + F.size(F.filter(table, lambda c: c <= u))).otherwise(F.lit(0)))
    copies = drawn.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    text = F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(copy).cast("string"))
    out = copies.withColumn(order, F.md5(text)).select(*docs.columns, n, copy, order)
    return out.orderBy(order, F.xxhash64(*docs.columns)), {"n_copies": n, "copy": copy, "mix_key": order}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to equal weights; whole texts travel, and their digest is of what arrived."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out, _ = mixed(docs)
    return out.select("doc_id", "source", "n_copies", "copy", "mix_key", F.md5("text").alias("text_md5"))


ORACLE = f"""
with s as (select coalesce(source, '') as s, count(*) as n from documents group by 1),
t as (select sum(n) as total, count(*) as k from s),
r as (select s, total * 1.0 / (n * cast(k as double)) as rate from s, t),
d as (select doc_id, source, text, coalesce(source, '') as s,
  cast('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) / 4294967296.0 as u from documents),
cdf as (select s, k, sum(exp(-rate) * power(rate, k) / gamma(k + 1)) over (partition by s order by k) as c from r, range(0, {MAX_COPIES + 1}) x(k)),
n as (select doc_id, source, text, count(*) filter (c <= u) as n_copies from (select row_number() over () as i, * from d) d join cdf using (s) group by i, doc_id, source, text)
select doc_id, source, cast(n_copies as int) as n_copies, cast(copy as int) as copy,
  md5('order {SEED}|' || coalesce(cast(doc_id as varchar), '') || '|' || cast(copy as varchar)) as mix_key, md5(text) as text_md5
from (select *, unnest(range(1, n_copies + 1)) as copy from n)
"""
assert math.isfinite(MAX_RATE)
