"""Quality rules on documents, with a verdict on each host.

Each document is measured by rules; a host's failures are pooled, and its failure rate is
shrunk towards all hosts' by a beta prior fitted to them (empirical Bayes, by moments). The
verdict of the host is joined back to its documents:

* ``ok``: a document is kept unless a base rule fails;
* ``suspect`` (shrunk rate >= ``suspect``): it must pass the secondary rules too;
* ``blocked`` (shrunk rate >= ``blocked``): all of the host's documents go.

Defined results: a null or empty text has no words and fails; a document without a host (null
or empty) has verdict ``none`` and is judged by base rules alone; repeated rows count as often as
they occur; an empty table gives an empty one. Other columns of the input stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm.shared import WORD_GAP, fresh, join_small, written

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Secondary rules: characters a word, symbols and repeated lines per 100 words.
MIN_WORD_CHARS, MAX_WORD_CHARS, MAX_SYMBOLS, MAX_DUP_LINES = 2, 15, 10, 5
#: Shrunk failure rates of hosts.
SUSPECT, BLOCKED = 0.5, 0.8
SYMBOLS = "#*$%&|<>"


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, with value computed once (a lambda binds it)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window that occurs twice or more in the text."""

    def covered(grams: Column) -> Column:
        # windows sorted by (hash, place): equal ones are neighbours
        def places(pairs: Column) -> Column:
            marked = F.transform(
                pairs,
                lambda p, i: F.when((F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]), p["i"]),
            )
            return F.array_sort(F.array_compact(marked))

        def cover(at: Column) -> Column:
            return F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
                lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")),
                lambda acc: acc["n"],
            )

        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _bound(_bound(pairs, places), cover)

    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered(grams)).otherwise(F.lit(0))

    grams = _bound(words, lambda w: F.transform(w, lambda x, i: F.when(i >= 2, F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), x))))
    return _bound(F.slice(grams, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), count)


def rule_metrics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the rules' measures; also their column names (fresh on clash)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = dict(zip(names, fresh(docs, *names), strict=True))
    (w,) = fresh(docs.select("*", *[F.lit(0).alias(c) for c in got.values()]), "words")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = docs.withColumn(w, words_of(F.col(text))).select(
        *docs.columns,
        F.size(w).cast("long").alias(got["n_words"]),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias(got["word_chars"]),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias(got["n_symbols"]),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias(got["n_dup_lines"]),
        _repeat_words(F.col(w)).cast("long").alias(got["n_repeat_words"]),
    )
    failed = (F.col(got["n_words"]) < MIN_WORDS) | (100 * F.col(got["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(got["n_words"]))
    return out.withColumn(got["base_failed"], failed), got


def host_verdicts(measured: DataFrame, host: str, failed: str, suspect: float = SUSPECT, blocked: float = BLOCKED) -> DataFrame:
    """One row a host: n, failures, shrunk rate, verdict. The prior's moments are of all hosts."""
    hosts = (
        measured.filter(F.col(host).isNotNull() & (F.col(host) != ""))
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(F.col(failed)).alias("host_failures"))
    )
    hosts = written(hosts, "hosts")
    n, f = F.col("host_docs"), F.col("host_failures")
    # moments of the beta prior: weighted mean, and variance between hosts above the binomial's
    moments = hosts.agg(F.sum("host_docs").alias("docs"), (F.sum(f) / F.sum(n)).alias("mean"), F.count(F.lit(1)).alias("k"), F.sum(f * f / n).alias("squares"))
    between = (F.col("squares") - F.col("docs") * F.col("mean") * F.col("mean") - (F.col("k") - 1) * F.col("mean") * (1 - F.col("mean"))) / F.greatest(F.col("docs") - F.col("k"), F.lit(1))
    spread = F.greatest(between, F.lit(1e-6))
    strength = F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / spread - 1, F.lit(1.0)), F.lit(1e6))
    prior = moments.select("mean", strength.alias("strength")).first()
    mean = F.lit(float(prior["mean"] or 0.0))
    weight = F.lit(float(prior["strength"] or 1.0))
    rate = (f + mean * weight) / (n + weight)
    return hosts.withColumn("host_rate", rate).withColumn("host_verdict", F.when(rate >= blocked, "blocked").when(rate >= suspect, "suspect").otherwise("ok"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Measures, host verdict and ``kept`` of every document; ``carry`` are the input's columns to keep."""
    carry = list(docs.columns) if carry is None else carry
    measured, got = rule_metrics(docs.select(*dict.fromkeys([*carry, host, text])), text)
    measured = measured.select(*dict.fromkeys([*carry, host]), *got.values())
    measured = written(measured, "measured")
    verdicts = host_verdicts(measured, host, got["base_failed"])
    key, docs_n, fails, rate, verdict, kept = fresh(measured, "host", "host_docs", "host_failures", "host_rate", "host_verdict", "kept")
    verdicts = written(verdicts.toDF(key, docs_n, fails, rate, verdict), "verdicts")
    got |= {"host_rate": rate, "host_verdict": verdict, "kept": kept}
    joined = join_small(measured.withColumn(key, F.col(host)), verdicts, key)
    n = F.col(got["n_words"])
    secondary = (
        (F.col(got["word_chars"]) < MIN_WORD_CHARS * n)
        | (F.col(got["word_chars"]) > MAX_WORD_CHARS * n)
        | (100 * F.col(got["n_symbols"]) > MAX_SYMBOLS * n)
        | (100 * F.col(got["n_dup_lines"]) > MAX_DUP_LINES * n)
    )
    state = F.coalesce(F.col(verdict), F.lit("none"))
    out = joined.select(
        *dict.fromkeys([*carry, host]),
        *[F.col(c) for k, c in got.items() if k not in ("host_rate", "host_verdict", "kept")],
        F.col(rate),
        state.alias(verdict),
        (~F.col(got["base_failed"]) & (state != "blocked") & ~((state == "suspect") & secondary)).alias(kept),
    )
    return out, got


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' measures and the verdict on every document; hosts are the sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out, _ = judged(docs, carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("host_verdict"), F.round("host_rate", 9).alias("host_rate"))


ORACLE = """
with w as (
  select doc_id, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from documents
), g as (
  select doc_id, source, t, ws, ls, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) as gs from w
), e as (
  select row_number() over () as r, * from g
), x as (
  select r, unnest(gs) as gram, unnest(range(1, len(gs) + 1)) as i from e
), dup as (
  select r, i from (select r, i, count(*) over (partition by r, gram) as c from x) where c > 1
), rep as (
  select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from dup) group by r
), m as (
  select doc_id, source, len(ws) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words
  from e left join rep using (r)
), b as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m
), h as (
  select source, count(*) as n, count(*) filter (base_failed) as f from b where source <> '' group by source
), a as (
  select sum(n) as docs, sum(f) / sum(n) as mean, count(*) as k, sum(f * f / n) as squares from h
), p as (
  select mean, least(greatest(mean * (1 - mean) / greatest((squares - docs * mean * mean - (k - 1) * mean * (1 - mean)) / greatest(docs - k, 1), 1e-6) - 1, 1.0), 1e6) as weight from a
), v as (
  select source, (f + mean * weight) / (n + weight) as rate from h, p
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  (not base_failed and coalesce(rate, 0) < 0.8 and not (coalesce(rate, 0) >= 0.5 and (word_chars < 2 * n_words or word_chars > 15 * n_words
    or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 5 * n_words))) as kept,
  case when rate is null then 'none' when rate >= 0.8 then 'blocked' when rate >= 0.5 then 'suspect' else 'ok' end as host_verdict,
  round(rate, 9) as host_rate
from b left join v using (source)
"""
