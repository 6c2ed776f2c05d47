"""The corpus pipeline: five stages from documents to encoded texts.

quality rules, line de-duplication, near-duplicate documents, mixing, BPE. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next; all
but the last return the columns of documents. Stages see all rows their predecessor kept.

Null texts and ids, empty tables and repeated rows are treated as each operator's docstring says. A
document whose every line repeats earlier lines has no text left and goes.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm import bpe, linededup, mixing, neardup, quality
from pagespan.llm.shared import dropped, stage_of, written

def staged(stage):
    """``stage``, which first removes what earlier stages wrote for themselves."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_of(docs):
            return stage(spark, docs, sf_dir)

    return run_stage


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their host's verdict reject."""
    out, got = quality.judged(docs.select(*COLUMNS))
    return out.filter(F.col(got["kept"])).select(*COLUMNS)


@staged
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that equal or resemble earlier ones; n_chars is renewed."""
    out, got = linededup.deduplicated(docs.select(*COLUMNS))
    changed = F.col(got["n_exact"]) + F.col(got["n_similar"]) > 0
    out = out.filter(~changed | (F.length("text") > 0))
    size = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", size.alias("n_chars"))


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the smallest id."""
    return neardup.deduplicated(docs.select(*COLUMNS))


@staged
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents with all sources at equal weight, in one global order."""
    out, _ = mixing.mixed(docs.select(*COLUMNS))
    return out.select(*COLUMNS)


@staged
def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every copy."""
    return bpe.token_digests(docs, bpe.vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe_encode", bpe_encode)]

#: The exact similarity join and the tokenizer are beyond SQL; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            if last is not None:
                dropped(last)
            last = docs
    return docs
