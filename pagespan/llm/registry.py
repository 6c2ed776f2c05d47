"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagespan.llm import ann, bpe, fim, langid, linededup, mixing, neardup, quality, substringdedup, tokencount, toxicity, vectorcodes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op7_mixing": mixing.op7_mixing,
        "op2_warc": warc.op2_warc,
        "op4_ann": ann.op4_ann,
        "op3_neardup": neardup.op3_neardup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_bpe": bpe.op6_bpe,
        "op8_langid": langid.op8_langid,
        "op9_tokens": tokencount.op9_tokens,
        "op10_lines": linededup.op10_lines,
        "op11_codes": vectorcodes.op11_codes,
        "op12_fim": fim.op12_fim,
        "op13_substrings": substringdedup.op13_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": quality.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op11_codes": vectorcodes.ORACLE,
        "op12_fim": fim.ORACLE,
        "op13_substrings": substringdedup.ORACLE,
    }
