"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. The tokens' spans are joined with the sections'
spans, and a token that crosses a boundary goes to the section that holds most of its bytes,
on a tie to the earlier one (``rule='most'``), or to the section of its first byte
(``rule='start'``). Counts of the sections therefore add up to the document's count.

A section is a line with its line end. Defined results: a null or empty text has one empty
section with no token; repeated rows each get their own; a text without line end is one
section; other columns do not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagespan.llm.bpe import read_spec, vocabulary_path
from pagespan.llm.shared import sliced

RULES = ("most", "start")
_loaded: dict = {}


def encoder(spec: bytes, pattern: str):
    """The vocabulary (rank file) and the number of bytes of each token, once a process."""
    import tiktoken

    key = hash((spec, pattern))
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[key]


def sections(data: np.ndarray) -> np.ndarray:
    """Where the sections of a text end, in bytes; at least one."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. Spans are half-open and adjoin, so ends are enough."""
    begin = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(section_ends, begin, "right")
    if rule == "start" or not len(begin):
        return first
    last = np.searchsorted(section_ends, token_ends, "left")
    out = first.copy()
    for k in np.flatnonzero(last > first):
        cuts = np.concatenate([[begin[k]], section_ends[first[k] : last[k]], [token_ends[k]]])
        out[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return out


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "most") -> DataFrame:
    """doc_id, section (from 0), char_start, char_end, n_tokens of every section of every text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoder(spec.value, pattern)
        for part in sliced(batches, "text"):
            ids, rows = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                ends = sections(data)
                tokens = np.asarray(coder.encode_ordinary(text or ""), np.int64)
                n = np.bincount(allocate(np.cumsum(sizes[tokens]), ends, rule), minlength=len(ends)) if len(tokens) else np.zeros(len(ends), np.int64)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                rows.append((np.arange(len(ends)), chars[np.concatenate([[0], ends[:-1]])], chars[ends], n))
                ids += [doc] * len(ends)
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns)], ["doc_id", "section", "char_start", "char_end", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section long, char_start long, char_end long, n_tokens long")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return section_tokens(docs, vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
