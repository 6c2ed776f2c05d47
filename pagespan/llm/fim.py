"""Fill-in-middle transformation, with cuts found by a wavelet matrix over character classes.

Every code point has one of four classes. The classes of all texts of a slice are one wavelet matrix of two bit
vectors; a rank query gives how often a class stands before a place. The ends of units (lines, words or
characters) are the places of some of the classes, so their number before a place is a sum of ranks. The
number of units of a text and the places of both cuts come from these counts alone, the cuts by bisection on
them, for all texts of a slice at once.

A text becomes prefix, middle and suffix: cuts after two hash-drawn numbers of units. The form is drawn from
hashes of the id too: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain`` (unchanged).

Defined results: a null text is an empty one; empty texts and texts that contain a marker stay plain; a null id is
hashed as an empty one; repeated rows each get their row; very long texts are cut like others (a slice of their own);
columns of the input pass through, and new names are made fresh on a clash; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagespan.llm.shared import fresh, sliced

SEED = 7
#: Of 100 texts with hashes alike, so many are transformed; of 100 such, so many have the suffix first.
RATE, SPM_RATE = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of code points: within words or others, line feeds, last of a word, other white space.
INNER, FEED, WORD_END, WHITE = range(4)
#: The classes that end a unit; what follows the last end is a unit too.
UNITS = {"line": (FEED,), "word": (WORD_END,), "char": (INNER, FEED, WORD_END, WHITE)}


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, on: np.ndarray):
        words = np.zeros(len(on) // 64 + 1, "<u8")
        packed = np.packbits(on, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Symbols of ``bits`` bits: a bit vector for each bit, high ones first, each in the order that the bits above left."""

    def __init__(self, symbols: np.ndarray, bits: int = 2):
        self.levels = []
        for b in reversed(range(bits)):
            on = (symbols >> b & 1).astype(bool)
            symbols = np.concatenate([symbols[~on], symbols[on]])
            self.levels.append((b, Bits(on), int(len(on) - on.sum())))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        first, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for b, bits, zeros in self.levels:
            if symbol >> b & 1:
                first, at = zeros + bits.rank(first), zeros + bits.rank(at)
            else:
                first, at = first - bits.rank(first), at - bits.rank(at)
        return at - first


def classes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point of texts that end at ``ends``."""
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    closed = np.ones(len(codes), bool)  # a word cannot go on: white space or another text follows
    closed[:-1] = white[1:]
    closed[ends[ends > 0] - 1] = True
    out = np.where(white, WHITE, np.where(closed, WORD_END, INNER)).astype(np.uint8)
    out[codes == 10] = FEED
    return out


class Cutter:
    """Units of many texts at once."""

    def __init__(self, texts: list[str], unit: str):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.start = np.concatenate([np.zeros(1, np.int64), self.stop[:-1]])
        self.ending = UNITS[unit]
        self.matrix = WaveletMatrix(classes(codes, self.stop))
        self.base = self.ended(self.start)
        whole = self.ended(self.stop) - self.base
        last = self.ended(np.maximum(self.stop - 1, self.start)) - self.base
        self.n = whole + ((self.stop > self.start) & (whole == last))  # the last code point ends no unit: one more

    def ended(self, at: np.ndarray) -> np.ndarray:
        """How many units end before each place."""
        return sum(self.matrix.rank(c, at) for c in self.ending)

    def after(self, units: np.ndarray) -> np.ndarray:
        """Where each text's first ``units`` units end, from the text's start: the least place that has so many ends before it."""
        low, high = self.start.copy(), self.stop.copy()
        while (open_ := low < high).any():
            middle = low + high >> 1
            enough = self.ended(middle) - self.base >= units
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low - self.start


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def restore(output: str, form: str) -> str:
    """The text that ``output`` of ``form`` was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(MIDDLE)
    return a + middle + b if form == "psm" else b + middle + a


def transform(ids: list, texts: list[str], unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> list[tuple]:
    """n, form, output, prefix_chars and middle_chars of each text."""
    cutter = Cutter(texts, unit)
    drawn = np.array([draws(seed, i) for i in ids], np.int64).reshape(-1, 4)
    u, v = drawn[:, 0] % (cutter.n + 1), drawn[:, 1] % (cutter.n + 1)
    one, two = cutter.after(np.minimum(u, v)).tolist(), cutter.after(np.maximum(u, v)).tolist()
    out = []
    for text, n, a, b, h in zip(texts, cutter.n.tolist(), one, two, drawn.tolist(), strict=True):
        if not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
            out.append((n, "plain", text, None, None))
            continue
        form = "spm" if h[3] % 100 < spm_rate else "psm"
        head, tail = PREFIX + text[:a], SUFFIX + text[b:]
        out.append((n, form, (tail + head if form == "spm" else head + tail) + MIDDLE + text[a:b], a, b - a))
    return out


_NEW = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]


def _map(docs: DataFrame, doc_id: str, text: str, more: list, form, **options) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns of _NEW and those that ``form`` makes of output and form; their names by meaning."""
    new = [*_NEW, *more]
    names = fresh(docs, *[n for n, _ in new])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, (_, t) in zip(names, new, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text):
            made = transform(part.column(doc_id).to_pylist(), [t or "" for t in part.column(text).to_pylist()], **options)
            n, kind, output, a, b = zip(*made, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(kind, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns, *form(output, kind)], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema), dict(zip([n for n, _ in new], names, strict=True))


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n, form, prefix_chars, middle_chars and output, and the names of these columns.

    Options: ``unit`` (line, word or char), ``rate`` and ``spm_rate`` of 100, ``seed``.
    """
    return _map(docs, doc_id, text, [("output", T.StringType())], lambda output, _: [pa.array(output, pa.string())], **options)


def restored(docs: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> tuple[DataFrame, str]:
    """``docs`` with the texts that their outputs were made of, and that column's name; null outputs give null."""
    (name,) = fresh(docs, text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, output):
            pairs = zip(part.column(output).to_pylist(), part.column(form).to_pylist(), strict=True)
            back = [None if o is None else restore(o, f or "plain") for o, f in pairs]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.string())], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema), name


def _sha256(texts) -> pa.Array:
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of output and rebuilt text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digests = [("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]
    out, _ = _map(docs, "doc_id", "text", digests, lambda output, kind: [_sha256(output), _sha256(map(restore, output, kind))], unit="line")
    return out.drop("text")


#: DuckDB's rows for op12_fim. Texts are cut at line feeds and joined again; what is rebuilt is the text itself.
ORACLE = f"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents
), u as (
  select doc_id, t, string_split(t, chr(10)) as lines,
    len(string_split(t, chr(10))) - if(t = '' or ends_with(t, chr(10)), 1, 0) as n,
    ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
    ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4
  from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as i, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as j from u
), p as (
  select *,
    array_to_string(lines[1:i], chr(10)) || if(i > 0 and i < len(lines), chr(10), '') as a,
    array_to_string(lines[i + 1:j], chr(10)) || if(j > i and j < len(lines), chr(10), '') as m,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain'
      when h4 % 100 < {SPM_RATE} then 'spm' else 'psm' end as form
  from c
), o as (
  select *, substr(t, length(a) + length(m) + 1) as s from p
)
select doc_id, n::bigint as n, form,
  if(form = 'plain', null, length(a))::bigint as prefix_chars, if(form = 'plain', null, length(m))::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || a || '{SUFFIX}' || s || '{MIDDLE}' || m
    else '{SUFFIX}' || s || '{PREFIX}' || a || '{MIDDLE}' || m end) as output_sha256,
  sha256(if(form = 'plain', t, a || m || s)) as restored_sha256
from o
"""
