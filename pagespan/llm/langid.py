"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte n-grams (SIZES) of its lower-cased letters, words padded with a
blank; each is hashed to one of BUCKETS embeddings, and the text is the average of all of them.
The model is trained here by stochastic gradient descent in numpy, on at most ``TRAIN_ROWS``
labelled documents (smallest hashes of the id, so any partitioning gives the same sample). Their
whole texts enter; executors turn them into averaged features, so the driver holds rows of at
most BUCKETS numbers. A temperature fitted on a part left out of training calibrates the scores;
``rejected`` marks predictions whose calibrated score is below the threshold that had the wanted
precision there.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; with
no labelled document every text is ``und``; repeated rows get equal predictions; very long texts
are scored whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm.shared import in_train, sliced, unit_hash
from pagespan.llm.textbytes import mix, raw

TRAIN_ROWS = 3000
SIZES = (2, 3, 4)
BUCKETS, DIM = 1 << 14, 12
EPOCHS, BATCH, RATE = 8, 32, 0.5
PRECISION = 0.99
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes as features: A-Z lower-cased, letters and bytes above 127 kept, all else a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every text, and the offsets of the texts."""
    data, offsets = raw(texts)
    n = len(texts)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    # a blank before each text keeps subwords within their text
    folded = np.insert(_FOLD[data], offsets, 32)
    ends = offsets + np.arange(n + 1)
    blank = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[ends[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[ends]
    folded = folded[keep]
    code = folded.astype(np.uint64)
    out = np.zeros((len(SIZES), len(folded)), np.int32)
    valid = np.zeros((len(SIZES), len(folded)), bool)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    inner = np.zeros(at[-1], np.int8)  # blanks after the first letter of the subword: at its end only
    blank = folded[: at[-1]] == 32
    gram = np.zeros(at[-1], np.uint64)
    for k in range(max(SIZES)):
        step = code[k : at[-1]]
        gram[: len(step)] = gram[: len(step)] << np.uint64(8) | step
        if k >= 2:
            inner[: len(step)] += blank[k - 1 : at[-1] - 1]
        if k + 1 in SIZES:
            row = SIZES.index(k + 1)
            out[row, : at[-1]] = (mix(gram, k) >> np.uint64(50)).astype(np.int32)
            valid[row, : at[-1]] = (left > k) & (inner == 0)
    flat = out.T.ravel()
    ok = valid.T.ravel()
    first = np.concatenate([[0], np.cumsum(ok)])[at * len(SIZES)]
    return flat[ok], first


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the averaged features (bucket, share) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            flat, first = subwords(part.column("text"))
            ids, shares = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                at, n = np.unique(flat[a:b], return_counts=True)
                ids.append(at.astype(np.int32))
                shares.append((n / max(1, b - a)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["doc_id", "lang", "at", "share"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at array<int>, share array<float>")


class Model:
    """Embeddings folded with the softmax's weights: one row of class scores a bucket."""

    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.scores, self.bias, self.temperature, self.threshold = langs, scores, bias, temperature, threshold

    def logits(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(first) - 1, len(self.langs)))
        some = np.diff(first) > 0
        for k in range(len(self.langs)):
            if len(flat):
                sums[some, k] = np.add.reduceat(self.scores[:, k][flat], first[:-1][some], dtype=np.float64)
        return sums / np.maximum(np.diff(first), 1)[:, None] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS, seed: int = 8) -> Model:
    """Fit on at most ``rows`` documents of those that ``learn`` allows and that have a language."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", unit_hash(seed, F.col("doc_id")))
    # rows, not ids, are drawn, of equal ones one: an id of very many rows adds no more than its different texts
    most = known.select("h", "doc_id").orderBy("h", "doc_id").limit(rows).agg(F.max("h")).first()[0]
    sample = known.filter(F.col("h") <= F.lit(most)).dropDuplicates(["doc_id", "lang", "text"]).orderBy("h", "doc_id", "text").limit(rows).drop("h")
    got = sorted(_features(sample).collect(), key=lambda r: (r["doc_id"], r["lang"], len(r["at"])))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    y = np.array([langs.index(r["lang"]) for r in got])
    x = [(np.array(r["at"], np.int64), np.array(r["share"], np.float32)) for r in got]
    order = rng.permutation(len(x))
    held, order = (order[: len(x) // 8], order[len(x) // 8 :]) if len(x) >= 80 else (order, order)
    freq = np.bincount(y[order], minlength=len(langs)).astype(np.float32)
    balance = len(order) / np.maximum(freq, 1) / len(langs)
    steps = EPOCHS * (len(order) // BATCH + 1)
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            rows_ = order[at : at + BATCH]
            rate = RATE * (1 - step / steps) + 0.01
            h = np.stack([(emb[x[r][0]] * x[r][1][:, None]).sum(0) for r in rows_])
            g = _softmax(h @ out + bias)
            g[np.arange(len(rows_)), y[rows_]] -= 1
            g *= balance[y[rows_]][:, None]
            back = g @ out.T
            out -= rate * h.T @ g
            bias -= rate * 0.1 * g.mean(0)
            for k, r in enumerate(rows_):
                emb[x[r][0]] -= (rate * 8) * x[r][1][:, None] * back[k]
            step += 1
    scores = emb @ out
    z = np.stack([(scores[x[r][0]] * x[r][1][:, None]).sum(0) for r in held]) + bias
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    top, right = p.max(1), p.argmax(1) == y[held]
    by = np.argsort(-top)
    precise = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= PRECISION)
    threshold = float(top[by][precise[-1]]) if len(precise) else 1.0
    return Model(langs, scores, bias.astype(float), temperature, threshold)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UNKNOWN], object)
        for part in sliced(batches, "text"):
            texts = part.column("text")
            letter = np.array([bool(t is not None and _LETTER.search(t)) for t in texts.to_pylist()], bool)
            if m.langs:
                p = _softmax(m.logits(*subwords(texts)) / m.temperature)
                best, score = np.where(letter, p.argmax(1), len(m.langs)), np.where(letter, p.max(1), 0.0)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            columns = [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(~letter | (score < m.threshold))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose labels may be learnt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    model = train(docs, in_train(F.col("doc_id")))
    return identified(docs, model).select("doc_id", (~in_train(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out"), "lang_pred", "score", "rejected")
