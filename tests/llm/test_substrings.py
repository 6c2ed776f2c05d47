"""op13 against SQL and brute force: passages, copies, loops, borders of buckets, repeated ids and odd rows."""

import collections
import hashlib
import random

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagespan.llm import substringdedup as sd

GAP = b"\x20\x09\x0a\x0b\x0c\x0d"


def test_sql_gives_the_same_rows(spark, sf):
    assert compare.same(sd.op13_substrings(spark, sf), compare.duck(sf), sd.ORACLE) == 200


def plain(rows, width):
    """n_words, kept words of each row, by all windows of all documents."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, ws in words:
        for i in range(len(ws) - width + 1):
            if d is not None:
                gram = tuple(ws[i : i + width])
                least[gram] = min(d, least.get(gram, d))
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - width + 1):
            if d is not None and least[tuple(ws[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(ws), [w for i, w in enumerate(ws) if i not in gone]))
    return out


def check(spark, rows, width, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out, got = sd.deduplicated(df, width, **options)
    have = collections.Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in out.collect())
    want = collections.Counter()
    for (d, t), (_, n, kept) in zip(rows, plain(rows, width), strict=True):
        want[d, t if len(kept) == n else b" ".join(kept).decode(), n, n - len(kept)] += 1
    assert have == want, (list((have - want).items())[:2], list((want - have).items())[:2])
    return sum(c * k[3] for k, c in want.items())


def texts(rng, n, vocabulary, passages):
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            if rng.random() < 0.6 and passages:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randrange(1, 60)]
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


@pytest.mark.parametrize(("width", "vocabulary", "hot"), [(13, 400, False), (13, 2, False), (5, 12, False), (2, 30, False), (13, 400, True), (4, 9, True)])
def test_against_all_windows(spark, monkeypatch, width, vocabulary, hot):
    """Few words make loops and branches everywhere; with ``hot`` every anchor is treated edge by edge."""
    rng = random.Random(width * vocabulary)
    names = [f"w{k}" for k in range(vocabulary)]
    passages = [[rng.choice(names) for _ in range(rng.randrange(10, 90))] for _ in range(5)]
    rows = [*enumerate(texts(rng, 110, names, passages), -20)]
    rows += [(500 + k, rows[k][1]) for k in range(30)] + [(None, rows[3][1]), (7777, None), (7778, ""), (7779, " \n")]
    if hot:
        monkeypatch.setattr(sd, "_busy", lambda docs, width, size: all_anchors(rows, width))
    assert check(spark, rows, width) > 300


def all_anchors(rows, width):
    runs = sd.Runs(pa.array([t for _, t in rows], pa.string()), width, np.zeros(0, np.uint64))
    return np.unique(runs.anchor)


def test_one_word_over_and_over(spark):
    """Loops on one node, runs cut at LONG, Unicode blanks that are no gaps, case that counts."""
    rows = [(1, "a " * 300), (2, "b " + "a " * 40 + "c"), (3, "a " * 12), (4, "A " * 13), (5, "x y " * 14), (6, "x y " * 13), (7, "a " * 3000), (8, "a b " * 50), (9, "z " + "b a " * 30)]
    assert check(spark, rows, 13) > 3000


def test_repeated_ids(spark):
    """Rows of one id are no sources of each other, and each keeps to its own words, whatever the others' places are."""
    p = " ".join(f"p{k}" for k in range(30))
    q = " ".join(f"q{k}" for k in range(30))
    rows = [(2, p), (2, p), (2, q + " " + p), (2, "short"), (3, p + " " + q), (3, p + " " + q), (1, "one " + q)]
    assert check(spark, rows, 13) == 30 + 60 + 60


def test_a_passage_in_most_documents(spark):
    """A hot passage with other words at its borders in each document, over many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        p = " ".join(f"p{k}" for k in range(50))
        rows = [(k, f"s{k} t{k} {p} u{k} v{k}" + f" x{k}" * (k % 20)) for k in range(600)]
        assert check(spark, rows, 13) == 599 * 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_common_passages_stay_whole(spark):
    """However documents are dealt, a passage in all of them is one path but for its borders, where anchors are busy."""
    p = " ".join(f"p{k}" for k in range(80))
    rows = [(k, " ".join(f"s{k}x{i}" for i in range(9)) + f" {p} " + " ".join(f"t{k}x{i}" for i in range(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {n: sd.repeated_spans(df.repartition(n)).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("longest")).agg(F.count(F.lit(1)), F.max("n"), F.min("longest")).first() for n in (1, 50)}
    assert counts[1] == counts[50] and counts[1][0] == 299 and counts[1][2] > 50, counts


def test_paths_and_sources(spark):
    """Spans name their source and path: a passage of 40 words that leaves no branch is one path of one source."""
    p = [f"p{k}" for k in range(40)]
    rows = [(5, " ".join(["a", "b", *p, "c"])), (9, " ".join(["d", *p])), (11, " ".join([*p[10:], "e"]))]
    spans = sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, spans.collect())) == [(9, 1, 40, 5, 2, 2), (11, 0, 30, 5, 12, 2)]


def test_false_spans_are_refused(spark, monkeypatch):
    """With node hashes of a few bits, wrong edges are proposed; digests of the words refuse them."""
    grams = sd._grams
    monkeypatch.setattr(sd, "_grams", lambda words, n: grams(words, n) & np.uint64(0x3) if n == 12 else grams(words, n))
    rng = random.Random(1)
    rows = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for k in range(40)]
    out, _ = sd.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("n_removed > 0").count() == 0 or {r["text"] for r in out.collect()} == {t for _, t in rows}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "t", "a " * 20, 3), (2, "t", "a " * 20, 4)], "doc_id int, n_words string, text string, span_doc int")
    out, got = sd.deduplicated(df)
    assert got == {"n_words": "_n_words", "n_removed": "n_removed"} and out.columns == [*df.columns, "_n_words", "n_removed"]
    assert {(r["doc_id"], r["text"], r["span_doc"], r["n_removed"]) for r in out.collect()} == {(1, "a " * 20, 3, 0), (2, "", 4, 20)}
    assert sd.deduplicated(df.limit(0))[0].count() == 0
    assert sd.deduplicated(df.withColumn("text", F.lit(None).cast("string")))[0].filter("n_removed = 0 and text is null").count() == 2
    with pytest.raises(ValueError, match="two words"):
        sd.repeated_spans(df, 1)


def test_digest_of_kept_words():
    words = [b"a", b"b", b"c", b"d"]
    span = {"start": 1, "n": 2, "digest": hashlib.blake2b(b"b c", digest_size=16).digest()}
    assert sd._cut(words, [span, span | {"start": 2}]) == [b"a", b"d"] and sd._cut(words, None) is words
