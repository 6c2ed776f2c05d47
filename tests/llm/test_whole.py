"""Results are whole: no bucket, source, line or level is left out, whatever its size or place."""

import decimal
import hashlib

import numpy as np
from pyspark.sql import functions as F

from pagespan.llm import linededup, mixing, neardup


def test_every_small_bucket_is_looked_at(spark):
    """Against the exact join, on 14,000 open rows of one partition; buckets straddle multiples of 4096."""
    rnd = np.random.default_rng(3)
    sizes = [2] * 2045 + [10] + [2] * 2200 + rnd.integers(2, neardup.SMALL + 1, 170).tolist()
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    rep = rnd.permutation(len(bucket))
    sketch = rnd.integers(0, 65536, (len(bucket), neardup.REGISTERS), dtype="<u2")
    sketch[:, : neardup.ROWS] = bucket[:, None]
    key = neardup.band_keys(sketch)[:, 0]  # of band 0
    members = spark.createDataFrame([(int(k), int(r), int(r)) for k, r in zip(key, rep)], "key long, rep long, comp long")
    classes = spark.createDataFrame([(int(r), 100, s.tobytes()) for r, s in zip(rep, sketch)], "rep long, n long, sketch binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {(r["u"], r["v"]) for r in neardup._proposed(members, classes, 0.0).collect()}
        x, y = members.toDF("key", "u", "cu"), members.toDF("key", "v", "cv")
        want = {(r["u"], r["v"]) for r in x.join(y, "key").filter(F.col("u") < F.col("v")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(key) > 10_000 and len(want) == sum(n * (n - 1) // 2 for n in sizes)
    assert got == want, len(want - got)


def test_rare_sources_are_mixed_too(spark):
    """Counts of sources with mean rates of 0 to 1,001 are the exact inverse, by decimals."""
    sources = ["hot"] * 2999 + [None] * 3
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")

    def inverse(rate, u):
        with decimal.localcontext(decimal.Context(prec=60, Emin=-10**6)):
            p = c = (-decimal.Decimal(rate)).exp()
            k = 0
            while c <= decimal.Decimal(u):
                k += 1
                p = p * decimal.Decimal(rate) / k
                c += p
            return k

    def check(weights, rates):
        out, _ = mixing.mixed(docs, weights=weights)
        got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k, s in enumerate(sources):
            u = int(hashlib.md5(f"{mixing.SEED}|{k}".encode()).hexdigest()[:8], 16) / 2**32
            assert got.get(k, 0) == inverse(rates[s], u), (k, s)

    check(None, {"hot": 3002 / 2 / 2999, None: 3002 / 2 / 3})
    check({"": 1.0}, {"hot": 0.0, None: 3002 / 3})
    tables = spark.createDataFrame([("x", 60_050.0), ("y", 1e7)], "mix_source string, rate double")
    for r in mixing.poisson_tables(tables).collect():
        for z, c in ((-3, 0.00135), (0, 0.5), (3, 0.99865)):
            assert abs(r["table"][round(r["rate"] + z * r["rate"] ** 0.5) - r["first"]] - c) < 0.003
        assert len(r["table"]) < 25 * r["rate"] ** 0.5 + 200 and r["table"][0] < 2**-40 and r["table"][-1] > 1 - 2**-40


def test_short_lines_go_too(spark):
    """Copies of lines of one to four words, and similar ones: equal sets, four words of five, and a very frequent word."""
    many = "\n".join(f"often w{k} x{k} y{k} z{k}" for k in range(4200))
    rows = [
        (1, "one two\n一二三四五\nalpha beta gamma delta\nred green blue\noften\np q r s t"),
        (2, "one two\n一二三四五\nkept\n \n\t\n"),
        (3, "two  one\nblue red green red\n \nred green\noften often"),
        (4, "delta gamma alpha beta epsilon\np q r s\np q r"),
        (5, many),
    ]
    for percent, want in (
        (80, {1: rows[0][1], 2: "kept\n \n\t\n", 3: " \nred green", 4: "p q r", 5: many}),
        (50, None),
    ):
        got = {(r["d"], r["l"]) for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
        lines = [(d, k, line) for d, t in rows for k, line in enumerate(t.split("\n")) if line.split()]
        few = [x for x in lines if x[0] < 5]
        exact = set()
        for a, (d, k, x) in enumerate(few):
            for _, _, y in few[:a]:
                p, q = set(x.split()), set(y.split())
                if x == y or 100 * len(p & q) >= percent * len(p | q):
                    exact.add((d, k))
        assert {g for g in got if g[0] < 5} == exact, percent
        if want:
            out, _ = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), percent)
            assert {r["doc_id"]: r["text"] for r in out.collect()} == want
