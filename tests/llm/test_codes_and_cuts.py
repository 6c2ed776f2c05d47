"""op11 and op12 against SQL, brute force and exact round trips, and on odd input."""

import hashlib
import re

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespan.llm import fim, vectorcodes


def test_sql_gives_the_same_rows(spark, sf):
    con = compare.duck(sf)
    assert compare.same(fim.op12_fim(spark, sf), con, fim.ORACLE)
    assert compare.same(vectorcodes.op11_codes(spark, sf), con, vectorcodes.ORACLE)


def plain_codes(x, parts, entries, rounds):
    """Codes, errors and codebooks by comparing everything with everything."""
    edges = [x.shape[1] * p // parts for p in range(parts + 1)]
    codes, error, books = [], np.zeros(len(x), np.int64), []
    for a, b in zip(edges, edges[1:]):
        part, c = x[:, a:b], x[:entries, a:b].copy()
        for r in range(rounds + 1):
            d = ((part[:, None] - c) ** 2).sum(2)
            near = d.argmin(1)
            for e in range(len(c)):
                if r < rounds and (near == e).any():
                    c[e] = part[near == e].sum(0) // (near == e).sum()
        codes.append(near)
        error += d.min(1)
        books.append(c)
    return np.stack(codes, 1), error, books


@pytest.mark.parametrize(("n", "size", "entries", "rounds", "spread"), [(900, 8, 40, 6, 3.0), (300, 10, 256, 4, 0.01), (30, 3, 64, 3, 1.0), (700, 8, 16, 9, 20_000.0)])
def test_codes_are_exact(spark, n, size, entries, rounds, spread):
    """Clusters, ties of coarse vectors, parts of unequal length and none, fewer vectors than entries, large components; a third of all rows equal."""
    rnd = np.random.default_rng(n)
    x = rnd.normal(size=(12, size))[rnd.integers(12, size=n)] * spread + rnd.normal(size=(n, size)) * spread / 5
    x[: n // 3] = x[0]
    x = np.round(x, 3)
    rows = [(i, v.tolist(), f"t{i % 3}") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string").repartition(5)
    out, got, books = vectorcodes.compressed(df, parts=4, entries=entries, rounds=rounds)
    ints = np.floor(1024 * x).astype(np.int64)
    codes, error, want = plain_codes(ints, 4, entries, rounds)
    assert all(map(np.array_equal, books.entries, want))
    found = {r["vec_id"]: r for r in vectorcodes.decoded(out, books, got["code"])[0].collect()}
    assert len(found) == n and got["code"] == "_code"
    for i in range(n):
        r = found[i]
        assert list(r["_code"]) == codes[i].tolist() and r["error"] == error[i] and r["code"] == f"t{i % 3}"
        assert ((np.array(r["decoded"]) * 1024 - ints[i]) ** 2).sum() == error[i]


def test_bounds_never_hide_the_nearest():
    """Entries that move far, little or not at all; what the bounds say is held to all distances."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-500, 500, (400, 6))
    entries = x[:50].copy()
    near, bounds = vectorcodes.nearest(x, entries, 8)
    spared = 0
    for step in (0, 3, 60, 1, 1, 0, 900, 2):
        new = entries + rnd.integers(-step, step + 1, entries.shape) * (rnd.random((50, 1)) < 0.6)
        moves = np.sqrt(((new - entries) ** 2).sum(1)) * (1 + 2**-20)
        near, bounds, need = vectorcodes.reassign(x, new, moves, near, vectorcodes._loaded(vectorcodes._stored(bounds)))
        entries = new
        d = ((x[:, None] - entries) ** 2).sum(2)
        assert np.array_equal(near[:, 0], d.argmin(1))
        assert np.array_equal(np.sort(near, 1)[:, 1:] == np.sort(near, 1)[:, :-1], np.zeros((400, 7), bool))
        spared += (need < 50).sum()
    assert spared > 1500


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25, 1.0, 2.0]
    rows = [(1, good, 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [nan, 1.0, 1.0, 1.0], None), (5, [inf, 0.0, 0.0, 0.0], 2), (6, [1.0], 2), (7, [], 2), (1, good, None), (None, good, None), (8, [1e300, -1e300, 0.0, -0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, got, books = vectorcodes.compressed(df)
    rows = out.collect()
    assert sorted(str(r["vec_id"]) for r in rows) == ["1", "1", "8", "None"] and {r["error"] for r in rows} == {0}
    assert len(books.entries[0]) == 4 and {bytes(r["code"]) for r in rows if r["vec_id"] != 8} == {b"\0\0\0\0"}
    out, _, books = vectorcodes.compressed(df.filter("vec_id = 2"))
    assert out.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest() and out.columns == ["vec_id", "label", "code", "error"]
    with pytest.raises(ValueError, match="one byte"):
        vectorcodes.compressed(df, entries=300)


def plain_units(text, unit):
    return re.findall({"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z", "char": r"(?s)."}[unit], text)


def test_wavelet_matrix():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rnd.integers(0, 4, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        at = np.arange(n + 1)
        for c in range(4):
            assert matrix.rank(c, at).tolist() == [int((symbols[:k] == c).sum()) for k in at]


TEXTS = ["", "\n", "\n\n", "a", "a\n", "a\nb", " ", " \n ", "x  y\tz\n", "ü🤦🏼‍♂️ z\r\nq\x0b", "no end of line", "l\n" * 3000 + "end", "a<P>b\nc", "<M", "<\n<", "w " * 70]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_cuts_and_round_trip(spark, unit):
    """Every text under many ids, with nulls, repeated rows and a column named like a new one."""
    rows = [(k, t, "mine") for k, t in enumerate(TEXTS * 9)] + [(3, "a", "mine"), (None, "a\nb\n", "mine"), (7, None, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    out, got = fim.transformed(df, unit=unit)
    assert got["form"] == "_form"
    back, name = fim.restored(out, got["output"], got["form"])
    seen = set()
    for r in back.collect():
        text, h = r["text"] or "", [int(hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
        units = plain_units(text, unit)
        assert "".join(units) == text and r["n"] == len(units), (text, unit)
        i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        a, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>"))
        form = "plain" if plain else "spm" if h[3] % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{a}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{a}<M>{m}"}[form]
        assert (r["_form"], r["output"], r[name], r["form"]) == (form, want, text, "mine")
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if plain else (len(a), len(m)))
        seen.add(form)
    assert seen == {"plain", "psm", "spm"} and back.count() == len(rows)
    assert fim.transformed(df, rate=0)[0].filter(F.col("_form") != "plain").count() == 0
    assert fim.transformed(df.limit(0))[0].count() == 0
