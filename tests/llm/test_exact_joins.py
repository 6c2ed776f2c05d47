"""Similarity joins against brute force: near-duplicate documents and lines."""

import re

import numpy as np
import pytest

from pagespan.llm import linededup, neardup


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, min(len(w), 1))))


def smallest_reachable(ids, links):
    at = {i: i for i in ids}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {i: find(i) for i in ids}


def exact_components(rows, width, percent):
    """id -> smallest id reachable, by an inverted index over all shingles."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links = []
    for k, (i, s) in enumerate(sets):
        common = {}
        for x in s:
            for o in holders[x]:
                if o < k:
                    common[o] = common.get(o, 0) + 1
        links += [(i, sets[o][0]) for o, c in common.items() if 100 * c >= percent * (len(s) + len(sets[o][1]) - c)]
        links += [(i, j) for j, _ in sets[:k] if i == j]
    return smallest_reachable({i for i, _ in sets}, links)


@pytest.mark.parametrize("width", [2, 5])
def test_documents_of_a_table(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = exact_components(rows, width, 80)
    got = neardup.near_duplicates(docs, width).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    size = {i: len(shingles(t, width)) for i, t in rows}
    assert all(r["n_shingles"] == size[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_groups_and_ids_with_several_texts(spark):
    """A group of 700 near copies whose links hang by chains, pairs at the threshold, and ids that have two texts."""
    rnd = np.random.default_rng(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(700):
        w = base.copy()
        for p in rnd.choice(60, rnd.integers(0, 9), replace=False):
            w[p] = f"x{rnd.integers(0, 40)}"
        rows.append((int(1000 + k), " ".join(w)))
    rows += [(5, "a b c d e f"), (5, " ".join(f"z{k}" for k in range(30))), (9, " ".join(f"z{k}" for k in range(30))), (3, "A b C d e f"), (4, "only one"), (6, None), (7, " \t"), (8, "only  one")]
    rows += [(k, " ".join(f"q{j}" for j in range(m))) for k, m in ((20, 9), (21, 11), (22, 12), (23, 20))]
    order = rnd.permutation(len(rows))
    rows = [rows[k] for k in order]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, 2).collect()
    want = exact_components(rows, 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert want[9] == want[5] == 3 and want[8] == 4 and want[21] == 20


def exact_lines(rows, percent):
    """(id, line number) of lines with an earlier equal or similar one, by an inverted index."""
    lines = sorted((i, k, frozenset(w for w in re.split("[\x20\x09-\x0d]+", line) if w)) for i, t in {(i, t) for i, t in rows if i is not None} for k, line in enumerate((t or "").split("\n")))
    seen, holders, gone = [], {}, set()
    at = {}
    for i, k, s in lines:
        if not s:
            continue
        if s in at:
            gone.add((i, k))
            continue
        common = {}
        for w in s:
            for o in holders.get(w, ()):
                common[o] = common.get(o, 0) + 1
        if any(100 * c >= percent * (len(s) + len(seen[o]) - c) for o, c in common.items()):
            gone.add((i, k))
        at[s] = len(seen)
        for w in s:
            holders.setdefault(w, []).append(len(seen))
        seen.append(s)
    return gone


def test_lines_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {(r["d"], r["l"]) for r in linededup.removed_lines(docs).collect()}
    want = exact_lines(rows, 80)
    assert got == want, (len(got - want), len(want - got))


@pytest.mark.parametrize("percent", [50, 80])
def test_frequent_words_long_lines_and_heavy_keys(spark, monkeypatch, percent):
    """Lines of frequent words only, on both sides of the length from which these are single keys; keys joined in blocks."""
    monkeypatch.setattr(linededup, "FREQUENT", 8)
    monkeypatch.setattr(linededup, "LONG", 24)
    monkeypatch.setattr(linededup, "HEAVY", 20)
    monkeypatch.setattr(linededup, "BLOCK", 7)
    rnd = np.random.default_rng(5)
    rows = []
    for k in range(60):
        lines = []
        for _ in range(5):
            n = int(rnd.integers(1, 44))
            lines.append(" ".join(f"c{w}" for w in rnd.choice(46, n, replace=False)))
        near = lines[0].split()
        near[0] = f"u{k}"
        rows.append((k, "\n".join([*lines, " ".join(near), "\t", "a\tb  c"])))
    got = {(r["d"], r["l"]) for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    want = exact_lines(rows, percent)
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])


def test_a_document_of_very_many_lines(spark):
    """Removing is linear in a document's lines; a line of 60,000 words is a line like others."""
    many = "\n".join(f"line number {k} of this document {k * 7}" for k in range(30_000))
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, many), (2, many), (3, long), (4, long + " more")]
    out, got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["text"] == many and by[2]["text"] == "" and by[2][got["n_exact"]] == 30_000
    assert by[3]["text"] == long and by[4]["text"] == "" and by[4][got["n_similar"]] == 1
