"""Substring de-duplication over a compacted De Bruijn graph of words.

Every ``width`` consecutive words of a document are an edge, from the node of its first to the node of its last
``width - 1`` words. An edge is repeated when documents of different ids have it; its source is its first place in the
smallest of these ids. Words that an edge covers go where its source is a smaller id than the document's.

* Nodes go to buckets by their anchor, the ANCHOR words in them with the smallest hash. Neighbours mostly share it, so a
  document is a sequence of short runs of nodes, and a run with the nodes beside it is one record. Equal records of a slice
  of documents are one, with the smallest and largest id, so that a passage in very many documents is few records.
* A bucket has all edges at its nodes: it finds the repeated ones, their sources and the nodes between just two of them
  whose sources follow each other. Such non-branching nodes join edges to pieces of paths.
* Pieces of two buckets overlap by one edge: a join of first and last edges links them, and pieces are numbered along the
  links in their source's order. This compacts the graph into paths.
* Runs of documents meet the repeated edges of equal runs in a join (Spark splits its skewed partitions), and what follows on one
  path becomes one span: document, place, length, source and the place there.
* Spans are verified on the words: digests of the named words of the source and of the document must be equal.

Anchors with very many different records (around the borders of very common passages) are looked for in a bounded sample of
documents; their nodes are treated edge by edge, dealt by the edge, and join no paths. What the sample misses only
makes a bucket longer. Hashes propose; nodes have 47 bits within their bucket and 31 more with each edge.

Defined results: null texts have no words; documents of fewer than ``width`` words, and those with a null id, are left alone
and are no source; repeated rows of an id each get their row and are never sources of each other; very long texts
are texts like others; an empty table gives an empty one. Columns of the input pass through, new names are made fresh on a clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespan.llm import textbytes
from pagespan.llm.shared import dropped, fresh, sliced, written

WIDTH = 13
#: Words of an anchor, and nodes of a run at most.
ANCHOR, LONG = 4, 64
#: Bytes of text to a bucket, and to a slice that a task looks at at once.
BUCKET, SLICE = 4 << 20, 4 << 20
#: Bytes of the documents in which anchors with many records are looked for; one in so many records makes an anchor such.
SAMPLE, SHARE = 24 << 20, 5000
_FAR = np.int64(1 << 40)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textbytes.mix(a * np.uint64(0xD1342543DE82EF95) + b)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, by blocks of 1, 2, 4 ... words."""
    out, done, block, size = None, 0, words, 1
    while True:
        if n & size:
            out = block if out is None else _pair(out[: len(out) - size], block[done:]) if len(out) > size else out[:0]
            done += size
        if size * 2 > n:
            return out
        block = _pair(block[:-size], block[size:]) if len(block) > size else block[:0]
        size *= 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        size += step
    return x


class Runs:
    """The runs of nodes of some texts: owner (the text's number), start (its first word), n, and what stands beside it.

    ``high`` and ``low`` are 31 and 16 bits of the nodes of all runs; ``before`` and ``after`` the high bits of the nodes
    beside a run, 0 where there is none.
    """

    def __init__(self, texts: pa.Array, width: int, hot: np.ndarray):
        words, first = textbytes.word_hashes(texts, fold=False)
        n, size = np.diff(first), width - 1
        count = np.where(n >= width, n - size + 1, 0)
        owner = np.repeat(np.arange(len(n)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = place + first[:-1][owner]
        m = min(ANCHOR, size)
        node, anchor = _grams(words, size)[at], _least(textbytes.mix(_grams(words, m), 3), size - m + 1)[at]
        alone = np.isin(anchor, hot) if len(hot) else np.zeros(len(node), bool)
        new = np.ones(len(node), bool)
        new[1:] = (place[1:] == 0) | (anchor[1:] != anchor[:-1]) | alone[1:]
        start = np.flatnonzero(new)
        within = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
        start = np.flatnonzero(within % LONG == 0)
        self.n = np.diff(np.append(start, len(node)))
        last = start + self.n - 1
        self.high, self.low = (node >> np.uint64(32)).astype("<u4") | np.uint32(1), (node >> np.uint64(16)).astype("<u2")
        beside = np.append(self.high, np.uint32(0))
        self.before = np.where((place[start] > 0) & ~alone[start], beside[start - 1], 0).astype("<u4")
        self.after = np.where(place[last] + 1 < count[owner[last]], beside[last + 1], 0).astype("<u4")
        self.owner, self.start, self.first, self.anchor = owner[start], place[start].astype("<u4"), start, anchor[start]
        self.keys = keys(self.high, self.low, start, self.n, self.before, self.after)
        self.deal = np.where(alone[start], self.keys[0], textbytes.mix(self.anchor, 5))

    def rows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """high and low of the nodes of some runs, in their order."""
        n = self.n[pick]
        at = np.arange(n.sum()) + np.repeat(self.first[pick] - (np.cumsum(n) - n), n)
        return self.high[at], self.low[at]


def keys(high: np.ndarray, low: np.ndarray, first: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of each run and what stands beside it."""
    if not len(n):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    place = (np.arange(len(high)) - np.repeat(first, n)).astype(np.uint64)
    x = textbytes.mix((high.astype(np.uint64) << np.uint64(16) | low) + (place << np.uint64(50)))
    one, two = np.add.reduceat(x, first), np.add.reduceat((x >> np.uint64(32)) * (x & np.uint64(0xFFFFFFFF)), first)
    beside = before.astype(np.uint64) << np.uint64(32) | after
    k = _pair(one + n.astype(np.uint64), beside)
    return k, (_pair(two, beside) >> np.uint64(32)).astype("<u4").view("<i4")


def _groups(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows follow each other, and where each group of them begins. The last array is sorted first, and mostly decides."""
    order = np.argsort(by[-1])
    new = np.ones(len(order), bool)
    new[1:] = by[-1][order[1:]] != by[-1][order[:-1]]
    if any((~new[1:] & (b[order[1:]] != b[order[:-1]])).any() for b in by[:-1]):
        order = np.lexsort(by)
        new[1:] = np.any([b[order[1:]] != b[order[:-1]] for b in by], axis=0)
    return order, np.flatnonzero(new)


_RECORD = [("n", "u1"), ("before", "<u4"), ("after", "<u4"), ("least", "<i8"), ("more", "<i8"), ("start", "<u4"), ("high", "<u4"), ("low", "<u2")]


def _records(docs: DataFrame, width: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Different runs of each slice of (doc_id, text): a row for each bucket of it, with arrays as binaries."""
    names = ["bucket", *[c for c, _ in _RECORD]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", SLICE):
            runs = Runs(part.column("text"), width, hot)
            if not len(runs.n):
                continue
            doc = part.column("doc_id").to_numpy()[runs.owner]
            useful = np.flatnonzero((runs.n > 1) | (runs.before > 0) | (runs.after > 0))
            order, first = _groups(runs.keys[1][useful], runs.keys[0][useful])
            order = useful[order]
            least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            size = np.diff(np.append(first, len(order)))
            start = np.minimum.reduceat(np.where(doc[order] == np.repeat(least, size), runs.start[order], _FAR), first)
            pick = order[first]
            bucket = (runs.deal[pick] % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((start, least, bucket))
            pick, bucket, least, more, start = pick[by], bucket[by], least[by], (most - least)[by], start[by].astype("<u4")
            high, low = runs.rows(pick)
            n, before, after = runs.n[pick], runs.before[pick], runs.after[pick]
            found, at = np.unique(bucket, return_index=True)
            at = np.append(at, len(bucket))
            nodes = np.append(0, np.cumsum(n))[at]
            whole = (n.astype("u1"), before, after, least.astype("<i8"), more.astype("<i8"), start, high, low)
            cut = [[a[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)] for a, ends in zip(whole, [at] * 6 + [nodes] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array(c, pa.binary()) for c in cut]], names)

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))


class _Edges:
    """The edges from (or to) nodes of a bucket: for each node of a record whether the edge is repeated, and its source."""

    def __init__(self, node: np.ndarray, other: np.ndarray, least: np.ndarray, most: np.ndarray, place: np.ndarray):
        has = np.flatnonzero(other)
        order, first = _groups(other[has], node[has], _pair(node[has], other[has].astype(np.uint64)))
        order = has[order]
        self.repeated = np.zeros(len(node), bool)
        self.doc, self.place = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        if not len(has):
            self.nodes, self.of = node[:0], first
            return
        doc = np.minimum.reduceat(least[order], first)
        twice = doc != np.maximum.reduceat(most[order], first)
        size = np.diff(np.append(first, len(order)))
        at = np.minimum.reduceat(np.where(least[order] == np.repeat(doc, size), place[order], _FAR), first)
        self.repeated[order] = np.repeat(twice, size)
        self.doc[order], self.place[order] = np.repeat(doc, size), np.repeat(at, size)
        heads = order[first[twice]]
        kept = np.argsort(node[heads], kind="stable")
        heads = heads[kept]
        single = np.ones(len(heads), bool)  # the only repeated edge of its node
        same = node[heads[1:]] == node[heads[:-1]]
        single[1:] &= ~same
        single[:-1] &= ~same
        self.nodes, self.of = node[heads[single]], heads[single]


_SOLVED = "k long, c int, off int, n int, d long, p int, a int"


def _solved(table: pa.Table) -> pa.Table:
    """A bucket's pieces of paths (k is null: edges p to p + n - 1 of document d), and its records' repeated edges: of the record
    k, c, the n edges from the node ``off`` on are those from place p of document d on, in the piece that begins at a."""
    n, before, after, least, more, start, high, low = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in _RECORD)
    n = n.astype(np.int64)
    first = np.cumsum(n) - n
    last = first + n - 1
    record = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(record)) - first[record]
    node = high.astype(np.uint64) << np.uint64(16) | low
    on, back = np.append(high[1:], np.uint32(0)), np.append(np.uint32(0), high[:-1])
    on[last], back[first] = after, before
    docs, most, at = least[record], (least + more)[record], start.astype(np.int64)[record] + place
    out, into = _Edges(node, on, docs, most, at), _Edges(node, back, docs, most, at - 1)
    # nodes between just two repeated edges whose sources follow each other
    _, x, y = np.intersect1d(out.nodes, into.nodes, assume_unique=True, return_indices=True)
    x, y = out.of[x], into.of[y]
    joined = (out.doc[x] == into.doc[y]) & (out.place[x] == into.place[y] + 1)
    d, p, inner = into.doc[y[joined]], into.place[y[joined]], np.sort(node[x[joined]])
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(new)
    pd, pa_, pn = d[begin], p[begin], np.diff(np.append(begin, len(d))) + 1
    # each different record's repeated edges, unless only their source has them
    k, c = keys(high, low, first, n, before, after)
    order, heads = _groups(c, k)
    top = np.zeros(len(n), np.int64)
    if len(n):
        top[order[heads]] = np.maximum.reduceat((least + more)[order], heads)
    chosen = np.zeros(len(n), bool)
    chosen[order[heads]] = True
    go = np.flatnonzero(out.repeated & chosen[record] & (top[record] > out.doc))
    within = np.zeros(len(go), bool)
    if len(inner) and len(go):
        hit = np.minimum(np.searchsorted(inner, node[go]), len(inner) - 1)
        within = inner[hit] == node[go]
    follows = np.zeros(len(go), bool)
    follows[1:] = (go[1:] == go[:-1] + 1) & (record[go[1:]] == record[go[:-1]]) & within[1:]
    follows[1:] &= (out.doc[go[1:]] == out.doc[go[:-1]]) & (out.place[go[1:]] == out.place[go[:-1]] + 1)
    begin = np.flatnonzero(~follows)
    size = np.diff(np.append(begin, len(go)))
    go = go[begin]
    gd, gp = out.doc[go], out.place[go]
    ga = gp.copy()
    if len(pd) and len(go):  # the piece that holds the edge; single edges are no pieces
        names = np.unique(pd)
        number = np.searchsorted(names, gd)
        code = (np.minimum(number, len(names) - 1) << 32) + gp
        hit = np.searchsorted((np.searchsorted(names, pd) << 32) + pa_, code, "right") - 1
        inside = (hit >= 0) & (pd[hit] == gd) & (gp < pa_[hit] + pn[hit])
        ga = np.where(inside, pa_[hit], gp)
    no = pa.nulls(len(pd), pa.int32())
    two = lambda left, right, kind: pa.concat_arrays([left.cast(kind), pa.array(right).cast(kind)])
    columns = [
        two(no, k[record[go]].view(np.int64), pa.int64()), two(no, c[record[go]], pa.int32()), two(no, place[go], pa.int32()),
        two(pa.array(pn), size, pa.int32()), two(pa.array(pd), gd, pa.int64()), two(pa.array(pa_), gp, pa.int32()), two(no, ga, pa.int32()),
    ]
    return pa.table(columns, [x.split()[0] for x in _SOLVED.split(", ")])


def _paths(pieces: DataFrame) -> DataFrame:
    """d, a and the path of each piece: pieces are linked where the last edge of one is the first of another."""
    ends = pieces.select("d", F.col("z").alias("a"), F.lit(True).alias("linked"))
    along = Window.partitionBy("d").orderBy("a")  # one document's pieces: as many as it has words at most
    begins = F.when(F.col("linked").isNull(), F.col("a"))
    return pieces.join(ends, ["d", "a"], "left").select("d", "a", "z", F.last(begins, ignorenulls=True).over(along).alias("path"))


def _occurrences(docs: DataFrame, width: int, hot: np.ndarray) -> DataFrame:
    """k, c, doc and start of every run that has an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", SLICE):
            runs = Runs(part.column("text"), width, hot)
            go = np.flatnonzero((runs.n > 1) | (runs.after > 0))
            doc = part.column("doc_id").to_numpy()[runs.owner[go]]
            columns = [pa.array(runs.keys[0][go].view(np.int64)), pa.array(runs.keys[1][go]), pa.array(doc), pa.array(runs.start[go].astype("<i4"))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "c", "doc", "start"])

    return docs.mapInArrow(run, "k long, c int, doc long, start int")


def _busy(docs: DataFrame, width: int, size: int) -> np.ndarray:
    """Anchors that have one in SHARE, or more, of the different runs of a sample of documents: at most SHARE numbers.

    Equal runs count once in the whole sample, however its documents lie: anchors within a common passage are not busy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", SLICE):
            runs = Runs(part.column("text"), width, np.zeros(0, np.uint64))
            order, first = _groups(runs.keys[1], runs.keys[0])
            pick = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(runs.anchor[pick].view(np.int64)), pa.array(runs.keys[0][pick].view(np.int64))], ["anchor", "k"])

    some = docs if size <= SAMPLE else docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / size))
    counts = written(some.mapInArrow(run, "anchor long, k long").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("n") * SHARE >= total) & (F.col("n") > 16)).collect()  # SHARE rows at most
    dropped(counts)
    return np.sort(np.array([r["anchor"] for r in rows], np.int64)).view(np.uint64)


def repeated_spans(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start, n, source, source_start, path: the ``n`` words of ``doc`` from word ``start`` on are those of the smaller id
    ``source`` from word ``source_start`` on, as hashes say; ``path`` is where their path begins in the source. A written table."""
    if width < 2:
        raise ValueError("an edge has two words or more")
    plain = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = _busy(plain, width, size)
    records = _records(plain, width, max(parts, -(-size // BUCKET)), hot)
    solved = written(records.groupBy("bucket").applyInArrow(_solved, _SOLVED), "edges")
    pieces = solved.filter("k is null").select("d", F.col("p").alias("a"), (F.col("p") + F.col("n") - 1).alias("z"))
    paths = written(_paths(pieces), "paths")
    edges = solved.filter("k is not null").join(paths.select("d", "a", "path"), ["d", "a"], "left")
    edges = written(edges.select("k", "c", "off", "n", "d", "p", F.coalesce("path", "p").alias("path")), "runs")
    dropped(solved)
    dropped(paths)
    met = _occurrences(plain, width, hot).join(edges.hint("shuffle_hash"), ["k", "c"]).filter("d < doc")
    found = met.select("doc", (F.col("start") + F.col("off")).alias("start"), "n", "d", "p", "path")
    # what follows on one path is one span; equal rows of a repeated id count once
    along = Window.partitionBy("doc").orderBy("start", "d", "p")
    before = lambda c: F.lag(c).over(along)
    stop = F.col("start") + F.col("n")
    found = found.distinct().withColumns({"gap": (before("d") == F.col("d")) & (before("path") == F.col("path")) & (before(stop) == F.col("start")) & (before(F.col("p") + F.col("n")) == F.col("p"))})
    found = found.withColumn("span", F.count_if(~F.coalesce("gap", F.lit(False))).over(along))
    spans = found.groupBy("doc", "span").agg(F.min("start").alias("start"), F.sum("n").alias("edges"), F.first("d").alias("source"), F.min("p").alias("source_start"), F.first("path").alias("path"))
    spans = written(spans.select("doc", "start", (F.col("edges").cast("int") + width - 1).alias("n"), "source", "source_start", "path"), "spans")
    dropped(edges)
    return spans


def _digest(words: list[bytes], start: int, n: int) -> bytes | None:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest() if start + n <= len(words) else None


def _source_digests(docs: DataFrame, spans: DataFrame, doc_id: str, text: str) -> DataFrame:
    """source, source_start, n and a digest of these words, for every place that spans name."""
    places = spans.select("source", "source_start", "n").distinct().groupBy("source").agg(F.collect_list(F.struct("source_start", "n")).alias("places"))
    plain = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", SLICE):
            out = []
            for source, text_, places_ in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                words = text_.encode().split()
                out += [(source, p["source_start"], p["n"], d) for p in places_ if (d := _digest(words, p["source_start"], p["n"]))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source", "source_start", "n", "digest"])

    return plain.join(places.hint("shuffle_hash"), "source").select("source", "text", "places").mapInArrow(run, "source long, source_start int, n int, digest binary").distinct()


def verified_spans(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and ``spans`` (start, n, digest) of documents with words to remove; the document's own words must have the digest."""
    spans = repeated_spans(docs, width, doc_id, text)
    sources = written(_source_digests(docs, spans, doc_id, text), "sources")
    both = spans.join(sources, ["source", "source_start", "n"])
    out = written(both.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans")), "removed")
    dropped(spans)
    dropped(sources)
    return out


def _cut(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words that no span with the right digest covers."""
    kept, at = [], 0
    for s in sorted(spans or (), key=lambda s: (s["start"], s["n"])):
        stop = s["start"] + s["n"]
        if stop > at and _digest(words, s["start"], s["n"]) == s["digest"]:
            kept += words[at : s["start"]]
            at = stop
    return kept + words[at:] if at else words


def _map(docs: DataFrame, width: int, doc_id: str, text: str, new: list, form) -> DataFrame:
    """``docs`` with its text column replaced by what ``form`` makes of texts, words and kept words."""
    spans = verified_spans(docs, width, doc_id, text)
    key, list_ = fresh(docs, "span_doc", "span_list")
    both = docs.withColumn(key, F.col(doc_id).cast("long")).join(spans.toDF(key, list_).hint("shuffle_hash"), key, "left").drop(key)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text], *new])
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text):
            texts = part.column(text).to_pylist()
            words = [(t or "").encode().split() for t in texts]
            kept = [_cut(w, s) for w, s in zip(words, part.column(list_).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *form(texts, words, kept)], [f.name for f in schema.fields])

    return both.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` whose texts have lost the words that repeat a smaller id's, and the names of columns with n_words and n_removed.

    A text that loses words becomes its other words, joined by one blank; other texts stay as they are.
    """
    n_words, n_removed = fresh(docs, "n_words", "n_removed")
    new = [T.StructField(text, T.StringType()), T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())]

    def form(texts, words, kept):
        out = [t if len(w) == len(k) else b" ".join(k).decode() for t, w, k in zip(texts, words, kept, strict=True)]
        return [pa.array(out, pa.string()), *_numbers(words, kept)]

    out = _map(docs, width, doc_id, text, new, form)
    return out.select(*docs.columns, n_words, n_removed), {"n_words": n_words, "n_removed": n_removed}


def _numbers(words, kept) -> list[pa.Array]:
    return [pa.array([len(w) for w in words], pa.int64()), pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64())]


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words and removed words of every document, and the digest of those kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    digests = lambda _, words, kept: [*_numbers(words, kept), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())]
    return _map(docs, WIDTH, "doc_id", "text", new, digests)


#: DuckDB's rows for op13_substrings, for ids that are unique: every window of words with its smallest id.
ORACLE = f"""
with w as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), e as materialized (
  select doc_id, i, array_to_string(ws[i:i + {WIDTH - 1}], ' ') as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) as i from w)
), r as materialized (
  select gram, min(doc_id) as least from e group by gram having min(doc_id) < max(doc_id)
), gone as (
  select doc_id, list(distinct x) as xs from (
    select e.doc_id, unnest(range(e.i, e.i + {WIDTH})) as x from e join r using (gram) where r.least < e.doc_id
  ) group by doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(len(xs), 0)::bigint as n_removed,
  sha256(array_to_string(if(xs is null, ws, list_select(ws, list_sort(list_filter(range(1, len(ws) + 1), lambda x: not list_contains(xs, x))))), ' ')) as kept_sha256
from w left join gone using (doc_id)
"""
