"""Near-duplicate documents by SetSketch registers.

A document is the set of its shingles. Its sketch has REGISTERS registers; every shingle draws
a value for each register, exponentially distributed and, in each shingle's own register order,
growing; a register keeps the minimum, truncated to powers of BASE. Sketches of unions are registers' maxima
(of the exponents), and equal registers are the likelier the more alike two sets are. Then:

1. documents of equal sets (equal size and 128-bit fingerprint) form a class; its smallest id represents it;
2. bands of ROWS registers propose partners. First each class meets the smallest of all its buckets'
   members, then the smallest of each large bucket that is of another component. In buckets that still hold
   several components, members of different components meet: in small buckets pair by pair, in
   large ones block by block, where full sets travel along and only confirmed links come out;
3. a joint maximum-likelihood estimate over whole sketches and the sets' sizes drops proposals
   far below the threshold;
4. the rest is confirmed on full sets, and confirmed links make components.

A link inside one component is never looked for again: it could not change the result. At
similarity 0.8 all bands miss a pair with probability under 3e-6; BASE is so near 1 that sets without
common shingles share a band with probability under 1e-12, sets 0.1 alike with 6e-5, so that buckets
do not fill with unrelated texts as the corpus grows.

Defined results: null texts and texts without words are empty sets and linked with nothing; texts
shorter than a shingle are one shingle; rows with a null id have no component and are kept;
repeated rows share their id's component; rows of one id with different texts are one document, linked with
all that one of its texts is linked with (n_shingles is each row's own); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm.components import components
from pagespan.llm.shared import NARROW_ROWS, dropped, sliced, written
from pagespan.llm.textbytes import mix, shingle_sets

ROWS, BANDS = 6, 42
REGISTERS, BASE, RATE = ROWS * BANDS, 1.02, 20.0
#: Added to exponents, so that the largest values stay above 0.
SHIFT = 40
#: Bits of a bucket's key below its band.
KEY_BITS = 57
#: Pairs estimated this far below the threshold are dropped; over six standard errors.
SLACK = 0.16
#: Members of a bucket that are compared in one go; larger buckets go in blocks of BLOCK members.
SMALL, BLOCK = 64, 512
WIDTH, PERCENT = 5, 80


def registers(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sketches (rows of 16-bit exponents) of sets given as hashes and offsets.

    At step j a set's elements draw values in [j, j + 1) / REGISTERS; a set is done when no register
    is above the step. Each element walks through the registers by a step without common divisors with their number.
    """
    n = len(first) - 1
    least = np.ones(n * REGISTERS)
    size = np.diff(first)
    owner = np.repeat(np.arange(n), size)
    at = (mix(flat, 1) % np.uint64(REGISTERS)).astype(np.int64)
    walk = _STEPS[(mix(flat, 2) % np.uint64(len(_STEPS))).astype(np.int64)]
    h = flat
    for j in range(REGISTERS):
        if not len(owner):
            break
        u = (j + (mix(h, 3 + j) >> np.uint64(11)).astype(np.float64) / (1 << 53)) / REGISTERS
        np.minimum.at(least, owner * REGISTERS + at, u)
        sets = np.unique(owner)
        more = np.zeros(n, bool)
        more[sets] = least.reshape(n, REGISTERS)[sets].max(1) > (j + 1) / REGISTERS
        go = more[owner]
        owner, h, walk = owner[go], h[go], walk[go]
        at = (at[go] + walk) % REGISTERS
    x = -np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE
    k = np.floor(SHIFT - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(k, 0, 65535).astype("<u2").reshape(n, REGISTERS)


_STEPS = np.flatnonzero(np.gcd(np.arange(REGISTERS), REGISTERS) == 1)


def unpacked(sketches: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of sketches as rows of registers."""
    return np.frombuffer(b"".join(sketches.to_pylist()), "<u2").reshape(-1, REGISTERS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """The bucket of each band of each sketch: the band, then a hash of its registers."""
    rows = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    code = np.zeros((len(sketch), BANDS), np.uint64)
    for k in range(ROWS):
        code = mix(code, k + 1) + rows[:, :, k]
    band = np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(KEY_BITS)
    return (mix(code) >> np.uint64(64 - KEY_BITS) | band).astype(np.int64)


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 50) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood over registers above, below and equal."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = REGISTERS - above - below
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most[:, None] * np.linspace(0, 1, grid)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-9
    like = above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), like.argmax(1)]


def _sketched(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            flat, first = shingle_sets(part.column("text"), width)
            total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(flat, s), dtype=np.uint64)]) for s in (901, 902)]
            prints = [(t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total]
            sketch = [r.tobytes() for r in registers(flat, first)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first).astype(np.int64)), *map(pa.array, prints), pa.array(sketch, pa.binary())], ["id", "n", "f1", "f2", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, f1 long, f2 long, sketch binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                keys = band_keys(unpacked(part.column("sketch")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), BANDS))], ["key", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "key long, rep long")


def _sets(docs: DataFrame, members: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """rep, size, sketch, shingles of the documents ``members`` names, as a written table."""
    ids = written(members.select("rep").distinct(), "ids")
    near = F.broadcast(ids) if ids.count() <= NARROW_ROWS else ids
    wanted = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(near, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            flat, first = shingle_sets(part.column("text"), width)
            sets = pa.array([flat[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(np.diff(first).astype(np.int64)), pa.array([s.tobytes() for s in registers(flat, first)], pa.binary()), sets], ["rep", "size", "sketch", "shingles"])

    out = wanted.mapInArrow(run, "rep long, size long, sketch binary, shingles binary").filter("size > 0")
    return written(out.dropDuplicates(["rep", "shingles"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (u, v) that the estimate does not rule out and whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = likeliest(unpacked(part.column("su")), unpacked(part.column("sv")), part.column("nu").to_numpy(), part.column("nv").to_numpy())
                a, b = part.column("a"), part.column("b")
                ok = [bool(e >= least) and _similar(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64), percent) for k, e in enumerate(near)]
                yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.toDF("u", "nu", "su", "a"), "u").join(sets.toDF("v", "nv", "sv", "b"), "v")
    return written(both.mapInArrow(check, "u long, v long"), "links")


def _first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which pairs of sketches agree: there, and only there, a pair is looked at."""
    return (a == b).reshape(-1, BANDS, ROWS).all(2).argmax(1)


def _proposed(members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of small buckets that are of different components, each once, by the estimate."""
    rows = members.join(classes.select("rep", F.col("n").alias("size"), "sketch"), "rep").select("key", "rep", "comp", "size", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> pa.RecordBatch:
            key, rep, comp, size = (t.column(c).to_numpy() for c in ("key", "rep", "comp", "size"))
            sketch = unpacked(t.column("sketch"))
            found = []
            step = 0
            while True:  # rows are sorted: a key's partners follow it closely
                step += 1
                i = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, int)
                if not len(i):
                    break
                j = i + step
                go = comp[i] != comp[j]
                i, j = i[go], j[go]
                go = _first_band(sketch[i], sketch[j]) == key[i] >> KEY_BITS
                i, j = i[go], j[go]
                go = likeliest(sketch[i], sketch[j], size[i], size[j]) >= least
                found.append((rep[i[go]], rep[j[go]]))
            u, v = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            key = t.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            at = 0
            while at < end:  # whole buckets, each chunk from where the last one ended
                to = int(np.searchsorted(key, key[min(at + 4096, end) - 1], "right"))
                yield pairs(t.slice(at, to - at))
                at = to
            rest = t.slice(end)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def _linked(members: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (u, v) between components in large buckets, one a member and component met in a block.

    Members outside of a bucket's most common component ask, all members are asked; both are dealt
    into blocks of BLOCK rows, and each pair of blocks is one group.
    """
    of = members.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("main"), F.sum("count").alias("all"))
    of = of.select("key", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.count")) / BLOCK).cast("int").alias("askers"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.join(of, "key").join(sets, "rep")
    columns = ["rep", "comp", "size", "sketch", "shingles"]
    ways = lambda n: F.sequence(F.lit(0), n - 1)
    held = rows.select("key", F.pmod(F.hash("rep"), blocks).alias("block"), F.explode(ways(F.col("askers"))).alias("asker"), *columns, F.lit(False).alias("asks"))
    asks = rows.filter(F.col("comp") != F.col("main")).select("key", F.explode(ways(blocks)).alias("block"), F.pmod(F.hash("rep"), "askers").alias("asker"), *columns, F.lit(True).alias("asks"))

    def meet(t: pa.Table) -> pa.Table:
        ask = t.column("asks").to_numpy()
        rep, comp, size = (t.column(c).to_numpy() for c in ("rep", "comp", "size"))
        band = t.column("key")[0].as_py() >> KEY_BITS
        sketch = unpacked(t.column("sketch"))
        full = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        here = np.flatnonzero(~ask)
        out = []
        for k in np.flatnonzero(ask):
            other = here[comp[here] != comp[k]]
            other = other[_first_band(sketch[other], sketch[np.full(len(other), k)]) == band] if len(other) else other
            if not len(other):
                continue
            me = np.full(len(other), k)
            near = likeliest(sketch[me], sketch[other], size[me], size[other])
            met: set[int] = set()
            for x in np.argsort(-near, kind="stable"):
                if near[x] < least:
                    break
                o = other[x]
                if comp[o] not in met and _similar(full[k], full[o], percent):
                    met.add(int(comp[o]))
                    out.append((min(rep[k], rep[o]), max(rep[k], rep[o])))
        return pa.table({"u": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.int64())})

    return held.unionByName(asks).groupBy("key", "block", "asker").applyInArrow(meet, "u long, v long").distinct()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components: key, rep, n, center, comp."""
    held = members.join(labels.toDF("rep", "comp"), "rep", "left").select("key", "rep", "n", "center", F.coalesce("comp", "rep").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("key")
    return written(held.join(mixed, "key", "left_semi"), "open")


def _texts_of_one_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between an id and the classes of its texts, where these differ."""
    prints = F.struct("f1", "f2", "n")
    several = usable.groupBy("id").agg(F.min(prints).alias("a"), F.max(prints).alias("b")).filter("a <> b").select("id")
    rows = usable.select("id", "f1", "f2", "n").join(several, "id", "left_semi").distinct()
    return rows.join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    least = percent / 100 - SLACK
    sketched = written(_sketched(docs, doc_id, text, width), "sketched")
    usable = sketched.filter("n > 0 and id is not null")
    classes = written(usable.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    banded = _banded(classes)
    buckets = banded.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(banded.join(buckets, "key"), "members")
    sets = _sets(docs, members, doc_id, text, width)
    star = members.filter("rep <> center").groupBy("rep").agg(F.min("center").alias("u")).select("u", F.col("rep").alias("v"))
    links = _confirmed(star, sets, least, percent).unionByName(_texts_of_one_id(usable, classes))
    # one step of these links is enough to tell what the second star can leave out
    open_ = _labelled(members, links.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v")))
    of = open_.select(F.col("rep").alias("center"), F.col("comp").alias("center_comp")).distinct()
    star = open_.filter(f"rep <> center and n > {SMALL}").select("center", "rep", "comp").distinct().join(of, "center").filter("comp <> center_comp").select(F.col("center").alias("u"), F.col("rep").alias("v"))
    labels = written(components(links.unionByName(_confirmed(star, sets, least, percent))), "labels")
    dropped(open_)
    open_ = _labelled(members, labels)
    small, large = open_.filter(F.col("n") <= SMALL), open_.filter(F.col("n") > SMALL)
    links = _linked(large, sets, least, percent)
    more = _confirmed(_proposed(small, classes, least), sets, least, percent)
    labels = written(components(labels.toDF("u", "v").unionByName(links).unionByName(more)), "labels")
    for table in (sets, members, open_):
        dropped(table)
    of_class = classes.select("f1", "f2", "n", "rep").join(labels.toDF("rep", "comp"), "rep", "left").select("f1", "f2", "n", F.coalesce("comp", "rep").alias("comp"))
    out = sketched.select("id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the smallest id."""
    gone = near_duplicates(docs, width, percent, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles are 0.8 alike."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=2)
