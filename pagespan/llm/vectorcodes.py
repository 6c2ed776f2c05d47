"""Vector code compression: product codes of integer vectors, by k-means with adaptive bounds.

Components are scaled to integers and vectors cut into parts; each part position has a codebook, and a vector's code is
the index of the nearest entry for each part. Codebooks are fitted to all vectors by rounds of assignment and means.

Rounds after the first use Drake's bounds. With each part go its b closest entries, in order, a lower bound for each of
them that also holds for all later ones, and one outer bound for all entries not kept. When entries have moved, bounds
shrink by their moves, and only the entries before the first bound that exceeds the distance to the present entry can be
nearest. These are compared by exact integer distances; where no bound suffices, all entries are. b adapts: after each
round it falls to what all but one in RARE of the parts needed. Bounds only spare work, they decide nothing.

State is a written table a round; sums of parts are formed in tasks and added up by Spark. The driver gets
codebooks and sums: ``entries`` times the number of components numbers, whatever the number of rows.

Defined results: rows whose vector is null, holds null or non-finite components, or has another length than most (ties: the
longer) are dropped; integers stay within bounds that keep squared distances in 64 bits (for 64 components, components beyond
131,072 count as that); parts differ by one in length where they must; with fewer vectors than entries there are as many
entries as vectors; rows with a null id come last in the initial codebook, rows of one id in the order of their integers' bytes;
repeated rows are coded each; an empty table gives an empty one. Input columns pass through, new names are made fresh.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespan.llm.shared import dropped, fresh, join_small, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries kept with each part at first, and at least.
KEPT, FEWEST = 24, 2
#: After a round, one part in so many may need more than the entries that are kept.
RARE = 200
#: Vectors that a task compares at once.
ROWS = 4096
#: Bounds are lowered, and distances that they must exceed raised, by more than floating point can err.
_SLACK = 2.0**-20


@dataclass
class Codebooks:
    """Entries of each part position, as integers: an array (entries, length) each."""

    entries: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that rows of indexes stand for."""
        return np.concatenate([part[codes[:, p]] for p, part in enumerate(self.entries)], 1)


def edges_of(size: int, parts: int) -> list[int]:
    return [size * p // parts for p in range(parts + 1)]


def largest(size: int) -> int:
    """The largest integer whose squared distances, over ``size`` components, stay below 2**62."""
    return 1 << (60 - (max(size, 1) - 1).bit_length()) // 2


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # all sums are whole numbers that doubles hold
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.concatenate([((x[k : k + 64, None, :] - entries) ** 2).sum(2) for k in range(0, len(x), 64)] or [np.zeros((0, len(entries)), np.int64)])


def nearest(x: np.ndarray, entries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` closest entries of each row in order, ties to lower indexes, and a bound after each of them."""
    d = squares(x, entries)
    order = np.argsort(d, axis=1, kind="stable")[:, : keep + 1]
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(float)) * (1 - _SLACK)
    bounds = np.full((len(x), keep), np.inf)
    bounds[:, : root.shape[1] - 1] = root[:, 1:]
    return order[:, :keep].astype(np.uint8), bounds


def reassign(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, near: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closest entries and bounds after the entries moved, and how many entries each row had to look at."""
    keep = near.shape[1]
    bounds = bounds.copy()
    bounds[:, :-1] -= moves[near[:, 1:]]
    bounds[:, -1] -= moves.max(initial=0)
    bounds = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]
    own = np.sqrt(((x - entries[near[:, 0]]) ** 2).sum(1).astype(float)) * (1 + _SLACK)
    sure = bounds > own[:, None]
    need = np.where(sure.any(1), sure.argmax(1) + 1, len(entries))
    near = near.copy()
    for z in np.unique(need[(need > 1) & (need <= keep)]).tolist():
        rows = np.flatnonzero(need == z)
        some = near[rows, :z].astype(np.int64)
        d = ((x[rows, None, :] - entries[some]) ** 2).sum(2)
        order = np.lexsort((some, d), axis=1)
        near[rows, :z] = np.take_along_axis(some, order, 1)
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float)) * (1 - _SLACK)
        bounds[rows, : z - 1] = np.minimum(root[:, 1:], bounds[rows, z - 1 : z])
    rows = np.flatnonzero(need > keep)
    if len(rows):
        near[rows], bounds[rows] = nearest(x[rows], entries, keep)
    return near, bounds, need


def _stored(bounds: np.ndarray) -> np.ndarray:
    """Bounds in 16 bits, never raised: the upper half of a float."""
    return ((np.maximum(bounds, 0) * (1 - _SLACK)).astype("<f4").view("<u4") >> 16).astype("<u2")


def _loaded(bits: np.ndarray) -> np.ndarray:
    return (bits.astype("<u4") << 16).view("<f4").astype(float)


def _binary(rows: np.ndarray) -> pa.Array:
    """A row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * (rows.shape[1] if rows.ndim == 2 else int(np.prod(rows.shape[1:])))
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int64) * size)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _integers(vectors: DataFrame, vector: str, ints: str) -> tuple[DataFrame, int]:
    """Rows with usable vectors, which become integers (as 32-bit numbers in one binary), and the vectors' length."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    sound = vectors.filter(v.isNotNull() & F.forall(v, finite))
    most = sound.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    limit = largest(size)
    at = vectors.columns.index(vector)
    schema = T.StructType([*[f for f in vectors.schema.fields if f.name != vector], T.StructField(ints, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.floor(SCALE * batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(batch.num_rows, size)
                rest = [c for k, c in enumerate(batch.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*rest, _binary(np.clip(x, -limit, limit).astype("<i4"))], [f.name for f in schema.fields])

    return sound.filter(F.size(v) == size).mapInArrow(run, schema), size


class _State:
    """Names of the columns that travel with a row: near entries, bounds, entries looked at, squared distances."""

    def __init__(self, df: DataFrame, ints: str):
        self.ints = ints
        self.names = fresh(df, "near", "bounds", "need", "squared")
        self.types = [T.BinaryType(), T.BinaryType(), T.IntegerType(), T.LongType()]
        self.base = df.columns


def _assigned(df: DataFrame, state: _State, edges: list[int], books: list[np.ndarray], moves: list[np.ndarray] | None, was: int, keep: int) -> DataFrame:
    """Rows with their parts' nearest entries: from nothing, or from bounds for ``was`` entries."""
    base = len(state.base)
    schema = T.StructType([*df.schema.fields[:base], *map(T.StructField, state.names, state.types)])
    at, size, parts = state.base.index(state.ints), edges[-1], len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                x = _matrix(batch.column(at), "<i4", size).astype(np.int64) if size else np.zeros((batch.num_rows, 0), np.int64)
                if moves:
                    old_near = _matrix(batch.column(base), np.uint8, parts, was)[:, :, :keep]
                    old_bounds = _loaded(_matrix(batch.column(base + 1), "<u2", parts, was))[:, :, :keep]
                near, bounds = np.zeros((len(x), parts, keep), np.uint8), np.zeros((len(x), parts, keep))
                need, squared = np.ones(len(x), np.int32), np.zeros(len(x), np.int64)
                for p, entries in enumerate(books):
                    part = x[:, edges[p] : edges[p + 1]]
                    if moves:
                        near[:, p], bounds[:, p], seen = reassign(part, entries, moves[p], old_near[:, p], old_bounds[:, p])
                        need = np.maximum(need, seen)
                    else:
                        near[:, p], bounds[:, p] = nearest(part, entries, keep)
                    squared += ((part - entries[near[:, p, 0]]) ** 2).sum(1)
                new = [_binary(near), _binary(_stored(bounds)), pa.array(need, pa.int32()), pa.array(squared, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:base], *new], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _sums(df: DataFrame, state: _State, edges: list[int], entries: int, keep: int) -> list[tuple[np.ndarray, list[list[int]]]]:
    """For each part: rows of each entry, and its parts' sums by component. Tasks add up their own rows first."""
    parts, size = len(edges) - 1, edges[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((entries, size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), "<i4", size).astype(np.int64) if size else np.zeros((batch.num_rows, 0), np.int64)
            code = _matrix(batch.column(1), np.uint8, parts, keep)[:, :, 0]
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                order = np.argsort(code[:, p], kind="stable")
                found, first = np.unique(code[order, p], return_index=True)
                if edges[p] < edges[p + 1]:
                    total[found, edges[p] : edges[p + 1]] += np.add.reduceat(x[order, edges[p] : edges[p + 1]], first, axis=0)
        place = np.concatenate([np.arange(parts) + size, np.arange(size)])  # the counts follow the components
        value = np.concatenate([count, total.T])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(place, entries)), pa.array(np.tile(np.arange(entries), size + parts)), pa.array(value.ravel())], ["place", "entry", "value"])

    sent = df.select(state.ints, state.names[0]).mapInArrow(run, "place long, entry long, value long")
    summed = sent.groupBy("place", "entry").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    table = {(r["place"], r["entry"]): int(r["value"]) for r in summed.collect()}  # entries * (size + parts) rows
    get = lambda place, e: table.get((place, e), 0)
    return [([get(size + p, e) for e in range(entries)], [[get(i, e) for i in range(edges[p], edges[p + 1])] for e in range(entries)]) for p in range(parts)]


def _means(entries: np.ndarray, counts: list[int], sums: list[list[int]]) -> np.ndarray:
    """Componentwise floors of the means; unused entries stay."""
    rows = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, entries.tolist(), strict=True)]
    return np.array(rows, np.int64).reshape(entries.shape)


def _enough(table: DataFrame, need: str, keep: int) -> int:
    """The fewest entries that all but one in RARE rows made do with."""
    found = sorted((r[need], r["count"]) for r in table.groupBy(need).count().collect())  # at most ``entries`` rows
    total, seen = sum(n for _, n in found), 0
    for z, n in found:
        seen += n
        if seen * RARE >= total * (RARE - 1):
            return max(FEWEST, min(keep, z))
    return keep


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, str], Codebooks]:
    """Rows with usable vectors, with ``code`` (a byte a part) and ``error`` (squared distance) instead of ``vector``,
    the names of these two columns, and the codebooks. ``entries`` is 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: entries must be 1 to 256")
    (ints,) = fresh(vectors, "ints")
    whole, size = _integers(vectors, vector, ints)
    whole = written(whole, "integers")
    edges = edges_of(size, parts)
    first = whole.select(vec_id, ints).orderBy(F.col(vec_id).asc_nulls_last(), ints).limit(entries).collect()
    code, error = fresh(whole.drop(ints), "code", "error")
    names = {"code": code, "error": error}
    x = np.array([np.frombuffer(bytes(r[ints]), "<i4") for r in first], np.int64).reshape(len(first), size)
    books = [x[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
    if not first:
        empty = whole.drop(ints).withColumns({code: F.lit(None).cast("binary"), error: F.lit(None).cast("long")})
        return empty, names, Codebooks(books)
    state = _State(whole, ints)
    near, _, need, squared = state.names
    keep = min(KEPT, len(first))
    table, old = written(_assigned(whole, state, edges, books, None, 0, keep), "codes"), whole
    for _ in range(rounds):
        new = [_means(b, *s) for b, s in zip(books, _sums(table, state, edges, len(first), keep), strict=True)]
        if all(map(np.array_equal, new, books)):
            break
        moves = [np.sqrt(((a - b) ** 2).sum(1).astype(float)) * (1 + _SLACK) for a, b in zip(new, books, strict=True)]
        dropped(old)
        was, keep = keep, _enough(table, need, keep) if old is not whole else keep
        books, old = new, table
        table = written(_assigned(table, state, edges, books, moves, was, keep), "codes")
    dropped(old)
    return table.select(*whole.drop(ints).columns, _first_bytes(F.col(near), parts, keep).alias(code), F.col(squared).alias(error)), names, Codebooks(books)


def _first_bytes(near: Column, parts: int, keep: int) -> Column:
    """The nearest entry of each part."""
    return F.concat(*[F.substring(near, p * keep + 1, 1) for p in range(parts)])


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", vector: str = "decoded") -> tuple[DataFrame, str]:
    """``codes`` with the vectors that their codes stand for, and that column's name."""
    (name,) = fresh(codes, vector)
    schema = T.StructType([*codes.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    at, parts = codes.columns.index(code), len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = books.vectors(_matrix(batch.column(at), np.uint8, parts)) / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], [f.name for f in schema.fields])

    return codes.mapInArrow(run, schema), name


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors, errors by label, and the digest of the codebooks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    out, got, books = compressed(vectors)
    out = out.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    groups = written(out.groupBy("group").agg(F.sum(F.col(got["error"]).cast("decimal(38,0)")).try_cast("long").alias("label_error")), "labels")
    out = join_small(out, groups, "group")
    return out.select("vec_id", F.lower(F.hex(got["code"])).alias("code"), F.col(got["error"]).alias("error"), "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment to codebook ``k``, and codebook ``k + 1``: means of the parts, by componentwise floors."""
    return f"""
a{k} as materialized (
  select vec_id, p, min(d * {ENTRIES} + e) as best
  from (select vec_id, x.p, e, sum((x.v - c.v) * (x.v - c.v)) as d from x join c{k} c using (i) group by all) group by all
), c{k + 1} as materialized (
  select c.p, e, i, coalesce((s - ((s % n) + n) % n) // n, c.v) as v
  from c{k} c left join (
    select best % {ENTRIES} as e, i, sum(v)::hugeint as s, count(*) as n from x join a{k} using (vec_id, p) group by all
  ) using (e, i)
)"""


#: DuckDB's rows for op11_codes, for ids that are unique and vectors of one length.
ORACLE = f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda z: floor({SCALE} * z::double)::hugeint) as vs
  from embeddings where embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0
), x as materialized (
  select *, i * {PARTS} // size as p from (select vec_id, len(vs) as size, unnest(range(len(vs))) as i, unnest(vs) as v from kept)
), c0 as materialized (
  select p, e, i, v from x join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept) using (vec_id) where e < {ENTRIES}
), {",".join(map(_round, range(ROUNDS + 1)))}, coded as (
  select vec_id, string_agg(printf('%02x', (best % {ENTRIES})::int), '' order by p) as code, sum(best // {ENTRIES})::bigint as error from a{ROUNDS} group by vec_id
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(v::varchar, ',' order by p, e, i)) from c{ROUNDS}) as codebooks_sha256
from coded join kept using (vec_id)
"""
