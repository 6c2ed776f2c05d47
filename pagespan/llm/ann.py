"""Approximate nearest neighbours with balanced posting lists.

* Equal vectors are one: each is indexed with the k + 1 smallest of its ids, which are all that can be among
  the k nearest of anything, and is searched for once; so a vector that a third of all rows share is one row.
* Fit: a sample of at most ``SAMPLE`` vectors (smallest hashes of their ids) is split in two again and
  again, by 2-means with equal halves' sizes favoured, until each part stands for about ``LIST`` vectors: the
  centroids, at most SAMPLE / 3 (parts hold 5 rows at most and a third of that at least), small enough to send to every task.
* Centroids form a graph (nearest neighbours and some far links), searched best-first by many
  vectors at once.
* Index: every vector goes to its nearest list and, near a boundary, to up to ``REPLICAS`` lists
  whose centroid is at most ``NEAR`` times as far.
* Where the sample is too small for lists of about ``LIST`` vectors (beyond about SAMPLE / 3 * LIST of them), each list is
  split again in the same way, on a sample of about ``FINE`` of its own vectors and in a task of its own: so the
  number of lists grows with the table, up to FINE / 5 parts a list.
* Search: a query visits the lists whose centroid is at most ``RATIO`` times as far as the nearest
  (LISTS at most, FEWEST at least; of lists that are split, the same number of parts, a quarter of them in one list at most). Lists longer than ``BLOCK`` are dealt
  in blocks. Distances are exact, in double precision; the best of the blocks are merged.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components, and
rows with a null id take no part; equal distances go to the smaller id; repeated rows count once (of an id with
different vectors, the smallest vector counts); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagespan.llm.shared import unit_hash, written

SAMPLE, LIST = 20_000, 128
DEGREE, FAR, BEAM = 16, 4, 64
REPLICAS, NEAR = 4, 1.12
LISTS, FEWEST, RATIO = 160, 24, 1.35
FINE, BLOCK = 8192, 4096


#: A vector's list and part, in which it is held or looked for.
PLACE = ["list", "part"]


def usable(vec_id: Column, vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec_id.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def split_evenly(x: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of parts of at most ``most`` rows, by repeated balanced 2-means."""
    parts, done = [np.arange(len(x))] if len(x) else [], []
    while parts:
        rows = parts.pop()
        if len(rows) <= most:
            done.append(x[rows].mean(0))
            continue
        y = x[rows]
        c = y[rng.choice(len(y), 2, replace=False)]
        cut = None
        for _ in range(8):
            lean = ((y - c[0]) ** 2).sum(1) - ((y - c[1]) ** 2).sum(1)
            # between a third and two thirds go left
            k = int(np.clip((lean < 0).sum(), len(y) // 3, len(y) - len(y) // 3))
            order = np.argsort(lean, kind="stable")
            cut = order[:k], order[k:]
            c = np.stack([y[cut[0]].mean(0), y[cut[1]].mean(0)])
        parts += [rows[cut[0]], rows[cut[1]]]
    return np.stack(done) if done else np.zeros((0, x.shape[1] if x.ndim == 2 else 0))


class Centroids:
    def __init__(self, points: np.ndarray, rng: np.random.Generator):
        self.points = points.astype(np.float32)
        n = len(points)
        square = (self.points**2).sum(1)
        near = np.zeros((n, min(DEGREE, max(n - 1, 1))), np.int32)
        for at in range(0, n, 512):
            d = square[None, :] - 2 * self.points[at : at + 512] @ self.points.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 512] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
        self.links = np.hstack([near, rng.integers(0, n, (n, FAR), dtype=np.int32)]) if n else near
        self.doors = np.linspace(0, n - 1, min(n, BEAM), dtype=np.int32) if n else np.zeros(0, np.int32)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``k`` nearest centroids of each row, by graph search."""
        width = min(max(k, 32), len(self.points))
        k = min(k, width)
        ids = np.broadcast_to(self.doors, (len(x), len(self.doors)))
        beam, dist = self._best(x, ids, width)
        while True:
            more = np.concatenate([beam, self.links[beam[:, : max(8, width // 4)]].reshape(len(x), -1)], axis=1)
            new, far = self._best(x, more, width)
            if new.shape == beam.shape and (new == beam).all():
                return new[:, :k], far[:, :k]
            beam, dist = new, far

    def _best(self, x: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.sort(ids, axis=1)
        p = self.points[ids]
        d = np.sqrt(np.maximum(((p - x[:, None, :]) ** 2).sum(2), 0))
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        d[again] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        best, far = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        return best, far


def fit(vectors: DataFrame, sample: int = SAMPLE, size: int = LIST, seed: int = 4) -> tuple[Centroids, int]:
    """Centroids, and the number of components that most vectors of the sample have. ``vectors``: vec_id, x (usable)."""
    n = vectors.count()
    rows = vectors.select("x", unit_hash(seed, F.col("vec_id")).alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).collect()
    lengths = [len(r["x"]) for r in rows]
    dim = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    x = np.array([r["x"] for r in rows if len(r["x"]) == dim], np.float64).reshape(-1, dim or 1)
    rng = np.random.default_rng(seed)
    most = max(5, int(size * len(x) / max(n, 1)))
    return Centroids(split_evenly(x, most, rng), rng), dim


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _dealt(vectors: DataFrame, sent, dim: int, asks: bool) -> DataFrame:
    """list and row of each list that a vector belongs to (or that a query visits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Centroids = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x = _matrix(part.column("x"), dim).astype(np.float32)
                ids, far = cells.nearest(x, LISTS if asks else 2 * REPLICAS)
                rank = np.arange(ids.shape[1])[None, :]
                if asks:
                    ok = (far <= RATIO * far[:, :1]) | (rank < FEWEST)
                else:
                    ok = (far <= NEAR * far[:, :1]) & (rank < REPLICAS)
                ok &= np.isfinite(far)
                row, col = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), *[part.column(c).take(pa.array(row)) for c in ("vec_id", "x")]], ["list", "vec_id", "x"])

    return vectors.select("vec_id", "x").mapInArrow(run, "list int, vec_id long, x array<double>")


def _sizes(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _centres(lists: DataFrame, dim: int, size: int) -> DataFrame:
    """list, part, c: the parts of about ``size`` vectors of each list, by a sample of about FINE of its vectors."""
    sizes = F.broadcast(_sizes(lists, "list"))  # at most SAMPLE / 3 rows
    drawn = lists.join(sizes, "list").filter(unit_hash(5, F.col("list"), F.col("vec_id")) * F.col("n") <= FINE)

    def parts(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x = _matrix(table.column("x"), dim)
        most = max(5, int(size * len(x) / table.column("n")[0].as_py()))
        points = split_evenly(x, most, np.random.default_rng(5))
        ids = np.arange(len(points), dtype=np.int32)
        return pa.table({"list": np.full(len(points), table.column("list")[0].as_py(), np.int32), "part": ids, "c": pa.array(list(points), pa.list_(pa.float64()))})

    return drawn.groupBy("list").applyInArrow(parts, "list int, part int, c array<double>")


def _in_parts(rows: DataFrame, centres: DataFrame, dim: int, asks: bool) -> DataFrame:
    """list, part, vec_id of ``rows`` (list, vec_id, x): the part of their list that vectors belong to (with x), or those that queries visit; in blocks."""
    blocks = _sizes(rows, "list").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)  # at most SAMPLE / 3 rows
    left = rows.join(blocks, "list").withColumn("block", F.pmod(F.hash("vec_id"), "blocks")).drop("blocks")
    right = centres.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def near(table: pa.Table, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")
        x, c = _matrix(table.column("x"), dim), _matrix(parts.column("c"), dim)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(x), 64):
            far = np.sqrt(((x[at : at + 64, None, :] - c[None]) ** 2).sum(2))
            order = np.argsort(far, axis=1, kind="stable")[:, : LISTS // 4 if asks else 2]
            far = np.take_along_axis(far, order, 1)
            ok = (far <= (RATIO if asks else NEAR) * far[:, :1]) | (np.arange(order.shape[1])[None] < (FEWEST if asks else 1))
            row, col = np.nonzero(ok)
            found.append((row + at, order[row, col], far[row, col]))
        row, part, far = (np.concatenate(v) for v in zip(*found, strict=True))
        kept = table.select(["list", "vec_id"] if asks else ["list", "vec_id", "x"]).take(pa.array(row))
        return kept.append_column("part", pa.array(part.astype(np.int32))).append_column("far", pa.array(far))

    vector = "" if asks else "x array<double>, "  # a query's candidates are many before the last choice
    placed = left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInArrow(near, f"list int, vec_id long, {vector}part int, far double")
    if asks:
        by = Window.partitionBy("vec_id")
        placed = placed.withColumns({"rank": F.row_number().over(by.orderBy("far", *PLACE)), "least": F.min("far").over(by)})
        placed = placed.filter((F.col("rank") <= FEWEST) | (F.col("rank") <= LISTS) & (F.col("far") <= RATIO * F.col("least")))
    return placed.drop("far", "rank", "least")


def neighbours(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, size: int = LIST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row that ``queries`` picks."""
    rows = vectors.filter(usable(F.col(vec_id), F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"), F.max("asks").alias("asks"))
    # the ids of equal vectors: Spark keeps the first k + 1 before the shuffle already
    ranked = rows.withColumn("copy", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("copy") <= k + 1)
    ranked = written(ranked.select("vec_id", "x", "copy"), "vectors")
    single = ranked.filter("copy = 1").select("vec_id", "x")
    cells, dim = fit(single, sample, size)
    if not dim:
        return rows.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    fits = F.size("x") == dim
    wanted = rows.filter(F.col("asks") & fits).select(F.col("vec_id").alias("query_id"), "x")
    named = wanted.select("x").distinct().join(single, "x")  # a query vector goes by its smallest id
    named = written(named.select("vec_id", "x"), "asked")
    sent = vectors.sparkSession.sparkContext.broadcast(cells)
    lists = written(_dealt(single.filter(fits), sent, dim, False), "lists")
    asked = _dealt(named, sent, dim, True)
    if lists.count() > 4 * REPLICAS * size * len(cells.points):
        centres = written(_centres(lists, dim, size), "centres")
        lists, asked = written(_in_parts(lists, centres, dim, False), "parts"), _in_parts(written(asked, "visits"), centres, dim, True).join(named, "vec_id")
    else:
        lists, asked = lists.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    blocks = _sizes(lists, *PLACE).select(*PLACE, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    block = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    held = lists.join(blocks, PLACE, "left").select(*PLACE, F.pmod(F.hash("vec_id"), F.coalesce("blocks", F.lit(1))).alias("block"), "vec_id", "x", F.lit(False).alias("asks"))
    asked = asked.join(blocks, PLACE, "left").select(*PLACE, block.alias("block"), "vec_id", "x", F.lit(True).alias("asks"))

    def meet(table: pa.Table) -> pa.Table:
        ask = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        x = _matrix(table.column("x"), dim)
        here = np.flatnonzero(~ask)
        out = []
        for q in np.flatnonzero(ask):
            score = np.sqrt(((x[here] - x[q]) ** 2).sum(1))
            best = np.lexsort((ids[here], score))[: k + 1]  # itself may be among them
            out.append((np.full(len(best), ids[q]), ids[here][best], score[best]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("asked", "first", "score"), columns, strict=True)))

    found = held.unionByName(asked).groupBy(*PLACE, "block").applyInArrow(meet, "asked long, first long, score double")
    found = found.groupBy("asked", "first").agg(F.min("score").alias("score"))
    found = found.withColumn("at", F.row_number().over(Window.partitionBy("asked").orderBy("score", "first"))).filter(F.col("at") <= k + 1)
    # the vectors' ids again; each query has itself left out
    copies = ranked.filter(fits).join(ranked.filter("copy = 1").select("x", F.col("vec_id").alias("first")), "x").select("first", "vec_id")
    by = Window.partitionBy("asked").orderBy("score", "vec_id")
    found = found.join(copies, "first").groupBy("asked", "vec_id").agg(F.min("score").alias("score")).withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k + 1)
    best = found.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    own = wanted.join(named.withColumnRenamed("vec_id", "asked"), "x").select("query_id", "asked").join(best, "asked")
    own = own.select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(vectors, F.col("vec_id") % 100 == 0)
