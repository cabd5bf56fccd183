"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to `axes` random directions, shifted, and put in the order of a Hilbert curve; that is done
for `curves` directions and shifts. Each curve is cut into ranges of about equal count; a query's window on a curve is
its own range and the two beside it. The windows of all curves merge: a row that lies in one of them is a candidate, and
its exact distance ranks it.

Rows stay where they are: a task computes the places of its rows on all curves, compares them with the windows of a block of
queries (a broadcast of bounded size), and keeps each query's k nearest. Only these are shuffled, so neither equal
vectors nor a crowded range fill a task. Queries beyond a block go in further blocks, each of which reads the rows again.

A range is a share of the table: in data without structure a window of a fixed length would find an ever smaller part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 6


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on a Hilbert curve of points [n, axes] with integer coordinates of `bits` bits (Skilling's transform)."""
    axes = points.shape[1]
    x = points.T.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[axes - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(points.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """Projections, shifts and scales of all curves."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, curves: int, axes: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        size = len(mean)
        self.axes = min(axes, size)
        self.mean = mean
        self.turn = [np.linalg.qr(rng.normal(size=(size, self.axes)))[0] for _ in range(curves)]
        self.shift = [rng.random(self.axes) * 0.5 for _ in range(curves)]
        self.scale = [np.maximum(6 * np.sqrt((r * r * (spread * spread)[:, None]).sum(axis=0)), 1e-300) for r in self.turn]

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        for turn, shift, scale in zip(self.turn, self.shift, self.scale, strict=True):
            unit = np.clip((vectors - self.mean) @ turn / scale + 0.5, 0, 1) * 0.5 + shift
            out.append(hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))
        return out


def _merge(best: tuple[np.ndarray, np.ndarray], d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least (distance, id) of what is held and what is new, each once."""
    d, ids = np.concatenate([best[0], d]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, d))
    d, ids = d[order], ids[order]
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (ids[1:] != ids[:-1])]) if len(d) else np.zeros(0, bool)
    return d[fresh][:k], ids[fresh][:k]


def search(vectors: DataFrame, every: int = 100, k: int = 10, curves: int = 64, axes: int = 8, range_rows: int = 256, ranges: int = 200, block: int = 8192, seed: int = 23, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Rows with a null id, and vectors that are null, zero, hold null or non-finite components, or have another length
    than most (ties: the longer), take no part. Ties go to the smaller id. Equal rows count once, as query and as
    candidate, and a query's own row is no candidate; rows of its id with another vector are. Of one id, rows at the
    same distance count once. Fewer candidates than k give them all. No rows give no rows.

    Curves are cut in `ranges` ranges (fewer where these would have less than range_rows rows). Queries go in blocks of
    about `block`; each block is broadcast and reads the rows once.
    """
    spark = vectors.sparkSession
    common.bounded(spark)
    v = F.col("v")
    clean = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    )
    lengths = clean.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("count"), F.sum((F.col("id") % every == 0).cast("long")).alias("asked")).orderBy(F.desc("count"), F.desc("size")).first()
    if not lengths or not lengths["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n, asked = lengths["size"], lengths["count"], lengths["asked"]
    clean = clean.where(F.size("v") == size)
    about = clean.agg(*[F.avg(v[i]).alias(f"m{i}") for i in range(size)], *[F.stddev_pop(v[i]).alias(f"s{i}") for i in range(size)]).first()
    shape = spark.sparkContext.broadcast(Curves(np.array(about[:size]), np.array(about[size:]), curves, axes, seed))
    matrix = lambda batch: batch.column("v").flatten().to_numpy().reshape(-1, size)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shape.value.keys(matrix(batch))
                yield pa.record_batch({"c": pa.array(np.repeat(np.arange(curves, dtype=np.int32), batch.num_rows)), "key": pa.array(np.concatenate(found))})

    ranges = min(max(n // range_rows, 1), ranges)
    at = [i / ranges for i in range(1, ranges)]
    cuts = [np.zeros(0, np.int64)] * curves
    if at:
        found = clean.select("v").mapInArrow(keys, "c int, key long").groupBy("c").agg(F.percentile_approx("key", at, 5000).alias("x")).collect()  # fewer than `ranges` numbers for each curve
        for r in found:
            cuts[r.c] = np.array(r.x, np.int64)
    parts = []
    for i in range(-(-asked // block)):
        mine = clean.where((F.col("id") % every == 0) & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(-(-asked // block))) == i)).distinct().toArrow()  # about `block` rows
        if mine.num_rows:
            parts.append(_nearest_of(clean, mine, shape, cuts, k, size))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    met = reduce(DataFrame.unionByName, parts).distinct()
    first = Window.partitionBy("query_id", "n").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of(rows: DataFrame, queries: pa.Table, shape, cuts: list[np.ndarray], k: int, size: int) -> DataFrame:
    """query_id, n (of the query among those of its id), vec_id, score: each task's k nearest rows of each query's windows."""
    queries = queries.take(np.lexsort((*queries.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size).T, queries.column("id").to_numpy())))
    ids = queries.column("id").to_numpy()
    points = queries.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
    number = np.arange(len(ids)) - np.searchsorted(ids, ids)
    windows = []
    for cut, key in zip(cuts, shape.value.keys(points), strict=True):
        own = np.searchsorted(cut, key, "right")
        edge = np.concatenate([[np.iinfo(np.int64).min], cut, [np.iinfo(np.int64).max]])
        windows.append((edge[np.maximum(own - 1, 0)], edge[np.minimum(own + 2, len(cut) + 1)]))
    shared = rows.sparkSession.sparkContext.broadcast((ids, number, points, windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, which, points, windows = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                data, own = some.column("v").flatten().to_numpy().reshape(-1, size), some.column("id").to_numpy()
                places = shape.value.keys(data)
                for a in range(0, len(asked), 512):
                    part = slice(a, a + 512)
                    inside = np.zeros((len(asked[part]), len(own)), bool)
                    for place, (low, high) in zip(places, windows, strict=True):
                        inside |= (place >= low[part, None]) & (place < high[part, None])
                    for q in range(len(inside)):
                        row = np.flatnonzero(inside[q])
                        gap = data[row] - points[a + q]
                        square = np.einsum("ij,ij->i", gap, gap)
                        held = best[a + q][0]
                        if len(held) == k:  # what is surely farther than the k-th goes before it is measured
                            close = square <= held[-1] ** 2 * (1 + 1e-9)
                            row, gap = row[close], gap[close]
                        d = np.sqrt((gap**2).sum(axis=1))
                        use = (own[row] != asked[a + q]) | (gap != 0).any(axis=1)
                        if use.any():
                            best[a + q] = _merge(best[a + q], d[use], own[row][use], k)
        n = [len(d) for d, _ in best]
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        yield pa.record_batch({"query_id": pa.array(np.repeat(asked, n)), "n": pa.array(np.repeat(which, n)), "vec_id": pa.array(join([x for _, x in best], np.int64)), "score": pa.array(join([d for d, _ in best], np.float64))})

    return rows.mapInArrow(scan, "query_id long, n long, vec_id long, score double")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the 10 nearest vectors of every hundredth."""
    return search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
