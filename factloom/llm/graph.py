"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links given join: each node but the smallest of a component to the smallest."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each 64 Ki links become the forest that joins the same nodes."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        data = pa.Table.from_batches(held)
        a, b = forest(data.column("a").to_numpy(), data.column("b").to_numpy())
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= 1 << 16:
            yield out()
            held = []
    if held:
        yield out()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links at once."""
    held = [x for x in batches if x.num_rows]
    if held:
        data = pa.Table.from_batches(held)
        node, root = forest(data.column("a").to_numpy(), data.column("b").to_numpy())
        top = np.unique(root)
        yield pa.record_batch({"node": pa.array(np.concatenate([node, top])), "root": pa.array(np.concatenate([root, top]))})


def components(links: DataFrame, most: int = 500_000) -> DataFrame:
    """node, root (the smallest node that it reaches) for each node of links (a, b: long, without nulls).

    Each task first replaces its links by a forest. If `most` links or fewer are left, one task (on an executor) joins
    them; else large-star and small-star steps in turn, each an aggregate of minima and a join, until nothing changes;
    a hub costs an aggregate one row for each task, and the join may be split by AQE. Repeated links and links of a
    node to itself do no harm. No links give no rows.
    """
    kind = "a long, b long"
    links = common.cut(links.where("a <> b").mapInArrow(_contract, kind).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.limit(most + 1).count() <= most:
        return links.coalesce(1).mapInArrow(_whole, "node long, root long")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = common.cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
