"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are filled like water: each source gets words by weight until it holds `most` times its own. Words are then
dealt to sources by highest quotients (target / 1, / 3, / 5, ...), and a source's words to its shards the same way,
in equal blocks, by the shards' sizes and up to what each can give; what is left is a part of a block. So every quota
is an integer and the quotas add up. A source has a shard for each 500 blocks of its own words. A shard lays its
documents in a seeded order on one line of words and takes its blocks from the start of that line, round again where
it takes more than it has.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def fill(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of total by weight, where none is above most * size; what is above is shared again by weight."""
    cap = most * sizes.astype(float)
    out, open_, left = np.zeros(len(cap)), np.ones(len(cap), bool), float(total)
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0)
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Integer seats by highest quotients votes / (2 * seats + 1); ties go to the first."""
    votes = votes.astype(float)
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)
    got = np.floor(votes * seats / votes.sum() + 0.5).astype(np.int64)  # a divisor that is nearly right
    gap = int(got.sum()) - seats
    sign = -1 if gap > 0 else 1
    quotient = lambda i: -votes[i] / (2 * got[i] + 1) if gap < 0 else votes[i] / (2 * got[i] - 1) if got[i] else np.inf
    heap = [(quotient(i), sign * i, i) for i in range(len(votes))]
    heapq.heapify(heap)
    for _ in range(abs(gap)):
        i = heap[0][2]
        got[i] += sign
        heapq.heapreplace(heap, (quotient(i), sign * i, i))
    return got


def bounded(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients, where none has more than its `most`; what is above is dealt again."""
    out, open_ = np.zeros(len(votes), np.int64), (most > 0) & (votes > 0)
    left = min(seats, int(most[open_].sum()))
    while left and open_.any():
        got = np.zeros(len(votes), np.int64)
        got[open_] = sainte_lague(votes[open_], left)
        over = open_ & (got > most)
        if not over.any():
            return out + got
        out[over] = most[over]
        left -= int(most[over].sum())
        open_ &= ~over
    return out


def deal(sizes: np.ndarray, total: int, most: int, block: int) -> np.ndarray:
    """Words of `total` for each shard, most * size at most: whole blocks, then the rest where most room is left."""
    room = most * sizes.astype(np.int64)
    out = bounded(sizes, total // block, room // block) * block
    left = min(total, int(room.sum())) - int(out.sum())
    for i in np.argsort(out - room, kind="stable"):
        more = min(left, int(room[i] - out[i]))
        out[i] += more
        left -= more
        if not left:
            break
    return out


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 2, block: int = 512, seed: int = 17, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target and taken to each document.

    size: words (0 for a null text). Sources stand by code point, null last, and weigh `weights` in turn. taken: words
    that the mix takes of the document, `most` times its size at most. The same rows, in any order and partitions,
    give the same result; repeated rows are told apart only where that changes nothing but their order.
    An empty table gives an empty table. Columns of the names added are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    names = docs.columns
    own = [*names, "size", "source_size", "target", "taken"]
    has, shard, at, quota, gap, h1, k1, h2, k2, s2 = (common.free(own, x) for x in ("has_source", "shard", "at", "quota", "source_key", "has_a", "key_a", "has_b", "key_b", "shard_b"))
    order = F.xxhash64(F.lit(seed), F.col(doc), F.md5(F.coalesce(F.col(text), F.lit(""))))
    sized = docs.withColumns({"size": F.size(common.words(F.col(text))).cast("long"), has: F.col(source).isNotNull(), gap: F.coalesce(F.col(source), F.lit("")), at: order})
    rows = sized.groupBy(has, gap).agg(F.sum("size").alias("source_size"))

    def targets(all_: pa.Table) -> pa.Table:
        names_ = list(zip(all_.column("h").to_pylist(), [x.encode() for x in all_.column("k").to_pylist()], strict=True))
        all_ = all_.take(sorted(range(len(names_)), key=lambda i: (not names_[i][0], names_[i][1])))
        sizes = all_.column("source_size").to_numpy()
        votes = np.array([weights[i % len(weights)] for i in range(len(sizes))])
        target = fill(sizes, votes, share * int(sizes.sum()), most)
        words = bounded(target, round(target.sum()), most * sizes)
        shards = np.maximum(sizes // (500 * block), 1)
        return pa.table({"h": all_.column("h"), "k": all_.column("k"), "source_size": sizes, "target": target, "words": words, "shards": shards})

    goal = rows.select(F.lit(0).alias("all"), F.col(has).alias("h"), F.col(gap).alias("k"), "source_size").groupBy("all").applyInArrow(targets, "h boolean, k string, source_size long, target double, words long, shards long")
    number = F.broadcast(goal.select(F.col("h").alias(h1), F.col("k").alias(k1), F.col("shards").alias(shard)))  # as many as sources
    sized = sized.join(number, (F.col(has) == F.col(h1)) & (F.col(gap) == F.col(k1))).drop(h1, k1)
    sized = sized.withColumn(shard, F.pmod(F.col(at), F.col(shard)).cast("long"))
    shards = sized.groupBy(has, gap, shard).agg(F.sum("size").alias("shard_size"))

    def quotas(one: pa.Table) -> pa.Table:
        one = one.sort_by("s")
        quota = deal(one.column("shard_size").to_numpy(), one.column("words")[0].as_py(), most, block)
        return one.select(["h", "k", "s", "source_size", "target"]).append_column("quota", pa.array(quota, pa.int64()))

    parts = shards.select(F.col(has).alias("h"), F.col(gap).alias("k"), F.col(shard).alias("s"), "shard_size").join(goal, ["h", "k"])
    dealt = parts.groupBy("h", "k").applyInArrow(quotas, "h boolean, k string, s long, source_size long, target double, quota long").toDF(h2, k2, s2, "source_size", "target", quota)
    line = Window.partitionBy(has, gap, shard)
    run = line.orderBy(at, doc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past, whole = F.sum("size").over(run), F.sum("size").over(line)
    ends, all_words = common.free(names, "line_end"), common.free(names, "line_size")
    laid = sized.withColumns({ends: past, all_words: whole})
    both = laid.join(dealt, (F.col(has) == F.col(h2)) & (F.col(gap) == F.col(k2)) & (F.col(shard) == F.col(s2)))
    want = F.col(quota)
    rounds = F.when(F.col(all_words) > 0, F.floor(want / F.col(all_words))).otherwise(0)
    rest = want - rounds * F.col(all_words)
    extra = F.least(F.greatest(rest - (F.col(ends) - F.col("size")), F.lit(0)), F.col("size"))
    return both.select(*names, "size", "source_size", "target", (rounds * F.col("size") + extra).cast("long").alias("taken"))


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: how many words of every document a mix of 150 % takes."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
