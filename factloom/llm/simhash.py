"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint of 64 bits is masked by each of 2**(r+1) - 1 structured masks. Bit i has a code m(i) of r + 1 bits;
mask v keeps bit i where m(i) and v share an odd number of ones. Any r bits have codes that some v other than zero
is orthogonal to, so two fingerprints that differ in at most r bits agree under some mask: no pair is missed.

A bucket (mask, masked bits) with more fingerprints than a task should pair is masked again by a second and then a
third independent family. Bits left free halve each time, so what the last family leaves is small whatever the
data. Within a bucket only links that join its components leave, fewer than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .codes import mix
from .graph import components, forest

_LANES = np.uint64(0x0101010101010101)


def shingle_codes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text lower-cased in A-Z; fewer words: of them all; none: no shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    past = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    width = min(words, len(parts))
    starts = np.concatenate([[0], past])[: len(parts) - width + 1].tolist()
    ends = (past[width - 1 :] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts, ends)), repeat(42)), np.uint64, len(ends))


def fingerprint(codes: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the codes."""
    ones = np.zeros((8, 8), np.int64)  # [bit within a byte, byte]
    for a in range(0, len(codes), 255):
        some = codes[a : a + 255]
        for k in range(8):
            ones[k] += np.add.reduce((some >> np.uint64(k)) & _LANES).astype("<u8").reshape(1).view(np.uint8)
    set_bits = 2 * ones.T.reshape(-1) > len(codes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, fp (the 64 bits as a long) of each document; a text without words, or null, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_codes(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)) for x in batch.column("t")]
            yield pa.record_batch({"doc": batch.column("doc"), "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("t")).mapInArrow(run, "doc long, fp long")


def masks(radius: int, family: int = 0) -> list[int]:
    """The masks of one family, as signed longs."""
    codes = np.random.Generator(np.random.PCG64(977 + family)).integers(1, 1 << (radius + 1), 64, dtype=np.uint64)
    out = []
    for v in range(1, 1 << (radius + 1)):
        bits = (np.bitwise_count(codes & np.uint64(v)) & 1).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def _bucket_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of one bucket."""
    if len(fps) == 2:
        near = int(np.bitwise_count(fps[0] ^ fps[1])) <= radius
        return (fps[1:], fps[:1]) if near else (fps[:0], fps[:0])
    some: list[np.ndarray] = []
    for a in range(0, len(fps), 512):
        near = np.bitwise_count(fps[a : a + 512, None] ^ fps[None, a:]) <= radius
        i, j = np.nonzero(np.triu(near, 1))
        some.append(np.stack(forest(fps[a + i], fps[a + j])))
    return forest(*np.concatenate(some, axis=1))


def _links_in_buckets(keyed: DataFrame, radius: int, most: int | None) -> DataFrame:
    """kind 0: a link (a, b). kind 1: fingerprint b of bucket a, which has more than `most` fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: int, parts: list[np.ndarray], over: bool) -> None:
            fps = np.concatenate(parts) if len(parts) > 1 else parts[0]
            if over:
                out.append((np.ones(len(fps), np.int32), np.full(len(fps), key, np.int64), fps.view(np.int64)))
            elif len(fps) > 1:
                a, b = _bucket_links(fps, radius)
                out.append((np.zeros(len(a), np.int32), a.view(np.int64), b.view(np.int64)))

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key, parts, held, over = None, [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            sure = np.ones(len(starts), bool)  # buckets that begin and end in this batch
            sure[[0, -1]] = False
            pairs = np.flatnonzero(sure & (ends - starts == 2))
            a, b = fps[starts[pairs]], fps[starts[pairs] + 1]
            near = np.bitwise_count(a ^ b) <= radius
            out.append((np.zeros(int(near.sum()), np.int32), a[near].view(np.int64), b[near].view(np.int64)))
            for s in np.flatnonzero(~sure | (ends - starts > 2)).tolist():
                this = int(keys[starts[s]])
                if this != key:
                    if parts:
                        close(key, parts, over)
                    key, parts, held, over = this, [], 0, False
                parts.append(fps[starts[s] : ends[s]])
                held += len(parts[-1])
                if most and held > most:
                    over = True
                    close(key, parts, True)
                    parts = []
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["kind", "a", "b"])
            out.clear()
        if parts:
            close(key, parts, over)
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["kind", "a", "b"])

    n = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "kind int, a long, b long")


def links(fps: DataFrame, radius: int = 4, most: int = 2048) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) that differ in `radius` bits or fewer."""
    found = []
    keyed = fps.select("fp", F.lit(0).cast("long").alias("key"))
    for family in range(3):
        chosen = masks(radius, family)
        keys = F.array(*[F.xxhash64(F.lit(i), F.col("key"), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(chosen)])
        keyed = keyed.select("fp", F.explode(keys).alias("key"))
        step = common.cut(_links_in_buckets(keyed, radius, most if family < 2 else None))
        found.append(step.where("kind = 0").select("a", "b"))
        keyed = step.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if keyed.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, fp, component: the smallest id that a document reaches over links between near fingerprints.

    Texts without words, and null texts, have fingerprint zero, which links like any other. A row without an id is
    linked but never names a component; a component of such rows alone has a null id. Repeated rows stay repeated.
    Up to 200,000 distinct fingerprints are broadcast with their components; beyond that rows are joined by
    fingerprint (AQE splits what many copies share).
    """
    common.bounded(docs.sparkSession)
    rows = common.cut(fingerprints(docs, shingle, doc, text))
    fps = common.cut(rows.groupBy("fp").agg(F.min("doc").alias("least")))
    joined = components(links(fps, radius))
    named = joined.join(fps, F.col("node") == F.col("fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of = named.join(least, "root").select("fp", "component")
    of = fps.join(of, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(common.small(common.cut(of)), "fp")


_PARITIES = 1024


def _frequent(texts: DataFrame, shingle: int, sample: int = 4000, most: int = 100_000) -> np.ndarray:
    """Codes of shingles frequent in a sample of the distinct texts (column t), rarest first.

    They only serve to put frequent shingles last in the order of prefixes. Any order gives the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.pieces(batch, "t", 1 << 21):
                codes = [np.unique(shingle_codes(x, shingle)) for x in common.texts_of(some.column("t"))]
                yield pa.record_batch({"code": pa.array(np.concatenate(codes).view(np.int64))})

    rate = max(texts.count() // sample, 1)
    some = texts.where(F.pmod(F.xxhash64(F.lit(91), "t"), F.lit(rate)) == 0).distinct()
    found = some.mapInArrow(run, "code long").groupBy("code").count().where("count > 2").orderBy(F.desc("count"), "code").limit(most)
    return found.toArrow().column("code").to_numpy().view(np.uint64)[::-1]


def _prefix(codes: np.ndarray, often: np.ndarray, rank: np.ndarray, p: int, q: int) -> np.ndarray:
    """The first codes of a set, so many that two sets of similarity p / q or more share one; none if only equal sets are."""
    n = len(codes)
    if (q - p) * (n + n * q // p) < q + p:
        return codes[:0]
    late = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, codes), len(often) - 1)
        late = np.where(often[at] == codes, 1 + rank[at], 0)
    return codes[np.lexsort((codes, late))[: n + 1 + -p * n // q]]


def _parities(codes: np.ndarray, cells: int = _PARITIES) -> bytes:
    """Parities of the counts of codes in each of `cells` (a power of 2): two sets differ in no fewer codes than parities."""
    ones = np.bincount((codes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(ones.astype(np.uint8)).tobytes()


def _wide(codes: np.ndarray) -> bytes:
    """Parities in as many cells as there are codes, or up to twice as many; empty for a set that has enough in _PARITIES."""
    return b"" if len(codes) <= _PARITIES else _parities(codes, 1 << (len(codes) - 1).bit_length())


def _may(n: np.ndarray, bits: np.ndarray, m: np.ndarray, other: np.ndarray, p: int, q: int) -> np.ndarray:
    """False only where sets of n and m codes, with these parities, cannot have similarity p / q."""
    differ = np.bitwise_count(bits ^ other).sum(axis=1, dtype=np.int64)
    return (np.minimum(n, m) * q >= np.maximum(n, m) * p) & (differ * (q + p) <= (q - p) * (n + m))


def _may_wide(n: int, wide: bytes, m: int, other: bytes, p: int, q: int) -> bool:
    """The same for wide parities; the longer ones are folded to as many cells as the others have."""
    if not wide or not other:
        return True
    x, y = np.frombuffer(wide, np.uint8), np.frombuffer(other, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (q + p) <= (q - p) * (n + m)


def _meetings(placed: DataFrame, p: int, q: int, turn: int | None = None) -> DataFrame:
    """Pairs (a < b) that may be similar, of different components, within each (key, i, j) of rows sorted by these.

    Where i <> j, the rows are two blocks of a large bucket, and a pair has a row of each. Repeated rows do no harm.
    turn: each row gives but one pair, with the row that this turn's order of all nodes puts first; else all pairs.
    """

    def pairs(data: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, root, n, i, j, own = (data.column(x).to_numpy() for x in ("node", "root", "n", "i", "j", "own"))
        bits = np.frombuffer(b"".join(data.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
        order = None if turn is None else mix(node.view(np.uint64) ^ mix(np.array([turn], np.uint64)))
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            for at in range(s, e, 256):
                past = min(at + 256, e)
                able = root[at:past, None] != root[None, s:e]
                if order is None:
                    able &= node[at:past, None] < node[None, s:e]
                able &= np.minimum(n[at:past, None], n[None, s:e]) * q >= np.maximum(n[at:past, None], n[None, s:e]) * p
                if i[s] != j[s]:
                    able &= own[at:past, None] != own[None, s:e]
                x, y = np.nonzero(able)
                x, y = x + at, y + s
                near = _may(n[x], bits[x], n[y], bits[y], p, q)
                x, y = x[near], y[near]
                if order is not None and len(x):
                    heads = np.flatnonzero(np.diff(x, prepend=-1))
                    best = order[y] == np.repeat(np.minimum.reduceat(order[y], heads), np.diff(np.append(heads, len(x))))
                    x, y = x[best], y[best]
                yield pa.record_batch({"a": pa.array(np.minimum(node[x], node[y])), "b": pa.array(np.maximum(node[x], node[y]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key, i, j = (data.column(x).to_numpy() for x in ("key", "i", "j"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(cuts):
                yield from pairs(data.slice(0, int(cuts[-1])), np.concatenate([[0], cuts[:-1]]), cuts)
                rest = data.slice(int(cuts[-1]))
            else:
                rest = data
        if rest is not None:
            yield from pairs(rest, np.array([0]), np.array([rest.num_rows]))

    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return placed.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _by_fingerprint(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (a < b) that join all nodes (node, fp) whose fingerprints differ in `radius` bits or fewer, by covering LSH.

    Of nodes with one fingerprint each is paired with the smallest, and the smallest ones stand for linked fingerprints.
    """
    least = common.cut(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    linked = links(least.select("fp"), radius)
    same = nodes.join(common.small(least), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = linked.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return same.unionByName(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _similar(keyed: DataFrame, nodes: DataFrame, judged: Callable[[DataFrame], DataFrame], p: int, q: int, most: int = 2048) -> DataFrame:
    """node, root: components over all pairs of nodes (node, n, fp, bits, wide) that judged() keeps. keyed: node, key of prefixes.

    Covering SimHash proposes the pairs of near fingerprints. Its radius does not reach all pairs of similarity p / q,
    so an exact way follows for the rest: two such sets share a code of their prefixes and meet in that code's bucket.
    Each node is judged against one smallest node that it meets. Then, as long as that joins many, each node is judged against one node
    of another component, so a large group of copies costs its size and not its square. At last all pairs of a bucket
    that are not in one component yet are proposed. Buckets with more rows than `most` are cut in blocks that meet in pairs.
    """
    spark = nodes.sparkSession
    met = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("c")).where("lead < last")
    shared = common.cut(keyed.join(met, "key").select("key", "lead", "c", "node"))
    common.sweep(spark)
    about = nodes.select("node", "n", "bits", "wide")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint64).reshape(-1, _PARITIES // 64) for x in ("bits", "bits2")]
            near = _may(batch.column("n").to_numpy(), bits[0], batch.column("n2").to_numpy(), bits[1], p, q)
            some = batch.filter(pa.array(near))
            near = [_may_wide(n, x, m, y, p, q) for n, x, m, y in zip(*(some.column(c).to_pylist() for c in ("n", "wide", "n2", "wide2")), strict=True)]
            yield some.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def possible(pairs: DataFrame) -> DataFrame:
        both = pairs.join(about.withColumnRenamed("node", "a"), "a").join(about.toDF("b", "n2", "bits2", "wide2"), "b")
        return common.cut(both.mapInArrow(may, "a long, b long"))

    leads = shared.where("node <> lead").groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("a"))
    tried = possible(_by_fingerprint(nodes.select("node", "fp")).unionByName(leads).distinct())
    found = common.cut(judged(tried))
    blocks = F.ceil(F.col("c") / most).cast("int")
    turn: int | None = 0
    while True:
        common.sweep(spark)
        roots = common.cut(components(found))
        rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        placed = rooted.join(mixed, "key").join(about.drop("wide"), "node").withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        placed = placed.select("key", "node", "root", "n", "bits", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        more = possible(_meetings(placed, p, q, turn).join(tried, ["a", "b"], "left_anti"))
        new = common.cut(judged(more))
        found, tried = found.unionByName(new), tried.unionByName(more)
        if turn is None:
            return components(found)
        turn = turn + 1 if turn < 5 and new.count() > 0.05 * nodes.count() else None


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """a, salt, node and the set of codes of text t; a task gives each (a, salt, node) once."""
    seen: set[tuple[int, int, int]] = set()
    held, codes = None, b""
    for batch in batches:
        for some in common.pieces(batch, "t", 1 << 21):
            fresh, out = [], []
            for i, (at, x) in enumerate(zip(zip(*(some.column(c).to_pylist() for c in ("a", "salt", "node")), strict=True), common.texts_of(some.column("t")), strict=True)):
                if at in seen:
                    continue
                seen.add(at)
                if x != held:
                    held, codes = x, np.unique(shingle_codes(x, shingle)).tobytes()
                fresh.append(i)
                out.append(codes)
            rows = some.select(["a", "salt", "node"]).take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], ["a", "salt", "node", "codes"])


def _judge(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of similarity p / q. Rows come by (a, salt), the set of a itself first, then of its partners."""
    at, lead, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        a_s, b_s = [], []
        for a, salt, node, codes in zip(*(batch.column(c) for c in ("a", "salt", "node", "codes")), strict=True):
            a, salt, node = a.as_py(), salt.as_py(), node.as_py()
            if (a, salt) != at:
                at, last = (a, salt), None
            if node == a:
                lead = np.frombuffer(codes.as_py(), np.uint64)
            elif node != last:
                other = np.frombuffer(codes.as_buffer(), np.uint64)
                both = len(np.intersect1d(lead, other, assume_unique=True))
                if both * q >= p * (len(lead) + len(other) - both):
                    a_s.append(a)
                    b_s.append(node)
            last = node
        yield pa.record_batch({"a": pa.array(a_s, pa.int64()), "b": pa.array(b_s, pa.int64())})


def _grouped(docs: DataFrame, shingle: int, similarity: float, most: int, doc: str, text: str) -> DataFrame:
    """doc, digest (of the text), node (null without words), first: of its group the smallest id, then digest; no id is last."""
    spark = docs.sparkSession
    common.bounded(spark)
    ratio = Fraction(similarity).limit_denominator(1000)
    p, q = ratio.numerator, ratio.denominator
    often = _frequent(docs.select(F.col(text).alias("t")), shingle)
    order = np.argsort(often)
    late = spark.sparkContext.broadcast((often[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        seen: set[int] = set()  # equal sets of a task send their bits and prefix once
        for batch in batches:
            for some in common.pieces(batch, "t", 1 << 21):
                node, n, fp, bits, wide, prefix = [], [], [], [], [], []
                for x in common.texts_of(some.column("t")):
                    codes = np.unique(shingle_codes(x, shingle))
                    node.append(xxhash.xxh3_64_intdigest(codes.tobytes()))
                    n.append(len(codes))
                    fp.append(None if node[-1] in seen else fingerprint(codes))
                    bits.append(None if node[-1] in seen else _parities(codes))
                    wide.append(None if node[-1] in seen else _wide(codes))
                    prefix.append(codes[:0] if node[-1] in seen else _prefix(codes, *late.value, p, q))
                    seen.add(node[-1])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix).view(np.int64)))
                made = [pa.array(np.array(node, np.uint64).view(np.int64), mask=np.array(n) == 0), pa.array(n, pa.int64()), pa.array(np.array([x or 0 for x in fp], np.uint64).view(np.int64), mask=np.array([x is None for x in fp], bool)), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), codes]
                yield pa.RecordBatch.from_arrays([*(some.column(x) for x in ("doc", "digest")), *made], ["doc", "digest", "node", "n", "fp", "bits", "wide", "prefix"])

    texts = docs.select(F.col(doc).cast("long").alias("doc"), _digest(text).alias("digest"), F.col(text).alias("t"))
    rows = common.cut(texts.mapInArrow(run, "doc long, digest binary, node long, n long, fp long, bits binary, wide binary, prefix array<long>"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "digest")).alias("least"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bits").alias("bits"), F.max("wide").alias("wide"))
    nodes = common.cut(nodes)
    named = nodes.select("node", F.col("least.doc").alias("doc"), F.col("least.digest").alias("digest"))

    def judged(pairs: DataFrame) -> DataFrame:
        """Sets are made where the texts lie; each goes to its lead's task, and a lead of many partners has several."""
        counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("salts"))
        salted = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
        sides = salted.select("a", "salt", F.col("b").alias("node")).unionByName(salted.select("a", "salt", F.col("a").alias("node")).distinct())
        sides = common.small(common.cut(sides.join(named, "node")))
        found = texts.join(sides.withColumnsRenamed({"doc": "own", "digest": "own_digest"}), (F.col("digest") == F.col("own_digest")) & F.col("doc").eqNullSafe(F.col("own"))).select("a", "salt", "node", "t")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        sets = found.mapInArrow(lambda x: _sets(x, shingle), "a long, salt long, node long, codes binary").repartition(parts, "a", "salt")
        return sets.sortWithinPartitions("a", "salt", F.col("node") != F.col("a"), "node").mapInArrow(lambda x: _judge(x, p, q), "a long, b long")

    joined = common.cut(_similar(rows.select("node", F.explode("prefix").alias("key")), nodes, judged, p, q, most))
    least = joined.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("first"))
    of = joined.join(least, "root").select("node", "first")
    of = nodes.join(of, "node", "left").select("node", F.coalesce("first", "least").alias("first"))
    return rows.select("doc", "digest", "node").join(of, "node", "left")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 2048, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, component: groups of documents whose sets of word shingles have a Jaccard similarity of `similarity` or more.

    Covering SimHash (fingerprints of the distinct shingle codes) links texts of near fingerprints, and an exact way for
    the rest follows. Pairs are complete: of any two sets so similar the first fifth of codes (rarest first) share one, and buckets of
    one code propose all their pairs but those already joined, those of too different sizes and those whose parities
    differ too much. The whole sets of distinct shingle codes judge them, as integer counts. Only texts
    with equal sets (a digest of 64 bits) go unjudged. Texts without words form no groups. Rows without an id join groups but
    name none.
    """
    found = _grouped(docs, shingle, similarity, most, doc, text)
    return found.select("doc", F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("first.doc")).alias("component"))


def without_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies the document of smallest id; of repeated ids one row.

    A group without ids keeps the row whose text has the smallest digest, one of equal rows. Rows without id and
    without words are in no group and stay.
    """
    found = common.cut(_grouped(docs, 5, 0.8, 2048, doc, text))
    common.sweep(docs.sparkSession)
    first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("digest") == F.col("first.digest"))
    names = docs.columns
    id_, digest_ = common.free(names, "gone"), common.free(names, "gone_digest")
    gone = common.small(common.cut(found.where(F.col("node").isNotNull() & ~first).select(F.col("doc").alias(id_), F.col("digest").alias(digest_)).distinct()))
    own, at = common.free(names, "own_digest"), common.free(names, "at")
    kept = docs.withColumn(own, _digest(text)).join(gone, F.col(doc).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest_)), "left_anti")
    ids = found.agg(F.count("doc"), F.countDistinct("doc")).first()
    same = found.where(F.col("doc").isNull() & F.col("node").isNotNull() & first).groupBy("digest").count().where("count > 1")
    if ids[0] != ids[1] or not same.isEmpty():
        no_words = F.col(doc).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
        line = Window.partitionBy(doc, F.when(F.col(doc).isNull(), F.col(own))).orderBy(own, F.to_json(F.struct(*[F.col(f"`{x}`") for x in names])))
        one = kept.where(~no_words).withColumn(at, F.row_number().over(line)).where(F.col(at) == 1).drop(at)
        kept = one.unionByName(kept.where(no_words))
    return kept.drop(own)


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprint and component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
