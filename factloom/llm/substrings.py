"""Removal of passages that other documents hold already, by prefix-partitioned suffix trees cut at a depth.

Every word of the corpus starts a suffix. The suffix tree over all of them is never built whole: suffixes are
split by a variable-length prefix into groups that fit a task's memory, and each group's subtree is built on its
own. The prefix is two words; where more suffixes share two words than a task should hold, it is the whole path
down to the depth that is asked for. A subtree is needed only down to that depth (`window` words), where internal
nodes are the runs of equal path labels: repeats. Consecutive repeats in a document are what deeper nodes would report
as one longer maximal repeat; they are joined when words are marked.

A label is 88 bits: a 64-bit code of its words' codes, and 24 bits from second codes of the words (words have 128-bit
hashes); among 10^13 different suffixes, 0.2 pairs of equal labels are expected. Labels of the words themselves would move 80 bytes for each suffix of 13 words, which is 12 times the input.

How rows move: documents go by ranges of doc_id into buckets of bounded text. A bucket sends each distinct suffix
once, as 10 or 11 bytes, to its prefix group, and gets one bit back: whether a bucket of smaller ids has that
suffix. So a passage in a third of all documents costs a group one label for each bucket, never one for each copy.
Rows of one id that pass a bucket's bound (or have no id) are dealt to several buckets of the same rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .codes import code_words, mix, sort_codes, windows

_CELLS = 1 << 12
_LAST = np.iinfo(np.int64).max


def _suffixes(texts: list[bytes], window: int):
    """Words, and the suffixes that are at least `window` words deep: place, text, code, check, cell of the two-word prefix."""
    coded = code_words(texts)
    place, owner, code = windows(coded.counts, coded.codes, window)
    check = (windows(coded.counts, coded.checks, window, 1)[2] >> np.uint64(40)).astype(np.uint32)
    after = coded.codes[place + 1] if window > 1 else np.uint64(0)
    cell = (mix(coded.codes[place] * np.uint64(3) + after) >> np.uint64(52)).astype(np.int64)
    return coded, place, owner, code, check, cell


def _cells(texts: list[bytes], window: int) -> np.ndarray:
    """How many suffixes each cell has."""
    coded = code_words(texts)
    ends = np.cumsum(coded.counts)
    place = np.arange(len(coded.codes))
    place = place[place + window <= np.repeat(ends, coded.counts)]
    after = coded.codes[place + 1] if window > 1 else np.uint64(0)
    return np.bincount((mix(coded.codes[place] * np.uint64(3) + after) >> np.uint64(52)).astype(np.int64), minlength=_CELLS)


def _pack(codes: np.ndarray, checks: np.ndarray) -> bytes:
    """Labels sorted by code: steps of 7 bytes, or of 8 where a step is too long, then the checks."""
    steps = np.diff(codes, prepend=np.uint64(0))
    wide = 7 if len(steps) and int(steps.max()) < 1 << 56 else 8
    return bytes([wide]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes() + np.ascontiguousarray(checks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = blob[0]
    n = (len(blob) - 1) // (wide + 3)
    raw, check = np.zeros((n, 8), np.uint8), np.zeros((n, 4), np.uint8)
    raw[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, 1).reshape(-1, wide)
    check[:, :3] = np.frombuffer(blob, np.uint8, n * 3, 1 + n * wide).reshape(-1, 3)
    return np.cumsum(raw.reshape(-1).view("<u8"), dtype=np.uint64), check.reshape(-1).view("<u4")


class _Forest:
    """How suffixes go to groups: base[cell] is a cell's first group, over how many groups the whole depth splits it."""

    def __init__(self, counts: np.ndarray, most: int):
        self.split = np.maximum(1, -(-counts // most)).astype(np.int64)
        self.base = np.zeros(_CELLS, np.int64)
        group, held = 0, 0
        for cell, (n, parts) in enumerate(zip(counts.tolist(), self.split.tolist(), strict=True)):
            if held and (parts > 1 or held + n > most):
                group, held = group + 1, 0
            self.base[cell] = group
            if parts > 1:
                group += parts
            else:
                held += n
        self.groups = group + 1

    def of(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.base[cell] + (code % self.split[cell].astype(np.uint64)).astype(np.int64)


def _bucket_suffixes(data: pa.Table, doc: str, text: str, window: int):
    """A bucket's documents in order of id, their suffixes, the distinct labels and cells, and which repeat within the bucket."""
    ids = data.column(doc).fill_null(_LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    data, ids = data.take(order), ids[order]
    coded, place, owner, code, check, cell = _suffixes(common.texts_of(data.column(text)), window)
    order, head = sort_codes(code, check)
    first = order[head]
    which = np.empty(len(code), np.int64)
    which[order] = np.cumsum(head) - 1
    return data, coded, place, code[first], check[first], cell[first], which, ids[owner] > ids[owner[first]][which]


def _cut_text(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words marked, and without what stands between two words that go."""
    turn = np.diff(gone.astype(np.int8), prepend=0, append=0)
    out, at = [], 0
    for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def dedup_substrings(docs: DataFrame, window: int = 13, doc: str = "doc_id", text: str = "text", bucket_bytes: int = 4 << 20, group_suffixes: int = 600_000) -> DataFrame:
    """Adds kept_text, n_words and n_removed to each document.

    Removed is each word covered by a window of `window` words that also starts in a document of smaller id.
    Windows are judged on the input. kept_text keeps the white space around what goes; it is null for a null text.
    A null text has no words. Of rows with the same id none is smaller; a null id is larger than all others.
    An empty table gives an empty table. Columns of the names added are replaced.
    """
    spark = docs.sparkSession
    common.bounded(spark)
    docs = docs.drop("kept_text", "n_words", "n_removed")
    rows = docs.count()
    fine = max(1, rows // max(128, rows // 1_000_000))
    at = [i / fine for i in range(1, fine)]
    found = docs.agg(F.percentile_approx(F.col(doc).cast("long"), at, max(10_000, 20 * fine)).alias("x")).first()[0] if at else []
    found = np.array(found or [], np.int64)
    often = np.unique(found[1:][found[1:] == found[:-1]])  # ids of many rows have a range of their own, as has no id
    marks = np.unique(np.concatenate([found, often + 1, [_LAST]]))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, cells = np.zeros(len(marks) + 1, np.int64), np.zeros(_CELLS, np.int64)
        for batch in batches:
            for some in common.pieces(batch, "t", 1 << 20):
                texts = common.texts_of(some.column("t"))
                range_of = np.searchsorted(marks, some.column("i").fill_null(_LAST).to_numpy(zero_copy_only=False), "right")
                size += np.bincount(range_of, [len(x) + 64 for x in texts], len(size)).astype(np.int64)
                cells += _cells(texts, window)
        for kind, values in ((0, size), (1, cells)):
            keys = np.flatnonzero(values)
            yield pa.record_batch({"kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys), "n": pa.array(values[keys])})
        common.release()

    seen = docs.select(F.col(doc).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(survey, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, at_, n_ = (seen.column(c).to_numpy() for c in ("kind", "key", "n"))
    size, cells = np.zeros(len(marks) + 1, np.int64), np.zeros(_CELLS, np.int64)
    size[at_[kind == 0]], cells[at_[kind == 1]] = n_[kind == 0], n_[kind == 1]
    forest = _Forest(cells, group_suffixes)
    bounds, salts, held = [], {}, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > bucket_bytes:
            bounds.append(marks[i - 1])
            held = 0
        held += n
        one_id = i == len(marks) or 0 < i and marks[i] == marks[i - 1] + 1
        if one_id and n > bucket_bytes:  # held is n here
            salts[len(bounds)] = -(-n // bucket_bytes)
    bounds = np.array(bounds, np.int64)

    @F.arrow_udf("long")
    def bucket_of(x: pa.Array, other: pa.Array) -> pa.Array:
        """A bucket's rank, then its number among those of the same rank."""
        rank = np.searchsorted(bounds, x.fill_null(_LAST).to_numpy(zero_copy_only=False), "right").astype(np.int64)
        salt = np.zeros(len(rank), np.int64)
        for k, n in salts.items():
            salt = np.where(rank == k, other.to_numpy(zero_copy_only=False) % n, salt)
        return pa.array(rank << 20 | salt)

    key = common.free(docs.columns, "bucket")
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = max(least, (len(bounds) + 1 + sum(salts.values())) // 8)
    placed = docs.withColumn(key, bucket_of(F.col(doc).cast("long"), F.xxhash64(F.col(text)))).repartition(parts, key)

    def send(data: pa.Table) -> pa.Table:
        bucket = data.column(key)[0].as_py()
        _, _, _, code, check, cell, _, _ = _bucket_suffixes(data, doc, text, window)
        group = forest.of(cell, code)
        order = np.argsort(group, kind="stable")
        names, starts = np.unique(group[order], return_index=True)
        blobs = [_pack(code[x], check[x]) for x in np.split(order, starts[1:])] if len(names) else []
        return pa.table({"g": pa.array(names, pa.int64()), "b": pa.array([bucket] * len(names), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def meet(data: pa.Table) -> pa.Table:
        """One subtree: labels in order are its leaves, a run of equal labels is a node with more than one leaf."""
        data = data.sort_by("b")
        leaves = [_unpack(x) for x in data.column("blob").to_pylist()]
        sizes = [len(x) for x, _ in leaves]
        rank = np.repeat(data.column("b").to_numpy() >> 20, sizes)
        order, head = sort_codes(np.concatenate([x for x, _ in leaves]), np.concatenate([x for _, x in leaves]))
        rank = rank[order]
        least_ = np.minimum.reduceat(rank, np.flatnonzero(head)) if len(rank) else rank
        repeat = np.zeros(len(rank), bool)
        repeat[order] = rank > least_[np.cumsum(head) - 1]
        bits = [np.packbits(x).tobytes() for x in np.split(repeat, np.cumsum(sizes)[:-1])]
        return pa.table({"b": data.column("b"), "g": data.column("g"), "bits": pa.array(bits, pa.binary())})

    out_schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    carried = docs.columns

    def judge(data: pa.Table, answers: pa.Table) -> pa.Table:
        if not data.num_rows:
            return data.select(carried).append_column("kept_text", pa.array([], pa.string())).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64()))
        data, coded, place, code, _, cell, which, here = _bucket_suffixes(data, doc, text, window)
        group = forest.of(cell, code)
        order = np.argsort(group, kind="stable")
        before = np.zeros(len(code), bool)
        names, starts, sizes = np.unique(group[order], return_index=True, return_counts=True)
        bits = dict(zip(answers.column("g").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for g, a, n in zip(names.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            before[order[a : a + n]] = np.unpackbits(np.frombuffer(bits[g], np.uint8), count=n)
        hit = place[here | before[which]]
        cover = np.zeros(len(coded.codes) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        at = np.concatenate([[0], np.cumsum(coded.counts)])
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[at[1:]] - total[at[:-1]]
        kept = data.column(text).cast(pa.large_binary()).to_pylist()
        for i in np.flatnonzero(removed).tolist():
            a, b = at[i], at[i + 1]
            kept[i] = _cut_text(kept[i], coded.starts[a:b], coded.ends[a:b], gone[a:b])
        out = data.select(carried)
        return out.append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string())).append_column("n_words", pa.array(coded.counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    def sent(data: pa.Table) -> pa.Table:
        out = send(data)
        common.release()
        return out

    def met(data: pa.Table) -> pa.Table:
        out = meet(data)
        common.release()
        return out

    def judged(data: pa.Table, answers: pa.Table) -> pa.Table:
        out = judge(data, answers)
        common.release()
        return out

    leaves = placed.groupBy(key).applyInArrow(sent, "g long, b long, blob binary").repartition(max(least, forest.groups // 8), "g")
    answers = leaves.groupBy("g").applyInArrow(met, "b long, g long, bits binary").repartition(parts, "b")
    return placed.groupBy(key).cogroup(answers.groupBy("b")).applyInArrow(judged, out_schema)


def substring_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's words that no earlier document has in a run of 13."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    out = dedup_substrings(docs, 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(common.words(F.col("kept_text")), " "), 256).alias("kept_sha256"))
