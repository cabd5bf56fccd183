"""Quality classifier: Naive Bayes support vectors.

A text becomes indicators of hashed n-grams: words, runs of one to three word shapes (case, digits, last mark, length,
whether the word before is the same) and runs of three bytes. An indicator is scaled by its class log-count ratio,
a text's vector has length one, and a hinge-loss linear model is fitted to the scaled vectors by dual coordinate
descent. Margins of rows that a model has not seen give the sigmoid that turns a margin into a probability.

The fit takes `most_rows` labelled rows at most, those of lowest hash of id; every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .codes import code_words, mix, windows

BITS = 18
_KIND = np.full(256, 0, np.uint64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3


def _shapes(buffer: np.ndarray, first: np.ndarray, past: np.ndarray, codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A code of what each word looks like; heads: which words begin a text."""
    kind = _KIND[buffer]
    count = lambda k: (total := np.concatenate([[0], np.cumsum(kind == k)]))[past] - total[first]
    length, upper, digits, marks = past - first, count(2), count(3), count(0)
    last = np.where(kind[past - 1] == 0, buffer[past - 1].astype(np.uint64), kind[past - 1])
    bins = np.searchsorted([2, 4, 8, 13, 25], length, "right")
    again = np.concatenate([[False], codes[1:] == codes[:-1]])[: len(codes)] & ~heads
    out = np.zeros(len(first), np.uint64)
    for part, of in ((kind[first], 4), (last, 256), (upper == length, 2), (digits > 0, 2), (np.minimum(marks, 3), 4), (bins, 6), (again, 2)):
        out = out * np.uint64(of) + part.astype(np.uint64)
    return mix(out + np.uint64(1 << 40))


def features(texts: list[bytes], piece: int = 1 << 19) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text."""
    stamp = np.zeros(1 << BITS, np.int64)
    shift = np.uint64(64 - BITS)
    at = 0
    while at < len(texts):
        last, held = at, 0
        while last < len(texts) and (last == at or held + len(texts[last]) < piece):
            held += len(texts[last]) + 1
            last += 1
        some = texts[at:last]
        coded = code_words(some)
        offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in some])])
        buffer = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
        bounds = np.concatenate([[0], np.cumsum(coded.counts)])
        base = np.repeat(offsets[:-1], coded.counts)
        heads = np.zeros(len(base) + 1, bool)
        heads[bounds] = True
        shapes = _shapes(buffer, coded.starts + base, coded.ends + base, coded.codes, heads[:-1]) if len(base) else np.zeros(0, np.uint64)
        families = [((coded.codes * np.uint64(0x9E3779B97F4A7C15)) >> shift, bounds)]
        for n in (1, 2, 3):
            _, owner, code = windows(coded.counts, shapes, n)
            families.append(((code + np.uint64(n) * np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15) >> shift, np.searchsorted(owner, np.arange(len(some) + 1))))
        wide = np.concatenate([buffer, [10, 10]]).astype(np.uint32)
        three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
        families.append(((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), offsets))
        for i in range(len(some)):
            ids = np.concatenate([x[b[i] : b[i + 1]] for x, b in families]).astype(np.int64)
            if not some[i]:
                ids = ids[:0]
            turn = np.arange(len(ids))
            stamp[ids] = turn
            yield ids[stamp[ids] == turn].astype(np.int32)
        at = last


@dataclass
class Model:
    """weights: of indicators, scaled by their ratios; a, b: margin to log-odds."""

    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum()) / max(1.0, self.norm(ids)) + self.bias

    def norm(self, ids: np.ndarray) -> float:
        return float(np.sqrt(self.squares[ids].sum()))

    squares: np.ndarray = None

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(ids) + self.b, -35, 35))))


def _fit_hinge(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, rounds: int = 12, alpha: float = 1.0) -> Model:
    """y is 1 or -1. Log-count ratios, then dual coordinate descent on the L1 hinge loss with balanced classes."""
    counts = {}
    for k in (1, -1):
        total = np.zeros(1 << BITS)
        for ids, label in zip(rows, y, strict=True):
            if label == k:
                total[ids] += 1
        counts[k] = total + alpha
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    squares = ratio * ratio
    norms = [max(1.0, float(np.sqrt(squares[ids].sum()))) for ids in rows]
    values = [(ratio[ids] / n).astype(np.float32) for ids, n in zip(rows, norms, strict=True)]
    diagonal = np.array([float(v @ v) + 1 for v in values])
    share = {k: c * len(y) / max(1, 2 * int((y == k).sum())) for k in (1, -1)}
    w, bias, dual = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(y))
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            ids, v = rows[i], values[i]
            gradient = y[i] * (float(w[ids] @ v) + bias) - 1
            new = min(max(dual[i] - gradient / diagonal[i], 0.0), share[y[i]])
            step = (new - dual[i]) * y[i]
            if step:
                w[ids] += np.float32(step) * v
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model((w * ratio).astype(np.float32), bias, 1.0, 0.0, squares.astype(np.float32))


def _sigmoid_of(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's fit of log-odds a * margin + b by Newton steps."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, h = p - goal, p * (1 - p) + 1e-9
        g = np.array([d @ margins, d.sum()]) + 1e-3 * np.array([a, 0])
        hess = np.array([[h @ (margins**2) + 1e-3, h @ margins], [h @ margins, h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-7:
            break
    return a, b


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """labels: 0 or 1. One class only, or no rows, gives a model that scores all alike."""
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), np.zeros(1 << BITS, np.float32))
    folds, margins = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        inside = np.flatnonzero(folds != k)
        if len(set(y[inside].tolist())) < 2:
            continue
        part = _fit_hinge([rows[i] for i in inside], y[inside])
        for i in np.flatnonzero(folds == k):
            margins[i] = part.margin(rows[i])
    model = _fit_hinge(rows, y)
    model.a, model.b = _sigmoid_of(margins, y)
    return model


def labelled(labels: DataFrame, docs: DataFrame, label: str, learn, most_rows: int) -> DataFrame:
    """doc_id, text, label of the `most_rows` labelled ids of lowest hash that `learn` lets in; a null label is none.

    An id that repeats counts once, with the greatest of its labels and the least of its texts.
    """
    first = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    some = first.where(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bounded by most_rows
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string")) % by


def train(labels: DataFrame, docs: DataFrame, learn, most_rows: int = 4000) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(list(features(common.texts_of(batch.column("text")))), pa.list_(pa.int32()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "ids": ids})

    some = labelled(labels, docs, "quality", learn, most_rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    found = some.mapInArrow(run, "doc_id long, label int, ids array<int>").toArrow()
    lists = found.column("ids").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")[:most_rows]
    rows = [flat[ends[i] : ends[i + 1]] for i in order.tolist()]
    return fit(rows, found.column("label").to_numpy()[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds quality (0 to 1) to each document; an empty or null text gets the score of no features.

    Only the text counts, so repeated rows and rows without an id are scored like any other. An empty table gives an empty
    table. A column named quality is replaced; other columns are carried along, whatever their names.
    """
    common.bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    carried = [c for c in docs.columns if c.lower() != "quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(x) for x in features(common.texts_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(scores, pa.float64())], [*carried, "quality"])

    schema = docs.select(*carried).schema.add("quality", "double")
    return docs.mapInArrow(run, schema)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality of every document, learned from rows whose crc32(doc_id) mod 5 is not 0."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(common.table(spark, sf_dir, "labels"), docs, remainder(5) != 0)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
