"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters and digits, lower-cased; its bag holds its character n-grams (three to five bytes, with
the word's borders) and the word itself, hashed to rows of an embedding table. The mean of a bag's embeddings goes
into a linear softmax of two classes. A document is as toxic as its worst word, so that one word in a long text
counts as much as in a short one; labels are of whole documents, so training pools words softly at first and ever
harder later, and embeddings and softmax move together. Misspelled variants of the words that carry a document's
label are trained on too; unseen ones share n-grams with them.

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
from .codes import spans, sums
from .quality import labelled, remainder

BITS, WIDTH, ORDERS = 17, 8, (3, 4, 5)
_PLAIN = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _PLAIN[_a:_b] = np.arange(_a, _b)


def plain(text: str | None) -> bytes:
    """Lower-cased, with a space for every character that is not a letter or digit."""
    return _PLAIN[np.frombuffer((text or "").lower().encode(), np.uint8)].tobytes()


def _grams(buffer: np.ndarray, first: np.ndarray, past: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: rows for every place of the buffer, and the first place and the one past the last for each word.

    The buffer begins and ends with a space. The last order given is the whole word.
    """
    shift, odd = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    wide = buffer.astype(np.uint64) + np.uint64(1)
    code = wide.copy()
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint64(0x100000001B3) + wide[n - 1 :]
        if n in ORDERS:
            rows = ((code * odd) ^ (code >> np.uint64(29))) * odd >> shift
            yield rows.astype(np.int32), np.minimum(first - 1, len(rows)), np.minimum(np.maximum(first - 1, past + 2 - n), len(rows))
    value = sums(wide, first, past, np.uint64(0x100000001B3))
    length = past - first
    yield (((value ^ length.astype(np.uint64)) * odd) >> shift).astype(np.int32), np.arange(len(first)), np.arange(1, len(first) + 1)


@dataclass
class Model:
    """weights: an embedding row's share in the log-odds (embedding times the softmax's difference)."""

    weights: np.ndarray
    bias: float

    def words(self, buffer: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Log-odds of each word."""
        total, count = np.zeros(len(first)), np.zeros(len(first))
        for rows, a, b in _grams(buffer, first, past):
            run = np.concatenate([[0.0], np.cumsum(self.weights[rows], dtype=np.float64)])
            total += run[b] - run[a]
            count += b - a
        return total / np.maximum(count, 1) + self.bias

    def texts(self, texts: list[bytes], piece: int = 1 << 19) -> np.ndarray:
        """Probability for each plain text."""
        out = np.full(len(texts), self.bias)
        at = 0
        while at < len(texts):
            last, held = at, 0
            while last < len(texts) and (last == at or held + len(texts[last]) < piece):
                held += len(texts[last]) + 1
                last += 1
            buffer = np.frombuffer(b" " + b" ".join(texts[at:last]) + b" ", np.uint8)
            offsets = np.concatenate([[1], 1 + np.cumsum([len(x) + 1 for x in texts[at:last]])])
            first, past = spans(buffer)
            if len(first):
                odds = np.concatenate([self._long(buffer, first[i : i + (1 << 18)], past[i : i + (1 << 18)]) for i in range(0, len(first), 1 << 18)])
                owner = np.searchsorted(offsets, first, "right") - 1
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                worst = np.maximum.reduceat(odds, heads)
                out[at + owner[heads]] = worst
            at = last
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    def _long(self, buffer: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        low = int(first[0]) - 1
        return self.words(buffer[low : int(past[-1]) + 1], first - low, past - low)


def _variants(word: str, rng: np.random.Generator) -> str:
    """A misspelling: a letter doubled, dropped, swapped with the next, or replaced."""
    at, how = int(rng.integers(1, max(2, len(word) - 1))), int(rng.integers(4))
    if how == 0:
        return word[:at] + word[at - 1] + word[at:]
    if how == 1:
        return word[:at] + word[at + 1 :]
    if how == 2 and at + 1 < len(word):
        return word[:at] + word[at + 1] + word[at] + word[at + 2 :]
    return word[:at] + chr(97 + int(rng.integers(26))) + word[at + 1 :]


def fit(docs: list[list[str]], labels: np.ndarray, rounds: int = 110, rate: float = 0.25) -> Model:
    """docs: distinct words of each; labels: 0 or 1. One class only gives a model that scores all alike."""
    labels = np.asarray(labels, float)
    if not 0 < labels.sum() < len(labels):
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.Generator(np.random.PCG64(11))
    vocabulary: dict[str, int] = {}
    held = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in x], np.int64) for x in docs]
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, WIDTH).astype(np.float32)  # softmax weight of class 1 less that of class 0
    bias, seen, seen_out = -2.0, np.full((1 << BITS, WIDTH), 1e-4, np.float32), np.full(WIDTH, 1e-4, np.float32)

    def bags() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buffer = np.frombuffer(b" " + " ".join(vocabulary).encode() + b" ", np.uint8)
        first, past = spans(buffer)
        rows, owner = [], []
        for r, a, b in _grams(buffer, first, past):
            n = b - a
            rows.append(r[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))])
            owner.append(np.repeat(np.arange(len(n)), n))
        owner_ = np.concatenate(owner)
        return np.concatenate(rows), owner_, np.bincount(owner_, minlength=len(vocabulary)).astype(np.float32)

    def lay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = [i for i in range(len(held)) if len(held[i])]
        return np.concatenate([held[i] for i in full]), np.cumsum([0, *[len(held[i]) for i in full]])[:-1], np.array(full)

    (rows, owner, size), (flat, heads, full) = bags(), lay()
    for turn in range(rounds):
        if turn == rounds // 2:  # misspellings of the words that carry a label
            odds = np.bincount(owner, (table @ out)[rows], len(vocabulary)) / size + bias
            names, more = list(vocabulary), []
            for i in np.flatnonzero(labels > 0):
                if len(held[i]):
                    worst = int(held[i][np.argmax(odds[held[i]])])
                    if odds[worst] > 1 and len(names[worst]) > 3:
                        more += [_variants(names[worst], rng) for _ in range(2)]
            clean = {int(w) for i in np.flatnonzero(labels == 0) for w in held[i]}
            more = [w for w in more if w.isalnum() and vocabulary.get(w, -1) not in clean]
            held += [np.array([vocabulary.setdefault(w, len(vocabulary))]) for w in more]
            labels = np.concatenate([labels, np.ones(len(more))])
            (rows, owner, size), (flat, heads, full) = bags(), lay()
        hard = min(30.0, 1.0 + 30.0 * turn / (0.5 * rounds))
        odds = np.bincount(owner, (table @ out)[rows], len(vocabulary)) / size + bias
        mine = odds[flat]
        counts = np.diff(np.append(heads, len(flat)))
        top = np.maximum.reduceat(mine, heads)
        soft = np.exp(hard * (mine - np.repeat(top, counts)))
        pool = np.add.reduceat(soft, heads)
        soft /= np.repeat(pool, counts)
        doc = np.add.reduceat(soft * mine, heads)
        y = labels[full]
        error = (1 / (1 + np.exp(-np.clip(doc, -35, 35))) - y) * np.where(y > 0, (len(y) - y.sum()) / max(1, y.sum()), 1.0) ** 0.5
        error /= len(y)
        pull = np.bincount(flat, soft * np.repeat(error, counts), len(vocabulary)) / size
        share = np.bincount(rows, pull[owner], 1 << BITS).astype(np.float32)
        touched = np.flatnonzero(share)
        move = share[touched, None] * out * 1e3 + 1e-4 * table[touched]
        slope = (share @ table) * 1e3 * 0.02
        seen[touched] += move * move
        seen_out += slope * slope
        table[touched] -= rate * move / np.sqrt(seen[touched])
        out -= 0.1 * rate * slope / np.sqrt(seen_out)
        bias -= 0.5 * float(error.sum())
    return Model((table @ out).astype(np.float32), bias)


def train(labels: DataFrame, docs: DataFrame, learn, most_rows: int = 5000) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(set(plain(x).decode(errors="ignore").split())) for x in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "words": pa.array(lists, pa.list_(pa.string()))})

    some = labelled(labels, docs, "toxic", learn, most_rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    found = some.mapInArrow(run, "doc_id long, label int, words array<string>").toArrow().sort_by("doc_id").slice(0, most_rows)
    return fit(found.column("words").to_pylist(), found.column("label").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds toxicity (0 to 1) to each document; a text without words, or null, gets the score of the bias alone.

    Only the text counts, so repeated rows and rows without an id are scored like any other. An empty table gives an empty
    table. A column named toxicity is replaced; other columns are carried along, whatever their names.
    """
    common.bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    carried = [c for c in docs.columns if c.lower() != "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.texts([plain(x) for x in some.column("text").to_pylist()]) for some in common.pieces(batch, "text", 1 << 20)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(scores, pa.float64())], [*carried, "toxicity"])

    return docs.mapInArrow(run, docs.select(*carried).schema.add("toxicity", "double"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: toxicity of every document, learned from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(common.table(spark, sf_dir, "labels"), docs, remainder(3) != 1)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
