"""Language identification by fusing evidence in Bayes' rule.

Log-odds of a row's language are the sum of
- the text's likelihood: byte-trigram models, one for each language, counted over all documents whose language is
  given; a long text's trigrams repeat each other, so their sum is scaled to that of `most` trigrams;
- the declared language's likelihood (of the mark-up or a column) and the address suffix's, each from a confusion
  table that grouped aggregation fills with the texts' own posteriors, smoothed towards agreement;
- the host's prior: posteriors summed by host, by domain, by suffix and over all, each level smoothed by the one
  above. A row's own posterior is taken out of the sums of every level, so its text counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .toxicity import plain

LANGUAGES = ("en", "de", "fr", "es")
_CELLS = 1 << 15
#: Which language a country's suffix speaks for.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es"}


_NO_DIGITS = bytes(32 if 48 <= b < 58 else b for b in range(256))


def _letters(text: str | None) -> bytes:
    return plain(text).translate(_NO_DIGITS)


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams that do not span two words, and each text's first cell. A text has a space before and behind it."""
    buffer = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8).astype(np.uint32)
    begins = 2 + np.cumsum([0, *[len(x) + 2 for x in texts]])[:-1]
    a, b, c = buffer[:-2], buffer[1:-1], buffer[2:]
    code = ((a | b << np.uint32(8) | c << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    use = np.flatnonzero((b != 32) & ~((a == 32) & (c == 32)))
    return code[use], np.searchsorted(use, begins - 1)


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Log-probabilities [language, cell] from all documents of a given language. No documents give equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        total = np.zeros((len(languages), _CELLS), np.int64)
        for batch in batches:
            for some in common.pieces(batch, "t", 1 << 20):
                cells, starts = _trigrams([_letters(x) for x in some.column("t").to_pylist()])
                which = np.array([languages.index(x) for x in some.column("l").to_pylist()])
                owner = np.repeat(which, np.diff(np.append(starts, len(cells))))
                total += np.bincount(owner * _CELLS + cells, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(at), "n": pa.array(total.reshape(-1)[at])})

    known = docs.select(F.col(text).alias("t"), F.lower(F.col(lang)).alias("l")).where(F.col("l").isin(*languages) & F.col("t").isNotNull())
    found = known.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # as many rows as cells at most
    counts = np.zeros(len(languages) * _CELLS)
    counts[found.cell.to_numpy(np.int64)] = found.n.to_numpy(float)
    counts = counts.reshape(len(languages), _CELLS) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _scores(texts: pa.RecordBatch | pa.Table, column: str, table: np.ndarray, most: int) -> np.ndarray:
    """Scaled log-likelihoods [row, language]; zero for a text without letters."""
    found = [np.zeros((0, len(table)))]
    for some in common.pieces(texts, column, 1 << 20):
        cells, starts = _trigrams([_letters(x) for x in some.column(column).to_pylist()])
        n = np.diff(np.append(starts, len(cells)))
        sums = np.zeros((len(n), len(table)))
        full = np.flatnonzero(n)
        if len(full):
            for k, row in enumerate(table):
                sums[full, k] = np.add.reduceat(row[cells].astype(np.float64), starts[full])
        found.append(sums * np.minimum(1, most / np.maximum(n, 1))[:, None])
    return np.concatenate(found)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def likelihoods(df: DataFrame, model: np.ndarray, text: Column, keep: list[str], most: int = 200) -> DataFrame:
    """keep, and ll (renamed where keep has it): scaled log-likelihoods of a text by language."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
    into, out = common.free(keep, "own_text"), common.free(keep, "ll")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _lists(_scores(batch, into, shared.value, most))], [*keep, out])

    return df.select(*keep, text.alias(into)).mapInArrow(run, df.select(*keep).schema.add(out, T.ArrayType(T.DoubleType())))


def _softmax(scores: np.ndarray) -> np.ndarray:
    parts = np.exp(scores - scores.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


@dataclass
class Evidence:
    """What the corpus says besides a row's text: sums of posteriors over all, and log P(clue | language) [clue, language]."""

    overall: np.ndarray
    declared: np.ndarray
    suffix: np.ndarray

    def posterior(self, ll: np.ndarray, host: np.ndarray, levels: np.ndarray, declared: np.ndarray, suffix: np.ndarray, strength: float) -> np.ndarray:
        """Posteriors [row, language].

        host: whether a row has one; levels: sums [row, level, language] of its suffix, domain and host; declared and
        suffix: number of the language that a clue names, -1 for none. A row's own posterior leaves every sum first.
        """
        own = _softmax(ll)
        prior = np.maximum(self.overall - own, 0) + 1.0
        prior /= prior.sum(axis=1, keepdims=True)
        for level in range(levels.shape[1]):
            left = np.maximum(levels[:, level] - own, 0)
            smoothed = (left + strength * prior) / (left.sum(axis=1, keepdims=True) + strength)
            prior = np.where(host[:, None], smoothed, prior)
        clues = [np.concatenate([table, np.zeros((1, ll.shape[1]))])[at] for table, at in ((self.declared, declared), (self.suffix, suffix))]
        return _softmax(ll + clues[0] + clues[1] + np.log(prior))


def identify(
    rows: DataFrame, model: np.ndarray, text: Column, declared: Column, host: Column, languages: tuple[str, ...] = LANGUAGES,
    sure: float = 0.6, strength: float = 5.0, keep: list[str] | None = None, most: int = 200,
) -> DataFrame:
    """keep (all columns unless given), language, confidence and posterior (by language, in the order of `languages`).

    language is "und" where no posterior reaches `sure`. A null or empty text has no say, nor has a null or unknown
    declared language; rows without a host share the prior over all. Repeated rows are judged alike.
    An empty table gives an empty table. Columns of the names added are replaced; other names never clash.

    With `keep` each text is read once, and what is kept is written with its likelihoods; else texts are read twice
    and never written. Up to 50,000 hosts are broadcast; beyond that rows are joined by host (AQE splits hot ones).
    """
    spark = rows.sparkSession
    common.bounded(spark)
    k, added, thin = len(languages), ("language", "confidence", "posterior"), keep is not None
    keep = [c for c in (keep if thin else rows.columns) if c.lower() not in added]
    names = [*keep, *rows.columns, *added]
    h, d, p, into, every, at = (common.free(names, x) for x in ("host_of", "declared_of", "suffix_of", "own_text", "every_level", "host_key"))
    said = F.lower(F.substring(F.coalesce(declared, F.lit("")), 1, 2))
    place = F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), ":[0-9]*$", ""))
    suffix = F.regexp_extract(place, r"\.([a-z]+)$", 1)
    spoken = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[suffix]
    clue = lambda c: F.when(c.isin(*languages), c).otherwise(F.lit(""))
    marked = rows.withColumns({h: place, d: clue(said), p: clue(F.coalesce(spoken, F.lit("")))})
    held = likelihoods(marked, model, text, [*keep, h, d, p], most)
    ll = held.columns[-1]
    if thin:
        held = common.cut(held)
    told = spark.sparkContext.broadcast(model)  # of fixed size

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            own = _softmax(_matrix(batch.column("x"), k) if thin else _scores(batch, "x", told.value, most))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "hdp"), *(pa.array(own[:, i]) for i in range(k))], [*"hdp", *(f"s{i}" for i in range(k))])

    light = (held.withColumn(into, F.col(ll)) if thin else marked.withColumn(into, text)).select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(p).alias("p"), F.col(into).alias("x"))
    kind = "h string, d string, p string" + "".join(f", s{i} double" for i in range(k))
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    host_sums = common.cut(light.mapInArrow(posteriors, kind).groupBy("h", "d", "p").agg(*again))  # one row for a host and clue

    def confusion(column: str) -> np.ndarray:
        """log P(clue | language), from soft counts of (clue, language)."""
        table = {r[0]: r[1:] for r in host_sums.where(F.col(column) != "").groupBy(column).agg(*again).collect()}  # a row for each language
        counts = np.array([[table.get(c, (0.0,) * k)[i] or 0.0 for i in range(k)] for c in languages])
        counts += 2.0 + 18.0 * np.eye(k)
        return np.log(counts / counts.sum(axis=0))

    overall = np.array([x or 0.0 for x in host_sums.agg(*again).first()])
    evidence = spark.sparkContext.broadcast((Evidence(overall, confusion("d"), confusion("p")), model))  # of fixed size
    levels = host_sums.groupBy("h").agg(F.array(*[F.sum(f"s{i}") for i in range(k)]).alias("host"))
    levels = levels.withColumns({"domain": F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract("h", r"\.([^.]+)$", 1)})
    for name in ("suffix", "domain"):
        up = levels.groupBy(name).agg(F.array(*[F.sum(F.col("host")[i]) for i in range(k)]).alias(f"{name}_sums"))
        levels = levels.join(up, name)
    hosts = common.small(common.cut(levels.select(F.col("h").alias(at), F.concat("suffix_sums", "domain_sums", "host").alias(every))), 50_000)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        known, table = evidence.value
        for batch in batches:
            scores = _matrix(batch.column(ll), k) if thin else _scores(batch, into, table, most)
            named = [pc.fill_null(pc.index_in(batch.column(c), pa.array(languages)), -1).to_numpy(zero_copy_only=False) for c in (d, p)]
            has = pc.not_equal(batch.column(h), "").to_numpy(zero_copy_only=False)
            found = known.posterior(scores, has, _matrix(batch.column(every), 3 * k).reshape(-1, 3, k), *named, strength)
            top = found.max(axis=1) if len(found) else np.zeros(0)
            best = np.where(top >= sure, np.array([*languages, "und"])[found.argmax(axis=1)] if len(found) else "", "und")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best.tolist(), pa.string()), pa.array(top), _lists(found)], [*keep, *added])

    source = held if thin else marked.select(*keep, h, d, p, text.alias(into))
    schema = rows.select(*keep).schema.add("language", "string").add("confidence", "double").add("posterior", T.ArrayType(T.DoubleType()))
    return source.join(hosts, F.col(h) == F.col(at)).mapInArrow(judge, schema)


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, comments and tags."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(out, r"<[^>]*>|&[a-z#0-9]+;", " ")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: language of every page."""
    model = train(common.table(spark, sf_dir, "documents").select("text", "lang"))
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    out = identify(pages, model, visible(F.col("html")), declared, host, keep=["page_id"])
    return out.select("page_id", "language", "confidence", *[F.col("posterior")[i].alias(f"p_{x}") for i, x in enumerate(LANGUAGES)])
