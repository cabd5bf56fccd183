"""A training corpus from documents: language, near copies, repeated passages, mix of sources, pieces."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, language, mixing, pieces, simhash, substrings

#: Words in a run that a later document may not share with an earlier one.
PASSAGE = 25


def _with(docs: DataFrame, added: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage makes of docs, with docs' own columns; those named like the stage's columns are set aside meanwhile."""
    aside = {c: common.free([*docs.columns, *added], f"own_{c}") for c in docs.columns if c.lower() in added}
    return stage(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure, with that language. The declared language and the source are evidence too.

    Null and empty texts are judged by that evidence alone, and go if it does not do. Repeated rows are judged alike.
    """
    common.sweep(spark)
    model = language.train(docs)

    def stage(own: DataFrame) -> DataFrame:
        found = language.identify(own, model, F.col("text"), F.col("lang"), F.col("source"))
        return found.where("language <> 'und'").withColumn("lang", F.col("language"))

    return _with(docs, ["language", "confidence", "posterior"], stage)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8): that of smallest id.

    Covering SimHash links near fingerprints; pairs of that similarity beyond its radius are found by shared shingles.
    Texts without words, and null texts, are nobody's copies. Of rows of one id, and of a group without ids, one stays.
    """
    common.sweep(spark)
    return simhash.without_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of smaller ids' documents; one that consists of such passages alone goes.

    Null and empty texts stay as they are. Rows of one id take nothing from each other; a null id is the largest.
    """
    common.sweep(spark)

    def stage(own: DataFrame) -> DataFrame:
        found = substrings.dedup_substrings(own, PASSAGE)
        kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
        return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))

    return _with(docs, ["kept_text", "n_words", "n_removed"], stage)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; what is left of its quota is a copy of its first words.

    Documents without words are taken no times and go. Equal rows are taken one after the other.
    """
    common.sweep(spark)

    def stage(own: DataFrame) -> DataFrame:
        found = mixing.mix(own).where("taken > 0")
        rest = F.col("taken") % F.col("size")
        whole = (F.col("taken") - rest) / F.col("size")
        copies = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.expr("cast(array() as array<bigint>)")))
        out = found.withColumn("words_taken", F.explode(copies))
        part = F.array_join(F.slice(common.words(F.col("text")), F.lit(1), F.col("words_taken").cast("int")), " ")
        text = F.when(F.col("words_taken") == F.col("size"), F.col("text")).otherwise(part)
        return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))

    return _with(docs, ["size", "source_size", "target", "taken", "words_taken"], stage)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, pieces of each text (ids), and whether they decode to it (round_trip); both null for a null text."""
    common.sweep(spark)
    return pieces.encode(docs.select("doc_id", "source", "lang", "text")).drop("text")


STAGES = [("language", by_language), ("near_copies", without_near_copies), ("repeats", without_repeats), ("mix", mixed), ("pieces", encoded)]
#: Language models, fingerprints and pieces have no SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written where all executors read it.

    A stage's table is removed when the next one's is written. The last but one stays, as the result reads it.
    """
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if last:
                _remove(spark, last)
            last = f"{folder}/{name}"
    return docs
