"""Helpers shared by the operators: tables, words, Arrow batches, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
BREAK = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch | pa.Table, column: str, most: int) -> Iterator[pa.Table]:
    """Slices of whole rows with at most `most` bytes of text (or one row)."""
    start, held = 0, 0
    for i, x in enumerate(batch.column(column)):
        n = len(x.as_buffer()) if x.is_valid else 0
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def bounded(spark: SparkSession) -> None:
    """Arrow batches of a few MB: rows of texts are long, and both the JVM and the worker hold whole batches."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    if spark.conf.get(name) == "67108864b":  # nobody has chosen another bound
        spark.conf.set(name, str(most))


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df (a checkpoint or table of short rows), to be broadcast if it has `most` rows or fewer; else it is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints of what no variable holds any more.

    Executors collect too, by a short task for each: they give back heap, code and buffers that a stage has left.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is one of them
    if n:
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def cut(df: DataFrame) -> DataFrame:
    """Writes a checkpoint that all executors share, so that lost executors cost no rework."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(names: Iterable[str], wish: str) -> str:
    """A column name like `wish` that clashes with none of `names`, whatever their case."""
    taken = {x.lower() for x in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def release() -> None:
    """Gives memory that is free back to the machine. A worker waits for its next task with what its last one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


#: What operators remember in a worker from task to task.
REMEMBERED: list[dict] = []


def forget() -> None:
    """For tasks that remember nothing: clears what another operator's tasks have left in this worker."""
    for x in REMEMBERED:
        x.clear()
    release()
