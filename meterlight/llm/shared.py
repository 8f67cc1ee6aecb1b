"""What the corpus operators share: work tables that outlive an executor, and joins that a hot key doesn't stall."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators have it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of texts that go to a Python worker at once, where the session doesn't say it.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of texts bounded, on both sides of each worker's pipe; what the session sets itself stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_ROWS)


def tidied(batches: Iterator) -> Iterator:
    """The batches; after the last one, what Arrow's pool and the C library hold free goes back to the machine, as workers outlive their tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The work tables of the run that this thread is in; none outside of ``tables_of_run``.
_RUN: ContextVar[list[str] | None] = ContextVar("work tables of the run", default=None)


@contextmanager
def tables_of_run() -> Iterator[list[str]]:
    """The work tables that are written inside, the oldest first: a list of its own for each run, so that runs in other threads keep theirs."""
    own: list[str] = []
    token = _RUN.set(own)
    try:
        yield own
    finally:
        _RUN.reset(token)


def shared_folder(spark: SparkSession) -> str:
    """A new place in ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where that is unset, a local session gets a folder of its own; any other master is an error, as its machines
    would each write to their own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _own_folder()
    return f"{at.rstrip('/')}/meterlight-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="meterlight-")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and not lost with an executor."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    own = _RUN.get()
    if own is not None:
        own.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, tables: list[str]) -> None:
    """Deletes work tables that no DataFrame reads any more."""
    for at in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def add_columns(rows: DataFrame, row: str, outputs: dict[str, Column]) -> DataFrame:
    """The fields of the struct ``row`` and then ``outputs``, which replace fields of the same name."""
    taken = {name.lower() for name in outputs}
    fields = [F.col(row)[name].alias(name) for name in rows.schema[row].dataType.names if name.lower() not in taken]
    return rows.select(*fields, *(c.alias(name) for name, c in outputs.items()))


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, hot: int = 1024) -> DataFrame:
    """``left`` joined to ``right`` that has one row for each key, with the number of its left rows in ``count``.

    Keys with over ``total / hot`` rows, of which there are fewer than ``hot`` because the counts sum to
    ``total``, are broadcast, so their left rows stay where they are; all other keys are shuffled.
    """
    is_hot = F.col(count) * hot > F.lit(total)
    few = right.where(is_hot)
    return left.join(F.broadcast(few), key).unionByName(
        left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~is_hot), key)
    )


def range_parts(df: DataFrame, order: list[Column], rows: int, part_rows: int = 1 << 14) -> DataFrame:
    """``df``, of some ``rows`` rows, dealt to ranges of ``order``, with the number of the range in ``_part``, as a work table.

    Ranges have about ``part_rows`` rows, and up to 4 times as many where there would be over 4096 of them. ``order`` should
    tell all rows apart, else a range can't be split.
    """
    parts = min(max(1, -(-rows // part_rows)), max(4096, rows // (4 * part_rows)))
    return kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id().cast("long")))


def part_offsets(parted: DataFrame, by: list[str]) -> DataFrame:
    """Of a table of ``range_parts``, for each ``by`` and part its rows ``_n``, and the rows ``_first`` of the same ``by`` in earlier parts. As many rows as parts, and one more for each further ``by`` in a part."""
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return parted.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))


def ranked(df: DataFrame, order: list[Column], rows: int, most: int, name: str) -> DataFrame:
    """``df`` with the place 1 to ``most`` of its first rows by ``order`` in ``name``, null for all others, without a sort in one task: ranges are counted, and rows are numbered within theirs."""
    parted = range_parts(df, order, rows)
    place = F.col("_first") + F.row_number().over(W.partitionBy("_part").orderBy(*order))
    # a row for each range, so this is small
    met = parted.join(F.broadcast(part_offsets(parted, []).drop("_n")), "_part")
    return met.withColumn("_place", place.cast("long")).withColumn(name, F.when(F.col("_place") <= most, F.col("_place"))).drop("_part", "_first", "_place")
