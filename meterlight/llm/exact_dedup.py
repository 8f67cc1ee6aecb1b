"""Exact dedup by two-pass Bloom filtering.

Pass one sets, for the hash of each text, one cell in each of two halves of a filter whose cells tell none,
one and several apart. Each task makes its own sparse part, and the parts are merged by segment. Pass two
reads the rows again: a row none of whose cells lacks "several" may be a repeat and goes through a shuffle; all
other rows are alone for sure and pass straight through. A false positive costs a shuffled row, never a
wrong answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, add_columns, join_counted, kept, text_of

HALVES = 2
SEGMENT = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _cells(hashes: pa.Array, half: int) -> np.ndarray:
    """Of each hash two 64-bit numbers, as a cell in each half."""
    raw = np.frombuffer(b"".join(bytes.fromhex(x[: 16 * HALVES]) for x in hashes.to_pylist()), dtype=">u8").reshape(-1, HALVES)
    return (raw % np.uint64(half)).astype(np.int64) + np.arange(HALVES) * half


def maybe_repeated(spark: SparkSession, bits: np.ndarray) -> Callable[[str], Column]:
    """The second pass: whether all cells of a row were set at least twice."""
    sent, half = spark.sparkContext.broadcast(bits), len(bits) * 8 // HALVES

    @F.arrow_udf("boolean")
    def repeated(h: pa.Array) -> pa.Array:
        cells = _cells(h, half)
        return pa.array(((sent.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1))

    return repeated


def repeat_filter(hashes: DataFrame, column: str, rows: int, max_bits: int = 1 << 30) -> np.ndarray:
    """The first pass, as packed bits: set where at least two rows have set the cell. Of 16 to 32 cells a row, but at most ``max_bits`` (128 MB).

    Beyond ``max_bits / 16`` rows the filter stays as large and lets more rows through to the shuffle.
    """
    bits = min(max_bits, max(2 * SEGMENT, 1 << (16 * max(1, rows) - 1).bit_length()))
    half = bits // HALVES

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [_cells(b.column(0), half).ravel() for b in batches if b.num_rows]
        cells, n = np.unique(np.concatenate(seen or [np.empty(0, np.int64)]), return_counts=True)
        cuts = np.flatnonzero(np.diff(cells // SEGMENT)) + 1
        rows = []
        for own, k in zip(np.split(cells, cuts), np.split(n, cuts), strict=True):
            if len(own):
                at = (own % SEGMENT).astype("<u2")
                rows.append((int(own[0] // SEGMENT), at[k == 1].tobytes(), at[k > 1].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            ["segment", "once", "more"],
        )

    def merged(group: pa.Table) -> pa.Table:
        n = np.zeros(SEGMENT, np.uint8)
        for once, more in zip(group["once"].to_pylist(), group["more"].to_pylist(), strict=True):
            n[np.frombuffer(more, "<u2")] = 2
            at = np.frombuffer(once, "<u2")
            n[at] = np.minimum(n[at] + 1, 2)
        return pa.table({"segment": group["segment"][:1], "bits": pa.array([np.packbits(n > 1).tobytes()], pa.binary())})

    sparse = hashes.select(column).mapInArrow(parts, "segment int, once binary, more binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in sparse.groupBy("segment").applyInArrow(merged, "segment int, bits binary").toLocalIterator():
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = 1 << 30) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are after each run of ASCII white space has become one space; null is empty, and
    SHA-256 stands for the text. Of equal texts the row with the smallest key stays; null keys come last, and of
    rows that repeat the smallest key one stays. An empty table gives an empty result. Input columns named as
    the four outputs are replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.sha2(normalised(text_of(text)), 256).alias("_hash"))
    found = repeat_filter(rows, "_hash", docs.count(), max_bits)
    repeated = maybe_repeated(spark, found)

    alone = add_columns(
        rows.where(~repeated("_hash")), "_row",
        {"keep_id": F.col("_key"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True), "text_sha256": F.col("_hash")},
    )
    maybe = kept(rows.where(repeated("_hash")).withColumn("_at", F.monotonically_increasing_id()))
    rank = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_at").alias("at"))
    groups = maybe.groupBy("_hash").agg(F.min(rank).alias("_first"), F.count("*").alias("_size"))
    met = join_counted(maybe, groups, "_hash", "_size", maybe.count())
    return alone.unionByName(
        add_columns(
            met, "_row",
            {"keep_id": F.col("_first.key"), "group_size": F.col("_size"), "kept": F.col("_at") == F.col("_first.at"), "text_sha256": F.col("_hash")},
        )
    )
