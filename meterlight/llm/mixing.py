"""Mixing sources to target weights.

Words are packed, source by source, into blocks of fixed length. Each output shard draws how many of its slots
go to which source, as a multinomial: slot by slot, a keyed hash falls into the sources' shares. A source's slots
are numbered over all shards, and a pseudorandom permutation of its block numbers, another one for each pass,
says which block a slot takes; slots and blocks meet by source and block number. The draws decide: a source gives as many
blocks as were drawn, which is near its target and not at it, but for slots that would take a block more often than
``most`` allows; these stay empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, add_columns, join_counted, kept, text_of

#: Relative weights of the sources by their order, repeating.
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    """The number of words between ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running_sum(rows: DataFrame, key: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows of the key before this one; rows lie by chunk and then ``order``.

    Sums run inside each ``_chunk`` of a key, and over the chunks' totals, so that a key with a third of all rows is
    summed by many tasks.
    """
    own = W.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("_upto", F.sum(value).over(own))
    parts = rows.groupBy(*key, "_chunk").agg(F.sum(value).alias("_part"))
    before = W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    return inside.join(parts, [*key, "_chunk"]).withColumn(out, F.col("_before") + F.col("_upto") - F.col(value)).drop("_before", "_upto")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, size) with ``rank``, ``weight`` and ``target``.

    Targets share ``share`` times all sizes by weight; none is above ``most`` times its size, and what is above goes to
    the others by weight. Sources are capped in the order of their caps for a unit of weight; what is left for a unit
    of weight of the others rises while that is right and falls when one is capped too many, so the most it reaches
    before a higher cap is the answer.
    The sources, not their documents, are sorted in one task.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    own = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("size"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto, every = by_cap.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = (
        own.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("others", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.lit(float(share)) * F.sum("size").over(every) - F.col("capped")) / F.col("others"))
        .withColumn("unit", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(every))
    )
    return own.select("source", "size", "rank", "weight", F.when(F.col("unit").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("unit") * F.col("weight"))).alias("target"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of ``0 .. n - 1`` sends each index: a Feistel cipher on the next even number of bits, stepped on while it leaves the range."""
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2 + 1e-9).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            left, right = right, left ^ (_mixed(right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def draws(sources: DataFrame, slots: int, total: float, shard_slots: int, seed: int) -> DataFrame:
    """``shard, at, rank, slot``: the place in its shard and the source of each of ``slots`` slots, numbered for each source over all shards."""
    spark = sources.sparkSession
    bins = 4096
    by_rank = W.orderBy("rank")
    shares = sources.withColumn("hi", F.sum("target").over(by_rank)).withColumn("lo", F.lag("hi", 1, 0.0).over(by_rank)).where("target > 0")
    edge = lambda c: F.floor(F.col(c) / F.lit(total) * bins).cast("int")
    shares = shares.select("rank", "lo", "hi", F.explode(F.sequence(edge("lo"), edge("hi"))).alias("bin"))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53)) * F.lit(total)
    drawn = spark.range(slots).withColumn("u", u).withColumn("bin", F.floor(F.col("u") / F.lit(total) * bins).cast("int"))
    drawn = drawn.join(shares, "bin").where("lo <= u and u < hi").select(F.expr(f"id div {shard_slots}").alias("shard"), "rank", "id")
    counts = drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")).withColumn("_chunk", F.expr("shard div 1024"))
    offsets = running_sum(counts, ["rank"], [F.col("shard")], "n", "offset").select("shard", "rank", "offset")
    inside = F.row_number().over(W.partitionBy("shard", "rank").orderBy("id")) - 1
    return drawn.withColumn("inside", inside).join(offsets, ["shard", "rank"]).select("shard", F.expr(f"id % {shard_slots}").alias("at"), "rank", (F.col("offset") + F.col("inside")).alias("slot"))


def block_words(total: float, slots: int = 1 << 20, longest: int = 2048) -> int:
    """The length of a block: so that the mix has ``slots`` slots or more, for the draws to come near the shares, but at most ``longest``."""
    return max(1, min(longest, int(total) // slots))


def uses(sources: DataFrame, drawn: DataFrame, block: int, most: float, seed: int) -> DataFrame:
    """``shard, at, rank, block, pass, words``: the block that each drawn slot takes, and its words. Slots beyond ``most`` passes take none."""
    own = sources.select("rank", "size", F.ceil(F.col("size") / block).alias("blocks"), F.expr(f"size div {block}").alias("full"))
    every = drawn.join(own, "rank").where(F.col("slot") < F.floor(F.lit(most)) * F.col("blocks"))
    every = every.withColumn("pass", F.expr("slot div blocks")).withColumn("index", F.expr("slot % blocks"))

    @F.arrow_udf("long")
    def place(index: pa.Array, blocks: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array(permuted(*(x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (index, blocks, key))), pa.int64())

    every = every.withColumn("block", place("index", "blocks", F.xxhash64(F.lit(seed), "rank", "pass")))
    return every.select("shard", "at", "rank", "block", "pass", F.least(F.lit(block), F.col("size") - F.col("block") * block).alias("words"))


def mixed(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", block: int | None = None, shard_slots: int = 4096, seed: int = 20240101, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``_row`` (of ``docs``), ``_size``, ``_source_size``, ``_target`` and ``_taken``: an array of ``pass, first, n, shard, at``, the words that the mix takes of the row, in runs.

    A run lies in slot ``at`` of its output shard; a shard's slots by source are the multinomial's counts. ``size`` is
    the row's number of words; null counts as 0. Without ``block``, blocks are as long as ``block_words`` says. The order of
    packing is that of a keyed hash of all columns of the row but maps; rows equal in all of them are documents of their
    own in any order. Rows without words are taken never. Reruns agree for the same rows and seed, however these are
    partitioned. A null source is a source, the last. Of an empty table the mix is empty.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = kept(
        docs.select(F.struct("*").alias("_row"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), name.alias("_source"), F.xxhash64(F.lit(seed), F.lit(key), *hashed).alias("_hash"), F.monotonically_increasing_id().alias("_id"))
    )
    slim = rows.select("_id", "_size", "_source", "_hash")
    by_source = slim.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("docs"))
    named = by_source.select(F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias("source"), "size", "docs", "_source")
    sources = kept(targets(named, share, most).join(named.select("_source", F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    n = rows.count()
    ranked = join_counted(slim, sources.select("_source", "rank", "docs", F.col("size").alias("_source_size"), F.col("target").alias("_target")), "_source", "docs", n)
    ranked = ranked.withColumn("_chunk", F.pmod("_hash", F.lit(max(1, n // 2000))))
    packed = kept(running_sum(ranked, ["rank"], [F.col("_hash"), F.col("_id")], "_size", "_at").select("_id", "_size", "rank", "_at", "_source_size", "_target"))

    if block is None:
        block = block_words(sources.agg(F.sum("target")).first()[0] or 0.0)
    # slots that give a source its target on average; its last block may be short
    expected = sources.select("rank", "size", (F.col("target") * F.ceil(F.col("size") / block) / F.greatest("size", F.lit(1))).alias("target"))
    total = expected.agg(F.sum("target")).first()[0] or 0.0
    drawn = kept(draws(expected, round(total), total, shard_slots, seed))
    first = F.greatest(F.col("_at"), F.col("block") * block)
    pieces = packed.where("_size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + _size - 1) div {block}"))))
    pieces = pieces.select("_id", "rank", "block", (first - F.col("_at")).alias("first"), (F.least(F.col("_at") + F.col("_size"), (F.col("block") + 1) * block) - first).alias("n"))
    taken = pieces.join(uses(sources, drawn, block, most, seed), ["rank", "block"]).select("_id", "pass", "first", "n", "shard", "at")
    taken = taken.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pass", "first", "n", "shard", "at"))).alias("_taken"))
    none = F.array().cast("array<struct<pass:long,first:long,n:long,shard:long,at:long>>")
    return rows.select("_row", "_id").join(packed, "_id").join(taken, "_id", "left").select("_row", "_size", "_source_size", "_target", F.coalesce("_taken", none).alias("_taken"))


def mixed_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", by_slot: bool = False, block: int | None = None, shard_slots: int = 4096) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each document and pass that takes words of it, with the text cut to these words.

    A text that a pass takes whole stays as it is; of others the runs of words, with the white space between
    them, stand one after the other. With ``by_slot`` the mix is laid out as its shards: a row for each slot and each
    document with words in it, and the columns ``shard`` and ``slot`` (which replace input columns of these names).
    """
    rows = mixed(docs, words(text_of(text)), key, source, block, shard_slots)
    if by_slot:
        runs = rows.select("_row", "_size", F.explode("_taken").alias("_run"))
        runs = runs.select("_row", "_size", F.col("_run.shard").alias("_shard"), F.col("_run.at").alias("_slot"), F.array("_run").alias("_runs"))
    else:
        by_pass = rows.select("_row", "_size", F.explode(F.array_distinct(F.transform("_taken", lambda t: t["pass"]))).alias("_pass"), "_taken")
        runs = by_pass.withColumn("_runs", F.filter("_taken", lambda t: t["pass"] == F.col("_pass")))
    whole = F.aggregate("_runs", F.lit(0).cast("long"), lambda a, t: a + t["n"]) == F.col("_size")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _cut(t, [(r["first"], r["n"]) for r in own]) for t, own in zip(texts.to_pylist(), runs.to_pylist(), strict=True)], pa.string())

    parts = runs.withColumn("_cut", F.when(~whole, F.col("_row")[text]))
    new = F.coalesce(cut("_cut", "_runs"), F.col("_row")[text])
    outputs = {text: F.col("_new")} | ({"shard": F.col("_shard"), "slot": F.col("_slot")} if by_slot else {})
    out = add_columns(parts.withColumn("_new", new), "_row", outputs)
    return out if by_slot else out.select(*docs.columns)


def _cut(text: str, runs: list[tuple[int, int]]) -> str:
    joined: list[list[int]] = []
    for first, n in sorted(runs):
        if joined and joined[-1][1] == first:
            joined[-1][1] += n
        else:
            joined.append([first, first + n])
    at = [m.span() for m in re.finditer(WORD, text)]
    return " ".join(text[at[a][0] : at[b - 1][1]] for a, b in joined)
