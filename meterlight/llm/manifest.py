"""A Merkle manifest of a dataset: a digest tree for each group of rows, a tree over the groups, and a proof for each row.

Leaves are sorted by range. Counting the rows of each group in each range gives every range its rows' places, so each range
builds the complete aligned subtrees among its leaves alone. Only the roots of these move on, two a level at most: such
ragged nodes meet by their coordinates (group, and place at a higher level) and are joined upwards, some levels a round,
until each group has one node. On the way back each ragged node learns the siblings above it, and each leaf those inside its
subtree and then those above. The groups' roots are the leaves of one more tree of the same kind.

A node is the SHA-256 of its children's digests as hexadecimal text. A level's last node can be alone: it is hashed alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, kept, part_offsets, range_parts

#: Levels that a round of ragged nodes climbs: at most 2 ** LEVELS nodes meet in one group of a task.
LEVELS = 12
#: A step of a proof: the sibling's digest, null where the node is alone, and whether the sibling stands on the left.
PATH = "array<struct<hash:string,left:boolean>>"
_PATH = pa.list_(pa.struct([("hash", pa.string()), ("left", pa.bool_())]))


def field(value: Column) -> Column:
    """A value of a leaf: ``-`` for null, else the bytes of its UTF-8 text, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def proof_digest(path: Column) -> Column:
    """The digest of a proof's siblings, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["hash"]), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """What a leaf and its proof come to: the root, if neither was changed."""

    def up(below: Column, step: Column) -> Column:
        beside = F.coalesce(step["hash"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(beside, below)).otherwise(F.concat(below, beside)), 256)

    return F.aggregate(path, node, up)


def height(total: int) -> int:
    """Levels above the leaves of a group of ``total``; level l has ceil(total / 2 ** l) nodes."""
    return (total - 1).bit_length() if total > 1 else 0


def digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def runs(first: int, leaves: list[str], total: int) -> Iterator[tuple[int, list[str], list[int]]]:
    """What follows from leaves ``first`` and on alone: for each level the first node's place, the nodes, and the places of those whose parents don't follow."""
    while leaves:
        wide, end = total, first + len(leaves)
        if wide == 1:
            yield first, leaves, [first]
            return
        up, to = (first + 1) // 2, (end + 1) // 2 if end == wide else end // 2
        ragged = [first] if first % 2 else []
        if end > 2 * to and end - 1 not in ragged:
            ragged.append(end - 1)
        yield first, leaves, ragged
        leaves = [digest(leaves[max(0, 2 * at - first) : 2 * at - first + 2]) for at in range(up, to)]
        first, total = up, -(-total // 2)


def _segments(rows: pa.Table) -> Iterator[tuple[str, int, int]]:
    """The runs of equal groups in a sorted range."""
    g = rows["_g"].to_pylist()
    start = 0
    for k in range(1, len(g) + 1):
        if k == len(g) or g[k] != g[start]:
            yield g[start], start, k
            start = k


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by([(c, "ascending") for c in ("_g", "_key", "_leaf", "_id")])


NODE = "_g string, _total long, _level int, _at long"
RAGGED = f"{NODE}, _hash string, _part long"


def _subtrees(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """The ragged nodes of one range."""
    rows, out = _ordered(rows), []
    own = {o["_g"]: o for o in offsets.to_pylist()}
    leaves = rows["_leaf"].to_pylist()
    for g, start, end in _segments(rows):
        o = own[g]
        for level, (first, nodes, ragged) in enumerate(runs(o["_first"], leaves[start:end], o["_total"])):
            out += [{"_g": g, "_total": o["_total"], "_level": level, "_at": at, "_hash": nodes[at - first], "_part": o["_part"]} for at in ragged]
    return pa.Table.from_pylist(out, pa.schema([("_g", pa.string()), ("_total", pa.int64()), ("_level", pa.int32()), ("_at", pa.int64()), ("_hash", pa.string()), ("_part", pa.int64())]))


CLIMBED = f"{NODE}, _part long, _path {PATH}, _end int, _up long, _root string"


def _climb(top: int) -> Callable[[pa.Table], pa.Table]:
    """One round: ragged nodes below one node of level ``top`` are joined up to it, or to their group's root. Each comes back with its siblings on the way."""

    def climbed(nodes: pa.Table) -> pa.Table:
        rows = nodes.to_pylist()
        total = rows[0]["_total"]
        end = min(top, height(total))
        levels: list[dict[int, str]] = [{} for _ in range(end + 1)]
        for r in rows:
            levels[r["_level"]][r["_at"]] = r["_hash"]
        for level in range(end):
            pairs: dict[int, list[str]] = {}
            for at in sorted(levels[level]):
                pairs.setdefault(at // 2, []).append(levels[level][at])
            levels[level + 1] |= {at: digest(pair) for at, pair in pairs.items()}
        out = []
        for r in rows:
            level, at = r["_level"], r["_at"]
            path = [{"hash": levels[k].get((at >> k - level) ^ 1), "left": bool(at >> k - level & 1)} for k in range(level, end)]
            up = at >> end - level
            out.append({"_g": r["_g"], "_total": total, "_level": level, "_at": at, "_part": r["_part"], "_path": path, "_end": end, "_up": up, "_root": levels[end][up]})
        return pa.Table.from_pylist(
            out,
            pa.schema([
                ("_g", pa.string()), ("_total", pa.int64()), ("_level", pa.int32()), ("_at", pa.int64()), ("_part", pa.int64()),
                ("_path", _PATH), ("_end", pa.int32()), ("_up", pa.int64()), ("_root", pa.string()),
            ]),
        )

    return climbed


def _finished(ragged: DataFrame, tallest: int) -> DataFrame:
    """``ragged`` with each node's siblings up to its group's root, and the root: rounds upwards, then as many joins on the way back."""
    waiting, rounds = ragged, []
    for top in range(LEVELS, max(tallest, 1) + LEVELS, LEVELS):
        low = waiting.where(F.col("_level") < top).withColumn("_block", F.expr(f"shiftright(_at, {top} - _level)"))
        met = kept(low.groupBy("_g", "_block").applyInArrow(_climb(top), CLIMBED))
        rounds.append(met)
        # a part of null: a node that this round has made, which no range holds
        made = met.select("_g", "_total", F.col("_end").alias("_level"), F.col("_up").alias("_at"), F.col("_root").alias("_hash"), F.lit(None).cast("long").alias("_part")).distinct()
        waiting = kept(waiting.where(F.col("_level") >= top).unionByName(made))
    known = waiting.select("_g", "_level", "_at", "_part", F.array().cast(PATH).alias("_path"), F.col("_hash").alias("_root"))
    for met in reversed(rounds):
        above = known.where("_part is null").select("_g", F.col("_level").alias("_end"), F.col("_at").alias("_up"), F.col("_path").alias("_rest"), F.col("_root").alias("_top"))
        below = met.join(above, ["_g", "_end", "_up"]).select("_g", "_level", "_at", "_part", F.concat("_path", "_rest").alias("_path"), F.col("_top").alias("_root"))
        known = known.where("_part is not null").unionByName(below)
    return known


def _proofs(rows: pa.Table, nodes: pa.Table) -> pa.Table:
    """A range's rows with their proofs: the siblings inside the subtree of a ragged node, and then that node's."""
    rows = _ordered(rows)
    crowns: dict[str, list[dict]] = {}
    for n in nodes.to_pylist():
        crowns.setdefault(n["_g"], []).append(n)
    # all digests in one list; a proof is a list of places in it, -1 for none
    digests: list[str] = []
    steps, lefts, lengths, roots, totals = [], [], [], [], []
    leaves = rows["_leaf"].to_pylist()
    for g, start, end in _segments(rows):
        first, total = crowns[g][0]["_first"], crowns[g][0]["_total"]
        own = []
        for at, level, _ in runs(first, leaves[start:end], total):
            own.append((at, len(level), len(digests)))
            digests += level
        spans = sorted((max(n["_at"] << n["_level"], first), min((n["_at"] + 1) << n["_level"], first + end - start), k) for k, n in enumerate(crowns[g]))
        for low, high, k in spans:
            node = crowns[g][k]
            at = np.arange(low, high)
            step = np.empty((high - low, node["_level"] + len(node["_path"])), np.int64)
            left = np.empty(step.shape, bool)
            for level in range(node["_level"]):
                beside = (at >> level) ^ 1
                since, n, base = own[level]
                step[:, level] = np.where(beside < since + n, beside - since + base, -1)
                left[:, level] = (at >> level) & 1
            for j, s in enumerate(node["_path"], start=node["_level"]):
                step[:, j], left[:, j] = -1 if s["hash"] is None else len(digests), s["left"]
                digests += [] if s["hash"] is None else [s["hash"]]
            steps.append(step.ravel())
            lefts.append(left.ravel())
            lengths.append(np.full(high - low, step.shape[1]))
            roots += [node["_root"]] * (high - low)
        totals += [total] * (end - start)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    flat = join(steps, np.int64)
    hashes = pa.array(digests, pa.string()).take(pa.array(flat, mask=flat < 0))
    path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(join(lengths, np.int64))]), pa.int32()), pa.StructArray.from_arrays([hashes, pa.array(join(lefts, bool))], ["hash", "left"]))
    return rows.append_column("_total", pa.array(totals, pa.int64())).append_column("_path", path.cast(_PATH)).append_column("_root", pa.array(roots, pa.string()))


def tree(leaves: DataFrame, part_rows: int = 1 << 14) -> DataFrame:
    """A work table of leaves with, for each, ``_total`` (the leaves of its group), ``_path`` and ``_root``.

    ``leaves``: ``_g``, a text that isn't null and names the group; ``_key``, by which a group's leaves ascend (nulls last; of
    equal ones by ``_leaf``); ``_leaf``, the digest; ``_id``, which tells repeated leaves apart; other columns stay. A large group
    is many ranges, and many small ones share a range.
    """
    parted = range_parts(leaves, [F.asc("_g"), F.asc_nulls_last("_key"), F.asc("_leaf"), F.asc("_id")], leaves.count(), part_rows)
    counted = part_offsets(parted, ["_g"])
    totals = kept(counted.groupBy("_g").agg(F.sum("_n").cast("long").alias("_total")))
    offsets = kept(counted.join(totals, "_g").select("_g", "_part", "_first", "_total"))
    ragged = kept(parted.groupBy("_part").cogroup(offsets.groupBy("_part")).applyInArrow(_subtrees, RAGGED))
    finished = _finished(ragged, height(totals.agg(F.max("_total")).first()[0] or 0)).join(offsets, ["_g", "_part"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parted.schema) + f", _total long, _path {PATH}, _root string"
    return kept(parted.groupBy("_part").cogroup(finished.groupBy("_part")).applyInArrow(_proofs, schema))


def manifest(rows: DataFrame, values: list[Column], group: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None, part_rows: int = 1 << 14) -> DataFrame:
    """For each row of ``rows`` its key, its group, ``leaf``, ``subroot``, ``root`` and ``path``, the proof from the leaf to the root; and the columns ``keep``.

    ``values`` are hashed to the leaf, in their order. Groups follow each other by their UTF-8 bytes, a null group first; leaves by
    the key, null keys last, rows of one key by their leaves. Repeated rows are leaves of their own. A group of one row
    has the leaf as its subroot, and a single group's subroot is the root. An empty table gives an empty result. Only the
    columns that are named are read.
    """
    keep = keep or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = kept(rows.select(
        F.monotonically_increasing_id().alias("_id"), name.alias("_g"), F.col(group).alias("_group"), F.col(key).alias("_key"),
        leaf(*values).alias("_leaf"), F.struct(F.lit(0).alias("_"), *(c.alias(n) for n, c in keep.items())).alias("_keep"),
    ))
    groups = tree(own, part_rows)
    subroots = groups.select("_g", "_root").distinct()
    top = tree(subroots.select(F.lit("").alias("_g"), F.col("_g").alias("_key"), F.col("_root").alias("_leaf"), F.lit(0).cast("long").alias("_id")), part_rows)
    sizes = groups.select("_g", "_total").distinct()
    above = top.select(F.col("_key").alias("_g"), F.col("_path").alias("_rest"), F.col("_root").alias("_top")).join(sizes, "_g")
    met = join_counted(groups.drop("_total"), above, "_g", "_total", own.count())
    return met.select(
        F.col("_key").alias(key), F.col("_group").alias(group), *(F.col("_keep")[n].alias(n) for n in keep),
        F.col("_leaf").alias("leaf"), F.col("_root").alias("subroot"), F.col("_top").alias("root"), F.concat("_path", "_rest").alias("path"),
    )
