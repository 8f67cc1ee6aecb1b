"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is the set of its five-word shingles. Each of ``TREES`` prefix tries holds all signatures by ``DEPTH``
minhashes; texts under one node of some tree are candidates. A pair of similarity s is met at depth k with probability
1 - (1 - s**k)**TREES. The join starts from the leaves and shortens the prefix until the least similar links are met
as surely as asked for; what deeper nodes would meet is met there too, so candidates are gathered once, at that
depth. It depends on the target and never on what other texts are in the table.

Texts with the same words in the same order are one, with a number of copies. Candidates are verified by
blocks, which are bounded by the number and the length of their texts: texts lie by the largest node that they are in, and
two blocks meet once if they share a node. A task counts the links of each text and keeps only a spanning forest of
them, so that what it hands on grows with its texts and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, join_counted, kept, tidied

SHINGLE = 5
TREES, DEPTH = 16, 8
#: Weight of a block; a text weighs 1 and another 1 for each ``LONG`` shingles.
BLOCK, LONG = 512, 512
#: Rounds in which candidates gather before they are dealt to blocks.
GATHERINGS = 1
#: Blocks of one node that a task pairs with the node's others.
SALT = 32
#: Words whose hashes a task remembers.
REMEMBERED = 50_000
_ODD = (np.random.default_rng(11).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str, hashes: _Hashes) -> np.ndarray:
    # split() of bytes knows ASCII's kinds of space only
    return np.fromiter(map(hashes.__getitem__, text.encode().split()), np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """The set, sorted. Of fewer than five words, all of them are one shingle; of none there is none."""
    n = max(1, len(words) - SHINGLE + 1)
    if not len(words):
        return words
    x = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        x = _mix(x * _P + words[k : k + n])
    return np.unique(x)


def signature(own: np.ndarray) -> np.ndarray:
    out = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        np.minimum(out, (own[None, at : at + 2048] * _ODD[:, None]).min(axis=1), out=out)
    return out


def nodes(sig: np.ndarray) -> np.ndarray:
    """Of each depth and tree, the node that the signature passes through."""
    x = _mix(np.arange(1, TREES + 1, dtype=np.uint64) * _P)
    out = np.empty((DEPTH, TREES), np.uint64)
    for k, level in enumerate(sig.reshape(TREES, DEPTH).T):
        x = out[k] = _mix(x * _P + level)
    return out


def found_share(s: float, depth: int) -> float:
    return 1 - (1 - s**depth) ** TREES


def shortened(least: float, target: float) -> int:
    """The longest prefix, from the leaves down, at which a pair of any similarity from ``least`` up is met with probability ``target``."""
    for k in range(DEPTH, 0, -1):
        if found_share(least, k) >= target:
            return k
    raise ValueError(f"{TREES} trees don't meet pairs of similarity {least} with probability {target}")


def _signed(rows: DataFrame, depth: int) -> DataFrame:
    """``_id, _key, seq, weight`` and the nodes at ``depth`` of each row's ``_text``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in tidied(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                seq, weight, own_nodes = [], [], []
                for t in part.column(2):
                    w = word_hashes(t.as_py(), hashes)
                    own = shingles(w)
                    seq.append(xxhash.xxh3_128_hexdigest(w.tobytes()))
                    weight.append(1 + len(own) // LONG)
                    own_nodes.append(nodes(signature(own))[depth - 1])
                flat = np.array(own_nodes).reshape(-1, TREES).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seq) + 1, dtype=np.int32) * TREES), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(seq), pa.array(weight, pa.int64()), lists], ["_id", "_key", "seq", "weight", "nodes"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.select("_id", "_key", "_text").mapInArrow(sign, f"_id long, _key {kind}, seq string, weight long, nodes array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _common(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets, where wanted."""
    out = np.zeros(wanted.shape, np.int64)
    pairs = np.argwhere(wanted)
    if len(pairs) <= 4 * sum(wanted.shape):
        for i, j in pairs:
            x, y = (a[i], b[j]) if len(a[i]) <= len(b[j]) else (b[j], a[i])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[i, j] = int((y[at] == x).sum()) if len(y) else 0
        return out
    values, code, n = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[code]
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    keep = column >= 0
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = 4096
    total = np.zeros(wanted.shape, np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        dense = np.zeros((len(a) + len(b), step), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        total += dense[: len(a)] @ dense[len(a) :].T
    return np.rint(total).astype(np.int64)


def verified(own: pa.Table, least: float) -> pa.Table:
    """Links between the texts of two blocks, or inside one if no row is of side 1: edges of a forest (a, b) and counts (a, none, n)."""
    hashes = _Hashes()
    side = own["side"].to_numpy()
    one = not side.any()
    sides = []
    for k in (0,) if one else (0, 1):
        t = own.filter(pa.array(side == k))
        at = t["nodes"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        sides.append((t["_id"].to_pylist(), at, [shingles(word_hashes(x.as_py(), hashes)) for x in t["_text"]], np.array(t["copies"].to_pylist(), np.int64)))
    (ids, at, sets, copies), (ids2, at2, sets2, copies2) = sides[0], sides[-1]
    wanted = np.zeros((len(ids), len(ids2)), bool)
    for t in range(TREES):
        wanted |= at[:, t, None] == at2[None, :, t]
    if one:
        wanted &= np.triu(np.ones(wanted.shape, bool), 1)
    size, size2 = np.array([len(x) for x in sets], np.int64), np.array([len(x) for x in sets2], np.int64)
    # sets of too different sizes can't be that similar
    wanted &= np.minimum(size[:, None], size2[None, :]) >= least * np.maximum(size[:, None], size2[None, :]) - 1e-9
    both = _common(sets, sets2, wanted)
    union = size[:, None] + size2[None, :] - both
    linked = wanted & (both >= least * union - 1e-9) & (union > 0)
    n1, n2 = linked @ copies2, linked.T @ copies
    rows: list[tuple[int, int | None, int]] = []
    forest = _Forest(len(ids) + (0 if one else len(ids2)))
    shift = 0 if one else len(ids)
    for i, j in np.argwhere(linked):
        if forest.join(int(i), int(j) + shift):
            rows.append((ids[i], ids2[j], 0))
    rows += [(x, None, int(n)) for x, n in zip(ids, n1, strict=True) if n]
    rows += [(x, None, int(n)) for x, n in zip(ids2, n2, strict=True) if n]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})


def _met(seen: DataFrame) -> DataFrame:
    """``block, with``: each pair of blocks once, and each block with itself, if they have two texts under one node.

    ``seen`` has ``node, block, m``. A node in b blocks is dealt to b / SALT tasks, each of which pairs all of its blocks with a share of them.
    """
    many = kept(seen.groupBy("node").agg(F.count("*").alias("b")).where("b > 1"))
    total = many.agg(F.sum("b")).first()[0] or 0
    across = kept(join_counted(seen, many, "node", "b", total)).withColumn("salts", F.ceil(F.col("b") / SALT).cast("long"))
    left = across.select("node", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    right = across.select("node", F.pmod(F.xxhash64("block"), F.col("salts")).alias("salt"), F.col("block").alias("with"))
    pairs = left.join(right, ["node", "salt"]).where("block < with").select("block", "with").distinct()
    return kept(pairs.unionByName(seen.where("m > 1").select("block", F.col("block").alias("with")).distinct()))


def _links(reps: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """What ``verified`` gives for all pairs of texts that share a node."""
    each = reps.select("_id", "weight", F.explode("nodes").alias("node"))
    groups = kept(each.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
    total = groups.agg(F.sum("n")).first()[0]
    if not total:
        return reps.sparkSession.createDataFrame([], "a long, b long, n long")
    members = kept(join_counted(each, groups, "node", "n", total))
    home = members.groupBy("_id").agg(F.max(F.struct("n", "node")).alias("home"), F.first("weight").alias("weight"))
    for _ in range(GATHERINGS):  # texts that share any node move to the largest that one of them is in
        best = kept(members.join(home.select("_id", "home"), "_id").groupBy("node").agg(F.max("home").alias("home"), F.count("*").alias("n")))
        home = join_counted(members.select("_id", "node", "weight"), best, "node", "n", total).groupBy("_id").agg(F.max("home").alias("home"), F.first("weight").alias("weight"))
    home = kept(home)
    sizes = kept(home.groupBy("home").agg(F.sum("weight").alias("size")))
    part = F.pmod(F.xxhash64("_id"), F.ceil(F.col("size") / BLOCK))
    home = kept(join_counted(home, sizes, "home", "size", sizes.agg(F.sum("size")).first()[0]).select("_id", F.xxhash64("home", part).alias("block")))
    pairs = _met(kept(members.join(home, "_id").groupBy("node", "block").agg(F.count("*").alias("m"))))
    both = [F.col("block").alias("p"), F.col("with").alias("q")]
    places = pairs.select("block", *both, F.lit(0).alias("side")).unionByName(pairs.where("block <> with").select(F.col("with").alias("block"), *both, F.lit(1).alias("side")))
    # ids go to their pairs of blocks first, and then the texts once, to where they are needed
    wanted = home.join(places, "block").select("_id", "p", "q", "side")
    sent = reps.select("_id", "copies", "nodes").join(wanted, "_id").join(texts, "_id")
    return kept(sent.groupBy("p", "q").applyInArrow(lambda own: verified(own, least), "a long, b long, n long"))


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` of all ends of the edges ``a, b``: the least id of the component.

    In each round every id goes to the least of itself and its neighbours, and edges are drawn between what their ends went
    to; there are fewer than half as many ids with edges after two rounds.
    """
    now = kept(edges.where("a <> b").select("a", "b").distinct())
    labels = kept(now.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")))
    while n := now.count():
        both = kept(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"), F.count("*").alias("n")))
        moved = join_counted(both, least, "a", "n", 2 * n).select(F.col("to").alias("x"), F.col("b").alias("a"))
        moved = join_counted(moved, least, "a", "n", 2 * n).select(F.col("x").alias("a"), F.col("to").alias("b"))
        counts = labels.groupBy("label").agg(F.count("*").alias("n"))
        step = counts.join(least.select(F.col("a").alias("label"), "to"), "label", "left").select("label", F.coalesce("to", "label").alias("to"), "n")
        labels = kept(join_counted(labels, step, "label", "n", labels.count()).select("id", F.col("to").alias("label")))
        now = kept(moved.where("a < b").distinct())
    return labels


def near_join(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8, target: float = 0.999) -> DataFrame:
    """Every row of ``docs`` with ``class_id``, ``class_size``, ``n_links`` and ``kept``.

    Rows are linked if their shingle sets have a Jaccard similarity of ``least`` or more, or the same words in the
    same order, as texts without words (null, empty) have. Classes are the components of the links, their id is the least key
    in them (null keys come last), and one row with that key is kept. ``n_links`` counts all rows that the row is
    linked with, copies too. Each link between different texts, whatever its similarity, is met with probability
    ``target`` or more.
    """
    depth = shortened(least, target)
    order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_id").alias("id"))
    rows = kept(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_id")))
    rows = rows.select("_row", "_id", F.col("_row")[key].alias("_key"), F.coalesce(F.col("_row")[text].cast("string"), F.lit("")).alias("_text"))
    signed = kept(_signed(rows, depth))
    copies = kept(signed.groupBy("seq").agg(F.min(order).alias("first"), F.count("*").alias("copies")))
    reps = kept(signed.join(copies.select(F.col("first.id").alias("_id"), "copies"), "_id").select("_id", "copies", "weight", "nodes"))
    links = _links(reps, rows.select("_id", "_text"), least)
    labels = components(links.where("b is not null"))
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    of = copies.select("seq", "first", "copies", F.col("first.id").alias("id")).join(labels, "id", "left").join(counts, "id", "left")
    of = kept(of.select("seq", "first", "copies", F.coalesce("label", "id").alias("label"), F.coalesce("links", F.lit(0).cast("long")).alias("links")))
    classes = of.groupBy("label").agg(F.min("first").alias("keeper"), F.sum("copies").alias("size"), F.count("*").alias("texts"))
    of = kept(join_counted(of, classes, "label", "texts", of.count()).select("seq", "copies", "links", "keeper", "size"))
    mine = join_counted(signed.select("_id", "seq"), of, "seq", "copies", rows.count())
    out = rows.select("_row", "_id").join(mine, "_id")
    return add_columns(
        out, "_row",
        {"class_id": F.col("keeper.key"), "class_size": F.col("size"), "n_links": F.col("links") + F.col("copies") - 1, "kept": F.col("keeper.id") == F.col("_id")},
    )
