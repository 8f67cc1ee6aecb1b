"""Quality of documents by a convolutional network over their bytes, in numpy.

A text's UTF-8 bytes are laid out in blocks; a chunk is a block and the next one, so that chunks overlap by half and cover the
whole text. Bytes have learnt vectors; learnt filters look at a window of bytes every few bytes, and each filter's largest
response in a chunk is the chunk's feature. A document's features are the mean and the maximum of its chunks', and a
logistic layer makes one probability of them. Training goes back through the windows that gave the maxima.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, fold, tidied

#: Bytes of a block, from one window to the next, and of a window; size of a byte's vector, and number of filters.
BLOCK, STEP, WINDOW, DIM, FILTERS = 512, 4, 12, 8, 32
TAPS = WINDOW // STEP
#: Blocks that are worked on at once: 64 kB of text.
SLAB = 128


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of all texts, and where each text's begin. After each text there is room for a window that starts in it."""
    room = np.array([-(-(len(t) + WINDOW) // BLOCK) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(room)])
    flat = np.zeros(first[-1] * BLOCK, np.uint8)
    for t, k in zip(texts, (first[:-1] * BLOCK).tolist(), strict=True):
        flat[k : k + len(t)] = np.frombuffer(t, np.uint8)
    return flat.reshape(-1, BLOCK), first


@dataclass
class Net:
    vectors: np.ndarray
    filters: np.ndarray  # (WINDOW * DIM, FILTERS)
    floor: np.ndarray
    mix: np.ndarray  # of the mean and the maximum of each filter
    bias: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator) -> Net:
        vectors = rng.normal(0, 0.5, (256, DIM))
        vectors[0] = 0
        return cls(*(x.astype(np.float32) for x in (vectors, rng.normal(0, 0.25, (WINDOW * DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1))))

    def responses(self, blocks: np.ndarray, last: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """What each filter says of each window that starts in ``blocks``: (block, window, filter). ``follow``: the bytes after them; ``last``: whether a block is its text's last."""
        flat = np.concatenate([blocks.ravel(), follow])
        parts = self.vectors[flat].reshape(-1, STEP * DIM)
        taps = self.filters.reshape(TAPS, STEP * DIM, FILTERS)
        n = blocks.size // STEP
        out = parts[:n] @ taps[0]
        for k in range(1, TAPS):
            out += parts[k : k + n] @ taps[k]
        out = out.reshape(len(blocks), -1, FILTERS)
        # these windows would reach into the next text
        out[last, -(TAPS - 1) :] = -np.inf
        return out

    def block_maxima(self, blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each block, and the window that gave it."""
        last = np.zeros(len(blocks), bool)
        last[first[1:] - 1] = True
        best, where = np.empty((len(blocks), FILTERS), np.float32), np.empty((len(blocks), FILTERS), np.int64)
        for k in range(0, len(blocks), SLAB):
            own = blocks[k : k + SLAB]
            follow = np.zeros(WINDOW - STEP, np.uint8)
            if k + SLAB < len(blocks):
                follow[:] = blocks[k + SLAB, : WINDOW - STEP]
            r = self.responses(own, last[k : k + SLAB], follow)
            where[k : k + SLAB] = at = r.argmax(axis=1)
            best[k : k + SLAB] = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
        return best, where

    def features(self, best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the mean and maximum over its chunks; also the chunks' own features, and the first chunk of each text."""
        size = np.diff(first)
        chunks = np.maximum(best, 0 - self.floor) + self.floor
        pair = np.ones(len(best), bool)
        pair[first[1:] - 1] = False
        chunks[:-1][pair[:-1]] = np.maximum(chunks[:-1], chunks[1:])[pair[:-1]]
        # a text of one block is one chunk; of others, the last block is in the chunk before it
        use = pair.copy()
        use[first[:-1][size == 1]] = True
        chunks = chunks[use]
        start = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 1))])
        mean = np.add.reduceat(chunks, start[:-1]) / np.diff(start)[:, None]
        return np.hstack([mean, np.maximum.reduceat(chunks, start[:-1])]), chunks, start

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        blocks, first = laid_out(texts)
        best, _ = self.block_maxima(blocks, first)
        z = self.features(best, first)[0].astype(float) @ self.mix.astype(float) + float(self.bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradient(net: Net, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted log loss, for each array of the network."""
    blocks, first = laid_out(texts)
    best, where = net.block_maxima(blocks, first)
    x, chunks, start = net.features(best, first)
    n = np.diff(start)
    p = 1 / (1 + np.exp(-np.clip(x @ net.mix + net.bias[0], -30, 30)))
    slope = (weight * (p - y) / weight.sum()).astype(np.float32)
    back = slope[:, None] * net.mix
    # a chunk's feature counts in the mean, and the document's largest in the maximum
    of = np.repeat(np.arange(len(n)), n)
    top = (chunks == x[of, FILTERS:]).astype(np.float32)
    per_chunk = (back[:, :FILTERS] / n[:, None])[of] + back[of, FILTERS:] * top / np.add.reduceat(top, start[:-1])[of]
    per_chunk = np.where(chunks > 0, per_chunk, 0).astype(np.float32)
    # a chunk is its first block and the next; the one with the larger response takes the slope
    head = first[:-1][of] + np.arange(len(of)) - start[:-1][of]
    nxt = np.minimum(head + 1, first[1:][of] - 1)
    block = np.where(best[head] >= best[nxt], head[:, None], nxt[:, None])
    filt = np.broadcast_to(np.arange(FILTERS), block.shape)
    live = per_chunk != 0
    block, filt, slopes = block[live], filt[live], per_chunk[live]
    at = block * BLOCK + where[block, filt] * STEP
    flat = np.concatenate([blocks.ravel(), np.zeros(WINDOW, np.uint8)])
    seen = flat[at[:, None] + np.arange(WINDOW)]
    inputs = net.vectors[seen].reshape(len(at), WINDOW * DIM)
    g_filters, g_vectors, g_floor = np.zeros_like(net.filters), np.zeros_like(net.vectors), np.zeros_like(net.floor)
    order = np.argsort(filt, kind="stable")
    cuts = np.searchsorted(filt[order], np.arange(FILTERS + 1))
    for f in range(FILTERS):
        own = order[cuts[f] : cuts[f + 1]]
        if len(own):
            g_filters[:, f] = slopes[own] @ inputs[own]
            g_floor[f] = slopes[own].sum()
            # a byte's vector is met at each place of the window
            share = np.zeros((256, WINDOW), np.float32)
            np.add.at(share, (seen[own], np.arange(WINDOW)), slopes[own, None])
            g_vectors += share @ net.filters[:, f].reshape(WINDOW, DIM)
    g_vectors[0] = 0
    return [g_vectors, g_filters, g_floor, (x * slope[:, None]).sum(axis=0).astype(np.float32), np.array([slope.sum()], np.float32)]


def _part(text: bytes, rng: np.random.Generator, blocks: int) -> bytes:
    """A run of at most ``blocks`` blocks, at a place drawn anew."""
    n = blocks * BLOCK
    at = int(rng.integers(0, len(text) - n)) if len(text) > n else 0
    return text[at : at + n]


def fit(texts: list[str], labels: list[int], share: float, steps: int = 500, batch: int = 32, rate: float = 0.01, l2: float = 1e-4, blocks: int = 24, seed: int = 11) -> Net:
    """The network of the sample, as if ``share`` of all rows were labelled 1. A step sees at most ``blocks`` blocks of a text, drawn anew each time. Without labels of both kinds, ``share`` is every text's score."""
    rng = np.random.default_rng(seed)
    net = Net.new(rng)
    share = min(max(share, 1e-3), 1 - 1e-3)
    net.bias[0] = np.log(share / (1 - share))
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        net.mix[:] = 0
        return net
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    raw = [t.encode("utf-8", "replace") for t in texts]
    names = [f.name for f in fields(net)]
    first = [np.zeros_like(getattr(net, n)) for n in names]
    second = [np.zeros_like(getattr(net, n)) for n in names]
    done, order = 0, np.empty(0, int)
    for k in range(1, steps + 1):
        if done >= len(order):
            done, order = 0, rng.permutation(len(raw))
        own = order[done : done + batch]
        done += batch
        grads = _gradient(net, [_part(raw[j], rng, blocks) for j in own], y[own], weight[own])
        pace = rate * (1 - (k - 1) / steps)
        for n, g, m, v in zip(names, grads, first, second, strict=True):
            if n != "bias":
                g = g + l2 * getattr(net, n)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            getattr(net, n)[...] -= pace * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = 1200, text: str = "text", key: str = "doc_id", label: str = "quality") -> tuple[list[str], list[int], float]:
    """At most ``rows`` different rows of each label with whole texts, picked by a hash of key and text, and the share of label 1 among all labels."""
    own = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where("_key is not null and _y in (0, 1)").distinct()
    counts = {r["_y"]: r["n"] for r in own.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    docs = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_key", "_text"))
    # rows are picked by their hashes, so that texts move only of those that are picked
    met = docs.select("_key", "_hash").join(own, "_key").distinct()
    parts = [met.where(F.col("_y") == y).orderBy("_hash", "_key").limit(rows) for y in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    got = docs.join(picked, ["_key", "_hash"]).dropDuplicates(["_key", "_hash", "_y"]).select("_key", "_hash", "_text", "_y").collect()
    got.sort(key=lambda r: (r["_y"], r["_hash"], r["_key"]))
    return [r["_text"] for r in got], [r["_y"] for r in got], counts.get(1, 0) / sum(counts.values()) if counts else 0.5


def quality(docs: DataFrame, net: Net, text: Column) -> Column:
    """The network's probability of each whole text; null is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in tidied(batches):
            out = []
            for at in range(0, len(batch), 250):
                raw = [t or b"" for t in batch.slice(at, 250).cast(pa.binary()).to_pylist()]
                out.append(own.scores(raw))
            # sums in single precision differ in their last digits by what else is in the batch
            yield pa.array(np.round(np.concatenate(out or [np.empty(0)]), 5), pa.float64())

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5, least: float = 0.3, rows: int = 1200) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; input columns of those names are replaced.

    Labels of rows of fold 0 are not learnt from, and keys, languages and sources are not seen by the score. A key labelled
    both ways counts for both. Null and empty texts get the score of a text without any response; repeated rows get
    equal scores; an empty table gives an empty result; without labels every score is one half, with labels of one
    kind all scores are alike.
    """
    net = fit(*labelled_sample(docs, labels.where(fold(F.col(key), folds) != 0), rows, text, key))
    found = docs.select(F.struct("*").alias("_row"), quality(docs, net, F.col(text)).alias("_score"))
    return add_columns(
        found, "_row",
        {"held_out": fold(F.col("_row")[key], folds) == 0, "score": F.col("_score"), "predicted": (F.col("_score") >= least).cast("int")},
    )
