"""Byte-level BPE encoding and decoding.

Pairs wait in a queue of buckets, one for each merge rank, that hold positions of a linked list. A bitmap of
two levels tells which buckets hold something: the highest bit of the top word and then of one word below,
both mirrored, gives the least rank. A merge leaves entries of its neighbours behind; they are skipped when they come up, because
the rank now noted at their position is another. Each of the n bytes of a pre-token enters and leaves a
bounded number of times, so that a pre-token of a million bytes costs about n log n and not n squared.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidied

WORD_BITS = 8
#: Pre-tokens of a generation, and the longest of them in characters. A task remembers the present and the last generation, some 40 MB.
REMEMBERED, LONGEST = 100_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder(dict):
    """Maps pre-tokens to the 32-bit ids of their tokens, and remembers them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        super().__init__()
        self.ranks, self.remembered = ranks, remembered
        self.last: dict[str, bytes] = {}
        self.find = regex.compile(pattern).findall
        self.words = [0] * ((max(ranks.values(), default=0) >> WORD_BITS) + 1)
        # mirrored, so that the length of a word gives the least that it holds
        self.bit = [1 << k for k in range((1 << WORD_BITS) - 1, -1, -1)]
        self.top_bit = [1 << k for k in range(len(self.words) - 1, -1, -1)]
        self.single = [ranks.get(bytes((x,))) for x in range(256)]
        self.pairs = [ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]

    def __missing__(self, token: str) -> bytes:
        ids = self.last.get(token)
        if ids is None:
            ids = array("i", self.merge(token.encode())).tobytes()
        if len(token) <= LONGEST:
            if len(self) >= self.remembered:
                self.last = dict(self)
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def merge(self, piece: bytes) -> list[int]:
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n, words, top, mask, pairs = len(piece), self.words, 0, (1 << WORD_BITS) - 1, self.pairs
        bit, top_bit, size = self.bit, self.top_bit, len(words)
        # a bucket of one position is that position, of several a heap
        buckets: dict[int, int | list[int]] = {}
        # the rank of the pair that starts at each place, or -1
        noted = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905
        for at, rank in enumerate(noted):
            if rank in buckets:
                held = buckets[rank]
                if held.__class__ is int:
                    buckets[rank] = [held, at]
                else:
                    held.append(at)
            elif rank >= 0:
                buckets[rank] = at
                bits = words[word := rank >> WORD_BITS]
                words[word] = bits | bit[rank & mask]
                if not bits:
                    top |= top_bit[word]
        noted += (-1, -1)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        single = self.single
        ids = [single[x] for x in piece]
        while top:
            bits = words[word := size - top.bit_length()]
            low = mask + 1 - bits.bit_length()
            rank = word << WORD_BITS | low
            at = buckets[rank]
            if at.__class__ is int:
                del buckets[rank]
                words[word] = bits = bits ^ bit[low]
                if not bits:
                    top ^= top_bit[word]
            else:
                bucket = at
                at = heappop(bucket)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            if noted[at] != rank:
                continue
            ids[at] = rank
            mid = after[at]
            end = after[at] = after[mid]
            before[end] = at
            ids[mid] = noted[mid] = noted[at] = -1
            left = before[at]
            if left >= 0:
                noted[left] = new = get(piece[left:end], -1)
                if new in buckets:
                    held = buckets[new]
                    if held.__class__ is int:
                        buckets[new] = [held, left] if held < left else [left, held]
                    else:
                        heappush(held, left)
                elif new >= 0:
                    buckets[new] = left
                    bits = words[word := new >> WORD_BITS]
                    words[word] = bits | bit[new & mask]
                    if not bits:
                        top |= top_bit[word]
            if end < n:
                noted[at] = new = get(piece[at : after[end]], -1)
                if new in buckets:
                    held = buckets[new]
                    if held.__class__ is int:
                        buckets[new] = [held, at] if held < at else [at, held]
                    else:
                        heappush(held, at)
                elif new >= 0:
                    buckets[new] = at
                    bits = words[word := new >> WORD_BITS]
                    words[word] = bits | bit[new & mask]
                    if not bits:
                        top |= top_bit[word]
        if None in ids:
            raise KeyError("a byte that the vocabulary lacks")
        return [x for x in ids if x >= 0]


def decoder(ranks: dict[bytes, int]) -> Callable[[np.ndarray], bytes]:
    """From ids to bytes; an id outside the vocabulary is an error."""
    known: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        known[rank] = token

    def decode(ids: np.ndarray) -> bytes:
        if len(ids) and ids.min() < 0:
            raise IndexError("an id below zero")
        return b"".join(map(known.__getitem__, ids.tolist()))

    return decode


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype=np.int64)
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch holds over 2**31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))


class ByteBPE:
    """A vocabulary of byte tokens, sent to the executors once; its size is that of its file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, remembered: int = REMEMBERED):
        self.ranks = spark.sparkContext.broadcast(load_ranks(path))
        self.pattern, self.remembered = pattern, remembered

    def encode(self, text: Column) -> Column:
        """The ids of the text's tokens; null gives none, as the empty text does."""
        ranks, pattern, remembered = self.ranks, self.pattern, self.remembered

        @F.arrow_udf("array<int>")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = Encoder(ranks.value, pattern, remembered)
            for batch in tidied(batches):
                yield _lists([own.encode(t.as_py() or "") for t in batch])

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for; null gives none. An id outside the vocabulary is an error."""
        ranks = self.ranks

        @F.arrow_udf("binary")
        def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = decoder(ranks.value)
            for batch in batches:
                yield pa.array([own(x.values.to_numpy()) if x.is_valid else b"" for x in batch], pa.binary())

        return text(ids)

    def round_trip(self, text: Column) -> Column:
        """A struct of ``ids`` and of ``decoded``, the bytes that these ids stand for: both ways in one Python worker."""
        ranks, pattern, remembered = self.ranks, self.pattern, self.remembered

        @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            there, back = Encoder(ranks.value, pattern, remembered), decoder(ranks.value)
            for batch in tidied(batches):
                parts = [there.encode(t.as_py() or "") for t in batch]
                decoded = pa.array([back(np.frombuffer(x, "<i4")) for x in parts], pa.binary())
                yield pa.StructArray.from_arrays([_lists(parts), decoded], ["ids", "decoded"])

        return both(text)


def encode_documents(docs: DataFrame, bpe: ByteBPE, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (an input column of that name is replaced)."""
    return docs.withColumn("ids", bpe.encode(F.col(text)))


def decode_documents(docs: DataFrame, bpe: ByteBPE, ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``decoded`` of bytes (an input column of that name is replaced)."""
    return docs.withColumn("decoded", bpe.decode(F.col(ids)))


def round_trip_documents(docs: DataFrame, bpe: ByteBPE, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` (input columns of these names are replaced)."""
    return docs.withColumn("ids", bpe.round_trip(F.col(text))).withColumn("decoded", F.col("ids.decoded")).withColumn("ids", F.col("ids.ids"))
