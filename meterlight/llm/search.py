"""Exact top-k search by BM25, with bounds by segments of documents.

Documents lie in shards of bounded size. A task builds a shard's inverted index: postings by term and document,
documents of like vocabulary side by side, and for each segment of documents a matrix of its frequent words with their
largest impacts. A query is weighted by statistics of all documents before it goes to the shards. In a shard, what a query
has from rare words is added up first; the product with a segment's matrix follows only where both parts' bound reaches
the k-th best score so far. That score starts from what a few shards have found, which can't be above the final one, and
rises from shard to shard. So the merged lists are exactly those of scoring everything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import kept, shared_folder, text_of, tidied

K1, B = 1.2, 0.75
SHARD_BYTES = 16 << 20
#: Words of the queries that go through the index at once, about; 16 bytes each.
QUERY_TERMS = 1 << 20
#: Blocks of queries for which a shard is read and made once.
BLOCKS_AT_ONCE = 4
#: Documents of a shard whose frequent words lie in one matrix.
SEGMENT = 512
#: Words of at least one in ``OFTEN`` documents, by the geometric mean of a shard's share and the segment's, and of ``OFTEN_LEAST`` in the segment, lie in its matrix.
OFTEN, OFTEN_LEAST = 16, 8
BATCH_CELLS = 1 << 19
FILTER_BITS, FILTER_PART = 1 << 26, 1 << 18
#: Ranges of words that counts are added up by, and words that a task holds before it hands them on.
COUNT_PARTS, COUNT_HELD = 64, 1 << 20


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, A-Z in lower case, ascending, and how often each comes."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode().lower().split()), np.uint64)
    own.sort()
    edge = np.flatnonzero(np.append(own[1:] != own[:-1], len(own) > 0))
    return own[edge], np.diff(edge, prepend=-1)


def _lists(parts: list[np.ndarray], dtype: str) -> pa.Array:
    flat = np.concatenate([np.empty(0, dtype), *parts]).astype(dtype)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat))


def postings(docs: list[tuple[np.ndarray, np.ndarray]], keep: Callable[[np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """Of a shard's documents: their order, lengths in that order, the terms to keep, ascending, how many documents have each, and which, how often."""
    lengths = np.array([n.sum() for _, n in docs], np.int64)
    term = np.concatenate([np.empty(0, np.uint64), *(t for t, _ in docs)])
    tf = np.concatenate([np.empty(0, np.int64), *(n for _, n in docs)])
    doc = np.repeat(np.arange(len(docs)), [len(t) for t, _ in docs])
    # documents by their most frequent word: those of a language, and of a kind, share segments
    mode = np.array([int(t[n.argmax()] >> np.uint64(1)) if len(t) else 0 for t, n in docs], np.int64)
    order = np.lexsort((lengths, mode))
    place = np.empty(len(docs), np.int64)
    place[order] = np.arange(len(docs))
    own = keep(term)
    term, tf, doc = term[own], tf[own], place[doc[own]]
    by = np.lexsort((doc, term))
    every, n = np.unique(term, return_counts=True)
    return {"order": order, "lengths": lengths[order], "term": every, "n": n, "doc": doc[by], "tf": tf[by]}


class Index:
    """A shard's postings, in two parts by segments of ``SEGMENT`` documents, and all of them by document.

    Words of many of a segment's documents lie as a matrix, so that a whole batch of queries gets their part of the scores by
    one product; all other postings lie by term and are added up for each query. What a query has from these is known
    first: a segment is left out where that and the largest impacts of its matrix stay below the query's bar. The products
    are in single precision: ``slack`` covers their error, and what may be among the best is scored again from the postings of
    its document.
    """

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, mean_length: float):
        self.build(mean_length, **postings(docs, lambda term: np.isin(term, wanted)))

    @classmethod
    def of(cls, mean_length: float, **stored: np.ndarray) -> Index:
        own = cls.__new__(cls)
        own.build(mean_length, **stored)
        return own

    def build(self, mean_length: float, order: np.ndarray, lengths: np.ndarray, term: np.ndarray, n: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        self.order, self.terms, self.docs = order, term, len(lengths)
        impact = tf * (K1 + 1) / (tf + norm[doc])
        code = np.repeat(np.arange(len(term), dtype=np.int32), n)
        segment = doc // SEGMENT
        edge = np.ones(len(code), bool)
        edge[1:] = (code[1:] != code[:-1]) | (segment[1:] != segment[:-1])
        start = np.flatnonzero(edge)  # of each run of a term in a segment
        span, at, of = np.diff(np.append(start, len(code))), segment[start], code[start]
        size = np.minimum(SEGMENT, len(lengths) - at * SEGMENT)
        often = (span >= OFTEN_LEAST) & (span * n[of] * OFTEN**2 >= size * len(lengths))

        self.column = np.full(len(term), -1)
        frequent = np.unique(of[often])
        self.column[frequent] = np.arange(len(frequent))
        self.columns = len(frequent)
        self.segments = []
        for k in range(-(-len(lengths) // SEGMENT)):
            lo, hi = k * SEGMENT, min((k + 1) * SEGMENT, len(lengths))
            runs = np.flatnonzero(often & (at == k))
            post = _ranges(start[runs], span[runs])
            matrix = np.zeros((len(runs), hi - lo), np.float32)
            matrix[np.repeat(np.arange(len(runs)), span[runs]), doc[post] - lo] = impact[post]
            self.segments.append((lo, hi, self.column[of[runs]], matrix, matrix.max(axis=1)))
        self.slack = 1 + 2.0**-22 * (max((len(x[2]) for x in self.segments), default=0) + 8)

        rest = ~np.repeat(often, span)
        pairs = np.empty((np.count_nonzero(rest), 2), np.int32)  # document, and impact in single precision: read as one number
        pairs[:, 0], pairs[:, 1] = doc[rest], impact[rest].astype(np.float32).view(np.int32)
        self.rare = pairs.reshape(-1).view(np.int64)
        self.rare_n = np.bincount(code[rest], minlength=len(term))
        self.rare_at = np.cumsum(self.rare_n) - self.rare_n

        by = _by_document(doc, len(lengths))
        self.by_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lengths)))])
        self.doc_term, self.doc_impact = code[by], impact[by]
        self.weight = np.zeros(len(term))  # of the words of the query whose documents are scored again

    def search(self, query: np.ndarray, weight: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the shard's order) that may be among the k best with ``least`` or more, and their scores. Words ascend."""
        found = [x[1:] for x in self.search_all(query, np.array([0, len(query)]), np.arange(len(query)), weight, k, np.array([least]))]
        return found[0] if found else (np.empty(0, np.int64), np.empty(0))

    def search_all(self, every: np.ndarray, edges: np.ndarray, code: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``search`` for each query, with its number, where it finds any. Words of query j are the places ``code[edges[j]:edges[j + 1]]`` in ``every``; batches keep weights and scores at ``BATCH_CELLS`` numbers each."""
        if not len(self.terms):
            return
        places = np.searchsorted(self.terms, every)
        places[places == len(self.terms)] = 0
        places[self.terms[places] != every] = -1
        at = places[code]
        hit = at >= 0
        edges = np.concatenate([[0], np.cumsum(hit)])[edges]
        at, weight = at[hit], weight[hit]
        step = max(1, min(256, BATCH_CELLS // max(1, self.columns, self.docs)))
        for lo in range(0, len(edges) - 1, step):
            own = edges[lo : lo + step + 1]
            for j, docs, total in self._batch(own - own[0], at[own[0] : own[-1]], weight[own[0] : own[-1]], k, least[lo : lo + step]):
                yield lo + j, docs, total

    def _batch(self, edges: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        many, cuts = len(edges) - 1, edges.tolist()
        column = self.column[at]
        often = np.flatnonzero(column >= 0)
        weights = np.zeros((self.columns, many), np.float32)
        weights[column[often], np.repeat(np.arange(many), np.diff(edges))[often]] = weight[often]
        scores = np.zeros((many, self.docs), np.float32)
        n = self.rare_n[at]
        ends, single = np.cumsum(n), weight.astype(np.float32)
        shift, sums = self.rare_at[at] - (ends - n), np.concatenate([[0], ends])[edges].tolist()
        places = np.arange(sums[-1])
        for j, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if sums[j] < sums[j + 1]:
                post = np.repeat(shift[lo:hi], n[lo:hi])
                post += places[sums[j] : sums[j + 1]]
                pairs = np.take(self.rare, post, mode="clip")
                part = np.repeat(single[lo:hi], n[lo:hi])
                part *= pairs.view(np.float32)[1::2]
                scores[j] = np.bincount(pairs.view(np.int32)[::2], part, self.docs)
        most = np.maximum.reduceat(scores, [x[0] for x in self.segments], axis=1)

        bar = least - 1e-9
        for (lo, hi, columns, matrix, top), rest in zip(self.segments, most.T, strict=True):
            own = weights[columns]
            bound = top @ own
            live = np.flatnonzero((bound > 0) & ((bound + rest) * self.slack >= bar))
            if len(live) == many:
                scores[:, lo:hi] += own.T @ matrix
            elif len(live):
                scores[live, lo:hi] += own[:, live].T @ matrix

        bare = np.flatnonzero(least <= 0)
        if len(bare) and k <= self.docs:  # without a bar from other shards, the k best here make one
            bar[bare] = np.partition(scores[bare], -k, axis=1)[:, -k] / self.slack - 1e-9
        found = scores >= np.maximum(bar / self.slack, 1e-37).astype(np.float32)[:, None]
        for j in np.flatnonzero(found.any(axis=1)).tolist():
            docs = np.flatnonzero(found[j])
            if len(docs) > k:
                near = scores[j, docs]
                docs = docs[near * self.slack >= np.partition(near, -k)[-k] / self.slack - 1e-9]
            total = self._full(docs, at[cuts[j] : cuts[j + 1]], weight[cuts[j] : cuts[j + 1]])
            keep = total >= (max(least[j], np.partition(total, -k)[-k]) if len(total) > k else least[j]) - 1e-9
            if keep.any():
                yield j, self.order[docs[keep]], total[keep]

    def _full(self, docs: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores added up word by word in the order of words, so that a document's sum doesn't depend on its shard."""
        self.weight[at] = weight
        n = self.by_doc[docs + 1] - self.by_doc[docs]
        post = _ranges(self.by_doc[docs], n)
        own = self.weight[self.doc_term[post]]
        hit = np.flatnonzero(own)
        self.weight[at] = 0
        return np.bincount(np.repeat(np.arange(len(docs)), n)[hit], own[hit] * self.doc_impact[post[hit]], len(docs))


def _by_document(doc: np.ndarray, docs: int) -> np.ndarray:
    """The order of postings by document, words ascending in each; numbers of 16 bits sort by their digits."""
    by = np.argsort((doc & 0xFFFF).astype(np.uint16), kind="stable")
    return by if docs <= 1 << 16 else by[np.argsort((doc[by] >> 16).astype(np.uint16), kind="stable")]


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo .. lo + n - 1 of each, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)


STORED = {"lengths": np.int32, "term": np.uint64, "n": np.int32, "doc": np.int32, "tf": np.int32}


def _indexed(rows: DataFrame, shards: int, wanted: Broadcast) -> DataFrame:
    """A row for each shard: its keys in the shard's order, and its postings of words that some query may have, as packed arrays."""
    mask = np.uint64(FILTER_BITS - 1)

    def some(term: np.ndarray) -> np.ndarray:
        bit = term & mask
        return ((wanted.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def build(own: pa.Table) -> pa.Table:
        p = postings([terms(t.as_py()) for t in own["text"]], some)
        keys = own["key"].combine_chunks().take(pa.array(p["order"]))
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.table({"shard": own["shard"][:1], "keys": lists, **{c: pa.array([p[c].astype(t).tobytes()]) for c, t in STORED.items()}})

    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("int"))
    return kept(rows.groupBy("shard").applyInArrow(build, f"shard int, keys array<{kind}>, " + ", ".join(f"{c} binary" for c in STORED)))


def _summed(term: list[np.ndarray], df: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms, ascending, each once, and the sums of their counts."""
    every, place = np.unique(np.concatenate([np.empty(0, np.uint64), *term]), return_inverse=True)
    return every, np.bincount(place, np.concatenate([np.empty(0, np.int64), *df]), len(every)).astype(np.int64)


def _packed_counts(index: DataFrame) -> DataFrame:
    """The counts of a task's shards, added up, as packed arrays, one for each of ``COUNT_PARTS`` ranges of terms: a shard's words aren't rows, so that rows don't grow with shards times words."""

    def packed(term: list[np.ndarray], df: list[np.ndarray], total: int) -> pa.RecordBatch:
        every, n = _summed(term, df)
        edges = [*np.searchsorted(every, np.arange(COUNT_PARTS, dtype=np.uint64) * np.uint64((1 << 64) // COUNT_PARTS)).tolist(), len(every)]
        cut = lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        lengths = np.zeros(COUNT_PARTS, np.int64)
        lengths[0] = total
        return pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), cut(every), cut(n), pa.array(lengths)], ["part", "terms", "counts", "length"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, dfs, total, held = [], [], 0, 0
        for b in batches:
            for term, n, lengths in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                terms.append(np.frombuffer(term, np.uint64))
                dfs.append(np.frombuffer(n, np.int32))
                total += int(np.frombuffer(lengths, np.int32).sum(dtype=np.int64))
                held += len(terms[-1])
                if held >= COUNT_HELD:
                    yield packed(terms, dfs, total)
                    terms, dfs, total, held = [], [], 0, 0
        if terms:
            yield packed(terms, dfs, total)

    return index.select("term", "n", "lengths").mapInArrow(counts, "part int, terms binary, counts binary, length long")


def _counted(index: DataFrame) -> DataFrame:
    """``term, df``, and at term 0 with df 0 the sums of lengths in ``length``."""

    def added(own: pa.Table) -> pa.Table:
        every, n = _summed([np.frombuffer(x, np.uint64) for x in own["terms"].to_pylist()], [np.frombuffer(x, np.int64) for x in own["counts"].to_pylist()])
        length = np.append(np.zeros(len(every), np.int64), sum(own["length"].to_pylist()))
        return pa.table({"term": np.append(every.view(np.int64), 0), "df": np.append(n, 0), "length": length})

    return kept(_packed_counts(index).groupBy("part").applyInArrow(added, "term long, df long, length long"))


@dataclass
class Queries:
    """A block of queries: words of query j are the places ``codes[edges[j]:edges[j + 1]]`` in ``every``, ascending, with their weights, and ``least`` is what its k-th best has at least."""

    ids: list
    edges: np.ndarray
    every: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    least: np.ndarray
    kind: pa.DataType

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        lists = rows["terms"].combine_chunks()
        every, codes = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        # words ascend as numbers without sign: a document's score is added up in that order
        by = np.lexsort((codes, np.repeat(np.arange(rows.num_rows), np.diff(edges))))
        weights = rows["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return cls(rows["query"].to_pylist(), edges, every, codes[by].astype(np.int32), weights[by], np.zeros(rows.num_rows), rows.schema.field("query").type)


def _answers(index: DataFrame, sent: list[Broadcast], k: int, mean: float, result: str) -> DataFrame:
    """``query, key, score`` of what may be among the k best: of each task's shards the k best, which raise the bar from shard to shard. Each shard is made once for all blocks."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, kinds = [], None
        for b in batches:
            kinds = b.schema.field("keys").type.value_type
            for at in range(b.num_rows):  # a row is a whole shard
                (row,) = b.slice(at, 1).to_pylist()
                keys, stored = row["keys"], {c: np.frombuffer(row[c], t) for c, t in STORED.items()}
                shard = Index.of(mean, order=np.arange(len(keys)), **stored)
                if not blocks:
                    blocks = [(x.value, x.value.least.copy(), {}) for x in sent]
                for q, least, best in blocks:
                    for j, found, score in shard.search_all(q.every, q.edges, q.codes, q.weights, k, least):
                        new = [(-s, keys[d] is None, keys[d]) for s, d in zip(np.round(score, 9).tolist(), found.tolist(), strict=True)]
                        best[j] = sorted(best.get(j, []) + new, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:k]
                        if len(best[j]) == k:
                            least[j] = max(least[j], -best[j][-1][0])
                row = stored = shard = None  # before the next one is built
        for q, _, best in blocks:
            ids = [q.ids[j] for j, x in best.items() for _ in x]
            yield pa.RecordBatch.from_arrays([pa.array(ids, q.kind), pa.array([x[2] for y in best.values() for x in y], kinds), pa.array([-x[0] for y in best.values() for x in y], pa.float64())], ["query", "key", "score"])

    return index.select("keys", *STORED).mapInArrow(lambda batches: tidied(answer(batches)), result)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "doc_id", shard_bytes: int = SHARD_BYTES, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``query_id, rank, key, score`` of the k best rows of ``docs`` for each row of ``queries``, whole texts both.

    A word counts in a query as often as it comes. Equal scores (to 9 digits after the point) go by key, null last. Rows
    that share no word with a query aren't found; queries without words, null or empty, find nothing. Repeated rows are
    found each, and of queries with the same key the one with the least text is answered. Queries with a null key are left out, as
    their answers couldn't be told apart. Other columns don't matter and don't come back.

    Texts shuffle once, to make the index. Queries go to the index in blocks of about ``query_terms`` words, each broadcast, ``BLOCKS_AT_ONCE`` of them together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    shards = max(1, -(-(size["bytes"] or 0) // shard_bytes))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [terms(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([t.view(np.int64) for t, _ in got], "int64"), _lists([n for _, n in got], "int64")], ["query", "terms", "tf"])

    kind = queries.schema[query_key].dataType.simpleString()
    asked = queries.select(F.col(query_key).alias("query"), text_of(query_text).alias("text")).where("query is not null").groupBy("query").agg(F.min("text").alias("text"))
    asked = kept(asked.mapInArrow(split, f"query {kind}, terms array<long>, tf array<long>"))
    asked_terms = asked.select("query", F.inline(F.arrays_zip("terms", "tf"))).withColumnRenamed("terms", "term")

    # which words any query has, as bits: the index has only these. The filter's size is fixed; what it lets through finds no query.
    def packed(own: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_PART // 8, np.uint8)
        at = own["bit"].to_numpy() % FILTER_PART
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pa.table({"part": own["part"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    bit = F.col("term").bitwiseAND(FILTER_BITS - 1)
    parts = asked_terms.select(bit.alias("bit")).distinct().withColumn("part", F.expr(f"bit div {FILTER_PART}")).groupBy("part").applyInArrow(packed, "part long, bits binary")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # 8 MB in all
        bits[r.part * FILTER_PART // 8 : (r.part + 1) * FILTER_PART // 8] = np.frombuffer(r.bits, np.uint8)
    sent_bits = spark.sparkContext.broadcast(bits)
    index = _indexed(rows, shards, sent_bits)
    sent_bits.destroy()
    counts = _counted(index)
    mean = (counts.agg(F.sum("length")).first()[0] or 0) / max(1, size["n"])
    idf = F.log1p((F.lit(float(size["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked_terms.join(counts.where("df > 0").select("term", idf.alias("idf")), "term")
    words = F.sort_array(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w"))))
    weighted = weighted.groupBy("query").agg(words.alias("q"), F.max_by("term", "tf").alias("mode"))
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-n_terms // query_terms))
    weighted = kept(weighted.select("query", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("part"), "mode", F.col("q.term").alias("terms"), F.col("q.w").alias("weights")))

    result = f"query {kind}, key {rows.schema['key'].dataType.simpleString()}, score double"
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("key").isNull(), "key")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = math.isqrt(shards - 1) + 1
    at = shared_folder(spark)
    for lo in range(0, blocks, BLOCKS_AT_ONCE):
        # queries with the same most frequent word, and so mostly of a language, lie side by side, as documents do
        group = [Queries.of(weighted.where(F.col("part") == part).orderBy("mode", "query").select("query", "terms", "weights").toArrow()) for part in range(lo, min(lo + BLOCKS_AT_ONCE, blocks))]
        # what some shards have k times is a bar for the others
        alone = [spark.sparkContext.broadcast(q) for q in group]
        few = kept(ranked(_answers(index.where(F.col("shard") < first), alone, k, mean, result)))
        for x in alone:
            x.destroy()
        bar = {r.query: r.score for r in few.where(F.col("rank") == k).select("query", "score").collect()}
        for q in group:
            q.least = np.array([bar.get(i, 0.0) for i in q.ids], float)
        sent = [spark.sparkContext.broadcast(q) for q in group]
        found = ranked(_answers(index.where(F.col("shard") >= first), sent, k, mean, result).union(few.drop("rank")))
        found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias(key), "score").write.mode("append").parquet(at)
        for x in sent:
            x.destroy()
    return spark.read.parquet(at)
