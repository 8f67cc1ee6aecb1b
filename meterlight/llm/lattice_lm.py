"""LM scoring by a subword lattice.

A word's probability is the sum over all its segmentations into pieces of an existing subword vocabulary, by a
forward recursion in log space. The vocabulary's own scores are the prior of the pieces' weights, which two
rounds of segmenting every distinct training word sharpen. The lattice is what a word never seen gets; a word
seen gets its discounted share of the training words as one more edge over its whole length. Weights and shares are
learnt for each class of documents (a language, say) and for all together; a document is a mixture over
these, of the product of its words and one end.

Words are counted and scored once each, in a table of distinct words. Documents lie in buckets of bounded size;
each bucket sends the counts of its own distinct words, and gets these words' scores back in packed arrays. What moves is
the texts and a few bytes for each distinct word of a bucket, never a row for each token.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, text_of

#: Of documents in a bucket.
BUCKET_BYTES = 16 << 20
#: Pseudo-counts that the vocabulary's own scores are worth.
PRIOR = 2000.0
#: Of a component's lattice, what words have that training knows.
ELSEWHERE = 0.3
#: Distinct words whose scores a task packs together.
PACKED = 200_000
NONE = float("-inf")
LN10 = math.log(10)


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case, as UTF-8."""
    return text.encode().lower().split()


Table = dict[bytes, tuple[float, ...]]


@dataclass
class Pieces:
    """Log weights of a piece, one for each component, by place in the word: ``[first or later][before others or last]``; each pair sums to one."""

    weights: list[list[Table]]
    longest: int
    one: Pieces | None = None

    def only(self, component: int) -> Pieces:
        if self.one is None:
            self.one = Pieces([[{p: (w[component],) for p, w in t.items()} for t in row] for row in self.weights], self.longest)
        return self.one

    def forward(self, words: Iterator[bytes]) -> Iterator[list[float]]:
        """Log probabilities over all segmentations, by component. Sorted words share the recursion over their common start."""
        (first_on, first_end), (on, end) = self.weights
        most = self.longest
        before, total = b"", [[]]
        for word in words:
            n = len(word)
            same, stop = 0, min(n, len(before), len(total) - 1)
            while same < stop and word[same] == before[same]:
                same += 1
            del total[same + 1 :]
            for j in range(len(total), n):
                terms = [first_on[word[:j]]] if j <= most and word[:j] in first_on else []
                for i in range(max(1, j - most), j):
                    w = on.get(word[i:j])
                    if w is not None:
                        terms.append([a + b for a, b in zip(total[i], w)])  # noqa: B905
                total.append(_log_sums(terms))
            terms = [first_end[word]] if word in first_end else []
            for i in range(max(1, n - most), n):
                w = end.get(word[i:])
                if w is not None:
                    terms.append([a + b for a, b in zip(total[i], w)])  # noqa: B905
            yield _log_sums(terms)
            before = word

    def best(self, words: Iterator[bytes], component: int) -> Iterator[list[int]]:
        """The ends of the pieces of each word's best segmentation by one component, from the last to the first."""
        (first_on, first_end), (on, end) = self.weights
        most, none = self.longest, None
        before, total, back = b"", [0.0], [0]
        for word in words:
            n = len(word)
            same, stop = 0, min(n, len(before), len(total) - 1)
            while same < stop and word[same] == before[same]:
                same += 1
            del total[same + 1 :], back[same + 1 :]
            for j in range(len(total), n):
                w = first_on.get(word[:j], none) if j <= most else none
                top, at = NONE if w is none else w[component], 0
                for i in range(max(1, j - most), j):
                    w = on.get(word[i:j])
                    if w is not none and total[i] + w[component] > top:
                        top, at = total[i] + w[component], i
                total.append(top)
                back.append(at)
            w = first_end.get(word, none)
            top, at = NONE if w is none else w[component], 0
            for i in range(max(1, n - most), n):
                w = end.get(word[i:])
                if w is not none and total[i] + w[component] > top:
                    top, at = total[i] + w[component], i
            cuts = [n]
            while at:
                cuts.append(at)
                at = back[at]
            yield cuts
            before = word


def _log_sums(terms: list) -> list[float]:
    if len(terms) == 1:
        return terms[0]
    out = []
    for own in zip(*terms):  # noqa: B905
        top = max(own)
        out.append(top + math.log(sum([math.exp(t - top) for t in own])))
    return out


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model by falling score; a mark of a word's start is dropped, and byte pieces are bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, None] = {}
    for k in sorted((k for k in range(model.get_piece_size()) if not model.is_unknown(k) and not model.is_control(k)), key=lambda k: (-model.get_score(k), k)):
        piece = model.id_to_piece(k)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", "").encode()
        if raw and raw == raw.lower() and len(raw.split()) == 1:
            found.setdefault(raw)
    return list(found | dict.fromkeys(bytes([b]) for b in range(256)))


def weighted(vocab: list[bytes], counts: np.ndarray) -> Pieces:
    """counts: by component, (later, last) and piece. The prior falls with the rank, and goes evenly to the places."""
    prior = 1 / (np.arange(len(vocab)) + 10.0)
    x = counts.reshape(len(counts), 2, 2, len(vocab)) + prior * (PRIOR / prior.sum() / 2)
    logs = np.log(x / x.sum(axis=(2, 3), keepdims=True))
    return Pieces([[dict(zip(vocab, map(tuple, logs[:, later, last].T.tolist()), strict=True)) for last in (0, 1)] for later in (0, 1)], max(map(len, vocab)))


def _segmented(words: DataFrame, components: int, vocab: list[bytes], pieces: Pieces) -> Pieces:
    """Weights from the best segmentations, by the weights of all, of all words of the table, each counted once in each component that has it.

    There are at most as many sums as the vocabulary has pieces, times four, for each component.
    """
    sent = words.sparkSession.sparkContext.broadcast((vocab, pieces))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, pieces = sent.value
        index = {p: k for k, p in enumerate(vocab)}
        n: Counter[int] = Counter()
        for batch in batches:
            every = batch.column(0).to_pylist()
            there = _matrix(batch.column(1), components) > 0
            rows = there[:, -1]
            own = [w for w, t in zip(every, rows.tolist(), strict=True) if t]
            of = [[4 * len(vocab) * c for c in np.flatnonzero(t).tolist()] for t in there[rows]]
            for word, cuts, into in zip(own, pieces.best(iter(own), components - 1), of, strict=True):
                end = len(word)
                for k, cut in enumerate(cuts):
                    start = cuts[k + 1] if k + 1 < len(cuts) else 0
                    place = (2 * (start > 0) + (cut == end)) * len(vocab) + index[word[start:cut]]
                    for c in into:
                        n[c + place] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["code", "n"])

    out = np.zeros(4 * components * len(vocab))
    for r in words.select("token", "counts").mapInArrow(counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return weighted(vocab, out.reshape(components, 4, len(vocab)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Index(dict):
    """Numbers what it is asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Model:
    """Of each component, what training has: words, distinct words, and the discount taken from each of these; and its prior."""

    words: list[int]
    distinct: list[int]
    discount: list[float]
    prior: list[float]
    ends: int
    pieces: Pieces

    @property
    def tokens(self) -> int:
        return self.words[-1] + self.ends

    def base(self, count: int) -> float:
        return math.log10((count + 0.1) / (self.tokens + 0.1 * (self.distinct[-1] + (self.ends > 0) + 1)))

    def end(self) -> float:
        return math.log10((self.ends + 0.5) / (self.tokens + 1.0))

    def words_of(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of words' probabilities by each component, of their counts in training and their log probabilities by the lattice."""
        n, kinds, discount = (np.array(x, float) for x in (self.words, self.distinct, self.discount))
        some = np.maximum(n, 1)
        new = lattice + np.where(n > 0, np.log(np.maximum(discount * kinds, 1e-300) / some), 0.0)
        seen = np.where(counts > 0, np.log(np.maximum(counts - discount, 1e-300) / some), -np.inf)
        return (np.logaddexp(seen, new) + math.log1p(-(self.ends + 0.5) / (self.tokens + 1.0))) / LN10

    def lattice(self, words: list[bytes], known: np.ndarray) -> np.ndarray:
        """Each component gives ``ELSEWHERE`` of its lattice to words that training knows, by the weights of all, and the rest to others, by its own."""
        out = np.empty((len(words), len(self.words)))
        last = self.pieces.only(len(self.words) - 1)
        for is_known, pieces, share in ((True, last, ELSEWHERE), (False, self.pieces, 1 - ELSEWHERE)):
            at = np.flatnonzero(known == is_known)
            if len(at):
                out[at] = np.array(list(pieces.forward(words[k] for k in at))) + math.log(share)
        return out


def score_documents(docs: DataFrame, train: Column, vocabulary_path: str, classes: Column | None = None, text: str = "text", key: str = "doc_id", rounds: int = 2, most_classes: int = 8) -> DataFrame:
    """Key, ``train`` (learnt from), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row of ``docs``.

    ``classes`` says what a training row is an example of; the ``most_classes`` most frequent have a component of
    their own, all others share one. It isn't seen when a row is scored. Null is the empty text, which is one end.
    ``score`` is the mixture's log10 probability of the text, ``base_score`` that of smoothed word counts.
    Repeated rows are scored, and learnt from, as often as they come. Without training rows the lattice has the
    vocabulary's own scores.
    """
    spark = docs.sparkSession
    kind = F.lit("") if classes is None else F.coalesce(classes.cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), kind.alias("kind"))
    top = rows.where("train").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(most_classes).collect()
    own = F.create_map(*[x for k, r in enumerate(top) for x in (F.lit(r.kind), F.lit(k))]) if top else F.create_map().cast("map<string,int>")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("train").alias("ends")).first()
    ends = size["ends"] or 0
    left = [r.n for r in top]
    if others := ends - sum(left):
        left.append(others)
    components = len(left) + 1  # and all together
    # documents of a class lie together, which makes for fewer distinct words in a bucket
    parts = max(1, -(-(size["bytes"] or 0) // BUCKET_BYTES))
    kind_of = F.coalesce(F.try_element_at(own, "kind"), F.lit(len(top)))
    rows = rows.select("key", "text", "train", (kind_of * parts + F.pmod(F.xxhash64("key", "text"), F.lit(parts))).cast("int").alias("bucket"))

    def asked(group: pa.Table) -> pa.Table:
        index = _Index()
        at = [np.empty(0, np.int64)]
        for t, learn in zip(group["text"], group["train"].to_pylist(), strict=True):
            own = np.fromiter(map(index.__getitem__, tokens(t.as_py())), np.int64)
            if learn:
                at.append(own)
        n = np.bincount(np.concatenate(at), minlength=len(index))
        bucket = group["bucket"][0].as_py() if group.num_rows else 0
        return pa.table({"bucket": pa.array(np.full(len(index), bucket, np.int32)), "token": pa.array(list(index), pa.binary()), "n": pa.array(n.astype(np.int64))})

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one token stand together: its counts by component, and its buckets. A list is at most as long as there are buckets."""
        out: tuple[list, list, list] = ([], [], [])
        last, counts, at = None, [0] * components, array("i")

        def batch_of() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())], ["token", "counts", "buckets"])
            for o in out:
                o.clear()
            return b

        def close() -> None:
            out[0].append(last)
            out[1].append(counts)
            out[2].append(at.tobytes())

        for batch in batches:
            for token, bucket, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if token != last:
                    if last is not None:
                        close()
                    last, counts, at = token, [0] * components, array("i")
                at.append(bucket)
                if n:
                    counts[bucket // parts] += n
                    counts[-1] += n
            if len(out[0]) > 50_000:
                yield batch_of()
        if last is not None:
            close()
        yield batch_of()

    wanted = rows.groupBy("bucket").applyInArrow(asked, "bucket int, token binary, n long")
    words = kept(wanted.select("token", "bucket", "n").repartition("token").sortWithinPartitions("token").mapInArrow(folded, "token binary, counts array<long>, buckets binary"))
    c = [F.col("counts")[k] for k in range(components)]
    sums = words.agg(*(f(c[k]).alias(f"{n}{k}") for k in range(components) for n, f in (("sum", F.sum), ("n1", lambda x: F.count_if(x == 1)), ("n2", lambda x: F.count_if(x == 2)), ("any", lambda x: F.count_if(x > 0))))).first()

    vocab = vocabulary(vocabulary_path)
    pieces = weighted(vocab, np.zeros((components, 4, len(vocab))))
    for _ in range(rounds):
        pieces = _segmented(words, components, vocab, pieces)
    every = range(components)
    model = Model(
        words=[sums[f"sum{k}"] or 0 for k in every],
        distinct=[sums[f"any{k}"] for k in every],
        discount=[(sums[f"n1{k}"] + 1) / (sums[f"n1{k}"] + 1 + 2.0 * (sums[f"n2{k}"] + 1)) for k in every],
        prior=[0.9 * (n + 1) / (ends + len(left)) for n in left] + [0.1],
        ends=ends,
        pieces=pieces,
    )
    sent = spark.sparkContext.broadcast(model)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket, the hashes, counts and scores of some of its words."""
        model = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, PACKED):
                part = batch.slice(start, PACKED)
                own = part.column(0).to_pylist()
                n = _matrix(part.column(1), components)
                scores = model.words_of(n, model.lattice(own, n[:, -1] > 0)).astype(np.float32)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
                lists = [np.frombuffer(b, np.int32) for b in part.column(2).to_pylist()]
                bucket = np.concatenate(lists)
                row = np.repeat(np.arange(len(own)), [len(b) for b in lists])
                order = np.argsort(bucket, kind="stable")
                bucket, row = bucket[order], row[order]
                edges = np.flatnonzero(np.diff(bucket)) + 1
                out = [(int(bucket[at[0]]), hashes[r].tobytes(), n[r, -1].tobytes(), scores[r].tobytes()) for at, r in zip(np.split(np.arange(len(bucket)), edges), np.split(row, edges), strict=True) if len(at)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "hashes", "counts", "scores"])

    answers = words.mapInArrow(answered, "bucket int, hashes binary, counts binary, scores binary")
    n_train, end_known, prior = model.tokens, int(ends > 0), np.log10(model.prior)
    base_of, base_end, own_end = (model.tokens + 0.1 * (model.distinct[-1] + end_known + 1)), model.base(ends), model.end()

    def summed(group: pa.Table, known: pa.Table) -> pa.Table:
        index = _Index()
        docs = [np.fromiter(map(index.__getitem__, tokens(t.as_py())), np.int64) for t in group["text"]]
        hashes, counts, scores = (np.frombuffer(b"".join(known[c].to_pylist()), t) for c, t in (("hashes", np.uint64), ("counts", np.int64), ("scores", np.float32)))
        order = np.argsort(hashes)
        row = order[np.searchsorted(hashes[order], np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index)))] if len(index) else order
        values = np.empty((len(index), 2 + components))
        values[:, 0] = counts[row] > 0
        values[:, 1] = np.log10((counts[row] + 0.1) / base_of)
        values[:, 2:] = scores.reshape(-1, components)[row]
        out = np.empty((len(docs), 4))
        for k, at in enumerate(docs):
            total = values[at].sum(axis=0)
            by = total[2:] + prior
            out[k] = len(at) + 1, total[0] + end_known, total[1] + base_end, by.max() + np.log10((10 ** (by - by.max())).sum()) + own_end
        return pa.table({
            "key": group["key"], "train": group["train"], "n_tokens": pa.array(out[:, 0].astype(np.int64)), "n_known": pa.array(out[:, 1].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(out), n_train, np.int64)), "base_score": pa.array(out[:, 2]), "score": pa.array(out[:, 3]),
        })

    result = f"key {rows.schema['key'].dataType.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(summed, result).withColumnRenamed("key", key)
