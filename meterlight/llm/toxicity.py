"""Toxic spans and document scores from a linear-chain conditional random field.

The chain has two states, clean and toxic. Only documents carry labels, so labelled tokens come first: in a
document labelled toxic a token counts as toxic if its word or one of its affixes marks toxic documents beyond
chance. The field is fitted on windows of such tokens; forward-backward marginals give each token's
probability, tokens of 0.5 and more give the spans, and a logistic fit of the marginals' maximum and sum gives
the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, fold, tidied

TOKEN = re.compile(r"[^\W\d_]+")
#: Words of a generation whose emission a task remembers; the last generation stays beside it.
REMEMBERED = 75_000
FLOOR = 1e-9
SPANS = "array<struct<start:int,end:int,p:double>>"


def features(word: str) -> list[str]:
    """The word in lower case, and its affixes of 3 to 5 letters."""
    w = word.lower()
    return [w, *(f"{w[:n]}-" for n in (3, 4, 5) if len(w) > n), *(f"-{w[-n:]}" for n in (3, 4, 5) if len(w) > n)]


@dataclass
class Field:
    """The fitted chain. Scores are against the clean state, and against a step from clean to clean."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    enter: float = 0.0
    stay: float = 0.0
    leave: float = 0.0
    document: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """x: odds of each token's emission, documents by positions, 0 past a document's end. The toxic state's probabilities."""
        a, b, c = math.exp(self.enter), math.exp(self.stay), math.exp(self.leave)
        if len(x) < 8:
            return np.array([self._one(row, a, b, c) for row in x.tolist()]).reshape(x.shape)
        cols = np.ascontiguousarray(x.T)
        forward = np.empty_like(cols)
        r = cols[0] * a
        forward[0] = r
        for t in range(1, len(cols)):
            r = cols[t] * (a + b * r) / (1 + c * r)
            forward[t] = r
        q = np.ones(x.shape[0])
        for t in range(len(cols) - 2, -1, -1):
            y = cols[t + 1] * q
            # past the end nothing follows: the next position's emission is 0 and both states have weight 1
            q = np.where(cols[t + 1] > 0, (c + b * y) / (1 + a * y), 1.0)
            forward[t] *= q
        return (forward / (1 + forward)).T

    @staticmethod
    def _one(row: list[float], a: float, b: float, c: float) -> list[float]:
        r, q, out = 0.0, 1.0, [0.0] * len(row)
        for t, x in enumerate(row):
            out[t] = r = x * (a + b * r) / (1 + c * r) if t else x * a
        for t in range(len(row) - 2, -1, -1):
            y = row[t + 1] * q
            q = (c + b * y) / (1 + a * y) if row[t + 1] > 0 else 1.0
            out[t] *= q
        return [v / (1 + v) for v in out]

    def score(self, most: float, total: float) -> float:
        b0, b1, b2 = self.document
        z = b0 + b1 * _logit(most) + b2 * math.log(total + FLOOR)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logit(p: float) -> float:
    p = min(max(p, FLOOR), 1 - 1e-6)
    return math.log(p / (1 - p))


class _Odds(dict):
    def __init__(self, model: Field):
        super().__init__()
        self.model = model
        self.last: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        x = self.last.get(word)
        if x is None:
            x = math.exp(min(30.0, max(-30.0, self.model.emission(word))))
        if len(self) >= REMEMBERED:
            self.last = dict(self)
            self.clear()
        self[word] = x
        return x


def tag(model: Field, texts: list[str], odds: dict[str, float] | None = None, cells: int = 1 << 20) -> list[np.ndarray]:
    """The toxic state's probability of each token of each text. Texts of like length are worked on together."""
    odds = _Odds(model) if odds is None else odds
    rows = [np.fromiter(map(odds.__getitem__, TOKEN.findall(t)), float) for t in texts]
    out: list[np.ndarray] = [np.empty(0)] * len(rows)
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: -len(rows[k]))
    while order:
        longest = len(rows[order[0]])
        now, order = order[: (n := max(1, cells // longest))], order[n:]
        x = np.zeros((len(now), longest))
        for k, own in enumerate(now):
            x[k, : len(rows[own])] = rows[own]
        for own, p in zip(now, model.marginals(x), strict=True):
            out[own] = p[: len(rows[own])]
    return out


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of tokens of ``least`` and more: code points from and to, and the largest probability."""
    found: list[dict] = []
    if not len(p) or p.max() < least:
        return found
    last = -2
    for k, (m, v) in enumerate(zip(TOKEN.finditer(text), p.tolist(), strict=True)):
        if v >= least:
            if last == k - 1:
                found[-1] |= {"end": m.end(), "p": max(v, found[-1]["p"])}
            else:
                found.append({"start": m.start(), "end": m.end(), "p": v})
            last = k
    return found


# Fitting, on the driver, from a bounded sample.


def _apart(texts: list[str], labels: list[int]) -> list[int]:
    """Positions of texts of which no earlier one of the same label seems a near copy: else the words of a much copied text would count as so many signs."""
    seen: set[tuple[int, int, int]] = set()
    out = []
    code = cache(lambda w: zlib.crc32(w.encode()))
    for k, (text, y) in enumerate(zip(texts, labels, strict=True)):
        w = np.fromiter(map(code, TOKEN.findall(text)), np.uint64)
        if len(w) > 2:
            w = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
        keys = {(y, j, int((w * np.uint64(2 * j + 0xD6E8FEB86659FD93)).min())) for j in range(4)} if len(w) else {(y, 0, 0)}
        if not keys & seen:
            out.append(k)
        seen |= keys
    return out


def _markers(docs: list[tuple[list[list[str]], int]], least: float = 3.0) -> set[str]:
    """Features whose share of toxic documents is above that of clean ones by ``least`` standard errors of the log odds."""
    df = (Counter(), Counter())
    n = [0, 0]
    for tokens, y in docs:
        df[y].update({f for t in tokens for f in t})
        n[y] += 1
    out = set()
    for f, p in df[1].items():
        q = df[0][f]
        lead = math.log((p + 0.5) / (n[1] + 1)) - math.log((q + 0.5) / (n[0] + 1))
        if lead / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) >= least and lead > 3.5:
            out.add(f)
    return out


def fit(texts: list[str], labels: list[int], window: int = 24, windows: int = 6000, rounds: int = 60, l2: float = 0.02, seed: int = 7) -> Field:
    """The field of the sample; without labels of both kinds, one that finds nothing."""
    model = Field()
    if len(set(labels)) < 2:
        return model
    apart = _apart(texts, labels)
    texts, labels = [texts[k] for k in apart], [labels[k] for k in apart]
    of = cache(features)
    docs = [([of(w) for w in TOKEN.findall(t)], y) for t, y in zip(texts, labels, strict=True)]
    marks = _markers(docs)
    rng = np.random.default_rng(seed)
    cut: tuple[list, list] = ([], [])
    for tokens, y in docs:
        for at in range(0, len(tokens), window):
            own = tokens[at : at + window]
            tagged = [bool(y) and any(f in marks for f in t) for t in own]
            cut[any(tagged)].append((own, tagged))
    rng.shuffle(cut[1])
    picked = cut[1][: windows // 2]
    picked += [cut[0][k] for k in rng.permutation(len(cut[0]))[: windows - len(picked)]]
    if not picked:
        return model
    # only features of tagged tokens and frequent ones get a weight of their own
    often = Counter(f for own, _ in picked for t in own for f in t)
    index = {f: k for k, f in enumerate(sorted(f for f, n in often.items() if n >= 3), start=1)}
    wide = max(len(t) for own, _ in picked for t in own)
    ids = np.zeros((len(picked), window, wide), np.int32)
    y = np.zeros((len(picked), window))
    there = np.zeros((len(picked), window), bool)
    for i, (own, tagged) in enumerate(picked):
        for j, (t, hit) in enumerate(zip(own, tagged, strict=True)):
            got = [index[f] for f in t if f in index]
            ids[i, j, : len(got)] = got
            y[i, j], there[i, j] = hit, True
    w = np.zeros(len(index) + 1)
    free = np.array([-6.0, 0.0, 0.0, 0.0])  # bias, enter, stay, leave
    pairs = there[:, 1:] & there[:, :-1]
    seen = np.array([(y * there).sum(), *((pairs * m).sum() for m in ((1 - y[:, :-1]) * y[:, 1:], y[:, :-1] * y[:, 1:], y[:, :-1] * (1 - y[:, 1:])))])
    m1, m2 = [np.zeros(len(w) + 4) for _ in range(2)]
    for k in range(1, rounds + 1):
        x = np.where(there, np.exp(np.clip(free[0] + w[ids].sum(axis=2), -30, 30)), 0.0)
        p, moves = _expected(x, there, *np.exp(free[1:]))
        grad = np.concatenate([np.bincount(ids.ravel(), weights=np.repeat(((y - p) * there).ravel(), wide), minlength=len(w)), seen - np.array([(p * there).sum(), *moves])])
        grad[: len(w)] -= l2 * w
        grad[len(w) + 1 :] -= 1.0 * free[1:]
        grad[0] = 0
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.15 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w += step[: len(w)]
        free += step[len(w) :]
    model = Field({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-3}, *map(float, free))
    return _calibrated(model, texts, labels)


def _expected(x: np.ndarray, there: np.ndarray, a: float, b: float, c: float) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Marginals of the toxic state, and expected moves: enter, stay, leave."""
    n = x.shape[1]
    r = np.zeros_like(x)
    q = np.ones_like(x)
    r[:, 0] = x[:, 0] * a
    for t in range(1, n):
        r[:, t] = x[:, t] * (a + b * r[:, t - 1]) / (1 + c * r[:, t - 1])
    for t in range(n - 2, -1, -1):
        z = x[:, t + 1] * q[:, t + 1]
        q[:, t] = np.where(there[:, t + 1], (c + b * z) / (1 + a * z), 1.0)
    left, right = r[:, :-1], x[:, 1:] * q[:, 1:]
    every = np.where(there[:, 1:], 1 + a * right + c * left + b * left * right, np.inf)
    return r * q / (1 + r * q), (float((a * right / every).sum()), float((b * left * right / every).sum()), float((c * left / every).sum()))


def _calibrated(model: Field, texts: list[str], labels: list[int]) -> Field:
    """Logistic regression of the label on the marginals' maximum and sum, with a ridge."""
    x = np.array([[1.0, _logit(p.max() if len(p) else 0.0), math.log((p.sum() if len(p) else 0.0) + FLOOR)] for p in tag(model, texts)])
    y = np.array(labels, float)
    for use in ([0, 1, 2], [0, 1], [0, 2], [0]):
        b = np.zeros(3)
        ridge = np.diag([1e-6, 0.05, 0.05][: len(use)])
        own = x[:, use]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(own @ b[use], -30, 30)))
            b[use] += np.linalg.solve(own.T @ (own * (p * (1 - p))[:, None]) + ridge, own.T @ (y - p) - ridge @ b[use])
        if (b[1:] >= 0).all():  # never a lower score for a higher marginal
            break
    model.document = tuple(map(float, b))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1000, clean_rows: int = 1500, text: str = "text", key: str = "doc_id", label: str = "toxic") -> tuple[list[str], list[int]]:
    """At most ``toxic_rows + clean_rows`` different labelled rows, picked by a hash of the key and then of the text, with their whole texts. Rows that share a key are rows of their own."""
    own = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where("_key is not null and _y in (0, 1)").distinct()
    docs = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    # rows are picked by their hashes, so that texts move only of those that are picked
    met = docs.select("_key", "_hash").join(own, "_key").distinct()
    order = [F.xxhash64("_key"), F.col("_key"), F.col("_hash")]
    some = met.where("_y = 1").orderBy(*order).limit(toxic_rows).unionByName(met.where("_y = 0").orderBy(*order).limit(clean_rows))
    rows = docs.join(F.broadcast(some), ["_key", "_hash"]).dropDuplicates(["_key", "_hash", "_y"]).select("_key", "_text", "_y").collect()
    rows.sort(key=lambda r: (r["_key"], r["_y"], r["_text"]))
    return [r["_text"] for r in rows], [r["_y"] for r in rows]


def toxicity(docs: DataFrame, model: Field, text: Column) -> Column:
    """A struct of ``score`` and ``spans`` of the whole text; null is empty, and an empty text gets the score of no evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<score:double,spans:{SPANS}>")
    def tagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, odds = sent.value, _Odds(sent.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in tidied(batches):
            scores, found = [], []
            for at in range(0, len(batch), 1000):
                texts = [t or "" for t in batch.slice(at, 1000).to_pylist()]
                for t, p in zip(texts, tag(own, texts, odds), strict=True):
                    scores.append(own.score(float(p.max()) if len(p) else 0.0, float(p.sum())))
                    found.append(spans(t, p))
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, kind)], ["score", "spans"])

    return tagged(text)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted`` and ``spans``; input columns of those names are replaced.

    Labels of rows of fold 0 are not learnt from. Keys, languages and sources are not seen by the score. Repeated rows get
    equal scores; an empty table gives an empty result; without labels every score is low and alike.
    """
    train = labels.where(fold(F.col(key), folds) != 0)
    model = fit(*labelled_sample(docs, train, text=text, key=key))
    rows = docs.select(F.struct("*").alias("_row"), toxicity(docs, model, F.col(text)).alias("_got"))
    return add_columns(
        rows, "_row",
        {"held_out": fold(F.col("_row")[key], folds) == 0, "score": F.col("_got.score"), "predicted": (F.col("_got.score") >= 0.5).cast("int"), "spans": F.col("_got.spans")},
    )
