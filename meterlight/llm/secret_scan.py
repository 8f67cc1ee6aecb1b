"""Secret scans: rules for known forms, and character Markov models for what has no form.

Two kinds of models, trained from labelled samples, look at each long run of identifier characters that no rule has
touched. Random strings: a drawn sample for each alphabet that secrets are written in (``RANDOM``), first-order models.
Ordinary identifiers: all runs of the whole corpus that are too short for a secret and that no rule
touches, and identifiers put together from its words; second-order with the first order behind it. A run is, or holds, a secret if some stretch of it has a high log-likelihood ratio of one of the
random models against the ordinary one. How high is set on held-out labelled strings: random ones drawn anew, and
identifiers put together from words of the corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, tidied

# The forms of the base rules, and the fewest characters of the group that is a secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
RULES = {"assign": (ASSIGN, 2, 6), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24)}
KINDS = (*RULES, "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: As ``hex``, without the matches that are too short.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Alphabets of random strings, each a model of its own. Numbers alone aren't taken for secrets.
RANDOM = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "letters": string.ascii_letters,
    "lower and digits": string.ascii_lowercase + string.digits, "upper and digits": string.ascii_uppercase + string.digits,
    "letters and digits": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_",
}
#: Drawn strings of each alphabet, and words kept for identifiers: the sizes of the labelled samples that aren't corpus counts.
DRAWN, WORDS = 400, 2000
#: Words of programs and addresses, added to those of the corpus when identifiers are made.
COMMON = (
    "read write file buffer user name config data test path index page list map item node value type get set key table column row query index cache count "
    "time date start end first last next parent child root left right height width size length error warning message event handler listener manager factory "
    "service client server request response session cookie header body content text string number integer boolean array object class method function module "
    "package import export default static public private version build release branch commit merge input output stream socket thread process worker task queue "
    "usr local share home user users projects applications node modules src lib bin var log opt apache spark sql execution datasources transactions backup api "
    "www com org net http https html json xml csv static images assets blog news article archive category product example some and more with from into"
).split()
N = len(ALPHABET) + 1  # the last code: any other character
CODES = np.full(256, N - 1, np.uint8)
CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(N - 1)
SPANS = "array<struct<kind:string,start:int,end:int>>"
PLAIN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{2,11}(?![A-Za-z0-9+/_=-])")


def by_rules(text: str) -> list[tuple[int, int, int, int]]:
    """Start, position of the kind, end, and start of the secret value; leftmost matches that don't overlap, for each kind."""
    found = []
    low = text.lower()
    for k, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        if kind == "assign" and not ("passw" in low or "secret" in low or "token" in low or "key" in low):
            continue
        if kind == "access" and "AKIA" not in text:
            continue
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), m.start(group)))
    return sorted(found)


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _codes(text: str) -> np.ndarray:
    return CODES[np.frombuffer(text.encode(), np.uint8)].astype(np.int32)


def _triples(text: str) -> np.ndarray:
    """The number of each three characters in a row, by code."""
    c = _codes(text)
    return np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3) if len(c) > 2 else np.zeros(N**3, np.int64)


def drawn(seed: int, n: int = DRAWN) -> dict[str, list[str]]:
    """``n`` random strings of 16 to 64 characters of each alphabet."""
    rng = random.Random(seed)
    return {kind: ["".join(rng.choices(letters, k=rng.randint(16, 64))) for _ in range(n)] for kind, letters in RANDOM.items()}


def stamp(rng: random.Random) -> str:
    """A date, a date with a time, or a number, as names of files and addresses have them."""
    day = f"{rng.randrange(1990, 2040)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    hour = f"T{rng.randrange(24):02d}-{rng.randrange(60):02d}-{rng.randrange(60):02d}Z"
    return rng.choice([day, day.replace("-", ""), day + hour, day.replace("-", "/"), str(rng.randrange(10**8)), f"v{rng.randrange(20)}"])


def identifiers(words: list[str], n: int = 2 * WORDS, seed: int = 3) -> list[str]:
    """``n`` identifiers of 16 and more characters put together from ``words`` and ``COMMON``: snake, kebab, camel and constant case, compounds, and paths, some with a number or a date."""
    rng, words = random.Random(seed), [*words, *COMMON * max(1, len(words) // len(COMMON))]
    forms = ["_".join, "-".join, "/".join, lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), "".join, lambda w: "/" + "/".join(w)]
    out = []
    while len(out) < n:
        own = [rng.choice(words).lower()]
        while sum(map(len, own)) < rng.randint(16, 40):
            own.append(rng.choice(words).lower())
        if rng.random() < 0.4:
            at = rng.randrange(len(own))
            own[at] += str(rng.randrange(2000) if rng.random() < 0.3 else rng.randrange(10))
        if rng.random() < 0.15:
            own.insert(rng.randrange(len(own) + 1), stamp(rng))
        out.append(rng.choice(forms)(own))
    return out


#: Characters of a run that are scored at once.
PIECE = 1 << 15


def best_stretch(llr: np.ndarray, least: int) -> float:
    return best_in_pieces(iter([llr]), least)


def best_in_pieces(pieces: Iterator[np.ndarray], least: int) -> float:
    """The largest sum of ``least`` or more neighbours in some row of the pieces, one after the other; of fewer, none is. Held are the last sums, and the least of those before."""
    best, held, low = -np.inf, None, None
    for llr in pieces:
        if held is None:
            held, low = np.zeros((len(llr), 1)), np.full((len(llr), 1), np.inf)
        sums = np.concatenate([held, held[:, -1:] + np.cumsum(llr, axis=1, dtype=float)], axis=1)
        lows = np.minimum.accumulate(np.concatenate([low, sums], axis=1), axis=1)
        at = np.arange(held.shape[1], sums.shape[1])
        best = max(best, float((sums[:, at] - lows[:, np.maximum(at - least + 1, 0)]).max(initial=-np.inf)))
        keep = min(sums.shape[1], least)
        held, low = sums[:, -keep:], lows[:, sums.shape[1] - keep][:, None]
    return best


@dataclass
class Models:
    """Log-likelihood ratios of a character after two others, by random model; the least that makes a secret; what held-out samples said."""

    ratio: np.ndarray
    least: float = 0.0
    recall: float = 0.0
    false_alarms: float = 0.0

    def score(self, run: str, least_length: int) -> float:
        def pieces() -> Iterator[np.ndarray]:
            for at in range(0, len(run) - 2, PIECE):
                c = _codes(run[at : at + PIECE + 2])
                yield self.ratio[:, (c[:-2] * N + c[1:-1]) * N + c[2:]]

        return best_in_pieces(pieces(), max(1, least_length - 2))


def _ordinary(triples: np.ndarray) -> np.ndarray:
    """Log probabilities of a character after two others, smoothed by those after one, and these by those of all."""
    n = triples.reshape(N, N, N)[: N - 1, : N - 1, : N - 1].astype(float)
    pairs = n.sum(axis=0)
    singles = pairs.sum(axis=0)
    first = (singles + 1) / (singles + 1).sum()
    second = (pairs + 4 * first) / (pairs.sum(axis=1, keepdims=True) + 4)
    return np.log((n + 4 * second[None]) / (n.sum(axis=2, keepdims=True) + 4))


def fit(triples: np.ndarray, words: list[str], least_length: int = 16, false_alarms: float = 0.001, margin: float = 6.0) -> Models:
    """Models of the corpus' counts of three characters in a row, in runs that no rule has touched, and of drawn strings.

    The least ratio is ``margin`` above what all but ``false_alarms`` of the held-out identifiers have.
    """
    # two ordinary models in even shares: runs of the corpus, and identifiers made of its words, as the corpus may have few
    own = sum((_triples(x) for x in identifiers(words, seed=4)), np.zeros(N**3, np.int64))
    ordinary = np.logaddexp(_ordinary(triples), _ordinary(own)) - np.log(2)
    ratio = np.full((len(RANDOM), N, N, N), -50.0, np.float32)  # with another character, it is no such string
    for k, (kind, own) in enumerate(drawn(1).items()):
        letters = _codes(RANDOM[kind])
        m = np.zeros((N - 1, N - 1))
        for text in own:
            c = _codes(text)
            np.add.at(m, (c[:-1], c[1:]), 1)
        m = m[np.ix_(letters, letters)]
        # as first-order models with a prior towards the alphabet's own letters, all alike
        p = np.log((m + 50 / len(letters)) / (m.sum(axis=1, keepdims=True) + 50))
        at = np.ix_(letters, letters, letters)
        ratio[k][at] = p[None] - ordinary[at]
    models = Models(ratio.reshape(len(RANDOM), -1))
    # the threshold is set on one half of the held-out identifiers, and false alarms are counted in the other
    scores = [models.score(x, least_length) for x in identifiers(words)]
    names, other = sorted(scores[::2]), scores[1::2]
    models.least = max(0.0, names[min(len(names) - 1, int(len(names) * (1 - false_alarms)))]) + margin
    found = [models.score(x, least_length) >= models.least for own in drawn(2).values() for x in own]
    models.recall, models.false_alarms = sum(found) / len(found), sum(x >= models.least for x in other) / max(1, len(other))
    return models


def train(docs: DataFrame, text: str = "text", least_length: int = 16) -> Models:
    """Models from all documents: a task counts its texts, and the counts, at most N ** 3 of them, are summed by Spark.

    Values that rules find and runs of ``least_length`` and more, which the models are to judge, aren't counted as ordinary.
    """
    long = re.compile(rf"[A-Za-z0-9+/_=-]{{{least_length},}}")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(N**3, np.int64)
        words: dict[int, str] = {}

        def take(part: list[str]) -> None:
            nonlocal n
            joined = long.sub("\n", "\n".join(part))
            n += _triples(joined)
            for w in set(PLAIN.findall(joined)):
                words[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=7).digest())] = w
            if len(words) > 20 * WORDS:
                for h in sorted(words)[WORDS:]:
                    del words[h]

        part: list[str] = []
        size = 0
        for batch in tidied(batches):
            for t in batch.column(0):
                t = t.as_py() or ""
                at = 0
                for start, end in zip(*_union([(value, end) for _, _, end, value in by_rules(t)]), strict=True):
                    part.append(t[at:start])
                    at = end
                part.append(t[at:])
                size += len(t)
                if size > 1 << 20:
                    take(part)
                    part, size = [], 0
        take(part)
        at = np.flatnonzero(n)
        own = sorted(words)[:WORDS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at.tolist(), *own], pa.int64()), pa.array([*n[at].tolist(), *[0] * len(own)], pa.int64()), pa.array([*[None] * len(at), *(words[h] for h in own)], pa.string())],
            ["code", "n", "word"],
        )

    sums = docs.select(F.col(text).cast("string")).mapInArrow(counts, "code long, n long, word string").groupBy("code", "word").agg(F.sum("n").alias("n"))
    sums = kept(sums)
    n = np.zeros(N**3)
    for r in sums.where("word is null").select("code", "n").collect():  # at most N ** 3 rows
        n[r.code] = r.n
    # the words of the least hashes, which don't depend on how the corpus is dealt to tasks
    return fit(n, [r.word for r in sums.where("word is not null").orderBy("code", "word").limit(WORDS).collect()], least_length)


def by_model(text: str, models: Models, base: list[tuple[int, int, int, int]], least_length: int) -> list[tuple[int, int]]:
    found = []
    starts, ends = _union([(s, e) for s, _, e, _ in base])
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{least_length},}}", text):
        start, end = m.span()
        k = bisect_left(ends, start + 1)  # the first that ends behind the start
        if k < len(starts) and starts[k] < end:
            continue
        run = m.group()
        if not run.isdigit() and models.score(run, least_length) >= models.least:
            found.append((start, end))
    return found


def secrets(text: Column, models: Models, least_length: int = 16) -> Column:
    """All spans of the whole text by start and then kind, in code points, the end not included; null is empty.

    The models look at all runs of ``least_length`` and more identifier characters that no rule has touched and that
    aren't numbers. A run is found, as a whole, if a stretch of it that is no shorter reaches ``models.least``, so ordinary
    names joined to a secret don't hide it.
    """
    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(models)

    @F.arrow_udf(SPANS)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in tidied(batches):
            out = []
            for t in batch:
                t = t.as_py() or ""
                base = by_rules(t)
                every = [(s, k, e) for s, k, e, _ in base] + [(s, len(RULES), e) for s, e in by_model(t, own, base, least_length)]
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(every)])
            yield pa.array(out, kind)

    return scanned(text)


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets`` (an input column of that name is replaced). An empty table trains an even model and gives an empty result."""
    return docs.withColumn("secrets", secrets(F.col(text), train(docs, text)))
