"""Importance resampling against plain Python."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlight.llm import queries, resampling
from meterlight.llm.resampling import resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, orders):
    w = words(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) for n in range(1, orders + 1) for k in range(len(w) - n + 1)]


def plain(docs, target, orders, buckets, percent, least, seed=2024):
    s = Counter(x % buckets for _, t in docs for x in grams(t, orders))
    t = Counter(x % buckets for y in target for x in grams(y, orders))
    a, b = s.total(), t.total()
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((n + 1) * (b + buckets)))) for k, n in s.items()}
    out = []
    for d, text in docs:
        own = [x % buckets for x in grams(text, orders)]
        weight = sum(gain[x] for x in own) // max(1, len(own))
        luck = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((luck + 0.5) / 2**32))), None, len(words(text))])
    can = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(can[: percent * len(can) // 100], start=1):
        x[4] = k
    return sorted((tuple(x[:5]) for x in out), key=repr)


def got(scored):
    return sorted((tuple(r) for r in scored.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


DOCS = [(k, f"Word{k % 5} the and ñandú, the-end {k} " * (k % 4 + 1)) for k in range(60)]
DOCS += [(None, "no key here but words"), (61, None), (62, ""), (63, "!!! ---"), (5, "twice the same words")] + [(64, "copied row of six words here")] * 40 + [(65, "long " * 20_000)]
TARGET = ["the end of the end", "ÑANDÚ and word3", None, ""]


@pytest.mark.parametrize(("orders", "broadcast"), [(1, 1 << 20), (3, 1 << 20), (2, 10)])
def test_like_plain_python(spark, monkeypatch, orders, broadcast):
    monkeypatch.setattr(resampling, "BROADCAST_BUCKETS", broadcast)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resampled(docs, target, percent=30, orders=orders, buckets=97, least_words=3)
    assert got(found) == plain(DOCS, TARGET, orders, 97, 30, 3)


def test_many_ranges_rank_alike(spark, monkeypatch):
    from meterlight.llm import shared

    monkeypatch.setattr(shared.range_parts, "__defaults__", (7,))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert got(resampled(docs, target, percent=50, buckets=97, least_words=3)) == plain(DOCS, TARGET, 1, 97, 50, 3)


def test_empty_tables_and_columns_named_alike(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert got(resampled(docs, none, buckets=97, least_words=3)) == plain(DOCS, [], 1, 97, 10, 3)
    assert got(resampled(docs.limit(0), none)) == []
    for name in ("bucket", "word", "pos", "gain", "score", "rank", "n_words", "_id", "_key"):
        docs = docs.withColumn(name, F.lit("x"))
    found = resampled(docs, none, percent=100, buckets=97, least_words=3)
    assert got(found) == plain(DOCS, [], 1, 97, 100, 3)
    back = resampling.drawn_rows(docs, found)
    assert back.columns == docs.columns
    assert back.where("doc_id = 64").count() == 40 and back.where("doc_id in (61, 62, 63)").count() == 0


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.OP13_SQL).fetchall()
    assert got(queries.op13_target_resampling(spark, sf)) == sorted(want, key=repr)
