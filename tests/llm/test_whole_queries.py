"""The registered corpus queries on whole tables, against brute force in plain Python, and the pipeline on awkward tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from meterlight.llm import queries, search, surrogates
from meterlight.llm.bpe import load_ranks
from meterlight.llm.shared import documents

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True))


def words(text, low=True):
    return (text.encode().lower() if low else text.encode()).split()


def test_bpe_is_tiktoken(spark, sf, texts):
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_byte_bpe(spark, sf).collect()}
    want = {}
    for d, t in texts.items():
        ids = own.encode_ordinary(t)
        want[d] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    assert got == want


def test_search_is_its_sql_and_shards_merge(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.OP3_SQL).fetchall()
    docs = documents(spark, sf).select("doc_id", "text")
    for found in (queries.op3_search(spark, sf), search.bm25_top_k(docs, docs.where("doc_id % 100 = 0"), shard_bytes=20_000, query_terms=200)):
        got = [(r.query_id, r.rank, r.doc_id, pytest.approx(r.score, abs=2e-9)) for r in found.collect()]
        assert sorted(got, key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])


def test_base_scores(spark, sf, texts):
    import math

    train = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    n = Counter(w for d in train for w in words(texts[d]))
    total, kinds = n.total() + len(train), len(n) + 1
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    for r in queries.op5_lattice_lm(spark, sf).collect():
        own = words(texts[r.doc_id])
        assert r.held_out == (r.doc_id not in train) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(own) + 1, sum(w in n for w in own) + 1)
        assert r.base_score == pytest.approx(sum(log(n[w]) for w in own) + log(len(train)), rel=1e-9)
        assert r.score < 0


def test_toxicity_of_held_out_rows(spark, sf):
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    held = [(d, y) for d, y in zip(labels["doc_id"], labels["toxic"], strict=True) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d, _ in held)
    assert sum(got[d].predicted == y for d, y in held) >= 0.9 * len(held)


def test_links_are_those_of_all_pairs(spark, sf, texts):
    def shingles(t):
        w = words(t, low=False)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in texts.items()}
    same = {d: tuple(words(t, low=False)) for d, t in texts.items()}
    links = Counter({d: 0 for d in sets})
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (same[a] == same[b] or both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                links[a] += 1
                links[b] += 1
    got = {r.doc_id: r.n_links for r in queries.op7_near_join(spark, sf).collect()}
    assert got == dict(links)


def test_base_secrets_are_the_patterns(spark, sf, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for r in queries.op9_secret_scan(spark, sf).collect():
        t = texts[r.doc_id]
        own = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 6]
        own += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        own += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
        n = Counter(x[2] for x in own)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        line = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(own))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_surrogates_are_distinct_and_the_same_everywhere(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", F.col("text").alias("old"))
    got = queries.op10_pii_surrogates(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    of, real = defaultdict(set), set()
    for r in got:
        found = surrogates.find(r.old or "")
        assert len(found) == len(r.entities)
        for (start, end, kind, value), e in zip(found, sorted(r.entities, key=lambda e: e.start), strict=True):
            assert (start, end) == (e.start, e.end)
            plain = "".join(c for c in e.surrogate.lower() if c.isalnum()) if kind not in ("ip", "email") else e.surrogate.lower()
            of[kind.split(":")[0], kind, value].add(plain)
            real.add((kind.split(":")[0], "".join(c for c in value.lower() if c.isalnum()) if kind not in ("ip", "email") else value.lower()))
    assert len(of) > 50 and all(len(own) == 1 for own in of.values())
    drawn = [(space, min(own)) for (space, _, _), own in of.items()]
    assert len(set(drawn)) == len(drawn)
    assert not set(drawn) & real


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [
        (1, base, "en", "a", 1), (2, base.replace("w5 ", "x5 "), "en", "a", 1), (3, base.replace(" ", "  "), "en", "b", 1), (4, None, None, None, None), (5, "", "en", None, 0),
        (6, "one alone", "de", "c", 9), (6, "one alone", "de", "c", 9), (7, "long " * 30_000 + "é日", "en", "b", 5), (None, "no id", "en", "a", 5), (8, "x" * 50_000, "en", "a", 5),
    ]
    docs = spark.createDataFrame([(*r, "s", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, kept boolean")
    at = tmp_path_factory.mktemp("awkward")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_pipeline_on_awkward_rows(spark, awkward):
    docs = documents(spark, awkward)
    left = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, awkward)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "kept"]
        left.append((name, sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is None, d))))
    assert left == [("toxicity", [1, 2, 3, 4, 5, 6, 6, 7, 8, None]), ("exact dedup", [1, 2, 4, 6, 7, 8, None]), ("near copies", [1, 4, 6, 7, 8, None])]
    got = corpus_pipeline.run(spark, awkward).collect()
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in got) and {r.doc_id for r in got} <= {1, 6, 7, 8, None}


def test_pipeline_on_no_rows(spark, awkward, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{awkward}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_one_of_each_group(spark, sf, texts):
    docs = documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
    rows = docs.collect()
    kept = {SPACE.sub(" ", r.text or "") for r in rows}
    assert len(kept) == len(rows) and kept <= {SPACE.sub(" ", t) for t in texts.values()}
    assert os.path.isdir(f"{sf}/documents.parquet") or os.path.isfile(f"{sf}/documents.parquet")
