"""Search over many blocks of queries and segments of documents, against scoring everything."""

import numpy as np
import pytest

from meterlight.llm import search


def test_shards_are_made_once_for_several_blocks_of_queries(spark, monkeypatch):
    """The index isn't read anew for each block: over 5 blocks it is gone through 4 times and not 10, for the same rows."""
    docs = spark.createDataFrame([(d, " ".join(f"w{(d * x) % 23}" for x in range(1, 12))) for d in range(40)], "doc_id long, text string")
    calls, whole = [], search._answers
    monkeypatch.setattr(search, "_answers", lambda *a, **b: (calls.append(1), whole(*a, **b))[1])
    rows = lambda found: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in found.collect())
    want = rows(search.bm25_top_k(docs, docs.where("doc_id % 4 = 0"), k=3))
    words = sum(len(search.terms(r.text)[0]) for r in docs.where("doc_id % 4 = 0").collect())
    calls.clear()
    assert rows(search.bm25_top_k(docs, docs.where("doc_id % 4 = 0"), k=3, shard_bytes=200, query_terms=-(-words // 5))) == want
    assert len(want) > 20 and len(calls) <= 4


@pytest.fixture(scope="module")
def languages():
    """1300 documents of two vocabularies and of both, three of them empty, and what each of 40 queries gives each of them."""
    rng = np.random.default_rng(4)
    p = 1 / np.arange(1, 401)
    text = lambda kind, n: " ".join(f"{'ab'[k]}{w}" for k, w in zip(rng.choice(2, n, p=kind), rng.choice(400, n, p=p / p.sum()), strict=True))
    kinds = ((1, 0), (0, 1), (0.5, 0.5))
    docs = [search.terms(text(kinds[d % 3], int(rng.integers(1, 120)) if d % 500 else 0)) for d in range(1300)]
    mean = sum(n.sum() for _, n in docs) / len(docs)
    queries = [search.terms(text(kinds[j % 3], int(rng.integers(1, 90)))) for j in range(40)]
    queries = [(t, n * rng.uniform(0.5, 9, len(t))) for t, n in queries]
    scores = np.zeros((len(queries), len(docs)))
    for d, (t, n) in enumerate(docs):
        impact = n * (search.K1 + 1) / (n + search.K1 * (1 - search.B + search.B * n.sum() / mean))
        for j, (q, w) in enumerate(queries):
            _, x, y = np.intersect1d(q, t, return_indices=True)
            scores[j, d] = (w[x] * impact[y]).sum()
    return docs, mean, queries, scores


@pytest.mark.parametrize("k, share", [(10, 0), (10, 0.9), (10, 1), (1, 1), (1299, 0), (5000, 0)])
def test_segments_leave_out_nothing_that_counts(languages, k, share):
    docs, mean, queries, scores = languages
    every = np.unique(np.concatenate([t for t, _ in docs] + [t for t, _ in queries]))
    index = search.Index(docs, every, mean)
    assert len(index.segments) == 3 and index.columns and len(index.rare)
    best = -np.sort(-scores, axis=1)[:, : min(k, len(docs))]
    least = share * best[:, -1]
    edges = np.cumsum([0, *(len(t) for t, _ in queries)])
    code = np.searchsorted(every, np.concatenate([t for t, _ in queries]))
    found = {j: (d, s) for j, d, s in index.search_all(every, edges, code, np.concatenate([w for _, w in queries]), k, least)}
    for j, row in enumerate(scores):
        at, got = found.get(j, (np.empty(0, int), np.empty(0)))
        assert len(set(at.tolist())) == len(at) and got == pytest.approx(row[at], abs=1e-9)
        assert sorted(np.round(got, 9), reverse=True)[:k] == pytest.approx([x for x in best[j] if x > 0], abs=2e-9)


def test_postings_by_document_beyond_16_bits():
    doc = np.random.default_rng(0).integers(0, 200_000, 300_000).astype(np.int32)
    assert (search._by_document(doc, 200_000) == np.argsort(doc, kind="stable")).all()
    assert (search._by_document(doc % 65536, 65536) == np.argsort(doc % 65536, kind="stable")).all()


def test_words_are_counted():
    text = "B a b\tÄ a A\x0bc  "
    t, n = search.terms(text)
    assert (np.diff(t.astype(object)) > 0).all() and sorted(n) == [1, 1, 2, 3] and n[t == search.terms("a")[0]] == 3
    assert [len(x) for x in search.terms(" \n")] == [0, 0]
