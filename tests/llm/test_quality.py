"""The convolutional network over bytes: its parts against plain ones, and the query's held-out accuracy."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meterlight.llm import quality as q
from meterlight.llm import queries


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(5)
    made = q.Net.new(rng)
    made.floor[:] = rng.normal(0, 0.3, q.FILTERS)
    return made


def plain(net, text):
    """A text's score, window by window."""
    room = -(-(len(text) + q.WINDOW) // q.BLOCK) * q.BLOCK
    flat = np.frombuffer(text + bytes(room - len(text) + q.WINDOW), np.uint8)
    says = np.array([net.vectors[flat[k : k + q.WINDOW]].ravel() @ net.filters + net.floor for k in range(0, room - q.WINDOW + q.STEP, q.STEP)])
    starts = range(0, max(room - q.BLOCK, 1), q.BLOCK)
    chunks = np.array([np.maximum(says[s // q.STEP : (s + 2 * q.BLOCK) // q.STEP].max(axis=0), 0) for s in starts])
    z = np.hstack([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.mix + net.bias[0]
    return 1 / (1 + np.exp(-z))


def test_chunks_cover_whole_texts(net):
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"\x00" * 700, *(bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (499, 500, 501, 512, 1024, 1030, 5000, 90_000))]
    assert net.scores(texts) == pytest.approx([plain(net, t) for t in texts], abs=1e-4)
    assert net.scores(texts[::-1])[::-1] == pytest.approx(net.scores(texts), abs=1e-5)
    # what stands at the very end counts
    assert abs(net.scores([b"e" * 60_000 + b"!%#" * 9])[0] - net.scores([b"e" * 60_027])[0]) > 1e-3


def test_gradient_is_the_slope_of_the_loss(net):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (30, 600, 1700, 3000)]
    y, w = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss(own):
        p = own.scores(texts)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grads = q._gradient(net, texts, y, w)
    for name, g in zip(("vectors", "filters", "floor", "mix", "bias"), grads, strict=True):
        x = getattr(net, name)
        for at in [np.unravel_index(k, g.shape) for k in np.argsort(-np.abs(g), axis=None)[:3]]:
            old = x[at]
            x[at] = old + 1e-3
            up = loss(net)
            x[at] = old - 1e-3
            down = loss(net)
            x[at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.1, abs=2e-4), name


def test_awkward_rows_and_columns(spark):
    rows = [(k, ("fine words here " if k % 3 else "%%% ### $$$ ") * 30, k % 2) for k in range(60)] + [(100, None, 0), (101, "", 0), (None, "no key", 1)] + [(102, "copy", 1)] * 5 + [(103, "long " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("predicted", F.lit("x")).withColumn("_key", F.lit(0)).withColumn("_row", F.lit(0))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)] + [(1, None, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.score_documents(docs, labels)
    assert sorted(got.columns) == sorted([*docs.columns, "held_out"])
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id == 102}) == 1 and len({r.score for r in out if r.doc_id in (100, 101)}) == 1
    seen = {r.doc_id: r.score for r in out}
    assert np.mean([seen[k] for k in range(60) if k % 3]) > np.mean([seen[k] for k in range(0, 60, 3)]) + 0.3
    assert q.score_documents(docs.limit(0), labels).count() == 0
    assert {r.score for r in q.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in q.score_documents(docs, labels.where("quality = 1")).collect()}) == 1


def test_sample_is_bounded_with_repeated_keys(spark):
    docs = spark.createDataFrame([(1, f"text {k % 50}") for k in range(400)] + [(2, "same")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    texts, y, share = q.labelled_sample(docs, labels, rows=20)
    assert (len(texts), sum(y), share) == (21, 20, 0.5)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_quality_cnn(spark, sf).collect()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    assert len(got) == pq.read_table(f"{sf}/documents.parquet", columns=["doc_id"]).num_rows
    held = [(got[d], y) for d, y in zip(labels["doc_id"], labels["quality"], strict=True) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == y for r, y in held]) >= 0.93
    good, bad = ([r.score for r, y in held if y == k] for k in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.97
