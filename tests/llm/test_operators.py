"""The operators on small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows at all."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meterlight.llm import exact_dedup, lattice_lm, mixing, near_join, search, secret_scan, surrogates, toxicity, warc
from meterlight.llm.bpe import ByteBPE, decode_documents, encode_documents

BASE = " ".join(f"w{k}" for k in range(60))
TEXTS = [
    (1, BASE, "a"), (2, BASE.replace("w5 ", "x5 "), "a"), (3, BASE.replace(" ", "\t\n"), "b"), (4, None, "b"), (5, "", None), (6, "one", "a"), (7, "one", "a"),
    (7, "one", "a"), (8, " one ", "c"), (None, BASE, "c"), (9, "long " * 5000 + "é日", "b"), (10, "password=abcdef1 a.b@mail.example.com", "a"), (None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, "k", "e", 2) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, keep_id int, kept string, entities string, n int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def space(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for d, t, _ in TEXTS:
        groups[space(t)].append(d)
    assert len(got) == len(TEXTS) and sum(r.kept for r in got) == len(groups)
    for r in got:
        own = groups[space(r.text)]
        assert r.group_size == len(own) and r.text_sha256 == hashlib.sha256(space(r.text).encode()).hexdigest()
        assert r.keep_id == min((d for d in own if d is not None), default=None)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_near_join(docs, none):
    got = near_join.near_join(docs).collect()
    assert len(got) == len(TEXTS)
    by = Counter((r.class_id, r.class_size, r.n_links) for r in got)
    # the base text, its copy in other spaces and the one without an id are one text; the changed one is linked with all three
    assert by[(1, 4, 3)] == 4
    assert by[(6, 4, 3)] == 4
    assert by[(4, 3, 2)] == 3
    assert sum(r.kept for r in got) == len({(r.class_id, r.class_size) for r in got})
    assert near_join.near_join(none).count() == 0


def test_near_join_finds_weak_links_beside_a_large_group(spark):
    texts = {k: " ".join(f"g{j}" for j in range(46)) + f" own{k}" for k in range(300)}  # 44850 links of 0.95
    for k in range(400):  # 400 links of 0.80 to 0.85
        words = [f"p{k}w{j}" for j in range(49 + k % 16)]
        texts[1000 + 2 * k] = " ".join(words)
        texts[1001 + 2 * k] = " ".join(words[:-5] + [f"q{k}w{j}" for j in range(5)])
    sets = {d: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in texts.items())}
    holders = defaultdict(list)
    for d, own in sets.items():
        for shingle in own:
            holders[shingle].append(d)
    links = Counter()
    for d, own in sets.items():
        for e, n in Counter(e for shingle in own for e in holders[shingle]).items():
            links[d] += e != d and 5 * n >= 4 * (len(own) + len(sets[e]) - n)
    got = near_join.near_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == links
    assert all(r.class_id == (0 if r.doc_id < 1000 else r.doc_id // 2 * 2) for r in got)


def test_mixing(docs, none):
    got = mixing.mixed(docs, mixing.words(F.coalesce("text", F.lit("")))).collect()
    assert len(got) == len(TEXTS)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        n = sum(t["n"] for t in r._taken)
        assert n <= 2 * r._size
        taken[r._row.source] += n
        size[r._row.source] += r._size
        target[r._row.source] = r._target
    assert all(abs(taken[s] - t) <= 5 * t**0.5 + 2 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert sum(len(r.text.split()) for r in texts.collect()) == sum(taken.values())
    assert sum(len(r.text.split()) for r in mixing.mixed_texts(docs, by_slot=True).collect()) == sum(taken.values())
    assert mixing.mixed_texts(none).count() == 0


def water_filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sizes[s] + 1e-9}
        for s in over or free:
            target[s] = most * sizes[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    return target


def test_shards_of_the_mix(spark, monkeypatch):
    rows = [(k, "word " * (5 + k % 7), "abcdefgh"[k % 8 if k % 3 else 0]) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = lambda d: mixing.mixed(d, mixing.words(F.col("text")), block=4, shard_slots=128).collect()
    got = mix(docs)
    size = Counter()
    for r in got:
        size[r._row.source] += r._size
    want = water_filled(size)
    assert {r._row.source: pytest.approx(r._target) for r in got} == want
    # the same rows in other partitions give the same mix
    key = lambda found: sorted((r._row.doc_id, [tuple(t) for t in r._taken]) for r in found)
    assert key(mix(docs.repartition(7, "text"))) == key(got)
    target, slots, taken = {r._row.source: r._target for r in got}, defaultdict(set), Counter()
    for r in got:
        for t in r._taken:
            slots[t["shard"], t["at"]].add(r._row.source)
            taken[t["shard"], t["at"]] += t["n"]
    assert all(len(own) == 1 for own in slots.values()) and max(taken.values()) == 4
    counts = defaultdict(Counter)
    for (shard, _), own in slots.items():
        counts[shard][min(own)] += 1
    for source, words in target.items():
        share = words / sum(target.values())
        assert all(abs(n[source] - 128 * share) < 5 * (128 * share * (1 - share)) ** 0.5 + 2 for s, n in counts.items() if s < max(counts))
    # the draws decide: with other draws other words are taken, and with none, none
    usual = mixing.draws
    monkeypatch.setattr(mixing, "draws", lambda *a: usual(*a[:-1], 5))
    assert [len(r._taken) for r in mix(docs)] != [len(r._taken) for r in got]
    monkeypatch.setattr(mixing, "draws", lambda *a: usual(*a).where("false"))
    assert not any(r._taken for r in mix(docs))


def test_lattice(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice_lm.score_documents(docs.withColumn("lang", F.col("source")), F.col("doc_id") != 6, path, F.col("lang")).collect()
    assert len(got) == len(TEXTS)
    n = sum(len((t or "").split()) + 1 for d, t, _ in TEXTS if d is not None and d != 6)
    for r in got:
        assert r.train_tokens == n and r.score < 0 and r.base_score < 0
    assert Counter(r.n_tokens for r in got)[1] == 3
    assert lattice_lm.score_documents(none, F.lit(True), path).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(d, k % 2) for k, d in enumerate((1, 2, 3, 6, 7))], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.score_documents(docs, labels.where("false")).where("predicted = 1").count() == 0


def test_secrets(docs, none):
    got = {(r.doc_id, s.kind, r.text[s.start : s.end]) for r in secret_scan.scan_documents(docs).collect() for s in r.secrets}
    assert got == {(10, "assign", "password=abcdef1")}
    assert secret_scan.scan_documents(none).count() == 0


def test_secret_models_learn(spark):
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(200)]
    rows = [(k, f"some ordinary words and identifiers like readFile2Buffer here token={h}") for k, h in enumerate(hexes)]
    names = "readFile2BufferAgain setUserNameOfSession data_table_index_column http/www/example/com/list/page"
    rows.append((999, f"key q7Zt2Lm9Xc4Vb8Nw1Rk5Pd3 and {names} and 4401553578478930"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secret_scan.scan_documents(docs).where("doc_id = 999").first()
    assert [(s.kind, got.text[s.start : s.end]) for s in got.secrets] == [("markov", "q7Zt2Lm9Xc4Vb8Nw1Rk5Pd3")]
    models = secret_scan.train(docs)
    assert models.recall > 0.99 and models.false_alarms < 0.002


def test_secrets_of_one_case_and_beside_names(spark):
    rng = random.Random(4)
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    names = ["configuration", "repository", "application", "environment", "transformation", "administration", "documentation", "implementation", "zookeeper", "quicksilver", "jackboxes", "hydroxyl", "viewpoint", "windlass"]
    prose = [f"the {rng.choice(names)} of our {rng.choice(names)}/{rng.choice(names)} and {rng.choice(names)}_{rng.choice(names)}" for _ in range(3000)]
    prose = [f"{t} {rng.choice(names).upper()} {rng.choice(names).title()} on 20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 30)}" for t in prose]
    rows = [(k, f"{t} token={drawn(string.ascii_letters + string.digits, 32)}") for k, t in enumerate(prose)]
    lower, upper, mixed = drawn(string.ascii_lowercase, 32), drawn(string.ascii_uppercase, 32), "aB3xK9zQ7mT2pLwR5vYc"
    long = "administration/documentation/implementation/transformation/"
    rows += [(1001, lower), (1002, upper), (1003, long + mixed), (1004, f"{mixed}/{long}"), (1005, long + "configuration"), (1006, "1" * 40)]
    got = secret_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.text[s.start : s.end]) for r in got for s in r.secrets if s.kind == "markov"}
    assert found == {(1001, lower), (1002, upper), (1003, long + mixed), (1004, f"{mixed}/{long}")}


def test_surrogates(spark, docs, none):
    got = {r.doc_id: r for r in surrogates.pseudonymised(docs, b"k").collect()}
    assert "mail.example.com" not in got[10].text and got[10].text.startswith("password=abcdef1 ")
    assert got[4].text is None and got[5].text == "" and got[1].text == BASE
    assert surrogates.pseudonymised(none, b"k").count() == 0
    # few addresses: many collide at first, and none does in the end
    ips = spark.createDataFrame([(k, f"at 10.0.{k % 8}.{k // 8}") for k in range(400)], "doc_id long, text string")
    for most in (100_000, 0):
        new = [r.text for r in surrogates.pseudonymised(ips, b"k", most_sent=most).collect()]
        assert len(set(new)) == 400


def test_search(docs, none):
    got = search.bm25_top_k(docs, docs.where("doc_id in (1, 6)"), k=4)
    by = {q: [r.doc_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 6)}
    assert by == {1: [1, 3, None, 2], 6: [6, 7, 7, 8]}
    assert search.bm25_top_k(none, docs, k=3).count() == 0
    assert search.bm25_top_k(docs, none, k=3).count() == 0


def test_bpe(spark, docs, none):
    bpe = ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = decode_documents(encode_documents(docs, bpe), bpe).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got)
    assert encode_documents(none, bpe).count() == 0


def test_warc(spark):
    big = "<html>" + "x" * 2000
    rows = [(1, "http://a", big), (2, "http://b\n", big), (3, None, big), (3, "again", big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (None, "u", big), (8, "u", "é" * 1000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, id string, of int")
    read = warc.archived(spark, pages).withColumn("page_id", warc.page_key("id")).withColumn("of", warc.page_key("refers_to")).collect()
    assert len(read) == len(rows) == len({r.id for r in read})
    assert sum(r.type == "response" for r in read if r.payload_bytes == len(big)) == 1
    for r in read:
        html = next(h for p, _, h in rows if p == r.page_id) or ""
        assert r.digest == hashlib.sha1(html.encode()).hexdigest() and r.payload_bytes == len(html.encode())
        assert r.of == (3 if r.type == "revisit" else None) and (r.type == "response" or html == big)
        assert r.page_id == 3 or (r.type == "revisit") == (html == big)
    assert warc.archived(spark, pages.where("false")).count() == 0


def test_words_of_shards_are_added_up_before_they_are_rows(spark):
    """Counts of words leave a task packed: rows don't grow with shards times words, and the sums are those of all shards."""
    shards, words = 40, [0, 1, *range(1 << 58, 1 << 64, 1 << 56)]
    packed = [(bytearray(np.array(words, np.uint64).tobytes()), bytearray(np.full(len(words), k, np.int32).tobytes()), bytearray(np.array([k, 2], np.int32).tobytes())) for k in range(1, shards + 1)]
    index = spark.createDataFrame(packed, "term binary, n binary, lengths binary").coalesce(2)
    assert search._packed_counts(index).count() <= 2 * search.COUNT_PARTS < shards * len(words)
    got = search._counted(index).collect()
    total = sum(range(1, shards + 1))
    assert sorted((r.term % (1 << 64), r.df) for r in got if r.df) == [(w, total) for w in words]
    assert sum(r.length for r in got) == total + 2 * shards
    assert search._counted(index.limit(0)).collect() == []
