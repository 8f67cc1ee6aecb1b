"""The Merkle manifest against a plain one, in many ranges and in one."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlight.llm import manifest as m
from meterlight.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """(key, leaf, subroot, root, digest of the siblings) of each row."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    def beside(levels, k):
        return [row[(k >> n) ^ 1] for n, row in enumerate(levels[:-1]) if (k >> n) ^ 1 < len(row)]

    groups = {}
    for d, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((d is None, d or 0, h(*map(field, (d, source, lang, n, text))), d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [(sorted(groups[g]), up([x[2] for x in sorted(groups[g])])) for g in names]
    top = up([t[-1][0] for _, t in trees])
    return sorted(
        (str(d), leaf, t[-1][0], top[-1][0], h(*beside(t, k), *beside(top, j)))
        for j, (leaves, t) in enumerate(trees) for k, (_, _, leaf, d) in enumerate(leaves)
    )


def got(rows, **options):
    made = m.manifest(rows, [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")], **options)
    made = made.withColumn("same", m.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    out = made.select("doc_id", "leaf", "subroot", "root", m.proof_digest(F.col("path")).alias("p"), "same").collect()
    assert all(r.same for r in out)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p) for r in out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(k, rng.choice(["", None, "año", "x" * k]), rng.choice(["en"] * 9 + ["ü", None, ""]), rng.choice(["a", None]), rng.choice([None, k])) for k in range(150)]
    out += [(7, "same", "en", "a", 4)] * 20 + [(None, "no key", "en", "a", 1), (None, None, None, None, None), (3, "alone", "zz", "a", 5), (9, "one", "10", "é", 2)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("part_rows", [9, 1000])
def test_trees_of_many_groups_and_ranges(spark, rows, part_rows):
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), part_rows=part_rows) == plain(rows)


def test_rounds_of_ragged_nodes(spark, rows, monkeypatch):
    monkeypatch.setattr(m, "LEVELS", 2)
    assert got(spark.createDataFrame(rows, SCHEMA), part_rows=5) == plain(rows)


def test_small_tables_and_columns_named_alike(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    one = [(1, "x", "en", None, 1)]
    frame = spark.createDataFrame(one, SCHEMA)
    for name in ("leaf", "root", "path", "_g", "_leaf", "_part"):
        frame = frame.withColumn(name, F.lit(1))
    assert got(frame) == plain(one)
    assert got(frame)[0][1] == got(frame)[0][3]


@pytest.mark.parametrize("first", range(5))
@pytest.mark.parametrize("total", [1, 2, 5, 8, 13])
def test_runs_give_each_ragged_node_once(first, total):
    leaves = [h(str(k)) for k in range(total)]
    for end in range(first + 1, total + 1):
        known, covered = {}, []
        for level, (at, nodes, ragged) in enumerate(m.runs(first, leaves[first:end], total)):
            known |= {(level, at + k): x for k, x in enumerate(nodes)}
            covered += [leaf for a in ragged for leaf in range(a << level, min((a + 1) << level, total))]
        assert sorted(covered) == list(range(first, end))


def test_query_finds_what_was_tampered_with(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cursor = con.execute(queries.OP12_SQL)
    names = [c[0] for c in cursor.description]
    made = queries.op12_merkle_manifest(spark, sf).select(names).collect()
    assert sorted(map(tuple, made)) == sorted(cursor.fetchall())
    for r in made:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
