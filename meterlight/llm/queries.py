"""The queries of the corpus operators, and the SQL that expresses them where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_join import near_join

    return near_join(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "class_size", "n_links", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived, page_key

    read = archived(spark, documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
    body = F.when(F.col("type") == "response", F.octet_length("payload")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("type") == "response", F.sha1("payload")).otherwise(F.col("digest"))
    return read.select(
        page_key("id").alias("page_id"), body.cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("type").alias("record_type"), page_key("refers_to").alias("refers_to"),
    )


OP1_SQL = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT *, payload_bytes < 1000 OR row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) = 1 AS alone,
                  max(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN alone THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT alone THEN first END AS refers_to
FROM g
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import ByteBPE, round_trip_documents

    # its workers hold nothing else, so that they may remember more than in the pipeline
    bpe = ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=200_000)
    coded = round_trip_documents(documents(spark, sf_dir).select("doc_id", "text"), bpe)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_documents(docs, documents(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_documents

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    found = scan_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(text(F.filter("secrets", lambda s: s.kind != "markov")), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"),
    )


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import pseudonymised

    new = pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), key=b"meterlight-surrogates-1")
    return new.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import bm25_top_k

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bm25_top_k(docs, docs.where("doc_id % 100 = 0"), k=10)


#: Words are split at ASCII white space and A-Z is put in lower case; k1 = 1.2, b = 0.75; a query's words count as often as they come.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
     tf AS (SELECT doc_id, len(words) AS length, word, count(*) AS n FROM (SELECT doc_id, words, unnest(words) AS word FROM d) GROUP BY ALL),
     t AS (SELECT doc_id, length, word, n FROM tf),
     df AS (SELECT word, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t GROUP BY word),
     mean AS (SELECT sum(len(words)) / count(*) AS length FROM d),
     s AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.n * df.idf * t.n * 2.2 / (t.n + 1.2 * (0.25 + 0.75 * t.length / mean.length))), 9) AS score
           FROM t AS q JOIN df ON q.word = df.word JOIN t ON t.word = q.word, mean WHERE q.doc_id % 100 = 0 GROUP BY ALL),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed, words
    from .shared import text_of

    docs = documents(spark, sf_dir).select("doc_id", "source", words(text_of()).alias("size"), F.xxhash64("text").alias("content"))
    return mixed(docs, F.col("size")).select(
        "_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.aggregate("_taken", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("taken"),
        F.transform("_taken", lambda t: F.struct(t["shard"].alias("shard"), t["at"].alias("slot"), t["n"].alias("words"))).alias("shards"),
    )


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lattice_lm import score_documents
    from .shared import fold

    scores = score_documents(documents(spark, sf_dir).select("doc_id", "text", "lang"), fold(F.col("doc_id"), 10) != 0, public_tokenizers.path("piece_bpe_32k.model"), F.col("lang"))
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_documents(docs, documents(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import folded, leaf, manifest, proof_digest

    docs = documents(spark, sf_dir)
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*values[:3], F.col("n_chars").cast("decimal(20,0)") + 1, values[4]]
    # the leaf that a checker would make of the row that it is given
    given = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(*changed))
    rows = manifest(docs, values, keep={"given": given})
    rows = rows.withColumn("folded_root", folded(F.coalesce("given", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 in SQL: the steps for each byte, from the polynomial, and a fold over the bytes of a text.
CRC_STEPS = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps)"


def _crc_sql(text: str) -> str:
    digit = "instr('0123456789ABCDEF', substr(hex(encode({t})), 2 * i + {k}, 1)) - 1"
    octets = f"list_transform(range(strlen({text})), lambda i: ({digit.format(t=text, k=1)}) * 16 + {digit.format(t=text, k=2)})"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


OP12_SQL = f"""
WITH RECURSIVE {CRC_STEPS},
  parts AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_field_sql("doc_id")} || {_field_sql("source")} || {_field_sql("lang")} AS head, {_field_sql("n_chars")} AS size, {_field_sql("n_chars + 1")} AS other,
                   {_field_sql("text")} AS tail, coalesce({_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS hit FROM documents, crc),
  leaves AS (SELECT doc_id, g, sha256(head || size || tail) AS leaf, sha256(head || CASE WHEN hit THEN other ELSE size END || tail) AS given FROM parts),
  placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY g) AS n FROM leaves),
  nodes(g, level, spot, n, h) AS (SELECT g, 0, spot, n, leaf FROM placed UNION ALL
    SELECT g, level + 1, spot // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY spot)) FROM nodes WHERE n > 1 GROUP BY g, level, spot // 2, n),
  subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1),
  top(level, spot, n, h) AS (SELECT 0, spot, n, h FROM subroots UNION ALL
    SELECT level + 1, spot // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY spot)) FROM top WHERE n > 1 GROUP BY level, spot // 2, n),
  steps_low AS (SELECT DISTINCT g, level FROM nodes WHERE n > 1),
  steps_top AS (SELECT DISTINCT level FROM top WHERE n > 1),
  low AS (SELECT p.g, p.spot, string_agg(s.h, '' ORDER BY s.level) AS siblings FROM placed AS p JOIN nodes AS s ON s.g = p.g AND s.n > 1 AND s.spot = xor(p.spot >> s.level, 1) GROUP BY p.g, p.spot),
  high AS (SELECT p.g, string_agg(s.h, '' ORDER BY s.level) AS siblings FROM subroots AS p JOIN top AS s ON s.n > 1 AND s.spot = xor(p.spot >> s.level, 1) GROUP BY p.g),
  up(g, spot, level, h) AS (SELECT g, spot, 0, given FROM placed UNION ALL
    SELECT u.g, u.spot, u.level + 1, sha256(CASE WHEN (u.spot >> u.level) & 1 = 1 THEN s.h || u.h ELSE u.h || coalesce(s.h, '') END)
    FROM up AS u JOIN steps_low AS l ON l.g = u.g AND l.level = u.level LEFT JOIN nodes AS s ON s.g = u.g AND s.level = u.level AND s.spot = xor(u.spot >> u.level, 1)),
  met AS (SELECT u.g, u.spot, r.spot AS own, u.h FROM up AS u JOIN (SELECT g, spot, max(level) AS level FROM up GROUP BY g, spot) AS m ON m.g = u.g AND m.spot = u.spot AND m.level = u.level JOIN subroots AS r ON r.g = u.g),
  crown(g, spot, own, level, h) AS (SELECT g, spot, own, 0, h FROM met UNION ALL
    SELECT u.g, u.spot, u.own, u.level + 1, sha256(CASE WHEN (u.own >> u.level) & 1 = 1 THEN s.h || u.h ELSE u.h || coalesce(s.h, '') END)
    FROM crown AS u JOIN steps_top AS l ON l.level = u.level LEFT JOIN top AS s ON s.level = u.level AND s.spot = xor(u.own >> u.level, 1)),
  root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, r.h AS subroot, root.h AS root, sha256(coalesce(low.siblings, '') || coalesce(high.siblings, '')) AS proof_sha256, o.h AS folded_root, o.h = root.h AS verified
FROM placed AS p JOIN subroots AS r ON r.g = p.g LEFT JOIN low ON low.g = p.g AND low.spot = p.spot LEFT JOIN high ON high.g = p.g
JOIN crown AS o ON o.g = p.g AND o.spot = p.spot AND o.level = (SELECT max(level) FROM top), root
"""


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resampled

    scored = resampled(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark").select("text"), percent=10, orders=1, buckets=10_000, seed=2024, least_words=20)
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH {CRC_STEPS},
  d AS (SELECT doc_id, row_number() OVER () AS id, {_WORDS_SQL} AS words FROM documents),
  w AS (SELECT id, unnest(words) AS word FROM d),
  b AS (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
  kinds AS (SELECT word, {_crc_sql("word")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), crc),
  s AS (SELECT bucket, count(*) AS n FROM w JOIN kinds USING (word) GROUP BY bucket),
  t AS (SELECT bucket, count(*) AS n FROM b JOIN kinds USING (word) GROUP BY bucket),
  sums AS (SELECT (SELECT count(*) FROM w) AS s, (SELECT count(*) FROM b) AS t),
  gains AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (sums.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
  g AS (SELECT id, sum(gain) AS gain FROM w JOIN kinds USING (word) JOIN gains USING (bucket) GROUP BY id),
  h AS (SELECT d.doc_id, id, len(words) AS n_features, coalesce(gain, 0)::BIGINT AS gain, ('0x' || sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8])::BIGINT AS h FROM d LEFT JOIN g USING (id)),
  x AS (SELECT *, CAST(floor(gain / greatest(n_features, 1)) AS BIGINT) AS weight, CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS luck FROM h),
  r AS (SELECT id, row_number() OVER (ORDER BY weight + luck DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + luck AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_byte_bpe": op2_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_near_join": op7_near_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op3_search": op3_search,
    "op4_source_mix": op4_source_mix,
    "op5_lattice_lm": op5_lattice_lm,
    "op11_quality_cnn": op11_quality_cnn,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_target_resampling": op13_target_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_search": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_target_resampling": OP13_SQL,
}
