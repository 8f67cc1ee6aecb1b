"""Session transcripts line by line: prompts, tool calls and their results, turns, and the subagents that a session started."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.functions.text import decoded_path
from meterlight.operators.sessions import prose
from meterlight.sources.jsonl import LONGEST, USAGE, Source, lines

LINE = (
    "type string, timestamp string, cwd string, entrypoint string, permissionMode string, requestId string, isMeta boolean, isSidechain boolean, isCompactSummary boolean, "
    f"message struct<id:string,model:string,usage:{USAGE},content:variant>"
)
BLOCKS = "array<struct<type:string,id:string,name:string,text:string,input:variant,tool_use_id:string,is_error:boolean>>"
# Where a call's target stands in its input, the best first.
TARGETS = ("command", "file_path", "path", "pattern", "url", "query", "skill", "prompt", "description")
SUBAGENTS = "/subagents/"


def session_lines(spark: SparkSession, source: Source, not_before: dt.datetime | None = None, main_only: bool = False) -> DataFrame:
    """``lines_of_sessions`` of the source's files: of all, of those changed since a time, or of main transcripts alone."""
    rows = lines(spark, source, not_before, longest=LONGEST)
    return lines_of_sessions(rows.where(~F.col("path").contains(SUBAGENTS)) if main_only else rows, source.root)


def session_of(path: Column, root: str) -> Column:
    """Project and session of a main transcript ``root/project/session.jsonl`` or of a subagent's beside it, as a list of two; other paths have another number of parts."""
    below = F.substring_index(path, root.split("://")[-1].rstrip("/") + "/", -1)
    return F.split(F.regexp_replace(F.regexp_replace(below, r"/subagents/[^/]*\.jsonl\z", ""), r"\.jsonl\z", ""), "/")


def lines_of_sessions(rows: DataFrame, root: str) -> DataFrame:
    """Lines of main transcripts and of the subagents beside them, with ``session_id``, ``project``, ``is_sub``, and ``ord``: the main file first."""
    rows = rows.withColumn("is_sub", F.col("path").contains(SUBAGENTS)).withColumn("_at", session_of(F.col("path"), root)).where("size(_at) = 2")
    m = F.from_json("value", LINE)
    rows = rows.select(
        "path", F.struct("is_sub", "ord").alias("ord"), "is_sub", F.col("_at")[0].alias("project"), F.col("_at")[1].alias("session_id"), "vendor", "source", m.alias("m")
    ).where("m is not null")
    listed = F.schema_of_variant("m.message.content").startswith("ARRAY")
    blocks = F.when(listed, F.try_variant_get("m.message.content", "$", BLOCKS))
    return rows.select("*", F.try_to_timestamp("m.timestamp").alias("ts"), blocks.alias("blocks"))


def overview(rows: DataFrame) -> DataFrame:
    """Of each session: the span of all its lines, the first folder and entry point of the main file, and whether it opened a pull request."""
    first = lambda c: F.min_by(c, F.when(~F.col("is_sub") & (F.coalesce(F.col(c), F.lit("")) != ""), F.col("ord")))
    rows = rows.select("session_id", "project", "ts", "ord", "is_sub", "m.type", "m.cwd", "m.entrypoint")
    return rows.groupBy("session_id", "project").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), first("cwd").alias("cwd"), first("entrypoint").alias("entrypoint"), F.coalesce(F.bool_or(F.col("type") == "pr-link"), F.lit(False)).alias("has_pr_link")
    )


def prompts(rows: DataFrame) -> DataFrame:
    """User turns of main transcripts that carry a mode; ``text`` is what a person typed, and null where that is nothing."""
    own = rows.where("m.type = 'user' and m.permissionMode <> '' and not is_sub")
    said = F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n")
    plain = F.when(F.schema_of_variant("m.message.content") == "STRING", F.try_variant_get("m.message.content", "$", "string"))
    by_hand = F.lit(True)
    for flag in ("isMeta", "isSidechain", "isCompactSummary"):
        by_hand = by_hand & ~F.coalesce(F.col(f"m.{flag}"), F.lit(False))
    return own.select(
        "session_id", "project", "ts", "ord", F.col("m.permissionMode").alias("mode"), F.coalesce("m.cwd", F.lit("")).alias("cwd"), F.coalesce("m.entrypoint", F.lit("")).alias("entrypoint"),
        F.when(by_hand, prose(F.coalesce(plain, said))).alias("text"),
    )


def target(given: Column) -> Column:
    """The first of ``TARGETS`` in the input that is a string and not empty."""
    kind = lambda k: F.schema_of_variant(F.try_variant_get(given, f"$.{k}", "variant")) == "STRING"
    return F.coalesce(*(F.when(kind(k), F.nullif(F.try_variant_get(given, f"$.{k}", "string"), F.lit(""))) for k in TARGETS), F.lit(""))


def tool_calls(rows: DataFrame) -> DataFrame:
    """Calls in the order read; of blocks with one id in a session the first counts, and blocks without id all do."""
    each = rows.where("blocks is not null").select("session_id", "project", "path", "ts", "ord", "is_sub", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'tool_use'")
    each = each.select(
        "session_id", "project", "path", "ts", F.struct("ord", "pos").alias("ord"), "is_sub", F.coalesce("b.id", F.lit("")).alias("id"), F.coalesce("b.name", F.lit("")).alias("name"), target(F.col("b.input")).alias("target"),
        *(F.when(F.schema_of_variant(F.try_variant_get("b.input", f"$.{k}", "variant")) == "STRING", F.try_variant_get("b.input", f"$.{k}", "string")).alias(k) for k in ("command", "file_path")),
    )
    first = each.where("id <> ''").withColumn("_n", F.row_number().over(W.partitionBy("session_id", "id").orderBy("ord"))).where("_n = 1").drop("_n")
    return first.unionByName(each.where("id = ''"))


def tool_results(rows: DataFrame) -> DataFrame:
    """``session_id, id, ord, is_error``, for ``matched_calls``."""
    each = rows.where("blocks is not null").select("session_id", "ord", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'tool_result' and b.tool_use_id <> ''")
    return each.select("session_id", F.col("b.tool_use_id").alias("id"), F.struct("ord", "pos").alias("ord"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


def session_events(rows: DataFrame) -> DataFrame:
    """Usage events of sessions. A message repeats inside its session only, so ``message_id`` has the session in front."""
    u = "m.message.usage"
    n = lambda f: F.coalesce(F.col(f"{u}.{f}_tokens"), F.lit(0).cast("bigint"))
    own = rows.where(F.col(u).isNotNull() & (F.coalesce("m.message.model", F.lit("")) != "<synthetic>"))
    mid, req = F.nullif("m.message.id", F.lit("")), F.nullif("m.requestId", F.lit(""))
    return own.select(
        "ord", "ts", "session_id", F.col("m.cwd").alias("cwd"), "project", "vendor", "source", F.coalesce("m.message.model", F.lit("")).alias("model"), F.concat("session_id", F.lit("/"), mid).alias("message_id"), req.alias("request_id"),
        "is_sub", n("input").alias("tok_in"), n("output").alias("tok_out"), n("cache_creation_input").alias("tok_cw"), n("cache_read_input").alias("tok_cr"), F.lit(False).alias("costed"), "path",
    )


def subagents(spark: SparkSession, source: Source) -> DataFrame:
    """``stem, description, depth`` of the ``*.meta.json`` beside subagents' transcripts; those that aren't JSON objects are left out."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").option("wholetext", True).text(source.root)
    read = read.select("value", decoded_path(F.col("_metadata.file_path")).alias("path")).where(F.col("path").contains(SUBAGENTS))
    meta = F.from_json("value", "description string, spawnDepth int, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    read = read.select(F.regexp_replace("path", r"\.meta\.json\z", "").alias("stem"), meta.alias("m")).where("m._bad is null")
    return read.select("stem", F.coalesce("m.description", F.lit("")).alias("description"), F.coalesce("m.spawnDepth", F.lit(0)).alias("depth"))
