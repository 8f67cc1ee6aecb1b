"""The corpus pipeline: toxic documents go, then exact and near copies; what stays is mixed to target weights and encoded.

Each stage takes what the one before kept, as a table, and decides on all of it. Null texts are empty texts: they aren't
toxic, are copies of each other, take no share of the mix and so leave it there. Repeated rows are copies. A null source is a
source. Columns of ``documents`` beyond the usual ones go through all stages but the last, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm.bpe import ByteBPE, round_trip_documents
from meterlight.llm.exact_dedup import exact_dedup
from meterlight.llm.mixing import mixed_texts
from meterlight.llm.near_join import near_join
from meterlight.llm.shared import documents, dropped, kept, small_batches, tables_of_run
from meterlight.llm.toxicity import score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field doesn't call toxic."""
    small_batches(spark)
    return score_documents(docs, documents(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the least id."""
    small_batches(spark)
    return exact_dedup(docs).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the least id."""
    small_batches(spark)
    return near_join(docs).where("kept").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and pass of the mix, with the words that this pass takes; ``n_chars`` follows the text."""
    small_batches(spark)
    rows = mixed_texts(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each row, and whether they decode to its text."""
    small_batches(spark)
    bpe = ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = round_trip_documents(docs.select("doc_id", "source", "lang", "text"), bpe)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", dedup),
    ("near copies", near_copies),
    ("source mix", mix),
    ("byte-level BPE", encode),
]
#: SQL has no field, forest or merge queue.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a work table; what the stage needed on the way goes when it is written."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        with tables_of_run() as own:
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = kept(docs)
                dropped(spark, own[:-1])
    return docs
