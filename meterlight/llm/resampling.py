"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target's texts.

Texts become a table of positions: a row for each word, by ``posexplode``. An n-gram of order k is a word and the k - 1
words that a window's ``lead`` finds after it in the same document. N-grams are hashed to buckets, buckets are counted on
both sides, and a bucket's gain is the logarithm of its smoothed share of the target over its share of the documents. Gains
join the position table by bucket, a document's weight is their mean, and a Gumbel number made from its key turns the weights
into a draw without replacement: the highest sums win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import join_counted, kept, ranked, text_of

#: What parts words: ASCII that is no digit and no lower-case letter. A-Z is put in lower case before.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gains are thousandths of a natural logarithm, as whole numbers: sums don't depend on their order.
SCALE = 1000
#: Up to so many buckets their gains are broadcast (some 16 MB); more are joined by a shuffle, hot ones apart.
BROADCAST_BUCKETS = 1 << 20


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NO_WORD), lambda w: w != "")


def positions(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row for each word of each row: ``keep``, the place ``pos`` and the ``word``; one with nulls for a row without words."""
    return rows.select(*keep, F.posexplode_outer(word_list(text_of(text))).alias("pos", "word"))


def features(rows: DataFrame, keep: list[str], orders: int, buckets: int, text: str = "text") -> DataFrame:
    """``keep``, the ``bucket`` of each n-gram of 1 to ``orders`` words, and in ``word`` whether it is of order 1. Rows are told apart by the first of ``keep``."""
    at = positions(rows, keep, text)
    bucket = lambda gram: F.crc32(gram.cast("binary")) % buckets
    if orders == 1:
        return at.select(*keep, bucket(F.col("word")).alias("bucket"), F.col("word").isNotNull().alias("word"))
    following = W.partitionBy(keep[0]).orderBy("pos")
    at = at.select(*keep, "word", *(F.lead("word", k).over(following).alias(f"_{k}") for k in range(1, orders)))
    grams = [F.when(F.col(f"_{n}" if n else "word").isNotNull(), F.concat_ws(" ", "word", *(f"_{k}" for k in range(1, n + 1)))) for n in range(orders)]
    # a row without words keeps one row; of other rows, the orders that reach past the end go
    each = at.select(*keep, F.posexplode(F.array(*grams)).alias("n", "gram")).where("n = 0 or gram is not null")
    return each.select(*keep, bucket(F.col("gram")).alias("bucket"), ((F.col("n") == 0) & F.col("gram").isNotNull()).alias("word"))


def bucket_counts(rows: DataFrame, orders: int, buckets: int, text: str = "text") -> DataFrame:
    """How many features fall into each bucket; buckets without any are left out. At most ``buckets`` rows, as a work table."""
    own = rows.select(text) if orders == 1 else rows.select(F.monotonically_increasing_id().alias("_id"), text)
    found = features(own, [] if orders == 1 else ["_id"], orders, buckets, text)
    return kept(found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n")))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Of counts by bucket on both sides, the ``gain`` of each bucket of the documents, with their count ``n``. Every bucket counts once more than it was seen."""
    total, aim = (side.agg(F.sum("n")).first()[0] or 0 for side in (documents, target))
    t, s = F.coalesce(F.col("t"), F.lit(0)).cast("double"), F.col("n").cast("double")
    ratio = (t + 1) * F.lit(float(total + buckets)) / ((s + 1) * F.lit(float(aim + buckets)))
    return documents.join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", "n", F.floor(SCALE * F.log(ratio)).alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """A Gumbel number of the key, in thousandths, rounded down; a null key counts as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, orders: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its key, ``n_features``, ``n_words``, ``weight``, ``score``, and ``rank`` if it is drawn.

    Of the N rows with ``least_words`` words, ``floor(percent * N / 100)`` are drawn: those with the highest scores, of
    equal scores the smaller keys, null keys last. Null and empty texts have no features, weight 0 and are not drawn.
    Repeated rows have equal scores and follow each other in rank. Without target texts all shares of the target are alike.
    Empty documents give an empty result. Other columns of ``docs`` are not looked at: ``drawn_rows`` brings them back.
    """
    own = docs.select(F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    counts = bucket_counts(own, orders, buckets, "_text")
    gain = gains(counts, bucket_counts(target.select(F.col(target_text).alias("_text")), orders, buckets, "_text"), buckets)
    found = features(own, ["_id", "_key"], orders, buckets, "_text")
    if buckets <= BROADCAST_BUCKETS:
        weighed = found.join(F.broadcast(gain.select("bucket", "gain")), "bucket", "left")
    else:
        # a document's features of a bucket are one row before they move
        per = found.groupBy("_id", "_key", "bucket").agg(F.count("bucket").alias("times"), F.sum(F.col("word").cast("long")).alias("words"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        met = join_counted(per.where("bucket is not null"), gain, "bucket", "n", total)
        columns = ["_id", "_key", "bucket", "times", "words", "gain"]
        weighed = met.select(*columns).unionByName(per.where("bucket is null").withColumn("gain", F.lit(None).cast("long")).select(*columns))
    times, word = (F.lit(1), F.col("word").cast("long")) if buckets <= BROADCAST_BUCKETS else (F.col("times"), F.col("words"))
    sums = weighed.groupBy("_id", "_key").agg(
        F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), times)), F.lit(0)).cast("long").alias("n_features"),
        F.coalesce(F.sum(word), F.lit(0)).alias("n_words"), F.coalesce(F.sum(F.col("gain") * times), F.lit(0)).cast("long").alias("_sum"),
    )
    least = F.greatest("n_features", F.lit(1))
    weight = F.expr("(_sum - pmod(_sum, _least)) div _least")
    scored = sums.withColumn("_least", least.cast("long")).withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("_key"), seed))
    scored = kept(scored.select("_id", F.col("_key").alias(key), "n_features", "n_words", "weight", "score"))
    can = F.col("n_words") >= least_words
    n = scored.where(can).count()
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("_id")]
    drawn = ranked(scored.where(can), order, n, percent * n // 100, "rank")
    return drawn.unionByName(scored.where(~can).withColumn("rank", F.lit(None).cast("long"))).drop("_id")


def drawn_rows(docs: DataFrame, scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key was drawn, as they are."""
    return docs.join(scored.where("rank is not null").select(key).distinct(), key, "left_semi")
