"""Commits out of the text of ``git log --no-merges --numstat --date=unix --pretty=format:%x00%H%x09%ae%x09%cd``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMAT = "%x00%H%x09%ae%x09%cd"


def parse_log(logs: DataFrame, my_email: str = "", repo: str = "repo", log: str = "log") -> DataFrame:
    """``repo, hash, author, date, mine, files, added, deleted``, a row for each commit of each row's log.

    A line that begins with NUL starts a commit; each line of three fields after it is a file. Binary files have no
    counts. What stands before the first commit is dropped; a null log has none. A header that lacks fields leaves
    the author and date null.
    """
    pieces = F.split(F.concat(F.lit("\n"), F.col(log)), "\n\\x00")
    one = logs.select(F.col(repo).alias("repo"), F.explode(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(0)))).alias("piece"))
    rows = F.split("piece", "\r?\n")
    head, files = F.split(rows[0], "\t"), F.filter(F.transform(F.slice(rows, 2, F.size(rows)), lambda x: F.split(x, "\t", 3)), lambda x: F.size(x) == 3)
    one = one.select("repo", F.when(F.size(head) >= 3, head).alias("head"), head[0].alias("hash"), files.alias("files"))
    total = lambda k: F.aggregate("files", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[k].try_cast("bigint"), F.lit(0).cast("bigint")))
    return one.select(
        "repo", "hash", F.col("head")[1].alias("author"), F.timestamp_seconds(F.col("head")[2].try_cast("bigint")).alias("date"),
        (F.lit(my_email != "") & F.coalesce(F.col("head")[1] == my_email, F.lit(False))).alias("mine"), F.size("files").cast("bigint").alias("files"), total(0).alias("added"), total(1).alias("deleted"),
    )
