"""Which repository a working directory belongs to, by the folders above it, and whose repository it is."""

from __future__ import annotations

import configparser
import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.operators.rankings import clamped
from meterlight.operators.usage import cells, priced_sums, usd
from meterlight.plans.pricing import PriceTable

LOOKED_AT = "folder string, is_root boolean, email string"


def prefixes(cwds: DataFrame, cwd: str = "cwd") -> DataFrame:
    """``cwd, folder``: each directory with itself and every folder above it. A path has few."""
    parts = F.split(F.regexp_replace(cwd, "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return cwds.where(F.col(cwd).isNotNull() & (F.col(cwd) != "")).select(cwd).distinct().withColumn("folder", F.explode(above)).where("folder <> ''")


def _email(text: str) -> str:
    """``user.email`` of a repository's own settings, and nothing where they can't be read."""
    parser = configparser.ConfigParser(strict=False, allow_no_value=True, interpolation=None)
    try:
        parser.read_string("\n".join(line.strip() for line in text.splitlines()))
    except configparser.Error:
        return ""
    return (parser.get("user", "email", fallback="") or "").strip().strip('"')


def look_at(folders: DataFrame, scheme: str = "file://") -> DataFrame:
    """``folder, is_root, email`` of distinct folders: a folder with a ``.git`` in it, folder or file, is a work tree's root. One that can't be looked at is none."""

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, roots, emails = b.column(0).to_pylist(), [], []
            for name in names:
                is_root, email = False, ""
                try:
                    fs, path = pyarrow.fs.FileSystem.from_uri(f"{scheme}{name}" if "://" not in name else name)
                    is_root = fs.get_file_info(f"{path}/.git").type != pyarrow.fs.FileType.NotFound
                    config = f"{path}/.git/config"
                    if is_root and fs.get_file_info(config).type == pyarrow.fs.FileType.File:
                        with fs.open_input_stream(config) as f:
                            email = _email(f.read(1 << 20).decode("utf-8", "replace"))
                except (OSError, ValueError):
                    pass
                roots.append(is_root)
                emails.append(email)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(roots), pa.array(emails)], ["folder", "is_root", "email"])

    return folders.select("folder").distinct().mapInArrow(looked, LOOKED_AT)


def resolved(cwds: DataFrame, known: DataFrame) -> DataFrame:
    """``cwd, root, email``: the nearest folder at or above each directory that ``known`` (as ``look_at`` gives it) calls a root; directories without one are left out.

    ``known`` is the memory: what is in it isn't looked at again, see ``unknown_folders``.
    """
    met = prefixes(cwds).join(known.where("is_root").select("folder", "email"), "folder")
    best = F.max_by(F.struct(F.col("folder").alias("root"), "email"), F.length("folder"))
    return met.groupBy("cwd").agg(best.alias("r")).select("cwd", "r.root", "r.email")


def unknown_folders(cwds: DataFrame, known: DataFrame) -> DataFrame:
    """Folders that nobody has looked at yet."""
    return prefixes(cwds).select("folder").distinct().join(known.select("folder"), "folder", "left_anti")


def project_days(events: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """``project, cwd, day, usd, tokens``: spend by project and day, with the first directory that is named in the project's events."""
    named = events.where("cwd is not null and cwd <> ''").groupBy("project").agg(F.min_by("cwd", "ord").alias("cwd"))
    return priced_sums(cells(events), ["project", "day"], table).select("project", "day", "usd", "tokens").join(named, "project", "left").select("project", F.coalesce("cwd", F.lit("")).alias("cwd"), "day", "usd", "tokens")


def repository_days(days: DataFrame, roots: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """``repo, day, usd, tokens``: ``project_days`` by the root that their directory resolves to; projects that share one are one.

    Days of projects without a root are left out, and days before that of ``since``, as commits are asked for since then.
    """
    days = days if since is None else clamped(days, since)
    return days.join(roots.select("cwd", F.col("root").alias("repo")), "cwd").groupBy("repo", "day").agg(usd(F.sum("usd")).alias("usd"), F.sum("tokens").alias("tokens"))


def skipped(days: DataFrame, roots: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """How many of ``project_days`` have no repository; days before ``since`` aren't skipped, they don't count."""
    days = days if since is None else clamped(days, since)
    return days.join(roots.select("cwd"), "cwd", "left_anti").agg(F.count("*").alias("skipped"))
