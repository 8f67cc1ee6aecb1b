"""Scalar functions for display, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_usd(v: Column) -> Column:
    """$1,234.56, rounded half up, a minus before the sign."""
    cents = F.floor(F.abs(v) * 100 + 0.5).cast("bigint")
    whole = F.format_number(F.expr("0").cast("bigint") + F.floor(cents / 100).cast("bigint"), 0)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def fmt_tokens(n: Column) -> Column:
    """950, 1K, 1.2M, 1.23B."""
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.2fB", n / F.lit(1e9)))
        .when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6)))
        .when(n >= 1_000, F.format_string("%.0fK", n / F.lit(1e3)))
        .otherwise(n.cast("string"))
    )


def fmt_tokens_short(n: Column) -> Column:
    """900, 1.2k, 2.3M."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.format_string("%.1fk", n / F.lit(1000.0))).otherwise(F.format_string("%.1fM", n / F.lit(1e6)))


def fmt_duration(seconds: Column) -> Column:
    """1h02m or 5m, to the nearest minute."""
    minutes = F.floor(seconds / 60 + 0.5).cast("bigint")
    return F.when(minutes >= 60, F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60)).otherwise(F.format_string("%dm", minutes))


def short_project(name: Column) -> Column:
    """A project's directory name: a leading dash doesn't count, then the first four parts go; names of up to four stay, and of none there is (unknown)."""
    parts = F.split(F.regexp_replace(name, "^-", ""), "-")
    tail = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts), F.lit(1))), "-")
    return F.when(name == "", "(unknown)").when((F.size(parts) <= 4) | (tail == ""), name).otherwise(tail)


def short_project_tail(name: Column) -> Column:
    """As the full view has it: what stands after the last slash, else ``short_project``."""
    return F.when(name.contains("/"), F.substring_index(name, "/", -1)).otherwise(short_project(name))


def short_project_name(name: Column) -> Column:
    """As notifications have it: parts that are empty don't count, and a leading dash is dropped where the name stays."""
    bare = F.regexp_replace(name, "^-", "")
    parts = F.filter(F.split(bare, "-"), lambda x: x != "")
    return F.when(name == "", "(unknown)").when(F.size(parts) <= 4, bare).otherwise(F.array_join(F.slice(parts, 5, F.greatest(F.size(parts), F.lit(1))), "-"))


def _by_family(model: Column, names: dict[str, str]) -> Column:
    out = model
    for part, name in reversed(names.items()):
        out = F.when(model.contains(part), name).otherwise(out)
    return out


def short_model(model: Column) -> Column:
    """Opus, Sonnet or Haiku; others stay."""
    return _by_family(model, {"opus": "Opus", "sonnet": "Sonnet", "haiku": "Haiku"})


def short_model_tag(model: Column) -> Column:
    return _by_family(model, {"opus": "opus", "sonnet": "sonnet", "haiku": "haiku"})


def trimmed_right(s: Column, n: int) -> Column:
    """At most ``n`` bytes with an ellipsis counted as one; cut between bytes, so that part of a character stays as a replacement mark."""
    return F.when(F.octet_length(s) > n, F.concat(F.decode(F.substring(F.encode(s, "UTF-8"), 1, n - 1), "UTF-8"), F.lit("…"))).otherwise(s)


def short_day(day: Column) -> Column:
    """Apr 26; what isn't a day stays."""
    return F.coalesce(F.date_format(F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))), "MMM d"), day)


def truncated(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n - 1)), F.lit("…"))).otherwise(s)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def fixed(v: Column, digits: int) -> Column:
    """So many digits, by the exact value of the double, a half to the even one."""
    return F.replace(F.format_number(v, digits), F.lit(","), F.lit(""))


def ratio_text(v: Column) -> Column:
    """Four digits, and nothing if there is no ratio."""
    return F.when(v > 0, F.format_string("%.4f", v)).otherwise("")


def encoded_path(path: Column) -> Column:
    """A working directory as a project's name."""
    return F.translate(path, "/.", "--")


def decoded_path(segment: Column) -> Column:
    """Percent-decoded, a plus left as it is; what can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def usd_compact(v: Column) -> Column:
    """$12.34, $123.4 and $1234."""
    return F.when(v >= 1000, F.concat(F.lit("$"), F.bround(v, 0).cast("bigint"))).when(v >= 100, F.format_string("$%.1f", v)).otherwise(F.format_string("$%.2f", v))


def usd_whole(v: Column) -> Column:
    """To the nearest dollar, a half to the even one."""
    return F.concat(F.lit("$"), F.bround(v, 0).cast("bigint"))


def short_id(s: Column) -> Column:
    return F.left(s, F.lit(8))


def joined_cycle(cycle: Column) -> Column:
    """A loop's calls, of the form name:target, as ``name target → ...``, targets cut to 24 characters."""

    def one(c: Column) -> Column:
        at = F.instr(c, ":")
        name, target = F.when(at > 0, F.left(c, at - 1)).otherwise(c), F.when(at > 0, F.substr(c, at + 1)).otherwise("")
        return F.when(target != "", F.concat(name, F.lit(" "), truncated(target, 24))).otherwise(name)

    return F.array_join(F.transform(cycle, one), " → ")


def until(end: Column, now: Column) -> Column:
    """What is left before ``end``: 5m, 2h07m, and the weekday if that is over or a day away."""
    s = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))
    minutes = F.floor(s / 60)
    return (
        F.when((s <= 0) | (s >= 86_400), F.date_format(end, "EEE"))
        .when(s < 3600, F.format_string("%dm", minutes))
        .otherwise(F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60))
    )


def mode_percent(part: Column, whole: Column) -> Column:
    """A whole percentage, and a dot for none."""
    return F.when((part > 0) & (whole > 0), F.concat(F.floor(100.0 * part / whole + 0.5).cast("string"), F.lit("%"))).otherwise("·")


def cells_of_ten(pct: Column) -> Column:
    """How many of a bar's ten cells are full."""
    return F.least(F.lit(10), F.greatest(F.lit(0), F.floor(pct / 10 + 0.5))).cast("int")


def digest_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a pipe: the key of what is kept about a file."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
