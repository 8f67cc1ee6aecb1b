"""The registered queries as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from meterlight.operators.reports import COMMAND_LANGUAGES, FILE_LANGUAGES, PHASES
from meterlight.operators.sessions import INJECTED
from meterlight.plans.pricing import ALIASES, LUNA, PRICES
from meterlight.sources.tables import COMMANDS, MODES, VERBS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PRICE = ", ".join(f"('{name}', {', '.join(f'{r}::double' for r in rates)})" for name, rates in (PRICES | LUNA).items())
_ALIAS = "CASE {m} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE {m} END"
_TOK = ("tok_in", "tok_out", "tok_cw", "tok_cr")


def _priced(rows: str) -> str:
    """The relation with priced_as and rates: by own name, alias, and both without the long-context mark."""
    bare = "regexp_replace(t.model, '\\[1m\\]$', '')"
    tries = ["t.model", _ALIAS.format(m="t.model"), bare, _ALIAS.format(m=bare)]
    joins = " ".join(f"LEFT JOIN price p{k} ON p{k}.name = {t}" for k, t in enumerate(tries))
    pick = lambda c, n: f"coalesce({', '.join(f'p{k}.{c}' for k in range(4))}) AS {n}"
    return f"(SELECT t.*, {pick('name', 'priced_as')}, {', '.join(pick(c, f'rate_{c}') for c in ('r_in', 'r_out', 'r_cw', 'r_cr'))} FROM {rows} t {joins})".replace("rate_r_", "rate_")


def _part(t: str) -> str:
    return f"coalesce({t} / 1e6 * rate_{t[-2:] if t != 'tok_out' else 'out'}, 0)"


_COST = " + ".join(map(_part, _TOK))
_NEW = " + ".join(map(_part, _TOK[:3]))

_CASE = lambda col, cases, other: f"CASE {col} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in cases.items())} ELSE '{other}' END"
_VENDOR = _CASE("event_type", {"purchase": "grok", "signup": "codex"}, "claude")
_MODEL = _CASE("event_type", {"view": "claude-opus-4-7", "click": "claude-sonnet-4-6", "signup": "codex-auto-review", "purchase": "grok-4.6-build"}, "mystery-model")
_TOOL = _CASE("event_type", {"view": "Read", "click": "Edit", "signup": "Skill", "purchase": "Write"}, "Bash")
_K = "cast(json_extract_string(props, '$.k') AS bigint)"
_SUMS = ", ".join(f"cast(sum({t}) AS bigint) AS {t}" for t in _TOK) + ", " + ", ".join(f"cast(sum(CASE WHEN costed THEN 0 ELSE {t} END) AS bigint) AS p_{t}" for t in _TOK)
_SUMS += ", coalesce(cast(sum(CASE WHEN costed THEN cost_usd END) AS double), 0) AS costed_usd"

BASE = f"""WITH ue AS (
  SELECT event_id AS ord, cast(ts AS timestamp) AS ts, user_id AS session_id, 'proj-' || (user_id % 12) AS project, {_VENDOR} AS vendor,
    {_VENDOR} || CASE WHEN user_id % 2 = 0 THEN '/work' ELSE '/personal' END AS source, {_MODEL} AS model, user_id % 3 = 0 AS is_sub,
    {_K} * 1000 AS tok_in, {_K} * 100 AS tok_out, event_id % 7 * 500 AS tok_cw, event_id % 11 * 2000 AS tok_cr,
    {_VENDOR} = 'grok' AS costed, cast(value AS decimal(18,4)) AS cost_usd, event_id - CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END AS message_id,
    CASE WHEN event_id % 13 <> 0 THEN 1 END AS request_id, event_id % 4 <> 0 AS has_usage FROM events),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY ord) AS rn FROM ue) WHERE rn = 1 OR message_id IS NULL OR request_id IS NULL),
price(name, r_in, r_out, r_cw, r_cr) AS (VALUES {_PRICE}),
cells AS (SELECT cast(ts AS date) AS day, project, source, vendor, model, is_sub, {_SUMS}, count(*) AS events FROM dd GROUP BY ALL),
hours AS (SELECT cast(ts AS date) AS day, cast(hour(ts) AS int) AS hour, vendor, model, {_SUMS} FROM dd GROUP BY ALL),
tc AS (SELECT user_id AS session_id, cast(ts AS timestamp) AS ts, event_id AS ord, {_TOOL} AS name, '/f' || ({_K} % 10) AS target, event_type = 'error' AS is_err, event_id % 4 = 0 AS is_sub FROM events),
pr AS (SELECT conv_id AS session_id, turn AS ord, {_list(MODES)}[cast((conv_id + turn) % 6 + 1 AS int)] AS mode, ['/Users/jane/src', '/workspace', '/tmp/x', ''][cast(conv_id % 4 + 1 AS int)] AS cwd,
    CASE WHEN conv_id % 2 = 0 THEN 'cli' ELSE 'sdk' END AS entrypoint, 'proj-' || (conv_id % 9) AS project, text FROM conversations WHERE role = 'user'),
cm AS (SELECT o_custkey % 20 AS repo, cast(date '2024-01-01' + cast(o_orderkey % 30 AS int) AS date) AS day, o_orderpriority IN ('1-URGENT', '2-HIGH') AS mine, o_orderkey % 97 AS added, o_orderkey % 41 AS deleted FROM orders),
ag AS (SELECT p_partkey AS agent_id, {_list(VERBS)}[cast(p_partkey % {len(VERBS)} + 1 AS int)] || ' ' || p_name AS description, {_list(COMMANDS)}[cast(p_size % {len(COMMANDS)} + 1 AS int)] AS command,
    '/src/a.' || ['go', 'rs', 'py', 'ts', 'md'][cast(p_partkey % 5 + 1 AS int)] AS path, ['claude-opus-4-7', 'claude-sonnet-4-6', 'claude-haiku-4-5', 'fable', 'mystery'][cast(p_partkey % 5 + 1 AS int)] AS model,
    'proj-' || (p_partkey % 7) AS project, p_partkey % 3 AS depth, p_partkey % 50 * 1000 AS tok_in, p_partkey % 20 * 100 AS tok_out, p_partkey % 5 * 10 AS tok_cw, p_partkey % 9 * 500 AS tok_cr FROM part),
rp AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'codex' ELSE 'grok' END AS vendor, CASE WHEN user_id % 2 = 0 THEN 300 ELSE 10080 END AS window_minutes, value AS pct, cast(ts AS timestamp) AS observed,
    cast(ts AS timestamp) + CASE WHEN user_id % 2 = 0 THEN 300 ELSE 10080 END * interval 1 minute AS resets_at, event_id AS ord FROM events),
tn AS (SELECT *, {_COST} AS usd, {_NEW} AS new_usd FROM {_priced("dd")})
"""
_DAY, _MONTH = "day = date '2024-01-24'", "date_trunc('month', day) = date '2024-01-01'"
_WEEK = "day >= date '2024-01-22' AND day < date '2024-01-29'"
_NOW = "timestamp '2024-01-24 12:00:00'"


def _sums(rows: str, *keys: str) -> str:
    by = ", ".join(dict.fromkeys([*keys, "model"]))
    inner = f"(SELECT {by}, {', '.join(f'sum({t}) AS all_{t}' for t in _TOK)}, {', '.join(f'sum(p_{t}) AS {t}' for t in _TOK)}, sum(costed_usd) AS costed_usd FROM {rows} GROUP BY {by})"
    out = f"SELECT {', '.join(keys) + ', ' if keys else ''}round(sum({_COST} + costed_usd), 8) AS usd, cast(sum({' + '.join(f'all_{t}' for t in _TOK)}) AS bigint) AS tokens, {', '.join(f'cast(sum(all_{t}) AS bigint) AS {t}' for t in _TOK)} FROM {_priced(inner)}"
    return out + (f" GROUP BY {', '.join(keys)}" if keys else "")


def _where(rows: str, cond: str) -> str:
    return f"(SELECT * FROM {rows} WHERE {cond})"


def _cut(body: str, *columns: str) -> str:
    return f"SELECT {', '.join(columns)} FROM ({body})"


def _main_sub(cond: str) -> str:
    side = lambda c, sub, kind: f"cast(coalesce(sum(CASE WHEN is_sub = {sub} THEN {c} ELSE 0 END), 0) AS {kind})"
    return (
        f"SELECT project, round({side('usd', 'false', 'double')}, 8) AS main_usd, round({side('usd', 'true', 'double')}, 8) AS sub_usd, {side('tokens', 'false', 'bigint')} AS main_tokens, {side('tokens', 'true', 'bigint')} AS sub_tokens "
        f"FROM ({_sums(_where('cells', cond), 'project', 'is_sub')}) GROUP BY project"
    )


_DAILY = f"(SELECT c.day, cast(coalesce(usd, 0) AS double) AS usd, cast(coalesce(tokens, 0) AS bigint) AS tokens FROM (SELECT cast(date '2024-01-24' - cast(i AS int) AS date) AS day FROM range(30) r(i)) c LEFT JOIN ({_sums('cells', 'day')}) s ON s.day = c.day)"


def _grouped(only: str | None = None) -> str:
    rows = f"({_sums(_where('cells', _MONTH), 'model', 'vendor', 'source')})"
    parts = [f"SELECT '{m}' AS mode, {c} AS name, round(sum(usd), 8) AS usd, cast(sum(tokens) AS bigint) AS tokens FROM {rows} GROUP BY 2" for m, c in (("model", "model"), ("vendor", "vendor"), ("source", "source"), ("total", "'total'")) if only in (None, m)]
    body = " UNION ALL ".join(parts)
    return body if only is None else f"SELECT name, usd, tokens FROM ({body}) WHERE name IS NOT NULL"


def _coverage(keys: str, rows: str) -> str:
    return f"SELECT {keys}, count(*) AS turns, count(*) FILTER (has_usage) AS with_usage, round(count(*) FILTER (has_usage) / count(*), 8) AS fraction, count(*) FILTER (has_usage) / count(*) < 0.95 AS partial FROM {rows} WHERE costed GROUP BY {keys}"


_RD = f"""(SELECT path, ord, declared, CASE WHEN ord % 7 = 0 AND before IS NOT NULL THEN before ELSE raw END AS total_in FROM
  (SELECT *, lag(raw) OVER (PARTITION BY path ORDER BY ord) AS before FROM (SELECT user_id AS path, event_id AS ord, CASE WHEN event_type = 'signup' THEN 'model-' || (event_id % 3) END AS declared,
   cast(sum({_K}) OVER (PARTITION BY user_id ORDER BY event_id) % 2000 AS bigint) AS raw FROM events)))"""

_REMINDERS = "regexp_replace(t, '(?s)<system-reminder>.*?(</system-reminder>|\\z)', '', 'g')"
_PROSE = f"trim({_REMINDERS})"
_TAGGED = " OR ".join(f"starts_with(p, '{t}')" for t in INJECTED)

# Findings, each session_id, category, count, usd.
_DUP_READS = "(SELECT session_id, target, count(*) AS reads FROM tc WHERE name = 'Read' GROUP BY ALL HAVING count(*) >= 2)"
_FAILED = "SELECT f.session_id, 'waste_failed' AS category, cast(n AS bigint) AS count, round(coalesce(mean, 0) * n, 8) AS usd FROM (SELECT session_id, count(*) AS n FROM tc WHERE is_err GROUP BY 1) f LEFT JOIN (SELECT session_id, avg(new_usd) AS mean FROM tn GROUP BY 1) m USING (session_id)"
_READS = f"SELECT session_id, 'waste_reads' AS category, cast(sum(reads - 1) AS bigint) AS count, cast(0 AS double) AS usd FROM {_DUP_READS} GROUP BY 1"


def _big(tiny: int) -> str:
    return f"SELECT session_id, 'waste_context' AS category, count(*) AS count, round(sum(new_usd), 8) AS usd FROM tn WHERE tok_in + tok_cw >= 50000 AND tok_out <= {tiny} GROUP BY 1"


_ABUSE = """(SELECT session_id, name, target, count(*) AS count, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, name || target, name) AS place FROM tc GROUP BY session_id, name, target HAVING count(*) >= 3)"""
_ABUSE_ROWS = f"SELECT session_id, place, name, target, count FROM {_ABUSE} WHERE place <= 8 UNION ALL SELECT session_id, 9, '', '', count(*) FROM {_ABUSE} WHERE place > 8 GROUP BY 1"
_SKILL = "SELECT session_id, 'skill' AS category, count(DISTINCT target) AS count, cast(0 AS double) AS usd FROM tc WHERE name = 'Skill' GROUP BY 1 HAVING count(DISTINCT target) > 3"
_LOOPS = """(SELECT session_id, is_sub, reps, w, start FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, is_sub ORDER BY reps * w DESC, w, start) AS rk FROM (
    SELECT session_id, is_sub, cast(i AS int) AS start, w, cast(1 + (stop - i) // w AS int) AS reps FROM (
      SELECT *, min(CASE WHEN NOT same THEN i END) OVER (PARTITION BY session_id, is_sub, w ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM (
        SELECT session_id, is_sub, i, cast(w AS int) AS w, coalesce(tok = list_extract([lead1, lead2, lead3, lead4], w), false) AS same FROM (
          SELECT session_id, is_sub, tok, row_number() OVER s - 1 AS i, lead(tok, 1) OVER s AS lead1, lead(tok, 2) OVER s AS lead2, lead(tok, 3) OVER s AS lead3, lead(tok, 4) OVER s AS lead4
          FROM (SELECT *, name || ':' || target AS tok FROM tc) WINDOW s AS (PARTITION BY session_id, is_sub ORDER BY ts, ord)), range(1, 5) r(w)))
    WHERE 1 + (stop - i) // w >= 3)) WHERE rk = 1)"""
_BOUNDS = "(SELECT session_id, min(ts) AS start, max(ts) AS \"end\", arg_min(project, CASE WHEN NOT is_sub THEN ord END) AS project FROM ue GROUP BY 1)"
_SPRAWL = f"""SELECT session_id, 'sprawl' AS category, cast(coalesce(prompts, 0) AS bigint) AS count, cast(0 AS double) AS usd FROM {_BOUNDS} LEFT JOIN (SELECT session_id, count(*) AS prompts FROM pr GROUP BY 1) USING (session_id)
  WHERE coalesce(prompts, 0) >= 60 OR (epoch("end") - epoch(start)) // 1 / 3600.0 >= 4"""
_TOTALS = "(SELECT session_id, " + ", ".join(f"cast(sum({t}) AS bigint) AS {t}" for t in _TOK) + ", max(tok_in + tok_cw + tok_cr) AS peak_context, count(*) AS turns FROM dd GROUP BY 1)"
_DOMINANT = "(SELECT session_id, model, n AS turns FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, model) AS r FROM (SELECT session_id, model, count(*) AS n FROM dd GROUP BY 1, 2)) WHERE r = 1)"


def _routing(tokens: int, tools: int) -> str:
    return f"SELECT t.session_id, 'routing' AS category, cast(1 AS bigint) AS count, cast(0 AS double) AS usd FROM {_TOTALS} t JOIN {_DOMINANT} d USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS calls FROM tc GROUP BY 1) c USING (session_id) WHERE contains(d.model, 'opus') AND tok_in + tok_out < {tokens} AND coalesce(calls, 0) <= {tools}"


_WINDOW = "CASE WHEN contains(d.model, '[1m]') OR peak_context > 200000 THEN 1000000 ELSE 200000 END"
_CONTEXT = f"(SELECT t.session_id, d.model, peak_context, cast({_WINDOW} AS bigint) AS \"window\", round(least(100.0, 100.0 * peak_context / {_WINDOW}), 8) AS context_pct FROM {_TOTALS} t JOIN {_DOMINANT} d USING (session_id))"


def _overload(pct: float) -> str:
    return f"SELECT session_id, 'context' AS category, cast(1 AS bigint) AS count, cast(0 AS double) AS usd FROM {_CONTEXT} WHERE context_pct >= {pct}"


_FINDINGS = " UNION ALL ".join([
    _FAILED, _READS, _big(100), f"SELECT session_id, 'abuse', cast(count AS bigint), cast(0 AS double) FROM ({_ABUSE_ROWS})", _SKILL, f"SELECT session_id, 'loop', cast(reps AS bigint), cast(0 AS double) FROM {_LOOPS}",
    _SPRAWL, _routing(20000, 5), _overload(80),
])
_REPORTS = f"""(SELECT s.session_id, b.project, round(s.usd, 8) AS usd, round(coalesce(waste, 0), 8) AS waste_usd, coalesce(n, 0) AS findings, round(coalesce(waste, 0) + coalesce(n, 0), 8) AS score
  FROM (SELECT session_id, sum(usd) AS usd FROM tn GROUP BY 1) s LEFT JOIN (SELECT session_id, sum(usd) AS waste, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1) f USING (session_id) JOIN {_BOUNDS} b USING (session_id))"""

_CONTAINER = "cwd <> '' AND NOT (starts_with(cwd, '/Users/') OR cwd IN ('/tmp', '/private', '/var/folders') OR starts_with(cwd, '/tmp/') OR starts_with(cwd, '/private/') OR starts_with(cwd, '/var/folders/'))"
_SS = f"(SELECT *, {_CONTAINER} AS container FROM (SELECT session_id, arg_min(project, ord) AS project, coalesce(arg_min(CASE WHEN cwd <> '' THEN cwd END, CASE WHEN cwd <> '' THEN ord END), '') AS cwd, arg_min(entrypoint, ord) AS entrypoint, count(*) AS turns, " + ", ".join(f"count(*) FILTER (mode = '{m}') AS \"{m}\"" for m in MODES) + " FROM pr WHERE mode <> '' GROUP BY 1))"


def _rules(col: str, rules, flags: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{flags}\\b{p}\\b') THEN '{n}'" for n, p in rules) + f" ELSE {other} END"


_PHASE = _rules("description", PHASES, "(?i)", "'other'")
_ENDING = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_VOTES = f"""(SELECT agent_id, lang, votes FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY votes DESC, lang) AS r FROM (SELECT agent_id, lang, cast(sum(v) AS bigint) AS votes FROM (
  SELECT agent_id, {_rules('command', COMMAND_LANGUAGES, '', 'NULL')} AS lang, 2 AS v FROM ag UNION ALL SELECT agent_id, {_CASE(_ENDING, FILE_LANGUAGES, '')}, 1 FROM ag) WHERE lang IS NOT NULL AND lang <> '' GROUP BY 1, 2)) WHERE r = 1)"""
_TIER = "CASE WHEN contains(model, 'fable') THEN 'fable-5' WHEN contains(model, 'opus') THEN 'opus' WHEN contains(model, 'sonnet') THEN 'sonnet' WHEN contains(model, 'haiku') THEN 'haiku' ELSE 'other' END"
_AGENTS = f"(SELECT a.agent_id, project, depth, {_PHASE} AS phase, coalesce(lang, 'unknown') AS lang, {_TIER} AS tier, {_COST} AS usd FROM {_priced('ag')} a LEFT JOIN {_VOTES} v USING (agent_id) WHERE {_COST} <> 0)"


def _by(*keys: str) -> str:
    return f"SELECT {', '.join(keys)}, round(sum(usd), 8) AS usd, count(*) AS count FROM {_AGENTS} GROUP BY {', '.join(keys)}"


_BUCKET = {"day": "strftime({d}, '%Y-%m-%d')", "month": "strftime({d}, '%Y-%m')", "week": "format('{{:04d}}-W{{:02d}}', isoyear({d}), week({d}))"}


def _roi(kind: str, only: str = "true", since: str = "true") -> str:
    b = _BUCKET[kind].format(d="day")
    ratio = lambda n: f"round(CASE WHEN coalesce({n}, 0) > 0 THEN coalesce(usd, 0) / {n} ELSE 0 END, 8)"
    return f"""SELECT repo, bucket, round(coalesce(usd, 0), 8) AS usd, coalesce(tokens, 0) AS tokens, coalesce(commits, 0) AS commits, coalesce(my_commits, 0) AS my_commits, coalesce(lines, 0) AS lines, coalesce(my_lines, 0) AS my_lines,
      {ratio('my_commits')} AS usd_per_commit, {ratio('my_lines')} AS usd_per_line
    FROM (SELECT cast(regexp_extract(project, '(\\d+)$', 1) AS bigint) AS repo, {b} AS bucket, sum(usd) AS usd, cast(sum(tokens) AS bigint) AS tokens FROM ({_sums('cells', 'project', 'day')}) WHERE {since} GROUP BY ALL HAVING {only})
    FULL OUTER JOIN (SELECT repo, {b} AS bucket, count(*) AS commits, count(*) FILTER (mine) AS my_commits, cast(sum(added + deleted) AS bigint) AS lines, cast(sum(CASE WHEN mine THEN added + deleted ELSE 0 END) AS bigint) AS my_lines FROM cm WHERE {only} AND {since} GROUP BY 1, 2) USING (repo, bucket)"""


_PLANS = f"""(SELECT vendor, window_minutes, CASE WHEN window_minutes < 1440 THEN (window_minutes // 60) || 'h' WHEN window_minutes = 1440 THEN '24h' ELSE (window_minutes // 1440) || 'd' END AS label, pct, observed, resets_at, resets_at < {_NOW} AS stale
  FROM (SELECT *, row_number() OVER (PARTITION BY vendor, window_minutes ORDER BY observed DESC, ord) AS r FROM rp) WHERE r = 1)"""


def _active(now: str) -> str:
    paid = f"CASE WHEN costed THEN cast(cost_usd AS double) ELSE {_COST} END"
    context = "CASE WHEN NOT is_sub THEN tok_in + tok_cw + tok_cr END"
    return f"""(SELECT session_id, count(*) FILTER (NOT is_sub) AS turns, round(sum({paid}), 8) AS usd, round(coalesce(sum(CASE WHEN ts >= {now} - interval 5 minute THEN {paid} END), 0), 8) AS usd_5m,
      round(coalesce(sum(CASE WHEN costed THEN 0 ELSE {_part('tok_cw')} END), 0), 8) AS cache_usd, coalesce(arg_max({context}, CASE WHEN NOT is_sub THEN (ts, ord) END), 0) AS context, coalesce(max({context}), 0) AS peak, max(ts) AS "last"
    FROM {_priced(f"(SELECT * FROM ue WHERE ts <= {now})")} GROUP BY 1 HAVING max(ts) >= {now} - interval 1440 minute)"""


def _warn(now: str) -> str:
    return f"(SELECT session_id, least(1.0, context / CASE WHEN peak > 200000 THEN 1000000 ELSE 200000 END) > 0.1 AS context_high, usd_5m > 5 AS cost_high, cache_usd > 0.01 AS cache_high FROM {_active(now)})"


def _on(now: str) -> str:
    return f"(SELECT session_id, 'context' AS condition FROM {_warn(now)} WHERE context_high UNION ALL SELECT session_id, 'cache' FROM {_warn(now)} WHERE cache_high)"


_MONEY = "floor(value * 1000) / 8.0"
_N = "cast(pow(10, event_id % 11) AS bigint) * 4"

_BODIES: dict[str, str] = {
    "full_snapshot_flagship": _sums("(SELECT 'day' AS scope, * FROM cells WHERE " + _DAY + " UNION ALL SELECT 'week', * FROM cells WHERE " + _WEEK + " UNION ALL SELECT 'month', * FROM cells WHERE " + _MONTH + ")", "scope", "source", "vendor", "model"),
    "dedupe_first_seen": "SELECT ord, session_id, model, is_sub, tok_in FROM dd",
    "dupes_count": "SELECT count(*) - count(DISTINCT (message_id, request_id)) AS dupes FROM ue WHERE message_id IS NOT NULL AND request_id IS NOT NULL",
    "usage_cells": f"SELECT day, project, source, vendor, model, is_sub, {', '.join(_TOK)}, round(costed_usd, 8) AS costed_usd, events FROM cells",
    "unknown_models": f"SELECT count(DISTINCT message_id) AS unknown FROM {_priced('(SELECT * FROM dd WHERE NOT costed)')} WHERE priced_as IS NULL",
    "coverage_month": _coverage("vendor", "(SELECT * FROM dd WHERE date_trunc('month', ts) = date '2024-01-01')"),
    "coverage_daily": _coverage("day, vendor", "(SELECT *, cast(ts AS date) AS day FROM dd)"),
    "snapshot_day_series": _sums(_where("cells", _DAY), "source", "vendor", "model"),
    "snapshot_week_series": _sums(_where("cells", _WEEK), "source", "vendor", "model"),
    "snapshot_month_series": _sums(_where("cells", _MONTH), "source", "vendor", "model"),
    "project_main_sub_day": _main_sub(_DAY),
    "project_main_sub_month": _main_sub(_MONTH),
    "daily_30": f"SELECT * FROM {_DAILY}",
    "daily_by_model": _cut(_sums("cells", "day", "model"), "day", "model", "usd", "tokens"),
    "hourly_by_model": _cut(_sums(_where("hours", "day > date '2023-12-25' AND day <= date '2024-01-24'"), "hour", "model"), "hour", "model", "usd", "tokens"),
    "today_hourly": f"SELECT h.hour, coalesce(usd, 0) AS usd, coalesce(tokens, 0) AS tokens FROM (SELECT cast(i AS int) AS hour FROM range(24) r(i)) h LEFT JOIN ({_sums(_where('hours', _DAY), 'hour')}) s ON s.hour = h.hour",
    "project_daily": _cut(_sums("cells", "project", "day"), "project", "day", "usd", "tokens"),
    **{f"group_{m}": _grouped(m) for m in ("model", "vendor", "source", "total")},
    "grouping_sets_all": f"SELECT * FROM ({_grouped()}) WHERE name IS NOT NULL",
    "group_coverage": f"SELECT model, coalesce(min(fraction), 1.0) AS fraction FROM (SELECT DISTINCT model, vendor FROM cells WHERE {_MONTH}) LEFT JOIN ({_coverage('vendor', 'dd')}) USING (vendor) GROUP BY model",
    "series_share": f"SELECT source, vendor, model, usd, round(CASE WHEN sum(usd) OVER () = 0 THEN 0 ELSE usd / sum(usd) OVER () END, 8) AS share FROM ({_sums(_where('cells', _MONTH), 'source', 'vendor', 'model')})",
    "breakdown_topk": f"SELECT name, usd, cast(rank AS int) AS rank, overflow FROM (SELECT project AS name, usd, row_number() OVER (ORDER BY usd DESC, project) AS rank, greatest(count(*) OVER () - 5, 0) AS overflow FROM ({_sums(_where('cells', _MONTH), 'project')}) WHERE usd > 0) WHERE rank <= 5",
    "palette_order": f"WITH m AS (SELECT model, usd FROM ({_sums(_where('cells', _WEEK), 'model')}) WHERE usd > 0) SELECT model, cast(row_number() OVER (ORDER BY usd DESC, model) AS int) AS place FROM m UNION ALL SELECT model, cast((SELECT count(*) FROM m) + row_number() OVER (ORDER BY model) AS int) FROM (SELECT DISTINCT model FROM cells WHERE model NOT IN (SELECT model FROM m))",
    "sparkline_levels": f"SELECT day, cast(least(8, greatest(0, floor(usd / greatest(max(usd) OVER (), 0.0001) * 8))) AS int) AS level FROM {_DAILY}",
    "price_resolution": f"SELECT model, coalesce(priced_as, '') AS priced_as, {', '.join(f'coalesce(rate_{r}, 0) AS rate_{r}' for r in ('in', 'out', 'cw', 'cr'))} FROM {_priced("(SELECT DISTINCT model || CASE WHEN ord % 2 = 0 THEN '[1m]' ELSE '' END AS model FROM ue)")}",
    "cost_components": f"SELECT model, {', '.join(f'round({_part(t)}, 8) AS {t[4:]}_usd' for t in _TOK)} FROM {_priced('(SELECT model, ' + ', '.join(f'sum(p_{t}) AS {t}' for t in _TOK) + ' FROM cells GROUP BY model)')}",
    "parse_usage_json": f"SELECT ord, project, model, is_sub, {', '.join(_TOK)} FROM ue",
    "codex_deltas": f"""SELECT path, ord, CASE WHEN before IS NULL THEN total_in ELSE total_in - before END AS d_total_in, CASE WHEN before IS NULL THEN total_in * 2 ELSE (total_in - before) * 2 END AS d_total_out
      FROM (SELECT *, lag(total_in) OVER (PARTITION BY path ORDER BY ord) AS before FROM {_RD}) WHERE before IS NULL OR total_in > before""",
    "codex_model_in_effect": f"SELECT path, ord, coalesce(last_value(declared IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'gpt-5.6-sol') AS model FROM {_RD}",
    "token_normalise": "SELECT ord, greatest(tok_in - tok_cr, 0) AS tok_in, tok_cr, cast(0 AS bigint) AS tok_cw FROM ue",
    "ticks_to_usd": "SELECT event_id, round(floor(value * 1000000) / 1e9, 9) AS usd FROM events",
    "civil_day_hour": "SELECT ord, cast(ts AS date) AS day, cast(hour(ts) AS int) AS hour FROM ue",
    "session_tokens_peak": f"SELECT * FROM {_TOTALS}",
    "session_bounds": f"SELECT session_id, start, \"end\", coalesce(project, '') AS project FROM {_BOUNDS}",
    "session_modes": "SELECT session_id, mode, count(*) AS turns FROM pr GROUP BY 1, 2",
    "mode_transitions": 'SELECT session_id, ord, "from", "to" FROM (SELECT session_id, ord, coalesce(lag(mode) OVER (PARTITION BY session_id ORDER BY ord), \'\') AS "from", mode AS "to" FROM pr) WHERE "from" <> "to"',
    "mode_chains": """SELECT session_id, string_agg(mode || CASE WHEN mode = 'bypassPermissions' THEN '(!)' ELSE '' END, ' → ' ORDER BY ord) AS chain FROM (SELECT *, coalesce(lag(mode) OVER (PARTITION BY session_id ORDER BY ord), '') AS f FROM pr) WHERE f <> mode GROUP BY 1""",
    "prompt_filter": f"""SELECT session_id, ord, cast(length(p) AS int) AS chars, md5(p) AS md5 FROM (SELECT session_id, ord, {_PROSE} AS p FROM (SELECT session_id, ord, CASE ord % 4 WHEN 1 THEN '<system-reminder>x' || chr(10) || 'y</system-reminder>' || text
      WHEN 2 THEN '<command-name>' || text ELSE text || '<system-reminder>open' END AS t FROM pr)) WHERE p <> '' AND NOT ({_TAGGED})""",
    "tool_result_match": """SELECT c.session_id, c.ord, coalesce(arg_max(r.is_err, r.ord), false) AS is_err FROM (SELECT session_id, ord, 't' || (ord % 50) AS id FROM tc WHERE ord % 2 = 0) c
      LEFT JOIN (SELECT session_id, ord, 't' || (ord % 50 - 1) AS id, is_err FROM tc WHERE ord % 2 = 1) r ON r.session_id = c.session_id AND r.id = c.id AND r.ord > c.ord GROUP BY 1, 2""",
    "scorecard_tools": "SELECT session_id, name, count(*) AS calls, count(*) FILTER (is_err) AS failed, round(100.0 * count(*) FILTER (is_err) / count(*), 8) AS fail_pct FROM tc GROUP BY 1, 2",
    "duplicate_reads": f"SELECT * FROM {_DUP_READS}",
    "timeline": """SELECT session_id, cast(row_number() OVER (PARTITION BY session_id ORDER BY ts, kind, ord) AS int) AS place, kind, ord, what FROM (SELECT session_id, ts, cast(0 AS int) AS kind, ord, name || ' ' || target AS what FROM tc
      UNION ALL SELECT session_id, ts, 1, ord, 'plan → auto' FROM tc WHERE ord % 10 = 0 UNION ALL SELECT session_id, ts, 2, ord, model FROM ue)""",
    "context_windows": f"SELECT * FROM {_CONTEXT}",
    "waste_failed": _FAILED,
    "waste_reads": _READS,
    "waste_bigctx": _big(6000),
    "abuse_top8": f"SELECT session_id, cast(place AS int) AS place, name, target, count FROM ({_ABUSE_ROWS})",
    "skill_overload": _SKILL,
    "loops_best": f"SELECT session_id, is_sub, reps, w, start FROM {_LOOPS}",
    "sprawl": _SPRAWL,
    "routing": _routing(1 << 40, 1 << 20),
    "context_overload": _overload(60),
    "dominant_model": f"SELECT * FROM {_DOMINANT}",
    "session_scores": f"SELECT session_id, findings, score, usd FROM {_REPORTS}",
    "corpus_projects": f"SELECT project, count(*) AS sessions, round(sum(usd), 8) AS usd, round(sum(waste_usd), 8) AS waste_usd, cast(sum(findings) AS bigint) AS findings FROM {_REPORTS} GROUP BY 1",
    "corpus_worst": f"SELECT cast(place AS int) AS place, session_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, usd DESC, session_id) AS place FROM {_REPORTS}) WHERE place <= 15",
    "corpus_totals": f"SELECT round(sum(usd), 8) AS total_usd, round(sum(waste_usd), 8) AS total_waste_usd FROM {_REPORTS}",
    "session_cost_unpriced": "SELECT session_id, round(sum(usd), 8) AS usd, count(*) AS turns, count(*) FILTER (priced_as IS NULL) AS unpriced FROM tn GROUP BY 1",
    "safety_rows": f"""SELECT project, cast(sum(turns) AS bigint) AS turns, count(*) AS sessions, {', '.join(f'cast(sum("{m}") AS bigint) AS "{m}"' for m in MODES)}, count(*) FILTER (container) AS container_sessions,
      coalesce(string_agg(DISTINCT CASE WHEN entrypoint <> '' THEN entrypoint END, ',' ORDER BY CASE WHEN entrypoint <> '' THEN entrypoint END), '') AS entrypoints, round(100.0 * sum("bypassPermissions") / sum(turns), 8) AS bypass_pct FROM {_SS} GROUP BY 1""",
    "safety_summary": f"""SELECT cast(sum(t) AS bigint) AS turns, cast(sum(b) AS bigint) AS bypass_turns, count(*) FILTER (b > 0) AS bypass_projects, cast(sum(c) AS bigint) AS container_sessions, round(CASE WHEN sum(t) > 0 THEN 100.0 * sum(b) / sum(t) ELSE 0 END, 8) AS bypass_pct
      FROM (SELECT project, sum("bypassPermissions") AS b, sum(turns) AS t, count(*) FILTER (container AND "bypassPermissions" > 0) AS c FROM {_SS} GROUP BY 1)""",
    "container_heuristic": f"SELECT DISTINCT cwd, {_CONTAINER} AS container FROM pr",
    "phases_by_phase": _by("phase"),
    "phases_by_lang": _by("lang"),
    "phases_by_key": _by("phase", "lang", "tier"),
    "phases_by_project": _by("project"),
    "phases_by_project_phase": _by("project", "phase"),
    "phases_by_depth": _by("depth"),
    "phases_main": f"""SELECT * FROM (SELECT session_id, {', '.join(f'round(sum({_part(t)}), 8) AS {t[4:]}_usd' for t in _TOK)}, round(sum({_COST}), 8) AS usd, count(*) AS responses, min(ts) AS start, max(ts) AS "end" FROM {_priced('(SELECT * FROM dd WHERE NOT is_sub)')} GROUP BY 1) WHERE usd <> 0""",
    "lang_vote": f"SELECT * FROM {_VOTES}",
    "classify_phase": f"SELECT agent_id, {_PHASE} AS phase FROM ag",
    "model_tier": f"SELECT agent_id, {_TIER} AS tier, cast(CASE WHEN contains(model, '[1m]') OR tok_in > 200000 THEN 1000000 ELSE 200000 END AS bigint) AS \"window\" FROM ag",
    **{f"roi_{k}": _roi(k) for k in ("day", "week", "month")},
    "budget_status": f"""SELECT "window", round(spent, 8) AS spent, limit_usd, round(100.0 * spent / limit_usd, 8) AS pct, CASE WHEN 100.0 * spent / limit_usd >= 100 THEN 'over' WHEN 100.0 * spent / limit_usd >= 80 THEN 'warn' ELSE 'ok' END AS state, resets_on FROM (
      SELECT 'day' AS "window", coalesce(sum(CASE WHEN {_DAY} THEN usd END), 0) AS spent, cast(5000 AS double) AS limit_usd, date '2024-01-25' AS resets_on FROM {_DAILY} UNION ALL SELECT 'week', coalesce(sum(CASE WHEN {_WEEK} THEN usd END), 0), 20000, date '2024-01-29' FROM {_DAILY})""",
    "plan_latest": f"SELECT * FROM {_PLANS}",
    "gauge_rows": f"""SELECT vendor, label, round(pct, 8) AS pct, band, cast(least(10, greatest(0, floor(pct / 10 + 0.5))) AS int) AS cells, CASE WHEN stale THEN 'stale' WHEN pct >= 100 THEN 'over' WHEN pct >= 80 THEN 'warn' ELSE 'ok' END AS tint,
      cast(row_number() OVER (ORDER BY band, list_position(['claude', 'codex', 'grok'], vendor), window_minutes) AS int) AS place FROM (SELECT *, cast(CASE WHEN label LIKE '%h' THEN 0 ELSE 1 END AS int) AS band FROM {_PLANS})""",
    "worst_pct": f"SELECT coalesce(max(pct), 0) AS worst_pct FROM {_PLANS} WHERE NOT stale AND vendor IN ('claude', 'codex', 'grok')",
    "active_sessions": f"SELECT * FROM {_active(_NOW)}",
    "session_warnings": f"SELECT * FROM {_warn(_NOW)}",
    "notify_new": f"SELECT a.session_id, a.condition FROM {_on(_NOW)} a ANTI JOIN {_on("timestamp '2024-01-24 06:00:00'")} b ON a.session_id = b.session_id AND a.condition = b.condition",
    "stream_equals_batch": f"SELECT day, project, source, vendor, model, is_sub, {', '.join(_TOK)}, round(costed_usd, 8) AS costed_usd, events FROM cells",
    "fmt_usd": f"SELECT event_id, CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', c // 100) || '.' || lpad(cast(c % 100 AS varchar), 2, '0') AS usd FROM (SELECT event_id, {_MONEY} AS v, cast(floor(abs({_MONEY}) * 100 + 0.5) AS bigint) AS c FROM events)",
    "fmt_tokens": f"""SELECT event_id, CASE WHEN n >= 1000000000 THEN printf('%.2fB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.0fK', n / 1e3) ELSE cast(n AS varchar) END AS tokens,
      CASE WHEN n < 1000 THEN cast(n AS varchar) WHEN n < 1000000 THEN printf('%.1fk', n / 1000.0) ELSE printf('%.1fM', n / 1e6) END AS short FROM (SELECT event_id, {_N} AS n FROM events)""",
    "bucket_labels": f"SELECT DISTINCT day, {', '.join(f'{b.format(d="day")} AS by_{k}' for k, b in _BUCKET.items())} FROM (SELECT cast(o_orderdate AS date) AS day FROM orders)",
    "short_project": "SELECT c_custkey, array_to_string(string_split('Users-x-src-' || (c_custkey % 7) || '-' || c_name, '-')[5:], '-') AS short FROM customer",
}



def _placed(rows: str, order: str, columns: str, most: int | None = None) -> str:
    return f"SELECT {columns} FROM (SELECT *, cast(row_number() OVER (ORDER BY {order}) AS int) AS place FROM ({rows})) {f'WHERE place <= {most}' if most else ''}"


def _shown(rows: str, most: int) -> str:
    return f"""SELECT session_id, name, "count", place, greatest(0, n - {most}) AS more FROM (SELECT *, cast(row_number() OVER (PARTITION BY session_id ORDER BY "count" DESC, name) AS int) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM ({rows})) WHERE place <= {most}"""


_DISPLAY = {
    "phase": "['build', 'review', 'research', 'test', 'plan', 'writing', 'other', 'orchestration']",
    "lang": "['go', 'rust', 'python', 'typescript', 'javascript', 'ruby', 'java', 'csharp', 'swift', 'terraform', 'unknown']",
}
_DELIVERED = f"""(SELECT s.session_id, s.repo, s.usd, CASE WHEN s.repo IN (SELECT o_custkey % 20 FROM orders) THEN (SELECT count(*) FROM (SELECT o_custkey % 20 AS repo, timestamp '2024-01-01' + to_days(cast(o_orderkey % 30 AS int)) + to_seconds(o_orderkey * 37 % 86400) AS at FROM orders) c
  WHERE c.repo % 4 <> 0 AND c.repo = s.repo AND c.at BETWEEN s.start AND s.upto) END AS commits FROM (SELECT t.session_id, t.session_id % 40 AS repo, t.usd, b.start, b."end" + interval 1 minute AS upto FROM (SELECT session_id, round(sum(usd), 8) AS usd FROM tn GROUP BY 1) t JOIN {_BOUNDS} b USING (session_id)) s)"""
_BODIES |= {
    "waste_projects": _placed(_BODIES["corpus_projects"], "waste_usd DESC, project", "place, project, waste_usd"),
    "safety_order": _placed(_BODIES["safety_rows"], "bypass_pct DESC, turns DESC, project", "place, project, bypass_pct, turns"),
    "phase_order": _placed(_BODIES["phases_by_phase"], f"coalesce(list_position({_DISPLAY['phase']}, phase), 99), phase", "*"),
    "language_order": _placed(_BODIES["phases_by_lang"], f"coalesce(list_position({_DISPLAY['lang']}, lang), 99), lang", "*"),
    "phase_keys_top25": _placed(_BODIES["phases_by_key"], "usd DESC, phase, lang, tier", "*", 25),
    "roi_repositories": _placed(f"SELECT repo, round(sum(usd), 8) AS usd, cast(sum(my_commits) AS bigint) AS my_commits, cast(sum(my_lines) AS bigint) AS my_lines FROM ({_BODIES['roi_week']}) GROUP BY 1", "usd DESC, repo", "*"),
    "top_tools": _shown('SELECT session_id, name, count(*) AS "count" FROM tc GROUP BY 1, 2', 8),
    "top_reads": _shown(f'SELECT session_id, target AS name, reads AS "count" FROM {_DUP_READS}', 5),
    "active_top8": _placed(_BODIES["active_sessions"], "usd_5m DESC, session_id", "place, session_id, usd_5m", 8),
    "flagged_top10": _placed(f"SELECT * FROM {_REPORTS} WHERE findings > 0", "score DESC, usd DESC, session_id", "place, session_id, score, findings", 10),
    "session_prefix": "SELECT session_id, count(*) AS turns FROM dd WHERE cast(session_id AS varchar) LIKE '1%' GROUP BY 1",
    "delivery_window": f"SELECT * FROM {_DELIVERED}",
    "delivery_scores": f"""SELECT session_id, findings + more AS findings, round(score + more, 8) AS score FROM (SELECT r.*, CASE WHEN x.session_id IS NULL THEN 0 ELSE 1 END AS more FROM {_REPORTS} r
      LEFT JOIN (SELECT session_id FROM {_DELIVERED} WHERE usd >= 2 AND session_id % 7 <> 0 AND commits = 0) x USING (session_id))""",
}

_LANDED = f"""SELECT session_id, 'delivery' AS category, cast(1 AS bigint) AS count, cast(0 AS double) AS usd, printf('$%.2f', usd) || ' session with no commit and no PR — did the work land?' AS detail
  FROM {_DELIVERED} WHERE usd >= 2 AND session_id % 7 <> 0 AND commits = 0"""
_CYCLES = f"""(SELECT l.session_id, l.is_sub, l.reps, string_agg(s.tok, ' → ' ORDER BY s.i) AS cycle FROM {_LOOPS} l JOIN (SELECT session_id, is_sub, name || ' ' || target AS tok, row_number() OVER (PARTITION BY session_id, is_sub ORDER BY ts, ord) - 1 AS i FROM tc) s
  ON s.session_id = l.session_id AND s.is_sub = l.is_sub AND s.i BETWEEN l.start AND l.start + l.w - 1 GROUP BY ALL)"""
_REST = f"(SELECT session_id, count(*) AS patterns, cast(sum(count) AS bigint) AS calls FROM {_ABUSE} WHERE place > 8 GROUP BY 1)"
_HOURS = 'round((epoch("end") - epoch(start)) // 1 / 3600.0, 12)'


def _worded(part: str, detail: str) -> str:
    return f"SELECT session_id, category, count, usd, {detail} AS detail FROM ({part})"


_DETAILS = " UNION ALL ".join([
    _worded(_FAILED, "count || ' failed tool call(s) — each burns a round-trip'"),
    f"SELECT session_id, 'waste_reads', cast(sum(reads - 1) AS bigint), cast(0 AS double), cast(sum(reads - 1) AS bigint) || ' redundant Read(s) across ' || count(*) || ' file(s)' FROM {_DUP_READS} GROUP BY 1",
    _worded(_big(100), "count || ' turn(s) injected big new context but produced tiny output'"),
    f"SELECT session_id, 'abuse', cast(count AS bigint), cast(0 AS double), name || ' \"' || target || '\" called ' || count || '×' FROM {_ABUSE} WHERE place <= 8",
    f"SELECT session_id, 'abuse', patterns, cast(0 AS double), '…and ' || patterns || ' more repeated-call pattern(s) (' || calls || ' calls)' FROM {_REST}",
    _worded(_SKILL, "count || ' distinct skills invoked in one session'"),
    f"SELECT session_id, 'loop', cast(reps AS bigint), cast(0 AS double), CASE WHEN is_sub THEN 'subagent' ELSE 'main' END || ' stream: cycle [' || cycle || '] repeated ' || reps || '×' FROM {_CYCLES}",
    f"SELECT session_id, category, count, usd, 'long session: ' || count || ' prompts over ' || printf('%.1f', {_HOURS}) || 'h — consider splitting or delegating to subagents' FROM ({_SPRAWL}) JOIN {_BOUNDS} USING (session_id)",
    _worded(_routing(20000, 5), "'light session ran on Opus — Sonnet/Haiku or Fast mode may suffice'"),
    f"SELECT session_id, category, count, usd, 'peak context ' || printf('%.0f', context_pct) || '% of ' || model || ' window' FROM ({_overload(80)}) JOIN {_CONTEXT} USING (session_id)",
    _LANDED,
])
_MAIN = f"""(SELECT * FROM (SELECT project, session_id, {_TIER} AS tier, sum({_COST}) AS usd, count(*) AS responses FROM {_priced('(SELECT * FROM dd WHERE NOT is_sub)')} GROUP BY 1, 2, 3)
  QUALIFY sum(usd) OVER (PARTITION BY project, session_id) <> 0)"""
_ONCE = "cast(0 AS double)"
_ONCE_TOKENS = ", ".join(f"cast(coalesce(sum({t}), 0) AS bigint) AS {t}" for t in _TOK)


def _once_total(place: int, name: str, rows: str) -> str:
    return f"SELECT 'total' AS section, cast({place} AS int) AS place, '{name}' AS name, cast(coalesce(round(sum(usd), 8), 0) AS double) AS usd, {_ONCE_TOKENS}, {_ONCE} AS main_usd, {_ONCE} AS sub_usd, cast(0 AS bigint) AS count FROM ({rows})"


_KEY = "CASE WHEN len(parts) <= 4 OR array_to_string(parts[5:], '-') = '' THEN n ELSE array_to_string(parts[5:], '-') END"


def _period(cond: str) -> str:
    shares = f"(SELECT vendor, round(sum(turns_with) / sum(turns), 8) AS coverage FROM (SELECT cast(ts AS date) AS day, vendor, count(*) AS turns, count(*) FILTER (has_usage) AS turns_with FROM dd WHERE costed GROUP BY 1, 2) WHERE {cond} GROUP BY 1)"
    return f"SELECT source, vendor, model, usd, tokens, coverage FROM ({_sums(_where('cells', cond), 'source', 'vendor', 'model')}) LEFT JOIN {shares} USING (vendor)"


_NO_TOKENS = ", ".join("cast(0 AS bigint)" for _ in _TOK)
_BODIES |= {
    "delivery_flag": _LANDED,
    "finding_rows": f"""SELECT cast(session_id AS varchar) AS session, project, printf('%.4f', r.usd) AS usd, printf('%.4f', waste_usd) AS waste_usd, coalesce(string_split(category, '_')[1], '') AS category, coalesce(detail, '') AS detail,
      coalesce(cast(f.count AS varchar), '') AS count, coalesce(printf('%.4f', f.usd), '') AS finding_usd FROM {_REPORTS} r LEFT JOIN ({_DETAILS}) f USING (session_id)""",
    "project_prompts": f"""SELECT project, cast(place AS int) AS place, session_id, ord, md5(text) AS md5 FROM (SELECT r.project, p.session_id, p.ord, p.text, row_number() OVER (PARTITION BY r.project ORDER BY score DESC, usd DESC, p.session_id, p.ord) AS place
      FROM pr p JOIN {_REPORTS} r USING (session_id) WHERE text IS NOT NULL) WHERE place <= 80""",
    "costliest_agents": _placed(f"SELECT agent_id, phase, lang, tier, round(usd, 8) AS usd, usd AS exact FROM {_AGENTS}", "exact DESC, agent_id", "place, agent_id, phase, lang, tier, usd", 20),
    "main_by_project": f"SELECT project, round(sum(usd), 8) AS usd, count(DISTINCT session_id) AS sessions FROM {_MAIN} GROUP BY 1",
    "main_by_project_tier": f"SELECT project, tier, round(sum(usd), 8) AS usd FROM {_MAIN} GROUP BY 1, 2",
    "session_tiers_top20": f"""SELECT place, project, session_id, t.usd, responses, m.tier, round(m.usd, 8) AS tier_usd FROM ({_placed(f'SELECT project, session_id, round(sum(usd), 8) AS usd, cast(sum(responses) AS bigint) AS responses FROM {_MAIN} GROUP BY 1, 2', 'usd DESC, session_id, project', '*', 20)}) t
      JOIN (SELECT project, session_id, tier, usd FROM {_MAIN}) m USING (project, session_id)""",
    "series_ranked": _placed(_BODIES["series_share"], "usd DESC, source, vendor, model", "place, source, vendor, model, usd, share"),
    "once_summary": " UNION ALL ".join([
        _once_total(1, "Today", _sums(_where("cells", _DAY), "vendor")), _once_total(2, "Month", _sums(_where("cells", _MONTH), "model")),
        f"SELECT 'model', cast(row_number() OVER (ORDER BY usd DESC, model) AS int), model, cast(usd AS double), {', '.join(_TOK)}, {_ONCE}, {_ONCE}, cast(0 AS bigint) FROM ({_sums(_where('cells', _MONTH), 'model')})",
        f"SELECT 'project', cast(row_number() OVER (ORDER BY round(main_usd + sub_usd, 8) DESC, project) AS int), project, round(main_usd + sub_usd, 8), {_NO_TOKENS}, main_usd, sub_usd, cast(0 AS bigint) FROM ({_main_sub(_MONTH)})",
        f"SELECT 'count', cast(1 AS int), 'dupes', {_ONCE}, {_NO_TOKENS}, {_ONCE}, {_ONCE}, cast(dupes AS bigint) FROM ({_BODIES['dupes_count']})",
        f"SELECT 'count', cast(2 AS int), 'unknown_model_events', {_ONCE}, {_NO_TOKENS}, {_ONCE}, {_ONCE}, cast(unknown AS bigint) FROM ({_BODIES['unknown_models']})",
    ]),
    "billing_latest": f"""SELECT 'grok' AS vendor, 'wk' AS label, value AS pct, date_trunc('second', cast(ts AS timestamp)) AS observed, date_trunc('second', cast(ts AS timestamp)) + interval 7 day AS resets_at, date_trunc('second', cast(ts AS timestamp)) + interval 7 day < {_NOW} AS stale, event_type AS plan
      FROM events WHERE event_id % 3 = 0 ORDER BY date_trunc('second', cast(ts AS timestamp)) DESC, event_id LIMIT 1""",
    "roi_projects": f"SELECT '/home/me/proj-' || repo AS repo, * EXCLUDE (repo) FROM ({_roi('week', 'repo < 12 AND repo % 3 <> 0', "day >= date '2024-01-08'")})",
    "roi_skipped": f"SELECT count(*) AS skipped FROM ({_sums('cells', 'project', 'day')}) WHERE cast(regexp_extract(project, '(\\d+)$', 1) AS bigint) % 3 = 0 AND day >= date '2024-01-08'",
    **{f"period_{k}": _period(c) for k, c in (("day", _DAY), ("week", _WEEK), ("month", _MONTH))},
    "short_names": f"""SELECT c_custkey, {_KEY} AS key, CASE WHEN contains(n, '/') THEN string_split(n, '/')[-1] ELSE {_KEY} END AS tail, CASE WHEN len(whole) <= 4 THEN bare ELSE array_to_string(whole[5:], '-') END AS name,
      CASE c_custkey % 4 WHEN 0 THEN 'Opus' WHEN 1 THEN 'Sonnet' WHEN 2 THEN 'Haiku' ELSE 'groké' END AS model, CASE c_custkey % 4 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'haiku' ELSE 'groké' END AS tag,
      CASE WHEN strlen(c_name) > 9 THEN c_name[1:8] || '…' ELSE c_name END AS cut
      FROM (SELECT *, string_split(bare, '-') AS parts, list_filter(string_split(bare, '-'), lambda x: x <> '') AS whole FROM (SELECT *, regexp_replace(n, '^-', '') AS bare FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '' END || 'Users-x-'
        || CASE WHEN c_custkey % 3 > 0 THEN 'src-' ELSE '' END || '-' || (c_custkey % 7) || CASE WHEN c_custkey % 5 = 0 THEN '-a/b' ELSE '' END AS n FROM customer)))""",
}

ORACLE_SQL: dict[str, str] = {name: BASE + (", " + body.removeprefix("WITH ") if body.startswith("WITH ") else body) for name, body in _BODIES.items()}
#: For the SQL of streams: cumulative readings, deduplicated events with prices, their cost, and that of writing the cache.
DELTA_SOURCE = (_RD, _priced("dd"), _COST, _part("tok_cw"))
