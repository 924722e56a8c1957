"""All registered queries of the log-analytics engine, with their DuckDB equivalents.

Each entry is a function of (spark, sf_dir). Where a query has a rollup path, it is registered by both paths under
two names, against the same SQL if their results must agree.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bots, params, probes, search, useragent
from tidemark.functions.catalog import agent_sql
from tidemark.operators import combine as C
from tidemark.functions.timewindow import whole
from tidemark.operators import rollups as R
from tidemark.operators import store as ST
from tidemark.plans import adapter as A
from tidemark.plans import analysis as N
from tidemark.plans import cases, stored
from tidemark.plans import overview as O
from tidemark.sources.scratch import kept

#: The window of the registered reports: it cuts minutes and hours at both ends.
SINCE, UNTIL = datetime(2024, 1, 5, 10, 7, 30), datetime(2024, 1, 24, 5, 13, 45)
_WHEN = f"ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'"
EV = f"WITH ev AS ({A.ACCESS_SQL}), w AS (SELECT * FROM ev WHERE {_WHEN}), ip AS ({A.INTEL_SQL}), lg AS (SELECT * FROM ({A.LOGS_SQL}) WHERE {_WHEN})"
_C4, _C5 = "count(*) FILTER (WHERE status BETWEEN 400 AND 499)", "count(*) FILTER (WHERE status BETWEEN 500 AND 599)"
_CS = "count(*) FILTER (WHERE request_time_ms >= 1000)"
_SEEN = "min(ts) AS first_seen, max(ts) AS last_seen"
_BYTES = "CAST(coalesce(sum(bytes_sent), 0) AS BIGINT) AS bytes_sent"
_P95 = "coalesce(percentile_cont(0.95) WITHIN GROUP (ORDER BY request_time_ms), 0.0)"
_EDGE = "CASE " + " ".join(f"WHEN request_time_ms <= {e} THEN {e}" for e in R.LATENCY_EDGES[:-1]) + f" ELSE {R.LATENCY_EDGES[-1]} END"
_R4, _R5 = "status_4xx / CAST(requests AS DOUBLE) AS status_4xx_rate", "status_5xx / CAST(requests AS DOUBLE) AS status_5xx_rate"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None = None) -> None:
    _queries[name] = lambda spark, sf_dir: A.plain_times(run(spark, sf_dir))
    if sql:
        _sql[name] = sql


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.window(A.access_events(spark, sf_dir), SINCE, UNTIL)


def _on_events(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over all access events."""
    _add(name, lambda s, d: f(A.access_events(s, d)), f"{EV} {sql}")


def _on_window(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over the events of the window."""
    _add(name, lambda s, d: f(_window(s, d)), f"{EV} {sql}")


def _stored(spark: SparkSession, sf_dir: str, name: str, since: datetime = SINCE, until: datetime = UNTIL, gap: bool = False) -> DataFrame:
    """A rollup's rows of the window, from the store: complete hours as stored, the rest from events."""
    return A.rollup_store(spark, sf_dir, name, gap=gap).rows(name, since, until)


# ---- rollups

_FULL = f"count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx, {_BYTES}, {_SEEN}"
_MINUTE = f"""count(*) AS requests, {', '.join(f'count(*) FILTER (WHERE status BETWEEN {n}00 AND {n}99) AS status_{n}xx' for n in (2, 3, 4, 5))},
    count(DISTINCT client_ip) AS unique_ips, {_BYTES}, count(request_time_ms) AS request_time_count, CAST(coalesce(sum(request_time_ms), 0) AS BIGINT) AS request_time_sum_ms,
    {_CS} AS slow_requests, count(*) FILTER (WHERE coalesce(user_agent, '') = '') AS empty_user_agents"""
_ROLLUP_SQL = {
    "rollup_1m": ("minute", "", _MINUTE, "true"),
    "rollup_ip_1h": ("hour", "client_ip", _FULL, "client_ip IS NOT NULL"),
    "rollup_path_1h": ("hour", "path", _FULL, "path IS NOT NULL"),
    "rollup_user_agent_1h": ("hour", "user_agent", _FULL, "user_agent IS NOT NULL"),
    "rollup_ip_path_1h": ("hour", "client_ip, path", _FULL, "client_ip IS NOT NULL AND path IS NOT NULL"),
    "rollup_ip_user_agent_1h": ("hour", "client_ip, user_agent", _FULL, "client_ip IS NOT NULL AND user_agent IS NOT NULL"),
    "rollup_status_1h": ("hour", "coalesce(status, 0) AS status", f"count(*) AS requests, {_SEEN}", "true"),
    "rollup_site_latency_1h": ("hour", f"{_EDGE} AS bucket_le_ms", "count(*) AS requests", "request_time_ms IS NOT NULL"),
    "rollup_path_latency_1h": ("hour", f"path, {_EDGE} AS bucket_le_ms", f"count(*) AS requests, {_C5} AS status_5xx, CAST(sum(request_time_ms) AS BIGINT) AS request_time_sum_ms, {_SEEN}", "request_time_ms IS NOT NULL"),
}
for _name, (_width, _keys, _measures, _where) in _ROLLUP_SQL.items():
    _on_events(
        _name, lambda e, n=_name: R.build(e, n),
        f"SELECT date_trunc('{_width}', ts) AS bucket_ts, site_id, env, {_keys + ', ' if _keys else ''}{_measures} FROM ev WHERE {_where} GROUP BY ALL",
    )

_PAIR = "lower(ltrim(split_part(pair, '=', 1), '?'))"
_VALUE = "CASE WHEN instr(pair, '=') > 0 THEN substr(pair, instr(pair, '=') + 1, 512) ELSE '' END"
_FAMILY = f"CASE WHEN param = 'srsltid' THEN 'srsltid' WHEN starts_with(param, 'utm_') THEN 'utm' WHEN param IN {params.CLICK_IDS} THEN 'click_id' WHEN param IN {params.CAMPAIGN} THEN 'campaign' WHEN starts_with(param, 'wpv_') THEN 'wpv' ELSE 'other' END"
PARAMS = lambda src: f", pr AS (SELECT *, {_FAMILY} AS param_family FROM (SELECT *, {_PAIR} AS param, {_VALUE} AS param_value FROM (SELECT *, unnest(string_split(query, '&')) AS pair FROM {src} WHERE coalesce(query, '') <> '')) WHERE param <> '')"
_UNIQUE = "count(DISTINCT client_ip) AS unique_ips, count(DISTINCT path) AS unique_paths"
_NEWEST = "coalesce(arg_max(coalesce(path, ''), (ts, id)), '') AS example_path, coalesce(arg_max(coalesce(query, ''), (ts, id)), '') AS example_query"
_on_events(
    "rollup_query_param_1h", R.build_params,
    PARAMS("ev") + f" SELECT date_trunc('hour', ts) AS bucket_ts, site_id, env, param_family, param, md5(param_value) AS value_hash, count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx, {_CS} AS slow_requests, {_UNIQUE}, count(DISTINCT user_agent) AS unique_user_agents, count(request_time_ms) AS request_time_count, CAST(coalesce(sum(request_time_ms), 0) AS BIGINT) AS request_time_sum_ms, {_SEEN}, {_NEWEST}, any_value(param_value) AS param_value FROM pr GROUP BY ALL",
)
_on_events(
    "rollup_merge",
    lambda e: R.merge(R.build(e.where("id % 3 = 0"), "rollup_ip_path_1h"), R.build(e.where("id % 3 <> 0"), "rollup_ip_path_1h"), "rollup_ip_path_1h"),
    _sql["rollup_ip_path_1h"].removeprefix(EV),
)


def _rebuilt(e: DataFrame) -> DataFrame:
    """Hours of new rows counted anew over an older rollup give the rollup of all rows."""
    return R.rebuild(e, R.build(e.where("id % 97 <> 0"), "rollup_path_1h"), "rollup_path_1h", R.touched_hours(e.where("id % 97 = 0")))


_on_events("rollup_rebuild_touched_hours", _rebuilt, _sql["rollup_path_1h"].removeprefix(EV))

# ---- access analysis

_on_window("totals", N.totals, f"""SELECT *, status_4xx / CAST(greatest(requests, 1) AS DOUBLE) AS status_4xx_rate, status_5xx / CAST(greatest(requests, 1) AS DOUBLE) AS status_5xx_rate, slow_requests / CAST(greatest(requests, 1) AS DOUBLE) AS slow_requests_rate, empty_user_agents / CAST(greatest(requests, 1) AS DOUBLE) AS empty_user_agents_rate
    FROM (SELECT count(*) AS requests, count(DISTINCT client_ip) AS unique_ips, count(DISTINCT user_agent) AS unique_user_agents, {_C4} AS status_4xx, {_C5} AS status_5xx, count(*) FILTER (WHERE coalesce(user_agent, '') = '') AS empty_user_agents, {_CS} AS slow_requests, {_BYTES}, coalesce(avg(request_time_ms), 0.0) AS avg_request_time_ms, {_P95} AS p95_request_time_ms FROM w)""")
_add("totals_from_minutes", lambda s, d: N.totals_from_minutes(_stored(s, d, "rollup_1m")), f"""{EV} SELECT *, request_time_sum_ms / CAST(greatest(request_time_count, 1) AS DOUBLE) AS avg_request_time_ms, status_4xx / CAST(greatest(requests, 1) AS DOUBLE) AS status_4xx_rate, status_5xx / CAST(greatest(requests, 1) AS DOUBLE) AS status_5xx_rate
    FROM (SELECT * EXCLUDE (unique_ips) FROM (SELECT {_MINUTE} FROM w))""")
_SITES = f"SELECT *, {_R4}, {_R5} FROM (SELECT site_id, env, count(*) AS requests, count(DISTINCT client_ip) AS unique_ips, {_C4} AS status_4xx, {_C5} AS status_5xx, coalesce(avg(request_time_ms), 0.0) AS avg_request_time_ms, {_P95} AS p95_request_time_ms, {_SEEN} FROM w GROUP BY site_id, env)"
_on_window("site_summary", N.site_summary, _SITES)


def _sites_from_rollups(s: SparkSession, d: str, gap: bool = False) -> DataFrame:
    return N.site_summary_from_rollups(*(_stored(s, d, n, gap=gap) for n in ("rollup_1m", "rollup_ip_1h", "rollup_site_latency_1h")))


def _backfilled_twice(s: SparkSession, d: str) -> DataFrame:
    """A rollup that was added to batch by batch, and once more: the marks keep it from counting twice."""
    store = A.rollup_store(s, d, "rollup_path_1h")
    store.backfill("rollup_path_1h")
    return store.merged("rollup_path_1h")


def _unique_from_bitmaps(s: SparkSession, d: str) -> DataFrame:
    """Addresses of the window by site, from hours of bitmaps and the window's edges."""
    events, hour = A.access_events(s, d), 3600
    lo, hi = whole(SINCE, UNTIL, hour)
    known = ST.dense_keys(s.createDataFrame([], "client_ip string, key long"), events.where("id % 2 = 0"), "client_ip")
    keys = kept(ST.dense_keys(known, events, "client_ip"), "address-keys")
    by = ("site_id", "env")
    hours = kept(ST.distinct_rollup(events, keys, "client_ip", *by), "address-bitmaps").where((F.col("bucket_ts") >= R.at(lo)) & (F.col("bucket_ts") < R.at(hi)))
    edges = ST.distinct_rollup(R.window(events, SINCE, UNTIL).where((F.col("ts") < R.at(lo)) | (F.col("ts") >= R.at(hi))), keys, "client_ip", *by)
    return ST.merge_distinct(hours.unionByName(edges), *by, name="unique_ips")


def _histogram_sql(keys: str, src: str = "w") -> str:
    return f"(SELECT {keys}, CAST(min(edge) AS DOUBLE) AS p95 FROM (SELECT {keys}, edge, sum(n) OVER (PARTITION BY {keys} ORDER BY edge) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM (SELECT {keys}, {_EDGE} AS edge, count(*) AS n FROM {src} WHERE request_time_ms IS NOT NULL GROUP BY ALL)) WHERE upto >= ceil(total * CAST(0.95 AS DOUBLE)) GROUP BY ALL)"


_add("site_summary_from_rollups", _sites_from_rollups, f"""{EV} SELECT a.site_id, a.env, requests, status_4xx, status_5xx, date_trunc('minute', first_seen) AS first_seen, date_trunc('minute', last_seen) + INTERVAL 1 MINUTE AS last_seen, unique_ips, avg_request_time_ms, coalesce(h.p95, 0.0) AS p95_request_time_ms, status_4xx_rate, status_5xx_rate
    FROM ({_SITES}) a LEFT JOIN {_histogram_sql('site_id, env')} h USING (site_id, env)""")

_add("site_summary_over_a_gap", lambda s, d: _sites_from_rollups(s, d, gap=True), _sql["site_summary_from_rollups"])
_add("totals_from_minutes_over_a_gap", lambda s, d: N.totals_from_minutes(_stored(s, d, "rollup_1m", gap=True)), _sql["totals_from_minutes"])
_add("rollup_backfilled_twice", _backfilled_twice, _sql["rollup_path_1h"])
_add("unique_ips_from_bitmaps", _unique_from_bitmaps, f"{EV} SELECT site_id, env, count(DISTINCT client_ip) AS unique_ips FROM w WHERE client_ip IS NOT NULL GROUP BY ALL")

_VERIFIED = "CASE WHEN coalesce(manual_action, '') = 'suspicious' THEN false WHEN coalesce(manual_action, '') IN ('allowlisted', 'verified') THEN true WHEN coalesce(actor_type, '') IN ('cloud', 'datacenter', 'edge', 'hosting', 'vps', 'unknown', 'tor', '') THEN false ELSE coalesce(verified_actor, false) OR (coalesce(forward_confirmed, false) AND coalesce(known_actor, '') NOT IN ('', 'Tor exit')) END"
_LOOSE = "CASE WHEN coalesce(manual_action, '') = 'suspicious' THEN false WHEN coalesce(manual_action, '') IN ('allowlisted', 'verified') THEN true ELSE coalesce(actor_type, '') NOT IN ('', 'datacenter', 'unknown', 'tor') AND (coalesce(verified_actor, false) OR (coalesce(forward_confirmed, false) AND coalesce(known_actor, '') <> '')) END"
_INTEL_COLUMNS = "i.actor_type, i.known_actor, i.manual_action, i.forward_confirmed, i.verified_actor, i.is_tor_exit, i.is_datacenter, i.risk_score, i.country_code"
_TOP_IPS = f"SELECT t.*, {_INTEL_COLUMNS}, {_VERIFIED} AS verified_source FROM (SELECT client_ip, {_FULL} FROM w WHERE client_ip IS NOT NULL GROUP BY client_ip ORDER BY requests DESC, client_ip LIMIT 25) t LEFT JOIN ip i ON i.ip = t.client_ip"
_add("top_source_ips", lambda s, d: N.top_ips(_window(s, d), A.ip_intel(s, d)), f"{EV} {_TOP_IPS}")
_add("top_source_ips_from_rollup", lambda s, d: N.top_ips_from_rollup(_stored(s, d, "rollup_ip_1h"), A.ip_intel(s, d)), f"{EV} {_TOP_IPS}")
_on_window("top_paths", N.top_paths, f"SELECT coalesce(path, '') AS path, {_FULL} FROM w GROUP BY 1 ORDER BY requests DESC, path LIMIT 10")
_on_window("status_breakdown", N.status_breakdown, "SELECT coalesce(status, 0) AS status, count(*) AS requests FROM w GROUP BY 1 ORDER BY requests DESC, status LIMIT 32")
_add(
    "status_breakdown_from_rollup", lambda s,
    d: _stored(s, d, "rollup_status_1h").groupBy("status").agg(F.sum("requests").alias("requests")).orderBy(F.desc("requests"), "status").limit(32),
    _sql["status_breakdown"],
)
_SLOW = f"SELECT site_id, env, coalesce(path, '') AS path, count(*) AS requests, avg(request_time_ms) AS avg_request_time_ms, percentile_cont(0.95) WITHIN GROUP (ORDER BY request_time_ms) AS p95_request_time_ms, {_C5} AS status_5xx, {_SEEN} FROM w WHERE request_time_ms IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20"
_on_window("slow_paths", N.slow_paths, f"{_SLOW} ORDER BY p95_request_time_ms DESC, requests DESC, site_id, env, path LIMIT 25")
_add("slow_paths_from_rollup", lambda s, d: N.slow_paths_from_rollup(_stored(s, d, "rollup_path_latency_1h")), f"""{EV} SELECT s.* EXCLUDE (p95_request_time_ms), h.p95 AS p95_request_time_ms FROM ({_SLOW}) s JOIN {_histogram_sql('site_id, env, path')} h USING (site_id, env, path)
    ORDER BY p95_request_time_ms DESC, requests DESC, site_id, env, path LIMIT 25""")
_on_window(
    "path_5xx_hotspots", N.path_hotspots,
    f"SELECT *, status_5xx / CAST(requests AS DOUBLE) AS rate FROM (SELECT site_id, env, coalesce(path, '') AS path, count(*) AS requests, {_C5} AS status_5xx, {_SEEN} FROM w GROUP BY 1, 2, 3) WHERE requests >= 30 AND status_5xx >= 5 AND status_5xx / CAST(requests AS DOUBLE) >= 0.2 ORDER BY status_5xx DESC, requests DESC, site_id, env, path LIMIT 25",
)
_add(
    "log_totals", lambda s, d: N.log_totals(R.window(A.log_events(s, d), SINCE, UNTIL)),
    f"{EV} SELECT log_type, severity, count(*) AS events, {_SEEN} FROM lg GROUP BY 1, 2",
)
_add(
    "log_messages", lambda s, d: N.log_messages(R.window(A.log_events(s, d), SINCE, UNTIL)),
    f"{EV} SELECT log_type, severity, left(message, 240) AS message, count(*) AS events, string_agg(DISTINCT site_id, ', ' ORDER BY site_id) AS sites, {_SEEN} FROM lg GROUP BY 1, 2, 3 ORDER BY events DESC, log_type, severity, message LIMIT 25",
)
_add(
    "latest_logs", lambda s, d: N.latest_logs(R.window(A.log_events(s, d), SINCE, UNTIL)),
    f"{EV} SELECT id, ts, site_id, env, log_type, severity, left(message, 500) AS message, left(raw, 1200) AS raw FROM lg ORDER BY ts DESC, id LIMIT 25",
)

# ---- user agents

_LOW = "lower(trim(sample))"
_TOOL = f"CASE WHEN regexp_matches(sample, '(?i)curl/[0-9.]+') THEN 'curl' WHEN regexp_matches(sample, '(?i)python-requests/[0-9.]+') THEN 'python-requests' ELSE '' END"
_BROWSER = "CASE WHEN regexp_matches(sample, '(?i)Chrome/[0-9.]+') THEN 'Chrome' ELSE '' END"
_AGENT = f"""SELECT *, CASE WHEN sample = '' THEN 'missing' WHEN svc IS NOT NULL THEN svc WHEN tool <> '' THEN 'tool' WHEN browser <> '' THEN 'browser' ELSE 'unknown' END AS actor_type,
    CASE WHEN sample = '' THEN 'empty' WHEN tool <> '' THEN tool WHEN svc IS NOT NULL THEN fam WHEN browser <> '' THEN browser ELSE 'unknown' END AS family,
    CAST(CASE WHEN sample = '' THEN 55 WHEN tool <> '' THEN (CASE WHEN vol < 60 THEN 65 ELSE vol END) WHEN svc IS NOT NULL THEN rsk WHEN browser <> '' THEN (CASE WHEN vol > 30 THEN 15 ELSE vol END) ELSE vol END AS INT) AS risk_score,
    CASE WHEN sample = '' OR act IS NULL THEN '' ELSE act END AS known_actor, browser AS browser_family, CASE WHEN tool <> '' OR browser <> '' THEN regexp_extract(sample, '(?i)(?:curl|python-requests|Chrome)/([0-9]+[.][0-9]+[.][0-9]+)', 1) ELSE '' END AS browser_version,
    CASE WHEN contains(sample, 'Windows NT 10.0') THEN 'Windows' ELSE '' END AS os_family, CASE WHEN contains(sample, 'Windows NT 10.0') THEN '10/11' ELSE '' END AS os_version, CASE WHEN contains(sample, 'Windows NT 10.0') THEN 'Desktop' ELSE 'unknown' END AS device_family,
    sample <> '' AND coalesce(svc, '') = 'crawler' AS is_bot, sample <> '' AND (tool <> '' OR coalesce(svc, '') IN ('tool', 'monitor')) AS is_tool
    FROM (SELECT *, {_TOOL} AS tool, {_BROWSER} AS browser, {agent_sql(_LOW, 'actor_type')} AS svc, {agent_sql(_LOW, 'family')} AS fam, {agent_sql(_LOW, 'known_actor')} AS act, {agent_sql(_LOW, 'risk_score')} AS rsk, CASE WHEN requests >= 10000 THEN 60 WHEN requests >= 1000 THEN 45 ELSE 30 END AS vol FROM ua)"""
_UA = f""", ua AS (SELECT coalesce(user_agent, '') AS sample, count(*) AS requests, count(DISTINCT client_ip) AS unique_ips, {_C4} AS status_4xx, {_C5} AS status_5xx, {_BYTES},
    count(DISTINCT client_ip) FILTER (WHERE ok) AS verified_ips, count(*) FILTER (WHERE ok) AS verified_requests, {_SEEN} FROM (SELECT w.*, coalesce({_LOOSE}, false) AND i.ip IS NOT NULL AS ok FROM w LEFT JOIN ip i ON i.ip = w.client_ip) GROUP BY 1 ORDER BY requests DESC, sample LIMIT 25)"""
_FIELDS = ", ".join(useragent.FIELDS)
_add(
    "user_agents", lambda s, d: N.user_agents(_window(s, d), A.ip_intel(s, d)),
    f"{EV}{_UA} SELECT sample, requests, unique_ips, status_4xx, status_5xx, bytes_sent, verified_ips, verified_requests, first_seen, last_seen, {_FIELDS}, verified_ips > 0 AS verified_source, {_R4}, {_R5} FROM ({_AGENT})",
)
_on_events(
    "user_agent_dimension",
    lambda e: O.dimension(e, "user_agent").withColumn("a", useragent.analyse(F.col("user_agent"), F.col("request_count"))).select(
        "user_agent", "first_seen", "last_seen", "request_count", *(F.col(f"a.{f}").alias(f) for f in useragent.FIELDS),
    ),
    f", ua AS (SELECT user_agent AS sample, count(*) AS requests, {_SEEN} FROM ev WHERE user_agent IS NOT NULL GROUP BY 1) SELECT sample AS user_agent, first_seen, last_seen, requests AS request_count, {_FIELDS} FROM ({_AGENT})",
)


def _reanalysed(e: DataFrame) -> DataFrame:
    """Stored analyses of which some have lost their family, type or risk, made whole again."""
    whole = O.dimension(e, "user_agent").withColumn("a", useragent.analyse(F.col("user_agent"), F.col("request_count")))
    stored = whole.select("user_agent", "first_seen", "last_seen", "request_count", "a.*")
    lost = lambda c, n: F.when(F.length("user_agent") % 3 == n, None).otherwise(F.col(c))
    return O.reanalysed(stored.withColumns({"family": lost("family", 0), "risk_score": lost("risk_score", 2)}))


_on_events("reanalysed_agents", _reanalysed, _sql["user_agent_dimension"].removeprefix(EV) + " WHERE length(sample) % 3 IN (0, 2)")
_on_events(
    "bot_kinds",
    lambda e: e.groupBy(F.coalesce("user_agent", F.lit("")).alias("sample")).agg(F.count("*").alias("requests")).withColumn("a", useragent.analyse(F.col("sample"), F.col("requests"))).select(
        "sample", "requests",
        bots.bot_kind(
            F.col("a.family"), F.col("a.known_actor"), F.col("a.actor_type"), F.col("sample"), F.lit(""), F.col("a.risk_score"), F.lit(""),
        ).alias("kind"),
    ),
    "SELECT coalesce(user_agent, '') AS sample, count(*) AS requests, CASE WHEN contains(user_agent, 'AhrefsBot') THEN 'seo' WHEN contains(user_agent, 'curl') OR contains(user_agent, 'python') THEN 'tools' WHEN contains(user_agent, 'sqlmap') THEN 'suspicious' ELSE 'other' END AS kind FROM ev GROUP BY ALL",
)

# ---- probes and facts

_PROBES = """, pb AS (SELECT *, 'admin' AS family, CASE WHEN method = 'POST' THEN 'admin_login' ELSE 'admin_path' END AS category FROM w WHERE path = '/wp-login.php'
    UNION ALL SELECT *, 'injection' AS family, CASE WHEN query = 'id=1%20OR%201%3D1' THEN 'sql_injection' ELSE 'secret_file' END AS category FROM w WHERE query = 'id=1%20OR%201%3D1' OR path = '/.env'),
    px AS (SELECT *, CASE family WHEN 'admin' THEN concat('admin_', category) ELSE concat('probe_', category) END AS rule_key, CASE WHEN family = 'admin' THEN '' WHEN category = 'sql_injection' THEN 'tautology' ELSE 'secret_file' END AS match_reason FROM pb)"""
_PROBE_COLUMNS = "id, ts, site_id, env, client_ip, method, path, query, status, family, category, rule_key, match_reason"
_on_window("security_probes", lambda w: probes.probes(w).select(*_PROBE_COLUMNS.split(", ")), f"{_PROBES} SELECT {_PROBE_COLUMNS} FROM px")
_on_window(
    "rollup_security_probe_1h", lambda w: R.build_probes(probes.probes(w)),
    f"{_PROBES} SELECT date_trunc('hour', ts) AS bucket_ts, site_id, env, family, category, rule_key, count(*) AS events, count(DISTINCT client_ip) AS unique_ips, {_C4} AS status_4xx, {_C5} AS status_5xx, {_SEEN} FROM px GROUP BY ALL",
)


def _probe_top(family: str) -> str:
    """The 25 busiest rows of a family's summary, without the address's hits in all."""
    order = "requests DESC, " + ", ".join(f"{c} NULLS FIRST" for c in ("category", "site_id", "env", "client_ip", "path"))
    return f"""(SELECT category, rule_key, site_id, env, client_ip, coalesce(path, '') AS path, count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx,
        max(method) AS method, max(coalesce(query, '')) AS sample_query, max(match_reason) AS match_reason, {_SEEN}
        FROM px WHERE family = '{family}' GROUP BY 1, 2, 3, 4, 5, 6 ORDER BY {order} LIMIT 25)"""


_HITS = "(SELECT client_ip, count(*) AS n FROM w WHERE client_ip IS NOT NULL GROUP BY 1)"
for _family, _title in (("admin", "admin_probes"), ("injection", "injection_probes")):
    _on_window(
        _title, lambda w, f=_family: N.probe_summary(w, probes.probes(w), f),
        f"{_PROBES} SELECT t.*, coalesce(h.n, 0) AS total_ip_hits FROM {_probe_top(_family)} t LEFT JOIN {_HITS} h USING (client_ip)",
    )
_TOR = f"""(SELECT client_ip, risk_score, country_code, requests, status_4xx, status_5xx, first_seen, last_seen, coalesce(n, 0) AS admin_requests
    FROM (SELECT client_ip, i.risk_score, i.country_code, count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx, {_SEEN} FROM w JOIN ip i ON i.ip = w.client_ip WHERE i.is_tor_exit GROUP BY 1, 2, 3) t
    LEFT JOIN (SELECT client_ip, count(*) AS n FROM px WHERE family = 'admin' GROUP BY 1) a USING (client_ip) ORDER BY admin_requests DESC, requests DESC, client_ip LIMIT 25)"""
_add("tor_sources", lambda s, d: N.tor_sources(_window(s, d), probes.probes(_window(s, d)), A.ip_intel(s, d)), f"{EV}{_PROBES} SELECT * FROM {_TOR}")
_on_events(
    "error_facts", lambda e: probes.errors(e).select("id", "ts", "site_id", "env", "client_ip", "path", "status"),
    "SELECT id, ts, site_id, env, client_ip, path, status FROM ev WHERE status >= 400",
)
_on_events(
    "slow_facts", lambda e: probes.slow(e).select("id", "ts", "site_id", "env", "client_ip", "path", "request_time_ms"),
    "SELECT id, ts, site_id, env, client_ip, path, request_time_ms FROM ev WHERE request_time_ms >= 1000",
)


def _issues(s: SparkSession, d: str) -> DataFrame:
    return N.issue_report(_window(s, d), R.window(A.log_events(s, d), SINCE, UNTIL), A.ip_intel(s, d))


def _issues_sql() -> str:
    r4, r5 = "status_4xx / CAST(requests AS DOUBLE)", "status_5xx / CAST(requests AS DOUBLE)"
    part = lambda c, by, most: f"least({c} // {by}, {most})"
    held = lambda x, lo, hi: f"least(greatest({x}, {lo}), {hi})"
    slow = held("trunc(p95_request_time_ms / 100) + 20", 30, 90)
    base = "CASE category WHEN 'admin_tool' THEN 58 WHEN 'password_reset' THEN 55 WHEN 'admin_login' THEN 62 WHEN 'admin_path' THEN 42 ELSE 35 END"
    admin = f"{base} + CASE WHEN method = 'POST' THEN 8 ELSE 0 END + {part('requests', 3, 16)} + {part('(status_4xx + status_5xx)', 2, 12)}"
    base = "CASE category WHEN 'sql_injection' THEN 70 WHEN 'xss' THEN 64 WHEN 'secret_file' THEN 68 WHEN 'path_traversal' THEN 60 ELSE 55 END"
    injection = f"{base} + {part('requests', 4, 10)} + CASE WHEN status_5xx > 0 THEN 4 ELSE 0 END"
    tor = f"CASE WHEN admin_requests > 0 THEN {held('70 + least(5 * admin_requests, 20)', 70, 95)} ELSE 50 + {part('requests', 25, 20)} END"
    log = held(f"25 + {part('requests', 1000, 40)} + {part('severe', 250, 30)}", 25, 95)
    of = lambda own: "site_id, env" if own else "NULL AS site_id, NULL AS env"
    #: source, rule, has a site, kind and value of the actor, score, events, rate, when
    rules = [
        ("sites", "'site_5xx_rate'", True, "site", "concat_ws('/', site_id, env)", held(f"trunc({r5} * 100) + {part('status_5xx', 10, 35)}", 35, 100), "status_5xx", r5, f"status_5xx >= 10 AND {r5} >= 0.02"),
        ("sites", "'site_slow_p95'", True, "site", "concat_ws('/', site_id, env)", slow, "requests", "0.0", "p95_request_time_ms >= 3000 AND requests >= 100"),
        ("ips", "'ip_5xx_burst'", False, "ip", "client_ip", held(f"trunc({r5} * 70) + {part('status_5xx', 10, 30)}", 35, 100), "status_5xx", r5, f"requests >= 50 AND status_5xx >= 10 AND {r5} >= 0.1"),
        ("ips", "'ip_4xx_scan'", False, "ip", "client_ip", held(f"trunc({r4} * 60) + {part('status_4xx', 50, 30)}", 25, 90), "status_4xx", r4, f"status_4xx >= 100 AND {r4} >= 0.5"),
        ("agents", "'missing_user_agent'", False, "user_agent", "family", held(f"45 + {part('requests', 1000, 25)}", 45, 75), "requests", "0.0", "actor_type = 'missing' AND requests >= 100"),
        ("agents", "'tool_user_agent_volume'", False, "user_agent", "family", held(f"risk_score + {part('requests', 1000, 20)}", 40, 85), "requests", "0.0", "actor_type = 'tool' AND requests >= 100"),
        ("agents", "'unverified_crawler_claim'", False, "user_agent", "known_actor", held(f"45 + {part('requests', 1000, 25)}", 45, 80), "requests", "0.0", "actor_type = 'crawler' AND verified_ips = 0 AND requests >= 1000 AND known_actor <> ''"),
        ("slow", "'path_slow_p95'", True, "path", "path", slow, "requests", "0.0", "p95_request_time_ms >= 3000"),
        ("hot", "'path_5xx_hotspot'", True, "path", "path", held(f"trunc({r5} * 80) + {part('status_5xx', 5, 20)}", 30, 95), "status_5xx", r5, "true"),
        ("logs", "concat(log_type, '_log_activity')", False, "log", "log_type", log, "requests", "0.0", "severe > 0 OR contains(log_type, 'slow') OR requests >= 100"),
        (_probe_top("admin"), "rule_key", True, "ip", "client_ip", held(admin, 30, 92), "requests", "0.0", "NOT (category = 'admin_path' AND requests < 10 AND status_4xx < 5)"),
        (_probe_top("injection"), "rule_key", True, "ip", "client_ip", held(injection, 35, 90), "requests", "0.0", "true"),
        (_TOR, "'tor_exit_traffic'", False, "ip", "client_ip", tor, "requests", "0.0", "admin_requests > 0 OR requests >= 10"),
    ]
    branch = lambda src, rule, own, kind, value, score, events, rate, when: f"SELECT {rule} AS rule_key, {of(own)}, '{kind}' AS actor_type, {value} AS actor_value, CAST({score} AS INT) AS score, requests, {events} AS events, CAST({rate} AS DOUBLE) AS rate, first_seen, last_seen FROM {src} WHERE {when}"
    severe = "CASE WHEN severity IN ('critical', 'error') OR contains(log_type, 'error') THEN 1 ELSE 0 END"
    return f"""{EV}{_UA}{_PROBES}, sites AS ({_SITES}), ips AS (SELECT client_ip, {_FULL} FROM w WHERE client_ip IS NOT NULL GROUP BY 1 ORDER BY requests DESC, client_ip LIMIT 25),
        agents AS ({_AGENT}), slow AS ({_SLOW} ORDER BY p95_request_time_ms DESC, requests DESC, site_id, env, path LIMIT 25), hot AS ({_sql['path_5xx_hotspots'].removeprefix(EV)}),
        logs AS (SELECT log_type, count(*) AS requests, CAST(sum({severe}) AS BIGINT) AS severe, {_SEEN} FROM lg GROUP BY 1)
        SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS severity FROM ({' UNION ALL '.join(branch(*r) for r in rules)})"""


_add("issues", _issues, _issues_sql())

# ---- traffic

_TIMELINE = lambda n: f"SELECT * FROM (SELECT to_timestamp(floor(epoch(ts) / {n}) * {n}) AT TIME ZONE 'UTC' AS bucket_ts, count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx, {_BYTES} FROM w GROUP BY 1 ORDER BY bucket_ts DESC LIMIT 180) ORDER BY bucket_ts"
_on_window("timeline", lambda w: N.timeline(w, O.width(SINCE, UNTIL)), _TIMELINE(O.width(SINCE, UNTIL)))
_on_window("timeline_3h", lambda w: N.timeline(w, 10800), _TIMELINE(10800))
_on_window(
    "query_params", N.query_params,
    PARAMS("w") + f" SELECT param_family, param, param_value, count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx, {_CS} AS slow_requests, {_UNIQUE}, coalesce(avg(request_time_ms), 0.0) AS avg_request_time_ms, {_NEWEST}, {_SEEN} FROM pr GROUP BY 1, 2, 3 ORDER BY status_5xx DESC, slow_requests DESC, requests DESC, param_family, param, param_value LIMIT 25",
)
_ERROR = "id, ts, site_id, env, client_ip, method, path, query, status, user_agent"
_on_window(
    "recent_errors", lambda w: N.recent_errors(w, probes.errors(w).where("id % 13 <> 0"), limit=50).select(*_ERROR.split(", ")),
    f"SELECT {_ERROR} FROM w WHERE status >= 400 ORDER BY ts DESC, id DESC LIMIT 50",
)
_add(
    "recent_errors_with_intel", lambda s,
    d: N.recent_errors(_window(s, d), probes.errors(_window(s, d)), A.ip_intel(s, d), 50).select(
        *_ERROR.split(", "), "actor_type", "known_actor", "manual_action", "country_code", "verified_source",
    ),
    f"{EV} SELECT e.*, i.actor_type, i.known_actor, i.manual_action, i.country_code, {_VERIFIED} AS verified_source FROM (SELECT {_ERROR} FROM w WHERE status >= 400 ORDER BY ts DESC, id DESC LIMIT 50) e LEFT JOIN ip i ON i.ip = e.client_ip",
)
_on_window(
    "agent_detail_ips", lambda w: N.paged(N.agent_detail(w, "curl/8.7.1")["ips"], 10, 5, F.desc("requests"), F.asc_nulls_first("client_ip")),
    f"SELECT *, count(*) OVER () AS total FROM (SELECT client_ip, count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx, {_SEEN} FROM w WHERE user_agent = 'curl/8.7.1' GROUP BY 1) ORDER BY requests DESC, client_ip NULLS FIRST LIMIT 10 OFFSET 5",
)
_on_window(
    "ip_detail_hits", lambda w: N.ip_detail(w, "203.0.113.77")["url_hits"],
    f"SELECT site_id, env, method, path, query, status, user_agent, count(*) AS requests, coalesce(avg(request_time_ms), 0.0) AS avg_request_time_ms, {_P95} AS p95_request_time_ms, {_SEEN} FROM w WHERE client_ip = '203.0.113.77' GROUP BY ALL",
)
_on_window("ip_detail_sites", lambda w: N.ip_detail(w, "203.0.113.77")["sites"], f"SELECT site_id, env, {_FULL} FROM w WHERE client_ip = '203.0.113.77' GROUP BY ALL")
_on_window(
    "signal_detail_ips", lambda w: N.signal_detail(probes.probes(w), family="injection", category="sql_injection", env="live")["ips"],
    f"{_PROBES} SELECT client_ip, count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx, {_SEEN} FROM px WHERE family = 'injection' AND category = 'sql_injection' AND env = 'live' GROUP BY 1",
)

# ---- search

_SEARCH = "SELECT id, ts, site_id, path, status FROM w WHERE "
for _name, _text, _cond in (
    ("search_status", "status:>=500 path:/error*", "status >= 500 AND starts_with(path, '/error')"),
    ("search_or", 'site:site-1 method:post or "ahrefsbot" status:404', "(contains(site_id, 'site-1') AND method = 'POST') OR (contains(lower(coalesce(user_agent, '')), 'ahrefsbot') AND status = 404)"),
    ("search_severity", "severity:critical ip:203.0.113.1* browser:chrome", "status >= 500 AND starts_with(client_ip, '203.0.113.1') AND contains(lower(user_agent), 'chrome')"),
):
    _on_window(_name, lambda w, t=_text: search.search(w, t).select("id", "ts", "site_id", "path", "status"), _SEARCH + _cond)

# ---- ingest: raw lines, combined and indexed again

def _ingested(s: SparkSession, d: str) -> DataFrame:
    lines, _ = C.combine(A.access_lines(s, d))
    events, _ = C.index_access(lines)
    return events.select(
        "ts", "site_id", "env", "client_ip", "method", "path", "query", "status", "bytes_sent", "user_agent",
        F.coalesce("request_time_ms", F.lit(0)).alias("request_time_ms"),
    )


_OCTET = "CASE WHEN TRY_CAST(split_part(client_ip, '.', 4) AS INT) > 255 THEN NULL ELSE client_ip END AS client_ip"
_add(
    "ingest_access_lines", _ingested,
    f"{EV} SELECT DISTINCT date_trunc('second', ts) AS ts, site_id, env, {_OCTET}, method, path, query, status, bytes_sent, user_agent, coalesce(request_time_ms, 0) AS request_time_ms FROM ev",
)
_LOG_LINES_SQL = f"""WITH lg AS ({A.LOGS_SQL}) SELECT DISTINCT date_trunc('second', ts) AS ts, site_id, env, log_type,
    CASE log_type WHEN 'php-error' THEN CASE WHEN contains(message, 'error') THEN 'error' ELSE 'warning' END WHEN 'php-slow' THEN CASE WHEN contains(message, 'error') THEN 'error' ELSE 'info' END ELSE severity END AS severity,
    CASE log_type WHEN 'php-error' THEN concat('PHP Warning: ', message) WHEN 'nginx-error' THEN concat('1#0: ', message) WHEN 'php-slow' THEN concat('[pool www] ', message)
    ELSE concat(CAST(id AS VARCHAR), ' [', upper(left(severity, 1)), substr(severity, 2), '] ', message) END AS message FROM lg"""
_add("ingest_log_lines", lambda s, d: C.index_logs(C.combine(A.log_lines(s, d))[0]).select("ts", "site_id", "env", "log_type", "severity", "message"), _LOG_LINES_SQL)
_add("segment_manifest", lambda s, d: C.manifest(C.combine(A.access_lines(s, d), SINCE, UNTIL)[0], UNTIL).select("bucket_start", "bucket_end", "site_id", "env", "line_count", "min_ts", "max_ts", "status"), f"""{EV}, l AS (SELECT DISTINCT date_trunc('second', ts) AS ts, site_id, env, client_ip, method, path, query, status, bytes_sent, user_agent, request_time_ms FROM ev WHERE date_trunc('hour', ts) >= date_trunc('hour', TIMESTAMP '{SINCE}') AND date_trunc('hour', ts) < TIMESTAMP '{UNTIL}')
    SELECT *, CASE WHEN bucket_end + INTERVAL 15 MINUTE < TIMESTAMP '{UNTIL}' THEN 'finalized' ELSE 'rewritten' END AS status FROM (SELECT date_trunc('hour', ts) AS bucket_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS bucket_end, site_id, env, count(*) AS line_count, min(ts) AS min_ts, max(ts) AS max_ts FROM l GROUP BY ALL)""")

# ---- dashboard, alerts and audits

for _name, _run, _text in O.registered(EV, _WHEN, SINCE, UNTIL):
    _add(_name, _run, _text)


for _name, _run, _text in (*cases.registered(), *stored.registered(EV)):
    _add(_name, _run, _text)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
