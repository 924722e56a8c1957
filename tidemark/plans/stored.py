"""Registered queries of operators that work on stored tables: ingest state, intelligence, alerts, reports, jobs and audits.

The tables are made from the generic ``events`` table by SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import catalog, trust
from tidemark.operators import carry
from tidemark.operators import combine as C
from tidemark.operators import intel as I
from tidemark.operators import rollups as R
from tidemark.plans import adapter as A
from tidemark.plans import analysis as N
from tidemark.plans import overview as O
from tidemark.sources import logs

Found = tuple[str, Callable[[SparkSession, str], DataFrame], str]
SINCE, UNTIL, NOW = datetime(2024, 1, 5, 10, 7, 30), datetime(2024, 1, 24, 5, 13, 45), datetime(2024, 1, 20)
_C4, _C5 = "count(*) FILTER (WHERE status BETWEEN 400 AND 499)", "count(*) FILTER (WHERE status BETWEEN 500 AND 599)"
_SEEN = "min(ts) AS first_seen, max(ts) AS last_seen"
_ERRORS = f"count(*) AS requests, {_C4} AS status_4xx, {_C5} AS status_5xx"


def table(spark: SparkSession, sf_dir: str, columns: str, where: str = "true") -> DataFrame:
    """Columns over ``events``, as a stored table would have them."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(where).selectExpr(*columns.split("; "))


def sql(columns: str, where: str = "true") -> str:
    return f"(SELECT {columns.replace('; ', ', ')} FROM events WHERE {where})"


# ---- ingest state


def _new_rows(s: SparkSession, d: str) -> DataFrame:
    rows = A.access_events(s, d).select(F.col("id").cast("string").alias("fingerprint"), "ts")
    return C.new_rows(rows.where("fingerprint % 2 = 0"), rows.unionByName(rows))


def _spoilt(s: SparkSession, d: str) -> DataFrame:
    return A.access_lines(s, d).withColumn("raw", F.when(F.col("raw_line_no") % 17 == 0, "garbage").otherwise(F.col("raw")))


def _quarantined(s: SparkSession, d: str) -> DataFrame:
    return C.combine(_spoilt(s, d))[1].select("site_id", "raw_line_no", "raw", "reason")


def _carried(s: SparkSession, d: str) -> DataFrame:
    """Lines without a time between those of a PHP log, indexed."""
    return _indexed(C.line_times(_traced(s, d)))


def _traced(s: SparkSession, d: str) -> DataFrame:
    lines = A.log_lines(s, d).where("log_type = 'php-error'")
    trace = F.concat(F.lit("#0 trace "), "raw_line_no")
    return lines.withColumn("raw", F.when(F.col("raw_line_no") % 3 == 1, trace).otherwise(F.col("raw")))


def _indexed(timed: DataFrame) -> DataFrame:
    marked = timed.where("ts is not null").withColumn("fingerprint", F.col("raw_line_no").cast("string"))
    return C.index_logs(marked).select("fingerprint", "ts", "site_id", "severity", "message")


def _carried_in_pieces(s: SparkSession, d: str) -> DataFrame:
    """The same when the files come in three pieces, each with the last times of the one before."""
    lines, last, parts = _traced(s, d), s.createDataFrame([], carry.LAST), []
    for piece in range(3):
        part = lines.where(_piece(F.col("raw_line_no")) == piece)
        parts.append(carry.carried_times(part, last, 512))
        last = carry.last_times(part, last, 512)
    return _indexed(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _piece(line: Column) -> Column:
    """0 up to line 300, 1 up to line 4,000, 2 from there."""
    return F.when(line < 300, 0).when(line < 4000, 1).otherwise(2)


_CARRIED_SQL = f"""lines AS (SELECT *, CASE WHEN id % 3 <> 1 THEN date_trunc('second', ts) END AS own FROM ({A.LOGS_SQL}) WHERE log_type = 'php-error'),
    carried AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY site_id, env ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM lines)
    SELECT CAST(id AS VARCHAR) AS fingerprint, seen AS ts, site_id, CASE WHEN own IS NULL THEN 'info' WHEN contains(message, 'error') THEN 'error' ELSE 'warning' END AS severity,
    CASE WHEN own IS NULL THEN concat('#0 trace ', CAST(id AS VARCHAR)) ELSE concat('PHP Warning: ', message) END AS message FROM carried WHERE seen IS NOT NULL"""
_HOUR = ["bucket_start", "site_id", "env"]


def _manifests(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of the lines as first read, and with those that came later."""
    lines = A.access_lines(s, d)
    return C.manifest(C.combine(lines.where("raw_line_no % 97 <> 0"))[0], NOW), C.manifest(C.combine(lines)[0], NOW)


_LINES = "(SELECT DISTINCT date_trunc('second', ts) AS sec, site_id, env, client_ip, method, path, query, status, bytes_sent, user_agent, request_time_ms FROM ev WHERE {0})"
_CHANGED_SQL = f"""SELECT bucket_start, site_id, env FROM (SELECT date_trunc('hour', sec) AS bucket_start, site_id, env, count(*) AS n FROM {_LINES.format('true')} GROUP BY ALL) a
    LEFT JOIN (SELECT date_trunc('hour', sec) AS bucket_start, site_id, env, count(*) AS m FROM {_LINES.format('id % 97 <> 0')} GROUP BY ALL) b USING (bucket_start, site_id, env) WHERE m IS NULL OR n <> m"""


def _pending(s: SparkSession, d: str) -> DataFrame:
    _, all_ = _manifests(s, d)
    return C.pending_segments(all_.where(F.col("bucket_start") >= R.at(UNTIL)), all_, 400).select(*_HOUR)


_PENDING_SQL = f"""SELECT bucket_start, site_id, env FROM (SELECT DISTINCT date_trunc('hour', ts) AS bucket_start, site_id, env FROM ev)
    ORDER BY CASE WHEN bucket_start >= TIMESTAMP '{UNTIL}' THEN 0 ELSE 1 END, bucket_start, site_id, env LIMIT 400"""
_FILES = (
    "concat('site-', CAST(user_id % 5 AS STRING)) AS site_id; 'live' AS env; 'c' AS container_id; concat('log-', CAST(event_id AS STRING)) AS remote_path; "
    "event_id % {0} AS remote_size; CAST(user_id AS STRING) AS remote_mtime; CASE event_id % 4 WHEN 0 THEN 'failed' ELSE 'downloaded' END AS status; ts AS updated_at"
)
_BACKLOG = "event_id AS id; CASE event_id % 4 WHEN 0 THEN 'failed' ELSE 'downloaded' END AS status; CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS combined_at; CAST(user_id % 3 AS STRING) AS combined_sha256; CAST(user_id % 6 AS STRING) AS sha256; ts AS remote_mtime; ts AS downloaded_at"

# ---- intelligence

_PEOPLE = (
    "concat('203.0.113.', CAST(user_id AS STRING)) AS ip; CASE user_id % 8 WHEN 0 THEN 'crawl-1.GoogleBot.com.' WHEN 1 THEN 'ec2-1.compute.amazonaws.com' WHEN 2 THEN 'x.ahrefs.net' WHEN 3 THEN 'notgoogle.community' "
    "WHEN 4 THEN 'search.msn.com' WHEN 5 THEN 'a1.deploy.akamaitechnologies.com' ELSE 'host.example' END AS host; user_id % 2 = 0 AS forward_confirmed; "
    "CASE user_id % 5 WHEN 0 THEN 'Amazon.com, Inc.' WHEN 1 THEN 'Contabo GmbH' WHEN 2 THEN 'Yandex LLC' WHEN 3 THEN 'Some Net' ELSE NULL END AS asn_org; user_id % 7 = 3 AS is_tor_exit; "
    "CASE user_id % 11 WHEN 0 THEN 'Bingbot' WHEN 1 THEN 'AWS' WHEN 2 THEN 'CDN' ELSE NULL END AS provider_name; CASE user_id % 11 WHEN 0 THEN 'crawler' WHEN 1 THEN 'cloud' WHEN 2 THEN 'edge' ELSE NULL END AS provider_type; "
    "CASE WHEN user_id % 13 = 0 THEN 'Office' ELSE NULL END AS allow_label; CASE WHEN user_id % 13 = 0 THEN 'office' ELSE NULL END AS allow_type; "
    "(user_id % 9) * (user_id % 9) * (user_id % 9) * 30 AS requests; (user_id % 9) * (user_id % 9) * (user_id % 9) * (CASE WHEN user_id % 3 = 0 THEN 25 ELSE 2 END) AS status_4xx; user_id % 4 AS status_5xx"
)


def _assembled(s: SparkSession, d: str) -> DataFrame:
    people = table(s, d, _PEOPLE).distinct().withColumn("names", F.array("host"))
    return I.assemble(people).select("ip", "actor_type", "known_actor", "risk_score", "verified_actor", "is_datacenter", "provider_verified")


def _assembled_sql() -> str:
    """Each step over the last, as in ``intel.assemble``."""
    host, org = "rtrim(lower(trim(host)), '.')", "lower(trim(asn_org))"
    rented = "('cloud', 'datacenter', 'edge', 'hosting', 'vps')"
    volume = "CASE WHEN requests >= 10000 THEN 65 WHEN requests >= 1000 THEN 50 WHEN requests >= 100 THEN 35 ELSE 20 END"
    base = "CASE WHEN provider_type IN ('cloud', 'datacenter') THEN 55 WHEN provider_type = 'edge' THEN 45 ELSE 25 END"
    bad = "requests > 0 AND status_4xx + status_5xx >= 50 AND (status_4xx + status_5xx) / CAST(requests AS DOUBLE) >= 0.8 AND (official OR rented)"
    return f"""WITH p AS (SELECT DISTINCT * FROM {sql(_PEOPLE)}),
    a AS (SELECT *, coalesce({catalog.host_sql(host, 'actor_type')}, 'unknown') AS t, coalesce({catalog.host_sql(host, 'known_actor')}, '') AS k, coalesce({catalog.host_sql(host, 'risk_score')}, {volume}) AS r FROM p),
    b AS (SELECT * EXCLUDE (t, k, r), forward_confirmed AND k <> '' AND t NOT IN {rented} AS proven, CASE WHEN is_tor_exit THEN 'tor' ELSE t END AS t, CASE WHEN is_tor_exit THEN 'Tor exit' ELSE k END AS k, CASE WHEN is_tor_exit THEN greatest(r, 80) ELSE r END AS r FROM a),
    c AS (SELECT * EXCLUDE (t, k, r), CASE WHEN is_tor_exit THEN t ELSE coalesce({catalog.org_sql(org, 'actor_type')}, t) END AS t, CASE WHEN is_tor_exit THEN k ELSE coalesce({catalog.org_sql(org, 'known_actor')}, k) END AS k, CASE WHEN is_tor_exit THEN r ELSE coalesce({catalog.org_sql(org, 'risk_score')}, r) END AS r FROM b),
    e AS (SELECT * EXCLUDE (t, k, r), provider_name IS NOT NULL AS official, coalesce(provider_type, t) AS t, coalesce(provider_name, k) AS k, CASE WHEN provider_name IS NOT NULL THEN greatest(r, {base}) ELSE r END AS r FROM c),
    f AS (SELECT *, t IN {rented} AS rented FROM e), g AS (SELECT * EXCLUDE (r), CASE WHEN {bad} THEN greatest(r, 85) ELSE r END AS r FROM f)
    SELECT ip, CASE WHEN allow_label IS NOT NULL THEN allow_type ELSE t END AS actor_type, CASE WHEN allow_label IS NOT NULL THEN allow_label ELSE k END AS known_actor,
    CAST(CASE WHEN allow_label IS NOT NULL AND (r = 0 OR r > 10) THEN 10 ELSE r END AS INT) AS risk_score, allow_label IS NOT NULL OR proven AS verified_actor, rented AS is_datacenter, official AS provider_verified FROM g"""


_FRESH = "concat('203.0.113.', CAST(user_id AS STRING)) AS ip; CASE user_id % 2 WHEN 0 THEN 'crawler' ELSE NULL END AS actor_type; CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 50 AS INT) END AS risk_score"
_KEEP = ("ip", "actor_type", "manual_action", "risk_score")


def _merged_intel(s: SparkSession, d: str) -> DataFrame:
    return I.merge(A.ip_intel(s, d).where("risk_score % 2 = 0").select(*_KEEP), table(s, d, _FRESH, "user_id % 3 = 0").distinct()).select(*_KEEP)


_MERGED_SQL = f"""SELECT coalesce(s.ip, f.ip) AS ip, coalesce(f.actor_type, s.actor_type) AS actor_type, s.manual_action,
    CASE WHEN coalesce(s.manual_action, '') IN ('suspicious', 'verified', 'allowlisted') THEN s.risk_score ELSE coalesce(f.risk_score, s.risk_score) END AS risk_score
    FROM (SELECT * FROM ip WHERE risk_score % 2 = 0) s FULL JOIN (SELECT DISTINCT * FROM {sql(_FRESH, 'user_id % 3 = 0')}) f ON s.ip = f.ip"""
_ACTIONS = ("suspicious", "verified", "watch", "clear")


def _manual(s: SparkSession, d: str) -> DataFrame:
    ips = A.ip_intel(s, d).withColumn("label", F.concat(F.lit("  said\n by  "), F.col("actor_type"), F.lit(" ")))
    part = lambda name: ips.select(
        "ip", F.lit(name).alias("asked"),
        *(c.alias(n) for c, n in zip(trust.manual_action(name, F.col("label"), F.col("risk_score")), ("action", "label", "risk"), strict=True)),
    )
    out = part(_ACTIONS[0])
    for name in _ACTIONS[1:]:
        out = out.unionByName(part(name))
    return out


_MANUAL_SQL = " UNION ALL ".join(
    f"SELECT ip, '{a}' AS asked, {'NULL' if a == 'clear' else repr(a)} AS action, {'NULL' if a == 'clear' else chr(39) + 'said by ' + chr(39) + ' || actor_type'} AS label, {r} AS risk FROM ip"
    for a, r in zip(_ACTIONS, ("greatest(risk_score, 80)", "least(risk_score, 10)", "risk_score", "risk_score"), strict=True)
).replace("'said by ' || actor_type", "trim('said by ' || actor_type)")


def _suspicious(s: SparkSession, d: str) -> DataFrame:
    c = {n: F.col(n) for n in ("manual_action", "actor_type", "known_actor", "is_tor_exit", "is_datacenter", "requests", "status_4xx", "status_5xx", "risk_score")}
    busy = N.top_ips(A.access_events(s, d), A.ip_intel(s, d), limit=100_000)
    test = trust.suspicious_ip(
        c["manual_action"], c["actor_type"], c["known_actor"], c["is_tor_exit"], F.lit(""), c["is_datacenter"], c["requests"], c["status_4xx"],
        c["status_5xx"], c["risk_score"],
    )
    return busy.select("client_ip", test.alias("suspicious"))


_BAD = "coalesce(status_4xx, 0) + coalesce(status_5xx, 0)"
_SUSPICIOUS_SQL = f"""SELECT client_ip, coalesce(manual_action, '') IN ('suspicious', 'watch') OR actor_type = 'tor' OR known_actor = 'Tor exit' OR is_tor_exit
    OR ((actor_type IN ('cloud', 'datacenter') OR is_datacenter) AND requests >= 100 AND {_BAD} >= 50 AND ({_BAD}) / CAST(requests AS DOUBLE) >= 0.8) OR risk_score >= 70 AS suspicious
    FROM (SELECT client_ip, {_ERRORS} FROM ev WHERE client_ip IS NOT NULL GROUP BY 1) e JOIN ip ON ip.ip = e.client_ip"""


def _refresh(s: SparkSession, d: str) -> DataFrame:
    return I.refresh_candidates(R.build(A.access_events(s, d), "rollup_ip_1h"), 40)


def _backfill(s: SparkSession, d: str) -> DataFrame:
    known = O.dimension(A.access_events(s, d).where("id % 2 = 0"), "client_ip")
    return I.backfill_candidates(known, A.ip_intel(s, d), 100)


_BACKFILL_SQL = f"""SELECT ip, CAST(sum(n) AS BIGINT) AS requests, max(last_seen) AS last_seen FROM (SELECT client_ip AS ip, count(*) AS n, max(ts) AS last_seen FROM ev WHERE id % 2 = 0 AND client_ip IS NOT NULL GROUP BY 1
    UNION ALL SELECT ip, 0, NULL FROM ip) GROUP BY 1 ORDER BY requests DESC, last_seen DESC NULLS LAST, ip LIMIT 100"""
_BLOCKS = [("203.0.113.0/25", None, "DE", "BE", "Berlin"), ("203.0.113.128/25", "FR", "DE", None, "Paris"), ("203.0.113.200/29", None, None, None, None)]


def _located(s: SparkSession, d: str) -> DataFrame:
    blocks = s.createDataFrame(_BLOCKS, "cidr string, country_code string, registered_country_code string, region string, city string")
    return I.located(A.ip_intel(s, d).select("ip"), blocks)


_OCTET = "CAST(split_part(ip, '.', 4) AS INT)"
_LOCATED_SQL = f"""SELECT ip, CASE WHEN {_OCTET} < 128 THEN 'DE' WHEN {_OCTET} BETWEEN 200 AND 207 THEN NULL WHEN {_OCTET} < 256 THEN 'FR' END AS country_code, CASE WHEN {_OCTET} < 128 THEN 'BE' END AS region,
    CASE WHEN {_OCTET} < 128 THEN 'Berlin' WHEN {_OCTET} BETWEEN 200 AND 207 THEN NULL WHEN {_OCTET} < 256 THEN 'Paris' END AS city FROM ip"""

# ---- readiness and audits

_MARK = "rollups_1h_backfilled_at"


def _marked(s: SparkSession, d: str) -> DataFrame:
    return A.access_events(s, d).withColumn(_MARK, F.when(F.col("id") % 401 != 3, F.col("ts")))


def _readiness(s: SparkSession, d: str) -> DataFrame:
    """Answers for the tables as they are, and with a gap in each."""
    events = A.access_events(s, d)
    minutes, statuses, params = R.build(events, "rollup_1m"), R.build(events, "rollup_status_1h"), R.build_params(events)
    checks = [
        ("dimension", R.dimension_ready(events.withColumn(_MARK, F.col("ts")), SINCE, UNTIL), R.dimension_ready(_marked(s, d), SINCE, UNTIL)),
        ("status", R.same_total(minutes, statuses, SINCE, UNTIL), R.same_total(minutes, statuses.where("status <> 404"), SINCE, UNTIL)),
        ("timeline", R.timeline_ready(events, minutes, SINCE, UNTIL), R.timeline_ready(events, minutes.where("site_id <> 'site-1'"), SINCE, UNTIL)),
        ("params", R.params_ready(events, params, SINCE, UNTIL), R.params_ready(events, params.where("site_id <> 'site-1'"), SINCE, UNTIL)),
    ]
    return s.createDataFrame(checks, "name string, whole boolean, gap boolean")


_INNER = "ts >= TIMESTAMP '2024-01-05 11:00:00' AND ts < TIMESTAMP '2024-01-24 05:00:00'"
_READINESS_SQL = f"""SELECT 'dimension' AS name, true AS whole, count(*) FILTER (WHERE id % 401 = 3) = 0 AS gap FROM ev WHERE {_INNER} UNION ALL SELECT 'status', true, count(*) FILTER (WHERE status = 404) = 0 FROM ev WHERE {_INNER}
    UNION ALL SELECT 'timeline', true, count(*) FILTER (WHERE site_id = 'site-1') = 0 FROM ev WHERE {_INNER} UNION ALL SELECT 'params', true, count(*) FILTER (WHERE site_id = 'site-1' AND coalesce(query, '') <> '') = 0 FROM ev WHERE {_INNER}"""


def _read_audit(s: SparkSession, d: str) -> DataFrame:
    events = A.access_events(s, d)
    facts = events.where("status >= 400 and id % 10 <> 0")
    got = O.read_audit(_marked(s, d), facts, R.build(events, "rollup_1m"), R.build(events, "rollup_status_1h"), SINCE, UNTIL)
    return s.createDataFrame([(k, str(v)) for k, v in got.items()], "item string, value string")


_READ_AUDIT_SQL = f"""c AS (SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05 10:08:00' OR ts >= TIMESTAMP '2024-01-24 05:13:00') AS m, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05 11:00:00' OR ts >= TIMESTAMP '2024-01-24 05:00:00') AS h,
    count(*) FILTER (WHERE status >= 400 AND id % 10 = 0) AS g, count(*) AS n, count(*) FILTER (WHERE id % 401 = 3 AND {_INNER}) = 0 AS ready FROM w)
    SELECT unnest(['access_analysis_source', 'traffic_source', 'overview_source', 'recent_errors_source', 'minute_edge_events', 'hour_edge_events', 'raw_gap_rows', 'expected_raw_rows']) AS item,
    unnest([CASE WHEN ready THEN 'dimension rollups + hour edge events' ELSE 'raw access_events' END, CASE WHEN ready THEN 'dimension rollups + hour edge events' ELSE 'raw access_events' END, 'rollup_1m + minute edge events',
    CASE WHEN g > 0 THEN 'error facts + raw gap rows' ELSE 'error facts' END, CAST(m AS VARCHAR), CAST(h AS VARCHAR), CAST(g AS VARCHAR), CAST(CASE WHEN ready THEN greatest(m, h) ELSE n END AS VARCHAR)]) AS value FROM c"""


def _remaining(s: SparkSession, d: str) -> DataFrame:
    e = _marked(s, d)
    return O.backfill_remaining(e, e.where("status >= 400 and id % 3 = 0"), e.where("request_time_ms >= 1000 and id % 5 = 0"))


_IMPORTED = "CASE WHEN event_id % 7 = 0 THEN event_id % 3 ELSE NULL END AS temporary_import_id"
_IMPORTS = [(0, datetime(2024, 1, 10)), (1, datetime(2024, 3, 1)), (2, datetime(2024, 1, 20))]


def _imported(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = A.access_events(s, d).withColumn("temporary_import_id", F.when(F.col("id") % 7 == 0, F.col("id") % 3))
    return events, s.createDataFrame(_IMPORTS, "id long, expires_at timestamp_ntz")


def _rollup_after_expiry(s: SparkSession, d: str) -> DataFrame:
    events, imports = _imported(s, d)
    return O.rollup_without_expired(R.build(events, "rollup_path_1h"), "rollup_path_1h", events, imports, NOW)


# ---- alerts

_ALERT = "'path_5xx' AS rule_key; concat('site-', CAST(user_id % 5 AS STRING)) AS site_id; 'live' AS env; 'path' AS actor_type; event_type AS actor_value"
_ALERT_KEYS = "rule_key, site_id, env, actor_type, actor_value"


def _alerts(s: SparkSession, d: str, where: str) -> DataFrame:
    rows = table(s, d, f"{_ALERT}; event_id; ts", where)
    return rows.groupBy(*_ALERT_KEYS.split(", ")).agg((F.count("*") % 90).cast("int").alias("score"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def _merged_alerts(s: SparkSession, d: str) -> DataFrame:
    return O.merge_alerts(_alerts(s, d, "event_id % 2 = 0 AND user_id % 5 < 4"), _alerts(s, d, "event_id % 3 = 0 AND user_id % 5 > 0"))


_OPEN_SQL = lambda where: f"(SELECT {_ALERT_KEYS}, CAST(count(*) % 90 AS INT) AS score, {_SEEN} FROM {sql(_ALERT + '; ts', where)} GROUP BY ALL)"
_MERGED_ALERTS_SQL = f"""SELECT {_ALERT_KEYS}, coalesce(f.score, o.score) AS score, least(o.first_seen, f.first_seen) AS first_seen, greatest(o.last_seen, f.last_seen) AS last_seen
    FROM {_OPEN_SQL('event_id % 2 = 0 AND user_id % 5 < 4')} o FULL JOIN {_OPEN_SQL('event_id % 3 = 0 AND user_id % 5 > 0')} f USING ({_ALERT_KEYS})"""
_SENT = "event_id AS alert_id; CASE event_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS severity; ts AS last_seen"


def _notifications(s: SparkSession, d: str) -> DataFrame:
    sent = table(s, d, "event_id AS alert_id; CASE WHEN event_id % 2 = 0 THEN 'delivered' ELSE 'failed' END AS status", "event_id % 3 < 2")
    return O.notifications(table(s, d, _SENT), sent, "medium", 60).select("alert_id", "severity", "last_seen")


_NOTIFICATIONS_SQL = f"""SELECT alert_id, severity, last_seen FROM {sql(_SENT)} WHERE NOT (alert_id % 3 < 2 AND alert_id % 2 = 0) AND lower(severity) IN ('critical', 'high', 'medium')
    ORDER BY CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END DESC, last_seen DESC, alert_id LIMIT 60"""
_CASE = {"rule_key": "path_5xx_hotspot", "actor_type": "path", "actor_value": "/error/1", "first_seen": SINCE, "last_seen": UNTIL}


def _alert_events(s: SparkSession, d: str) -> DataFrame:
    return O.alert_events(A.access_events(s, d), _CASE).select("id", "ts", "site_id", "status")


# ---- reports

_SIGNALS = "event_id AS id; CASE event_id % 4 WHEN 0 THEN 'admin_login' WHEN 1 THEN 'probe_xss' WHEN 2 THEN 'admin_tool' ELSE 'probe_sql' END AS rule_key; user_id AS requests"
_FOUND = "event_id AS id; CASE event_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity"
_REPORTS = (
    "event_id AS id; CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('site-', CAST(user_id % 5 AS STRING)) END AS site_id; CASE event_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'custom' END AS report_type; "
    "ts AS created_at; concat('{\"report_summary\": \"', event_type, '\"}') AS input"
)


def _window(s: SparkSession, d: str) -> DataFrame:
    return R.window(A.access_events(s, d), SINCE, UNTIL)


def _summary(s: SparkSession, d: str) -> DataFrame:
    tor = table(s, d, "user_id AS requests", "user_id % 7 = 3")
    return O.report_summary(N.totals(_window(s, d)).select("requests", "unique_ips"), table(s, d, _FOUND), table(s, d, _SIGNALS), tor)


_KIND = lambda k: f"count(*) FILTER (WHERE severity = '{k}') AS {k}_issues"
_SUM = lambda p, n: f"CAST(coalesce(sum(requests) FILTER (WHERE starts_with(rule_key, '{p}')), 0) AS BIGINT) AS {n}"
_SUMMARY_SQL = f"""SELECT * FROM (SELECT count(*) AS requests, count(DISTINCT client_ip) AS unique_ips FROM w), (SELECT count(*) AS issue_count, {', '.join(map(_KIND, ('critical', 'high', 'medium', 'low')))} FROM {sql(_FOUND)}),
    (SELECT {_SUM('admin_', 'admin_probe_requests')}, {_SUM('probe_', 'injection_probe_requests')} FROM {sql(_SIGNALS)}), (SELECT CAST(coalesce(sum(user_id), 0) AS BIGINT) AS tor_requests FROM events WHERE user_id % 7 = 3)"""


def _charts(s: SparkSession, d: str) -> DataFrame:
    w = _window(s, d)
    agents = w.groupBy(F.coalesce("user_agent", F.lit("none")).alias("actor_type")).agg(F.count("*").alias("requests"))
    charts = O.report_charts(N.timeline(w, 3600), N.status_breakdown(w), N.site_summary(w), N.top_ips(w), agents, N.slow_paths(w), table(s, d, _SIGNALS))
    out = None
    for name, rows in charts.items():
        part = rows.withColumn("chart", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_PICK = lambda name, label, value, second, src, n: f"SELECT * FROM (SELECT {label} AS label, CAST({value} AS DOUBLE) AS value, CAST({second} AS DOUBLE) AS secondary, '{name}' AS chart FROM {src} ORDER BY value DESC, label LIMIT {n})"
_BY = lambda keys, where="true": f"(SELECT {keys}, {_ERRORS}, percentile_cont(0.95) WITHIN GROUP (ORDER BY request_time_ms) AS p95 FROM w WHERE {where} GROUP BY ALL)"
_CHARTS_SQL = " UNION ALL ".join([
    f"SELECT strftime(bucket_ts, '%Y-%m-%d %H:%M:%S') AS label, CAST(requests AS DOUBLE) AS value, CAST(status_4xx + status_5xx AS DOUBLE) AS secondary, 'traffic_timeline' AS chart FROM (SELECT date_trunc('hour', ts) AS bucket_ts, {_ERRORS} FROM w GROUP BY 1 ORDER BY 1 DESC LIMIT 120)",
    "SELECT * FROM (SELECT concat(CAST(status // 100 AS VARCHAR), 'xx') AS label, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS secondary, 'status_mix' AS chart FROM w WHERE status BETWEEN 200 AND 599 GROUP BY 1)",
    _PICK("site_traffic", "concat_ws('/', site_id, env)", "requests", "status_5xx", _BY("site_id, env"), 12), _PICK("source_ips", "client_ip", "requests", "status_5xx", f"(SELECT * FROM {_BY('client_ip', 'client_ip IS NOT NULL')} ORDER BY requests DESC, client_ip LIMIT 25)", 12),
    _PICK("user_agent_classes", "agent", "requests", "NULL", _BY("coalesce(user_agent, 'none') AS agent"), 10), _PICK("security_signals", "rule_key", "requests", "NULL", f"(SELECT rule_key, sum(requests) AS requests FROM {sql(_SIGNALS)} GROUP BY 1)", 12),
    _PICK("slow_paths", "path", "p95", "requests", f"(SELECT * FROM {_BY('site_id, env, coalesce(path, chr(0)) AS path', 'request_time_ms IS NOT NULL')} WHERE requests >= 20 ORDER BY p95 DESC, requests DESC, site_id, env, path LIMIT 25)", 12),
])


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return O.report_catalog(table(s, d, _REPORTS), "site-1", "weekly", 20, 5).select("id", "site_id", "report_type", "created_at", "report_summary", "total")


_ONE = "(site_id = 'site-1' OR site_id IS NULL)"
_CATALOG_SQL = f"""SELECT id, site_id, report_type, created_at, json_extract_string(input, '$.report_summary') AS report_summary, count(*) OVER () AS total FROM {sql(_REPORTS)} WHERE {_ONE} AND report_type = 'weekly'
    ORDER BY created_at DESC, id LIMIT 20 OFFSET 5"""

# ---- jobs, details and keys

_JOBS = "event_id AS id; CASE user_id % 3 WHEN 0 THEN 'Pipeline' WHEN 1 THEN 'pipeline-late' ELSE 'other' END AS name; CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status; ts AS started_at"
_STEPS = "concat('job-', CAST(user_id % 4 AS STRING)) AS job_name; event_type AS step_name; CAST(floor(value * 10) AS BIGINT) AS duration_ms"
_CYCLE_SQL = f"""SELECT name, max(CASE WHEN n = 1 THEN status END) AS latest_status, max(CASE WHEN n = 1 THEN started_at END) AS latest_at, max(CASE WHEN n = 2 THEN status END) AS previous_status, max(CASE WHEN n = 2 THEN started_at END) AS previous_at
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY started_at DESC, id) AS n FROM {sql(_JOBS)} WHERE contains(lower(name), 'pipeline')) GROUP BY 1"""
_KEY = "CAST(('0x' || left(md5({0}), 15)) AS BIGINT)"


def _keyed(s: SparkSession, d: str) -> DataFrame:
    events = A.access_events(s, d)
    tables = {c: O.dimension(events.where("id % 3 <> 0"), c).withColumn("key", O.value_key(F.col(c))) for c in ("path", "client_ip")}
    return O.keyed(events, tables).select("id", "path_id", "client_ip_id")


_KEYED_SQL = f"""SELECT id, CASE WHEN path IN (SELECT path FROM ev WHERE id % 3 <> 0) THEN {_KEY.format('path')} END AS path_id,
    CASE WHEN client_ip IN (SELECT client_ip FROM ev WHERE id % 3 <> 0 AND client_ip IS NOT NULL) THEN {_KEY.format('client_ip')} END AS client_ip_id FROM ev"""


def _record(s: SparkSession, d: str) -> DataFrame:
    """Found by its key, by its text, and by its first characters."""
    stored = O.dimension(A.access_events(s, d), "user_agent").withColumn("key", F.length("user_agent"))
    part = lambda how, *a, **k: N.agent_record(stored, *a, **k).select(F.lit(how).alias("how"), "user_agent", "request_count")
    return part("key", "none", key=10).unionByName(part("text", "sqlmap/1.8.7")).unionByName(
        part("start", "python-of-another-kind", prefix=6)
    ).unionByName(part("nothing", "none"))


_RECORD_SQL = "SELECT how, user_agent, count(*) AS request_count FROM (SELECT unnest(['key', 'text', 'start']) AS how, unnest(['curl/8.7.1', 'sqlmap/1.8.7', 'python-requests/2.32.3']) AS user_agent) JOIN ev USING (user_agent) GROUP BY ALL"


def _ip_rollups(s: SparkSession, d: str) -> dict[str, DataFrame]:
    events = A.access_events(s, d)
    edges = lambda n: A.rollup_store(s, d, n).rows(n, SINCE, UNTIL)
    return N.ip_detail_from_rollups(edges("rollup_ip_1h"), edges("rollup_ip_path_1h"), edges("rollup_ip_user_agent_1h"), "203.0.113.77")


_DETAIL = f"{_ERRORS}, CAST(coalesce(sum(bytes_sent), 0) AS BIGINT) AS bytes_sent, {_SEEN}"


def registered(ev: str) -> Iterator[Found]:
    yield "new_rows", _new_rows, f"{ev} SELECT CAST(id AS VARCHAR) AS fingerprint, ts FROM ev WHERE id % 2 = 1"
    yield "quarantined_lines", _quarantined, f"{ev} SELECT site_id, id AS raw_line_no, 'garbage' AS raw, 'timestamp_parse_failed' AS reason FROM ev WHERE id % 17 = 0"
    yield "carried_log_lines", _carried, f"WITH {_CARRIED_SQL}"
    yield "carried_log_lines_in_pieces", _carried_in_pieces, f"WITH {_CARRIED_SQL}"
    yield "changed_segments", lambda s, d: C.changed_segments(*_manifests(s, d)).select(*_HOUR), f"{ev} {_CHANGED_SQL}"
    yield "pending_segments", _pending, f"{ev} {_PENDING_SQL}"
    seen, done = _FILES.format(11), _FILES.format(13)
    names = ("site_id", "remote_path", "remote_size", "remote_mtime")
    yield "changed_files", lambda s, d: logs.changed_files(
        table(s, d, done, "event_id % 5 > 0"), table(s, d, seen).drop("status", "updated_at"),
    ).select(*names), f"SELECT {', '.join(names)} FROM {sql(seen + '; event_id')} WHERE NOT (event_id % 5 > 0 AND event_id % 4 > 0 AND event_id % 11 = event_id % 13)"
    backlog = f"SELECT id FROM {sql(_BACKLOG)} WHERE status = 'downloaded' AND (combined_at IS NULL OR combined_sha256 <> sha256"
    yield "combine_backlog", lambda s, d: logs.combine_backlog(table(s, d, _BACKLOG)).select("id"), f"{backlog} OR true)"
    yield "combine_backlog_since", lambda s, d: logs.combine_backlog(table(s, d, _BACKLOG), str(NOW)).select("id"), f"{backlog} OR remote_mtime >= TIMESTAMP '{NOW}')"
    yield "file_stats", lambda s, d: O.file_stats(table(s, d, seen), NOW), f"SELECT status, count(*) AS files, count(*) FILTER (WHERE status = 'failed' AND updated_at >= TIMESTAMP '{NOW}') AS failed_recent FROM {sql(seen)} GROUP BY 1"

    yield "ip_assembly", _assembled, _assembled_sql()
    yield "ip_merge", _merged_intel, f"{ev} {_MERGED_SQL}"
    yield "ip_manual_actions", _manual, f"{ev} {_MANUAL_SQL}"
    yield "suspicious_ips", _suspicious, f"{ev} {_SUSPICIOUS_SQL}"
    yield "refresh_candidates", _refresh, f"{ev} SELECT client_ip AS ip, {_ERRORS} FROM ev WHERE client_ip IS NOT NULL GROUP BY 1 ORDER BY requests DESC, ip LIMIT 40"
    yield "backfill_candidates", _backfill, f"{ev} {_BACKFILL_SQL}"
    yield "located_ips", _located, f"{ev} {_LOCATED_SQL}"

    yield "readiness", _readiness, f"{ev} {_READINESS_SQL}"
    yield "read_audit", _read_audit, f"{ev}, {_READ_AUDIT_SQL}"
    yield "backfill_remaining", _remaining, f"{ev} SELECT count(*) AS remaining FROM ev WHERE id % 401 = 3 OR (status >= 400 AND id % 3 <> 0) OR (request_time_ms >= 1000 AND id % 5 <> 0)"
    yield "table_audit", lambda s, d: O.table_audit(
        {"access_events": (A.access_events(s, d), "ts"), "log_events": (A.log_events(s, d).where("id % 4 = 0"), "ts")}
    ), f"{ev} SELECT 'access_events' AS \"table\", count(*) AS rows, min(ts) AS oldest, max(ts) AS newest FROM ev UNION ALL SELECT 'log_events', count(*), min(ts), max(ts) FROM ev WHERE id % 4 = 0"
    kept = f"id % 7 <> 0 OR id % 3 IN (SELECT i FROM (VALUES (0, TIMESTAMP '2024-01-10'), (1, TIMESTAMP '2024-03-01'), (2, TIMESTAMP '2024-01-20')) AS v(i, t) WHERE t > TIMESTAMP '{NOW}')"
    yield "without_expired_imports", lambda s, d: O.without_expired_imports(*_imported(s, d), NOW).select("id"), f"{ev} SELECT id FROM ev WHERE {kept}"
    yield "rollup_without_expired_imports", _rollup_after_expiry, f"{ev} SELECT date_trunc('hour', ts) AS bucket_ts, site_id, env, path, {_DETAIL} FROM ev WHERE path IS NOT NULL AND ({kept}) GROUP BY ALL"
    yield "retained_events", lambda s, d: O.retained(_imported(s, d)[0], NOW).select("id"), f"{ev} SELECT id FROM ev WHERE ts >= TIMESTAMP '{NOW}' OR id % 7 = 0"

    yield "merged_alerts", _merged_alerts, _MERGED_ALERTS_SQL
    yield "alert_events", _alert_events, f"{ev} SELECT id, ts, site_id, status FROM ev WHERE path = '/error/1' AND status BETWEEN 500 AND 599 AND ts BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'"
    yield "notifications", _notifications, _NOTIFICATIONS_SQL
    yield "report_summary", _summary, f"{ev} {_SUMMARY_SQL}"
    yield "report_charts", _charts, f"{ev} {_CHARTS_SQL}"
    yield "report_catalog", _catalog, _CATALOG_SQL
    yield "report_types", lambda s, d: O.report_types(table(s, d, _REPORTS), "site-1"), f"SELECT report_type, count(*) AS reports FROM {sql(_REPORTS)} WHERE {_ONE} GROUP BY 1"

    yield "job_counts", lambda s, d: O.job_counts(table(s, d, _JOBS), 100), f"SELECT status, count(*) AS n FROM (SELECT * FROM {sql(_JOBS)} ORDER BY started_at DESC, id LIMIT 100) GROUP BY 1"
    yield "slow_phases", lambda s, d: O.slow_phases(table(s, d, _STEPS)), f"SELECT job_name, step_name, count(*) AS runs, avg(duration_ms) AS avg_ms, max(duration_ms) AS max_ms FROM {sql(_STEPS)} GROUP BY 1, 2 ORDER BY max_ms DESC, job_name, step_name LIMIT 8"
    yield "cycle_summary", lambda s, d: O.cycle_summary(table(s, d, _JOBS)), _CYCLE_SQL
    yield "dimension_keys", _keyed, f"{ev} {_KEYED_SQL}"
    yield "agent_record", _record, f"{ev} {_RECORD_SQL}"
    for part, keys in (("sites", "site_id, env"), ("paths", "path"), ("user_agents", "user_agent")):
        where = " AND user_agent IS NOT NULL" * (part == "user_agents")
        yield f"ip_detail_{part}_from_rollups", lambda s, d, p=part: _ip_rollups(s, d)[p], f"{ev} SELECT {keys}, {_DETAIL} FROM w WHERE client_ip = '203.0.113.77'{where} GROUP BY ALL"
    yield "tor_detail_ips", lambda s, d: N.tor_detail(
        _window(s, d), A.ip_intel(s, d), env="live",
    )["ips"], f"{ev} SELECT client_ip, {_ERRORS}, {_SEEN} FROM w JOIN ip ON ip.ip = w.client_ip WHERE is_tor_exit AND env = 'live' GROUP BY 1"
    yield "tor_detail_summary", lambda s, d: N.tor_detail(_window(s, d), A.ip_intel(s, d))["summary"], f"{ev} SELECT count(*) AS requests, count(DISTINCT client_ip) AS unique_ips, {_C4} AS status_4xx, {_C5} AS status_5xx, {_SEEN} FROM w JOIN ip ON ip.ip = w.client_ip WHERE is_tor_exit"
