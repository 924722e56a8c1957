"""Access analysis and traffic investigation: report queries over a window of access events.

Every function takes the events of the window (see ``rollups.window``) and returns a DataFrame; ties are broken
by keys, so that every top-k is repeatable. ``intel`` is a table of IP intelligence, ``logs`` of log events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.params import with_params
from tidemark.functions.trust import verified_source, verified_source_loose
from tidemark.functions.useragent import FIELDS, analyse
from tidemark.functions import probes as P
from tidemark.operators.quantiles import Measure, percentiles, summary
from tidemark.operators.rollups import count_if, histogram_p95
from tidemark.sources.scratch import kept

INTEL = (
    "reverse_dns", "asn", "asn_org", "network", "country_code", "known_actor", "actor_type", "risk_score", "forward_confirmed", "verified_actor",
    "is_datacenter", "is_tor_exit", "provider_verified", "provider_id", "provider_name", "manual_label", "manual_action",
)


def _class(n: int) -> Column:
    return count_if(F.col("status").between(100 * n, 100 * n + 99)).alias(f"status_{n}xx")


def _slow() -> Column:
    return count_if(F.col("request_time_ms") >= 1000).alias("slow_requests")


def _bytes() -> Column:
    return F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent")


def _average() -> Column:
    return F.coalesce(F.avg("request_time_ms"), F.lit(0.0)).alias("avg_request_time_ms")


def _measures(*names: str) -> dict[str, Measure]:
    """Additive measures by name, with those that an average of durations needs."""
    every = {
        "requests": Measure(F.count("*")), "status_4xx": Measure(_class(4)), "status_5xx": Measure(_class(5)), "slow_requests": Measure(_slow()), "bytes_sent": Measure(_bytes()),
        "empty_user_agents": Measure(count_if(F.coalesce("user_agent", F.lit("")) == "")), "first_seen": Measure(F.min("ts"), "min"), "last_seen": Measure(F.max("ts"), "max"),
        "__timed": Measure(F.count("request_time_ms")), "__ms": Measure(F.sum("request_time_ms")),
    }
    return {n: every[n] for n in (*names, "__timed", "__ms")}


def _with_average(rows: DataFrame) -> DataFrame:
    """Average and percentile of durations, zero without any."""
    return rows.withColumns({"avg_request_time_ms": rate("__ms", "__timed"), "p95_request_time_ms": F.coalesce("p95_request_time_ms", F.lit(0.0))}).drop("__ms", "__timed")


_P95 = ("request_time_ms", "p95_request_time_ms")


def _seen() -> tuple[Column, Column]:
    return F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")


def rate(part: str, total: str = "requests") -> Column:
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def totals(events: DataFrame) -> DataFrame:
    """One row of counters, latencies and rates."""
    own = _measures("requests", "status_4xx", "status_5xx", "empty_user_agents", "slow_requests", "bytes_sent")
    row = summary(events, [], _P95[0], own, _P95[1], ("client_ip", "user_agent")).withColumnsRenamed({"unique_client_ip": "unique_ips", "unique_user_agent": "unique_user_agents"})
    row = _with_average(row.withColumns({n: F.coalesce(n, F.lit(0)) for n in (*own, "unique_ips", "unique_user_agents")}))
    return row.withColumns({f"{n}_rate": rate(n) for n in ("status_4xx", "status_5xx", "slow_requests", "empty_user_agents")})


def totals_from_minutes(minutes: DataFrame) -> DataFrame:
    """The additive counters of ``totals`` from minute rows (``rollup_with_edges``)."""
    names = (
        "requests", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "bytes_sent", "request_time_count", "request_time_sum_ms",
        "slow_requests", "empty_user_agents",
    )
    row = minutes.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return row.withColumns(
        {
            "avg_request_time_ms": rate("request_time_sum_ms", "request_time_count"), "status_4xx_rate": rate("status_4xx"),
            "status_5xx_rate": rate("status_5xx"),
        }
    )


def site_summary(events: DataFrame) -> DataFrame:
    own = _measures("requests", "status_4xx", "status_5xx", "first_seen", "last_seen")
    rows = _with_average(summary(events, ["site_id", "env"], _P95[0], own, _P95[1], ("client_ip",)).withColumnRenamed("unique_client_ip", "unique_ips"))
    return rows.withColumns({"status_4xx_rate": rate("status_4xx"), "status_5xx_rate": rate("status_5xx")})


def site_summary_from_rollups(minutes: DataFrame, ips: DataFrame, latency: DataFrame) -> DataFrame:
    """The same from rollup rows: exact counters and addresses, p95 as the upper edge of its histogram bucket;
    seen times are those of the minutes."""
    keys = ["site_id", "env"]
    rows = minutes.groupBy(*keys).agg(
        *(F.sum(n).alias(n) for n in ("requests", "status_4xx", "status_5xx", "request_time_count", "request_time_sum_ms")),
        F.min("bucket_ts").alias("first_seen"), (F.max("bucket_ts") + F.expr("interval 1 minute")).alias("last_seen"),
    )
    unique = ips.groupBy(*keys).agg(F.count_distinct("client_ip").alias("unique_ips"))
    joined = rows.join(unique, keys, "left").join(histogram_p95(latency, *keys), keys, "left")
    out = joined.withColumns(
        {
            "unique_ips": F.coalesce("unique_ips", F.lit(0)), "avg_request_time_ms": rate("request_time_sum_ms", "request_time_count"),
            "p95_request_time_ms": F.coalesce("p95_request_time_ms", F.lit(0.0)), "status_4xx_rate": rate("status_4xx"),
            "status_5xx_rate": rate("status_5xx"),
        }
    )
    return out.drop("request_time_count", "request_time_sum_ms")


def _top(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def _with_intel(rows: DataFrame, intel: DataFrame | None) -> DataFrame:
    """Top rows joined to intelligence after the limit, so only they meet the larger table."""
    if intel is None:
        return rows
    out = rows.join(intel.select(F.col("ip").alias("client_ip"), *(c for c in INTEL if c in intel.columns)), "client_ip", "left")
    return out.withColumn(
        "verified_source",
        verified_source(F.col("known_actor"), F.col("actor_type"), F.col("manual_action"), F.col("forward_confirmed"), F.col("verified_actor")),
    )


def top_ips(events: DataFrame, intel: DataFrame | None = None, limit: int = 25) -> DataFrame:
    rows = events.where("client_ip is not null").groupBy("client_ip").agg(F.count("*").alias("requests"), _class(4), _class(5), _bytes(), *_seen())
    return _with_intel(_top(rows, limit, F.desc("requests"), "client_ip"), intel)


def top_ips_from_rollup(rows: DataFrame, intel: DataFrame | None = None, limit: int = 25) -> DataFrame:
    """From rollup_ip_1h rows with edges."""
    added = rows.groupBy("client_ip").agg(
        *(F.sum(n).alias(n) for n in ("requests", "status_4xx", "status_5xx", "bytes_sent")), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return _with_intel(_top(added, limit, F.desc("requests"), "client_ip"), intel)


def top_paths(events: DataFrame, limit: int = 10) -> DataFrame:
    rows = events.groupBy(F.coalesce("path", F.lit("")).alias("path")).agg(F.count("*").alias("requests"), _class(4), _class(5), _bytes(), *_seen())
    return _top(rows, limit, F.desc("requests"), "path")


def user_agents(events: DataFrame, intel: DataFrame, limit: int = 25) -> DataFrame:
    """Top user agents with their analysis, and how many of their addresses and requests are verified."""
    proof = intel.select(
        F.col("ip").alias("client_ip"),
        verified_source_loose(
            F.col("known_actor"), F.col("actor_type"), F.col("manual_action"), F.col("forward_confirmed"), F.col("verified_actor"),
        ).alias("__ok"),
    )
    by_ip = events.groupBy(F.coalesce("user_agent", F.lit("")).alias("sample"), "client_ip").agg(
        F.count("*").alias("n"), _class(4).alias("n4"), _class(5).alias("n5"), _bytes().alias("nb"), *_seen(),
    )
    ok = F.coalesce("__ok", F.lit(False))
    rows = by_ip.join(proof, "client_ip", "left").groupBy("sample").agg(
        F.sum("n").alias("requests"), F.count("client_ip").alias("unique_ips"), F.sum("n4").alias("status_4xx"), F.sum("n5").alias("status_5xx"), F.sum("nb").alias("bytes_sent"),
        F.count(F.when(ok, F.col("client_ip"))).alias("verified_ips"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("verified_requests"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    top = _top(rows, limit, F.desc("requests"), "sample").withColumn("__a", analyse(F.col("sample"), F.col("requests")))
    return top.select(
        *rows.columns, *(F.col(f"__a.{f}").alias(f) for f in FIELDS), (F.col("verified_ips") > 0).alias("verified_source"),
        rate("status_4xx").alias("status_4xx_rate"), rate("status_5xx").alias("status_5xx_rate"),
    )


def slow_paths(events: DataFrame, limit: int = 25, least: int = 20) -> DataFrame:
    rows = events.where("request_time_ms is not null").withColumn("path", F.coalesce("path", F.lit("")))
    own = _measures("requests", "status_5xx", "first_seen", "last_seen")
    return _slowest(summary(rows, ["site_id", "env", "path"], _P95[0], own, _P95[1]), limit, least)


def _slowest(rows: DataFrame, limit: int, least: int) -> DataFrame:
    return _top(_with_average(rows.where(F.col("requests") >= least)), limit, F.desc("p95_request_time_ms"), F.desc("requests"), "site_id", "env", "path")


def slow_paths_from_rollup(latency: DataFrame, limit: int = 25, least: int = 20) -> DataFrame:
    """From rollup_path_latency_1h rows with edges; p95 is an upper edge."""
    keys = ["site_id", "env", "path"]
    rows = latency.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("status_5xx").alias("status_5xx"), F.sum("request_time_sum_ms").alias("ms"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).where(F.col("requests") >= least)
    out = rows.join(histogram_p95(latency, *keys), keys).withColumn("avg_request_time_ms", rate("ms")).drop("ms")
    return _top(out, limit, F.desc("p95_request_time_ms"), F.desc("requests"), *keys)


def status_breakdown(events: DataFrame, limit: int = 32) -> DataFrame:
    return _top(events.groupBy(F.coalesce("status", F.lit(0)).alias("status")).agg(F.count("*").alias("requests")), limit, F.desc("requests"), "status")


def path_hotspots(events: DataFrame, limit: int = 25) -> DataFrame:
    """Paths with 30 or more requests, 5 or more server errors and a rate of 0.2 or more."""
    rows = events.groupBy("site_id", "env", F.coalesce("path", F.lit("")).alias("path")).agg(F.count("*").alias("requests"), _class(5), *_seen())
    return _hottest(rows, limit)


def _hottest(rows: DataFrame, limit: int) -> DataFrame:
    rows = rows.where("requests >= 30 and status_5xx >= 5")
    return _top(rows.withColumn("rate", rate("status_5xx")).where("rate >= 0.2"), limit, F.desc("status_5xx"), F.desc("requests"), "site_id", "env", "path")


def probe_groups(probes: DataFrame, family: str, category: str = "") -> DataFrame:
    """All probes of a family by category, rule, site, environment, address and path."""
    own = probes.where(F.col("family") == family)
    own = own.where(F.col("category") == category) if category else own
    keys = ["category", "rule_key", "site_id", "env", "client_ip", F.coalesce("path", F.lit("")).alias("path")]
    return own.groupBy(*keys).agg(
        F.count("*").alias("requests"), _class(4), _class(5), F.max("method").alias("method"),
        F.max(F.coalesce("query", F.lit(""))).alias("sample_query"), F.max("match_reason").alias("match_reason"), *_seen(),
    )


def probe_summary(events: DataFrame, probes: DataFrame, family: str, category: str = "", limit: int = 25) -> DataFrame:
    """The busiest of ``probe_groups``, with the address's hits in all."""
    rows = probe_groups(probes, family, category)
    top = _top(rows, limit, F.desc("requests"), "category", "site_id", "env", "client_ip", "path")
    hits = events.join(top.select("client_ip").distinct(), "client_ip", "left_semi").groupBy("client_ip").agg(F.count("*").alias("total_ip_hits"))
    return top.join(hits, "client_ip", "left").withColumn("total_ip_hits", F.coalesce("total_ip_hits", F.lit(0)))


def probe_tops(probes: DataFrame, limit: int = 25) -> DataFrame:
    """The busiest rows of ``probe_summary`` of both families in one pass, with ``family`` and without hits in all."""
    keys = ["family", "category", "rule_key", "site_id", "env", "client_ip", F.coalesce("path", F.lit("")).alias("path")]
    rows = probes.groupBy(*keys).agg(F.count("*").alias("requests"), _class(4), _class(5), F.max("method").alias("method"), *_seen())
    order = Window.partitionBy("family").orderBy(F.desc("requests"), "category", "site_id", "env", "client_ip", "path")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def tor_sources(events: DataFrame, probes: DataFrame, intel: DataFrame, limit: int = 25) -> DataFrame:
    exits = intel.where("is_tor_exit").select(F.col("ip").alias("client_ip"), "risk_score", "country_code")
    rows = events.join(exits, "client_ip").groupBy("client_ip", "risk_score", "country_code").agg(F.count("*").alias("requests"), _class(4), _class(5), *_seen())
    admin = probes.where("family = 'admin'").groupBy("client_ip").agg(F.count("*").alias("admin_requests"))
    joined = rows.join(admin, "client_ip", "left").withColumn("admin_requests", F.coalesce("admin_requests", F.lit(0)))
    return _top(joined, limit, F.desc("admin_requests"), F.desc("requests"), "client_ip")


def log_totals(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_type", "severity").agg(F.count("*").alias("events"), *_seen())


def log_messages(logs: DataFrame, limit: int = 25) -> DataFrame:
    """Most frequent messages by type, severity and first 240 characters, with the sites they come from."""
    rows = logs.groupBy("log_type", "severity", F.left("message", F.lit(240)).alias("message")).agg(
        F.count("*").alias("events"), F.array_join(F.sort_array(F.collect_set("site_id")), ", ").alias("sites"), *_seen(),
    )
    return _top(rows, limit, F.desc("events"), "log_type", "severity", "message")


def latest_logs(logs: DataFrame, limit: int = 25) -> DataFrame:
    return _top(logs, limit, F.desc("ts"), "id").select(
        "id", "ts", "site_id", "env", "log_type", "severity", F.left("message", F.lit(500)).alias("message"), F.left("raw", F.lit(1200)).alias("raw"),
    )


def timeline(events: DataFrame, seconds: int, points: int = 180) -> DataFrame:
    """Buckets since the epoch, the newest 180, oldest first."""
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds)
    rows = events.groupBy(bucket.alias("bucket_ts")).agg(F.count("*").alias("requests"), _class(4), _class(5), _bytes())
    return _top(rows, points, F.desc("bucket_ts")).orderBy("bucket_ts")


def query_params(events: DataFrame, limit: int = 25, param: str = "", family: str = "") -> DataFrame:
    """Parameter values by errors, slowness and volume, with the newest request as an example.

    Counts alone are hashed while they add up; with the examples, whose strings make Spark sort instead, a task would hold all its
    rows. So the examples are looked up afterwards, for the rows of the report, among the requests of their last moment.
    """
    rows = with_params(events)
    rows = rows.where(F.col("param") == param.lower()) if param else rows
    rows = rows.where(F.col("param_family") == family) if family else rows
    keys = ["param_family", "param", "param_value"]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("requests"), _class(4), _class(5), _slow(), F.count_distinct("client_ip").alias("unique_ips"),
        F.count_distinct("path").alias("unique_paths"), _average(), *_seen(),
    )
    order = (F.desc("status_5xx"), F.desc("slow_requests"), F.desc("requests"), *keys)
    top = kept(_top(out, limit, *order), "query-params")
    last = rows.join(F.broadcast(top.select(*keys, "last_seen")), keys).where(F.col("ts").eqNullSafe(F.col("last_seen")))
    newest = lambda c: F.max_by(F.coalesce(c, F.lit("")), F.struct("ts", "id")).alias(f"example_{c}")
    top = top.join(last.groupBy(*keys).agg(newest("path"), newest("query")), keys)
    measures = [c for c in out.columns if c not in (*keys, "first_seen", "last_seen")]
    return _top(top, limit, *order).select(*keys, *measures, "example_path", "example_query", "first_seen", "last_seen")


def recent_errors(events: DataFrame, facts: DataFrame, intel: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Error facts, and errors among the raw events that have no fact yet."""
    missing = events.where("status >= 400").join(facts.select("id"), "id", "left_anti")
    rows = facts.select(*events.columns).unionByName(missing).select(
        "id", "ts", "site_id", "env", "client_ip", "method", "path", "query", "status", "request_time_ms", "user_agent",
    )
    return _with_intel(_top(rows, limit, F.desc("ts"), F.desc("id")), intel)


# ---- issues

def _clamp(score: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(score, F.lit(lo)), F.lit(hi)).cast("int")


def severity(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 30, "medium").otherwise("low")


def _part(part: str, by: int, most: int) -> Column:
    return F.least(F.expr(f"{part} div {by}"), F.lit(most))


def _issues(rows: DataFrame, rule: Column | str, when: Column, score: Column, actor_type: str, actor: Column, events: str, rate_: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    name = F.lit(rule) if isinstance(rule, str) else rule
    return rows.where(when).select(
        name.alias("rule_key"), severity(score).alias("severity"), *(F.col(c) if c in rows.columns else null.alias(c) for c in ("site_id", "env")),
        F.lit(actor_type).alias("actor_type"), actor.alias("actor_value"), score.cast("int").alias("score"), F.col("requests").cast("long").alias("requests") if "requests" in rows.columns else F.col(events).cast("long").alias("requests"),
        F.col(events).cast("long").alias("events"), (rate_ if rate_ is not None else F.lit(0.0)).cast("double").alias("rate"), F.col("first_seen"), F.col("last_seen"),
    )


def _whole(x: Column) -> Column:
    return x.cast("int")


def issues(sites: DataFrame, ips: DataFrame, agents: DataFrame, slow: DataFrame, hotspots: DataFrame, logs: DataFrame, probes: DataFrame | None = None, tor: DataFrame | None = None) -> DataFrame:
    """All issues that the report's rows show, by score. Integer parts are cut, as in the scores' definition."""
    site = F.concat_ws("/", "site_id", "env")
    r4, r5 = rate("status_4xx"), rate("status_5xx")
    severe = logs.withColumn("__n", F.when(F.col("severity").isin("critical", "error") | F.col("log_type").contains("error"), F.col("events")).otherwise(0))
    by_type = severe.groupBy("log_type").agg(
        F.sum("events").alias("events"), F.sum("__n").alias("severe"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    burst = (F.col("requests") >= 50) & (F.col("status_5xx") >= 10) & (r5 >= 0.10)
    out = [
        _issues(sites, "site_5xx_rate", (F.col("status_5xx") >= 10) & (r5 >= 0.02), _clamp(_whole(r5 * 100) + _part("status_5xx", 10, 35), 35, 100), "site", site, "status_5xx", r5),
        _issues(sites, "site_slow_p95", (F.col("p95_request_time_ms") >= 3000) & (F.col("requests") >= 100), _clamp(_whole(F.col("p95_request_time_ms") / 100) + 20, 30, 90), "site", site, "requests"),
        _issues(ips, "ip_5xx_burst", burst, _clamp(_whole(r5 * 70) + _part("status_5xx", 10, 30), 35, 100), "ip", F.col("client_ip"), "status_5xx", r5),
        _issues(ips, "ip_4xx_scan", (F.col("status_4xx") >= 100) & (r4 >= 0.50), _clamp(_whole(r4 * 60) + _part("status_4xx", 50, 30), 25, 90), "ip", F.col("client_ip"), "status_4xx", r4),
        _issues(agents, "missing_user_agent", (F.col("actor_type") == "missing") & (F.col("requests") >= 100), _clamp(45 + _part("requests", 1000, 25), 45, 75), "user_agent", F.col("family"), "requests"),
        _issues(agents, "tool_user_agent_volume", (F.col("actor_type") == "tool") & (F.col("requests") >= 100), _clamp(F.col("risk_score") + _part("requests", 1000, 20), 40, 85), "user_agent", F.col("family"), "requests"),
        _issues(agents, "unverified_crawler_claim", (F.col("actor_type") == "crawler") & ~F.col("verified_source") & (F.col("requests") >= 1000) & (F.col("known_actor") != ""), _clamp(45 + _part("requests", 1000, 25), 45, 80), "user_agent", F.col("known_actor"), "requests"),
        _issues(slow, "path_slow_p95", (F.col("requests") >= 20) & (F.col("p95_request_time_ms") >= 3000), _clamp(_whole(F.col("p95_request_time_ms") / 100) + 20, 30, 90), "path", F.col("path"), "requests"),
        _issues(hotspots, "path_5xx_hotspot", F.lit(True), _clamp(_whole(r5 * 80) + _part("status_5xx", 5, 20), 30, 95), "path", F.col("path"), "status_5xx", r5),
        _issues(by_type, F.concat("log_type", F.lit("_log_activity")), (F.col("severe") > 0) | F.col("log_type").contains("slow") | (F.col("events") >= 100), _clamp(25 + _part("events", 1000, 40) + _part("severe", 250, 30), 25, 95), "log", F.col("log_type"), "events"),
    ]
    if probes is not None:
        by = lambda scores, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), F.col("category")), F.lit(other))
        bad = F.expr("least((status_4xx + status_5xx) div 2, 12)")
        admin = by(
            {"admin_tool": 58, "password_reset": 55, "admin_login": 62, "admin_path": 42}, 35,
        ) + F.when(F.col("method") == "POST", 8).otherwise(0) + _part("requests", 3, 16) + bad
        injection = by(
            {"sql_injection": 70, "xss": 64, "secret_file": 68, "path_traversal": 60}, 55,
        ) + _part("requests", 4, 10) + F.when(F.col("status_5xx") > 0, 4).otherwise(0)
        few = (F.col("category") == "admin_path") & (F.col("requests") < 10) & (F.col("status_4xx") < 5)
        score = F.when(F.col("family") == "admin", _clamp(admin, 30, 92)).otherwise(_clamp(injection, 35, 90))
        out.append(_issues(probes, F.col("rule_key"), ~few, score, "ip", F.col("client_ip"), "requests"))
    if tor is not None:
        score = F.when(
            F.col("admin_requests") > 0, _clamp(70 + F.least(5 * F.col("admin_requests"), F.lit(20)), 70, 95),
        ).otherwise(50 + _part("requests", 25, 20)).cast("int")
        out.append(_issues(tor, "tor_exit_traffic", (F.col("admin_requests") > 0) | (F.col("requests") >= 10), score, "ip", F.col("client_ip"), "requests"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.orderBy(F.desc("score"), F.desc("last_seen"), "rule_key", "actor_value")


#: What of an event each part of the report counts by: site, path and duration; agent and address; probe.
_PARTS = ("site_id", "env", "path", "client_ip", "user_agent", "request_time_ms", "family", "category", "rule_key")


def report_counts(events: DataFrame) -> DataFrame:
    """The report's three sets of keys counted in one read of ``events``: ``part`` 0 by site, environment, path and duration, 1 by
    user agent and address, 2 by probe, site, environment, address and path. Kept as a table with a folder for each part.

    Each event gives a row for each set that it has a part in, which are added up before they are shuffled.
    """
    tried = P.classified(events)
    path, none = F.coalesce("path", F.lit("")).alias("path"), {c: F.lit(None).cast(events.schema[c].dataType if c in events.columns else "string").alias(c) for c in _PARTS}
    row = lambda part, **own: F.struct(F.lit(part).alias("part"), *(own.get(c, none[c]) for c in _PARTS))
    plain = {c: F.col(c) for c in _PARTS if c in events.columns}
    site = {c: plain[c] for c in ("site_id", "env")}
    probe = lambda p: row(2, **site, path=path, client_ip=plain["client_ip"], family=p["family"].alias("family"), category=p["category"].alias("category"), rule_key=p["rule_key"].alias("rule_key"))
    rows = F.concat(
        F.array(row(0, **site, path=path, request_time_ms=plain["request_time_ms"]), row(1, client_ip=plain["client_ip"], user_agent=F.coalesce("user_agent", F.lit("")).alias("user_agent"))),
        F.transform("__probes", probe),
    )
    kept_columns = ["ts", "status", "bytes_sent", "method", "request_time_ms"]
    each = tried.select(*(F.col(c).alias(f"__{c}") for c in kept_columns), F.inline(rows))
    status = lambda n: count_if(F.col("__status").between(100 * n, 100 * n + 99)).alias(f"status_{n}xx")
    counts = each.groupBy("part", *_PARTS).agg(
        F.count("*").alias("requests"), status(4), status(5), F.coalesce(F.sum("__bytes_sent"), F.lit(0)).alias("bytes_sent"), F.max("__method").alias("method"),
        F.count("__request_time_ms").alias("__n"), F.sum("__request_time_ms").alias("__ms"), F.min("__ts").alias("first_seen"), F.max("__ts").alias("last_seen"),
    )
    return kept(counts, "report", "part")


def issue_report(events: DataFrame, logs: DataFrame, intel: DataFrame, limit: int = 25) -> DataFrame:
    """``issues`` of a window, from one read each of its events, its log events and the table of intelligence."""
    counts = report_counts(events)
    paths, people, found = (counts.where(F.col("part") == k) for k in range(3))
    add = lambda rows, *keys, more=(): rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("requests", "status_4xx", "status_5xx", "bytes_sent")), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *more)
    own = {n: m for n, m in _measures("requests", "status_4xx", "status_5xx", "first_seen", "last_seen").items() if n != "__timed"}
    timed = {**own, "__timed": Measure(F.sum("__n"))}
    named = paths.withColumn("__timed", F.col("__n"))
    sites = _with_average(percentiles(named, ["site_id", "env"], _P95[0], timed, _P95[1]))
    slow = _slowest(percentiles(named.where("request_time_ms is not null"), ["site_id", "env", "path"], _P95[0], timed, _P95[1]), limit, 20)
    loose = verified_source_loose(F.col("known_actor"), F.col("actor_type"), F.col("manual_action"), F.col("forward_confirmed"), F.col("verified_actor"))
    proof = intel.select(F.col("ip").alias("client_ip"), loose.alias("ok"), "is_tor_exit", "risk_score", "country_code")
    known = kept(people.drop("risk_score").join(proof, "client_ip", "left"), "people")
    ok = F.coalesce("ok", F.lit(False))
    rows = add(known.withColumnRenamed("user_agent", "sample"), "sample", more=(F.count("client_ip").alias("unique_ips"), F.count(F.when(ok, F.col("client_ip"))).alias("verified_ips")))
    agents = _top(rows, limit, F.desc("requests"), "sample").withColumn("__a", analyse(F.col("sample"), F.col("requests")))
    agents = agents.select(*rows.columns, *(F.col(f"__a.{f}").alias(f) for f in FIELDS), (F.col("verified_ips") > 0).alias("verified_source"))
    exits = add(known.where("is_tor_exit and client_ip is not null"), "client_ip", "risk_score", "country_code")
    admin = found.where("family = 'admin'").groupBy("client_ip").agg(F.sum("requests").alias("admin_requests"))
    exits = exits.join(admin, "client_ip", "left").withColumn("admin_requests", F.coalesce("admin_requests", F.lit(0)))
    order = Window.partitionBy("family").orderBy(F.desc("requests"), "category", "site_id", "env", "client_ip", "path")
    tops = found.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= limit)
    return issues(
        sites, _top(add(people.where("client_ip is not null"), "client_ip"), limit, F.desc("requests"), "client_ip"), agents, slow,
        _hottest(add(paths, "site_id", "env", "path"), limit), log_totals(logs), tops.drop("__k"), _top(exits, limit, F.desc("admin_requests"), F.desc("requests"), "client_ip"),
    )


# ---- details

def paged(rows: DataFrame, limit: int, offset: int, *order: Column | str) -> DataFrame:
    """A page with the number of all rows in ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def agent_detail(events: DataFrame, agent: str) -> dict[str, DataFrame]:
    """Traffic, addresses, paths and requests of one user agent."""
    own = events.where(F.coalesce("user_agent", F.lit("")) == agent)
    counted = lambda *k: own.groupBy(*k).agg(F.count("*").alias("requests"), _class(4), _class(5), *_seen())
    return {"traffic": totals(own), "ips": counted("client_ip"), "paths": counted("path"), "requests": own}


def ip_detail(events: DataFrame, ip: str) -> dict[str, DataFrame]:
    """Summary, sites, paths, addresses asked for, user agents and requests of one address."""
    own = events.where(F.col("client_ip") == ip)
    counted = lambda *k: own.groupBy(*k).agg(F.count("*").alias("requests"), _class(4), _class(5), _bytes(), *_seen())
    hit = ["site_id", "env", "method", "path", "query", "status", "user_agent"]
    hits = _with_average(summary(own, hit, _P95[0], _measures("requests", "first_seen", "last_seen"), _P95[1]))
    return {"traffic": totals(own), "sites": counted("site_id", "env"), "paths": counted("path"), "url_hits": hits, "user_agents": counted("user_agent"), "requests": own}


def signal_detail(probes: DataFrame, **filters: str) -> dict[str, DataFrame]:
    """Probes narrowed by any of family, category, rule_key, site_id, env, client_ip and path."""
    unknown = filters.keys() - {"family", "category", "rule_key", "site_id", "env", "client_ip", "path"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for name, value in filters.items():
        probes = probes.where(F.col(name) == value) if value else probes
    counted = lambda *k: probes.groupBy(*k).agg(F.count("*").alias("requests"), _class(4), _class(5), *_seen())
    return {"summary": counted("family", "category", "rule_key"), "ips": counted("client_ip"), "requests": probes}


def agent_record(dimension: DataFrame, agent: str, key: int | None = None, prefix: int = 300) -> DataFrame:
    """The one stored user agent (key, user_agent, request_count) that is meant: by its key, else by its whole text, else
    by its first 300 characters; among equals the busiest."""
    text = F.col("user_agent")
    rank = F.when(F.col("key") == key, 0) if key is not None else F.when(F.lit(False), 0)
    rank = rank.when(text == agent, 1).when(F.left(text, F.lit(prefix)) == agent[:prefix], 2)
    return _top(dimension.withColumn("__rank", rank).where("__rank is not null"), 1, "__rank", F.desc("request_count"), "user_agent").drop("__rank")


def tor_detail(events: DataFrame, intel: DataFrame, **filters: str) -> dict[str, DataFrame]:
    """Traffic of Tor exits, narrowed by any of site_id, env, client_ip and path."""
    exits = intel.where("is_tor_exit").select(F.col("ip").alias("client_ip"))
    own = events.join(exits, "client_ip", "left_semi")
    for name, value in filters.items():
        own = own.where(F.col(name) == value) if value else own
    counted = lambda *k: own.groupBy(*k).agg(F.count("*").alias("requests"), _class(4), _class(5), *_seen())
    return {
        "summary": own.agg(F.count("*").alias("requests"), F.count_distinct("client_ip").alias("unique_ips"), _class(4), _class(5), *_seen()),
        "ips": counted("client_ip"), "requests": own,
    }


def ip_detail_from_rollups(ips: DataFrame, paths: DataFrame, agents: DataFrame, ip: str) -> dict[str, DataFrame]:
    """Sites, paths and user agents of one address from rollup rows with edges (by address; and path; and agent)."""

    def added(rows: DataFrame, *keys: str) -> DataFrame:
        own = rows.where(F.col("client_ip") == ip)
        return own.groupBy(*keys).agg(
            *(F.sum(n).alias(n) for n in ("requests", "status_4xx", "status_5xx", "bytes_sent")), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )

    return {"sites": added(ips, "site_id", "env"), "paths": added(paths, "path"), "user_agents": added(agents, "user_agent")}
