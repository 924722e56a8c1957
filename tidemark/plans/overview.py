"""Dashboard, alerts, reports, archives and audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import probes
from tidemark.functions.timewindow import bucket_seconds, span_of
from tidemark.functions.useragent import FIELDS, analyse, merge_stored
from tidemark.operators import intel as I
from tidemark.operators import rollups as R
from tidemark.plans import adapter as A

width = lambda since, until: bucket_seconds(until - since)


def dimension(events: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with first and last time seen and a count."""
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("request_count"),
    )


def value_key(value: Column) -> Column:
    """A key for a dimension's value that needs no table of numbers given out: 60 bits of its md5."""
    return F.conv(F.left(F.md5(value), F.lit(15)), 16, 10).cast("long")


def keyed(events: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """``events`` with <column>_id for each dimension (column -> table with that column and ``key``) that holds its value."""
    for column, table in dimensions.items():
        events = events.join(table.select(column, F.col("key").alias(f"{column}_id")), column, "left")
    return events


def add_new(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``stored`` and the values it does not have; what it has is frozen as first written."""
    return stored.unionByName(fresh.join(stored.select(key), key, "left_anti"))


def add_counts(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The alternative to ``add_new`` that keeps counts and times up to date."""
    return stored.unionByName(fresh).groupBy(key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("request_count").alias("request_count"),
    )


def overview(events: DataFrame, since: datetime, until: datetime, now: datetime, minutes: DataFrame | None = None) -> DataFrame:
    """One row: counters, rates, the busiest site and address, the newest event and its age.

    With the minute rollup, the newest event is looked for from its last minute on, not in all history."""
    w = R.window(events, since, until)
    c4, c5 = R.count_if(F.col("status").between(400, 499)), R.count_if(F.col("status").between(500, 599))
    row = w.agg(F.count("*").alias("requests"), F.count_distinct("client_ip").alias("unique_ips"), c4.alias("c4"), c5.alias("c5"))
    first = lambda key: w.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(1)
    site, ip = first("site_id").toDF("top_site", "top_site_requests"), first("client_ip").toDF("top_ip", "top_ip_requests")
    last = minutes.agg(F.max("bucket_ts").cast("timestamp_ntz")).first()[0] if minutes is not None else None
    latest = (events if last is None else events.where(F.col("ts") >= R.at(last))).agg(F.max("ts").alias("latest_event_at"))
    span = (until - since).total_seconds() / 60
    lag = F.greatest(F.lit(0), F.unix_seconds(R.at(now).cast("timestamp")) - F.unix_seconds(F.col("latest_event_at").cast("timestamp")))
    share = lambda c: F.coalesce(F.try_divide(c, "requests"), F.lit(0.0))
    one = F.lit(1) == F.lit(1)
    # each side is a single row
    joined = row.join(F.broadcast(site), one, "left").join(F.broadcast(ip), one, "left").join(F.broadcast(latest), one, "left")
    return joined.select(
        "requests", (F.col("requests") / span).alias("requests_per_minute"), "unique_ips", share("c4").alias("status_4xx_rate"),
        share("c5").alias("status_5xx_rate"), "top_site", "top_site_requests", "top_ip", "top_ip_requests", "latest_event_at",
        lag.alias("event_lag_seconds"),
    )


def alert_candidates(events: DataFrame, limit: int = 50) -> DataFrame:
    """Addresses and paths that break a rule: of an address only the first that applies."""
    measures = (
        F.count("*").alias("requests"), R.count_if(F.col("status").between(400, 499)).alias("status_4xx"),
        R.count_if(F.col("status").between(500, 599)).alias("status_5xx"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    order = (F.desc("status_5xx"), F.desc("status_4xx"), F.desc("requests"), "site_id", "env", "actor_value")
    ips = events.where("client_ip is not null").groupBy(
        "site_id", "env", F.col("client_ip").alias("actor_value"),
    ).agg(*measures).where("requests >= 50").orderBy(*order).limit(limit).withColumn("actor_type", F.lit("ip"))
    paths = events.where("path is not null").groupBy(
        "site_id", "env", F.col("path").alias("actor_value"),
    ).agg(*measures).where("requests >= 30").orderBy(*order).limit(limit).withColumn("actor_type", F.lit("path"))
    r4, r5 = F.col("status_4xx") / F.col("requests"), F.col("status_5xx") / F.col("requests")
    rule = F.when((F.col("actor_type") == "ip") & (F.col("status_5xx") >= 10) & (r5 >= 0.10), "ip_5xx_burst").when((F.col("actor_type") == "ip") & (F.col("status_4xx") >= 100) & (r4 >= 0.50), "ip_4xx_scan").when(
        (F.col("actor_type") == "path") & (F.col("status_5xx") >= 5) & (r5 >= 0.20), "path_5xx_hotspot",
    )
    whole = lambda rate, times, part, by, most: (rate * times).cast("int") + F.least(F.expr(f"{part} div {by}"), F.lit(most))
    held = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    score = F.when(
        F.col("rule_key") == "ip_5xx_burst", held(whole(r5, 70, "status_5xx", 10, 30), 35, 100),
    ).when(
        F.col("rule_key") == "ip_4xx_scan", held(whole(r4, 60, "status_4xx", 50, 30), 25, 90),
    ).otherwise(held(whole(r5, 80, "status_5xx", 5, 20), 30, 95))
    return ips.unionByName(paths).withColumn("rule_key", rule).where("rule_key is not null").withColumn("score", score.cast("int"))


def merge_alerts(open_alerts: DataFrame, found: DataFrame) -> DataFrame:
    """Open alerts with new findings of the same rule, site, environment and actor folded in: times widened, the
    newest score; other findings open new alerts."""
    keys = ["rule_key", "site_id", "env", "actor_type", "actor_value"]
    both = open_alerts.select(*keys, "score", "first_seen", "last_seen", F.lit(0).alias("__new")).unionByName(
        found.select(*keys, "score", "first_seen", "last_seen", F.lit(1).alias("__new"))
    )
    return both.groupBy(*keys).agg(F.max_by("score", "__new").alias("score"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def alert_events(events: DataFrame, alert: dict) -> DataFrame:
    """The error events behind an alert, between its first and last time, both included."""
    lo, hi = {"ip_4xx_scan": (400, 499), "ip_5xx_burst": (500, 599), "path_5xx_hotspot": (500, 599)}.get(alert["rule_key"], (400, 599))
    own = F.col("client_ip" if alert["actor_type"] == "ip" else "path") == alert["actor_value"]
    return events.where(own & F.col("status").between(lo, hi) & F.col("ts").between(R.at(alert["first_seen"]), R.at(alert["last_seen"])))


def severity_rank(severity: Column) -> Column:
    text = F.lower(severity)
    return F.when(text == "critical", 4).when(text == "high", 3).when(text == "medium", 2).when(text == "low", 1).otherwise(0)


def notifications(alerts: DataFrame, delivered: DataFrame, least: str = "high", limit: int = 50) -> DataFrame:
    """Alerts of a severity and up that no delivery has reached yet, the gravest and newest first."""
    done = delivered.where("status = 'delivered'").select("alert_id").distinct()
    grave = alerts.withColumn("__rank", severity_rank(F.col("severity"))).where(F.col("__rank") >= severity_rank(F.lit(least)))
    return grave.join(done, "alert_id", "left_anti").orderBy(F.desc("__rank"), F.desc("last_seen"), "alert_id").limit(limit).drop("__rank")


def site_health(sites: DataFrame) -> DataFrame:
    """Risk of a site from its error rate and slowest environment: critical from 65, warning from 25."""
    rows = sites.groupBy("site_id").agg(
        F.sum("requests").alias("requests"), F.sum(F.col("status_4xx") + F.col("status_5xx")).alias("errors"),
        F.max("p95_request_time_ms").alias("p95"),
    )
    risk = F.least(F.lit(99), F.floor(F.coalesce(F.try_divide("errors", "requests"), F.lit(0.0)) * 900 + F.col("p95") / 90 + 0.5)).cast("int")
    return rows.select("site_id", "requests", risk.alias("risk")).withColumn(
        "health", F.when(F.col("risk") >= 65, "critical").when(F.col("risk") >= 25, "warning").otherwise("healthy"),
    )


def facets(events: DataFrame, *columns: str) -> DataFrame:
    """Counts by value of each column, in one pass: (facet, value, n)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns)))
    return events.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


# ---- reports

def report_charts(timeline: DataFrame, statuses: DataFrame, sites: DataFrame, ips: DataFrame, agents: DataFrame, slow: DataFrame, probes: DataFrame) -> dict[str, DataFrame]:
    """The seven charts of a report as (label, value, secondary) tables."""
    mix = F.floor(F.col("status") / 100).cast("int")
    pick = lambda df, label, value, second, n: df.select(
        label.cast("string").alias("label"), F.col(value).cast("double").alias("value"), second.cast("double").alias("secondary"),
    ).orderBy(F.desc("value"), "label").limit(n)
    none = F.lit(None)
    return {
        "traffic_timeline": timeline.orderBy(F.desc("bucket_ts")).limit(120).select(F.col("bucket_ts").cast("string").alias("label"), F.col("requests").cast("double").alias("value"), (F.col("status_4xx") + F.col("status_5xx")).cast("double").alias("secondary")).orderBy("label"),
        "status_mix": statuses.where(mix.between(2, 5)).groupBy(F.concat(mix.cast("string"), F.lit("xx")).alias("label")).agg(F.sum("requests").cast("double").alias("value")).withColumn("secondary", none.cast("double")),
        "site_traffic": pick(sites, F.concat_ws("/", "site_id", "env"), "requests", F.col("status_5xx"), 12),
        "source_ips": pick(ips, F.col("client_ip"), "requests", F.col("status_5xx"), 12),
        "user_agent_classes": pick(agents.groupBy("actor_type").agg(F.sum("requests").alias("requests")), F.col("actor_type"), "requests", none, 10),
        "security_signals": pick(probes.groupBy("rule_key").agg(F.sum("requests").alias("requests")), F.col("rule_key"), "requests", none, 12),
        "slow_paths": pick(slow, F.col("path"), "p95_request_time_ms", F.col("requests"), 12),
    }


def report_summary(totals: DataFrame, issues: DataFrame, probes: DataFrame, tor: DataFrame) -> DataFrame:
    """One row: totals, issues by severity, probe and Tor requests."""
    by = issues.agg(F.count("*").alias("issue_count"), *(R.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in ("critical", "high", "medium", "low")))
    sums = probes.agg(*(F.coalesce(F.sum(F.when(F.col("rule_key").startswith(p), F.col("requests"))), F.lit(0)).alias(n) for p, n in (("admin_", "admin_probe_requests"), ("probe_", "injection_probe_requests"))))
    tors = tor.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("tor_requests"))
    one = F.lit(1) == F.lit(1)
    return totals.join(F.broadcast(by), one).join(F.broadcast(sums), one).join(F.broadcast(tors), one)


def report_text(row: dict, since: datetime | None = None, until: datetime | None = None) -> str:
    """A plain summary of a report's row, headed by the kind and span of its window if that is given."""
    grave = row["critical_issues"] + row["high_issues"]
    label, kind = span_of(since, until) if since and until else ("", "")
    lines = [f"{row['requests']} requests from {row['unique_ips']} addresses; {row['status_4xx_rate']:.1%} client errors, {row['status_5xx_rate']:.1%} server errors."]
    lines.append(f"{row['issue_count']} issues, {grave} of them high or critical." if row["issue_count"] else "No issues.")
    if row["admin_probe_requests"] or row["injection_probe_requests"]:
        lines.append(f"{row['admin_probe_requests']} admin and {row['injection_probe_requests']} injection probes; {row['tor_requests']} requests from Tor exits.")
    return "\n".join([f"{kind.capitalize()} report, {label}."] * bool(label) + lines)


def drilldowns(rows: int = 30, **sections: DataFrame) -> dict[str, DataFrame]:
    """The first rows of each section of a report, as they are sorted there."""
    return {name: df.limit(rows) for name, df in sections.items()}


def evenly(rows: list, limit: int) -> list:
    """At most ``limit`` rows, spread evenly, the first and last among them."""
    if len(rows) <= limit or limit < 2:
        return rows[:limit]
    return [rows[k * (len(rows) - 1) // (limit - 1)] for k in range(limit)]


def shortened(value: object, most: int = 240) -> object:
    """Long strings cut with an ellipsis, in whatever they stand."""
    if isinstance(value, dict):
        return {k: shortened(v, most) for k, v in value.items()}
    if isinstance(value, list):
        return [shortened(v, most) for v in value]
    return value[: most - 1] + "…" if isinstance(value, str) and len(value) > most else value


def evidence(summary: dict, charts: dict[str, list[dict]], sections: dict[str, list[dict]], points: int = 24, rows: int = 8) -> dict:
    """A report compacted to a bounded size: timelines thinned evenly, other lists cut, long strings shortened."""
    thin = lambda name, data: evenly(data, points) if name == "traffic_timeline" else data[:points]
    return shortened({"summary": summary, "charts": {n: thin(n, d) for n, d in charts.items()}, "drilldowns": {n: d[:rows] for n, d in sections.items()}})


def read_audit(events: DataFrame, facts: DataFrame, minutes: DataFrame, statuses: DataFrame, since: datetime, until: datetime) -> dict:
    """Which tables each report of a window would read, and how many raw rows that takes."""
    w = R.window(events, since, until)
    edge = lambda seconds: w.where(
        (F.col("ts") < R.at(R.whole(since, until, seconds)[0])) | (F.col("ts") >= R.at(R.whole(since, until, seconds)[1]))
    ).count()
    ready, status_ready = R.dimension_ready(events, since, until), R.same_total(minutes, statuses, since, until)
    gaps = w.where("status >= 400").join(facts.select("id"), "id", "left_anti").count()
    minute_edges, hour_edges = edge(60), edge(3600)
    raw = "raw access_events"
    return {
        "access_analysis_source": "dimension rollups + hour edge events" if ready else raw,
        "traffic_source": ("dimension rollups + hour edge events" if ready else raw) + ("" if status_ready else " + raw status"),
        "overview_source": "rollup_1m + minute edge events", "recent_errors_source": "error facts" + (" + raw gap rows" if gaps else ""),
        "minute_edge_events": minute_edges, "hour_edge_events": hour_edges, "raw_gap_rows": gaps, "expected_raw_rows": max(minute_edges, hour_edges) if ready else w.count(),
    }


def database_probe_ips(probes: DataFrame) -> DataFrame:
    """Addresses that probe databases, with their sites, riskiest first."""
    text = F.concat_ws(" ", "category", "rule_key", "match_reason", "sample_query", "path")
    rows = probes.where(text.rlike("(?i)sql|mysql|database|query|select_from|union|information_schema") & (F.coalesce("client_ip", F.lit("")) != ""))
    sums = (F.sum(n).alias(n) for n in ("requests", "status_4xx", "status_5xx"))
    return rows.groupBy("client_ip").agg(*sums, F.sort_array(F.collect_set("site_id")).alias("sites")).orderBy(F.desc("requests"), "client_ip")


def stale_agents(stored: DataFrame, limit: int = 5000) -> DataFrame:
    """User agents whose analysis is incomplete, the newest first: what to analyse again."""
    gap = lambda c: F.coalesce(c, F.lit("")) == ""
    return stored.where(gap(F.col("family")) | gap(F.col("actor_type")) | F.col("risk_score").isNull()).orderBy(F.desc("last_seen"), "user_agent").limit(limit)


def reanalysed(stored: DataFrame, limit: int = 5000) -> DataFrame:
    """The stale of ``stored`` (user_agent, request_count, ... and the fields of the analysis) with their gaps filled."""
    rows = stale_agents(stored, limit)
    filled = merge_stored(F.struct(*FIELDS), analyse(F.col("user_agent"), F.col("request_count")))
    return rows.withColumn("__a", filled).select(*(c for c in rows.columns if c not in FIELDS), *(F.col(f"__a.{c}").alias(c) for c in FIELDS))


def report_catalog(reports: DataFrame, site: str = "", kind: str = "", limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of reports, newest first, with its summary out of the stored input and the number of all that fit in
    ``total``; a site also matches reports of all."""
    rows = _of_site(reports, site)
    rows = rows.where(F.col("report_type") == kind) if kind else rows
    total = rows.agg(F.count("*").alias("total"))
    page = rows.withColumn("report_summary", F.get_json_object("input", "$.report_summary")).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row


def report_types(reports: DataFrame, site: str = "") -> DataFrame:
    """Number of reports by type."""
    return _of_site(reports, site).groupBy("report_type").agg(F.count("*").alias("reports"))


def _of_site(reports: DataFrame, site: str) -> DataFrame:
    return reports.where((F.col("site_id") == site) | F.col("site_id").isNull()) if site else reports


# ---- archives and retention

def merged_intervals(rows: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching [range_start, range_end) as one, by key: first within the day of their start, so that a
    busy key's many intervals are spread over tasks, then what is left of them across days."""
    daily = _merged(rows.withColumn("__day", F.to_date("range_start")), *keys, "__day").drop("__day")
    return _merged(daily, *keys)


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy("range_start", "range_end")
    before = F.max("range_end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.coalesce((F.col("range_start") > F.col("__before")).cast("int"), F.lit(1))).over(own)
    numbered = rows.withColumn("__before", before).withColumn("__run", run)
    return numbered.groupBy(*keys, "__run").agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).drop("__run")


_RANK = {"monthly": 3, "weekly": 2, "daily": 1}


def covered_seconds(spans: list[tuple[datetime, datetime]], start: datetime, end: datetime) -> int:
    total, reached = 0, start
    for a, b in sorted(spans):
        a, b = max(a, reached), min(b, end)
        if b > a:
            total, reached = total + int((b - a).total_seconds()), b
    return total


def choose_archives(archives: list[dict], start: datetime, end: datetime) -> list[dict]:
    """The archives to read for [start, end): coarse before fine, long before short, early before late; those that
    add nothing are left out. Works on the manifest's rows, a few a day."""
    chosen: list[dict] = []
    for a in sorted(archives, key=lambda a: (-_RANK.get(a["granularity"].lower(), 0), a["range_start"] - a["range_end"], a["range_start"])):
        lo, hi = max(a["range_start"], start), min(a["range_end"], end)
        if hi > lo and covered_seconds([(c["range_start"], c["range_end"]) for c in chosen], lo, hi) < int((hi - lo).total_seconds()):
            chosen.append(a)
    return sorted(chosen, key=lambda a: a["range_start"])


def archive_groups(segments: DataFrame, cutoff: datetime, archived: DataFrame, unit: str = "week") -> DataFrame:
    """Segments older than a cutoff that no archive holds yet, by day or week: what the next archives are made of."""
    old = segments.where(F.col("bucket_end") <= R.at(cutoff)).join(archived.select("segment_id"), "segment_id", "left_anti")
    return old.groupBy(F.date_trunc(unit, "bucket_start").alias("range_start")).agg(
        F.count("*").alias("segments"), F.sum("line_count").alias("line_count"), F.min("bucket_start").alias("first_bucket"),
        F.max("bucket_end").alias("last_bucket"),
    )


def retention_counts(tables: dict[str, tuple[DataFrame, str, datetime]]) -> DataFrame:
    """(table, expired): rows of each table whose time column is before its cutoff."""
    expired = lambda df, column, cutoff: df.where(F.col(column) < R.at(cutoff)).agg(F.count("*").alias("expired"))
    return reduce(DataFrame.unionByName, (expired(*own).select(F.lit(name).alias("table"), "expired") for name, own in tables.items()))


def retained(events: DataFrame, cutoff: datetime) -> DataFrame:
    """What retention leaves: events from the cutoff on, and those of temporary imports, which expire by themselves."""
    return events.where((F.col("ts") >= R.at(cutoff)) | F.col("temporary_import_id").isNotNull())


def without_expired_imports(events: DataFrame, imports: DataFrame, now: datetime) -> DataFrame:
    """Events but those of temporary imports that have run out."""
    return events.join(_expired(imports, now), "temporary_import_id", "left_anti")


def _expired(imports: DataFrame, now: datetime) -> DataFrame:
    return imports.where(F.col("expires_at") <= R.at(now)).select(F.col("id").alias("temporary_import_id"))


def rollup_without_expired(rollup: DataFrame, name: str, events: DataFrame, imports: DataFrame, now: datetime) -> DataFrame:
    """A rollup after the imports that have run out are gone: hours that held their events are counted anew from the rest,
    and vanish if nothing is left."""
    hours = R.touched_hours(events.join(_expired(imports, now), "temporary_import_id", "left_semi"))
    hour = lambda df, c: df.withColumn("__hour", F.date_trunc("hour", c))
    touched = hours.withColumnRenamed("bucket_ts", "__hour")
    left = hour(without_expired_imports(events, imports, now), "ts").join(touched, "__hour", "left_semi").drop("__hour")
    return hour(rollup, "bucket_ts").join(touched, "__hour", "left_anti").drop("__hour").unionByName(R.build(left, name))


def table_audit(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, rows, oldest, newest) of tables by their time column."""
    parts = [df.agg(F.count("*").alias("rows"), F.min(c).alias("oldest"), F.max(c).alias("newest")).select(F.lit(n).alias("table"), "rows", "oldest", "newest") for n, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def site_rates(events: DataFrame) -> DataFrame:
    """Events a day of each site over the span in which it was seen, busiest first."""
    rows = events.groupBy("site_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    days = (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / F.lit(86_400_000_000.0)
    return rows.withColumn("events_per_day", F.col("events") / F.when(days > 0, days).otherwise(1.0))


def twenty_site_rate(rates: DataFrame) -> float:
    """A blend of 20 sites: two as the busiest, two as the second, sixteen at half the second."""
    top = [r["events_per_day"] for r in rates.orderBy(F.desc("events"), "site_id").limit(2).collect()]
    if not top:
        return 0.0
    return 2 * top[0] + 2 * top[-1] + 16 * top[-1] / 2


def projection(sites: int, events_per_day: float, observed: dict, days: dict) -> dict:
    """Bytes that a scenario needs. observed: events_per_day, days, bytes_per_event, raw_bytes_per_day and the bytes of
    dimensions, rollups, facts and reports; days: hot, archive, report, raw. Archives compress to the observed
    ratio, else to a quarter."""
    scale = events_per_day / observed["events_per_day"] if observed["events_per_day"] else 0.0
    horizon = lambda name, span: int(observed.get(name, 0) * scale * span / observed["days"])
    hot = int(events_per_day * days["hot"])
    out = {"sites": sites, "events_per_day": events_per_day, "hot_events": hot, "hot_event_bytes": int(hot * observed["bytes_per_event"])}
    out |= {f"{n}_bytes": horizon(n, days["report" if n == "reports" else "archive"]) for n in ("dimensions", "rollups", "facts", "reports")}
    out["raw_bytes"] = int(observed["raw_bytes_per_day"] * days["raw"] * scale)
    out["archive_bytes"] = int(observed["raw_bytes_per_day"] * days["archive"] * scale * observed.get("compression", 0.25))
    out["total_bytes"] = sum(v for k, v in out.items() if k.endswith("_bytes"))
    return out


def backfill_remaining(events: DataFrame, errors: DataFrame, slow: DataFrame) -> DataFrame:
    """How many events still lack a mark or a fact: the union of three sets, each event once."""
    unmarked = events.where("rollups_1h_backfilled_at is null").select("id")
    no_error = events.where("status >= 400").select("id").join(errors.select("id"), "id", "left_anti")
    no_slow = events.where("request_time_ms >= 1000").select("id").join(slow.select("id"), "id", "left_anti")
    return unmarked.union(no_error).union(no_slow).distinct().agg(F.count("*").alias("remaining"))


# ---- jobs and files

def job_counts(jobs: DataFrame, recent: int = 200) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "id").limit(recent).groupBy("status").agg(F.count("*").alias("n"))


def slow_phases(steps: DataFrame, limit: int = 8) -> DataFrame:
    return steps.groupBy("job_name", "step_name").agg(
        F.count("*").alias("runs"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
    ).orderBy(F.desc("max_ms"), "job_name", "step_name").limit(limit)


def cycle_summary(jobs: DataFrame, pattern: str = "pipeline") -> DataFrame:
    """The two newest runs of jobs whose name fits, side by side with the time between them."""
    own = Window.partitionBy("name").orderBy(F.desc("started_at"), "id")
    rows = jobs.where(F.col("name").rlike(f"(?i){pattern}")).withColumn("__n", F.row_number().over(own)).where("__n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("__n") == n, F.col(c)))
    return rows.groupBy("name").agg(
        pick(1, "status").alias("latest_status"), pick(1, "started_at").alias("latest_at"), pick(2, "status").alias("previous_status"),
        pick(2, "started_at").alias("previous_at"),
    )


def file_stats(files: DataFrame, since: datetime) -> DataFrame:
    """Raw files by status, and failures since a time."""
    return files.groupBy("status").agg(
        F.count("*").alias("files"), R.count_if((F.col("status") == "failed") & (F.col("updated_at") >= R.at(since))).alias("failed_recent"),
    )


# ---- registered queries

def registered(ev: str, when: str, since: datetime, until: datetime) -> Iterator[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]]:
    from tidemark.plans import analysis as N

    c4, c5 = "count(*) FILTER (WHERE status BETWEEN 400 AND 499)", "count(*) FILTER (WHERE status BETWEEN 500 AND 599)"
    now = datetime(2024, 2, 1)
    window = lambda s, d: R.window(A.access_events(s, d), since, until)
    minutes = (until - since).total_seconds() / 60
    overview_sql = f"""{ev}, s AS (SELECT site_id, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, site_id LIMIT 1), i AS (SELECT client_ip, count(*) AS n FROM w WHERE client_ip IS NOT NULL GROUP BY 1 ORDER BY n DESC, client_ip LIMIT 1)
        SELECT requests, requests / CAST({minutes!r} AS DOUBLE) AS requests_per_minute, unique_ips, c4 / CAST(requests AS DOUBLE) AS status_4xx_rate, c5 / CAST(requests AS DOUBLE) AS status_5xx_rate, s.site_id AS top_site, s.n AS top_site_requests, i.client_ip AS top_ip, i.n AS top_ip_requests, latest AS latest_event_at, CAST(epoch(TIMESTAMP '{now}') - floor(epoch(latest)) AS BIGINT) AS event_lag_seconds
        FROM (SELECT count(*) AS requests, count(DISTINCT client_ip) AS unique_ips, {c4} AS c4, {c5} AS c5 FROM w), s, i, (SELECT max(ts) AS latest FROM ev)"""
    yield "overview", lambda s, d: overview(A.access_events(s, d), since, until, now), overview_sql
    with_minutes = lambda s, d: overview(A.access_events(s, d), since, until, now, R.build(A.access_events(s, d), "rollup_1m"))
    yield "overview_with_minutes", with_minutes, overview_sql

    def alert_sql(actor: str, kind: str, least: int) -> str:
        return f"(SELECT site_id, env, {actor} AS actor_value, count(*) AS requests, {c4} AS status_4xx, {c5} AS status_5xx, min(ts) AS first_seen, max(ts) AS last_seen, '{kind}' AS actor_type FROM w WHERE {actor} IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {least} ORDER BY status_5xx DESC, status_4xx DESC, requests DESC, site_id, env, actor_value LIMIT 50)"

    yield "alert_candidates", lambda s, d: alert_candidates(window(s, d)), f"""{ev}, c AS ({alert_sql('client_ip', 'ip', 50)} UNION ALL {alert_sql('path', 'path', 30)}),
        r AS (SELECT *, status_4xx / CAST(requests AS DOUBLE) AS r4, status_5xx / CAST(requests AS DOUBLE) AS r5, CASE WHEN actor_type = 'ip' AND status_5xx >= 10 AND status_5xx / CAST(requests AS DOUBLE) >= 0.10 THEN 'ip_5xx_burst' WHEN actor_type = 'ip' AND status_4xx >= 100 AND status_4xx / CAST(requests AS DOUBLE) >= 0.5 THEN 'ip_4xx_scan' WHEN actor_type = 'path' AND status_5xx >= 5 AND status_5xx / CAST(requests AS DOUBLE) >= 0.2 THEN 'path_5xx_hotspot' END AS rule_key FROM c)
        SELECT site_id, env, actor_value, requests, status_4xx, status_5xx, first_seen, last_seen, actor_type, rule_key, CAST(CASE rule_key WHEN 'ip_5xx_burst' THEN least(greatest(trunc(r5 * 70) + least(status_5xx // 10, 30), 35), 100) WHEN 'ip_4xx_scan' THEN least(greatest(trunc(r4 * 60) + least(status_4xx // 50, 30), 25), 90) ELSE least(greatest(trunc(r5 * 80) + least(status_5xx // 5, 20), 30), 95) END AS INT) AS score FROM r WHERE rule_key IS NOT NULL"""
    sites = f"(SELECT site_id, env, count(*) AS requests, {c4} AS status_4xx, {c5} AS status_5xx, coalesce(percentile_cont(0.95) WITHIN GROUP (ORDER BY request_time_ms), 0.0) AS p95 FROM w GROUP BY 1, 2)"
    yield "site_health", lambda s, d: site_health(N.site_summary(window(s, d))), f"""{ev} SELECT *, CASE WHEN risk >= 65 THEN 'critical' WHEN risk >= 25 THEN 'warning' ELSE 'healthy' END AS health FROM (SELECT site_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(least(99, floor(sum(status_4xx + status_5xx) / CAST(sum(requests) AS DOUBLE) * 900 + max(p95) / 90 + 0.5)) AS INT) AS risk FROM {sites} GROUP BY 1)"""
    yield "facets", lambda s, d: facets(window(s, d), "status", "env", "site_id", "path"), f"{ev} " + " UNION ALL ".join(
        f"SELECT '{c}' AS facet, CAST(coalesce(CAST({c} AS VARCHAR), '') AS VARCHAR) AS value, count(*) AS n FROM w GROUP BY 2" for c in ("status", "env", "site_id", "path")
    )
    yield "site_rates", lambda s, d: site_rates(A.access_events(s, d)), f"{ev} SELECT *, events / CASE WHEN last_seen > first_seen THEN (epoch_us(last_seen) - epoch_us(first_seen)) / CAST(86400000000 AS DOUBLE) ELSE 1.0 END AS events_per_day FROM (SELECT site_id, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM ev GROUP BY 1)"
    for column in ("client_ip", "path", "query"):
        yield f"dimension_{column}", lambda s, d, c=column: dimension(A.access_events(s, d), c), f"{ev} SELECT {column}, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS request_count FROM ev WHERE {column} IS NOT NULL GROUP BY 1"
    yield "dimension_insert_if_absent", lambda s, d: add_new(
        dimension(A.access_events(s, d).where("id % 2 = 0"), "path"), dimension(A.access_events(s, d), "path"), "path",
    ), f"{ev}, a AS (SELECT path, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS request_count FROM ev WHERE id % 2 = 0 GROUP BY 1) SELECT * FROM a UNION ALL SELECT path, min(ts), max(ts), count(*) FROM ev WHERE path NOT IN (SELECT path FROM a) GROUP BY 1"

    def segments(s: SparkSession, d: str) -> DataFrame:
        hour = F.date_trunc("hour", "ts")
        return A.access_events(s, d).groupBy("site_id", hour.alias("bucket_start")).agg(F.count("*").alias("line_count")).select(
            F.concat_ws("/", "site_id", F.date_format("bucket_start", "yyyyMMddHH")).alias("segment_id"), "bucket_start",
            (F.col("bucket_start") + F.expr("interval 1 hour")).alias("bucket_end"), "line_count",
        )

    yield "archive_groups", lambda s, d: archive_groups(segments(s, d), until, segments(s, d).where("line_count % 5 = 0")), f"""{ev}, sg AS (SELECT site_id, date_trunc('hour', ts) AS bucket_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS bucket_end, count(*) AS line_count FROM ev GROUP BY ALL)
        SELECT CAST(date_trunc('week', bucket_start) AS TIMESTAMP) AS range_start, count(*) AS segments, CAST(sum(line_count) AS BIGINT) AS line_count, min(bucket_start) AS first_bucket, max(bucket_end) AS last_bucket FROM sg WHERE bucket_end <= TIMESTAMP '{until}' AND line_count % 5 <> 0 GROUP BY 1"""
    yield "merged_intervals", lambda s, d: merged_intervals(A.access_events(s, d).where("status >= 500").select("site_id", F.col("ts").cast("timestamp").alias("range_start"), (F.col("ts").cast("timestamp") + F.expr("interval 30 minutes")).alias("range_end")), "site_id"), f"""{ev}, iv AS (SELECT site_id, ts AS range_start, ts + INTERVAL 30 MINUTE AS range_end FROM ev WHERE status >= 500),
        m AS (SELECT *, max(range_end) OVER (PARTITION BY site_id ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv), g AS (SELECT *, sum(CASE WHEN b IS NULL OR range_start > b THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY range_start, range_end) AS run FROM m) SELECT site_id, min(range_start) AS range_start, max(range_end) AS range_end FROM g GROUP BY site_id, run"""
    yield "database_probe_ips", lambda s, d: database_probe_ips(
        N.probe_groups(probes.probes(window(s, d)), "injection")
    ).withColumn("sites", F.array_join("sites", ", ")), f"{ev} SELECT client_ip, count(*) AS requests, {c4} AS status_4xx, {c5} AS status_5xx, string_agg(DISTINCT site_id, ', ' ORDER BY site_id) AS sites FROM w WHERE query = 'id=1%20OR%201%3D1' AND client_ip IS NOT NULL GROUP BY 1"
    yield "retention_counts", lambda s, d: retention_counts(
        {"access_events": (A.access_events(s, d), "ts", until), "log_events": (A.log_events(s, d), "ts", since)}
    ), f"{ev} SELECT 'access_events' AS \"table\", count(*) AS expired FROM ev WHERE ts < TIMESTAMP '{until}' UNION ALL SELECT 'log_events', count(*) FROM ev WHERE ts < TIMESTAMP '{since}'"

    ranges = [
        ("203.0.113.0/24", "net-all", "cloud"), ("203.0.113.64/26", "net-b", "edge"), ("203.0.113.96/28", "net-c", "crawler"),
        ("203.0.113.100/32", "net-d", "monitor"), ("203.0.113.64/26", "net-a", "fetcher"),
    ]

    def matched(s: SparkSession, d: str) -> DataFrame:
        table = s.createDataFrame(ranges, "cidr string, provider_id string, provider_type string")
        return I.longest_prefix(A.ip_intel(s, d).select("ip"), table)

    octet = "CAST(split_part(ip, '.', 4) AS INT)"
    case = lambda k: f"CASE WHEN {octet} > 255 THEN NULL WHEN {octet} = 100 THEN '{ranges[3][k]}' WHEN {octet} BETWEEN 96 AND 111 THEN '{ranges[2][k]}' WHEN {octet} BETWEEN 64 AND 127 THEN '{ranges[4][k]}' ELSE '{ranges[0][k]}' END"
    yield "longest_prefix_match", matched, f"{ev} SELECT ip, {case(0)} AS cidr, {case(1)} AS provider_id, {case(2)} AS provider_type FROM ip"
