"""Rollups: counters by minute or hour and key, declared as data, and windows that combine them with raw events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.params import with_params
from tidemark.functions.timewindow import whole

#: Upper edges of the latency histogram, in milliseconds; the last one stands for more.
LATENCY_EDGES = (50, 100, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000, 10000, 30000, 60000, 2147483647)


def count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def latency_edge(ms: str = "request_time_ms") -> str:
    """SQL of the first edge that a duration does not exceed; null stays null."""
    return f"CASE {' '.join(f'WHEN {ms} <= {e} THEN {e}' for e in LATENCY_EDGES[:-1])} WHEN {ms} IS NOT NULL THEN {LATENCY_EDGES[-1]} END"


def _status(n: int) -> str:
    return f"count_if(coalesce(status BETWEEN {n}00 AND {n}99, false))"


# measures are SQL text, as they are declared before there is a session
_REQUESTS = {"requests": "count(*)"}
_ERRORS = {"status_4xx": _status(4), "status_5xx": _status(5)}
_SEEN = {"first_seen": "min(ts)", "last_seen": "max(ts)"}
_BYTES = {"bytes_sent": "coalesce(sum(bytes_sent), 0)"}
_TIMES = {"request_time_count": "count(request_time_ms)", "request_time_sum_ms": "coalesce(sum(request_time_ms), 0)"}
_SLOW = {"slow_requests": "count_if(coalesce(request_time_ms >= 1000, false))"}
_UNIQUE_IPS = {"unique_ips": "count(DISTINCT client_ip)"}


@dataclass(frozen=True)
class Rollup:
    """One rollup table: its bucket, its keys after site and environment (name -> SQL), its measures and what rows it
    counts. ``unique`` names measures that count distinct values; they do not add up over buckets."""

    name: str
    width: str
    keys: dict[str, str]
    measures: dict[str, str]
    where: str | None = None
    unique: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return ["bucket_ts", "site_id", "env", *self.keys]


_FULL = _REQUESTS | _ERRORS | _BYTES | _SEEN


def _by(*names: str) -> dict[str, str]:
    return {n: n for n in names}


ROLLUPS = {
    r.name: r
    for r in (
        Rollup("rollup_1m", "minute", {}, _REQUESTS | {f"status_{n}xx": _status(n) for n in (2, 3, 4, 5)} | _UNIQUE_IPS | _BYTES | _TIMES | _SLOW | {"empty_user_agents": "count_if(coalesce(user_agent, '') = '')"}, unique=("unique_ips",)),
        Rollup("rollup_ip_1h", "hour", _by("client_ip"), _FULL, "client_ip is not null"),
        Rollup("rollup_path_1h", "hour", _by("path"), _FULL, "path is not null"),
        Rollup("rollup_user_agent_1h", "hour", _by("user_agent"), _FULL, "user_agent is not null"),
        Rollup("rollup_ip_path_1h", "hour", _by("client_ip", "path"), _FULL, "client_ip is not null and path is not null"),
        Rollup("rollup_ip_user_agent_1h", "hour", _by("client_ip", "user_agent"), _FULL, "client_ip is not null and user_agent is not null"),
        Rollup("rollup_status_1h", "hour", {"status": "coalesce(status, 0)"}, _REQUESTS | _SEEN),
        Rollup("rollup_site_latency_1h", "hour", {"bucket_le_ms": latency_edge()}, _REQUESTS, "request_time_ms is not null"),
        Rollup("rollup_path_latency_1h", "hour", _by("path") | {"bucket_le_ms": latency_edge()}, _REQUESTS | {"status_5xx": _status(5), "request_time_sum_ms": "sum(request_time_ms)"} | _SEEN, "path is not null and request_time_ms is not null"),
        Rollup("rollup_security_probe_1h", "hour", _by("family", "category", "rule_key"), {"events": "count(*)"} | _UNIQUE_IPS | _ERRORS | _SEEN, unique=("unique_ips",)),
    )
}


def grouped(rows: DataFrame, spec: Rollup, *also: str) -> DataFrame:
    """``rows`` counted by the rollup's keys, and by the columns ``also``."""
    rows = rows.where(spec.where) if spec.where else rows
    keyed = rows.withColumns({"bucket_ts": F.date_trunc(spec.width, "ts")} | {f"__{k}": F.expr(c) for k, c in spec.keys.items()})
    groups = [F.col("bucket_ts"), F.col("site_id"), F.col("env"), *(F.col(f"__{k}").alias(k) for k in spec.keys), *map(F.col, also)]
    return keyed.groupBy(*groups).agg(*_measures(spec.measures))


def _measures(measures: dict[str, str]) -> list[Column]:
    return [F.expr(c).alias(n) for n, c in measures.items()]


def build(events: DataFrame, name: str, *also: str) -> DataFrame:
    """One rollup over all of ``events``: a single partial-then-final aggregation."""
    return grouped(events, ROLLUPS[name], *also)


def build_probes(probes: DataFrame) -> DataFrame:
    """rollup_security_probe_1h over classified probes."""
    return build(probes, "rollup_security_probe_1h")


def build_params(events: DataFrame) -> DataFrame:
    """rollup_query_param_1h: by parameter and value, with the newest request as an example.

    Requests alike in address, agent and path are added up first, with the newest of them. The three distinct counts, for each
    of which Spark makes a copy of each row, then see each combination once; the long texts are in one of the copies only.
    """
    keys = ["bucket_ts", "site_id", "env", "param_family", "param", "value_hash"]
    rows = with_params(events).withColumns({"bucket_ts": F.date_trunc("hour", "ts"), "value_hash": F.md5("param_value")})
    parts = _REQUESTS | _ERRORS | _SLOW | _TIMES | _SEEN
    text = lambda c: F.coalesce(c, F.lit("")).alias(f"example_{c}")
    newest = F.max(F.struct("ts", "id", text("path"), text("query"), "param_value")).alias("__newest")
    alike = rows.groupBy(*keys, "client_ip", "user_agent", "path").agg(*_measures(parts), newest)
    sums = {n: f"min({n})" if n == "first_seen" else f"max({n})" if n == "last_seen" else f"sum({n})" for n in parts}
    unique = {"client_ip": "unique_ips", "user_agent": "unique_user_agents", "path": "unique_paths"}
    counted = alike.groupBy(*keys).agg(*_measures(sums), F.max("__newest").alias("__newest"), *(F.count_distinct(c).alias(n) for c, n in unique.items()))
    return counted.select(*keys, *sums, *unique.values(), "__newest.example_path", "__newest.example_query", "__newest.param_value")


def merge(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Two partial rollups added up: counters summed, first and last seen widened. Not for distinct counts."""
    return added(old.unionByName(new), name)


def added(rows: DataFrame, name: str) -> DataFrame:
    """Partial rows of a rollup added up by key."""
    spec = ROLLUPS[name]
    if spec.unique:
        raise ValueError(f"{name} counts distinct values, which do not add up")
    join = {n: f"min({n})" if n == "first_seen" else f"max({n})" if n == "last_seen" else f"sum({n})" for n in spec.measures}
    return rows.groupBy(*spec.columns).agg(*_measures(join))


def touched_hours(rows: DataFrame) -> DataFrame:
    """The hours that new rows fall into: what must be counted anew."""
    return rows.select(F.date_trunc("hour", "ts").alias("bucket_ts")).distinct()


def rebuild(events: DataFrame, old: DataFrame, name: str, hours: DataFrame) -> DataFrame:
    """``old`` with the given hours counted anew; hours without any raw event left are kept as they are, as their
    events may have expired."""
    hour = lambda df, c: df.withColumn("__hour", F.date_trunc("hour", c))
    raw = hour(events, "ts").join(hours.withColumnRenamed("bucket_ts", "__hour"), "__hour", "left_semi")
    fresh = build(raw.drop("__hour"), name)
    counted = raw.select("__hour").distinct()
    return hour(old, "bucket_ts").join(counted, "__hour", "left_anti").drop("__hour").unionByName(fresh)


def at(t: datetime) -> Column:
    """A time as a literal, read in the session's zone like the events' own."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


# ---- windows: whole buckets from the rollup, the rest from raw events

def window(events: DataFrame, since: datetime, until: datetime, site: str = "") -> DataFrame:
    """Raw events of [since, until), of one site or all."""
    rows = events.where((F.col("ts") >= at(since)) & (F.col("ts") < at(until)))
    return rows.where(F.col("site_id") == site) if site else rows


def rollup_with_edges(rollup: DataFrame, events: DataFrame, name: str, since: datetime, until: datetime, site: str = "") -> DataFrame:
    """Rows of one rollup for exactly [since, until): whole buckets as stored, the edges counted from events.

    A bucket cut by an edge gives a row of its own from the events inside the window; a window shorter than a
    bucket comes from events alone."""
    spec = ROLLUPS[name]
    lo, hi = whole(since, until, 60 if spec.width == "minute" else 3600)
    stored = rollup.where((F.col("bucket_ts") >= at(lo)) & (F.col("bucket_ts") < at(hi)))
    edge = window(events, since, until, site).where((F.col("ts") < at(lo)) | (F.col("ts") >= at(hi)))
    stored = stored.where(F.col("site_id") == site) if site else stored
    return stored.unionByName(grouped(edge, spec))


# ---- readiness: may a window be read from a rollup?

def dimension_ready(events: DataFrame, since: datetime, until: datetime) -> bool:
    """No event of the whole hours is still unmarked; a window without a whole hour is ready."""
    lo, hi = whole(since, until, 3600)
    return lo >= hi or window(events, lo, hi).where("rollups_1h_backfilled_at is null").isEmpty()


def same_total(a: DataFrame, b: DataFrame, since: datetime, until: datetime, width: int = 3600) -> bool:
    """Two rollups count the same requests in the whole buckets; zero is ready."""
    lo, hi = whole(since, until, width)
    total = lambda df: df.where((F.col("bucket_ts") >= at(lo)) & (F.col("bucket_ts") < at(hi))).agg(F.coalesce(F.sum("requests"), F.lit(0))).first()[0]
    return total(a) == total(b)


def timeline_ready(events: DataFrame, minutes: DataFrame, since: datetime, until: datetime) -> bool:
    """The minute rollup counts every event of the whole minutes."""
    lo, hi = whole(since, until, 60)
    counted = minutes.where((F.col("bucket_ts") >= at(lo)) & (F.col("bucket_ts") < at(hi))).agg(F.coalesce(F.sum("requests"), F.lit(0))).first()[0]
    return window(events, lo, hi).count() == counted


def params_ready(events: DataFrame, params: DataFrame, since: datetime, until: datetime) -> bool:
    """Every hour, site and environment with a query has a parameter row; without a whole hour, not ready."""
    lo, hi = whole(since, until, 3600)
    if lo >= hi:
        return False
    keys = ["bucket_ts", "site_id", "env"]
    asked = window(events, lo, hi).where("coalesce(query, '') <> ''").select(F.date_trunc("hour", "ts").alias("bucket_ts"), "site_id", "env").distinct()
    return asked.join(params.select(*keys).distinct(), keys, "left_anti").isEmpty()


def choose(ready: bool, from_rollup, from_events) -> DataFrame:
    """The rollup's plan where it is complete, else that over events; both are functions, built on demand."""
    return from_rollup() if ready else from_events()


def histogram_p95(rows: DataFrame, *keys: str, share: float = 0.95) -> DataFrame:
    """The least edge that holds ``share`` of all requests, by key, from (bucket_le_ms, requests) rows."""
    edges = rows.groupBy(*keys, "bucket_le_ms").agg(F.sum("requests").alias("n"))
    own = Window.partitionBy(*keys)
    held = edges.withColumns({"upto": F.sum("n").over(own.orderBy("bucket_le_ms")), "total": F.sum("n").over(own)})
    return held.where(F.col("upto") >= F.ceil(F.col("total") * F.lit(share))).groupBy(*keys).agg(F.min("bucket_le_ms").cast("double").alias("p95_request_time_ms"))
