"""Access events, log events and IP intelligence made from the generic ``events`` table, by one text that Spark and
DuckDB both read. Real logs come from ``sources``; this serves benchmarks and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.store import RollupStore
from tidemark.sources.scratch import new_path

#: Column -> SQL over ``events``.
ACCESS = {
    "id": "event_id",
    "ts": "ts",
    "site_id": "concat('site-', CAST(user_id % 5 AS STRING))",
    "env": "CASE WHEN event_id % 10 = 0 THEN 'dev' ELSE 'live' END",
    "client_ip": "CASE WHEN user_id % 37 = 0 THEN NULL ELSE concat('203.0.113.', CAST(user_id AS STRING)) END",
    "method": "CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END",
    "path": "CASE WHEN event_id % 50 = 7 THEN '/wp-login.php' WHEN event_id % 50 = 8 THEN '/.env' ELSE concat('/', event_type, '/', CAST(event_id % 5 AS STRING)) END",
    "query": "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 40 = 1 THEN 'id=1%20OR%201%3D1' ELSE concat('k=', CAST(event_id % 7 AS STRING), '&utm_source=s', CAST(user_id % 3 AS STRING), '&flag') END",
    "status": "CASE WHEN event_type = 'error' THEN (CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 503 END) WHEN event_type = 'click' THEN 302 WHEN event_type = 'signup' THEN 201 ELSE 200 END",
    "bytes_sent": "CAST(floor(value * 100) AS BIGINT)",
    "user_agent": "CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'curl/8.7.1' WHEN 2 THEN 'python-requests/2.32.3' WHEN 3 THEN 'Mozilla/5.0 (compatible; AhrefsBot/7.0)' WHEN 4 THEN 'sqlmap/1.8.7' ELSE 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/126.0.6478.127 Safari/537.36' END",
    "request_time_ms": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 20) AS INT) END",
}
LOGS = {
    "id": "event_id", "ts": "ts", "site_id": ACCESS["site_id"], "env": ACCESS["env"],
    "log_type": "CASE event_id % 4 WHEN 0 THEN 'php-error' WHEN 1 THEN 'nginx-error' WHEN 2 THEN 'php-slow' ELSE 'mysql' END",
    "severity": "CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'notice' END",
    "message": "concat('handler ', event_type, ' failed in step ', CAST(event_id % 9 AS STRING))",
    "raw": "concat('[', event_type, '] handler failed in step ', CAST(event_id % 9 AS STRING))",
}
INTEL = {
    "ip": "concat('203.0.113.', CAST(user_id AS STRING))",
    "actor_type": "CASE user_id % 7 WHEN 0 THEN 'crawler' WHEN 1 THEN 'datacenter' WHEN 2 THEN 'unknown' WHEN 3 THEN 'tor' WHEN 4 THEN 'monitor' WHEN 5 THEN 'cloud' ELSE '' END",
    "known_actor": "CASE user_id % 7 WHEN 0 THEN 'Ahrefs' WHEN 3 THEN 'Tor exit' WHEN 4 THEN 'Pingdom' ELSE '' END",
    "manual_action": "CASE WHEN user_id % 29 = 0 THEN 'suspicious' WHEN user_id % 31 = 0 THEN 'allowlisted' ELSE NULL END",
    "forward_confirmed": "user_id % 2 = 0",
    "verified_actor": "user_id % 14 = 0",
    "is_tor_exit": "user_id % 7 = 3",
    "is_datacenter": "user_id % 7 IN (1, 5)",
    "risk_score": "CAST(user_id % 100 AS INT)",
    "country_code": "CASE user_id % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' ELSE NULL END",
}


def _select(columns: dict[str, str], distinct: bool = False) -> str:
    return f"SELECT {'DISTINCT ' * distinct}" + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM events"


#: Common table expressions for DuckDB: ev, lg and ip.
ACCESS_SQL, LOGS_SQL, INTEL_SQL = _select(ACCESS), _select(LOGS), _select(INTEL, True)


def _read(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"{sql} AS {name}" for name, sql in columns.items()))


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, ACCESS)


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, LOGS)


def ip_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, INTEL).distinct()


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access events as raw log lines of one file a site, as a web server would have written them."""
    e = access_events(spark, sf_dir)
    seconds = F.concat(F.floor(F.col("request_time_ms") / 1000), F.lit("."), F.lpad((F.col("request_time_ms") % 1000).cast("string"), 3, "0"))
    target = F.concat("path", F.when(F.col("query").isNull(), "").otherwise(F.concat(F.lit("?"), "query")))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    raw = F.concat(
        dash(F.col("client_ip")), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), F.lit('] "'), "method", F.lit(" "), target,
        F.lit(' HTTP/1.1" '), "status", F.lit(" "), "bytes_sent", F.lit(' "-" "'), dash(F.col("user_agent")), F.lit('" '), dash(seconds),
    )
    return e.select(
        "site_id", "env", F.lit("c1").alias("container_id"), F.lit("nginx-access").alias("log_type"),
        F.concat("site_id", F.lit(".log")).alias("raw_file_id"), F.col("id").alias("raw_line_no"), raw.alias("raw"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log events as lines of their kinds: a PHP error and a slow log, a web server's error log and a database's."""
    e = log_events(spark, sf_dir)
    level = F.when(F.col("severity") == "critical", "crit").when(F.col("severity") == "warning", "warn").otherwise(F.col("severity"))
    at = lambda form: F.date_format("ts", form)
    raw = (
        F.when(F.col("log_type") == "php-error", F.concat(F.lit("["), at("dd-MMM-yyyy HH:mm:ss"), F.lit(" UTC] PHP Warning: "), "message"))
        .when(F.col("log_type") == "nginx-error", F.concat(at("yyyy/MM/dd HH:mm:ss"), F.lit(" ["), level, F.lit("] 1#0: "), "message"))
        .when(F.col("log_type") == "php-slow", F.concat(F.lit("["), at("dd-MMM-yyyy HH:mm:ss"), F.lit("] [pool www] "), "message"))
        .otherwise(F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), "id", F.lit(" ["), F.initcap("severity"), F.lit("] "), "message"))
    )
    return e.select(
        "site_id", "env", F.lit("c1").alias("container_id"), "log_type", F.concat("site_id", F.lit(".log")).alias("raw_file_id"),
        F.col("id").alias("raw_line_no"), raw.alias("raw"),
    )


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as DuckDB gives them."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, t in df.dtypes if t == "timestamp"})


_stores: dict[tuple[str, str, bool], RollupStore] = {}
#: Rollups of the store that has a gap hold what came before this batch.
_LATE = 2


def rollup_store(spark: SparkSession, sf_dir: str, *names: str, gap: bool = False) -> RollupStore:
    """A store of the access events, written once a session, that holds the named rollups of them.

    Events come in three batches, the last one of late lines. With ``gap``, the rollups do not hold that one."""
    key = (spark.sparkContext.applicationId, sf_dir, gap)
    if key not in _stores:
        _stores[key] = store = RollupStore(spark, new_path(spark, "rollup-store"), "day")
        events = access_events(spark, sf_dir)
        late = "id % 211 = 0"
        store.append(events.where(f"id % 3 <> 0 AND NOT {late}"), 0)
        store.append(events.where(f"id % 3 = 0 AND NOT {late}"), 1)
        if not gap:
            store.append(events.where(late), _LATE)
    store = _stores[key]
    if gap and store.held("events").where(F.col("batch") == _LATE).isEmpty():
        store.backfill(*GAP_ROLLUPS)
        store.append(access_events(spark, sf_dir).where("id % 211 = 0"), _LATE)
    if not gap:
        store.backfill(*names)
    return store


GAP_ROLLUPS = ("rollup_1m", "rollup_ip_1h", "rollup_site_latency_1h", "rollup_path_1h")
