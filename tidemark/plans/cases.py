"""Registered queries over written-out inputs: every event gets the case of its number, and what the library makes of it is
compared with the values that the case must give.

They cover the branches of parsers and classifiers that the generic test tables do not reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import catalog, parsing, probes, useragent
from tidemark.operators import combine as C
from tidemark.operators import intel as I

Found = tuple[str, Callable[[SparkSession, str], DataFrame], str]


def by_case(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """``id`` and the columns of the case that each event's number picks."""
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"n int, {schema}")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), (F.col("event_id") % len(rows)).cast("int").alias("n"))
    return events.join(F.broadcast(table), "n").drop("n")  # the list above


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool) or not isinstance(value, str):
        return str(value).lower()
    quoted = value.replace("'", "''")
    return f"'{quoted}'"


def expected_sql(columns: dict[str, str], rows: list[tuple[int, tuple]], cases: int) -> str:
    """DuckDB SQL of the expected rows (case number, values); a case may have none or several."""
    values = ", ".join(f"({n}, {', '.join(map(_literal, r))})" for n, r in rows)
    names = ", ".join(columns)
    typed = ", ".join(f"CAST(c.{c} AS {t}) AS {c}" for c, t in columns.items())
    return f"SELECT event_id AS id, {typed} FROM events JOIN (VALUES {values}) AS c(n, {names}) ON event_id % {cases} = n"


def _all(rows: list[tuple]) -> list[tuple[int, tuple]]:
    return list(enumerate(rows))


def _inputs_sql(rows: list[str], name: str) -> str:
    values = ", ".join(f"({n}, {_literal(r)})" for n, r in enumerate(rows))
    return f"(SELECT event_id AS id, {name} FROM events JOIN (VALUES {values}) AS c(n, {name}) ON event_id % {len(rows)} = n)"


# ---- access and log lines

_ACCESS = {
    "ts": "TIMESTAMP", "client_ip": "VARCHAR", "method": "VARCHAR", "scheme": "VARCHAR", "host": "VARCHAR", "path": "VARCHAR", "query": "VARCHAR", "status": "INTEGER",
    "bytes_sent": "BIGINT", "referer": "VARCHAR", "user_agent": "VARCHAR", "request_time_ms": "INTEGER", "upstream_time_ms": "INTEGER",
}
_AT = "17/Jun/2026:14:22:31 +0000"
_T = "2026-06-17 14:22:31"
#: (line, its fields; None: no access line)
_LINES: list[tuple[str, tuple | None]] = [
    (f'203.0.113.10 - - [{_AT}] "GET /foo?bar=baz HTTP/1.1" 404 123 "https://example.com/start" "Mozilla/5.0"', (_T, "203.0.113.10", "GET", None, None, "/foo", "bar=baz", 404, 123, "https://example.com/start", "Mozilla/5.0", None, None)),
    (f'203.0.113.10 - - [{_AT}] "GET /group/www.youtube.com%2Fwatch%3Fv%3DlhfVm HTTP/1.1" 404 1 "-" "x"', (_T, "203.0.113.10", "GET", None, None, "/group/www.youtube.com/watch", "v=lhfVm", 404, 1, None, "x", None, None)),
    (f'﻿203.0.113.10 - - [{_AT}] "GET / HTTP/1.1" 200 5 "-" "-"', (_T, "203.0.113.10", "GET", None, None, "/", None, 200, 5, None, None, None, None)),
    (f'10.1.1.34 - - [{_AT}] "GET / HTTP/1.1" 200 1 "-" "curl/8" 0.123 "212.47.78.48, 140.248.75.59, 10.1.1.34"', (_T, "212.47.78.48", "GET", None, None, "/", None, 200, 1, None, "curl/8", 123, None)),
    (f'unix: - - [{_AT}] "GET / HTTP/1.1" 200 1 "-" "curl/8" 0.1 "178.18.254.57, 140.248.74.81, unix:"', (_T, "178.18.254.57", "GET", None, None, "/", None, 200, 1, None, "curl/8", 100, None)),
    (f'203.0.113.7 - - [{_AT}] "GET / HTTP/1.1" 200 1 "-" "curl/8" 1.234 0.250', (_T, "203.0.113.7", "GET", None, None, "/", None, 200, 1, None, "curl/8", 1234, 250)),
    (f'203.0.113.7 - - [{_AT}] "GET / HTTP/1.1" 200 1 "-" "curl/8" 1.234 "0.100, 0.250, -"', (_T, "203.0.113.7", "GET", None, None, "/", None, 200, 1, None, "curl/8", 1234, 250)),
    (f'203.0.113.7 - bob [17/Jun/2026:16:22:31 +0200] "POST /a/b HTTP/2.0" 201 - "-" "Mozilla/5.0 (X11; Linux) Gecko (KHTML, like Gecko) Chrome/1" 0.0001', (_T, "203.0.113.7", "POST", None, None, "/a/b", None, 201, 0, None, "Mozilla/5.0 (X11; Linux) Gecko (KHTML, like Gecko) Chrome/1", 1, None)),
    (f'2001:db8::1 - - [{_AT}] "GET https://shop.example/x?y=1 HTTP/1.1" 200 7 "-" "x" 2', (_T, "2001:db8::1", "GET", "https", "shop.example", "/x", "y=1", 200, 7, None, "x", 2000, None)),
    (f'203.0.113.9 - - [{_AT}] "GET /q?a=1&b=%20c HTTP/1.1" 1234 9 "-" "x" -', (_T, "203.0.113.9", "GET", None, None, "/q", "a=1&b=%20c", None, 9, None, "x", None, None)),
    (f'203.0.113.9 - - [{_AT}] "GET /with\\"quote HTTP/1.1" 200 9 "-" "say \\"hi\\"" 0.5 x', (_T, "203.0.113.9", "GET", None, None, '/with"quote', None, 200, 9, None, 'say "hi"', 500, None)),
    (f'203.0.113.9 - - [{_AT}] "GET /bad%zz?q#f HTTP/1.1" 200 9 "-" "x"', (_T, "203.0.113.9", "GET", None, None, "/bad%zz", "q#f", 200, 9, None, "x", None, None)),
    (f'not.an.address - - [{_AT}] "GET /n HTTP/1.1" 503 9 "-" "x" 99999999', (_T, None, "GET", None, None, "/n", None, 503, 9, None, "x", 86400000, None)),
    ("2026-06-17T14:22:31Z GET /", None),
    ("not a log line", None),
    ("", None),
]


def _access_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_case(spark, sf_dir, "raw string", [(line,) for line, _ in _LINES])
    lines = rows.select(
        "id", "raw",
        *(F.lit(x).alias(c) for x, c in zip(("s", "live", "c", "nginx-access", "f"), (*C.SOURCE, "log_type", "raw_file_id"), strict=True)),
        F.col("id").alias("raw_line_no"),
    )
    timed = C.line_times(lines).withColumn("fingerprint", F.col("id").cast("string"))
    events, _ = C.index_access(timed)
    return events.select(F.col("id").cast("long").alias("id"), *_ACCESS)


_LOGS = {"ts": "TIMESTAMP", "severity": "VARCHAR", "message": "VARCHAR"}
_LOG_LINES: list[tuple[str, tuple]] = [
    ("[20-Jun-2026 01:02:29 UTC] PHP Warning: Undefined array key in /code/index.php on line 1", ("2026-06-20 01:02:29", "warning", "PHP Warning: Undefined array key in /code/index.php on line 1")),
    ("2026-06-20  1:26:10 110662 [Warning] Aborted connection", ("2026-06-20 01:26:10", "warning", "110662 [Warning] Aborted connection")),
    ("# Time: 260618 13:46:23", ("2026-06-18 13:46:23", "info", "")),
    ("[Tue Jun 23 00:28:25.918877 2026] [authz_core:error] [pid 2116256:tid 1] AH01630: client denied", ("2026-06-23 00:28:25.918877", "error", "[authz_core:error] [pid 2116256:tid 1] AH01630: client denied")),
    ("2026/06/20 10:00:00 [crit] 12#0: *1 connect() failed", ("2026-06-20 10:00:00", "critical", "12#0: *1 connect() failed")),
    ("2026/06/20 10:00:00 [warn] x", ("2026-06-20 10:00:00", "warning", "x")),
    ("2026/06/20 10:00:00 [debug] x", ("2026-06-20 10:00:00", "debug", "x")),
    ("2026-06-20T10:00:00.5+0200 note: all well", ("2026-06-20 08:00:00.5", "notice", "note: all well")),
    ("2026-06-20 10:00:00 PHP Fatal error: out of memory", ("2026-06-20 10:00:00", "critical", "PHP Fatal error: out of memory")),
    ("[20-Jun-2026 01:02:29] [ERR] disk", ("2026-06-20 01:02:29", "error", "[ERR] disk")),
    ("260618  3:46:23 InnoDB: an exception", ("2026-06-18 03:46:23", "error", "InnoDB: an exception")),
    ("#0 a trace without a time", (None, None, None)),
]
_FILES = {"hosted": "VARCHAR", "local_type": "VARCHAR", "combined": "VARCHAR"}
_FILE_NAMES: list[tuple[str, tuple]] = [
    ("a/nginx-access.log.gz", ("nginx-access", "nginx-access", "nginx-access")), ("a/NGINX-error.log-2024", ("nginx-error", "nginx-error", "nginx-error")),
    ("a/php-fpm-error.log", ("php-error", "php-error", "php-error")), ("php-slow.log", ("php-slow", "php-slow", "php-slow")),
    ("a/shop_error.log", ("unknown", "apache-error", "apache-error")), ("a/shop-access.log.gz", ("unknown", "apache-access", "apache-access")),
    ("x/my-mysql-slow.log", ("mysql-slow", "mysql-slow", "unknown")), ("mysqld-slow-query.log", ("mysql-slow", "mysql-slow", "mysql-slow")),
    ("mysql.log", ("mysql", "mysql", "mysql")), ("apache-access.log", ("apache-access", "apache-access", "apache-access")), ("notes.txt", ("unknown", "unknown", "unknown")),
]


def _log_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsing.parse_log(F.col("raw"))
    return by_case(spark, sf_dir, "raw string", [(x,) for x, _ in _LOG_LINES]).withColumn("p", p).select("id", *(F.col(f"p.{c}").alias(c) for c in _LOGS))


def _file_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    kinds = (parsing.hosted_log_type(path), parsing.local_log_type(path), parsing.combined_log_type(path))
    return by_case(spark, sf_dir, "path string", [(x,) for x, _ in _FILE_NAMES]).select("id", *(k.alias(c) for k, c in zip(kinds, _FILES, strict=True)))


# ---- user agents and services

_AGENT = {
    "family": "VARCHAR", "browser_family": "VARCHAR", "browser_version": "VARCHAR", "os_family": "VARCHAR", "os_version": "VARCHAR", "device_family": "VARCHAR",
    "actor_type": "VARCHAR", "known_actor": "VARCHAR", "is_bot": "BOOLEAN", "is_tool": "BOOLEAN", "risk_score": "INTEGER",
}
_W, _M = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15"
_A, _I = "Mozilla/5.0 (Linux; Android 14; SM-S918B) AppleWebKit/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) AppleWebKit/605.1.15"


def _browser(name: str, version: str, system: str, system_version: str, device: str) -> tuple:
    return (name, name, version, system, system_version, device, "browser", "", False, False, 15)


def _tool(name: str, version: str) -> tuple:
    return (name, "", version, "", "", "unknown", "tool", "", False, True, 65)


#: (user agent, number of requests, its analysis)
_AGENTS: list[tuple[str | None, int, tuple]] = [
    (f"{_W} Chrome/126.0.6478.127 Safari/537.36", 2000, _browser("Chrome", "126.0.6478", "Windows", "10/11", "Desktop")),
    (f"{_W} Chrome/126.0.0.0 Safari/537.36 Edg/126.0.2592.87", 2000, _browser("Microsoft Edge", "126.0.2592", "Windows", "10/11", "Desktop")),
    (f"{_W} Chrome/110.0.0.0 Safari/537.36 OPR/96.0.1", 2000, _browser("Opera", "96.0.1", "Windows", "10/11", "Desktop")),
    (f"{_A} SamsungBrowser/25.0 Chrome/121.0.0.0 Mobile Safari/537.36", 2000, _browser("Samsung Internet", "25.0", "Android", "14", "Mobile")),
    (f"{_M} Version/17.4.1 Safari/605.1.15", 2000, _browser("Safari", "17.4.1", "macOS", "10.15.7", "Desktop")),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:127.0) Gecko/20100101 Firefox/127.0", 2000, _browser("Firefox", "127.0", "Linux", "", "Desktop")),
    ("Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) AppleWebKit/537.36 Chrome/126.0.0.0 Safari/537.36", 2000, _browser("Chrome", "126.0.0", "Chrome OS", "14541.0.0", "Desktop")),
    ("Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 6.1)", 2000, _browser("Internet Explorer", "8.0", "Windows", "7", "Desktop")),
    ("Mozilla/5.0 (Windows NT 6.3; Trident/7.0; rv:11.0) like Gecko", 2000, _browser("Internet Explorer", "11.0", "Windows", "8.1", "Desktop")),
    ("Mozilla/5.0 (Windows NT 6.2) Chromium/90.0.4430.1", 2000, _browser("Chrome", "90.0.4430", "Windows", "8", "Desktop")),
    ("curl/8.7.1", 5, _tool("curl", "8.7.1")), ("Wget/1.21.4", 5, _tool("Wget", "1.21.4")), ("python-requests/2.32.3", 5, _tool("python-requests", "2.32.3")),
    ("Python/3.11 aiohttp/3.9.5", 5, _tool("aiohttp", "3.9.5")), ("Go-http-client/1.1", 5, _tool("go-http-client", "1.1")), ("okhttp/4.12.0", 5, _tool("okhttp", "4.12.0")), ("Java/17.0.10", 5, _tool("java-client", "17.0.10")),
    ("sqlmap/1.8.7#stable (https://sqlmap.org)", 5, ("sqlmap", "", "", "", "", "unknown", "malicious", "sqlmap", False, False, 95)),
    ("Mozilla/5.0 (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)", 20000, ("ahrefs", "", "", "", "", "unknown", "crawler", "Ahrefs", True, False, 45)),
    ("Pingdom.com_bot_version_1.4", 5, ("pingdom", "", "", "", "", "unknown", "monitor", "Pingdom", False, True, 20)),
    ("SomeSpider 1", 5, ("generic-crawler", "", "", "", "", "unknown", "crawler", "", True, False, 50)),
    ("SomeSpider 1", 20000, ("generic-crawler", "", "", "", "", "unknown", "crawler", "", True, False, 60)),
    ("Thing/1 (x)", 5, ("thing", "", "", "", "", "unknown", "unknown", "", False, False, 30)),
    ("Thing/1 (x)", 1000, ("thing", "", "", "", "", "unknown", "unknown", "", False, False, 45)),
    ("  ", 5, ("empty", "", "", "", "", "unknown", "missing", "", False, False, 55)), (None, 5, ("empty", "", "", "", "", "unknown", "missing", "", False, False, 55)),
]


def _agent_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_case(spark, sf_dir, "agent string, requests int", [(a, n) for a, n, _ in _AGENTS])
    return rows.withColumn("a", useragent.analyse(F.col("agent"), F.col("requests"))).select("id", *(F.col(f"a.{c}").alias(c) for c in _AGENT))


_SERVICE = {"family": "VARCHAR", "known_actor": "VARCHAR", "actor_type": "VARCHAR", "risk_score": "INTEGER"}
_AGENT_NAMES = [f"Mozilla/5.0 (compatible; {x.title()}/1.0)" for s in catalog.SERVICES for x in s.agents] + ["nothing known"]
_HOSTS = [
    h for s in catalog.SERVICES for h in (
        *(f"A.{x}1.example" for x in s.dns_parts), *(f"Crawl-1.{x}." for x in s.dns_suffixes), *(f"not{x}" for x in s.dns_suffixes), *s.dns_suffixes,
    )
] + ["host.example"]
_ORGS = [f"AS1 {x.upper()} Inc." for s in catalog.SERVICES for x in s.orgs] + ["Somebody else"]


def _services(column: str, rows: list[str], by: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = by_case(spark, sf_dir, f"{column} string", [(x,) for x in rows]).withColumn("s", by(F.col(column)))
        return found.select("id", column, *(F.col(f"s.{c}").alias(c) for c in _SERVICE))

    return run


def _services_sql(column: str, rows: list[str], text: str, sql: Callable[[str, str], str]) -> str:
    fields = ", ".join(f"CAST({sql(text, c)} AS {t}) AS {c}" for c, t in _SERVICE.items())
    return f"SELECT id, {column}, {fields} FROM {_inputs_sql(rows, column)}"


# ---- probes

_PROBE = {"family": "VARCHAR", "category": "VARCHAR", "rule_key": "VARCHAR", "match_reason": "VARCHAR"}


def _found(*kinds: str) -> list[tuple]:
    """``category`` of an admin probe, or ``category:reason`` of an injection."""
    return [("injection", k.split(":")[0], f"probe_{k.split(':')[0]}", k.split(":")[1]) if ":" in k else ("admin", k, f"admin_{k}", "") for k in kinds]


#: (method, path, query, status, what is found)
_REQUESTS: list[tuple[str, str | None, str | None, int | None, list[tuple]]] = [
    ("GET", "/phpMyAdmin/index.php", None, 404, _found("admin_tool")), ("GET", "/XMLRPC.php", None, 200, _found("admin_tool")), ("GET", "/adminer-4.php", None, 200, _found("admin_tool")),
    ("GET", "/wp-login.php", "action=lostpassword", 200, _found("password_reset")), ("POST", "/password/reset", None, 200, _found("password_reset")),
    ("POST", "/wp-login.php", None, 200, _found("admin_login")), ("POST", "/index.php", "controller=AdminLogin", 200, _found("admin_login")), ("POST", "/user/login", None, 200, _found("admin_login")),
    ("GET", "/wp-login.php", None, 200, _found("admin_path")), ("GET", "/administrator/", None, 200, _found("admin_path")), ("GET", "/wp-admin/admin-ajax.php", None, 200, _found()), ("GET", "/wp-admin/admin-ajax.php", None, 403, _found("admin_path")),
    ("GET", "/x", "id=1%20OR%201%3D1", 200, _found("sql_injection:tautology")), ("GET", "/x", "id=1+and+1=1", 200, _found("sql_injection:tautology")), ("GET", "/x", "id=1%2527%2520OR%25201%253D1", 200, _found("sql_injection:tautology")),
    ("GET", "/a", "x=union%20all%20select%201", 200, _found("sql_injection:union_select")), ("GET", "/a", "x=1;select+name+from+users", 200, _found("sql_injection:select_from")),
    ("GET", "/a", "q=information_schema.tables", 200, _found("sql_injection:information_schema")), ("GET", "/a", "q=1-sleep(5)", 200, _found("sql_injection:time_delay_function")),
    ("GET", "/a", "q=extractvalue(1,2)", 200, _found("sql_injection:sql_function")), ("GET", "/a", "q=union/**/all", 200, _found("sql_injection:sql_comment_with_keyword")),
    ("GET", "/a", "q=<script>x", 200, _found("xss:script_tag")), ("GET", "/a", "q=%3Cscript%3E", 200, _found("xss:script_tag")), ("GET", "/a", "q=javascript:x", 200, _found("xss:xss_payload")),
    ("GET", "/.env.local", None, 404, _found("secret_file:secret_file")), ("GET", "/.git/config", None, 404, _found("secret_file:secret_file")), ("GET", "/download", "file=%252e%252e%252fwp-config.php", 200, _found("secret_file:secret_file")),
    ("GET", "/../../etc/passwd", None, 400, _found("path_traversal:path_traversal")), ("GET", "/f", "name=..%5cboot", 200, _found("path_traversal:path_traversal")),
    ("GET", "/phpMyAdmin/", "q=<script>", 404, _found("admin_tool", "xss:script_tag")), ("GET", "/products/…", "lid=dProducts-and-Services/.../Category/x", 200, _found()),
    ("GET", "/news/example-customer-selects-example-platform/", None, 200, _found()), ("GET", None, None, None, _found()),
]


def _probe_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_case(spark, sf_dir, "method string, path string, query string, status int", [r[:4] for r in _REQUESTS])
    return probes.probes(rows).select("id", *_PROBE)


# ---- networks

_NETWORK = {"cidr": "VARCHAR", "provider_id": "VARCHAR"}
_RANGES = [
    ("203.0.113.0/24", "b"), ("203.0.113.0/29", "z"), ("203.0.113.0/29", "y"), ("2001:db8::/32", "six"), ("2001:db8:0:1::/64", "part"),
    ("2001:db8::5/128", "one"), ("198.0.0.0/8", "wide"),
]
_ADDRESSES: list[tuple[str | None, tuple]] = [
    ("203.0.113.5", ("203.0.113.0/29", "y")), ("203.0.113.9", ("203.0.113.0/24", "b")), ("::ffff:203.0.113.9", ("203.0.113.0/24", "b")), ("198.51.100.1", ("198.0.0.0/8", "wide")), ("192.0.2.1", (None, None)),
    ("2001:db8::1", ("2001:db8::/32", "six")), ("2001:DB8:0:1::9", ("2001:db8:0:1::/64", "part")), ("2001:db8::5", ("2001:db8::5/128", "one")), ("2001:db9::1", (None, None)), ("bad", (None, None)), ("203.0.113.05", (None, None)), (None, (None, None)),
]
_DOCUMENTS: list[tuple[str, str, list[str]]] = [
    ("json", '{"a": [{"ip": "10.1.2.3/8"}, "::1", 5], "b": "192.0.2.7"}', ["10.0.0.0/8", "192.0.2.7/32"]), ("json", '{"v": ["2001:DB8::/32", "2001:db8::/32", "fe80::1%eth0", "0.0.0.0/0"]}', ["2001:db8::/32"]),
    ("text", "see 198.51.100.0/24, and (2001:db8::/32); 0.0.0.0 or 300.1.1.1", ["198.51.100.0/24", "2001:db8::/32"]), ("json", "{", []), ("text", "", []),
]


def _network_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(_RANGES, "cidr string, provider_id string")
    return I.longest_prefix(by_case(spark, sf_dir, "ip string", [(a,) for a, _ in _ADDRESSES]), table).select("id", *_NETWORK)


def _document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_case(spark, sf_dir, "kind string, body string", [r[:2] for r in _DOCUMENTS])
    return rows.select("id", F.explode(I.document_ranges("body", "kind")).alias("cidr"))


def registered() -> Iterator[Found]:
    each = [(n, r) for n, (_, r) in enumerate(_LINES) if r]
    yield "access_line_cases", _access_cases, expected_sql(_ACCESS, each, len(_LINES))
    yield "log_line_cases", _log_cases, expected_sql(_LOGS, _all([r for _, r in _LOG_LINES]), len(_LOG_LINES))
    yield "log_file_types", _file_cases, expected_sql(_FILES, _all([r for _, r in _FILE_NAMES]), len(_FILE_NAMES))
    yield "user_agent_cases", _agent_cases, expected_sql(_AGENT, _all([r for *_, r in _AGENTS]), len(_AGENTS))
    yield "services_by_agent", _services("agent", _AGENT_NAMES, catalog.by_user_agent), _services_sql("agent", _AGENT_NAMES, "lower(trim(agent))", catalog.agent_sql)
    yield "services_by_host", _services("host", _HOSTS, catalog.by_reverse_dns), _services_sql("host", _HOSTS, "rtrim(lower(trim(host)), '.')", catalog.host_sql)
    yield "services_by_org", _services("org", _ORGS, catalog.by_network_org), _services_sql("org", _ORGS, "lower(trim(org))", catalog.org_sql)
    found = [(n, r) for n, (*_, rows) in enumerate(_REQUESTS) for r in rows]
    yield "probe_cases", _probe_cases, expected_sql(_PROBE, found, len(_REQUESTS))
    yield "network_cases", _network_cases, expected_sql(_NETWORK, _all([r for _, r in _ADDRESSES]), len(_ADDRESSES))
    ranges = [(n, (c,)) for n, (*_, rows) in enumerate(_DOCUMENTS) for c in rows]
    yield "provider_document_cases", _document_cases, expected_sql({"cidr": "VARCHAR"}, ranges, len(_DOCUMENTS))
