import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bots, params, parsing, probes, search, timewindow, trust, useragent

COMBINED = '203.0.113.10 - - [17/Jun/2026:14:22:31 +0000] "GET /foo?bar=baz HTTP/1.1" 404 123 "https://example.com/start" "Mozilla/5.0"'
FIELDS = parsing.ACCESS.fieldNames()


def access(line):
    row = parsing.parse_access(line)
    return dict(zip(FIELDS, row, strict=True)) if row else None


def test_access_line():
    got = access(COMBINED)
    assert (got["path"], got["query"], got["status"], got["bytes_sent"], got["user_agent"], got["client_ip"]) == ("/foo", "bar=baz", 404, 123, "Mozilla/5.0", "203.0.113.10")


@pytest.mark.parametrize(
    ("tail", "ip", "ms", "upstream"),
    [
        ('"curl/8" 0.123 "212.47.78.48, 140.248.75.59, 10.1.1.34"', "212.47.78.48", 123, 0),
        ('"curl/8" 1.234 0.250', "10.1.1.34", 1234, 250),
        ('"curl/8" 1.234 "0.100, 0.250, -"', "10.1.1.34", 1234, 250),
        ('"curl/8" 0.0001 "0.1, x"', "10.1.1.34", 1, 0),
        ('"curl/8" nan 99999999', "10.1.1.34", 0, 86_400_000),
    ],
)
def test_access_times_and_addresses(tail, ip, ms, upstream):
    got = access(f'10.1.1.34 - - [17/Jun/2026:14:22:31 +0000] "GET / HTTP/1.1" 200 1 "-" {tail}')
    assert (got["client_ip"], got["request_time_ms"], got["upstream_time_ms"], got["referer"]) == (ip, ms, upstream, "")


def test_unix_socket_is_no_address():
    assert access('unix: - - [17/Jun/2026:14:22:31 +0000] "GET / HTTP/1.1" 200 1 "-" "curl/8" 0.1 "178.18.254.57, 140.248.74.81, unix:"')["client_ip"] == "178.18.254.57"


@pytest.mark.parametrize(
    ("target", "expected"),
    [
        ("/a/www.youtube.com%2Fwatch%3Fv%3Dlh", ("/a/www.youtube.com/watch", "v=lh", "", "")),
        ("/a%3Fb=1?c=2", ("/a", "b=1&c=2", "", "")),
        ("https://x.example/p+q?r=%20", ("/p+q", "r=%20", "https", "x.example")),
        ("/bad%zz?q", ("/bad%zz", "q", "", "")),
        ("", ("/", "", "", "")),
        ("*", ("*", "", "", "")),
    ],
)
def test_targets(target, expected):
    assert parsing.split_target(target) == expected


def test_lines_without_request_are_none():
    assert access("not a log line") is None
    assert access("") is None


def test_access_column(spark):
    rows = spark.createDataFrame([("﻿" + COMBINED,), ("2026-06-17T14:22:31Z GET /",), ("not a log line",), (None,)], "line string")
    got = rows.select(parsing.access_time(F.col("line")).alias("ts"), parsing.access_fields(parsing.clean_line(F.col("line"))).alias("a")).collect()
    assert [str(r.ts) for r in got] == ["2026-06-17 14:22:31", "2026-06-17 14:22:31", "None", "None"]
    assert [r.a.path for r in got] == ["/foo", None, None, None]


def test_ordinary_lines_are_read_as_by_the_parser(spark):
    r = random.Random(1)
    ips = ["203.0.113.9", "10.0.0.1", "256.1.1.1", "1.2.3.04", "-", "unix:", "2001:db8::1", "host"]
    targets = ["/", "/a/b", "/a?x=1", "/a?x=%20&y", "/a%20b", "//h/p", "/a?b?c", "/a#f", "*", "/a?q=1,2", "https://x.example/p", "/é?ü", "/a:b?c:d", "/?"]
    agents = ["-", "curl/8", "Mozilla/5.0 (X11) (KHTML, like Gecko)", "x, 8.8.8.8", "a [b] c", 'say \\"hi\\"', "", "é", "GET /x HTTP/1.1"]
    times = ["", " 0.1", " -", " 1.5 0.25", " 0 0.0004", ' 1 "0.1, 0.2"', ' 0.2 "8.8.8.8, 10.0.0.1"', " nan", " 1e3", " 5 6 7", " 99999999"]
    pick = lambda *of: r.choice(of)
    lines = [
        f'{r.choice(ips)} - {pick("-", "bob", "a b")} [17/Jun/2026:14:22:31 +0000] "{pick("GET", "POST", "get")} {r.choice(targets)} HTTP/{pick("1.1", "2.0", "x")}" '
        f'{pick("200", "404", "-", "1000")} {pick("5", "-", "0", "99999999999999999999")} "{pick("-", "https://e.example/a?b", "x,y", "")}" "{r.choice(agents)}"{r.choice(times)}'
        for _ in range(20_000)
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").where(parsing.is_ordinary(F.col("line"))).withColumn("a", parsing.ordinary_fields(F.col("line"))).collect()
    assert len(rows) > 100
    for row in rows:
        assert tuple(row.a) == parsing.parse_access(row.line), row.line


@pytest.mark.parametrize(
    ("line", "ts", "severity", "start"),
    [
        ("[20-Jun-2026 01:02:29 UTC] PHP Warning: Undefined array key in /code/index.php on line 1", "2026-06-20 01:02:29", "warning", "PHP Warning"),
        ("2026-06-20  1:26:10 110662 [Warning] Aborted connection", "2026-06-20 01:26:10", "warning", "110662"),
        ("# Time: 260618 13:46:23", "2026-06-18 13:46:23", "info", ""),
        ("[Tue Jun 23 00:28:25.918877 2026] [authz_core:error] [pid 2116256:tid 1] AH01630: client denied", "2026-06-23 00:28:25.918877", "error", "[authz_core:error]"),
        ("2026/06/20 10:00:00 [crit] 12#0: *1 connect() failed", "2026-06-20 10:00:00", "critical", "12#0"),
        ("2026-06-20T10:00:00.5+0200 note: all well", "2026-06-20 08:00:00.500000", "notice", "note"),
        ("no time here", None, None, None),
    ],
)
def test_log_lines(spark, line, ts, severity, start):
    p = spark.createDataFrame([(line,)], "line string").select(parsing.parse_log(F.col("line")).alias("p")).first().p
    if ts is None:
        assert p is None
    else:
        assert (str(p.ts), p.severity) == (ts, severity)
        assert p.message.startswith(start)


def test_log_types(spark):
    names = [("a/nginx-access.log.gz", "nginx-access", "nginx-access", "nginx-access"), ("a/shop_error.log", "unknown", "apache-error", "apache-error"), ("x/my-mysql-slow.log", "mysql-slow", "mysql-slow", "unknown"), ("mysqld-slow-query.log", "mysql-slow", "mysql-slow", "mysql-slow"), ("notes.txt", "unknown", "unknown", "unknown")]
    df = spark.createDataFrame(names, "p string, a string, b string, c string")
    p = F.col("p")
    assert df.where(~((parsing.hosted_log_type(p) == F.col("a")) & (parsing.local_log_type(p) == F.col("b")) & (parsing.combined_log_type(p) == F.col("c")))).collect() == []


AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/126.0.6478.127 Safari/537.36", "Chrome", "126.0.6478", "Windows", "10/11", "Desktop", "browser", 30 - 0),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) AppleWebKit/605.1 Version/17.5 Mobile/15E148 Safari/604.1", "Safari", "17.5", "iOS", "17.5", "Mobile", "browser", 30),
    ("curl/8.7.1", "curl", "8.7.1", "", "", "unknown", "tool", 65),
    ("sqlmap/1.8.7#stable", "sqlmap", "", "", "", "unknown", "malicious", 95),
    ("Mozilla/5.0 (compatible; AhrefsBot/7.0)", "ahrefs", "", "", "", "unknown", "crawler", 45),
    ("SomeSpider 1", "generic-crawler", "", "", "", "unknown", "crawler", 50),
    ("", "empty", "", "", "", "unknown", "missing", 55),
    (None, "empty", "", "", "", "unknown", "missing", 55),
    ("Thing/1 (x)", "thing", "", "", "", "unknown", "unknown", 30),
]


@pytest.mark.parametrize("case", AGENTS, ids=lambda c: str(c[0])[:20])
def test_user_agents(spark, case):
    a = spark.createDataFrame([(case[0],)], "ua string").select(useragent.analyse(F.col("ua")).alias("a")).first().a
    assert (a.family, a.browser_version, a.os_family, a.os_version, a.device_family, a.actor_type, a.risk_score) == case[1:]


def classify(spark, method, path, query, status):
    df = spark.createDataFrame([(method, path, query, status)], "method string, path string, query string, status int")
    return sorted((r.family, r.category, r.match_reason) for r in probes.probes(df).collect())


@pytest.mark.parametrize("query", ["id=1%20OR%201%3D1", "id=1+and+1=1", "id=1%2527%2520OR%25201%253D1"])
def test_tautologies(spark, query):
    assert classify(spark, "GET", "/x", query, 200) == [("injection", "sql_injection", "tautology")]


@pytest.mark.parametrize(
    ("method", "path", "query", "status", "expected"),
    [
        ("GET", "/download", "file=%252e%252e%252fwp-config.php", 200, ["secret_file"]),
        ("GET", "/products/…", "lid=dProducts-and-Services/.../Category/x", 200, []),
        ("GET", "/news/example-customer-selects-example-platform/", None, 200, []),
        ("POST", "/wp-login.php", None, 200, ["admin_login"]),
        ("GET", "/wp-login.php", None, 200, ["admin_path"]),
        ("GET", "/wp-admin/admin-ajax.php", None, 200, []),
        ("GET", "/wp-admin/admin-ajax.php", None, 403, ["admin_path"]),
        ("GET", "/phpMyAdmin/", "q=<script>", 404, ["admin_tool", "xss"]),
        ("GET", "/a", "x=union%20all%20select%201", 200, ["sql_injection"]),
        ("GET", "/../../etc/passwd", None, 400, ["path_traversal"]),
        ("GET", None, None, None, []),
    ],
)
def test_probes(spark, method, path, query, status, expected):
    assert [c for _, c, _ in classify(spark, method, path, query, status)] == expected


def test_params(spark):
    df = spark.createDataFrame([("?A=1=2&utm_x=&flag&=v&gclid=9",), (None,), ("",)], "query string")
    assert sorted((r.param, r.param_value, r.param_family) for r in params.with_params(df).collect()) == [("a", "1=2", "other"), ("flag", "", "other"), ("gclid", "9", "click_id"), ("utm_x", "", "utm")]


def test_windows():
    assert [timewindow.bucket_seconds(timedelta(hours=h)) for h in (0.5, 3, 7 * 24, 90 * 24, 365 * 24)] == [60, 60, 3600, 86400, 259200]
    assert timewindow.parse_range("weekly") == (timedelta(days=7), "7d")
    assert timewindow.parse_range("1h30m") == (timedelta(minutes=90), "1h30m")
    assert timewindow.parse_range("nonsense") == (timedelta(hours=1), "1h")
    assert timewindow.parse_range("daily", aliases=False) == (timedelta(hours=1), "1h")
    a, b = datetime(2024, 1, 1, 10, 7, 30), datetime(2024, 1, 1, 12, 0)
    assert timewindow.whole(a, b, 3600) == (datetime(2024, 1, 1, 11), b)
    assert timewindow.whole(a, b, 60) == (datetime(2024, 1, 1, 10, 8), b)
    assert timewindow.resolve(b, "15m", a)[::2] == (a, "custom")
    with pytest.raises(ValueError):
        timewindow.resolve(a, "1h", b)


def test_spans():
    day = datetime(2024, 1, 1)
    spans = [timedelta(days=366), timedelta(days=90), timedelta(days=30), timedelta(days=7), timedelta(hours=24), timedelta(minutes=60), timedelta(hours=72), timedelta(minutes=90), timedelta(minutes=5), timedelta(0)]
    assert [timewindow.span_of(day, day + s) for s in spans] == [
        ("365d", "annual"), ("90d", "quarterly"), ("30d", "monthly"), ("7d", "weekly"), ("24h", "daily"), ("1h", "period"), ("72h0m0s", "period"), ("1h30m0s", "period"), ("5m0s", "period"), ("0s", "period"),
    ]


def test_trust(spark):
    rows = [("Ahrefs", "crawler", None, True, None, True, True), ("Tor exit", "tor", None, True, True, False, False), ("AWS", "cloud", None, True, None, False, True), ("x", "unknown", "allowlisted", None, None, True, True), ("x", "crawler", "suspicious", True, True, False, False), (None, None, None, None, None, False, False)]
    df = spark.createDataFrame(rows, "k string, t string, m string, f boolean, v boolean, strict boolean, loose boolean")
    args = [F.col(c) for c in "ktmfv"]
    assert df.where((trust.verified_source(*args) != F.col("strict")) | (trust.verified_source_loose(*args) != F.col("loose"))).collect() == []


def test_bot_kinds(spark):
    rows = [("openai", "OpenAI", "crawler", "GPTBot/1", 40, "ai"), ("googlebot", "Google", "crawler", "Googlebot/2.1", 25, "search"), ("pingdom", "Pingdom", "monitor", "Pingdom", 20, "monitors"), ("z", "", "tool", "z", 10, "tools"), ("nikto", "Nikto", "malicious", "Nikto", 95, "suspicious"), ("y", "", "browser", "y", 15, "other")]
    df = spark.createDataFrame(rows, "f string, k string, t string, s string, r int, kind string")
    kind = bots.bot_kind(F.col("f"), F.col("k"), F.col("t"), F.col("s"), F.lit(None), F.col("r"), F.lit(None))
    assert df.where(kind != F.col("kind")).collect() == []


def test_search(spark):
    assert search.parse('a "b c" OR site:x') == [[("", "a"), ("", "b c")], [("site", "x")]]
    df = spark.createDataFrame([(1, "site-1", "/a", 500), (2, "site-2", "/b", 404), (3, None, None, None)], "id int, site_id string, path string, status int")
    ids = lambda q: [r.id for r in search.search(df, q).orderBy("id").collect()]
    assert ids("") == [1, 2, 3]
    assert ids("status:>=500") == [1]
    assert ids("path:/* status:<500") == [2]
    assert ids("site:site-1 or severity:warning") == [1, 2]
    assert ids("nothing:here") == []


def test_lines_without_a_valid_address_need_no_python(spark):
    lines = [f'{ip} - - [05/Jan/2024:10:00:00 +0000] "GET /a?b=1 HTTP/1.1" 200 5 "-" "x y" 0.250' for ip in ("203.0.113.900", "203.0.113.9", "1.2.3", "010.1.1.1", "7", "1.2.3.4.5", ".", "256.1.1.1")]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").where(parsing.is_ordinary(F.col("line"))).withColumn("a", parsing.ordinary_fields(F.col("line"))).collect()
    assert len(rows) == len(lines)
    assert all(tuple(r.a) == parsing.parse_access(r.line) for r in rows)
