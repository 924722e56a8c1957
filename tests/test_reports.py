import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intel as I
from tidemark.operators import rollups as R
from tidemark.plans import adapter as A
from tidemark.plans import analysis as N
from tidemark.plans import overview as O

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return A.access_events(spark, SF).cache()


@pytest.mark.parametrize("seed", range(3))
def test_windows_from_rollups_equal_raw_events(events, seed):
    random.seed(seed)
    since = datetime(2024, 1, 3) + timedelta(seconds=random.randrange(20 * 86400))
    until = since + timedelta(seconds=random.choice([1000, 5000, 400_000]))
    whole = R.rollup_with_edges(R.build(events, "rollup_ip_1h"), events, "rollup_ip_1h", since, until)
    raw = R.window(events, since, until)
    a = whole.groupBy("client_ip").agg(F.sum("requests").alias("n"), F.sum("bytes_sent").alias("b"), F.min("first_seen").alias("f"))
    b = raw.where("client_ip is not null").groupBy("client_ip").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("b"), F.min("ts").alias("f"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_readiness(events):
    since, until = datetime(2024, 1, 5, 1), datetime(2024, 1, 9)
    marked = events.withColumn("rollups_1h_backfilled_at", F.when(F.col("id") >= 0, F.col("ts")))
    assert R.dimension_ready(marked, since, until)
    assert not R.dimension_ready(marked.withColumn("rollups_1h_backfilled_at", F.lit(None).cast("timestamp")), since, until)
    minutes = R.build(events, "rollup_1m")
    assert R.timeline_ready(events, minutes, since, until)
    assert not R.timeline_ready(events, minutes.where("minute(bucket_ts) < 30"), since, until)
    assert R.same_total(minutes, R.build(events, "rollup_status_1h"), since, until)
    assert R.params_ready(events, R.build_params(events), since, until)
    assert not R.params_ready(events, R.build_params(events).limit(0), since, until)
    assert not R.params_ready(events, R.build_params(events), since, since + timedelta(minutes=20))


def test_rebuild_keeps_hours_without_raw_events(events):
    old = R.build(events, "rollup_status_1h")
    kept = R.rebuild(events.where("day(ts) > 10"), old, "rollup_status_1h", R.touched_hours(events))
    assert kept.exceptAll(old).isEmpty() and old.exceptAll(kept).isEmpty()


def test_issue_scores(spark):
    site = spark.createDataFrame([("s", "live", 1000, 0, 500, 4000.0, 1, 2)], "site_id string, env string, requests long, status_4xx long, status_5xx long, p95_request_time_ms double, first_seen int, last_seen int")
    ip = spark.createDataFrame([("1.1.1.1", 400, 300, 60, 1, 2)], "client_ip string, requests long, status_4xx long, status_5xx long, first_seen int, last_seen int")
    agent = spark.createDataFrame([("x", "missing", "empty", "", 55, False, 3000, 1, 2)], "sample string, actor_type string, family string, known_actor string, risk_score int, verified_source boolean, requests long, first_seen int, last_seen int")
    slow = spark.createDataFrame([], "site_id string, env string, path string, requests long, p95_request_time_ms double, first_seen int, last_seen int")
    hot = spark.createDataFrame([], "site_id string, env string, path string, requests long, status_5xx long, first_seen int, last_seen int")
    logs = spark.createDataFrame([("php-error", "info", 2500, 1, 2)], "log_type string, severity string, events long, first_seen int, last_seen int")
    got = {r.rule_key: (r.score, r.severity) for r in N.issues(site, ip, agent, slow, hot, logs).collect()}
    assert got == {"site_5xx_rate": (85, "critical"), "site_slow_p95": (60, "high"), "ip_5xx_burst": (35, "medium"), "ip_4xx_scan": (51, "high"), "missing_user_agent": (48, "medium"), "php-error_log_activity": (37, "medium")}


def test_longest_prefix_with_both_families(spark):
    ips = spark.createDataFrame([("203.0.113.5",), ("2001:db8::1",), ("::ffff:203.0.113.9",), ("bad",), (None,), ("198.51.100.1",)], "ip string")
    ranges = spark.createDataFrame([("203.0.113.0/24", "b"), ("203.0.113.0/29", "z"), ("203.0.113.0/29", "y"), ("2001:db8::/32", "six"), ("0.0.0.0/0", "all")], "cidr string, provider_id string")
    assert {r.ip: r.provider_id for r in I.longest_prefix(ips, ranges).collect()} == {"203.0.113.5": "y", "2001:db8::1": "six", "::ffff:203.0.113.9": "b", "bad": None, None: None, "198.51.100.1": "all"}
    allow = spark.createDataFrame([(2, "203.0.113.0/24", "net", "office"), (1, "203.0.113.5", "one", "person")], "position int, cidr string, label string, actor_type string")
    assert {r.ip: r.allow_label for r in I.allowlisted(ips, allow).where("allow_label is not null").collect()} == {"203.0.113.5": "one", "::ffff:203.0.113.9": "net"}


def test_provider_documents(spark):
    docs = spark.createDataFrame([("p", "P", "crawler", "u", "json", '{"a": [{"ip": "10.1.2.3/8"}, "::1", 5], "b": "192.0.2.7"}'), ("q", "Q", "edge", "u", "text", "see 198.51.100.0/24, and 2001:db8::/32; 0.0.0.0"), ("r", "R", "edge", "u", "json", "{")], "provider_id string, provider_name string, actor_type string, source_url string, kind string, body string")
    assert sorted((r.provider_id, r.cidr) for r in I.provider_ranges(docs).collect()) == [("p", "10.0.0.0/8"), ("p", "192.0.2.7/32"), ("q", "198.51.100.0/24"), ("q", "2001:db8::/32")]


def test_assembly_order(spark):
    schema = "ip string, names array<string>, forward_confirmed boolean, asn_org string, is_tor_exit boolean, provider_name string, provider_type string, allow_label string, allow_type string, requests long, status_4xx long, status_5xx long"
    rows = [
        ("crawler", ["crawl-1.googlebot.com."], True, None, None, None, None, None, None, 10, 0, 0),
        ("cloud", [], None, "Amazon.com", None, None, None, None, None, 100, 90, 0),
        ("tor", None, None, "OVH", True, None, None, None, None, 10, 0, 0),
        ("official", [], None, "Amazon", None, "Bingbot", "crawler", None, None, 10, 0, 0),
        ("friend", [], None, None, None, None, None, "Office", "office", 20000, 0, 0),
        ("nobody", [], None, None, None, None, None, None, None, 1500, 0, 0),
    ]
    got = {r.ip: (r.actor_type, r.known_actor, r.risk_score, r.verified_actor, r.is_datacenter) for r in I.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"crawler": ("crawler", "Google", 25, True, False), "cloud": ("datacenter", "AWS", 85, False, True), "tor": ("tor", "Tor exit", 80, False, False), "official": ("crawler", "Bingbot", 55, False, False), "friend": ("office", "Office", 10, True, False), "nobody": ("unknown", "", 50, False, False)}


def test_merges(spark):
    stored = spark.createDataFrame([("a", "crawler", "suspicious", 80), ("b", "unknown", None, 20)], "ip string, actor_type string, manual_action string, risk_score int")
    fresh = spark.createDataFrame([("a", "datacenter", 30), ("c", "tor", 80)], "ip string, actor_type string, risk_score int")
    assert sorted(map(tuple, I.merge(stored, fresh).collect())) == [("a", "datacenter", "suspicious", 80), ("b", "unknown", None, 20), ("c", "tor", None, 80)]
    keys = "rule_key string, site_id string, env string, actor_type string, actor_value string, score int, first_seen int, last_seen int"
    old, new = spark.createDataFrame([("r", "s", "e", "ip", "1", 90, 5, 7)], keys), spark.createDataFrame([("r", "s", "e", "ip", "1", 40, 6, 9), ("q", "s", "e", "ip", "1", 30, 1, 1)], keys)
    assert sorted(tuple(r)[0:1] + tuple(r)[5:] for r in O.merge_alerts(old, new).collect()) == [("q", 30, 1, 1), ("r", 40, 5, 9)]
    alerts = spark.createDataFrame([(1, "critical", 1), (2, "low", 2), (3, "high", 3)], "alert_id int, severity string, last_seen int")
    sent = spark.createDataFrame([(1, "delivered"), (3, "failed")], "alert_id int, status string")
    assert [r.alert_id for r in O.notifications(alerts, sent).collect()] == [3]


def test_archive_choice():
    day = datetime(2024, 1, 1)
    make = lambda n, kind, a, b: {"id": n, "granularity": kind, "range_start": day + timedelta(days=a), "range_end": day + timedelta(days=b)}
    rows = [make("d1", "daily", 1, 2), make("d2", "daily", 2, 3), make("weekly-1", "weekly", 0, 7), make("gap", "daily", 9, 10), make("out", "daily", 30, 31)]
    chosen = O.choose_archives(rows, day, day + timedelta(days=14))
    assert [c["id"] for c in chosen] == ["weekly-1", "gap"]
    assert O.covered_seconds([(c["range_start"], c["range_end"]) for c in chosen], day, day + timedelta(days=14)) == 8 * 86400
    hour = lambda a, b: (day + timedelta(hours=a), day + timedelta(hours=b))
    assert O.covered_seconds([hour(-1, 2), hour(1, 4), hour(5, 8)], day, day + timedelta(hours=6)) == 5 * 3600


def test_projection(events):
    rate = O.twenty_site_rate(O.site_rates(events))
    got = O.projection(20, rate, {"events_per_day": rate / 2, "days": 10, "bytes_per_event": 100, "raw_bytes_per_day": 1000, "rollups": 50}, {"hot": 60, "archive": 90, "report": 30, "raw": 5})
    assert got["rollups_bytes"] == 50 * 2 * 9
    assert (got["raw_bytes"], got["archive_bytes"]) == (10_000, 45_000)
    assert got["total_bytes"] == sum(v for k, v in got.items() if k.endswith("_bytes") and k != "total_bytes")


def test_report(spark, events):
    w = R.window(events, datetime(2024, 1, 5), datetime(2024, 1, 20))
    probes = spark.createDataFrame([("admin_x", 5), ("probe_y", 2)], "rule_key string, requests long")
    intel, tor = A.ip_intel(spark, SF), spark.createDataFrame([(4,)], "requests long")
    issues = spark.createDataFrame([("critical",), ("low",)], "severity string")
    row = O.report_summary(N.totals(w), issues, probes, tor).first().asDict()
    assert (row["critical_issues"], row["admin_probe_requests"], row["injection_probe_requests"], row["tor_requests"]) == (1, 5, 2, 4)
    assert "2 issues, 1 of them" in O.report_text(row)
    charts = O.report_charts(N.timeline(w, 3600), N.status_breakdown(w), N.site_summary(w), N.top_ips(w), N.user_agents(w, intel), N.slow_paths(w), probes)
    assert len(charts) == 7 and all(c.columns == ["label", "value", "secondary"] for c in charts.values())
    assert charts["traffic_timeline"].count() <= 120


def test_jobs_and_files(spark):
    t = datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(k, n, s, t + timedelta(minutes=k)) for k, (n, s) in enumerate((("Pipeline", "ok"), ("pipeline", "failed"), ("pipeline", "ok"), ("other", "ok")))], "id int, name string, status string, started_at timestamp_ntz")
    row = O.cycle_summary(jobs).where("name = 'pipeline'").first()
    assert (row.latest_status, row.previous_status) == ("ok", "failed")
    assert {r.status: r.n for r in O.job_counts(jobs, 2).collect()} == {"ok": 2}
    files = spark.createDataFrame([("failed", t), ("failed", t + timedelta(days=2)), ("downloaded", t)], "status string, updated_at timestamp_ntz")
    assert {r.status: (r.files, r.failed_recent) for r in O.file_stats(files, t + timedelta(days=1)).collect()} == {"failed": (2, 1), "downloaded": (1, 0)}


def test_empty_tables(spark, events):
    none = events.limit(0)
    assert N.totals(none).first().requests == 0
    assert N.site_summary(none).isEmpty() and N.query_params(none).isEmpty() and O.alert_candidates(none).isEmpty()


def test_lookups(spark):
    from tidemark.operators import lookups as L

    ips = spark.createDataFrame([("1.2.3.4",), ("2001:db8::1",), ("x",)], "ip string").select(L.origin_host("ip").alias("h")).collect()
    assert [r.h for r in ips] == ["4.3.2.1.origin.asn.cymru.com", "1." + "0." * 23 + "8.b.d.0.1.0.0.2.origin6.asn.cymru.com", None]
    a = spark.createDataFrame([("13335 132892 | 1.1.1.0/24 | US | arin | 2010-07-14",)], "a string").select(L.parse_origin(F.col("a")).alias("a")).first().a
    assert tuple(a) == (13335, "1.1.1.0/24", "US", "arin")
    raw = '{"handle": "N", "country": "US", "cidr0_cidrs": [{"v4prefix": "1.1.1.0", "length": 24}, {"length": 3}], "events": [{"eventAction": "Registration", "eventDate": "d"}], "links": [{"href": ""}, {"rel": "self", "href": "h"}]}'
    r = [x.r for x in spark.createDataFrame([(raw,), ("{",)], "a string").select(L.flatten_rdap(F.col("a")).alias("r")).collect()]
    assert (r[0].handle, r[0].cidrs, r[0].registration, len(r[0].links), r[1]) == ("N", ["1.1.1.0/24"], "d", 1, None)
    reverse = spark.createDataFrame([("1.1.1.1", "a"), ("2.2.2.2", "b")], "ip string, name string")
    forward = spark.createDataFrame([("a", "1.1.1.1"), ("b", "9.9.9.9")], "name string, ip string")
    assert {x.ip: x.forward_confirmed for x in L.forward_confirmed(reverse, forward).collect()} == {"1.1.1.1": True, "2.2.2.2": False}


def test_provider_files(spark, tmp_path):
    from tidemark.sources import providers

    (tmp_path / "bingbot.json").write_text('{"prefixes": [{"ipv4Prefix": "192.0.2.0/24"}]}')
    (tmp_path / "unheard-of").write_text("192.0.2.0/24")
    assert [(r.provider_id, r.cidr) for r in I.provider_ranges(providers.documents(spark, str(tmp_path))).collect()] == [("bingbot", "192.0.2.0/24")]
    assert len(providers.PROVIDERS) == 26


def test_read_audit_and_evidence(spark, events):
    since, until = datetime(2024, 1, 5, 10, 7, 30), datetime(2024, 1, 9, 5, 13)
    marked = events.withColumn("rollups_1h_backfilled_at", F.col("ts"))
    facts = events.where("status >= 400 and id % 10 <> 0")
    got = O.read_audit(marked, facts, R.build(events, "rollup_1m"), R.build(events, "rollup_status_1h"), since, until)
    assert got["traffic_source"] == "dimension rollups + hour edge events" and got["raw_gap_rows"] > 0
    assert got["expected_raw_rows"] < R.window(events, since, until).count()
    assert O.evenly(list(range(100)), 4) == [0, 33, 66, 99] and O.evenly([1, 2], 4) == [1, 2]
    packed = O.evidence({"t": "x" * 300}, {"traffic_timeline": [{"v": k} for k in range(500)], "other": [{}] * 99}, {"issues": [{}] * 40})
    assert len(packed["summary"]["t"]) == 240 and [len(v) for v in packed["charts"].values()] == [24, 24] and len(packed["drilldowns"]["issues"]) == 8


def test_stored_agents_are_filled(spark):
    from tidemark.functions import useragent as U

    schema = "ua string, s struct<family string, browser_family string, browser_version string, os_family string, os_version string, device_family string, actor_type string, known_actor string, is_bot boolean, is_tool boolean, risk_score int>"
    df = spark.createDataFrame([("curl/8.7.1", ("tool", "", None, "", "", "unknown", "tool", "Somebody", None, False, 0))], schema)
    got = df.select(U.merge_stored(F.col("s"), U.analyse(F.col("ua"))).alias("m")).first().m
    assert (got.family, got.browser_version, got.known_actor, got.is_tool, got.risk_score) == ("curl", "8.7.1", "Somebody", True, 65)
    stored = spark.createDataFrame([("a", "", "x", 1, 1), ("b", "f", "x", 1, 2), ("c", "f", "x", None, 3)], "user_agent string, family string, actor_type string, risk_score int, last_seen int")
    assert [r.user_agent for r in O.stale_agents(stored).collect()] == ["c", "a"]


def test_scans_read_what_they_need(spark):
    from tidemark.plans import registry

    spark.catalog.clearCache()  # else the plan reads the events kept above
    plan = registry.queries()["status_breakdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "user_id" not in plan and "props" not in plan


def test_database_probes_of_more_addresses_than_a_page(spark, tmp_path):
    from tidemark.plans import registry

    n = 100_050  # each an address, site and path of its own
    one = spark.range(n).selectExpr("id * 40 + 1 AS event_id", "TIMESTAMP '2024-01-06 00:00:00' AS ts", "id * 37 + 1 AS user_id", "'view' AS event_type", "1.0D AS value", "'' AS props")
    one.write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["database_probe_ips"](spark, str(tmp_path))
    assert got.agg(F.count("*"), F.sum("requests")).first() == (n, n)


def test_query_params_hash_their_counts(spark, tmp_path, monkeypatch):
    """No aggregate over all rows sorts them: only the examples of the last moment, for the report's rows, are strings."""
    day = datetime(2024, 1, 6)
    rows = [(k, day if k > 5 else day - timedelta(hours=1), f"10.0.0.{k % 3}", f"/p{k}", "a=1&b=2" if k % 2 else "a=1", 500 if k % 2 else 200, k) for k in range(10)]
    events = spark.createDataFrame(rows, "id long, ts timestamp, client_ip string, path string, query string, status int, request_time_ms int")
    plans, keep = [], N.kept
    monkeypatch.setattr(N, "kept", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, *more))
    got = {(x.param, x.param_value): (x.requests, x.unique_ips, x.unique_paths, x.example_path, x.example_query) for x in N.query_params(events).collect()}
    assert got == {("a", "1"): (10, 3, 10, "/p9", "a=1&b=2"), ("b", "2"): (5, 3, 5, "/p9", "a=1&b=2")}
    assert len(plans) == 1 and "SortAggregate" not in plans[0] and "ObjectHashAggregate" not in plans[0]
