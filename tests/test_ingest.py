import gzip
import io
import json
import tarfile
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import combine as C
from tidemark.operators import rollups as R
from tidemark.sources import logs
from tidemark.streaming import ingest

LINE = '203.0.113.{n} - - [17/Jun/2026:14:{m:02d}:31 +0000] "GET /p{n} HTTP/1.1" {s} 10 "-" "curl/8" 0.2'
RAW = "site_id string, env string, container_id string, log_type string, raw_file_id string, raw_line_no long, raw string"


def lines(spark, *raw, kind="nginx-access", file="f1", site="a"):
    return spark.createDataFrame([(site, "live", "c", kind, file, k + 1, x) for k, x in enumerate(raw)], RAW)


def access(n=1, m=22, s=200):
    return LINE.format(n=n, m=m, s=s)


def test_duplicates_and_quarantine(spark):
    kept, bad = C.combine(lines(spark, access(2), access(1), access(1), "garbage", "  "))
    assert sorted(r.raw_line_no for r in kept.collect()) == [1, 3]
    assert [(r.raw, r.reason) for r in bad.collect()] == [("garbage", "timestamp_parse_failed")]
    again, _ = C.combine(lines(spark, access(1), access(2)))
    now = datetime(2026, 6, 17, 16)
    shas = [C.manifest(x, now).first() for x in (kept, again)]
    assert shas[0].content_sha256 == shas[1].content_sha256
    assert (shas[0].line_count, shas[0].status) == (2, "finalized")
    assert C.changed_segments(C.manifest(kept, now), C.manifest(again, now)).isEmpty()


def test_partial_range_keeps_whole_hours(spark):
    rows = lines(spark, access(1, 2), access(2, 56))
    kept, _ = C.combine(rows, datetime(2026, 6, 17, 14, 54), datetime(2026, 6, 17, 14, 59))
    assert kept.count() == 2


def test_sources_have_segments_of_their_own(spark):
    rows = lines(spark, access(1)).unionByName(lines(spark, access(1), site="b"))
    kept, _ = C.combine(rows)
    assert C.manifest(kept, datetime(2026, 6, 17, 14, 30)).groupBy("status").count().collect() == [("rewritten", 2)]


def test_fingerprint(spark):
    from hashlib import sha256

    row = spark.range(1).select(C.fingerprint(*map(F.lit, "sect"), F.lit("2026-06-17 14:22:31.5").cast("timestamp"), F.lit("x")).alias("f")).first()
    assert row.f == sha256("\0".join([*"sect", "2026-06-17T14:22:31.5Z", sha256(b"x").hexdigest()]).encode()).hexdigest()


def test_continuation_lines_take_the_time_before(spark):
    rows = lines(spark, "loose", "[20-Jun-2026 01:02:29 UTC] PHP Fatal error: x", "#0 trace", "#1 trace", kind="php-error")
    kept, bad = C.combine(rows)
    assert {str(r.ts) for r in kept.collect()} == {"2026-06-20 01:02:29"}
    assert bad.count() == 1
    events = C.index_logs(kept).collect()
    assert sorted(e.severity for e in events) == ["critical", "info", "info"]


def test_index_counts_and_null_rules(spark):
    kept, _ = C.combine(lines(spark, access(1, s=0), "2026-06-17T14:22:31Z nothing more"))
    events, invalid = C.index_access(kept)
    row = events.first()
    assert (events.count(), invalid.count()) == (1, 1)
    assert (row.status, row.query, row.referer, row.request_time_ms, row.path) == (None, None, None, 200, "/p1")
    assert C.new_rows(events, events.unionByName(events)).isEmpty()
    assert C.new_rows(events.limit(0), events.unionByName(events)).count() == 1


def test_pending_segments_once(spark):
    kept, _ = C.combine(lines(spark, access(1)))
    m = C.manifest(kept, datetime(2026, 6, 17))
    assert C.pending_segments(m, m, 10).count() == 1


def test_tree_and_segments_round_trip(spark, tmp_path):
    folder = tmp_path / "raw/site1/live/c1"
    folder.mkdir(parents=True)
    (folder / "nginx-access.log").write_text(access(1) + "\r\n" + access(2) + "\n\n")
    with gzip.open(folder / "php-error.log.gz", "wt") as f:
        f.write("[20-Jun-2026 01:02:29 UTC] PHP Warning: x\n")
    (folder / "notes.txt").write_text("x")
    raw = logs.read_tree(spark, str(tmp_path / "raw"))
    assert sorted((r.site_id, r.container_id, r.log_type, r.raw_line_no) for r in raw.collect()) == [("site1", "c1", "nginx-access", 1), ("site1", "c1", "nginx-access", 2), ("site1", "c1", "php-error", 1)]
    assert logs.read_local(spark, str(folder), "s", "e", masks=["*.log"]).count() == 2
    kept, _ = C.combine(raw)
    logs.write_segments(kept, str(tmp_path / "seg"))
    logs.write_segments(kept, str(tmp_path / "seg"))
    next(iter((tmp_path / "seg").rglob("*.json.gz"))).parent.joinpath("part-x.json").write_text("{broken\n")
    good, broken = logs.read_segments(spark, str(tmp_path / "seg"))
    assert (good.count(), broken.count()) == (3, 1)
    assert sorted((r.site_id, r.env, r.container_id, r.log_type, r.raw_line_no, str(r.ts)) for r in good.collect()) == sorted((r.site_id, r.env, r.container_id, r.log_type, r.raw_line_no, str(r.ts)) for r in kept.collect())
    logs.compact(spark, str(tmp_path / "seg"), str(tmp_path / "week"))
    assert spark.read.parquet(str(tmp_path / "week")).count() == 3
    assert sorted((str(r.period), r.line_count, r.sources) for r in logs.archive_manifest(spark, str(tmp_path / "week")).collect()) == [("2026-06-15", 3, 2)]


def test_large_files_are_read_in_splits(spark, tmp_path):
    folder = tmp_path / "raw/site1/live/c1"
    folder.mkdir(parents=True)
    texts = {f"nginx-access.log.{k}": [f"{k}-{n} {'x' * (n % 50)}" if n % 7 else "" for n in range(400 * k + 3)] for k in range(4)}
    for name, rows in texts.items():
        (folder / name).write_text("\r\n".join(rows) if name.endswith("2") else "\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = logs.read_tree(spark, str(tmp_path / "raw"))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        assert sorted((r.raw_file_id.rsplit("/", 1)[-1], r.raw_line_no, r.raw) for r in got.collect()) == sorted((name, n + 1, x) for name, rows in texts.items() for n, x in enumerate(rows) if x)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archives(spark, tmp_path):
    import zstandard

    body = io.BytesIO()
    with tarfile.open(fileobj=body, mode="w") as tar:
        for name, data in (("a/x.jsonl.gz", gzip.compress(b"one\ntwo\n")), ("a/readme", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "d.tar.zst").write_bytes(zstandard.compress(body.getvalue()))
    (tmp_path / "e.tar").write_bytes(body.getvalue())
    found = logs.read_archives(spark, str(tmp_path), lines_at_once=1)
    assert {(r.archive.rsplit(".", 1)[-1], r.line) for r in found.collect()} == {(kind, line) for kind in ("zst", "tar") for line in ("one", "two")}
    (tmp_path / "e.tar").unlink()
    assert sorted((r.member, r.line) for r in logs.read_archives(spark, str(tmp_path)).collect()) == [("a/x.jsonl.gz", "one"), ("a/x.jsonl.gz", "two")]


def test_changed_files(spark):
    keys = "site_id string, env string, container_id string, remote_path string, remote_size long, remote_mtime string"
    seen = spark.createDataFrame([("s", "e", "c", p, n, "t") for p, n in (("same", 1), ("grown", 2), ("new", 1), ("failed", 1))], keys)
    stored = spark.createDataFrame([("s", "e", "c", "same", 1, "t", "downloaded"), ("s", "e", "c", "grown", 1, "t", "downloaded"), ("s", "e", "c", "failed", 1, "t", "failed")], keys + ", status string")
    assert sorted(r.remote_path for r in logs.changed_files(stored, seen).collect()) == ["failed", "grown", "new"]


def test_stream_is_idempotent_and_takes_late_lines(spark, tmp_path):
    folder = tmp_path / "in/site1/live/c1"
    folder.mkdir(parents=True)
    root = str(tmp_path / "out")
    (folder / "1.log").write_text("\n".join(access(n, m=n) for n in range(1, 5)) + "\nbad line\n")
    ingest.ingest(spark, str(tmp_path / "in"), root).awaitTermination()
    (folder / "2.log").write_text(access(1, m=1) + "\n" + access(9, m=0, s=500) + "\n")
    ingest.ingest(spark, str(tmp_path / "in"), root).awaitTermination()
    events = spark.read.parquet(f"{root}/access_events")
    assert events.count() == 5 and events.where("batch = 1").count() == 1
    again = [("site1", "live", "c1", x) for x in (folder / "2.log").read_text().splitlines()]
    ingest._keep(spark.createDataFrame(again, "site_id string, env string, container_id string, raw string"), 1, root, ingest.TABLES)  # after a failure
    events = spark.read.parquet(f"{root}/access_events")
    assert events.count() == 5
    for name in ("rollup_1m", "rollup_status_1h"):
        stored = spark.read.parquet(f"{root}/{name}").drop("hour")
        fresh = R.build(events, name).select(stored.columns)
        assert stored.exceptAll(fresh).isEmpty() and fresh.exceptAll(stored).isEmpty()


def test_json_lines_are_what_was_written(spark, tmp_path):
    kept, _ = C.combine(lines(spark, access(1)))
    logs.write_segments(kept, str(tmp_path / "s"))
    text = gzip.decompress(next(iter((tmp_path / "s").rglob("*.json.gz"))).read_bytes()).decode()
    assert json.loads(text)["ts"] == "2026-06-17T14:22:31Z"


def test_times_are_worked_out_once_a_line(spark):
    """Filters on the time stand above the place where it is worked out, not below with a copy of it."""
    lines = spark.range(3).selectExpr("'s' AS site_id", "'e' AS env", "'c' AS container_id", "'nginx-access' AS log_type", "'f' AS raw_file_id", "id AS raw_line_no", "concat('x [05/Jan/2024:10:00:0', id, ' +0000]') AS raw")
    timed = C.line_times(lines).where("ts is not null")
    assert timed.count() == 3
    plan = timed._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp" in x]
