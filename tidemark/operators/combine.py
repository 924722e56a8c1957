"""Combining raw log lines into hourly segments: times, fingerprints, buckets, duplicates, and what cannot be read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import access_fields, access_time, clean_line, is_access, is_ordinary, ordinary_fields, parse_log
from tidemark.operators.rollups import at

SOURCE = ["site_id", "env", "container_id"]
LONGEST_LINE = 10 * 1024 * 1024



def rfc3339(ts: Column) -> Column:
    """UTC without closing zeros in the fraction: 2026-06-17T14:22:31.5Z."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    return F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z"))


def fingerprint(site: Column, env: Column, container: Column, log_type: Column, ts: Column, raw: Column) -> Column:
    """sha256 of the source, the time and the line's own sha256, with zero bytes between."""
    return F.sha2(F.concat_ws("\0", site, env, container, log_type, rfc3339(ts), F.sha2(raw, 256)), 256)


def line_times(lines: DataFrame) -> DataFrame:
    """``lines`` (site_id, env, container_id, log_type, raw_file_id, raw_line_no, raw) with ``ts``.

    Lines other than access lines that show no time take that of the last line before them in their file, if they are of
    one; blank lines go.
    """
    timed = lines.where(F.trim("raw") != "")
    # access lines, and lines of no file, have no line before them to take a time from: only the others are sorted
    alone = F.coalesce(is_access(F.col("log_type")), F.lit(False))
    own = F.when(alone, access_time(F.col("raw"))).otherwise(parse_log(F.col("raw"))["ts"])
    before = Window.partitionBy(*SOURCE, "log_type", "raw_file_id").orderBy("raw_line_no").rowsBetween(Window.unboundedPreceding, 0)
    others = timed.where(~alone & F.col("raw_file_id").isNotNull()).withColumn("__own", parse_log(F.col("raw"))["ts"])
    carried = others.withColumn("ts", F.last("__own", ignorenulls=True).over(before)).drop("__own")
    # a generator, so that filters on the time are not pushed below it, where each would work the time out anew
    return timed.where(alone | F.col("raw_file_id").isNull()).withColumn("ts", F.explode(F.array(own))).unionByName(carried)


def combine(lines: DataFrame, since: datetime | None = None, until: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments' lines, quarantine). A line's copies within an hour and source are one, the last read; an hour that
    the range touches is complete. Lines without a time are set aside with the reason."""
    timed = line_times(lines)
    quarantine = timed.where("ts is null").drop("ts").withColumn("reason", F.lit("timestamp_parse_failed"))
    good = timed.where("ts is not null").withColumn("bucket_start", F.date_trunc("hour", "ts"))
    if since is not None:
        good = good.where(F.col("bucket_start") >= F.date_trunc("hour", at(since)))
    if until is not None:
        good = good.where(F.col("ts") < at(until)) if since is None else good.where(F.col("bucket_start") < at(until))
    good = good.withColumn("fingerprint", fingerprint(*(F.col(c) for c in (*SOURCE, "log_type")), F.col("ts"), F.col("raw")))
    # the key is the line itself, so copies meet in small groups however many lines an hour has
    order = F.struct(F.coalesce("raw_file_id", F.lit("")), F.coalesce("raw_line_no", F.lit(0)))
    kept = good.groupBy("fingerprint", "bucket_start").agg(*(F.max_by(c, order).alias(c) for c in good.columns if c not in ("fingerprint", "bucket_start")))
    return kept.select(*good.columns), quarantine


def manifest(segment_lines: DataFrame, now: datetime, finalize_after_s: int = 900) -> DataFrame:
    """One row a segment: hour and source, number of lines, first and last time, a hash of its content that does not
    depend on order, and whether it is final."""
    line = F.conv(F.left("fingerprint", F.lit(15)), 16, 10).cast("decimal(38,0)")
    rows = segment_lines.groupBy("bucket_start", *SOURCE, "log_type").agg(
        F.count("*").alias("line_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.sum(line).alias("__sum"),
    )
    end = F.col("bucket_start") + F.expr("interval 1 hour")
    return rows.select(
        "bucket_start", end.alias("bucket_end"), *SOURCE, "log_type", "line_count", "min_ts", "max_ts",
        F.sha2(F.concat_ws(":", "line_count", "__sum"), 256).alias("content_sha256"),
        F.when(end + F.make_interval(secs=F.lit(finalize_after_s)) < at(now), "finalized").otherwise("rewritten").alias("status"),
    )


def changed_segments(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Segments whose content is new: only these are indexed again."""
    return fresh.join(stored.select("bucket_start", *SOURCE, "log_type", "content_sha256"), ["bucket_start", *SOURCE, "log_type", "content_sha256"], "left_anti")


def pending_segments(in_range: DataFrame, backlog: DataFrame, limit: int) -> DataFrame:
    """Segments to index: those in range first, then the backlog, oldest first, each once."""
    both = in_range.withColumn("__turn", F.lit(0)).unionByName(backlog.withColumn("__turn", F.lit(1)))
    once = both.groupBy("bucket_start", *SOURCE, "log_type").agg(F.min("__turn").alias("__turn"))
    return once.orderBy("__turn", "bucket_start", *SOURCE, "log_type").limit(limit).drop("__turn")



def with_access_fields(lines: DataFrame) -> DataFrame:
    """``lines`` (raw, ...) with their fields in ``a``, null in lines that are none, in one read of them. Python sees only
    what a pattern cannot read, and nulls for all else."""
    clean = lines.withColumn("__line", clean_line(F.col("raw"))).withColumn("__plain", is_ordinary(F.col("__line")))
    read = clean.withColumn("__other", access_fields(F.when(~F.col("__plain"), F.col("__line"))))
    # by a generator: else each use of a field would cut the line anew
    return read.withColumn("a", F.explode(F.array(F.when(F.col("__plain"), ordinary_fields(F.col("__line"))).otherwise(F.col("__other"))))).drop("__line", "__plain", "__other")


def index_access(segment_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(access events, lines that are none) of combined access lines; empty fields and zero status or times are null."""
    parsed = with_access_fields(segment_lines.where(is_access(F.col("log_type"))))
    ok = F.col("a.path").isNotNull()
    zero = lambda c: F.nullif(F.col(f"a.{c}"), F.lit(0)).alias(c)
    text = lambda *names: [_clean(F.nullif(F.col(f"a.{c}"), F.lit(""))).alias(c) for c in names]
    events = parsed.where(ok).select(
        F.col("fingerprint").alias("id"), "ts", *SOURCE, *text("client_ip", "method", "scheme", "host", "path", "query"),
        zero("status"), F.col("a.bytes_sent").alias("bytes_sent"), *text("referer", "user_agent"), zero("request_time_ms"), zero("upstream_time_ms"), "fingerprint",
    )
    return events, parsed.where(~ok).drop("a")


def _clean(c: Column) -> Column:
    """Without zero bytes and bytes that are no text."""
    return F.replace(F.replace(F.make_valid_utf8(c), F.lit("\0"), F.lit("")), F.lit("�"), F.lit(""))


def index_logs(segment_lines: DataFrame) -> DataFrame:
    """Log events of combined lines of other kinds; a line that no format fits keeps its segment time as information."""
    parsed = segment_lines.where(~is_access(F.col("log_type"))).withColumn("p", parse_log(F.col("raw")))
    return parsed.select(
        "fingerprint", F.coalesce("p.ts", "ts").alias("ts"), *SOURCE, "log_type", F.coalesce("p.severity", F.lit("info")).alias("severity"),
        _clean(F.coalesce("p.message", F.trim("raw"))).alias("message"), _clean(F.col("raw")).alias("raw"),
    )


def new_rows(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows whose (fingerprint, ts) is not stored yet, each once."""
    keys = ["fingerprint", "ts"]
    return fresh.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
