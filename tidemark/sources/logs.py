"""Reading and writing raw logs, combined segments and archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.parsing import combined_log_type, local_log_type

SEGMENT_LINE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("ts", "site_id", "env", "container_id", "log_type", "raw_file_id")] + [
        T.StructField("raw_line_no", T.LongType()), T.StructField("raw", T.StringType()), T.StructField("fingerprint", T.StringType()),
    ]
)


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw_line_no, raw) of all files below a folder; the number is the line's place in its file.

    Files are read in splits, so that a large one is many tasks' work. Within a task, rows are numbered in order; a
    line's place in its split is its distance from the split's first row, to which the lines of the file's earlier
    splits are added: one small row a split.
    """
    read = spark.read.text(folder, recursiveFileLookup=True, lineSep="\n")
    meta = F.col("_metadata")
    lines = read.select(F.col("value"), meta["file_path"].alias("path"), meta["file_block_start"].alias("split")).withColumn("row", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "split").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split")) - F.col("n")
    placed = lines.join(splits.select("path", "split", "first", before.alias("before")), ["path", "split"])
    number = (F.col("before") + F.col("row") - F.col("first") + 1).alias("raw_line_no")
    return placed.select("path", number, F.regexp_replace("value", "\r$", "").alias("raw")).where(F.trim("raw") != "")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Lines of <root>/<site>/<env>/<container>/.../<file>, plain or gzip, with source columns and log type.

    Plain files may be of any size; a gzip file cannot be split and is one task's work. Files that lie less deep are
    left out.
    """
    below = F.split(F.substring_index("path", "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
    named = _numbered(spark, root).withColumn("p", below).where(F.size("p") >= 4)
    part = lambda k: F.element_at("p", k)
    source = (part(1).alias("site_id"), part(2).alias("env"), part(3).alias("container_id"))
    rows = named.select(*source, combined_log_type(F.col("path")).alias("log_type"), F.col("path").alias("raw_file_id"), "raw_line_no", "raw")
    return rows.where("log_type <> 'unknown'")


def read_local(spark: SparkSession, folder: str, site: str, env: str, masks: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Lines of a local log folder as one source. Without masks all files count; then by log type, if types are given."""
    lines = _numbered(spark, folder)
    if masks:
        lines = lines.where(_any_mask(F.regexp_extract("path", "([^/]+)$", 1), masks))
    source = (F.lit(site).alias("site_id"), F.lit(env).alias("env"), F.lit("local").alias("container_id"))
    rows = lines.select(*source, local_log_type(F.col("path")).alias("log_type"), F.col("path").alias("raw_file_id"), "raw_line_no", "raw")
    return rows.where(F.col("log_type").isin(types)) if types else rows.where("log_type <> 'unknown'")


def _any_mask(name: Column, masks: list[str]) -> Column:
    from fnmatch import translate

    return name.rlike("|".join(translate(m).replace(r"\Z", "$").replace(r"\z", "$") for m in masks))


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, broken lines) of combined JSON segments."""
    schema = T.StructType([*SEGMENT_LINE.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    text = rows.withColumn("ts", F.try_to_timestamp("ts"))
    bad = F.col("_corrupt_record").isNotNull() | F.col("ts").isNull()
    return text.where(~bad).drop("_corrupt_record"), text.where(bad)


def write_segments(lines: DataFrame, path: str) -> None:
    """Combined lines as gzip JSON by log type, source and hour, sorted by time; touched hours are written anew, others
    stay. A source's hour is dealt by its keys and a part of the fingerprint, so that a busy one fills several files."""
    from tidemark.operators.combine import rfc3339

    source = ["log_type", "site_id", "env", "container_id"]
    rows = lines.withColumn("bucket", F.date_format("ts", "yyyy-MM-dd-HH")).withColumn("__lot", F.left("fingerprint", F.lit(1)))
    dealt = rows.repartition(*source, "bucket", "__lot").sortWithinPartitions(*source, "bucket", "ts", "fingerprint")
    # the folders are named by copies, as what names a folder is not in its files, which say all about a line by themselves
    folders = {f"by_{c}": F.col(c) for c in source}
    kept = dealt.withColumn("ts", rfc3339(F.col("ts"))).select(*SEGMENT_LINE.fieldNames(), "bucket").withColumns(folders)
    out = kept.write.mode("overwrite").option("compression", "gzip").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*folders, "bucket").json(path)


def changed_files(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Files to fetch: new ones, those of another size or time, and those not downloaded."""
    keys = ["site_id", "env", "container_id", "remote_path"]
    done = registry.where("status = 'downloaded'").select(*keys, F.col("remote_size").alias("__size"), F.col("remote_mtime").alias("__mtime"))
    return seen.join(done, keys, "left").where(
        ~(F.col("remote_size").eqNullSafe(F.col("__size")) & F.col("remote_mtime").eqNullSafe(F.col("__mtime")))
    ).select(*seen.columns)


def combine_backlog(registry: DataFrame, since: str | None = None) -> DataFrame:
    """Downloaded files that are not combined in their present state, or have changed since a time."""
    stale = F.col("combined_at").isNull() | ~F.col("combined_sha256").eqNullSafe(F.col("sha256"))
    recent = F.lit(True) if since is None else F.greatest("remote_mtime", "downloaded_at") >= F.lit(since).cast("timestamp")
    return registry.where("status = 'downloaded'").where(stale | recent)


def read_archives(spark: SparkSession, path: str, lines_at_once: int = 20_000) -> DataFrame:
    """(archive, member, line) of tar archives, plain, gzip or zstd, whose regular members end in .gz. Archives and members
    are unpacked as they are read, so that a task holds a packed archive and a few lines."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=_unpacked(name, io.BytesIO(content)), mode="r|*") as tar:
                    for member in tar:
                        if member.isfile() and fnmatch(member.name, "*.gz"):
                            with gzip.open(tar.extractfile(member), "rt", encoding="utf-8", errors="replace") as text:
                                while some := [line.rstrip("\n") for line in islice(text, lines_at_once)]:
                                    yield pd.DataFrame({"archive": name, "member": member.name, "line": some})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(members, "archive string, member string, line string")


def _unpacked(name: str, packed: io.BytesIO) -> io.BufferedIOBase:
    if name.endswith((".zst", ".zstd")):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(packed)
    return packed


def compact(spark: SparkSession, path: str, out: str, unit: str = "week") -> None:
    """Segments of days rewritten as archives of weeks or months: zstd Parquet, by the period's first day."""
    lines, _ = read_segments(spark, path)
    once = lines.withColumn("period", F.to_date(F.date_trunc(unit, "ts"))).dropDuplicates(["fingerprint", "ts"])
    once.repartition(
        "period", F.left("fingerprint", F.lit(1)),
    ).sortWithinPartitions("ts", "fingerprint").write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(out)


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(period, line_count, min_ts, max_ts, sources) of compacted archives: what coverage and retention look at."""
    source = F.concat_ws("/", "site_id", "env", "container_id", "log_type")
    rows = spark.read.parquet(path).groupBy("period")
    return rows.agg(F.count("*").alias("line_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count_distinct(source).alias("sources"))
