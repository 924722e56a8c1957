"""Continuous collection of growing log folders: all kinds of lines, continuation lines included.

The tail source gives what was appended. Access lines go the way of ``ingest``; lines of other logs take their times with the
last time of their file, which each batch reads from the batch before and hands on to the next: one row a file, in a folder of
the batch's number. A batch that is run again after a failure reads the same row and writes the same folders. Spark's keyed state
is not used, because it would bring all new lines of a file to one task, in no order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.parsing import combined_log_type, is_access
from tidemark.operators import carry
from tidemark.operators.combine import SOURCE, fingerprint, index_logs
from tidemark.sources import tail
from tidemark.streaming import ingest

KEYS = ["fingerprint", "ts"]


def tail_lines(spark: SparkSession, folder: str, split_bytes: int = tail.SPLIT) -> DataFrame:
    """Lines of <folder>/<site>/<env>/<container>/<file> as a stream; a line's number is the byte it starts at."""
    tail.register(spark)
    lines = spark.readStream.format("tail").option("path", folder).option("splitBytes", str(split_bytes)).load().withColumn("p", F.split("file", "/"))
    source = (F.element_at("p", k).alias(n) for k, n in zip((-4, -3, -2), SOURCE, strict=True))
    typed = lines.select(*source, combined_log_type(F.col("file")).alias("log_type"), F.col("file").alias("raw_file_id"), F.col("start_byte").alias("raw_line_no"), "raw")
    return typed.where("log_type <> 'unknown'")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that have a complete folder below a path."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return []
    done = (f for f in files.listStatus(at) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    return sorted(int(name) for f in done if (name := f.getPath().getName()).isdigit())


def _forget(spark: SparkSession, path: str, below: int) -> None:
    for number in _batches(spark, path):
        if number < below:
            at, files = _files(spark, f"{path}/{number}")
            files.delete(at, True)


def _last(spark: SparkSession, root: str, batch: int) -> DataFrame:
    earlier = [n for n in _batches(spark, f"{root}/_last_times") if n < batch]
    return spark.read.schema(carry.LAST).parquet(f"{root}/_last_times/{earlier[-1]}") if earlier else spark.createDataFrame([], carry.LAST)


def _add(fresh: DataFrame, path: str, batch: int, keys: list[str]) -> None:
    """Add rows to a table in folders by hour and batch, but for those that other batches have stored."""
    spark = fresh.sparkSession
    fresh = fresh.withColumn("hour", F.coalesce(F.date_format("ts", "yyyy-MM-dd-HH"), F.lit("none"))).withColumn("batch", F.lit(batch))
    at, files = _files(spark, path)
    if files.exists(at):
        stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("batch") != batch)
        fresh = fresh.join(stored.select("hour", *keys), ["hour", *keys], "left_anti")
    out = fresh.repartition("hour", F.left("fingerprint", F.lit(1))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("hour", "batch").parquet(path)


def keep_logs(lines: DataFrame, batch: int, root: str, span: int = carry.SPAN, keep_days: int | None = 90) -> None:
    """Add a batch's lines of error, slow and database logs to ``log_events``, those before any time to ``quarantine``, and
    write the last times of their files for the next batch. ``lines`` is a written table."""
    spark, last = lines.sparkSession, _last(lines.sparkSession, root, batch)
    timed = carry.carried_times(lines, last, span)
    marked = timed.withColumn("fingerprint", fingerprint(*(F.col(c) for c in (*SOURCE, "log_type")), F.col("ts"), F.col("raw")))
    _add(index_logs(marked.where("ts is not null").dropDuplicates(KEYS)), f"{root}/log_events", batch, KEYS)
    unread = timed.where("ts is null").withColumn("fingerprint", F.sha2(F.concat_ws("\0", *carry.FILE, "raw_line_no", "raw"), 256))
    _add(unread.dropDuplicates(["fingerprint"]).withColumn("reason", F.lit("timestamp_parse_failed")), f"{root}/quarantine", batch, ["fingerprint"])
    carry.last_times(lines, last, span, keep_days).write.mode("overwrite").parquet(f"{root}/_last_times/{batch}")
    _forget(spark, f"{root}/_last_times", batch - 1)


def keep(lines: DataFrame, batch: int, root: str, tables: tuple[str, ...] = ingest.TABLES, span: int = carry.SPAN) -> None:
    """A batch of tailed lines: written once, then access lines to events and rollups, the others to log events."""
    spark, path = lines.sparkSession, f"{root}/_lines/{batch}"
    lines.write.mode("overwrite").parquet(path)
    written, access = spark.read.schema(lines.schema).parquet(path), is_access(F.col("log_type"))
    ingest._keep(written.where(access).select(*SOURCE, "raw"), batch, root, tables)
    keep_logs(written.where(~access), batch, root, span)
    _forget(spark, f"{root}/_lines", batch)


def collect(spark: SparkSession, folder: str, root: str, tables: tuple[str, ...] = ingest.TABLES, every: str | None = None, split_bytes: int = tail.SPLIT, span: int = carry.SPAN) -> StreamingQuery:
    """Collect a growing folder into the tables below ``root``; without ``every``, all that is there, then stop."""
    stream = tail_lines(spark, folder, split_bytes).writeStream.foreachBatch(lambda batch, number: keep(batch, number, root, tables, span))
    writer = stream.option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
