"""Continuous ingest: new raw lines become events, and the hours they touch are counted anew.

State alone would drop late lines; here a late line adds to its hour's events, and the rollups of that hour are
rebuilt from them. A batch adds events in folders of its own, by hour and batch, and overwrites the rollups of whole
hours, so that events are never rewritten and a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.parsing import access_time
from tidemark.operators import rollups as R
from tidemark.operators.combine import fingerprint, with_access_fields


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Access lines of files that arrive in <path>/<site>/<env>/<container>/, as a stream."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path).withColumn("p", F.split("_metadata.file_path", "/"))
    part = lambda k: F.element_at("p", k)
    return lines.select(part(-4).alias("site_id"), part(-3).alias("env"), part(-2).alias("container_id"), F.col("value").alias("raw"))


def to_events(lines: DataFrame) -> DataFrame:
    """Parsed access events; lines without time or request go."""
    timed = lines.withColumn("ts", access_time(F.col("raw"))).where("ts is not null")
    own = ("site_id", "env", "container_id")
    marked = timed.withColumn("fingerprint", fingerprint(*(F.col(c) for c in own), F.lit("nginx-access"), F.col("ts"), F.col("raw")))
    marked = with_access_fields(marked).where("a.path is not null")
    text = lambda c: F.nullif(F.col(f"a.{c}"), F.lit("")).alias(c)
    number = lambda c: F.nullif(F.col(f"a.{c}"), F.lit(0)).alias(c)
    return marked.select(
        F.col("fingerprint").alias("id"), "fingerprint", "ts", *own, *map(text, ("client_ip", "method", "path", "query", "referer", "user_agent")),
        number("status"), F.col("a.bytes_sent").alias("bytes_sent"), number("request_time_ms"),
    )


def _keep(lines: DataFrame, batch: int, root: str, tables: tuple[str, ...]) -> None:
    """Add a batch's lines to the hours they touch and count these anew."""
    spark, events = lines.sparkSession, f"{root}/access_events"
    fresh = to_events(lines).withColumn("hour", F.date_format("ts", "yyyy-MM-dd-HH")).dropDuplicates(["fingerprint", "ts"])
    own = f"{root}/_batch/{batch}"
    fresh.write.mode("overwrite").parquet(own)  # read more than once, and lines are not to be parsed again
    fresh = spark.read.parquet(own).withColumn("batch", F.lit(batch))
    hours = [r["hour"] for r in fresh.select("hour").distinct().collect()]  # hours of one batch
    if not hours:
        return
    path, keys = spark._jvm.org.apache.hadoop.fs.Path(events), ["fingerprint", "ts"]
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        # this batch's own events are those of a run that failed
        stored = spark.read.schema(fresh.schema).parquet(events).where(F.col("hour").isin(hours) & (F.col("batch") != batch))
        fresh = fresh.join(stored.select(*keys), keys, "left_anti")
    out = fresh.repartition("hour", F.left("fingerprint", F.lit(1))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("hour", "batch").parquet(events)
    whole = spark.read.schema(fresh.schema).parquet(events).where(F.col("hour").isin(hours))
    for name in tables:
        counted = R.build(whole, name).withColumn("hour", F.date_format("bucket_ts", "yyyy-MM-dd-HH"))
        counted.repartition("hour", F.pmod(F.hash("site_id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(f"{root}/{name}")
    before = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_batch/{batch - 1}")
    before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)


TABLES = ("rollup_1m", "rollup_ip_1h", "rollup_path_1h", "rollup_status_1h")


def ingest(spark: SparkSession, source: str, root: str, tables: tuple[str, ...] = TABLES, every: str | None = None) -> StreamingQuery:
    """Start ingest from ``source`` to the tables under ``root``; without ``every``, all that is there, then stop."""
    lines = stream_lines(spark, source).writeStream.foreachBatch(lambda batch, number: _keep(batch, number, root, tables))
    writer = lines.option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def live_timeline(events: DataFrame, minutes: int = 5, lateness: str = "15 minutes") -> DataFrame:
    """A streaming count by window and site, for views that may lag behind late lines."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", f"{minutes} minutes"), "site_id").agg(
        F.count("*").alias("requests"), R.count_if(F.col("status") >= 500).alias("status_5xx"),
    )
