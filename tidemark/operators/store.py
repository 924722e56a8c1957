"""Stored rollups: partitioned by time, added to under a marker, and read where they are complete.

Events lie in folders by hour (or by day, where hours are small) and batch. A rollup whose measures add up keeps, in the same
folders, what each batch adds to them; one that counts distinct values keeps each folder's counts over all its events. A
ledger marks which batch of which folder a rollup holds. It is written after the rows, and rows are written by overwriting the batch's own folders, so that a
backfill that is run twice, or again after it was killed, counts nothing twice.

A window is read from the rollup's folders that the ledger says are complete; its edges and the folders with a gap are counted
from events. Both reads name their folders, so that Spark lists and opens only these.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timewindow import whole
from tidemark.operators import rollups as R
from tidemark.sources.scratch import kept

#: Length of a folder, how Spark and Python name it (a letter first, so that no reader takes it for a date), and its step.
FOLDERS = {"hour": ("'h'yyyy-MM-dd-HH", "h%Y-%m-%d-%H", timedelta(hours=1)), "day": ("'d'yyyy-MM-dd", "d%Y-%m-%d", timedelta(days=1))}


class RollupStore:
    """Events and rollups under ``root``, which all executors share, in a folder for each ``hour`` or ``day``."""

    def __init__(self, spark: SparkSession, root: str, width: str = "hour"):
        self.spark, self.root, self.width = spark, root.rstrip("/"), width

    def folder_of(self, ts: str) -> Column:
        return F.date_format(ts, FOLDERS[self.width][0])

    def folders(self, since: datetime, until: datetime) -> list[str]:
        """Names of the folders that [since, until) touches."""
        _, form, step = FOLDERS[self.width]
        at, out = since.replace(minute=0, second=0, microsecond=0, **({"hour": 0} if self.width == "day" else {})), []
        while at < until:
            out.append(at.strftime(form))
            at += step
        return out

    # ---- events

    def append(self, events: DataFrame, batch: int) -> None:
        """Add a batch of events (ts, ...). A batch does not change: the same one again, as after a failure, replaces itself."""
        rows = events.withColumns({"folder": self.folder_of("ts"), "batch": F.lit(batch)})
        self._write(rows.repartition("folder"), "events", "folder", "batch")
        self._mark(self._table("events").where(F.col("batch") == batch), "events")

    def events(self, names: list[str] | None = None) -> DataFrame:
        rows = self._table("events")
        return rows if names is None else rows.where(F.col("folder").isin(names))

    # ---- the ledger

    def _mark(self, rows: DataFrame, table: str) -> None:
        rows.select("folder", "batch").distinct().withColumn("held", F.lit(table)).coalesce(1).write.mode("append").partitionBy("held").parquet(f"{self.root}/ledger")

    def held(self, table: str) -> DataFrame:
        """(folder, batch) that a table holds whole."""
        marks = self.spark.read.schema("folder string, batch int, held string").parquet(f"{self.root}/ledger")
        return marks.where(F.col("held") == table).select("folder", "batch").distinct()

    def pending(self, name: str) -> DataFrame:
        """(folder, batch) of events that a rollup does not hold: what ``backfill`` adds."""
        return self.held("events").join(self.held(name), ["folder", "batch"], "left_anti")

    def gaps(self, name: str, names: list[str]) -> list[str]:
        """Which of the named folders have events that the rollup does not hold."""
        return sorted(r["folder"] for r in self.pending(name).where(F.col("folder").isin(names)).select("folder").distinct().collect())

    def ready(self, name: str, since: datetime, until: datetime) -> bool:
        """The rollup holds every event of the window's whole hours."""
        lo, hi = whole(since, until, 3600)
        return lo >= hi or not self.gaps(name, self.folders(lo, hi))

    # ---- rollups

    def backfill(self, *names: str, most: int | None = None) -> dict[str, int]:
        """Add what is pending to each rollup, at most so many (folder, batch) folders each, oldest first; how many were added."""
        return {name: self._backfill(name, most) for name in names}

    def _backfill(self, name: str, most: int | None) -> int:
        spec = R.ROLLUPS[name]
        todo = self.pending(name)
        todo = todo.orderBy("folder", "batch").limit(most) if most else todo
        todo = todo.persist()
        added = todo.count()
        if added:
            rows, done = self._table("events").join(todo.select("folder").distinct(), "folder", "left_semi"), todo
            if spec.unique:
                # what counts distinct values is counted anew, over all batches of its folder
                self._write(R.build(rows, name).withColumn("folder", self.folder_of("bucket_ts")), name, "folder")
                done = self.held("events").join(todo.select("folder").distinct(), "folder", "left_semi")
            else:
                own = rows.join(todo, ["folder", "batch"], "left_semi")
                self._write(R.build(own, name, "batch").withColumn("folder", self.folder_of("bucket_ts")), name, "folder", "batch")
            self._mark(done, name)
        todo.unpersist()
        return added

    def rollup(self, name: str) -> DataFrame:
        """The stored rows: of additive rollups one for each batch, to be added up by the reader or by ``merged``."""
        return self._table(name)

    def merged(self, name: str) -> DataFrame:
        """One row a key, as ``rollups.build`` gives it over all events that the rollup holds."""
        return R.added(self.rollup(name), name)

    def rows(self, name: str, since: datetime, until: datetime, site: str = "") -> DataFrame:
        """Rollup rows for exactly [since, until): complete whole buckets as stored, all else counted from events.

        Rows of one bucket and key may be several, to be added up. Of distinct counts each bucket gives one row a key."""
        spec = R.ROLLUPS[name]
        lo, hi = whole(since, until, 60 if spec.width == "minute" else 3600)
        inside = self.folders(lo, hi) if lo < hi else []
        gaps = self.gaps(name, inside)
        if not self._exists(name) or not set(inside) - set(gaps):
            return R.grouped(R.window(self.events(self.folders(since, until)), since, until, site), spec)
        stored = self.rollup(name).where((F.col("bucket_ts") >= R.at(lo)) & (F.col("bucket_ts") < R.at(hi))).where(self._folders_from(inside, gaps))
        stored = stored.where(F.col("site_id") == site) if site else stored
        edges = sorted({*gaps, *(self.folders(since, lo) if since < lo else []), *(self.folders(hi, until) if hi < until else [])})
        raw = R.window(self.events(edges), since, until, site)
        outside = (F.col("ts") < R.at(lo)) | (F.col("ts") >= R.at(hi))
        raw = raw.where(outside | F.col("folder").isin(gaps)) if gaps else raw.where(outside)
        columns = [*spec.columns, *spec.measures]
        return stored.select(*columns).unionByName(R.grouped(raw, spec).select(*columns))

    @staticmethod
    def _folders_from(names: list[str], gaps: list[str]) -> Column:
        """A range of folders without its gaps: a filter on the folder's name that stays short however long the window is."""
        if not names:
            return F.lit(False)
        between = F.col("folder").between(names[0], names[-1])
        return between & ~F.col("folder").isin(gaps) if gaps else between

    # ---- files

    def _write(self, rows: DataFrame, name: str, *partitions: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")


# ---- distinct counts that add up

def dense_keys(stored: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``stored`` (column, key) and the values it does not have, with keys that go on where its own end, without gaps.

    New values are numbered within each task, after which a table of one row a task tells where its numbers begin."""
    fresh = values.select(column).where(F.col(column).isNotNull()).distinct().join(stored.select(column), column, "left_anti")
    numbered = kept(fresh.withColumn("__id", F.monotonically_increasing_id()), "fresh-keys")
    task, place = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    first = stored.agg(F.coalesce(F.max("key"), F.lit(-1)).alias("top")).first()["top"] + 1
    begins = sizes.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n") + first).alias("__begin"))
    new = numbered.withColumn("__task", task).join(begins, "__task").select(column, (F.col("__begin") + place).alias("key"))
    return stored.select(column, "key").unionByName(new)


def distinct_rollup(events: DataFrame, keys: DataFrame, column: str, *by: str) -> DataFrame:
    """Which values each hour saw, as bitmaps over dense keys: (bucket_ts, by..., word, seen). ``merge_distinct`` adds them up."""
    keyed = events.join(keys, column).withColumn("bucket_ts", F.date_trunc("hour", "ts"))
    word = F.bitmap_bucket_number("key").alias("word")
    return keyed.groupBy("bucket_ts", *by, word).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("seen"))


def merge_distinct(rows: DataFrame, *by: str, name: str = "unique_values") -> DataFrame:
    """The exact number of different values by ``by``, over any union of hours, batches and edges of ``distinct_rollup``."""
    return rows.groupBy(*by, "word").agg(F.bitmap_count(F.bitmap_or_agg("seen")).alias("n")).groupBy(*by).agg(F.sum("n").alias(name))


def sketch_rollup(events: DataFrame, column: str, *by: str) -> DataFrame:
    """The cheap form: a HyperLogLog sketch by hour, a few kilobytes whatever it counts, with an error of about 1.6 %."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("bucket_ts"), *by).agg(F.hll_sketch_agg(column).alias("sketch"))


def merge_sketches(rows: DataFrame, *by: str, name: str = "about") -> DataFrame:
    return rows.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
