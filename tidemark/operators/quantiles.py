"""Exact percentiles and distinct counts beside additive measures, in one read and without a buffer of a group's values.

Rows are counted by key and value first. Values are then gathered in ranges of ``1 << RANGE_BITS``, of which each holds so
many different values at most; running sums over a key's ranges tell which of them hold the two ranks that the percentile
lies between, and only there are values looked at. A key with most of all rows is many (key, value) groups.
Distinct counts come from the same read: it is expanded once for each column that is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 10


@dataclass(frozen=True)
class Measure:
    """What is counted of raw rows, and how parts are put together: sum, min or max."""

    part: Column
    join: str = "sum"

    def joined(self, name: str, when: Column | None = None) -> Column:
        column = F.col(name) if when is None else F.when(when, F.col(name))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.join](column).alias(name)


def counted(rows: DataFrame, keys: list[str], value: str, measures: dict[str, Measure], unique: tuple[str, ...] = ()) -> DataFrame:
    """One read of ``rows``: measures by keys and value, and a row for each key's different values of ``unique``.

    Column ``__set`` tells them apart: 0 for values, 1 and up for the columns of ``unique`` in order.
    """
    columns = [F.col(c) for c in (*keys, value, *unique)]
    sets = [[F.col(c) for c in (*keys, last)] for last in (value, *unique)]
    parts = [m.part.alias(n) for n, m in measures.items()]
    # the grouping id has a bit for each column that a set leaves out; keys are in all sets
    whole = (1 << len(unique) + 1) - 1
    set_of = F.lit(None).cast("int")
    for k in range(len(unique) + 1):
        set_of = F.when(F.col("__id") == whole - (1 << len(unique) - k), k).otherwise(set_of)
    return rows.groupingSets(sets, *columns).agg(*parts, F.count(value).alias("__n"), F.grouping_id().alias("__id")).withColumn("__set", set_of).drop("__id")


def percentiles(counts: DataFrame, keys: list[str], value: str, measures: dict[str, Measure], name: str, unique: tuple[str, ...] = (), share: float = 0.95) -> DataFrame:
    """Keys, measures, distinct counts of ``unique`` (as unique_<column>) and the interpolated percentile ``name`` (null
    without values) of the rows of ``counted``: also of rows with __n and measures alone that have been counted before."""
    held = counts if "__set" in counts.columns else counts.withColumn("__set", F.lit(0))
    own = F.col("__set") == 0
    span = F.when(own, F.shiftright(value, RANGE_BITS)).alias("__range")
    some = own & F.col(value).isNotNull()
    ranged = held.groupBy(*keys, span).agg(
        *(m.joined(n, own) for n, m in measures.items()), F.coalesce(F.sum(F.when(some, F.col("__n"))), F.lit(0)).alias("__n"),
        F.collect_list(F.when(some, F.struct(F.col(value).alias("v"), F.col("__n").alias("n")))).alias("__held"),
        *(F.count(F.when(F.col("__set") == k, F.col(c))).alias(f"unique_{c}") for k, c in enumerate(unique, 1)),
    )
    over = Window.partitionBy(*keys)
    upto = ranged.withColumns({"__upto": F.sum("__n").over(over.orderBy("__range")), "__total": F.sum("__n").over(over)})
    at = F.lit(share) * (F.col("__total") - 1)
    picked = {f"__{side}": _value_at(rank(at).cast("long")) for side, rank in (("low", F.floor), ("high", F.ceil))}
    rows = upto.withColumns(picked).groupBy(*keys).agg(
        *(m.joined(n) for n, m in measures.items()), *(F.sum(f"unique_{c}").alias(f"unique_{c}") for c in unique),
        *(F.max(c).alias(c) for c in ("__low", "__high", "__total")),
    )
    low, high = F.col("__low").cast("double"), F.col("__high").cast("double")
    return rows.withColumn(name, low + (high - low) * (at - F.floor(at))).drop("__low", "__high", "__total")


def _value_at(rank: Column) -> Column:
    """The value of a rank (from 0) if this range holds it, else null."""
    before = F.col("__upto") - F.col("__n")
    start = F.struct(before.alias("upto"), F.lit(None).cast("long").alias("found"))
    step = lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.when(s["found"].isNull() & (s["upto"] + x["n"] > rank), x["v"].cast("long")).otherwise(s["found"]).alias("found"))
    return F.when((before <= rank) & (rank < F.col("__upto")), F.aggregate(F.array_sort("__held"), start, step, lambda s: s["found"]))


def summary(rows: DataFrame, keys: list[str], value: str, measures: dict[str, Measure], name: str, unique: tuple[str, ...] = (), share: float = 0.95) -> DataFrame:
    """``percentiles`` of ``counted``: measures, distinct counts and an exact percentile in one read."""
    return percentiles(counted(rows, keys, value, measures, unique), keys, value, measures, name, unique, share)
