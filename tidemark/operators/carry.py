"""Times of continuation lines when a file comes in pieces: each piece starts from the last time of the piece before.

A file's lines are cut into stretches of ``span`` places. Within a stretch a window carries times; across stretches one small
row a stretch does. So a file that holds most of the lines is many tasks' work, and what one piece hands to the next is one row
a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import access_time, is_access, parse_log
from tidemark.operators.combine import SOURCE

FILE = [*SOURCE, "log_type", "raw_file_id"]
LAST = "site_id string, env string, container_id string, log_type string, raw_file_id string, last_place long, last_ts timestamp"
#: Places of one stretch: bytes, if ``raw_line_no`` is a byte of the file, else lines.
SPAN = 8 << 20


def _same(names: list[str], left: str, right: str) -> Column:
    """Equal in all columns, nulls equal to nulls."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def _own(lines: DataFrame, span: int) -> DataFrame:
    alone = F.coalesce(is_access(F.col("log_type")), F.lit(False))
    own = F.when(alone, access_time(F.col("raw"))).otherwise(parse_log(F.col("raw"))["ts"]).cast("timestamp")
    stretch = F.coalesce(F.floor(F.col("raw_line_no") / span), F.lit(-1)).cast("long")
    return lines.where(F.trim("raw") != "").withColumn("__own", own).withColumn("__carries", ~alone & F.col("raw_file_id").isNotNull()).withColumn("__stretch", stretch)


def _before(lines: DataFrame, last: DataFrame, span: int) -> DataFrame:
    """(file, stretch, time before the stretch, time at its end) of the stretches of a piece.

    A file that starts anew at or before the place where it ended last time is another file under an old name and takes
    nothing over.
    """
    rows = _own(lines, span).where("__carries")
    # among the lines of one place, the greatest time; lines without a place come first
    order = F.struct(F.coalesce("raw_line_no", F.lit(-1)), F.col("__own"))
    ends = rows.groupBy(*FILE, "__stretch").agg(
        F.max_by("__own", F.when(F.col("__own").isNotNull(), order)).alias("__end"), F.min("raw_line_no").alias("__low"), F.max("raw_line_no").alias("__high"),
    )
    old = last.select(*FILE, F.lit(-2).cast("long").alias("__stretch"), F.col("last_ts").alias("__end"), F.col("last_place").alias("__low"), F.col("last_place").alias("__high"))
    file = Window.partitionBy(*FILE)
    both = ends.unionByName(old).withColumn("__first", F.min(F.when(F.col("__stretch") > -2, F.col("__low"))).over(file))
    stale = (F.col("__stretch") == -2) & (F.col("__first") <= F.col("__low"))
    upto = file.orderBy("__stretch")
    both = both.withColumn("__end", F.when(~F.coalesce(stale, F.lit(False)), F.col("__end")))
    return both.withColumn("__before", F.last("__end", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)))


def carried_times(lines: DataFrame, last: DataFrame, span: int = SPAN) -> DataFrame:
    """``lines`` as ``combine.line_times`` takes them, with ``ts``: the times that the whole files would give, if ``last`` is
    what ``last_times`` gave for their earlier pieces. Blank lines go; access lines and lines of no file have their own
    time only. An empty ``last`` is the start of all files. ``lines`` is read twice: pass a written table.
    """
    rows = _own(lines, span)
    order = F.coalesce("raw_line_no", F.lit(-1))
    within = Window.partitionBy(*FILE, "__stretch").orderBy(order, "__own").rowsBetween(Window.unboundedPreceding, 0)
    carrying = rows.where("__carries").withColumn("__within", F.last("__own", ignorenulls=True).over(within))
    before = _before(lines, last, span).where("__stretch > -2 and __before is not null").select(*FILE, "__stretch", "__before")
    met = carrying.alias("l").join(before.alias("b"), _same([*FILE, "__stretch"], "l", "b"), "left")
    carried = met.select(*(F.col(f"l.{c}") for c in lines.columns), F.coalesce("l.__within", "b.__before").alias("ts"))
    return carried.unionByName(rows.where(~F.col("__carries")).select(*lines.columns, F.col("__own").alias("ts")))


def last_times(lines: DataFrame, last: DataFrame, span: int = SPAN, keep_days: int | None = None) -> DataFrame:
    """The last place and time of each file (``LAST``) after a piece: one row a file. With ``keep_days``, files whose last
    time lies so many days behind the newest of all are forgotten."""
    ends = _before(lines, last, span).groupBy(*FILE).agg(
        F.max_by("__high", F.when(F.col("__high").isNotNull(), F.col("__stretch"))).alias("last_place"), F.max_by("__end", F.when(F.col("__end").isNotNull(), F.col("__stretch"))).alias("last_ts"),
    ).where("last_ts is not null")
    if keep_days is None:
        return ends
    newest = ends.agg(F.max("last_ts").alias("__newest"))
    return ends.crossJoin(F.broadcast(newest)).where(F.col("last_ts") >= F.col("__newest") - F.expr(f"interval {int(keep_days)} days")).drop("__newest")
