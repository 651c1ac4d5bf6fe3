"""Joins by time: the last row before a moment, and the intervals that hold it.

Rows of a key are cut into buckets of time, so that a key with most of the rows is many tasks' work. For the last row before a moment, each bucket's last row is carried
into the buckets after it. Intervals are put to a level of buckets by their length, so that neither long nor short ones are copied often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(time: str, df: DataFrame) -> Column:
    """A time as microseconds: a timestamp, or a whole number that is taken as it is."""
    return F.unix_micros(F.col(time).cast("timestamp")) if dict(df.dtypes)[time].startswith("timestamp") else F.col(time).cast("long")


def place(time: Column, width: Column | int) -> Column:
    """The bucket of a time, in whole numbers."""
    width = F.lit(width).cast("long") if isinstance(width, int) else width
    return F.call_function("div", time - F.pmod(time, width), width)


def key_columns(df: DataFrame, keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], *, bucket: int = 3_600_000_000, prefix: str = "asof_") -> DataFrame:
    """``left`` with ``columns`` and the time of the last row of ``right`` that has its keys and isn't later, under names with the prefix; null where there is none.

    Of right rows at one time the one with the greatest ``columns`` counts. A row with a null key or time has no other; right ones are left out. ``bucket`` is
    in microseconds, or in the unit of whole numbers. Rows that repeat are joined each. A left column with the name of an added one gives way.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    at = place(F.col("_time"), bucket)
    seen = F.struct(micros(right_time, right).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(right_time).alias("time"))
    rights = right.select(*key_columns(right, keys), micros(right_time, right).alias("_time"), seen.alias("_seen")).dropna(subset=[*names, "_time"])
    # of one moment one row is enough, whatever stands there
    rights = rights.groupBy(*names, "_time").agg(F.max("_seen").alias("_seen")).withColumn("_bucket", at)
    own = F.struct(*left.columns)
    lefts = left.select(*key_columns(left, keys), micros(left_time, left).alias("_time"), own.alias("_row")).withColumn("_bucket", at)
    known = lefts.dropna(subset=[*names, "_time"])
    both = rights.withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType)).unionByName(known.withColumn("_seen", F.lit(None).cast(rights.schema["_seen"].dataType)))
    # at one time the right row stands before the left ones
    order = Window.partitionBy(*names, "_bucket").orderBy("_time", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(order)).filter("_row is not null")
    # a row for each bucket that has any
    ends = both.groupBy(*names, "_bucket").agg(F.max("_seen").alias("_end"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*names, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = within.join(carried, [*names, "_bucket"], "left").select("_row", F.coalesce("_last", "_carried").alias("_seen"))
    alone = lefts.filter(" or ".join(f"{c} is null" for c in [*names, "_time"])).select("_row", F.lit(None).cast(rights.schema["_seen"].dataType).alias("_seen"))
    added = {f"{prefix}{c}": F.col("_seen")[f"c{i}"] for i, c in enumerate(columns)} | {f"{prefix}time": F.col("_seen")["time"]}
    return found.unionByName(alone).select(*[F.col("_row")[c].alias(c) for c in left.columns if c not in added], *[v.alias(k) for k, v in added.items()])


#: Buckets of a level are so many times as long as those of the one below.
STEP = 64


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, *, bucket: int = 60_000_000, levels: int = 4) -> DataFrame:
    """Each point with each interval of its keys that holds it: start <= time < end. The result has the structs ``point`` and ``interval``.

    A bucket of the lowest level is ``bucket`` long (microseconds, or the unit of whole numbers). An interval goes to the lowest level where it covers at most ``STEP`` buckets, and to
    each of these; a point goes to one bucket of each of the ``levels``. On the highest level an interval may cover more. Null keys, times
    and ends, and intervals that end before they start, match nothing. Rows that repeat match each.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    widths = [bucket * STEP**k for k in range(levels)]
    spans = intervals.select(*key_columns(intervals, keys), micros(start, intervals).alias("_from"), micros(end, intervals).alias("_to"), F.struct(*intervals.columns).alias("interval")).dropna(subset=[*names, "_from", "_to"]).filter("_from < _to")
    level = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        level = F.when(F.col("_to") - F.col("_from") <= widths[k] * (STEP - 1), k).otherwise(level)
    spans = spans.withColumn("_level", level)
    width = F.get(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("_level"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(place(F.col("_from"), width), place(F.col("_to") - 1, width))))
    at = F.array(*[F.struct(F.lit(k).alias("_level"), place(F.col("_time"), w).alias("_bucket")) for k, w in enumerate(widths)])
    own = points.select(*key_columns(points, keys), micros(time, points).alias("_time"), F.struct(*points.columns).alias("point")).dropna(subset=[*names, "_time"])
    own = own.withColumn("_at", F.explode(at)).select(*names, "_time", "point", "_at.*")
    # an interval is in each of its buckets once, and a point in one of them
    return own.join(spans, [*names, "_level", "_bucket"]).filter("_from <= _time and _time < _to").select("point", "interval")
