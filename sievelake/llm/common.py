"""What the operators share: the folder that all executors see, and tables written to it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.session import new_folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage like a checkpoint, but computes ``df`` once and keeps columns apart, so
    that a lost executor costs a reread and later steps read only what they use.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one run of an operator; they go once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, new_folder(spark, "run")

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table that stays, in place of all others."""
        out = settle(df, name)
        self.drop()
        return out

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def readable(text: Column) -> Column:
    """A text that Python can read: null is empty, and bytes that aren't UTF-8 become replacement characters."""
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splitters(ids: DataFrame, parts: int, each: int = 64) -> list[int]:
    """At most ``parts - 1`` ids, out of a column of whole numbers, that part it evenly.

    They come from about ``each * parts`` ids that a hash picks, however many there are, so the same ids
    always give the same splitters.
    """
    ids = ids.toDF("id").filter("id is not null")
    every = max(1, ids.count() // (each * parts))
    picked = sorted({r.id for r in ids.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0).collect()})
    return sorted({picked[i * len(picked) // parts] for i in range(1, parts)}) if picked else []


def numbered(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos``, the place of each in its group from 0, and ``n``, the group's number of rows.

    Rows are range-partitioned and sorted by group and order, and written; each partition's rows of a group are counted, and
    the counts before them added. So a group may be any part of all rows. Ties follow in any order.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *group, *order).sortWithinPartitions(*group, *order)
    # the number holds the partition in its upper and the place in its lower 33 bits
    dealt = scratch.settle(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    family = Window.partitionBy(*group)
    before = family.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(family).alias("n"))
    out = dealt.withColumn("_part", part).join(scratch.settle(firsts, "places"), [*group, "_part"])
    return out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")
