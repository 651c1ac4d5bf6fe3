"""Exact dedup by content sort, with DataFrame functions only.

Rows are range-partitioned by sampled splitters over (first bytes, hash, salt) of the normalised
text, sorted externally within each partition, and neighbours with the same whole text form a run.
The sampled key is short and of bounded size, so what the driver samples doesn't grow with the
length of texts, and a passage that opens many texts doesn't pile them up, as the hash splits them.
A text with more than ``1 / heavy_parts`` of all rows is salted over many runs: there are at most
``heavy_parts`` of these, so their joint table is small whatever the input. That is a quarter of a partition's share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import shuffle_partitions

#: Code points of the text in the sampled key.
KEY_CHARS = 24


def identity(c: Column) -> Column:
    return c


def sha(c: str) -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def heavy_hashes(docs: DataFrame, text_hash: Column, heavy_parts: int) -> DataFrame:
    """Hashes shared by over ``1 / heavy_parts`` of all rows: fewer than ``heavy_parts`` rows."""
    counts = docs.select(text_hash.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))
    total = docs.agg(F.count("*").alias("_all"))
    return counts.filter(F.col("_n") > 1).join(F.broadcast(total), F.col("_n") * heavy_parts > F.col("_all")).select("_h")


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = identity,
    heavy_parts: int | None = None,
    salts: int = 64,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the ``carry`` columns.

    Texts are equal when their normalised forms are identical; a null text counts as empty.
    Of equal texts the row with the smallest id stays (``keep="max"``: the largest). Null ids never
    win over other ids. Rows that repeat an id and its text are one group; only one of them is
    ``kept``. No rows in, no rows out. Other columns are ignored unless named in ``carry``; they may have any
    name, as inner names are prefixed.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    spark = docs.sparkSession
    heavy_parts = heavy_parts or max(512, 4 * shuffle_partitions(spark))
    best = F.min if keep == "min" else F.max
    order = F.col("_id").asc_nulls_last() if keep == "min" else F.col("_id").desc_nulls_last()
    plain = normalise is identity
    carried = [c for c in carry if not (c == text_col and plain)]
    named = text_col in carry and plain
    null = [F.col(text_col).isNull().alias("_null")] if named else []
    base = docs.select(F.col(id_col).alias("_id"), *null, normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carried])
    base = base.withColumn("_h", F.xxhash64("_t"))
    heavy = heavy_hashes(base, F.col("_h"), heavy_parts).withColumn("_heavy", F.lit(True))
    # at most heavy_parts rows of eight bytes
    base = base.join(F.broadcast(heavy), "_h", "left")
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(salts)).cast("int")).otherwise(-1)
    ranged = base.select("_id", "_t", "_h", *["_null"] * named, *[f"_c_{c}" for c in carried], salt.alias("_salt"), F.substring("_t", 1, KEY_CHARS).alias("_p")).repartitionByRange(shuffle_partitions(spark), "_p", "_h", "_salt")
    # The range partitioning of (_p, _h, _salt) already keeps a run's rows together: no second exchange.
    run = Window.partitionBy("_p", "_h", "_salt", "_t").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select("*", sha("_t").alias("_sha"), F.row_number().over(run).alias("_rn"), best("_id").over(whole).alias("_best"), F.count("*").over(whole).alias("_size"))
    # Salted texts: at most heavy_parts of them, met whole and combined before the shuffle.
    joint = base.filter("_heavy").groupBy("_t").agg(best("_id").alias("_joint"), F.count("*").alias("_joint_n")).select(sha("_t").alias("_sha"), F.lit(True).alias("_met"), "_joint", "_joint_n")
    runs = runs.join(F.broadcast(joint), "_sha", "left")
    keep_id = F.when(F.col("_met"), F.col("_joint")).otherwise(F.col("_best"))
    return runs.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_joint_n", "_size").alias("group_size"),
        # an id has one salt, so one run holds the best
        ((F.col("_rn") == 1) & F.col("_best").eqNullSafe(keep_id)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *[(F.when(~F.col("_null"), F.col("_t")) if c == text_col and plain else F.col(f"_c_{c}")).alias(c) for c in carry],
    )
