"""Signals over streams: stateless detection, and rates by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelake.operators.text import detect_text


def read_stream(spark: SparkSession, path: str, schema: str | StructType, *, fmt: str = "parquet", max_files: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def signal_rates(texts: DataFrame, time_col: str, *, window: str = "10 minutes", slide: str | None = None, late: str = "30 minutes", text_col: str = "text") -> DataFrame:
    """Matches by window, vendor and pattern. Rows more than ``late`` behind the newest are dropped, so state is bounded."""
    found = detect_text(texts.select(F.col(time_col).alias("_time"), F.col(text_col).alias("text")).withWatermark("_time", late))
    return found.groupBy(F.window("_time", window, slide).alias("window"), "vendor", "pattern").agg(F.count("*").alias("matches"))


def bursts(texts: DataFrame, time_col: str, keys: list[str], *, gap: str = "5 minutes", late: str = "30 minutes", text_col: str = "text") -> DataFrame:
    """Sessions of matches by ``keys``: a session ends after a gap without one."""
    found = detect_text(texts.select(*keys, F.col(time_col).alias("_time"), F.col(text_col).alias("text")).withWatermark("_time", late))
    return found.groupBy(F.session_window("_time", gap).alias("session"), *keys).agg(F.count("*").alias("matches"))
