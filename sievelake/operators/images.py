"""Images as rows, and the regions found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.images import detect_regions


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image): decoded in the JVM; files that can't be are left out."""
    df = spark.read.format("image").option("dropInvalid", "true").load(path)
    return df.select(F.col("image.origin").alias("path"), "image")


def detect_images(images: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(path, region, x, y, width, height, confidence): a row per region, the largest first."""
    found = images.select("path", F.posexplode(detect_regions(F.col("image"), threshold)).alias("region", "_r"))
    return found.select("path", "region", "_r.*")
