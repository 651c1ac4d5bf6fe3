"""File operators: inspection, privacy cleaning and the batch over a mixed folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.markdown import clean_markdown
from sievelake.functions.metadata import clean_metadata, extension_of, inspect_metadata
from sievelake.operators.text import clean_udf
from sievelake.options import MarkdownOptions, MetadataOptions, TextOptions
from sievelake.sources.files import classify, output_path


def inspect_files(files: DataFrame) -> DataFrame:
    """(path, container, key, value, error_code, error_message): a row per entry; a file in error has one row, a clean one none."""
    found = files.withColumn("_i", inspect_metadata(F.col("content"), F.coalesce(F.col("extension"), F.lit(""))))
    rows = found.select("path", F.explode_outer("_i.entries").alias("_e"), "_i.error_code", "_i.error_message")
    return rows.select("path", "_e.*", "error_code", "error_message").filter("key is not null or error_code is not null")


def clean_files(files: DataFrame, options: MetadataOptions | None = None) -> DataFrame:
    """``files`` with output_path and the struct ``cleaned`` (content, removed, input_bytes, output_bytes, error_code, error_message)."""
    return files.select("path", output_path(F.col("path")).alias("output_path"), clean_metadata(F.col("content"), F.coalesce(F.col("extension"), F.lit("")), options).alias("cleaned"))


def clean_all(files: DataFrame, *, text: TextOptions | None = None, markdown: MarkdownOptions | None = None, metadata: MetadataOptions | None = None) -> DataFrame:
    """(path, pipeline, status, output_path, content, removed, error_code, error_message) of every file.

    A file goes to one pipeline by its extension; status is succeeded, skipped (unsupported) or failed. A file without content, as too large a one has none, fails.
    """
    routed = files.select("path", "content", extension_of(F.col("path")).alias("_ext"), classify(F.col("path")).alias("pipeline"))
    # each pipeline sees only its own contents; the others' go to it as null
    of = lambda kind: F.when(F.col("pipeline") == kind, F.col("content"))
    done = routed.withColumn("_m", clean_metadata(of("metadata"), F.col("_ext"), metadata)).withColumn("_d", clean_markdown(F.make_valid_utf8(of("markdown").cast("string")), markdown)).withColumn("_t", clean_udf(text or TextOptions())(F.make_valid_utf8(of("text").cast("string"))))
    content = F.coalesce(F.col("_m.content"), F.col("_d.cleaned").cast("binary"), F.col("_t.cleaned").cast("binary"))
    removed = F.coalesce(F.size("_m.removed"), F.size("_d.removed"), F.size("_t.removed"))
    large = F.col("content").isNull()
    status = F.when(F.col("pipeline") == "unsupported", "skipped").when(large | F.col("_m.error_code").isNotNull(), "failed").otherwise("succeeded")
    code = F.when((status == "failed") & large, "PAYLOAD_TOO_LARGE").otherwise(F.col("_m.error_code"))
    return done.select("path", "pipeline", status.alias("status"), output_path(F.col("path")).alias("output_path"), content.alias("content"), F.when(status == "succeeded", removed).alias("removed"), code.alias("error_code"), F.col("_m.error_message").alias("error_message"))


def outcomes(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("pipeline", "status").agg(F.count("*").alias("files"))
