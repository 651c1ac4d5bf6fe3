"""Files as rows: listings, routing by extension, output names, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.metadata import EXTENSIONS, MARKDOWN, TEXT, extension_of
from sievelake.sources.sink import join_path, store_of


#: The longest value that a column can hold.
MAX_BYTES = (1 << 31) - 1
#: Files of ``read_files`` leave a task once they are so many or so many bytes.
SLICE_FILES, SLICE_BYTES = 1024, 1 << 24


def read_texts(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """(path, text): each file is one text."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, *, recursive: bool = False, suffix: str = ".cleaned", supported_only: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content, extension) of files, less those whose path has the suffix of cleaned ones.

    Files are chosen by the listing before any is read. One of more than ``max_bytes`` (at most 2 GiB less a byte, what a value
    can hold) has null content, so that it can't fill an executor or fail the job; ``clean_all`` gives it an error.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if supported_only:
        # others' contents aren't read
        read = read.option("pathGlobFilter", f"*{{{','.join(''.join(f'[{c}{c.upper()}]' if c.isalpha() else c for c in e) for e in EXTENSIONS)}}}")
    df = read.load(path).withColumn("extension", extension_of(F.col("path")))
    if suffix:
        df = df.filter(~F.contains("path", F.lit(suffix)))
    if supported_only:
        df = df.filter(is_supported(F.col("path")))
    fits = F.col("length") <= min(max_bytes, MAX_BYTES)
    # the source reads the content of files that pass a filter on length only
    large = df.filter(~fits).select("path", "length", F.lit(None).cast("binary").alias("content"), "extension")
    return df.filter(fits).select("path", "length", "content", "extension").unionByName(large)


def read_files(listed: DataFrame, folder: str) -> DataFrame:
    """(name, length, content) of files in ``folder`` by a table of their names, as ``write_files`` makes one.

    Unlike a file source, which holds the whole listing in the driver, tasks open the files that their rows name. A file that is gone fails the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(folder)
        for b in batches:
            names, contents, held = [], [], 0
            for name in b["name"]:
                with store.open_input_stream(join_path(root, name), compression=None) as f:
                    content = f.read()
                # a slice holds one large file at most
                if names and (len(names) == SLICE_FILES or held + len(content) > SLICE_BYTES):
                    yield pd.DataFrame({"name": names, "length": [len(c) for c in contents], "content": contents})
                    names, contents, held = [], [], 0
                names.append(name)
                contents.append(content)
                held += len(content)
            if names:
                yield pd.DataFrame({"name": names, "length": [len(c) for c in contents], "content": contents})

    # names are small, so they are dealt before the files are read
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("name").repartition(tasks, "name").mapInPandas(run, "name string, length long, content binary")


def is_supported(path: Column) -> Column:
    """Whether a metadata reader handles the file."""
    return extension_of(path).isin(*EXTENSIONS)


def classify(path: Column) -> Column:
    """markdown, metadata, text or unsupported: markdown first, then the metadata readers, then text and files without extension."""
    ext = extension_of(path)
    return F.when(path.isNull(), None).when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*EXTENSIONS), "metadata").when(ext.isin(*TEXT) | (ext == ""), "text").otherwise("unsupported")


def output_path(path: Column, suffix: str = ".cleaned") -> Column:
    """The suffix between a file's name and its extension."""
    return F.concat(F.regexp_replace(path, r"(\.[^./\\]+)$", ""), F.lit(suffix), F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one JSON string, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_texts(df: DataFrame, path: str, text_col: str = "text") -> None:
    df.select(F.col(text_col).alias("value")).write.text(path)
