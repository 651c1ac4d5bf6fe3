"""A sink that writes each row as a file of its own, for cleaned files.

A task writes its files under temporary names in a folder of its attempt, and their names to a list beside it. Once all tasks are done, the files of the
attempts that count are moved to their names, by tasks of a second job (``write_files``) or by the driver, so that a task that runs again leaves no second
copy, and a job that fails leaves nothing.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

FORMAT = "sievelake_files"
SCHEMA = "name string, content binary"
#: A row for each file that was written; names are below the folder.
LISTING = "name string, length long"
#: Files that a task moves before it tells of them.
MOVED_AT_ONCE = 4096
#: In the temporary folder, the folders of the attempts that count.
ATTEMPTS = "_attempts.json"
#: After the name of an attempt's folder, the list of its files: a name and a length in a line of JSON.
NAMES = ".names"


def store_of(uri: str):
    """The store of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def join_path(folder: str, name: str) -> str:
    """A name within a folder, which it may not leave."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"{name!r} is no name of a file in a folder")
    return "/".join([folder, *parts])


def move(attempt: str, folder: str) -> int:
    """Move the files of an attempt to their names in ``folder``; once more, it moves those that are left."""
    from pyarrow import fs

    (store, own), (_, root) = store_of(attempt), store_of(folder)
    # a task without rows makes no folder
    if store.get_file_info(own).type == fs.FileType.NotFound:
        return 0
    moves = [(f.path, f"{root}/{f.path[len(own) + 1 :]}") for f in store.get_file_info(fs.FileSelector(own, recursive=True)) if f.type == fs.FileType.File]
    run_moves(store, moves)
    return len(moves)


def run_moves(store, moves: list[tuple[str, str]]) -> None:
    from pyarrow import fs

    for above in {to.rpartition("/")[0] for _, to in moves}:
        store.create_dir(above, recursive=True)

    def run(ends: tuple[str, str]) -> None:
        try:
            store.move(*ends)
        except FileNotFoundError:
            # a copy of the task has moved it
            if store.get_file_info(ends[1]).type != fs.FileType.File:
                raise

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(run, moves))


def move_listed(attempt: str, folder: str) -> Iterator[list[tuple[str, int]]]:
    """Move the files that the list of an attempt names, some at a time, and give their names and lengths; once more, it gives the same."""
    from pyarrow import fs

    (store, own), (_, root) = store_of(attempt), store_of(folder)
    # a task without rows makes no list
    if store.get_file_info(own + NAMES).type == fs.FileType.NotFound:
        return
    with io.TextIOWrapper(store.open_input_stream(own + NAMES, compression=None), encoding="utf-8") as lines:
        for some in batched(lines, MOVED_AT_ONCE):
            files = [(name, length) for name, length in map(json.loads, some)]
            run_moves(store, [(f"{own}/{name}", f"{root}/{name}") for name, _ in files])
            yield files


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt; its files are listed beside it, not here."""

    folder: str


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str, later: bool = False):
        """``later``: the attempts that count are only listed."""
        self.folder, self.job, self.later = folder, job, later

    @property
    def temporary(self) -> str:
        return f"{self.folder.rstrip('/')}/_temporary-{self.job}"

    def write(self, rows: Iterator) -> Written:
        attempt = f"{self.temporary}/{uuid.uuid4().hex}"
        store, path = store_of(attempt)
        made, names = set(), None
        try:
            for row in rows:
                to, content = join_path(path, row.name), bytes(row.content)
                above = to.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                with store.open_output_stream(to, compression=None) as out:
                    out.write(content)
                names = names or store.open_output_stream(path + NAMES, compression=None, buffer_size=1 << 16)
                names.write(f"{json.dumps([to[len(path) + 1 :], len(content)])}\n".encode())
        finally:
            if names:
                names.close()
        return Written(attempt)

    def commit(self, messages: list) -> None:
        attempts = [m.folder for m in messages if m]
        if self.later:
            store, path = store_of(self.temporary)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{ATTEMPTS}", compression=None) as out:
                out.write(json.dumps(attempts).encode())
            return
        for attempt in attempts:
            move(attempt, self.folder)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        # of attempts that don't count, too
        store, path = store_of(self.temporary)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if schema.fieldNames() != ["name", "content"] or not isinstance(schema["content"].dataType, BinaryType):
            raise ValueError(f"{FORMAT} takes {SCHEMA}")
        if "path" not in self.options:
            raise ValueError(f"{FORMAT} needs a path")
        return FileWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex, "job" in self.options)


def relative(path: Column, base: str | None) -> Column:
    """A path below ``base``, or below its store's root."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    if base is None:
        return F.regexp_replace(bare, "^/+", "")
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root) + 1))).otherwise(F.regexp_replace(bare, "^/+", ""))


def write_files(cleaned: DataFrame, folder: str, *, base: str | None = None, listing: str | None = None) -> None:
    """Write the contents of ``cleaned`` (output_path, content, and status if there is one) to files of these names in ``folder``.

    Names are taken below ``base`` (a path without scheme). Rows that failed or were skipped, and those without content, write nothing; empty
    contents are empty files. Two rows of one name are an error before anything is written, whatever their status, as is a name that leaves the folder.
    A file that is there already under a name is replaced. No rows make no files. With ``listing``, a folder for it, the names and lengths of what was
    written become a table there (``LISTING``), for ``read_files`` to read the files by: the driver never lists them.
    """
    rows = cleaned.filter("status = 'succeeded'") if "status" in cleaned.columns else cleaned
    name = relative(F.col("output_path"), base).alias("name")
    rows = rows.filter("content is not null and output_path is not null").select(name, "content")
    # names come from the listing: no file is read or cleaned for these two
    names = cleaned.select(name).filter("name is not null")
    out_of = names.filter(F.rlike("name", F.lit(r"(^|/)\.\.(/|$)")) | (F.col("name") == "")).limit(5).collect()
    if out_of:
        raise ValueError(f"names that leave the folder: {[r.name for r in out_of]}")
    twice = names.groupBy("name").count().filter("count > 1").select("name").limit(5).collect()
    if twice:
        raise ValueError(f"several files of one name: {[r.name for r in twice]}")
    spark = cleaned.sparkSession
    spark.dataSource.register(FileSink)
    writer = FileWriter(folder, uuid.uuid4().hex)
    rows.write.format(FORMAT).option("path", folder).option("job", writer.job).mode("append").save()
    try:
        move_all(spark, writer, listing)
    finally:
        writer._clear()


def move_all(spark: SparkSession, writer: FileWriter, listing: str | None = None) -> None:
    """Move the files of the listed attempts, a task for each."""
    store, path = store_of(writer.temporary)
    with store.open_input_stream(f"{path}/{ATTEMPTS}", compression=None) as f:
        attempts = json.loads(f.read())
    folder = writer.folder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for attempt in b["attempt"]:
                for files in move_listed(attempt, folder):
                    yield pd.DataFrame(files, columns=["name", "length"])

    # as many rows as the write had tasks
    listed = spark.createDataFrame([(i, a) for i, a in enumerate(attempts)], "n long, attempt string")
    moved = listed.repartitionByRange(max(1, len(attempts)), "n").mapInPandas(run, LISTING)
    if listing:
        moved.write.parquet(listing)
    else:
        moved.agg(F.sum("length")).collect()
