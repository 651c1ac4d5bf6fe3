"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id: splitters come from a hash sample of the ids, so the same
pages always make the same shards. Each shard rolls to a new file once the compressed bytes reach a
size. Headers, record ids and digests are made anew from the payload. A file is written under a
temporary name and renamed when it is whole, so that a task that runs again replaces it by the same
bytes; a manifest, committed last, lists the files that count, and readers read only these.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch, shuffle_partitions, splitters

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, first_page long, last_page long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record as its own gzip member. The block of a response is the payload; a revisit has none."""
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    block = payload if kind == "response" else b""
    uri = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    data = f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def filesystem(uri: str):
    """The store of a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def fs_selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


class Roller:
    """The files of one shard at a time."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.path = filesystem(folder)
        self.roll, self.shard, self.out, self.done = roll_bytes, None, None, []

    def add(self, shard: int, page_id: int | None, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.out is None:
            self.name = f"part-{shard:06d}-{self.part:04d}.warc.gz"
            self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.out, self.sha, self.size, self.pages = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, []
            self.count = 0
        self.out.write(data)
        self.sha.update(data)
        self.size, self.count = self.size + len(data), self.count + 1
        if page_id is not None:
            self.pages = [min(self.pages[:1] + [page_id]), max(self.pages[1:] + [page_id])]
        if self.size >= self.roll:
            self.close()
            self.part += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            from pyarrow import fs

            # a task that runs again replaces its files; some stores don't move over one that is there
            if self.fs.get_file_info(f"{self.path}/{self.name}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.path}/{self.name}")
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.name, *(self.pages or [None, None]), self.count, self.size, self.sha.hexdigest()))
            self.out = None


def place_among(cuts: list[int]):
    """How many of ``cuts`` are at most a page id, looked up in batches."""
    known = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(page: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known, page.to_numpy(np.int64), side="right").astype(np.int32))

    return place


def even_cuts(sized: DataFrame, shards: int) -> list[int]:
    """At most ``shards - 1`` page ids that part the rows (page, n) into shards of like bytes ``n``: of many splitters those at which a shard is full are taken."""
    fine = splitters(sized.select("page"), 16 * shards)
    # a row for each splitter
    sums = dict(sized.filter("page is not null").groupBy(place_among(fine)(F.col("page")).alias("k")).agg(F.sum("n").alias("n")).collect())
    total, upto, out = sum(sums.values()), 0, []
    for k, cut in enumerate(fine):
        upto += sums.get(k, 0)
        if total and upto * shards >= (len(out) + 1) * total and len(out) < shards - 1:
            out.append(cut)
    return out


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shards: int | None = None, shard_bytes: int = 128 << 20, roll_bytes: int = 16 << 20, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write an archive of the pages to a new folder; returns its manifest, one row per file.

    The payload is the html's bytes, a null one is empty. Of pages with equal payloads of at
    least ``least_bytes``, the one with the least id is a response and the others revisit it; others
    are responses. Rows that repeat an id and payload are alike: all responses, or all revisits. A
    page without id is never revisited; it revisits another with its payload, if one has an id. Such pages are in shards by payload. No
    pages make no files. Other columns are ignored. Without ``shards``, there is one for each ``shard_bytes`` of payloads.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.make_valid_utf8(F.col(url_col)).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("_html"))
    digests = base.select("page", F.sha2("_html", 256).alias("digest"), F.octet_length("_html").alias("n"))
    sized = scratch.settle(digests, "digests")
    digests = sized.filter(F.col("n") >= least_bytes).select("page", "digest")
    # equal payloads are combined before the shuffle; only those that come again are looked up
    first = digests.groupBy("digest").agg(F.min("page").alias("refers"), F.count("*").alias("n")).filter("n > 1 and refers is not null").drop("n")
    roles = digests.join(first, "digest").filter(~F.col("page").eqNullSafe(F.col("refers"))).distinct()
    # shards follow the bytes alone, so that a task's share stays bounded and any cluster makes the same
    shards = shards or max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // shard_bytes))
    cuts = even_cuts(sized, shards)
    rows = base.select("page", F.lit(1).alias("_kind"), "_url", "_html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers"))
    rows = rows.unionByName(roles.select("page", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_url"), F.lit(None).cast("binary").alias("_html"), "digest", "refers"))
    # pages without id have no place in the order: those with a payload in common share a shard
    unnamed = F.pmod(F.xxhash64(F.coalesce("digest", F.sha2("_html", 256))), F.lit(shards)).cast("int")
    rows = rows.withColumn("_shard", F.when(F.col("page").isNull(), unnamed).otherwise(place_among(cuts)(F.coalesce("page", F.lit(0)))))
    # a task for each shard
    rows = rows.repartitionById(shards, "_shard").sortWithinPartitions("_shard", "page", "_kind", "digest", "_url", "_html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller, at, found = Roller(folder, roll_bytes), object(), {}
        for batch in batches:
            for shard, page, kind, url, html, digest, refers in zip(*(batch[c] for c in ("_shard", "page", "_kind", "_url", "_html", "digest", "refers")), strict=True):
                page = None if page is None else int(page)
                if page != at:
                    at, found = page, {}
                if not kind:
                    found[digest] = int(refers)
                    continue
                payload = bytes(html)
                to = found.get(hashlib.sha256(payload).hexdigest()) if found else None
                roller.add(int(shard), page, render(page, url, payload, to, date))
            if roller.done:
                yield pd.DataFrame(roller.done, columns=["file", "first_page", "last_page", "records", "bytes", "sha256"]).astype({"first_page": "Int64", "last_page": "Int64"})
                roller.done = []
        roller.close()
        if roller.done:
            yield pd.DataFrame(roller.done, columns=["file", "first_page", "last_page", "records", "bytes", "sha256"]).astype({"first_page": "Int64", "last_page": "Int64"})

    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    text = [F.col(c).cast("string").alias(c) for c in ("page", "refers")]
    rows.select("_shard", "_kind", "_url", "_html", "digest", *text).mapInPandas(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    scratch.drop()
    # of tasks that were killed
    for left in store.get_file_info(fs_selector(path)):
        if left.base_name.startswith("_temporary-"):
            store.delete_file(left.path)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


class Members(io.RawIOBase):
    """The decompressed bytes of concatenated gzip members, from a stream and in bounded memory."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk, self.unpack, self.raw = stream, chunk, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    return 0
            out = self.unpack.decompress(self.raw, len(into))
            self.raw = b"" if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    source = io.BufferedReader(Members(stream), 1 << 20)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := source.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip()] = v.strip()
        block = source.read(int(head["Content-Length"]))
        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"{head['WARC-Record-ID']}: the block doesn't match its digest")
        yield head, block


def read(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of the files in an archive's manifest, each checked against its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = filesystem(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for name in batch["file"]:
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for head, block in parse(f):
                        page, to = head["X-Page-ID"], head.get("X-Refers-To-Page-ID")
                        rows.append((int(page) if page else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], int(to) if to else None, block if payloads else None))
                        held += len(block) if payloads else 500
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest(spark, folder).select("file")
    return files.repartition(shuffle_partitions(spark), "file").mapInPandas(run, RECORD)
