"""Incremental, reversible line dedup: exact reference-count tables behind sharded cuckoo filters.

The exact tables have a row for each (key, document) reference, so that a deleted document's lines
can pass to the next holder, and the count and keeper of each key. Cuckoo filters, one per shard of the key
space, hold the keys with at least two documents: a line whose key a filter rejects needs no
lookup. References are dealt by shard and meet their shard's filter as a row of the same partition, so no
filter is sent to all executors. A filter has false positives but no false negatives, and can delete, so that it
follows the counts both ways; the exact table has the last word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch, new_folder, settle, shuffle_partitions

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def digest_of(key: Column) -> Column:
    """16 bytes of the key's SHA-256."""
    return F.substring(F.unhex(F.sha2(key.cast("binary"), 256)), 1, 16)


def py_digest(line: bytes) -> bytes:
    # lower() changes ASCII letters only
    return hashlib.sha256(line.strip(BLANKS.encode()).lower()).digest()[:16]


class CuckooFilter:
    """16-bit prints in buckets of four; keys are 16-byte digests. Grows by building anew if an insertion fails."""

    def __init__(self, keys: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    @staticmethod
    def split(digests: list[bytes] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prints (never 0) and hashes of digests."""
        words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        prints = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return np.where(prints == 0, np.uint16(1), prints), words[:, 0]

    def places(self, prints: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        with np.errstate(over="ignore"):
            first = hashes & mask
            return first, (first ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(20))) & mask

    def add(self, digests: list[bytes]) -> bool:
        prints, hashes = self.split(digests)
        first, second = self.places(prints, hashes)
        rng = np.random.default_rng(1)
        table = self.table
        for p, i, j in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for at in (i, j):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = p
                    break
            else:
                at = i
                for _ in range(500):
                    slot = int(rng.integers(SLOTS))
                    p, table[at, slot] = int(table[at, slot]), p
                    at = int(self.places(np.array([p], np.uint16), np.array([at], np.uint64))[1][0])
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = p
                        break
                else:
                    return False
        return True

    def has(self, digests: list[bytes]) -> np.ndarray:
        prints, hashes = self.split(digests)
        first, second = self.places(prints, hashes)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def remove(self, digests: list[bytes]) -> None:
        """Only of keys that were added."""
        prints, hashes = self.split(digests)
        for p, i, j in zip(prints.tolist(), *(x.tolist() for x in self.places(prints, hashes)), strict=True):
            for at in (i, j):
                found = np.flatnonzero(self.table[at] == p)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        out.buckets = len(out.table)
        return out

    @classmethod
    def build(cls, digests: list[bytes]) -> CuckooFilter:
        room = len(digests)
        while True:
            out = cls(room)
            if out.add(digests):
                return out
            room = out.buckets * SLOTS


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Distinct (digest, doc) pairs: the exact table of references."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), key_of))
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.filter(keys, lambda k: F.length(k) >= min_chars)).alias("key")).select(digest_of(F.col("key")).alias("digest"), "doc")


def counts(refs: DataFrame) -> DataFrame:
    """Of keys held by at least two documents: its references and the smallest document, which keeps it. A common key is combined before the shuffle."""
    return refs.groupBy("digest").agg(F.count("*").alias("holders"), F.min("doc").alias("keeper"), F.max("doc").alias("_last")).filter("keeper < _last").drop("_last")


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def filters(table: DataFrame, shards: int) -> DataFrame:
    """(shard, data): a cuckoo filter of each shard's keys. ``shards`` follows the number of keys, so a shard is bounded."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "data": [CuckooFilter.build([bytes(x) for x in part["digest"]]).dump()]})

    return table.select(shard_of(F.col("digest"), shards).alias("shard"), "digest").groupBy("shard").applyInPandas(build, "shard int, data binary")


def probe(refs: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """The references (digest, doc) whose key the filter of its shard may hold. A partition has a shard's filter before the shard's references and reads one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for shard, rows in sorted(batch.groupby("shard").indices.items()):
                if shard != at:
                    at, own = shard, None
                data = batch["data"].to_numpy()[rows]
                if data[0] is not None:
                    own, rows = CuckooFilter.load(bytes(data[0])), rows[1:]
                if own is not None and len(rows):
                    keep[rows] = own.has([bytes(x) for x in batch["digest"].to_numpy()[rows]])
            yield batch.loc[keep, ["digest", "doc"]].astype({"doc": "int64"})

    rows = refs.select(shard_of(F.col("digest"), shards).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("data"), "digest", F.col("doc").cast("long").alias("doc"))
    heads = built.select("shard", F.lit(0).alias("kind"), "data", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("doc"))
    dealt = heads.unionByName(rows).repartition(shuffle_partitions(refs.sparkSession), "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInPandas(run, "digest binary, doc long")


def drops(refs: DataFrame, table: DataFrame, built: DataFrame | None = None, *, shards: int | None = None, shard_keys: int = 250_000, heavy: int = 512) -> DataFrame:
    """(doc, digest): the references that lose their lines. ``built`` are the filters, if there are any yet, over ``shards``.

    A shard has about ``shard_keys`` keys, and there are several for each partition. Keys with more than
    1 / ``heavy`` of all references, of which there are fewer than ``heavy``, are told apart first, as their references would pile up in one shard.
    """
    shards = shards or max(-(-table.count() // shard_keys), 4 * shuffle_partitions(refs.sparkSession))
    hot = table.filter(F.col("holders") * heavy > F.lit(refs.count())).select("digest", F.col("keeper").alias("_hot"))
    told = refs.join(F.broadcast(hot), "digest", "left")
    sure = told.filter("doc > _hot").select("doc", "digest")
    likely = probe(told.filter("_hot is null"), filters(table, shards) if built is None else built, shards)
    return sure.unionByName(likely.join(table, "digest").filter(F.col("doc") > F.col("keeper")).select("doc", "digest"))


def rewrite(docs: DataFrame, dropped: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every document."""
    per_doc = dropped.groupBy("doc").agg(F.collect_list("digest").alias("_lost")).withColumnRenamed("doc", "_doc")
    # bytes, as a text may hold some that aren't UTF-8; they stay
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, n, gone = [], [], []
            for text, lost in zip(batch["_t"], batch["_lost"], strict=True):
                if lost is None or not len(lost):
                    texts.append(text)
                    n.append(text.count(b"\n") + 1)
                    gone.append(0)
                    continue
                lines, lost = text.split(b"\n"), {bytes(x) for x in lost}
                kept = [x for x in lines if py_digest(x) not in lost]
                texts.append(b"\n".join(kept))
                n.append(len(lines))
                gone.append(len(lines) - len(kept))
            yield pd.DataFrame({"doc_id": batch["_id"], "n_lines": n, "n_dropped": gone, "kept_text": texts})

    return base.join(per_doc, F.col("_id") == F.col("_doc"), "left").select(F.col("_id").cast("string"), "_t", "_lost").mapInPandas(run, "doc_id string, n_lines long, n_dropped long, kept_text binary").withColumns({"doc_id": F.col("doc_id").cast("long"), "kept_text": F.col("kept_text").cast("string")})


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_text of every document.

    A line's key is the line without white space (space, U+0009 to U+000D) at its ends, A-Z
    lowered. Keys of at least ``min_chars`` code points in at least two documents lose all their
    lines but those of the smallest id that holds them. Null and empty texts are one empty line.
    Rows that share an id count as one document, so their lines stay; a null id holds no
    references and keeps all its lines. A document that loses all its lines keeps the empty text.
    """
    scratch = Scratch(docs.sparkSession)
    refs = references(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, min_chars)
    refs = scratch.settle(refs.withColumn("doc", F.col("doc").cast("long")), "line-references")
    table = scratch.settle(counts(refs), "line-counts")
    return scratch.keep(rewrite(docs, drops(refs, table), id_col=id_col, text_col=text_col), "line-dedup")


TABLES = {"refs": "shard int, digest binary, doc long", "counts": "shard int, digest binary, holders long, keeper long", "filters": "shard int, data binary"}


@dataclass(frozen=True)
class LineIndex:
    """An incremental line dedup in a shared folder: documents can be inserted and deleted again.

    Its tables are the references, the holders and the keeper of each key, and a cuckoo filter of each shard. A change
    writes new versions of the shards that it touches and leaves the others' files alone; ``versions`` has
    the version of each. Counts change by what was added or removed, and filters by the keys that came to two holders or fell
    below. An index doesn't change, so the one before stays as it was. Deleting
    a document gives its lines to the next smallest holder, as if it had never been inserted.
    """

    spark: SparkSession
    folder: str
    shards: int
    versions: tuple[tuple[int, str], ...] = ()

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 64) -> LineIndex:
        """``shards`` stays for good: about the expected number of keys over 250,000."""
        return cls(spark, new_folder(spark, "line-index"), shards)

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """All shards of a table, or some."""
        of: dict[str, list[int]] = {}
        for shard, version in self.versions:
            if only is None or shard in only:
                of.setdefault(version, []).append(shard)
        out = self.spark.createDataFrame([], TABLES[name])
        for version, own in of.items():
            out = out.unionByName(self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{version}/{name}").filter(F.col("shard").isin(own)))
        return out

    def insert(self, docs: DataFrame, **names: str) -> LineIndex:
        """With the lines of documents; a document that it has already gains those it lacks. Null ids are skipped."""
        new = references(docs.filter(F.col(names.get("id_col", "doc_id")).isNotNull()), **names).select(shard_of(F.col("digest"), self.shards).alias("shard"), "digest", F.col("doc").cast("long").alias("doc")).distinct()
        return self._changed(new, 1)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of a table of ids; ids that it doesn't have change nothing."""
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("doc")).distinct()
        return self._changed(self.table("refs").join(gone, "doc", "left_semi").select("shard", "digest", "doc"), -1)

    def _changed(self, delta: DataFrame, sign: int) -> LineIndex:
        scratch, version = Scratch(self.spark), uuid.uuid4().hex
        delta = scratch.settle(delta, "line-delta")
        # at most a number for each shard
        touched = [r.shard for r in delta.select("shard").distinct().collect()]
        refs, known, built = (self.table(name, touched) for name in TABLES)
        key = ["shard", "digest"]
        if sign > 0:
            delta = scratch.settle(delta.join(refs, [*key, "doc"], "left_anti"), "line-news")
            after = refs.unionByName(delta)
        else:
            after = refs.join(delta, [*key, "doc"], "left_anti")
        change = delta.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc").alias("least"))
        both = known.join(change, key, "full").select(*key, F.coalesce("holders", F.lit(0)).alias("was"), (F.coalesce("holders", F.lit(0)) + sign * F.coalesce("n", F.lit(0))).alias("holders"), "keeper", "least")
        if sign > 0:
            both = both.withColumn("keeper", F.least("keeper", "least"))
        else:
            # only where the keeper went
            orphans = both.filter("least <= keeper and holders > 0").select(*key)
            heirs = after.join(orphans, key, "left_semi").groupBy(*key).agg(F.min("doc").alias("heir"))
            both = both.join(heirs, key, "left").withColumn("keeper", F.coalesce("heir", "keeper"))
        both = scratch.settle(both.select(*key, "was", "holders", "keeper"), "line-counts")
        path = f"{self.folder}/{version}"
        both.filter("holders > 0").select(*key, "holders", "keeper").write.parquet(f"{path}/counts")
        after.write.parquet(f"{path}/refs")
        crossing = both.filter("(was > 1) <> (holders > 1)").select(*key, (F.col("holders") > 1).alias("up"))
        followed = scratch.settle(follow(built, crossing), "line-filters")
        # filters that are full, or new, are built from their shards' keys
        anew = filters(both.filter("holders > 1").join(followed.filter("data is null"), "shard", "left_semi"), self.shards)
        untouched = built.join(followed, "shard", "left_anti")
        followed.filter("data is not null").unionByName(anew).unionByName(untouched).write.parquet(f"{path}/filters")
        scratch.drop()
        return LineIndex(self.spark, self.folder, self.shards, tuple(sorted({**dict(self.versions), **dict.fromkeys(touched, version)}.items())))

    def dropped(self) -> DataFrame:
        """(doc, digest): the references that lose their lines."""
        return drops(self.table("refs").select("digest", "doc"), self.table("counts").filter("holders > 1").select("digest", "holders", "keeper"), self.table("filters"), shards=self.shards)


def follow(built: DataFrame, crossing: DataFrame) -> DataFrame:
    """(shard, data) of the shards of ``crossing`` (shard, digest, up): the filters with keys added and removed, null where one must be built anew."""

    def run(key: tuple, changes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(changes):
            return pd.DataFrame({"shard": [], "data": []}).astype({"shard": "int32", "data": object})
        data = None
        if len(own):
            live = CuckooFilter.load(bytes(own["data"].iloc[0]))
            live.remove([bytes(x) for x in changes["digest"][~changes["up"]]])
            data = live.dump() if live.add([bytes(x) for x in changes["digest"][changes["up"]]]) else None
        return pd.DataFrame({"shard": [key[0]], "data": [data]})

    return crossing.groupBy("shard").cogroup(built.groupBy("shard")).applyInPandas(run, "shard int, data binary")
