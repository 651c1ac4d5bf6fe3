"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document of n tokens costs about ``linear * n + quadratic * n * n`` to attend over. Whole
sequences are cut off long documents first; what is left of each is assigned, by descending cost, to
the sequence of lowest cost that still has room for it. A rest that fits nowhere is cut over the
sequences with room, so that all are full. Each partition packs its own documents in blocks of
bounded memory, without a shuffle; what a block leaves over is carried to the next. What partitions
leave over at their end, less than a sequence each, meets in one of ``gather`` times fewer partitions; what is left there
goes to sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import readable, settle

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Where cutting a text at single spaces could change its pieces: runs of white space round a space.
TANGLED = re.compile(r"  |\s \s|\s \Z")
CACHE_ENTRIES = 400_000
#: Sequences of what partitions leave over are numbered from here times 2^33, beyond those of all partitions.
OWN_IDS = 1 << 28


def bytes_of_unicode() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Token ids of texts, packed as little-endian unsigned 32-bit ids, as the vocabulary's own tokenizer gives them.

    Its added tokens are single ids wherever their strings stand in a text. Words' ids are kept, as words come again and again.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from public_tokenizers import PATTERN

        model = json.loads(open(vocabulary, encoding="utf-8").read())
        byte = bytes_of_unicode()
        special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        self.special = {k: np.asarray([v], "<u4").tobytes() for k, v in special.items()}
        self.added = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        ids = self.plain(f" {word}")
        if len(word) < 40:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.added is None or not (found := self.added.search(text)):
            return self.between(text)
        out, at = [], 0
        while found:
            out += [self.between(text[at : found.start()]), self.special[found[0]]]
            at = found.end()
            found = self.added.search(text, at)
        return b"".join([*out, self.between(text[at:])])

    def between(self, text: str) -> bytes:
        """Of a text without added tokens."""
        if TANGLED.search(text):
            return self.plain(text)
        first, *words = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, words))


def assign(sizes: np.ndarray, capacities: np.ndarray, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, its start, length, bin) of each piece. The capacities add up to no more than the sizes.

    Items come by descending cost; each goes to the lowest-cost bin with room, or is cut over bins
    with room by ascending cost; what finds no room is left out.
    """
    cost, room, out = np.zeros(len(capacities)), capacities.astype(np.int64).copy(), []
    for item in np.argsort(-sizes, kind="stable"):
        start, left = 0, int(sizes[item])
        while left:
            fits = room >= left
            if fits.any():
                at, n = int(np.where(fits, cost, np.inf).argmin()), left
            elif (room > 0).any():
                at = int(np.where(room > 0, cost, np.inf).argmin())
                n = int(room[at])
            else:
                break
            out.append((int(item), start, n, at))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Packer:
    """Packs what one partition holds; sequence ids are unique as the partition's number leads them."""

    def __init__(self, partition: int, length: int, linear: float, quadratic: float):
        self.next, self.length, self.linear, self.quadratic = partition << 33, length, linear, quadratic
        self.items: list[tuple[object, int, int, bytes]] = []  # doc_id, start, its document's tokens, ids
        self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, doc_id, start: int, ids: bytes, doc_tokens: int, sequence: int, offset: int, tokens: int) -> None:
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence, offset, tokens))

    def add(self, doc_id, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.length:
            self._emit(doc_id, start, ids[4 * start : 4 * (start + self.length)], n, self.next, 0, self.length)
            self.next += 1
            start += self.length
        if start < n:
            self.items.append((doc_id, start, n, ids[4 * start :]))
            self.tokens += n - start

    def pack(self, last: bool) -> None:
        bins = [self.length] * (self.tokens // self.length) + (powers_of_two(self.tokens % self.length) if last else [])
        if not bins:
            return
        filled, rest = [0] * len(bins), [0] * len(self.items)
        for item, start, n, at in assign(np.array([len(x[3]) // 4 for x in self.items]), np.array(bins), self.linear, self.quadratic):
            doc_id, begins, doc_tokens, ids = self.items[item]
            self._emit(doc_id, begins + start, ids[4 * start : 4 * (start + n)], doc_tokens, self.next + at, filled[at], bins[at])
            filled[at] += n
            rest[item] = start + n
        self.next += len(bins)
        self.items = [(d, s + done, n, ids[4 * done :]) for (d, s, n, ids), done in zip(self.items, rest, strict=True) if 4 * done < len(ids)]
        self.tokens = sum(len(x[3]) // 4 for x in self.items)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        frame = pd.DataFrame(rows, columns=COLUMNS)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    def leave(self) -> pd.DataFrame:
        """What is left over, with its ids, for another packer."""
        rows = [(d, s, len(ids) // 4, zlib.crc32(ids), n, None, None, None, ids) for d, s, n, ids in self.items]
        frame = pd.DataFrame(rows, columns=[*COLUMNS, "_ids"])
        self.items, self.tokens = [], 0
        return frame.astype({c: "Int64" for c in ("doc_id", "sequence_id", "offset", "sequence_tokens")})


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
    block_tokens: int = 1_000_000,
    gather: int = 64,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A document is its ids by the byte-level vocabulary at ``vocabulary``, then ``end_id``. A null
    text counts as empty (one token); bytes that aren't UTF-8 count as replacement characters; a null id stays null; rows that repeat are packed each. No
    rows in, no rows out; other columns are ignored. The pieces are written to the shared folder as they
    are packed, so they stay the same however often the result is read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer, encoder, end = Packer(TaskContext.get().partitionId(), length, linear, quadratic), None, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            encoder = encoder or Encoder(vocabulary)
            for doc_id, text in zip(batch["_id"], batch["_t"], strict=True):
                packer.add(None if doc_id is None else int(doc_id), encoder.ids(text) + end)
                if packer.tokens >= block_tokens:
                    packer.pack(last=False)
            if packer.rows:
                yield packer.take().assign(_ids=None, _part=-1)
        packer.pack(last=False)
        if packer.rows:
            yield packer.take().assign(_ids=None, _part=-1)
        if packer.items:
            yield packer.leave().assign(_part=TaskContext.get().partitionId())

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer = Packer(OWN_IDS + TaskContext.get().partitionId(), length, linear, quadratic)
        for batch in batches:
            for doc_id, start, n, ids in zip(batch["doc_id"], batch["start"], batch["doc_tokens"], batch["_ids"], strict=True):
                packer.items.append((None if doc_id is None else int(doc_id), int(start), int(n), bytes(ids)))
                packer.tokens += len(ids) // 4
            if packer.tokens >= block_tokens:
                packer.pack(last=False)
                yield packer.take()
        packer.pack(last=True)
        if packer.rows:
            yield packer.take()

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), readable(F.col(text_col)).alias("_t"))
    packed = settle(rows.mapInPandas(run, f"{SCHEMA}, _ids binary, _part int"), "packed")
    rest = packed.filter("_ids is not null")
    groups = 1 + (rest.agg(F.max("_part")).first()[0] or 0) // gather
    dealt = rest.withColumn("_group", F.expr(f"_part div {int(gather)}")).repartition(groups, "_group").sortWithinPartitions("_part", "doc_id", "start", "ids_crc32")
    last = dealt.select(F.col("doc_id").cast("string"), "start", "doc_tokens", "_ids").mapInPandas(finish, SCHEMA)
    return packed.filter("_ids is null").select(*COLUMNS).unionByName(last)
