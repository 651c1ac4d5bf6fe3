"""Near-duplicate classes by Order MinHash and banded alignment.

A document is its sequence of occurrence-labelled five-word shingles: the k-th occurrence of a
shingle is another symbol than the first, so that each symbol comes once. For each of ``bands``
hash functions a document samples the ``picks`` symbols of least hash and keeps them in text
order; documents with an equal sample are candidates, and those whose order differs are not.

Identical texts are one node. Two candidates are linked if their words align with few enough edits:
a banded Levenshtein alignment, whose columns are machine words of differences. Buckets of
candidates are met in passes. First those of a few bands, in blocks of bounded size, each with some members of the whole
bucket as heads, so that a large group of copies links up at a cost in proportion to its size. Then, in
buckets of several blocks and those of all other bands, in two rounds, members that aren't in one class yet meet, so that no pair of
candidates is left out; most copies are one class by then, and their words aren't sent again. In buckets of several blocks only
texts of like lengths meet, and in those of many only texts with one of their rarest words in common: an exact filter, as texts
with few edits between them have most words in common. Links join into classes
by contraction in tables, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch, shuffle_partitions

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of a text whose places are held in one table of bits.
CHUNK = 4096
#: Shingles of a text under which it has half as many bands again: how many of few are left by edits varies more.
FEW = 128
#: Most bins of the word counts that rule out most pairs before alignment.
BINS = 8192


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def symbols(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Occurrence-labelled shingles of a document in text order; a shorter document is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    words = words.view(np.uint64) if words.dtype == np.int64 else words
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out + words[i : n - k + 1 + i]) * MIX
    out = mix(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = ranked[1:] == ranked[:-1]
    if same.any():
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        nth = np.arange(len(out)) - np.repeat(starts, np.diff(np.append(starts, len(out))))
        out = out.copy()
        out[order] = np.where(nth > 0, mix(ranked + nth.astype(np.uint64) * MIX), ranked)
    return out


def order_minhash(found: np.ndarray, bands: int, picks: int) -> np.ndarray:
    """A signature for each band: the hash of the band and of its ``picks`` least symbols in text order."""
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * MIX)
    # symbols are spread already: a product by an odd number orders them anew
    hashed = (seeds[:, None] ^ found[None, :]) * (mix(seeds) | np.uint64(1))[:, None]
    k, rows, at = min(picks, len(found)), np.arange(bands), []
    for _ in range(k):
        at.append(hashed.argmin(1))
        hashed[rows, at[-1]] = np.iinfo(np.uint64).max
    out = seeds + np.uint64(k)
    for place in np.sort(np.stack(at), 0):
        out = mix((out + found[place]) * MIX)
    return out.view(np.int64)


def edits(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Words to insert, delete or replace between two texts, if they are at most ``limit``; else more than ``limit``.

    Only cells that ``limit`` edits can reach are looked at: a band round the diagonal, of which each
    column is held as the bits of its differences (Myers, Hyyro) and moves down a row with the next word.
    """
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if len(a) - m > limit:
        return limit + 1
    same = a[:m] == b
    start = m if same.all() else int(same.argmin())
    a, b = a[start:], b[start:]
    m = len(b)
    if not m:
        return len(a)
    same = a[len(a) - m :][::-1] == b[::-1]
    end = m if same.all() else int(same.argmin())
    a, b = a[: len(a) - end].tolist(), b[: m - end].tolist()
    gap = len(a) - len(b)
    half = (limit - gap) // 2
    width = gap + 2 * half + 1
    mask, last = (1 << width) - 1, 1 << (half + gap)
    held: dict[int, dict[int, int]] = {}

    def places(chunk: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for p, w in enumerate(a[chunk * CHUNK : (chunk + 1) * CHUNK]):
            out[w] = out.get(w, 0) | 1 << p
        return out

    # bit t of column j is row j - half + t; rows above the first add one for each column
    up, down, score = mask & ~((1 << half) - 1), 0, gap
    # most texts have one table, which needs no choice of tables for each word
    only = places(0) if len(a) <= CHUNK else None
    for j, w in enumerate(b):
        low, equal = j - half, 0
        if only is not None:
            if w in only:
                equal = only[w] >> low if low > 0 else only[w] << -low
        else:
            first = max(low, 0) // CHUNK
            for chunk in range(first, (low + width - 1) // CHUNK + 1):
                if chunk not in held:
                    held[chunk] = places(chunk)
                    held.pop(first - 1, None)
                bits = held[chunk].get(w)
                if bits:
                    shift = chunk * CHUNK - low
                    equal |= bits << shift if shift >= 0 else bits >> -shift
        either = (equal & mask) | down
        free = (((either & up) + up) ^ up) | either
        right, left = down | ~(free | up), free & up
        if not free & last:
            score += 1
            if score > limit:
                return score
        free >>= 1
        up, down = (left | ~(free | right)) & mask, free & right & mask
    return score


def limit_of(longer: int, least: float) -> int:
    return int((1 - least) * longer + 1e-9)


def signatures(texts: DataFrame, bands: int, picks: int, size: int) -> DataFrame:
    """_sha, _id, _len, _sigs of the rows (_sha, _id, _t)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [symbols(np.asarray(w, np.int64), size) for w in batch["_w"]]
                sigs = [order_minhash(f, bands if len(f) >= FEW else bands * 3 // 2, picks) if len(f) else None for f in found]
                yield pd.DataFrame({"_sha": batch["_sha"], "_id": batch["_id"], "_len": [len(w) for w in batch["_w"]], "_sigs": sigs})

    return texts.select("_sha", "_id", word_hashes(F.col("_t")).alias("_w")).mapInPandas(run, "_sha string, _id long, _len long, _sigs array<long>")


def parts_of(n: str, words: str, block: int, block_words: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(words) / block_words)).cast("int")


def first_meetings(buckets: DataFrame, members: DataFrame, heads: int) -> DataFrame:
    """(_task, _node): each member in one block of its bucket, and about ``heads`` of a bucket in all its blocks."""
    rows = members.join(buckets, "_sig")
    own = F.pmod(F.xxhash64("_node", F.lit(3)), F.col("_parts")).cast("int")
    head = (F.col("_parts") > 1) & (F.pmod(F.xxhash64("_node", F.lit(4)), F.ceil(F.col("_n") / heads).cast("long")) == 0)
    blocks = F.when(head, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(own))
    return rows.select("_sig", "_node", F.explode(blocks).alias("_block")).select(F.xxhash64("_sig", "_block").alias("_task"), "_node")


def meetings(rows: DataFrame, least: float, block: int, block_words: int, scratch: Scratch, most: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(_task, _node, _class) in which each two members of a group of (_group, _node, _len, _class) meet that are of different classes and of lengths that a link may join.

    A class of more than a block is cut into chunks of its own, which don't meet each other; small
    classes share chunks. Chunks go by length, and every two others of a group meet whose lengths are near enough. Groups where a
    chunk may meet more than ``most`` others, of their greatest _len, are left out and come second, as (_group).
    """
    # a quarter of the least ratio of lengths, and a little for what the logarithm is off
    step = F.floor(4 * F.log(F.greatest("_len", F.lit(1))) / float(np.log(1.001 / least))).alias("_step")
    sizes = rows.groupBy("_group", "_class").agg(F.count("*").alias("_n"), F.sum("_len").alias("_words")).withColumn("_parts", parts_of("_n", "_words", block, block_words))
    several = sizes.groupBy("_group").agg(F.count("*").alias("_classes")).filter("_classes > 1").select("_group")
    sizes = sizes.join(several, "_group").select("_group", "_class", F.when(F.col("_parts") > 1, F.col("_class")).alias("_large"))
    # read twice below
    rows = scratch.settle(rows.select("_group", "_node", "_class", "_len", step).join(sizes, ["_group", "_class"]), "grouped")
    blocks = F.greatest(F.count("*") / block, F.sum("_len") / block_words)
    steps = rows.groupBy("_group", "_large", "_step").agg(blocks.alias("_blocks"), F.max("_len").alias("_longest"))
    # a few steps of each group or class, not its members
    before = Window.partitionBy("_group", "_large").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = scratch.settle(steps.withColumn("_before", F.coalesce(F.sum("_blocks").over(before), F.lit(0.0))), "steps")
    left = None
    if most is not None:
        around = Window.partitionBy("_group").orderBy("_step").rangeBetween(-4, 4)
        near = steps.groupBy("_group", "_step").agg(F.sum("_blocks").alias("_blocks"), F.max("_longest").alias("_longest")).withColumn("_near", F.sum("_blocks").over(around))
        left = near.groupBy("_group").agg(F.max("_near").alias("_near"), F.max("_longest").alias("_longest")).filter(F.col("_near") > most).select("_group")
        left = scratch.settle(left, "left")
        steps = steps.join(left, "_group", "left_anti")
    share = F.pmod(F.xxhash64("_node", F.lit(6)), F.lit(1 << 20)) / (1 << 20)
    own = steps.select(F.col("_group").alias("_g"), F.col("_large").alias("_l"), F.col("_step").alias("_s"), "_before", "_blocks")
    rows = rows.join(own, (F.col("_group") == F.col("_g")) & F.col("_large").eqNullSafe(F.col("_l")) & (F.col("_step") == F.col("_s")))
    rows = rows.select("_group", "_node", "_class", "_large", "_step", F.xxhash64("_group", "_large", F.floor(F.col("_before") + share * F.col("_blocks"))).alias("_chunk"))
    rows = scratch.settle(rows, "dealt-groups")
    chunks = rows.groupBy("_group", "_large", "_chunk").agg(F.min("_step").alias("_from"), F.max("_step").alias("_to"))
    other = chunks.select("_group", F.col("_large").alias("_other_large"), F.col("_chunk").alias("_other"), F.col("_from").alias("_other_from"), F.col("_to").alias("_other_to"))
    apart = F.col("_large").isNull() | ~F.col("_large").eqNullSafe(F.col("_other_large"))
    near = (F.col("_from") <= F.col("_other_to") + 4) & (F.col("_other_from") <= F.col("_to") + 4)
    pairs = chunks.join(other, "_group").filter((F.col("_chunk") <= F.col("_other")) & apart & near)
    task = F.xxhash64("_group", "_chunk", "_other").alias("_task")
    ends = F.array_distinct(F.array("_chunk", "_other"))
    meets = pairs.select(task, "_group", F.explode(ends).alias("_chunk"))
    return rows.join(meets, ["_group", "_chunk"]).select("_task", "_node", "_class"), left


def later_meetings(rest: DataFrame, members: DataFrame, found: DataFrame, words: DataFrame, least: float, block: int, block_words: int, scratch: Scratch) -> DataFrame:
    """(_node, _class, _tasks, _with): members of the buckets ``rest`` that are of different classes so far.

    Where texts of a bucket would be met by many chunks they meet by rare words instead (see ``word_tasks``), so that a text's meetings
    have a bound that doesn't grow with the bucket. Of those, _with has the buckets, one of which two texts must share.
    """
    rows = members.join(rest.select("_sig"), "_sig").join(found, F.col("_node") == F.col("node"), "left")
    rows = scratch.settle(rows.select(F.col("_sig").alias("_group"), "_node", "_len", F.coalesce("root", "_node").alias("_class")), "other-buckets")
    # a text has as many rare words as a link may have edits, and one more; few of them are another class's
    tasks, wide = meetings(rows, least, block, block_words, scratch, most=F.greatest(F.lit(3.0), (1 - least) * F.col("_longest") / 4))
    out = gathered(tasks).withColumn("_with", F.lit(None).cast("array<long>"))
    if wide.isEmpty():
        return out
    nodes = rows.join(wide, "_group").groupBy("_node", "_class").agg(F.collect_set("_group").alias("_with"))
    nodes = scratch.settle(words.select("_node", "_data").join(nodes, "_node"), "wide-nodes")
    by_word = gathered(word_tasks(nodes, least, block, block_words, scratch))
    return out.unionByName(by_word.join(nodes.select("_node", "_with"), "_node"))


def word_tasks(nodes: DataFrame, least: float, block: int, block_words: int, scratch: Scratch, sample: int = 20_000, listed: int = 4096) -> DataFrame:
    """(_task, _node, _class) in which each two nodes of (_node, _class, _data) that may be linked meet.

    Two texts that a link may join have all words in common but as many as it may have edits. So of the words of each in one order
    for all, occurrences counted, the first ones, one more than such edits, have one in common. Any order will do; the most frequent words come last, so that few texts share
    one of their first. Those are told from a sample, which bears on the time only.
    """

    def occurring(data: bytes) -> np.ndarray:
        with np.errstate(over="ignore"):
            return symbols(unpacked(data), 1).view(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, n = np.unique(np.concatenate([np.empty(0, np.int64), *map(occurring, batch["_data"])]), return_counts=True)
            yield pd.DataFrame({"_group": found, "_n": n})

    every = max(1, nodes.count() // sample)
    some = nodes.filter(F.pmod(F.xxhash64("_node", F.lit(8)), F.lit(every)) == 0).select("_data")
    top = some.mapInPandas(count, "_group long, _n long").groupBy("_group").agg(F.sum("_n").alias("_n")).filter("_n > 1").orderBy(F.desc("_n"), "_group").limit(listed).collect()
    frequent = np.array(sorted(r["_group"] for r in top), np.int64)
    counts = np.array([r["_n"] for r in sorted(top, key=lambda r: r["_group"])], np.int64)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, own, data in zip(batch["_node"], batch["_class"], batch["_data"], strict=True):
                found = occurring(data)
                often = np.zeros(len(found), np.int64)
                if len(frequent):
                    at = np.searchsorted(frequent, found).clip(max=len(frequent) - 1)
                    often = np.where(frequent[at] == found, counts[at], 0)
                picked = found[np.lexsort((found, often))[: limit_of(len(found), least) + 1]]
                yield pd.DataFrame({"_group": picked, "_node": node, "_class": own, "_len": len(found)})

    rows = scratch.settle(nodes.mapInPandas(first, "_group long, _node long, _class long, _len long"), "rare-words")
    groups = rows.groupBy("_group").agg(F.count("*").alias("_n"), F.min("_class").alias("_a"), F.max("_class").alias("_b"), F.bit_xor(F.xxhash64("_node", F.lit(1))).alias("_x"), F.bit_xor(F.xxhash64("_node", F.lit(2))).alias("_y")).filter("_a < _b")
    # of words with the same texts one is enough
    groups = groups.groupBy("_n", "_x", "_y").agg(F.min("_group").alias("_group")).select("_group")
    return meetings(scratch.settle(rows.join(groups, "_group"), "shared-words"), least, block, block_words, scratch)[0]


def shared_words(texts: list[np.ndarray]) -> np.ndarray:
    """For each two texts a number of words that both have, occurrences counted: as many as that or fewer.

    Words go to bins; the lesser count of two texts' bins is how many of the levels 1, 2, ... both reach, which is a
    product of matrices for each level.
    """
    bins = min(BINS, 1 << int(np.ceil(np.log2(4 * max(1, max(map(len, texts)))))))
    with np.errstate(over="ignore"):
        # the k-th occurrence of a word is another symbol than the first, so that few bins hold many
        counts = np.stack([np.bincount((symbols(t, 1) % np.uint64(bins)).astype(np.int64), minlength=bins) for t in texts])
    out, level = np.zeros((len(texts), len(texts)), np.float32), 1
    while (columns := (counts >= level).any(0)).any():
        reached = (counts[:, columns] >= level).astype(np.float32)
        out += reached @ reached.T
        counts, level = counts[:, columns], level + 1
    return out


class Leaders:
    """Tells texts apart by the triangle inequality: a text that is far from one member of a class is far from those close to that one.

    Of a class with several texts in a task the first is the leader; edits to it are counted once for each text that asks.
    """

    def __init__(self, texts: list[np.ndarray], label: np.ndarray, least: float, few: int = 8):
        self.texts, self.least, self.known = texts, least, {}
        numbers, first, counts = np.unique(label, return_index=True, return_counts=True)
        leader = {int(k): int(i) for k, i, n in zip(numbers, first, counts, strict=True) if n >= few}
        self.leader = [leader.get(int(k)) for k in label]

    def distance(self, i: int, leader: int) -> int:
        """The edits between a text and a leader, or a number that is no more than these where they are over twice the limit."""
        if (i, leader) not in self.known:
            most = 2 * limit_of(max(len(self.texts[i]), len(self.texts[leader])), self.least)
            self.known[i, leader] = min(most + 1, edits(self.texts[i], self.texts[leader], most)) if i != leader else 0
        return self.known[i, leader]

    def close(self, i: int) -> int | None:
        """The edits between a text and its own leader, if that is known for sure."""
        leader = self.leader[i]
        found = self.distance(i, leader)
        return found if found <= 2 * limit_of(max(len(self.texts[i]), len(self.texts[leader])), self.least) else None

    def apart(self, i: int, j: int, limit: int) -> bool:
        """Whether more than ``limit`` edits are sure without comparing the two."""
        a, b = self.leader[i], self.leader[j]
        near = [None if k is None else self.close(x) for x, k in ((i, a), (j, b))]
        if None not in near and self.distance(a, b) - near[0] - near[1] > limit:
            return True
        return near[1] is not None and j != b and self.distance(i, b) - near[1] > limit or near[0] is not None and i != a and self.distance(j, a) - near[0] > limit


def sharing(sets: list[np.ndarray]) -> np.ndarray:
    """Which two of the sets have a member in common."""
    members, at = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((len(sets), len(members)), np.float32)
    held[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), at] = 1
    return held @ held.T > 0


def block_links(nodes: list[int], texts: list[np.ndarray], classes: list[int], least: float, buckets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join the texts of a task into classes; texts of one class aren't compared. All other pairs are, or those that share one of their ``buckets``."""
    n = len(nodes)
    if n == 2 and (buckets is None or sharing(buckets)[0, 1]):
        limit = limit_of(max(map(len, texts)), least)
        return [(nodes[0], nodes[1])] if classes[0] != classes[1] and edits(texts[0], texts[1], limit) <= limit else []
    sizes, label, out = np.array([len(t) for t in texts]), np.unique(classes, return_inverse=True)[1], []
    if n < 2 or not label.max():
        return out
    leaders = Leaders(texts, label, least)
    # an edit takes away one word of a text and adds one at most
    alike = shared_words(texts) >= least * np.maximum(sizes[:, None], sizes[None, :]) - 1e-6
    if buckets is not None:
        alike &= sharing(buckets)
    for i in range(n - 1):
        for j in (i + 1 + np.flatnonzero(alike[i, i + 1 :] & (label[i + 1 :] != label[i]))).tolist():
            if label[i] != label[j]:
                limit = limit_of(max(sizes[i], sizes[j]), least)
                if not leaders.apart(i, j, limit) and edits(texts[i], texts[j], limit) <= limit:
                    out.append((nodes[i], nodes[j]))
                    label[label == label[j]] = label[i]
    return out


def ties(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each member of a class that the pairs make, but for its least, with that one before it."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return [(top(x), x) for x in above if top(x) != x]


def gathered(tasks: DataFrame) -> DataFrame:
    """_node, _class and the _tasks of each node."""
    return tasks.groupBy("_node", "_class").agg(F.collect_list("_task").alias("_tasks"))


def packed(words: np.ndarray) -> bytes:
    """48 bits of each word's hash: of texts of 20,000 different words one pair in 700,000 mistakes a word for another."""
    return words.astype("<i8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<i8")[:, 0]


def candidates(own: DataFrame, named: DataFrame) -> DataFrame:
    """_node, _class, _tasks and the words' hashes _data of the rows (_node, _class, _tasks, _sha, _id) of ``own``, with the texts of ``named``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [packed(np.asarray(w, np.int64)) for w in batch["_w"]]
            yield pd.DataFrame({"_node": batch["_node"], "_class": batch["_class"], "_data": data, "_tasks": batch["_tasks"]})

    mine = named.join(own, ["_sha", "_id"]).select("_node", "_class", word_hashes(F.col("_t")).alias("_w"), "_tasks")
    return mine.mapInPandas(pack, "_node long, _class long, _data binary, _tasks array<long>")


def links(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b: ties of classes that links join, between the rows (_node, _class, _data, _tasks, _with) that share a task, and one of _with if that isn't null.

    A task ties all classes that it joins to the least of these. A tie may come from several tasks.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, nodes, held, classes, buckets, out = None, [], [], [], [], []

        def done():
            # of a task's rows all have buckets or none
            sets = buckets if buckets and buckets[0] is not None else None
            of = dict(zip(nodes, classes, strict=True))
            out.extend(ties([(of[a], of[b]) for a, b in block_links(nodes, held, classes, least, sets)]))

        for batch in batches:
            for t, node, data, own, among in zip(batch["_task"], batch["_node"], batch["_data"], batch["_class"], batch["_with"], strict=True):
                if t != task:
                    done()
                    task, nodes, held, classes, buckets = t, [], [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(int(node))
                    held.append(unpacked(data))
                    classes.append(int(own))
                    buckets.append(among)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out.clear()
        done()
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = rows.select("_node", "_class", "_data", "_with", F.explode("_tasks").alias("_task"))
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "_task").sortWithinPartitions("_task", "_node")
    return dealt.mapInPandas(meet, "a long, b long")


def classes(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes with a link; the root is the least node of its class.

    Alternates small stars and large stars: each node's smaller, then larger neighbours are tied to
    its least one, until each is tied to its root, which takes a logarithmic number of rounds. Small stars come first, as
    stars that have members in common then are one after a round. Edges may repeat.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = both.join(least, "u")
        if large:
            tied = tied.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            tied = tied.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        # what comes twice goes once, after both stars
        return tied.filter("a <> b").distinct() if large else tied.filter("a <> b")

    def told(e: DataFrame) -> bool:
        """Whether each node has one other that it is tied to, which is tied to none itself."""
        ends = e.select(F.col("b").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("a").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").count() == 0

    while True:
        edges = scratch.settle(star(star(edges, False), True), "stars")
        if told(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bands: int = 72, picks: int = 2, first: int = 8, block: int = 512, block_words: int = 500_000, heads: int = 32) -> DataFrame:
    """doc_id, class_id, kept, text_sha256 of every row: classes of identical and near-duplicate texts.

    Two candidates are linked if at most 1 - ``similarity`` of the longer one's words need to be inserted,
    deleted or replaced to make one text of the other. Words are parted by white space and lowered. The
    class id is the least doc_id of the class, whose row is ``kept``. Texts that share a part j of all their
    shingles share a band's sample with a chance of about j to the power of ``picks``. Edits that lie scattered leave the least: of texts
    at a similarity of 0.8, 0.85 or 0.9 they leave a j of 0.20, 0.29 or 0.42, of which 72 bands of 2 find about 93, 99.7 and all but one in a million
    of 100 pairs. The buckets of ``first`` bands meet first, then those of twice as many, then all others.

    A null text counts as empty; empty texts are identical to each other and near to nothing else.
    Texts under ``size`` words are near only if they have the same words. A null id is no member of a
    class: its class_id is null and it is kept. Rows that repeat an id have the class of their own text
    each. No rows in, no rows out; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    named = base.filter("_id is not null").withColumn("_sha", F.sha2(F.col("_t").cast("binary"), 256))
    rows = scratch.settle(signatures(named, bands, picks, size), "signatures")
    # a node for each text, by its least id; copies are combined before the shuffle, and numbered as the table is written
    nodes = scratch.settle(rows.groupBy("_sha").agg(F.min("_id").alias("_id")).withColumn("_node", F.monotonically_increasing_id()), "nodes")
    own = rows.join(nodes, ["_sha", "_id"]).dropDuplicates(["_sha", "_id"])
    own = scratch.settle(own.select("_node", "_len", "_sigs"), "samples")
    members = own.select("_node", "_len", F.posexplode("_sigs").alias("_band", "_sig")).select("_sig", "_node", "_len", F.when(F.col("_band") < first, 0).when(F.col("_band") < 3 * first, 1).otherwise(2).alias("_round"))
    # most samples are one text's only; they go before anything else is asked of them
    shared = members.groupBy("_sig").agg(F.count("*").alias("_n")).filter("_n > 1").select("_sig")
    members = scratch.settle(members.join(shared, "_sig"), "shared")

    def told(rows: DataFrame) -> DataFrame:
        """Buckets (_sig, _n, _words, _parts). Of those with the same members one is enough."""
        own = rows.groupBy("_sig").agg(F.count("*").alias("_n"), F.sum("_len").alias("_words"), F.bit_xor(F.xxhash64("_node", F.lit(1))).alias("_x"), F.bit_xor(F.xxhash64("_node", F.lit(2))).alias("_y"))
        own = own.groupBy("_n", "_x", "_y").agg(F.min(F.struct("_sig", "_words")).alias("_b")).select("_b._sig", "_b._words", "_n")
        return own.withColumn("_parts", parts_of("_n", "_words", block, block_words))

    early = members.filter("_round = 0")
    buckets = scratch.settle(told(early), "buckets")
    tasks = gathered(first_meetings(buckets, early, heads).withColumn("_class", F.col("_node")))
    # texts are shuffled once: later meetings take the words of candidates from this table
    asked = members.select("_node").distinct().join(tasks, "_node", "left").join(nodes, "_node").withColumn("_class", F.col("_node"))
    words = scratch.settle(candidates(scratch.settle(asked, "tasks"), named), "candidates")
    roots = classes(scratch.settle(links(words.withColumn("_with", F.lit(None).cast("array<long>")), similarity), "links"), scratch)
    for k in (1, 2):
        # what one round ties, the next needn't look at
        rest = told(members.filter(f"_round = {k}")).select("_sig")
        rest = rest.unionByName(buckets.filter("_parts > 1").select("_sig")) if k == 1 else rest
        own = scratch.settle(later_meetings(rest, members, roots, words, similarity, block, block_words, scratch), "later-tasks")
        if not own.isEmpty():
            found = scratch.settle(links(words.select("_node", "_data").join(own, "_node"), similarity), "later-links")
            if found.isEmpty():
                continue
            # a class so far is its members' ties to its root
            roots = classes(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found), scratch)
    of_text = nodes.join(roots, F.col("_node") == F.col("node"), "left").select("_sha", "_id", F.coalesce("root", "_node").alias("_root"))
    least = of_text.groupBy("_root").agg(F.min("_id").alias("class_id"))
    of_text = of_text.join(least, "_root").select("_sha", "class_id")
    out = rows.select(F.col("_id").alias(id_col), "_sha").join(of_text, "_sha").select(id_col, "class_id", (F.col(id_col) == F.col("class_id")).alias("kept"), F.col("_sha").alias("text_sha256"))
    unnamed = base.filter("_id is null").select(F.col("_id").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"), F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"))
    return scratch.keep(out.unionByName(unnamed), "near-duplicates")
