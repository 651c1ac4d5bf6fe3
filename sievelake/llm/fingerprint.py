"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

With DataFrame functions only. A text is cut into pieces: paragraphs at line ends, and these at
sentence ends, as many texts are one paragraph. A piece's 64-bit digest, which tells its predecessor and how often both came before, goes to one cell in each of three tables; a cell holds the
count, the XOR of digests and the XOR of their check sums. Subtracting two sketches cancels what both
texts have; a cell that holds one digest gives it away, and taking it out of its other cells frees
more, until all differing digests are out or none is alone. If some stay in, larger tables with
other seeds are tried, until all have come out.

The fingerprint that is kept is the smallest sketch, of a fixed number of cells, and tells versions apart that differ in a
few pieces. For the likeness of any two texts the tables are sized by their numbers of pieces, as both headers give them.
``recovered`` gives the differing digests themselves.

Each document meets the next one by id in range buckets: a bucket also gets a copy of the first
document of the next bucket, so one shuffle of the texts does. All later groupings are by bucket
first, so they stay in its task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import settle, shuffle_partitions, splitters

TABLES = 3
LOWEST = -(2**63)
#: Cuts a text into pieces.
CUTS = r"\s(?<=[.!?]\s)\s*|\n+"
BLOCK = 256


def scanned(values: Column, step) -> Column:
    """Each of ``values`` (longs) as ``step`` makes it of it, the value before and how many equal ones stand directly before; in one pass."""
    none, blocks = F.from_json(F.lit("[]"), "array<bigint>"), F.from_json(F.lit("[]"), "array<array<bigint>>")
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), none.alias("block"), blocks.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(0)
        block = F.array_append(acc["block"], step(x, acc["last"], run))
        # an array is copied when it gets one more
        full = F.size(acc["block"]) >= BLOCK - 1
        return F.struct(x.alias("last"), run.alias("run"), F.when(full, none).otherwise(block).alias("block"), F.when(full, F.array_append(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(values, start, add, lambda acc: F.flatten(F.array_append(acc["out"], acc["block"])))


def pieces(text: Column) -> Column:
    """Digests of a text's pieces, all different: each is told by the piece before it too, so that order counts, and the k-th of equal ones is another than the first."""
    cut = F.transform(F.filter(F.split(text, CUTS, -1), lambda x: x != ""), lambda x: F.xxhash64(x))
    after = scanned(cut, lambda x, last, run: F.xxhash64(x, last))
    return scanned(F.sort_array(after), lambda x, last, run: F.when(run == 0, x).otherwise(F.xxhash64(x, run)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def fingerprint(digests: str, width: int = 5) -> Column:
    """The number of digests and the cells of three tables of ``width``, in hexadecimal digits: 2 of the count, 16 of the digests, 8 of the check sums."""
    return F.expr(f"""
        concat(lpad(hex(size({digests})), 8, '0'), array_join(transform(
          transform(sequence(0, {TABLES * width - 1}), c -> filter({digests}, k -> pmod(shiftright(k, cast(20 * (c div {width}) as int)), {width}) = c % {width})),
          f -> concat(lpad(hex(size(f) % 256), 2, '0'),
                      lpad(hex(aggregate(f, 0L, (a, x) -> a ^ x)), 16, '0'),
                      lpad(hex(aggregate(f, 0L, (a, x) -> a ^ (xxhash64(x, 99) & 4294967295L))), 8, '0'))), ''))""")


def place(digest: Column, table: int, seed: int, width: Column) -> Column:
    return (F.pmod(F.xxhash64(digest, F.lit(seed + table)), width) + width * table).cast("int")


def sketches(pairs: DataFrame, keys: list[str], *, factor: float, seed: int) -> DataFrame:
    """Cells (keys, _m, _cell, _c, _k, _h) of the subtracted sketches of rows (keys, _x, _y) with the digests of two texts, less the empty ones.

    ``pairs`` must be partitioned by the first of ``keys``; nothing here shuffles then.
    """
    width = (F.ceil((F.size("_x") + F.size("_y")) * F.lit(factor)) + 24).cast("int")
    signed = pairs.select(*keys, width.alias("_m"), F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("_x").alias("list")), F.struct(F.lit(-1).alias("sign"), F.col("_y").alias("list")))).alias("_s"))
    signed = signed.select(*keys, "_m", F.col("_s.sign").alias("_sign"), F.explode("_s.list").alias("_key"))
    cells = signed.select(*keys, "_m", "_sign", "_key", check(F.col("_key")).alias("_check"), F.explode(F.array(*[place(F.col("_key"), t, seed, F.col("_m")) for t in range(TABLES)])).alias("_cell"))
    return cells.groupBy(*keys, "_m", F.col("_cell").cast("long").alias("_cell")).agg(F.sum("_sign").alias("_c"), F.bit_xor("_key").alias("_k"), F.bit_xor("_check").alias("_h")).filter("_c <> 0 or _k <> 0 or _h <> 0")


def peeled(cells: DataFrame, keys: list[str], *, seed: int, rounds: int, apart: bool) -> DataFrame:
    """The cells after ``rounds`` of taking out digests that stand alone. What has come out is in cells under 0: its number in cell -1, or with ``apart`` each digest in a cell of its own with its sign."""
    for r in range(rounds):
        own = r % TABLES
        alone = (F.abs("_c") == 1) & (F.col("_cell") == place(F.col("_k"), own, seed, F.col("_m"))) & (F.col("_h") == check(F.col("_k")))
        cell = lambda at, c, k, h: F.struct(at.cast("long").alias("_cell"), c.cast("long").alias("_c"), k.alias("_k"), h.alias("_h"))
        none = F.lit(0).cast("long")
        out = [cell(F.col("_k").bitwiseOR(F.lit(LOWEST)), F.col("_c"), F.col("_k"), none) if apart else cell(F.lit(-1), F.lit(1), none, none)]
        out += [cell(place(F.col("_k"), t, seed, F.col("_m")), -F.col("_c"), F.col("_k"), F.col("_h")) for t in range(TABLES) if t != own]
        moved = F.when((F.col("_cell") >= 0) & alone, F.array(*out)).otherwise(F.array(cell(F.col("_cell"), F.col("_c"), F.col("_k"), F.col("_h"))))
        cells = cells.select(*keys, "_m", F.explode(moved).alias("_e")).select(*keys, "_m", "_e.*")
        cells = cells.groupBy(*keys, "_m", "_cell").agg(F.sum("_c").alias("_c"), F.bit_xor("_k").alias("_k"), F.bit_xor("_h").alias("_h")).filter("_c <> 0 or _k <> 0 or _h <> 0")
    return cells


def differences(pairs: DataFrame, keys: list[str], *, factor: float, seed: int, rounds: int = 9) -> DataFrame:
    """(keys, _d, _left): the number of digests that came out of the subtracted sketches, and of cells that still hold some. A row whose sketches are equal gives no row."""
    cells = peeled(sketches(pairs, keys, factor=factor, seed=seed), keys, seed=seed, rounds=rounds, apart=False)
    return cells.groupBy(*keys).agg(F.sum(F.when(F.col("_cell") < 0, F.col("_c")).otherwise(0)).alias("_d"), F.count(F.when(F.col("_cell") >= 0, 1)).alias("_left"))


def recovered(pairs: DataFrame, keys: list[str], *, factor: float = 1.0, seed: int = 1000, rounds: int = 9) -> DataFrame:
    """(keys, digest, side, whole): the digests that only one of two texts has; side is 1 for the first's, -1 for the second's.

    ``whole`` is false where some stayed in, so that these pairs should be tried with a larger factor and another seed; a
    pair of which nothing came out then has a row without digest. Texts with the same pieces give no row.
    """
    cells = peeled(sketches(pairs, keys, factor=factor, seed=seed), keys, seed=seed, rounds=rounds, apart=True)
    # the top bit is taken for the cell's sign only
    found = cells.groupBy(*keys).agg(F.collect_list(F.when(F.col("_cell") < 0, F.struct(F.col("_k").alias("digest"), F.col("_c").cast("int").alias("side")))).alias("_out"), F.max(F.col("_cell") >= 0).alias("_stuck"))
    return found.select(*keys, F.explode_outer("_out").alias("_o"), (~F.col("_stuck")).alias("whole")).select(*keys, "_o.digest", "_o.side", "whole")


def up_to(cuts: Column, k: Column) -> Column:
    """How many of ``cuts`` are at most ``k``."""
    below = F.array_position(F.sort_array(F.array_append(cuts, k)), k) - 1
    return (below + F.array_contains(cuts, k).cast("int")).cast("int")


def in_buckets(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (_k, _t) with _bucket and _copy: 0 for the row itself, 1 for its copy as the next bucket's first, 2 as the first of all, which follows the last."""
    cuts = splitters(docs.select("_k"), parts)
    least = docs.agg(F.min("_k")).first()[0]
    cuts = [c for c in cuts if c != least]
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    # constants of the plan: buckets are looked up among groups of splitters, then in one group
    grouped = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups[1:]])), "array<bigint>")
    # no lambdas here: with them Spark wouldn't see that both uses of the dealt rows can share one shuffle
    rows = docs.withColumn("_g", up_to(heads, F.col("_k")))
    group = F.element_at(grouped, F.col("_g") + 1)
    rows = rows.withColumn("_b", F.col("_g") * step + up_to(group, F.col("_k"))).withColumn("_head", F.array_contains(group, F.col("_k")))
    to = lambda bucket, copy: F.struct(bucket.cast("int").alias("_bucket"), F.lit(copy).alias("_copy"))
    copies = F.array_compact(F.array(to(F.col("_b"), 0), F.when(F.col("_head"), to(F.col("_b") - 1, 1)), F.when(F.col("_k") == F.lit(least), to(F.lit(len(cuts)), 2))))
    # a join that keeps one side infers this for the other only, and their shuffles would differ
    return rows.select("_k", "_t", F.explode(copies).alias("_to")).select("_k", "_t", "_to.*").filter("_bucket is not null")


def with_next(base: DataFrame, parts: int) -> DataFrame:
    """Rows (_k, _t) with _bucket, _row, their digests _a and the next row's _next, _next_k, _next_h and digests _n, partitioned by _bucket."""
    dealt = in_buckets(base, parts).repartition(parts, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_copy", "_k", "_h")
    # a copy of the next bucket's first row stands behind the rows of its own, the first of all behind that
    lead = lambda c: F.lead(c).over(order).alias(f"_next{c.removeprefix('_t')}")
    told = dealt.withColumns({"_h": F.xxhash64("_t"), "_a": pieces(F.col("_t"))})
    return told.select("_bucket", "_copy", "_k", "_h", "_t", "_a", F.row_number().over(order).alias("_row"), lead("_t"), lead("_k"), lead("_h"), F.lead("_a").over(order).alias("_n")).filter("_copy = 0").drop("_copy")


def with_edited(rows: DataFrame) -> DataFrame:
    """_edited and its digests _e, for rows with the text _t and the _next one."""
    half = F.floor(F.length("_t") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substr("_t", F.lit(1), F.length("_t") - half), F.substr("_next", F.lit(1), half)))
    return rows.withColumn("_e", pieces(F.col("_edited")))


KEYS = ["_bucket", "_row", "_which"]


def as_pairs(rows: DataFrame, *more: str) -> DataFrame:
    """A row with the digests _x, _y of each pair: 0 of a text and its edited one, 1 of a text and the next."""
    pair = lambda which, y: F.struct(F.lit(which).alias("_which"), F.col("_a").alias("_x"), F.col(y).alias("_y"))
    return rows.select("_bucket", "_row", *more, F.explode(F.array(pair(0, "_e"), pair(1, "_n"))).alias("_p")).select("_bucket", "_row", *more, "_p.*")


def retry(base: DataFrame, stuck: DataFrame, parts: int, attempts: int) -> DataFrame:
    """(keys, _d) of stuck pairs (keys, _k, _h, _next_k, _next_h), in tables that double until every digest comes out."""
    solved, attempt = None, 0
    while not stuck.isEmpty():
        attempt += 1
        if attempt > attempts:
            raise RuntimeError(f"sketches don't come apart after {attempts} attempts")
        ids = stuck.select("_k", "_h").union(stuck.select("_next_k", "_next_h")).distinct()
        texts = settle(base.withColumn("_h", F.xxhash64("_t")).join(ids, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).withColumn("_a", pieces(F.col("_t"))), "stuck-texts")
        after = texts.select(F.col("_k").alias("_next_k"), F.col("_h").alias("_next_h"), F.col("_t").alias("_next"), F.col("_a").alias("_n"))
        rows = with_edited(stuck.join(texts, ["_k", "_h"]).join(after, ["_next_k", "_next_h"]))
        pairs = as_pairs(rows.withColumnRenamed("_which", "_asked"), "_asked").filter("_which = _asked").drop("_asked")
        found = differences(settle(pairs, "stuck-digests").repartition(parts, "_bucket"), KEYS, factor=2.0**attempt, seed=1000 * (attempt + 1))
        found = settle(stuck.join(found, KEYS, "left").withColumn("_d", F.when(F.coalesce("_left", F.lit(0)) == 0, F.coalesce("_d", F.lit(0)))).drop("_left"), "stuck-pairs")
        done = found.filter("_d is not null").select(*KEYS, "_d")
        solved = done if solved is None else solved.unionByName(done)
        stuck = found.filter("_d is null").drop("_d")
    return solved if solved is not None else stuck.select(*KEYS, F.lit(0).cast("long").alias("_d"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_factor: int = 8, factor: float = 1.0, attempts: int = 12) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last half of the code points (rounded down) replaced by as many from the
    start of the next document by id, or all it has; the last document is followed by the first. Likeness is the share
    of both texts' pieces, each with the one before it, that the other has too, 1 for two texts without pieces. A null text
    is empty. Null ids come before all others. Rows that share an id follow each other by hash of the
    text; a single row follows itself. No rows in, no rows out; other columns are ignored.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_k"), F.coalesce(text_col, F.lit("")).alias("_t"))
    parts = bucket_factor * shuffle_partitions(docs.sparkSession)
    rows = with_edited(with_next(base, parts))
    first = differences(as_pairs(rows), KEYS, factor=factor, seed=1000)
    near = first.groupBy("_bucket", "_row").agg(*[F.max(F.when(F.col("_which") == w, F.when(F.col("_left") == 0, F.col("_d")).otherwise(-1))).alias(f"_d{w}") for w in (0, 1)])
    meta = rows.select(
        "_bucket",
        "_row",
        "_k",
        "_h",
        "_next_k",
        "_next_h",
        F.length("_t").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("_a").alias("fingerprint"),
        fingerprint("_e").alias("edited_fingerprint"),
        (F.size("_a") + F.size("_e")).alias("_s0"),
        (F.size("_a") + F.size("_n")).alias("_s1"),
    )
    found = settle(meta.join(near, ["_bucket", "_row"], "left"), "fingerprints")
    asked = F.explode(F.array_compact(F.array(F.when(F.col("_d0") == -1, 0), F.when(F.col("_d1") == -1, 1)))).alias("_which")
    stuck = settle(found.filter("_d0 = -1 or _d1 = -1").select("_bucket", "_row", asked, "_k", "_h", "_next_k", "_next_h"), "stuck")
    later = retry(base, stuck, parts, attempts).groupBy("_bucket", "_row").agg(*[F.max(F.when(F.col("_which") == w, F.col("_d"))).alias(f"_l{w}") for w in (0, 1)])
    out = found.join(later, ["_bucket", "_row"], "left")

    def likeness(w: int) -> Column:
        d = F.coalesce(F.when(F.col(f"_d{w}") >= 0, F.col(f"_d{w}")), F.col(f"_l{w}"), F.lit(0))
        return F.when(F.col(f"_s{w}") == 0, 1.0).otherwise((F.col(f"_s{w}") - d) / F.col(f"_s{w}"))

    return out.select(F.when(F.col("_k") != LOWEST, F.col("_k")).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(0).alias("near_edited"), likeness(1).alias("near_next"))
