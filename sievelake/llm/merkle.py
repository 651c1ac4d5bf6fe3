"""Merkle manifest of a dataset: a tree of digests for each language, and one over these, with a proof for each row.

Bottom up, every eight consecutive nodes of a level become their parent's digest; levels are tables. Top down,
each level joins its children to their parents, and a child puts its own siblings before the proof that its
parent has inherited. A row's proof is what it needs to be folded up to the root again.

No level is gathered: leaves get their places from a range partitioning by language and id, whose partitions
are counted, and a node and its siblings are one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch, numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Children of a node.
FAN = 8
PATH = "array<struct<at:int,siblings:array<binary>>>"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def leaf_of(docs: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in docs]))


def levels_up(nodes: DataFrame, most: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables (group, pos, n, hash, kids) of the levels over ``nodes`` (group, pos, n, hash), up to where every group has one node.

    ``n`` is the number of the group's nodes on that level; a group with one node goes no higher. ``most`` is the
    largest group's number of leaves.
    """
    out = [nodes]
    while most > 1:
        kids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda k: k["hash"])
        below = out[-1].filter("n > 1").groupBy("group", F.expr(f"pos div {FAN}").alias("_up")).agg(kids.alias("kids"), F.first("n").alias("_n"))
        up = below.select("group", F.col("_up").alias("pos"), F.expr(f"(_n + {FAN - 1}) div {FAN}").alias("n"), digest(F.array_join(F.transform("kids", as_hex), "")).alias("hash"), "kids")
        out.append(scratch.settle(up, f"{name}-level"))
        most = -(-most // FAN)
    return out


def tops(levels: list[DataFrame]) -> DataFrame:
    """(group, hash) of each group's last node."""
    out = levels[0].filter("n = 1").select("group", "hash")
    for level in levels[1:]:
        out = out.unionByName(level.filter("n = 1").select("group", "hash"))
    return out


def push_down(levels: list[DataFrame], above: DataFrame, carry: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The lowest level's rows (group, pos, hash, ``carry``) with their ``path`` and what ``above`` (group, path, ...) says of their group.

    A path is the list, from the bottom to the root, of the siblings at each level and the number of them that stand before.
    """
    more = [c for c in above.columns if c not in ("group", "path")]
    step = F.struct((F.col("pos") % FAN).cast("int").alias("at"), F.filter("kids", lambda x, i: i != F.col("pos") % FAN).alias("siblings"))
    down = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        keep = ["group", "pos", "hash", *(carry if k == 0 else ["kids"])]
        last = level.filter("n = 1").join(above, "group").select(*keep, "path", *more)
        if down is not None:
            up = down.select("group", F.col("pos").alias("_up"), "kids", F.col("path").alias("_path"), *more)
            own = level.filter("n > 1").select("group", "pos", "hash", *[c for c in keep if c not in ("group", "pos", "hash", "kids")], *[F.col("kids").alias("_kids")] * (k > 0), F.expr(f"pos div {FAN}").alias("_up")).join(up, ["group", "_up"])
            own = own.withColumn("path", F.concat(F.array(step), "_path")).drop("kids", "_path", "_up")
            own = own.withColumnRenamed("_kids", "kids") if k else own
            last = last.unionByName(own.select(*keep, "path", *more))
        down = last if k == 0 else scratch.settle(last, f"{name}-paths")
    return down


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (in hexadecimal digits) and its path give."""
    put = lambda acc, s: F.concat(F.array_join(F.transform(F.slice(s["siblings"], F.lit(1), s["at"]), as_hex), ""), acc, F.array_join(F.transform(F.slice(s["siblings"], s["at"] + 1, F.lit(FAN)), as_hex), ""))
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(put(acc, s).cast("binary"), 256))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, tampered_field: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root, verified of every row; digests in hexadecimal digits.

    A leaf is the digest of ``fields`` (see ``field``). Per ``group_col`` leaves ascend by id, nulls first, rows that share an id
    by their leaf. The groups' roots, ordered by group (null first, then by UTF-8 bytes), give the root in the same way.
    ``tampered`` is what ``tampered_field`` is taken to be when a row is folded up again: null leaves the row as it is. ``verified`` says
    whether the root comes out. Rows that repeat are leaves each, and alike but for their places. A lone row is
    its group's root, and a lone group's root is the root. No rows in, no rows out; other columns are ignored and may have any name.
    The result reads tables of ``scratch``; the caller drops them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    # null before all others, and apart from the empty string
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    own = leaf_of([F.col(c) for c in fields])
    other = leaf_of([tampered if c == tampered_field else F.col(c) for c in fields]) if tampered is not None else F.lit(None).cast("binary")
    changed = F.when(tampered.isNotNull(), other) if tampered is not None else other
    # the texts are read once; all that follows is digests
    rows = scratch.settle(docs.select(group.alias("group"), F.col(id_col).cast("long").alias("id"), own.alias("hash"), changed.alias("other")), "leaves")
    leaves = scratch.settle(numbered(rows, ["group"], ["id", "hash"], scratch), "level-0")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = levels_up(leaves, most, scratch, "group")
    groups = numbered(scratch.settle(tops(levels), "tops").select(F.lit(0).alias("group"), F.col("group").alias("id"), "hash"), ["group"], ["id"], scratch)
    groups = scratch.settle(groups, "groups")
    upper = levels_up(groups, groups.agg(F.max("n")).first()[0] or 0, scratch, "root")
    root = tops(upper).select("group", F.from_json(F.lit("[]"), PATH).alias("path"), F.col("hash").alias("root"))
    of_group = push_down(upper, root, ["id"], scratch, "root").select(F.col("id").alias("group"), "path", F.col("hash").alias("subroot"), "root")
    down = push_down(levels, scratch.settle(of_group, "subroots"), ["id", "other"], scratch, "group")
    out = down.select(F.col("id").alias(id_col), as_hex("hash").alias("leaf"), as_hex("subroot").alias("subroot"), as_hex("root").alias("root"), "path", folded(as_hex(F.coalesce("other", "hash")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof(path: Column) -> Column:
    """The digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.flatten(F.transform(path, lambda s: s["siblings"])), as_hex), "").cast("binary"), 256)
