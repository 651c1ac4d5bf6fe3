"""Audit of how sources differ in their words: triangular divergence of the smoothed shares of terms.

Terms are counted per group, a (language, source), with a small table of counts held while documents are read.
The kept terms of a language are numbered, and a group's counts are packed into a vector for each chunk of that vocabulary.
Groups of a language are cut into blocks; a task is a block by a block and a stretch of chunks, to which the vectors of both blocks are
replicated. It goes through its chunks one after the other and adds up the submatrix of its pairs. So neither many
sources, nor a large vocabulary, nor one language that holds most rows meets in one task.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch, numbered

SCALE = 1_000_000_000
#: Bytes of a term are ASCII letters, lowered, and all bytes beyond ASCII; others part terms.
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTS = "lang binary, source binary, term binary, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_counts(docs: DataFrame, held_entries: int) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text) in bytes: occurrences, and documents that have the term. A row with a null term counts a group's documents.

    A task hands its counts on when it holds ``held_entries``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[int]] = {}

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["lang", "source", "term", "n", "docs"])
            held.clear()
            return rows

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                own: dict[bytes, int] = {}
                for t in terms(text):
                    own[t] = own.get(t, 0) + 1
                for t, n in [(None, 0), *own.items()]:
                    at = held.get((lang, source, t))
                    if at is None:
                        held[lang, source, t] = [n, 1]
                    else:
                        at[0] += n
                        at[1] += 1
                if len(held) > held_entries:
                    yield out()
        yield out()

    counted = docs.select("lang", "source", "text").mapInPandas(run, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)); the product takes more than 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0))) div cast({total} + 2 * {kept} as decimal(19,0))")


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same in a task: long division by thousands, as totals are far under 2**63 / 1000."""
    rest, out = n + 2, np.zeros(len(n), np.int64)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total + 2 * kept)
        out = out * 1000 + more
    return out + 1


def term_parts(p: str, q: str) -> Column:
    """floor((p - q) ** 2 / (p + q))."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


TILE = "lang string, a long, b long, value long"


def tile(rows: pd.DataFrame, block_size: int) -> pd.DataFrame:
    """The pairs a < b of a task's two blocks of groups, summed over its chunks; ``rows`` has a row for each group and chunk."""
    found: dict[tuple[int, int], int] = {}
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    for _, chunk in rows.groupby("chunk", sort=True):
        size = int(chunk["size"].iloc[0])
        own = chunk.sort_values("pos")
        at, dense = own["pos"].to_numpy(), np.zeros((len(own), size), np.int64)
        for k, (places, counts) in enumerate(zip(own["places"], own["counts"], strict=True)):
            if places is not None:
                dense[k, places] = counts
        p = np.stack([shares(x, int(t), int(v)) for x, t, v in zip(dense, own["total"], own["kept"], strict=True)]) if size else dense
        block = at // block_size
        for k in np.flatnonzero(block == i):
            others = np.flatnonzero((block == j) & (at > at[k]))
            gap = p[others] - p[k]
            sums = (gap * gap // (p[others] + p[k])).sum(1)
            for o, s in zip(others, sums, strict=True):
                key = (int(at[k]), int(at[o]))
                found[key] = found.get(key, 0) + int(s)
    lang = rows["lang"].iloc[0]
    return pd.DataFrame([(lang, a, b, s) for (a, b), s in found.items()], columns=["lang", "a", "b", "value"])


def pair_sums(groups: DataFrame, vectors: DataFrame, chunk: int, stretch: int, block: int) -> DataFrame:
    """(lang, a, b, value) of each two groups a < b of a language, over ``groups`` (lang, pos, n, total, kept) and ``vectors`` (lang, pos, chunk, places, counts)."""
    chunks = groups.withColumn("chunk", F.explode(F.expr(f"sequence(0L, greatest((kept - 1) div {chunk}, 0L))")))
    rows = chunks.join(vectors, ["lang", "pos", "chunk"], "left").withColumn("size", F.expr(f"cast(greatest(least({chunk}, kept - chunk * {chunk}), 0) as int)"))
    # a block meets itself and all others of its language; both ends of a task are told from one block's place
    own = F.expr(f"pos div {block}")
    rows = rows.withColumn("_own", own).withColumn("_with", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")))
    rows = rows.select("lang", F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"), F.expr(f"chunk div {stretch}").alias("stretch"), "pos", "chunk", "size", "total", "kept", "places", "counts")
    sums = rows.groupBy("lang", "i", "j", "stretch").applyInPandas(lambda task: tile(task, block), TILE)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10, chunk: int = 8192, stretch: int = 8, block: int = 16, held_entries: int = 200_000, scratch: Scratch | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the divergence from every other source of its language (part ``pair``),
    and the ``top`` terms that it has more of than its language does (part ``term``).

    A null language, source or text is the empty string. Terms are runs of ASCII letters, lowered, and of all characters beyond ASCII; a language
    keeps those in at least ``least_docs`` of its rows. The share of a kept term in a group is smoothed, see ``share``. A group without
    terms takes part; in a language without kept terms all values of pairs are 0 and no term is told. Ranks are from 1 by value, descending, then by item. Rows
    that repeat count each. Bytes that aren't UTF-8 count as characters beyond ASCII. No rows in, no rows out; other columns are ignored.
    A task has ``stretch`` chunks of ``chunk`` terms of two blocks of ``block`` groups. The result reads tables of ``scratch``; the caller drops them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    counted = term_counts(docs.select(raw(lang_col).alias("lang"), raw(source_col).alias("source"), raw(text_col).alias("text")), held_entries)
    counted = scratch.settle(counted.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs"), "counts")
    words = counted.filter("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("_docs")).filter(F.col("_docs") >= least_docs).drop("_docs")
    kept = scratch.settle(numbered(scratch.settle(kept, "kept"), ["lang"], ["term"], scratch).withColumnsRenamed({"pos": "place", "n": "kept"}), "vocabulary")
    held = scratch.settle(words.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("_total"))
    sizes = kept.groupBy("lang").agg(F.max("kept").alias("_kept"), F.sum("in_lang").alias("lang_total"))
    groups = scratch.settle(numbered(counted.filter("term is null").select("lang", "source"), ["lang"], ["source"], scratch), "groups")
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = scratch.settle(groups.select("lang", "source", "pos", "n", F.coalesce("_total", F.lit(0)).alias("total"), F.coalesce("_kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "sized-groups")
    packed = held.select("lang", "source", F.expr(f"place div {chunk}").alias("chunk"), F.struct((F.col("place") % chunk).cast("int").alias("place"), "n").alias("x"))
    # at most ``chunk`` terms
    packed = packed.groupBy("lang", "source", "chunk").agg(F.collect_list("x").alias("x"))
    vectors = packed.join(groups.select("lang", "source", "pos"), ["lang", "source"]).select("lang", "pos", "chunk", F.col("x.place").alias("places"), F.col("x.n").alias("counts"))
    pairs = scratch.settle(pair_sums(groups.drop("source", "lang_total"), vectors, chunk, stretch, block), "pairs")
    name = lambda at, as_: groups.select("lang", F.col("pos").alias(at), F.col("source").alias(as_))
    named = pairs.join(name("a", "_a"), ["lang", "a"]).join(name("b", "_b"), ["lang", "b"])
    both = F.array(F.struct(F.col("_a").alias("source"), F.col("_b").alias("item")), F.struct(F.col("_b").alias("source"), F.col("_a").alias("item")))
    pairs = named.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    own = held.filter("n > 0").drop("kept").join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", "term", share("n", "total", "kept").alias("p"), share("in_lang", "lang_total", "kept").alias("q")).filter("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), term_parts("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # the first ranks are told in each task before rows are shuffled
    own = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(own)
