"""Mixing sources to target weights over a domain-language-source tree.

A budget of tokens is parted top down by weight. A node takes no more than its documents can give
in ``max_epochs`` passes; what it can't take goes to its siblings by weight, and only what a whole
subtree can't take passes on to its parent's siblings. That is filling siblings to a common level
per weight, which sorted capacities solve in closed form, so it is a window over siblings.

A leaf with a budget of f passes and a rest takes all its documents f times, and of the next epoch the
prefix that fits the rest, in an order seeded by epoch. The prefix is found without gathering a
leaf: a histogram of the order's keys gives the bucket where it ends, and only that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch

LEVELS = ("_m_domain", "_m_lang", "_m_source")
#: Leaves up to which their table goes to all executors (a few hundred bytes each); beyond, it is joined.
BROADCAST_LEAVES = 50_000


def tokens_of(text: Column) -> Column:
    """About the tokens of a text: a quarter of its code points, rounded up."""
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(1).cast("long"))


def fill(nodes: DataFrame, parents: list[str], name: str, budget: str) -> DataFrame:
    """``_share`` of each node (name, _cap, _w) of its parent's ``budget``: siblings filled to a common level per weight."""
    ratio = F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w"))
    ranked = Window.partitionBy(*parents).orderBy(ratio.asc_nulls_last(), F.col(name))
    family = Window.partitionBy(*parents)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_ws", F.sum("_w").over(family) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    out = out.withColumn("_full", (F.col("_w") > 0) & (F.col("_cap") * F.col("_ws") <= (F.col(budget) - F.col("_caps")) * F.col("_w")))
    out = out.withColumn("_left", F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(family), F.lit(0)))
    out = out.withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(family), F.lit(0)))
    share = F.when(F.col("_full"), F.col("_cap")).when(F.col("_open") == 0, 0).otherwise(F.floor(F.try_divide(F.col("_left") * F.col("_w") - (F.col("_left") * F.col("_w")) % F.greatest(F.col("_open"), F.lit(1)), F.greatest(F.col("_open"), F.lit(1)))).cast("long"))
    return out.withColumn("_share", share).drop("_caps", "_ws", "_full", "_left", "_open")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], fraction: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, _tokens, _share) of leaves (domain, lang, source, _tokens)."""
    domain, lang, source = LEVELS
    capped = leaves.withColumn("_cap", F.col("_tokens") * max_epochs)
    total = leaves.agg(F.floor(F.sum("_tokens") * F.lit(fraction)).cast("long").alias("_b0"))
    ask = [weights.get(k, {}) for k in ("domain", "lang", "source")]
    top = capped.groupBy(domain).agg(F.sum("_cap").alias("_cap")).join(F.broadcast(total)).withColumn("_root", F.lit(0)).withColumn("_w", weight_of(F.col(domain), ask[0]))
    top = fill(top, ["_root"], domain, "_b0").select(domain, F.col("_share").alias("_b1"))
    mid = capped.groupBy(domain, lang).agg(F.sum("_cap").alias("_cap")).join(top, domain).withColumn("_w", weight_of(F.col(lang), ask[1]))
    mid = fill(mid, [domain], lang, "_b1").select(domain, lang, F.col("_share").alias("_b2"))
    low = capped.join(mid, [domain, lang]).withColumn("_w", weight_of(F.col(source), ask[2]))
    return fill(low, [domain, lang], source, "_b2").select(*LEVELS, "_tokens", "_share")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], *, fraction: float = 0.6, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each epoch that takes them, with columns mix_domain,
    mix_lang, mix_source, mix_tokens and mix_epoch added.

    ``levels`` gives the columns for domain, lang and source; a null is "unknown". ``weights`` gives
    whole weights by level and name, 1 for others; a weight of 0 takes nothing. The budget is ``fraction``
    of all tokens; rounding down loses less than a token for each node. A null text has no tokens and
    comes along where its place in the order is within the prefix. Rows that repeat an id go together.
    No rows in, no rows out. ``tokens`` gives the tokens of a row, by default a quarter of its code points; null is none. A column of the caller's that has
    the name of an added one gives way to it; all others may have any name. The result reads tables of ``scratch``; the caller drops them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    settle = scratch.settle
    named = {c: F.coalesce(levels[k].cast("string"), F.lit("unknown")) for c, k in zip(LEVELS, ("domain", "lang", "source"), strict=True)}
    own = {f"_own_{i}": c for i, c in enumerate(docs.columns)}
    size = tokens_of(F.col(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    tagged = docs.select(*[F.col(c).alias(k) for k, c in own.items()], *[v.alias(k) for k, v in named.items()], size.alias("_m_tokens"))
    id_col = next(k for k, c in own.items() if c == id_col)
    narrow = settle(tagged.select(F.col(id_col).alias("_m_id"), *LEVELS, "_m_tokens"), "mix-tokens")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("_m_tokens").alias("_tokens"))
    shares = settle(budgets(settle(leaves, "mix-leaves"), weights, fraction, max_epochs), "mix-shares")
    few = shares.count() <= BROADCAST_LEAVES
    passes = F.when(F.col("_tokens") > 0, F.expr("_share div _tokens")).otherwise(0).cast("int")
    shares = shares.select(*LEVELS, passes.alias("_m_passes"), (F.col("_share") - passes * F.col("_tokens")).alias("_m_rest"))
    hint = F.broadcast if few else (lambda d: d)
    keyed = narrow.join(hint(shares), list(LEVELS)).withColumn("_m_key", order_key(seed, F.col("_m_passes"), F.col("_m_id"))).withColumn("_m_bucket", F.substring("_m_key", 1, 3))
    histogram = keyed.groupBy(*LEVELS, "_m_rest", "_m_bucket").agg(F.sum("_m_tokens").alias("_n"))
    upto = Window.partitionBy(*LEVELS).orderBy("_m_bucket")
    running = histogram.withColumn("_upto", F.sum("_n").over(upto))
    # the first bucket that goes beyond the rest, and what stands before it
    ends = running.filter("_upto > _m_rest").groupBy(*LEVELS).agg(F.min(F.struct("_m_bucket", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_e")).select(*LEVELS, F.col("_e._m_bucket").alias("_m_end"), F.col("_e._before").alias("_m_before"))
    ends = settle(ends, "mix-ends")
    inside = keyed.join(hint(ends), list(LEVELS)).filter("_m_bucket = _m_end")
    within = Window.partitionBy(*LEVELS).orderBy("_m_key", "_m_id")
    cut = inside.withColumn("_at", F.col("_m_before") + F.sum("_m_tokens").over(within)).filter("_at <= _m_rest").groupBy(*LEVELS).agg(F.max(F.struct("_m_key", "_m_id")).alias("_m_cut"))
    plan = settle(shares.join(ends, list(LEVELS), "left").join(cut, list(LEVELS), "left").drop("_m_rest", "_m_before"), "mix-plan")
    chosen = tagged.join(hint(plan), list(LEVELS))
    key = order_key(seed, F.col("_m_passes"), F.col(id_col))
    bucket, end = F.substring(key, 1, 3), F.col("_m_end")
    last = end.isNull() | (bucket < end) | ((bucket == end) & F.coalesce(F.struct(key.alias("_m_key"), F.col(id_col).alias("_m_id")) <= F.col("_m_cut"), F.lit(False)))
    times = F.col("_m_passes") + last.cast("int")
    out = chosen.withColumn("_m_times", times).filter("_m_times > 0").withColumn("_m_epoch", F.explode(F.sequence(F.lit(0), F.col("_m_times") - 1)))
    added = {f"mix_{c[3:]}": c for c in (*LEVELS, "_m_tokens", "_m_epoch")}
    return out.select(*[F.col(k).alias(c) for k, c in own.items() if c not in added], *[F.col(c).alias(k) for k, c in added.items()])


def domain_of(source: Column) -> Column:
    """A domain for sources that end in a number: its remainder by four."""
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, r"([0-9]+)$", 1), F.lit("")), F.lit("9999999999")) % 4, F.lit(0)).cast("int").cast("string"))
