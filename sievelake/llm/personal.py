"""Personal data in texts: addresses of mail and machines, card and telephone numbers, with DataFrame functions only.

Strict patterns and checks give the base spans, which always stay. Beside them wide generators propose spans in other spellings
("name (at) host dot org", "10[.]0[.]0[.]1", cards with dots, numbers without a plus); these overlap each other and much that is harmless.
Boosted trees over a span's format and context decide on them. They learn from the corpus itself: base spans are
known to be personal data; spans that fail their kind's check, that are dates, or that lie on a base span of another kind are known
not to be. Format features are taken from a canonical spelling, so that what is learnt of base spans carries over to others. Every known span
is counted by its features; at most ``sample`` of these rows go to the driver, where the trees grow. Thresholds
for each kind are the lowest that keep precision on all known spans of the documents that the trees haven't seen. The trees score as an expression.

Texts are read once; what follows moves spans only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch
from sievelake.llm.urlfilter import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
# Patterns are possessive and start only where a run of their characters does, so that long runs cost no more than their length.
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|(?<=0))"
BASE = {
    # a match may start within a run where the one before has ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){15})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
GATES = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
_AT = r"(?:@|\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?i:dot|\.)\x20?[\])}]\x20?|\x20(?i:dot)\x20)"
_STOP = r"(?:\.|\x20?[\[({](?i:dot|\.)[\])}]\x20?)"
_RUN = r"[\x20._/\x{A0}-]"
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": rf"(?<![0-9A-Za-z:])(?:[0-9]{{1,3}}(?:{_STOP}[0-9]{{1,3}}){{3}}|(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}+[0-9A-Fa-f]{{1,4}})(?![0-9A-Za-z:])",
    "card": rf"(?<![0-9])(?=[0-9](?:{_RUN}{{0,3}}[0-9]){{12}})[0-9]++(?:{_RUN}{{1,3}}+[0-9]++)*+",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20./()-]{1,2}[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
}
WIDE_GATES = {
    "email": r"@|(?i:[\[({]\x20?at\x20?[\])}]|\x20at\x20[A-Za-z0-9-]{1,63}+\x20?[\[({]?(?:dot|\.)\b)",
    "ip": r"[0-9](?:\.|\[\.\]|\(\.\)|[\[(](?i:dot)[\])])[0-9]|[0-9A-Fa-f]?:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]",
    "card": rf"[0-9](?:{_RUN}{{0,3}}[0-9]){{12}}",
    "phone": r"[0-9][)]?[\x20./()-]{1,2}[0-9]{2}",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|schreiben|kontakt)",
    "ip": r"(?i)\b(?:ip|ipv[46]|address|host|server|adresse|direcci[oó]n|client|login)",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment|pan)",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|handy|t[eé]l[eé]phone|tel[eé]fono|ruf|appel|llam)",
}
#: What numbers are that aren't personal.
NOT_PERSONAL = r"(?i)\b(?:version|ver|release|section|figure|fig|table|chapter|page|isbn|issn|doi|order|invoice|serial|id|hash|token|key|commit|build|rev)\b[\s:.#=]*$|v$|[=\"#$]\s?$"
_DATE = r"^(?:(?:19|20)[0-9]{2}[\x20./-][0-9]{1,2}[\x20./-][0-9]{1,2}|[0-9]{1,2}[\x20./-][0-9]{1,2}[\x20./-](?:19|20)[0-9]{2})$"
FEATURES = ("kind", "valid", "chars", "digits", "letters", "groups", "longest", "shortest", "marks", "variety", "zero", "cue", "other", "glued", "closed", "last")
FOUND = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
CONTEXT = 40
BLOCK = 256
#: Of a log odds, in which spans are counted for the thresholds.
CELLS = 1024
#: A threshold that no score reaches.
NEVER = 1e300


def located(text: Column, pattern: str) -> Column:
    """All matches with their places in code points and what stands around them: the pieces between matches give both."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("b"), F.slice(pieces, F.lit(2), F.size(found)).alias("a"))
    none = F.from_json(F.lit("[]"), FOUND)
    # spans go to blocks first: an array is copied when it gets one more
    start = F.struct(F.lit(0).alias("at"), none.alias("block"), F.from_json(F.lit("[]"), f"array<{FOUND}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["b"])
        end = at + F.length(x["m"])
        one = F.struct(at.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["b"], F.lit(CONTEXT)).alias("before"), F.left(x["a"], F.lit(CONTEXT)).alias("after"))
        block = F.array_append(acc["block"], one)
        full = F.size(acc["block"]) >= BLOCK - 1
        return F.struct(end.alias("at"), F.when(full, none).otherwise(block).alias("block"), F.when(full, F.array_append(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, add, lambda acc: F.flatten(F.array_append(acc["out"], acc["block"])))


def gated(text: Column, gate: str, pattern: str) -> Column:
    return F.when(F.rlike(text, F.lit(gate)), located(text, pattern)).otherwise(F.from_json(F.lit("[]"), FOUND))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    n = F.length(digits(m))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", digits(m))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def canonical(kind: str, m: Column) -> Column:
    """One spelling for all of a kind's, as far as the features go."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(m, _AT, "@"), _DOT, ".")
    if kind == "ip":
        return F.regexp_replace(m, _STOP, ".")
    return F.regexp_replace(m, rf"^(?:\+|00)|{_RUN}+", " ") if kind == "card" else F.trim(F.regexp_replace(F.regexp_replace(m, r"^(?:\+|00)", ""), r"[\x20./()-]+", " "))


def candidate(kind: str, base: bool, x: Column) -> Column:
    """A span with what is known of it (1, 0, or -1 for nothing) and its features."""
    k = KINDS.index(kind)
    m = canonical(kind, x["m"])
    own = digits(m)
    sizes = F.transform(F.split(m, "[^0-9A-Za-z]+"), F.length)
    valid = {
        "email": F.rlike(m, F.lit(r"\.[A-Za-z]{2,}$")),
        "ip": F.rlike(m, F.lit(rf"^(?:{_PART}(?:\.{_PART}){{3}}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|.*::.*[A-Fa-f0-9]{{2,}})$")),
        "card": F.length(own).between(13, 19) & F.call_function("luhn_check", own),
        "phone": F.length(own).between(8, 15) & ~F.rlike(x["m"], F.lit(_DATE)),
    }[kind]
    flag = lambda c: c.cast("int")
    values = {
        "valid": flag(valid),
        "chars": F.length(m),
        "digits": F.length(own),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "groups": F.size(sizes),
        "longest": F.array_max(sizes),
        "shortest": F.array_min(sizes),
        "marks": F.size(F.array_distinct(F.split(F.regexp_replace(m, "[0-9A-Za-z]", ""), ""))),
        "variety": F.size(F.array_distinct(F.split(own, ""))),
        "zero": flag(F.startswith(own, F.lit("0"))),
        "cue": flag(F.rlike(x["before"], F.lit(CUES[kind])) | F.rlike(x["after"], F.lit(CUES[kind]))),
        "other": flag(F.rlike(x["before"], F.lit(NOT_PERSONAL))),
        "glued": flag(F.rlike(x["before"], F.lit(r"[0-9A-Za-z_]$"))),
        "closed": flag(F.rlike(x["after"], F.lit("^[0-9A-Za-z_]"))),
        "last": F.element_at(sizes, -1),
    }
    known = F.lit(1) if base else F.when(valid, -1).otherwise(0)
    return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), known.alias("known"), *[F.coalesce(v, F.lit(0)).cast("int").alias(f) for f, v in values.items()])


def proposed(text: Column) -> tuple[Column, Column]:
    """Base spans, and those of the generators."""
    of = lambda kind, base, found: F.transform(found, lambda x: candidate(kind, base, x))
    strict = lambda kind: F.filter(gated(text, GATES[kind], BASE[kind]), lambda x: passes(kind, x["m"]))
    base = [of(k, True, strict(k)) for k in KINDS]
    wide = [of(k, False, gated(text, WIDE_GATES[k], WIDE[k])) for k in KINDS]
    return F.concat(*base), F.concat(*wide)


def told(found: DataFrame) -> DataFrame:
    """(row, held, x) of all spans, less the generators' that overlap a base span of their kind. Those that overlap another kind's are known to be none."""
    spans = found.select("row", "held", F.explode(F.concat("base", "wide")).alias("x"))
    order = [F.col(f"x.{f}") for f in ("start", "end", "kind", "base")]
    up = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    strict = lambda k, c: F.when(F.col("x.base") & (F.col("x.kind") == k), F.col(f"x.{c}"))
    for k in range(len(KINDS)):
        met = (F.max(strict(k, "end")).over(up) > F.col("x.start")) | (F.min(strict(k, "start")).over(down) < F.col("x.end"))
        spans = spans.withColumn(f"met{k}", F.coalesce(met, F.lit(False)))
    met = F.array(*[f"met{k}" for k in range(len(KINDS))])
    spans = spans.filter(F.col("x.base") | ~F.get(met, F.col("x.kind")))
    known = F.when(~F.col("x.base") & F.array_contains(met, True), 0).otherwise(F.col("x.known"))
    return spans.select("row", "held", F.col("x").withField("known", known).alias("x"))


def tree_sql(tree, field) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, at, left, right = tree
    return f"CASE WHEN {field(f)} <= {at!r}D THEN {tree_sql(left, field)} ELSE {tree_sql(right, field)} END"


class Model:
    """Boosted trees and a threshold of log odds for each kind."""

    def __init__(self, trees: BoostedTrees, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def score_sql(self, x: str) -> str:
        """Log odds of the struct ``x``."""
        return " + ".join([f"{self.trees.base!r}D", *(f"({tree_sql(t, lambda f: f'{x}.{FEATURES[f]}')})" for t in self.trees.grown)])

    def chosen_sql(self, x: str, score: str) -> str:
        return f"{score} >= element_at(array({', '.join(f'{t!r}D' for t in self.thresholds)}), {x}.kind + 1)"


def thresholds(scores: np.ndarray, y: np.ndarray, kinds: np.ndarray, weights: np.ndarray, precision: float) -> list[float]:
    """For each kind the score from which on ``precision`` of the weight is right, half way to the next lower one, where it isn't; at least 0; ``NEVER`` where no personal data of the kind is known."""
    out = []
    for k in range(len(KINDS)):
        own = np.flatnonzero(kinds == k)
        own = own[np.argsort(-scores[own], kind="stable")]
        s, good, all_ = scores[own], (y * weights)[own].cumsum(), weights[own].cumsum()
        # rows of equal scores stand or fall together
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True)) if len(s) else np.empty(0, int)
        right = [i for i in ends if good[i] >= precision * all_[i] and good[i] > 0]
        low = right[-1] if right else 0
        out.append(max(0.0, float(s[low] + s[low + 1]) / 2 if low + 1 < len(s) else 0.0) if right else NEVER)
    return out


def cells(held: DataFrame, score: Column) -> DataFrame:
    """(kind, y, cell, n): all spans of ``held`` (y, n, FEATURES) counted by kind, what is known of them, and their log odds to the nearest 1/CELLS; so many rows at most as there are cells."""
    return held.groupBy("kind", "y", (F.floor(score * CELLS + 0.5) / CELLS).alias("cell")).agg(F.sum("n").alias("n"))


def fit(spans: DataFrame, *, sample: int, precision: float, scratch: Scratch) -> Model:
    """From spans (held, x): the trees get at most ``sample`` rows of equal features, chosen by hash, with their counts.

    A quarter of the documents, by hash, is kept for the thresholds. For these every known span is scored and counts.
    """
    counts = spans.filter("x.known >= 0").groupBy("held", F.col("x.known").alias("y"), *[F.col(f"x.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"))
    counts = scratch.settle(counts, "counts")
    rows = counts.filter("not held").orderBy(F.xxhash64("y", *FEATURES), "y", *FEATURES).limit(sample).collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    x, y, n = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float), np.array([r.n for r in rows], float)
    trees = BoostedTrees(trees=40, depth=3)
    if (y == 1).any():
        # copies of a span tell little more than one
        trees.fit(x, y, 1 + np.log(n))
    if not trees.grown:
        return Model(trees, [NEVER] * len(KINDS))
    held = counts.filter("held").select("y", "n", F.struct(*FEATURES).alias("x"), "kind")
    told = cells(held, F.expr(Model(trees, []).score_sql("x"))).collect()
    return Model(trees, thresholds(*(np.array([r[c] for r in told], float) for c in ("cell", "y", "kind", "n")), precision))


def joined(spans: Column) -> Column:
    """kind:start:end of spans by kind, then start."""
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))), named), ",")


def number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def find_personal(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, precision: float = 0.98, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, base, added of every row: arrays of (kind, start, end), in code points, end exclusive.

    A null text is empty. Base spans of a kind don't overlap; spans that the trees add overlap neither base spans nor each other. Rows that repeat
    are searched each. Without any base span nothing is added. No rows in, no rows out; other columns are ignored and may have any name.
    The result reads tables of ``scratch``; the caller drops them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    base, wide = proposed(F.col("t"))
    held = F.pmod(F.xxhash64("t", F.lit(13)), F.lit(4)) == 0
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # rows are numbered as they are written, so that the number is the same wherever it is read
    found = scratch.settle(rows.select(F.monotonically_increasing_id().alias("row"), "id", held.alias("held"), base.alias("base"), wide.alias("wide")), "found")
    spans = scratch.settle(told(found), "spans")
    model = fit(spans, sample=sample, precision=precision, scratch=scratch)
    # what is known not to be personal data stays out, whatever its score
    open_ = spans.filter("not x.base and x.known <> 0").select("row", F.col("x"), F.expr(model.score_sql("x")).alias("score")).filter(model.chosen_sql("x", "score"))
    one = F.struct(F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.kind").alias("kind"), "score")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kind:int,score:double>>")

    def keep(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = (F.size(acc) == 0) | (last["end"] <= x["start"])
        return F.when(apart, F.array_append(acc, x)).when(x["score"] > last["score"], F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), x)).otherwise(acc)

    chosen = open_.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("chosen")).select("row", F.aggregate("chosen", none, keep).alias("added"))
    span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return found.join(chosen, "row", "left").select(F.col("id").alias(id_col), F.transform("base", span).alias("base"), F.transform(F.coalesce("added", none), span).alias("added"))
