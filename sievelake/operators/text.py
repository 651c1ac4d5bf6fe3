"""Text operators on DataFrames: cleaning, detection, logs and signal rates.

Rows that no rule can touch never reach Python: their text goes to the UDF as null, in the same
scan, and comes back from the column as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import schemas
from sievelake.functions import detectors, hygiene
from sievelake.functions.vectorised import in_slices
from sievelake.options import TextOptions

_BLANKS = regex.compile(hygiene.BLANKS)
_REMOVED = ("type", "position", "length", "description")
_MATCH = ("vendor", "pattern", "confidence", "position", "length")


def clean_one(text: str, options: TextOptions, registry: detectors.Registry | None = None) -> tuple[str, list[tuple], list[tuple], float]:
    """Hygiene, then each vendor's clean-up if its detectors fire on what the ones before left, then blanks."""
    removed: list[tuple] = []
    found: list[tuple] = []
    best = 0.0
    if not text:
        return text, removed, found, best
    if options.unicode:
        text, removed, best = hygiene.clean(text)
    if options.vendors:
        registry = registry or detectors.REGISTRY
        for vendor in registry.vendors:
            matches = detectors.find(text, (vendor,), registry)
            if matches:
                found += matches
                best = max(best, *(m[2] for m in matches))
                after = registry.remove(vendor, text)
                if after != text:
                    removed.append(("vendor-watermark", 0, 0, vendor))
                    text = after
    if options.collapse_whitespace:
        after = _BLANKS.sub(" ", text)
        if after != text:
            removed.append(("heuristic-paraphrase", 0, 0, "Collapsed runs of blanks"))
            text = after
    return text, removed, found, best


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def others(df: DataFrame, text_col: str, added: tuple[str, ...]) -> list[str]:
    """``df``'s columns but for the text and those that the added ones take the place of."""
    return [c for c in df.columns if c != text_col and c not in added]


def clean_udf(options: TextOptions, registry: detectors.Registry | None = None):
    @F.pandas_udf(schemas.TEXT_CLEAN)
    @in_slices
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                if t is None:
                    rows.append((None, None, None, None))
                    continue
                cleaned, removed, found, best = clean_one(t, options, registry)
                rows.append((cleaned, [dict(zip(_REMOVED, r, strict=True)) for r in removed], [dict(zip(_MATCH, m, strict=True)) for m in found], best))
            yield pd.DataFrame(rows, columns=["cleaned", "removed", "detections", "confidence"])

    return run


def touched(text: Column, options: TextOptions, registry: detectors.Registry | None = None) -> Column:
    """Whether any rule of the options can change or match a text."""
    out = F.lit(False)
    if options.unicode:
        out = out | hygiene.has_hygiene_work(text) | hygiene.may_change(text)
    if options.vendors:
        out = out | detectors.is_candidate(text, registry)
    return out | F.rlike(text, F.lit(hygiene.BLANKS)) if options.collapse_whitespace else out


def clean_text(df: DataFrame, text_col: str = "text", options: TextOptions | None = None, prefix: str = "clean_", registry: detectors.Registry | None = None) -> DataFrame:
    """``df`` with the cleaned text, removal log, detections and confidence; all null for a null text.

    Columns: <prefix>text, <prefix>removed, <prefix>detections, <prefix>confidence, and <prefix>source_sha256 for the audit trail. A column
    that has one of these names gives way. Bytes that aren't UTF-8 become replacement characters; the hash is of the text as it was.
    """
    options = options or TextOptions()
    text, own = F.col(text_col), fresh(df, "_cleaned")
    out = df.withColumn(own, clean_udf(options, registry)(F.when(touched(text, options, registry), F.make_valid_utf8(text))))
    done = F.col(own)
    same = done["cleaned"].isNull() & text.isNotNull()
    added = {
        f"{prefix}text": F.coalesce(done["cleaned"], F.make_valid_utf8(text)),
        f"{prefix}removed": F.when(same, F.from_json(F.lit("[]"), f"array<{schemas.REMOVED}>")).otherwise(done["removed"]),
        f"{prefix}detections": F.when(same, F.from_json(F.lit("[]"), f"array<{schemas.MATCH}>")).otherwise(done["detections"]),
        f"{prefix}confidence": F.when(same, 0.0).otherwise(done["confidence"]),
        f"{prefix}source_sha256": F.sha2(text.cast("binary"), 256),
    }
    return out.select(*[c for c in df.columns if c not in added], *[c.alias(k) for k, c in added.items()])


def normalise(df: DataFrame, text_col: str = "text", out_col: str = "normalised") -> DataFrame:
    """Full hygiene of a text; only texts that compatibility normalisation may change visit Python."""
    tidied = fresh(df, "_tidied")
    out = df.withColumn(tidied, hygiene.tidy(F.col(text_col)))
    text = F.col(tidied)
    return out.withColumn(out_col, F.coalesce(hygiene.nfkc(F.when(hygiene.may_change(text), text)), text)).drop(tidied)


def removal_log(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per removed or replaced character of hygiene, in order, with ``df``'s other columns; those that have the name of an added one give way."""
    keep, own = others(df, text_col, ("item", *_REMOVED)), fresh(df, "_h")
    text = F.col(text_col)
    found = df.filter(hygiene.has_hygiene_work(text) | hygiene.may_change(text)).withColumn(own, hygiene.hygiene(text))
    return found.select(*keep, F.posexplode(F.col(own)["removed"]).alias("item", own)).select(*keep, "item", *[F.col(own)[k].alias(k) for k in _REMOVED])


def detect_text(df: DataFrame, text_col: str = "text", registry: detectors.Registry | None = None) -> DataFrame:
    """One row per match on the raw text, with ``df``'s other columns; those that have the name of an added one give way. Texts without a candidate are filtered at the scan."""
    keep, own = others(df, text_col, ("match", *_MATCH)), fresh(df, "_m")
    rest, valid = fresh(df, "_rare"), fresh(df, "_valid")
    found = df.filter(detectors.is_candidate(F.col(text_col), registry)).withColumn(valid, F.make_valid_utf8(F.col(text_col))).withColumn(rest, detectors.rare(F.col(valid)))
    found = found.withColumn(own, detectors.detect(F.col(valid), registry, F.col(rest)))
    # from an inner one the optimiser takes a filter on the number of matches, and finds them all once more for it
    return found.select(*keep, F.posexplode_outer(own).alias("match", own)).filter("match is not null").select(*keep, "match", *[F.col(own)[k].alias(k) for k in _MATCH])


def signal_counts(df: DataFrame, keys: list[str], text_col: str = "text", registry: detectors.Registry | None = None) -> DataFrame:
    """Matches and texts with a match, by ``keys``, vendor and pattern, without Python unless the registry has many detectors of the caller's.

    The counts of all detectors are summed side by side first, so one narrow row for each key is
    shuffled; they are turned into rows after that.
    """
    text, registry = F.col(text_col), registry or detectors.REGISTRY
    if registry.wide:
        found = df.select(*keys, detectors.detect(text, registry).alias("_m"))
        # matches of a detector follow each other
        first = F.transform("_m", lambda m, i: F.struct(m["vendor"].alias("vendor"), m["pattern"].alias("pattern"), ((i == 0) | (F.get("_m", i - 1)["vendor"] != m["vendor"]) | (F.get("_m", i - 1)["pattern"] != m["pattern"])).cast("long").alias("first")))
        return found.select(*keys, F.explode(first).alias("_x")).groupBy(*keys, "_x.vendor", "_x.pattern").agg(F.count("*").alias("matches"), F.sum("_x.first").alias("texts"))
    rare = df.filter(registry.candidate(text)).select(*keys, text.alias("_text"), detectors.rare(text).alias("_rare"))
    per_text = rare.select(*keys, detectors.counts(F.col("_text"), F.col("_rare"), registry).alias("_c"))
    field = lambda d: F.col("_c")[d.name]
    sums = [x for i, d in enumerate(registry.detectors) for x in (F.sum(field(d)).alias(f"_n{i}"), F.count(F.when(field(d) > 0, 1)).alias(f"_t{i}"))]
    wide = per_text.groupBy(*keys).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(d.vendor).alias("vendor"), F.lit(d.pattern).alias("pattern"), F.col(f"_n{i}").alias("matches"), F.col(f"_t{i}").alias("texts")) for i, d in enumerate(registry.detectors)]))
    return wide.select(*keys, rows.alias("_s")).select(*keys, "_s.*").filter("matches > 0")


def codepoint_inventory(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """How often each strippable or replaceable code point occurs, by ``keys``."""
    pattern = f"({hygiene.HYGIENE_CLASS})"
    found = df.filter(hygiene.has_hygiene_work(F.col(text_col))).select(*keys, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1)).alias("_ch"))
    return found.groupBy(*keys, F.lpad(F.hex(F.encode("_ch", "UTF-16BE")), 4, "0").alias("codepoint")).agg(F.count("*").alias("occurrences"))
