"""Places of a pattern's matches in a text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<position:int,length:int>>"
#: An array is copied when it gets one more: matches go to blocks of so many first.
BLOCK = 256


def utf16_length(text: Column) -> Column:
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)


def located(text: Column, pattern: str, measure: Callable[[Column], Column] = utf16_length) -> Column:
    """(position, length) of all matches, in the units of ``measure``: the pieces between matches and the matches add up to their places. A match may not be empty."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("b"))
    none = F.from_json(F.lit("[]"), SPANS)
    start = F.struct(F.lit(0).alias("at"), none.alias("block"), F.from_json(F.lit("[]"), f"array<{SPANS}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at, length = acc["at"] + measure(x["b"]), measure(x["m"])
        block = F.array_append(acc["block"], F.struct(at.alias("position"), length.alias("length")))
        full = F.size(acc["block"]) >= BLOCK - 1
        return F.struct((at + length).alias("at"), F.when(full, none).otherwise(block).alias("block"), F.when(full, F.array_append(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, add, lambda acc: F.flatten(F.array_append(acc["out"], acc["block"])))
