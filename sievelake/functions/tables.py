"""Table functions, to call in SQL: matches of a text beside its row, and template tokens that are cut by the turns of a conversation."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Row
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from sievelake.functions import detectors
from sievelake.functions.codepoints import TEMPLATE_TOKENS

_TOKENS = regex.compile("|".join(regex.escape(t) for t in TEMPLATE_TOKENS))
#: A token that isn't over yet has fewer characters than the longest.
_TAIL = max(map(len, TEMPLATE_TOKENS)) - 1


@udtf(returnType="vendor string, pattern string, confidence double, position int, length int")
class TextMatches:
    """text_matches(text): a row for each match of the detectors, none for a null text."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from detectors.find(text)


class TurnTokens:
    """turn_tokens(TABLE(...), key => , turn => , text => ): a row for each template token over the turns of a conversation, in the order of turns: the key, the turns where it
    starts and ends, the token, and whether turns cut it.

    The function itself asks for the partitioning and the order. A null text is empty. A conversation's rows go by one after the other; only the last few characters are held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, turn: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("turn_tokens takes a table")
        names = [a.value for a in (key, turn, text)]
        missing = [n for n in names if n not in rows.dataType.fieldNames()]
        if missing:
            raise ValueError(f"no such columns: {', '.join(map(str, missing))}")
        schema = StructType().add(names[0], rows.dataType[names[0]].dataType).add("started", LongType()).add("ended", LongType()).add("token", StringType()).add("cut", BooleanType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def __init__(self):
        self.tail: list[tuple[str, int]] = []

    def eval(self, row: Row, key: str, turn: str, text: str) -> Iterator[tuple]:
        at, own = row[turn], row[text] or ""
        held = len(self.tail)
        whole = "".join(c for c, _ in self.tail) + own
        for m in _TOKENS.finditer(whole):
            # one that ended before has been told
            if m.end() > held:
                started = self.tail[m.start()][1] if m.start() < held else at
                yield row[key], started, at, m[0], m.start() < held
        kept = whole[-_TAIL:]
        turns = [t for _, t in self.tail] + [at] * len(own)
        self.tail = list(zip(kept, turns[len(whole) - len(kept) :], strict=True))


def register(spark) -> list[str]:
    spark.udtf.register("text_matches", TextMatches)
    spark.udtf.register("turn_tokens", udtf(TurnTokens))
    return ["text_matches", "turn_tokens"]
