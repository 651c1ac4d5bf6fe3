"""Pandas UDFs that are made when they are first used: modules can be imported before there is a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows whose results are held in Python at once.
SLICE = 256


def in_slices(f: Callable) -> Callable:
    """A function over batches that sees no more than SLICE rows at once: results leave as they are made, so that a batch's, which may be many times its texts, are never held together."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(slices(batches))

    return run


def slices(batches: Iterator) -> Iterator:
    """A batch is a column or a tuple of some."""
    for b in batches:
        for i in range(0, len(b[0] if isinstance(b, tuple) else b), SLICE):
            yield tuple(c.iloc[i : i + SLICE] for c in b) if isinstance(b, tuple) else b.iloc[i : i + SLICE]


def vectorised(returns: str, texts: bool = False) -> Callable:
    """``texts``: columns are texts, whose bytes that aren't UTF-8 become replacement characters."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column) -> Column:
            return call.udf()(*map(F.make_valid_utf8, columns) if texts else columns)

        call.udf = lambda: F.pandas_udf(in_slices(f), returns)
        call.__doc__ = f.__doc__
        return call

    return wrap
