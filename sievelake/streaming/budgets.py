"""Budgets over streams: each key may have so many rows in each fixed window of event time.

A group of the state is one window of a bucket of keys, dealt by hash, and its state is what each key has used: a group for each key costs
a call of Python each. Of a batch's rows only the earliest that a key's budget has room for are held; the others are counted, so a key with
most of the rows costs time but no memory. A timer at the window's end takes the state away.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, FloatType


def spend_each(permits: int, used: dict[str, int], batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of a batch's rows (_code of the key, _at, _id, others) those that what is left of each key's budget admits, with their ``place``, in order; and a row of each key that has more, with the number ``rejected``."""
    first, seen, n = None, None, pd.Series(dtype="int64")
    for b in batches:
        n = n.add(b["_code"].value_counts(), fill_value=0)
        seen = pd.concat([seen, b.drop_duplicates("_code")]).drop_duplicates("_code")
        first = pd.concat([first, b]).sort_values(["_code", "_at", "_id"], kind="stable", ignore_index=True)
        place = first.groupby("_code").cumcount() + 1 + first["_code"].map(lambda c: used.get(c, 0)).astype("int64")
        first = first.assign(place=place)[place <= permits]
    rejected = seen["_code"].map(n.sub(first["_code"].value_counts(), fill_value=0)).astype("int64")
    return first, seen.assign(rejected=rejected)[rejected > 0]


def spend(permits: int, used: int, batches: Iterator[pd.DataFrame]) -> tuple[list[tuple[int, int]], int]:
    """The rows (_at, _id) of one key that what is left of its budget admits, in order, and how many it doesn't."""
    first, more = spend_each(permits, {"": used}, (b.assign(_code="") for b in batches))
    return list(zip(first["_at"].tolist(), first["_id"].tolist(), strict=True)), int(more["rejected"].sum())


def code(events: DataFrame, keys: list[str]) -> Column:
    """A text for each key, equal where the keys are."""
    types = {f.name: f.dataType for f in events.schema.fields}
    # minus zero is zero
    exact = [(F.when(F.col(k) == 0, 0.0).otherwise(F.col(k)) if isinstance(types[k], (FloatType, DoubleType)) else F.col(k)).alias(k) for k in keys]
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.to_json(F.struct(*exact), {"timestampFormat": micros, "timestampNTZFormat": micros, "timeZone": "UTC"})


def budgets(events: DataFrame, keys: list[str], time_col: str, id_col: str, *, permits: int, window_seconds: int, late: str = "30 minutes", buckets: int = 128) -> DataFrame:
    """A stream of (``keys``, window_start, ``id_col``, place, rejected) of the stream ``events``.

    A window admits the first ``permits`` rows of a key, by batch, then by time and id: each is a row with its place from 1 on. For each batch that
    has more, a row with neither id nor place has the number ``rejected``; their sum is the whole number. ``window_start`` is in seconds. Windows
    start at multiples of their length. Rows more than ``late`` behind the newest of the batches before are dropped, and the query's progress counts them
    (numRowsDroppedByWatermark). Rows with a null key, time or id (a whole number) are left out; rows that repeat count each. A task holds the keys
    of a window's bucket, so windows of over a hundred million keys want more ``buckets``; a stream keeps the number it has started with.
    """
    if permits < 1 or window_seconds < 1:
        raise ValueError("a budget has at least one permit and a window of at least a second")
    length = window_seconds * 1_000_000
    rows = events.select(*keys, F.col(time_col).cast("timestamp").alias("_time"), F.col(id_col).cast("long").alias("_id")).dropna().withWatermark("_time", late)
    at = F.unix_micros("_time")
    rows = rows.withColumn("_at", at).withColumn("window_start", at - F.pmod(at, F.lit(length)))
    rows = rows.withColumn("_code", code(rows, keys)).withColumn("_bucket", F.pmod(F.hash("_code"), F.lit(buckets)))
    names = [*keys, "window_start", id_col, "place", "rejected"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = dict(zip(*state.get, strict=True)) if state.exists else {}
        first, more = spend_each(permits, used, batches)
        used |= first.groupby("_code")["place"].max().to_dict()
        state.update((list(used), list(used.values())))
        state.setTimeoutTimestamp((int(key[-1]) + length) // 1000)
        first = first.assign(rejected=0).rename(columns={"_id": id_col})
        more = more.assign(place=pd.NA).drop(columns="_id").assign(**{id_col: pd.NA})
        out = pd.concat([x[[*keys, id_col, "place", "rejected"]].astype({id_col: "Int64", "place": "Int64"}) for x in (first, more)], ignore_index=True)
        yield out.assign(window_start=int(key[-1]) // 1_000_000)[names]

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "window_start long", f"`{id_col}` long", "place long", "rejected long"])
    return rows.groupBy("_bucket", "window_start").applyInPandasWithState(run, schema, "codes array<string>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout)
