import datetime as dt

import pandas as pd
import pytest

from sievelake.streaming.budgets import budgets, spend

SCHEMA = "k string, t timestamp, id long"


def test_only_the_earliest_are_held():
    batches = [pd.DataFrame({"_at": [5, 3, 9], "_id": [1, 2, 3]}), pd.DataFrame({"_at": [3, 1], "_id": [1, 9]})]
    assert spend(4, 1, iter(batches)) == ([(1, 9), (3, 1), (3, 2)], 2)
    assert spend(4, 4, iter(batches)) == ([], 5)
    with pytest.raises(ValueError):
        budgets(None, ["k"], "t", "id", permits=0, window_seconds=60)


def test_batches_spend_one_budget_and_late_rows_are_counted(spark, tmp_path):
    def at(s):
        return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)

    first = [("a", at(5), 1), ("a", at(1), 2), (None, at(1), 3), ("a", None, 4), ("b", at(2), None), ("b", at(60), 5)]
    # ninety seconds behind the newest of the batch before, which is at 60, nothing is late yet
    second = [("a", at(6), 6), ("a", at(7), 7), ("a", at(7), 7), ("b", at(500), 8)]
    # now windows before 410 are over
    third = [("a", at(8), 9), ("b", at(501), 10)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    dropped = 0
    for batch in (first, second, third):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # each time the query starts again from its checkpoint
        query = budgets(stream, ["k"], "t", "id", permits=3, window_seconds=60, late="90 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    found = sorted(((r.k, r.window_start - start, r.id, r.place, r.rejected) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert found == sorted([("a", 0, 2, 1, 0), ("a", 0, 1, 2, 0), ("b", 60, 5, 1, 0), ("a", 0, 6, 3, 0), ("a", 0, None, None, 2), ("b", 480, 8, 1, 0), ("b", 480, 10, 2, 0)], key=str)
    assert dropped == 1


def test_keys_share_a_group_and_keep_budgets_of_their_own(spark, tmp_path):
    micro = dt.timedelta(microseconds=1)
    start = dt.datetime(2024, 1, 1)
    # keys that differ by a microsecond, or only by where one part ends; zeros of both signs are one key
    keys = [(s, start + m * micro, x) for s in ("a", 'a","b', "ü") for m in (0, 1) for x in (0.0, 1.5)]
    schema = "k string, m timestamp, x double, t timestamp, id long"
    rows = [(k, m, -x if i % 2 and not x else x, start + dt.timedelta(seconds=i), 10 * j + i) for i in range(4) for j, (k, m, x) in enumerate(keys) if x == 0.0 or i < 3]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = budgets(stream, ["k", "m", "x"], "t", "id", permits=2, window_seconds=60, late="90 seconds")
    # what is grouped: one group for a bucket and window, whatever the number of keys
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "[_bucket" in plan.split("FlatMapGroupsInPandasWithState", 1)[1]
    for _ in range(2):
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    # the first batch spends all, so the second has only rejected rows
    groups = {}
    for r in out:
        groups.setdefault((r.k, r.m, r.x + 0.0), []).append((r.id, r.place, r.rejected))
    assert len(groups) == len(want(rows))
    for key, first in want(rows).items():
        n = sum(1 for k, m, x, _, _ in rows if (k, m, x + 0.0) == key)
        assert sorted(g[:2] for g in groups[key] if g[0] is not None) == sorted((i, p + 1) for p, i in enumerate(first))
        assert sum(g[2] for g in groups[key]) == 2 * n - 2


def want(rows):
    out = {}
    for k, m, x, t, i in sorted(rows, key=lambda r: (r[3], r[4])):
        first = out.setdefault((k, m, x + 0.0), [])
        if len(first) < 2:
            first.append(i)
    return out
