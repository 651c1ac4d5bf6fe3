import random

import pytest

from sievelake.operators.temporal import asof_join, interval_join


def rows(seed, n, keys, span):
    """Times that repeat, a key with most rows, null keys and times, rows that repeat."""
    rng = random.Random(seed)
    out = [(rng.choice(["hot"] * 6 + keys + [None]), None if rng.random() < 0.05 else rng.randrange(-span, span), rng.randrange(5), i) for i in range(n)]
    return out + out[:5]


@pytest.mark.parametrize("bucket", [1, 7, 50, 10_000])
def test_asof_against_brute_force(spark, bucket):
    left, right = rows(1, 200, ["a", "b"], 120), rows(2, 80, ["a", "c"], 120)
    found = asof_join(spark.createDataFrame(left, "k string, t long, v int, id long"), spark.createDataFrame(right, "k string, u long, v int, id long"), ["k"], "t", "u", ["v", "id"], bucket=bucket)
    assert found.columns == ["k", "t", "v", "id", "asof_v", "asof_id", "asof_time"]

    def last(k, t):
        seen = [(u, v, i) for key, u, v, i in right if key is not None and key == k and u is not None and t is not None and u <= t]
        u, v, i = max(seen, default=(None, None, None))
        return v, i, u

    assert sorted(map(tuple, found.collect()), key=str) == sorted(((*x, *last(x[0], x[1])) for x in left), key=str)


@pytest.mark.parametrize("bucket, levels", [(1, 2), (3, 4), (1000, 1)])
def test_intervals_against_brute_force(spark, bucket, levels):
    points = rows(3, 150, ["a", "b"], 5000)
    rng = random.Random(4)
    spans = [(k, t, None if t is None else t + rng.choice([-3, 0, 1, 10, 70, 4000]), v, i) for k, t, v, i in rows(5, 60, ["a", "c"], 5000)]
    found = interval_join(spark.createDataFrame(points, "k string, t long, v int, id long"), spark.createDataFrame(spans, "k string, since long, until long, v int, id long"), ["k"], "t", "since", "until", bucket=bucket, levels=levels)
    want = [(p[3], s[4]) for p in points for s in spans if p[0] is not None and p[0] == s[0] and None not in (p[1], s[1], s[2]) and s[1] <= p[1] < s[2]]
    assert sorted((r.point.id, r.interval.id) for r in found.collect()) == sorted(want) and len(want) > 100


def test_timestamps_and_empty_tables(spark):
    schema = "k string, t timestamp, v int"
    left = spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00.000002' AS t, 1 AS v")
    right = spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00.000001' AS t, 2 AS v UNION ALL SELECT 'a', timestamp'2024-01-01 00:00:00.000003', 3")
    assert [(r.v, r.asof_v) for r in asof_join(left, right, ["k"], "t", "t", ["v"]).collect()] == [(1, 2)]
    none = spark.createDataFrame([], schema)
    assert [(r.v, r.asof_v) for r in asof_join(left, none, ["k"], "t", "t", ["v"]).collect()] == [(1, None)]
    assert asof_join(none, right, ["k"], "t", "t", ["v"]).collect() == interval_join(none, right.selectExpr("k", "t as a", "t as b"), ["k"], "t", "a", "b").collect() == []
