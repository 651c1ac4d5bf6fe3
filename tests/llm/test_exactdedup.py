import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sievelake.llm.exactdedup import exact_dedup


def test_keeps_largest_or_smallest(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    for keep, kept in (("max", {2, 3, 5}), ("min", {1, 3, 4})):
        rows = exact_dedup(docs, keep=keep).collect()
        assert {r.doc_id for r in rows if r.kept} == kept
        assert all(r.text_sha256 == hashlib.sha256({1: b"a", 2: b"a", 3: b"b"}.get(r.doc_id, b"")).hexdigest() for r in rows)


def test_hot_text_is_salted_and_met_again(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    rows = exact_dedup(docs, keep="max", heavy_parts=64).collect()
    groups = defaultdict(list)
    for d in docs.collect():
        groups[d.text].append(d.doc_id)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == want


def test_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    rows = {r.doc_id: r for r in exact_dedup(docs, normalise=F.lower, carry=("text",)).collect()}
    assert rows[2].keep_id == 1 and rows[2].text == "a B" and not rows[2].kept


def test_odd_rows(odd, none):
    rows = exact_dedup(odd, keep="max", carry=("text", "_t")).collect()
    assert len(rows) == odd.count()
    want = Counter(t or "" for (t,) in odd.select("text").collect())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in want.items()}
    assert all(r.group_size == by_sha[r.text_sha256] for r in rows)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(by_sha.keys())
    assert sum(r.text is None for r in rows) == 2
    assert exact_dedup(none).collect() == []
