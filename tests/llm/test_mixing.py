from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievelake.llm import mixing, registry

LEVELS = lambda: {"domain": F.col("source"), "lang": F.col("lang"), "source": F.col("key")}


def water(budget, caps, weights):
    """Shares by raising the level step by step: whoever can't take its share takes all it can."""
    share, open_ = {}, {k for k in caps if weights[k] > 0}
    left = budget
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= left * weights[k]}
        if not full:
            return share | {k: left * weights[k] // total for k in open_} | {k: 0 for k in caps if weights[k] == 0}
        for k in full:
            share[k] = caps[k]
        left -= sum(caps[k] for k in full)
        open_ -= full
    return share | {k: 0 for k in caps if weights[k] == 0}


@pytest.mark.parametrize("fraction,epochs", [(0.3, 1), (0.9, 1), (1.4, 2), (5.0, 2)])
def test_budgets_go_to_siblings_first(spark, fraction, epochs):
    leaves = [("a", "en", "x", 100), ("a", "en", "y", 900), ("a", "de", "x", 50), ("b", "en", "x", 2000), ("b", "fr", "z", 10), ("c", "en", "q", 0)]
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2, "fr": 0}, "source": {"x": 5}}
    df = spark.createDataFrame(leaves, "_m_domain string, _m_lang string, _m_source string, _tokens long")
    got = {tuple(r)[:3]: r._share for r in mixing.budgets(df, weights, fraction, epochs).collect()}
    w = lambda level, k: weights[level].get(k, 1)
    cap = lambda *p: sum(epochs * t for *q, t in leaves if tuple(q[: len(p)]) == p)
    want = {}
    domains = {x[0] for x in leaves}
    for d, b in water(int(sum(x[3] for x in leaves) * fraction), {d: cap(d) for d in domains}, {d: w("domain", d) for d in domains}).items():
        langs = {x[1] for x in leaves if x[0] == d}
        for g, b2 in water(b, {g: cap(d, g) for g in langs}, {g: w("lang", g) for g in langs}).items():
            ss = {x[2] for x in leaves if x[:2] == (d, g)}
            for s, b3 in water(b2, {s: cap(d, g, s) for s in ss}, {s: w("source", s) for s in ss}).items():
                want[d, g, s] = b3
    assert got == want


def test_leaf_prefixes_fit_their_budgets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, registry.mix_levels(), registry.MIX_WEIGHTS, fraction=0.5).collect()
    total = sum((r.n + 3) // 4 for r in docs.select(F.length("text").alias("n")).collect())
    taken = sum(r.mix_tokens for r in rows)
    assert taken <= 0.5 * total and taken > 0.3 * total
    per = defaultdict(set)
    for r in rows:
        assert r.mix_epoch not in per[r.doc_id]
        per[r.doc_id].add(r.mix_epoch)
    assert all(e == set(range(len(e))) for e in per.values())


def test_odd_rows(odd, none):
    rows = mixing.mix(odd, LEVELS(), {"lang": {"en": 2}}, fraction=9.0, max_epochs=1).collect()
    assert sum(r.mix_tokens for r in rows) == sum((len(r.text or "") + 3) // 4 for r in odd.collect())
    assert {r.mix_lang for r in rows} == {"en", "unknown"}
    assert mixing.mix(none, LEVELS(), {}).collect() == []
