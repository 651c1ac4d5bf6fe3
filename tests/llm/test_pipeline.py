from pyspark.sql import functions as F

import corpus_pipeline
from sievelake.llm import registry
from tests.llm.test_neardup import brute as near_classes
from tests.llm.test_packing import check


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in registry.op4_toxicity(spark, sf).collect()}
    left = {i: t for i, t in rows.items() if not scores[i]}
    stages = dict(corpus_pipeline.STAGES)
    out = stages["toxicity"](spark, docs, sf)
    assert {r.doc_id: r.text for r in out.collect()} == left and out.columns == docs.columns
    last = {}
    for i in sorted(left):
        last[left[i]] = i
    left = {i: left[i] for i in last.values()}
    out = stages["exact_dedup"](spark, out, sf)
    assert {r.doc_id: r.text for r in out.collect()} == left and out.columns == docs.columns
    classes = near_classes(sorted(left.items()))
    out = stages["near_dedup"](spark, out, sf)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept.items() <= left.items() and out.columns == docs.columns
    # whatever goes has a near copy that stays, and of those that should go nearly all do
    stay = {classes[i] for i in kept}
    assert all(classes[i] in stay for i in left)
    copies = {i for i in left if classes[i] != i}
    assert len(copies - set(kept)) >= 0.95 * len(copies) and len(left) - len(kept) <= len(copies)
    left = kept
    out = stages["mixing"](spark, out, sf)
    mixed = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(dict(mixed)) == len(mixed)
    size = lambda texts: sum((len(t) + 3) // 4 for t in texts)
    assert 0.6 * size(left.values()) < size(t for _, t in mixed) <= 0.8 * size(left.values())
    check(stages["packing"](spark, out, sf).collect(), mixed)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {i for i, _ in mixed}


def test_odd_rows_and_empty_tables(spark, sf, odd, none):
    """Nulls, empty and long texts, repeated rows, clashing names; without labels of these ids nothing is toxic."""
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    every = texts(odd)
    out = stages["toxicity"](spark, odd, sf)
    assert texts(out) == every and out.columns == odd.columns
    exact = stages["exact_dedup"](spark, odd, sf)
    assert exact.columns == odd.columns and sorted({t for _, t in every}) == [t for _, t in sorted(texts(exact), key=lambda x: x[1])]
    near = stages["near_dedup"](spark, odd, sf)
    assert near.columns == odd.columns and {t.lower().strip() for _, t in texts(near)} <= {t.lower().strip() for _, t in every}
    assert sum(r.doc_id is None for r in near.collect()) == sum(r.doc_id is None for r in odd.collect())
    # an id with two texts loses only the row whose own text is a near copy
    twice = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (2, "something else entirely, this is")], "doc_id long, text string")
    assert texts(stages["near_dedup"](spark, twice, sf)) == [("1", "one two three four five six"), ("2", "something else entirely, this is")]
    assert stages["mixing"](spark, odd, sf).columns == odd.columns
    assert sum(r.length for r in stages["packing"](spark, odd, sf).collect()) > len(every)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.collect() == [] and (name == "packing" or out.columns == none.columns)


def test_columns_with_the_stages_own_names(spark, sf, odd):
    """Names that the stages use inside, and those that operators add, come back with the caller's values."""
    names = ["_toxicity", "_text_sha", "_gone", "_gone_sha", "_m_tokens", "_own_0", "_stage_5", "mix_epoch", "mix_tokens", "kept", "keep_id", "class_id", "_id", "_t", "_h", "_salt"]
    clash = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {c}").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns
        rows = out.select(*names).distinct().collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in names), name
    assert stage_count(corpus_pipeline.STAGES[-1][1](spark, clash, sf)) == stage_count(corpus_pipeline.STAGES[-1][1](spark, odd, sf))


def stage_count(df):
    return df.agg(F.sum("length")).first()[0]
