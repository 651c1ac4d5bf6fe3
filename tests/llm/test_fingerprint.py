import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelake.llm import fingerprint
from sievelake.llm.fingerprint import fingerprints


def py_pieces(text):
    """Pieces with the ones before them, the k-th of equal ones apart."""
    cut = [x for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", text) if x]
    times = Counter()
    out = set()
    for pair in zip([None, *cut], cut, strict=False):
        out.add((*pair, times[pair]))
        times[pair] += 1
    return out


def brute(docs):
    """(id, n_chars, sha of the edited text, likeness to it, likeness to the next)."""
    docs = sorted(docs)
    out = {}
    for at, (i, t) in enumerate(docs):
        nxt = docs[(at + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, n = py_pieces(t), py_pieces(edited), py_pieces(nxt)
        near = [1.0 if not a and not x else (len(a) + len(x) - len(a ^ x)) / (len(a) + len(x)) for x in (e, n)]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *map(pytest.approx, near))
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = fingerprints(docs).collect()
    want = brute([(r.doc_id, r.text or "") for r in docs.collect()])
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == want
    prints = {}
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), [x.text for x in docs.orderBy("doc_id").collect()], strict=True):
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert sum(r.near_edited for r in rows) > 3 * sum(r.near_next for r in rows)


def test_small_sketches_are_tried_again_larger(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    rows = fingerprints(docs, factor=0.001).collect()
    want = brute([(r.doc_id, r.text or "") for r in docs.collect()])
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == want


def test_differences_come_out_whole(spark):
    pairs = spark.createDataFrame([(0, i, list(range(i * 100, i * 100 + 40)), list(range(i * 100 + 10, i * 100 + 45))) for i in range(50)], "b int, r int, _x array<long>, _y array<long>")
    rows = fingerprint.differences(pairs, ["b", "r"], factor=4.0, seed=7).collect()
    assert {(r._d, r._left) for r in rows} == {(15, 0)} and len(rows) == 50


def test_differing_digests_are_recovered(spark):
    """With their signs, whichever digests both texts share; tables that are too small say so."""
    rng = random.Random(2)
    digests = lambda n: [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    want, rows = {}, []
    for i in range(40):
        both, x, y = digests(rng.randrange(60)), digests(rng.randrange(30)), digests(rng.randrange(30))
        rows.append((0, i, both + x, y + both))
        want[i] = {(k, 1) for k in x} | {(k, -1) for k in y}
    pairs = spark.createDataFrame(rows, "b int, r int, _x array<long>, _y array<long>")
    found = fingerprint.recovered(pairs, ["b", "r"], factor=2.0).collect()
    assert all(r.whole for r in found)
    assert {i: {(r.digest, r.side) for r in found if r.r == i} for i in want} == want
    few = fingerprint.recovered(pairs, ["b", "r"], factor=0.0, rounds=1).collect()
    assert any(not r.whole for r in few) and all((r.digest, r.side) in want[r.r] for r in few if r.digest is not None)


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(5, "ab, cd. ef")], "doc_id long, text string")
    (r,) = fingerprints(docs).collect()
    assert r.edited_sha256 == hashlib.sha256(b"ab, cab, c").hexdigest() and r.near_next == 1.0


def test_order_and_repeats_count(spark):
    texts = ["A line.\nB line.", "B line.\nA line.\nA line.\nA line.", "A line.\nB line.\nB line.", "B line.\nA line."]
    rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in rows}) == 4 and all(r.near_next < 1 for r in rows)


def test_many_equal_pieces(spark):
    """Texts of very many short lines take time in proportion."""
    docs = spark.createDataFrame([(0, "x\n" * 6_000), (1, "x\ny\n" * 3_000)], "doc_id long, text string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fingerprints(docs).collect()} == want


def test_odd_rows(odd, none):
    rows = fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert sum(r.doc_id is None for r in rows) == 2
    empty = odd.filter("text is null or text = ''").select(F.col("doc_id"), "text")
    assert all(r.near_edited == r.near_next == 1.0 and r.n_chars == 0 for r in fingerprints(empty).collect())
    assert fingerprints(none).collect() == []
