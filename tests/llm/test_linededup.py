import hashlib
import random
from collections import defaultdict

import pytest

from sievelake.llm import linededup
from sievelake.llm.linededup import BLANKS, CuckooFilter, LineIndex, dedup_lines

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWERED)
            if len(key) >= 10 and i is not None:
                held[key].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := held.get(x.strip(BLANKS).translate(LOWERED), ())) < 2 or i == min(h)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = dedup_lines(docs).collect()
    assert sorted(map(tuple, rows), key=str) == brute([tuple(r) for r in docs.collect()])
    assert sum(r.n_dropped for r in rows)


@pytest.mark.parametrize("limits", [{"shards": 1}, {"shards": 40}, {"shard_keys": 3}, {"heavy": 1}, {"heavy": 10**6}])
def test_same_at_every_size(spark, sf, limits):
    """However many shards, and whether keys count as heavy or not."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    refs = linededup.references(docs)
    table = linededup.counts(refs)
    sets = [{(r.doc, bytes(r.digest)) for r in linededup.drops(refs, table, **x).collect()} for x in ({}, limits)]
    assert sets[0] == sets[1] and sets[0]


def test_filters_reject_most_references(spark, sf):
    refs = linededup.references(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    table = linededup.counts(refs)
    likely, shared = linededup.probe(refs, linededup.filters(table, 5), 5).count(), refs.join(table, "digest", "left_semi").count()
    assert shared <= likely <= shared + 0.01 * refs.count() < refs.count()


def test_odd_rows(odd, none):
    rows = dedup_lines(odd).collect()
    assert sorted(map(tuple, rows), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert dedup_lines(none).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 5000])
def test_cuckoo_filter(n):
    keys = [hashlib.sha256(str(i).encode()).digest()[:16] for i in range(2 * n)]
    f = CuckooFilter.load(CuckooFilter.build(keys[:n]).dump())
    if n:
        assert f.has(keys[:n]).all() and f.has(keys[n:]).mean() < 0.01
        f.remove(keys[: n // 2])
        assert f.has(keys[n // 2 : n]).all() and (n < 100 or f.has(keys[: n // 2]).mean() < 0.01)


def test_deletion_reverses_insertion(spark):
    line = "a line of ten or more"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in (1, 2, 3)], "doc_id long, text string")
    index = LineIndex.empty(spark, shards=4).insert(docs)
    dropped = lambda x: sorted(r.doc for r in x.dropped().collect())
    assert dropped(index) == [2, 3]
    less = index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert dropped(less) == [3] and dropped(index) == [2, 3]
    assert dropped(less.insert(docs.filter("doc_id = 1"))) == [2, 3]
    # the key has one shard: the others' files stay
    assert len(less.versions) == 1


def test_any_changes_follow_the_counts(spark):
    """Batches that come and go: what is dropped, and what the filters hold, is as from all documents that are left."""
    rng = random.Random(4)
    lines = [f"a line with the number {i}" for i in range(30)]
    index, left = LineIndex.empty(spark, shards=3), {}
    for _ in range(5):
        new = {rng.randrange(40): "\n".join(rng.choices(lines, k=6)) for _ in range(8)}
        new = {i: t for i, t in new.items() if i not in left}
        index = index.insert(spark.createDataFrame(list(new.items()), "doc_id long, text string"))
        left |= new
        gone = rng.sample(sorted(left), 4) + [999]
        index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        left = {i: t for i, t in left.items() if i not in gone}
        refs = linededup.references(spark.createDataFrame(list(left.items()), "doc_id long, text string"))
        table = linededup.counts(refs)
        want = {(r.doc, bytes(r.digest)) for r in linededup.drops(refs, table).collect()}
        assert {(r.doc, bytes(r.digest)) for r in index.dropped().collect()} == want
        assert {(bytes(r.digest), r.holders, r.keeper) for r in index.table("counts").filter("holders > 1").collect()} == {tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in table.collect()}
        held = sum(int((CuckooFilter.load(bytes(r.data)).table > 0).sum()) for r in index.table("filters").collect())
        assert held == table.count()


def test_full_filters_are_built_anew(spark):
    docs = [(i, "\n".join(f"line {i // 2} number {k} of many" for k in range(150))) for i in range(8)]
    index = LineIndex.empty(spark, shards=1)
    for at in range(0, 8, 2):
        index = index.insert(spark.createDataFrame(docs[at : at + 2], "doc_id long, text string"))
    assert index.dropped().count() == 4 * 150
