import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievelake.llm import neardup
from sievelake.llm.common import Scratch
from sievelake.llm.neardup import near_duplicates


def words(text):
    return (text or "").lower().split()


def levenshtein(a, b):
    """The whole table, a row at a time."""
    a, b = np.array(a), np.array(b)
    row, at = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != x))))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def pairs(docs, least=0.8):
    """All pairs of different texts that are alike by words."""
    number, first = {}, {}
    for i, t in sorted(docs):
        first.setdefault(t or "", i)
    texts = [(i, np.array([number.setdefault(w, len(number)) for w in words(t)])) for t, i in first.items() if words(t)]
    bags = [Counter(t.tolist()) for _, t in texts]
    out = []
    for x, (i, a) in enumerate(texts):
        for y in range(x):
            j, b = texts[y]
            longer = max(len(a), len(b))
            if min(len(a), len(b)) >= least * longer - 1e-9 and (bags[x] & bags[y]).total() >= least * longer - 1e-9 and longer - levenshtein(a, b) >= least * longer - 1e-9:
                out.append((min(i, j), max(i, j)))
    return out


def brute(docs, least=0.8):
    """Least id of each id's class, by all pairs."""
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def tie(i, j):
        up[max(root(i), root(j))] = min(root(i), root(j))

    first = {}
    for i, t in sorted(docs):
        tie(first.setdefault(t or "", i), i)
    for i, j in pairs(docs, least):
        tie(i, j)
    return {i: root(i) for i in up}


def recall(found, docs, least=0.8):
    """Of the pairs by all pairs, the share that is in one class, and their number. Every class must be within one of the brute force's."""
    want = brute(docs)
    assert all(want[i] == want[c] for i, c in found.items())
    alike = pairs(docs, least)
    return sum(found[i] == found[j] for i, j in alike) / max(1, len(alike)), len(alike)


def planted(n=24, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        for edits in (0, 0, 1, 2, 5, 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


def classes_of(rows):
    return {r.doc_id: r.class_id for r in rows}


def test_planted_copies(spark):
    docs = planted()
    rows = classes_of(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    # texts of eight words have four shingles, of which a word in the middle takes all
    found, n = recall(rows, docs)
    assert found >= 0.85 and n > 100
    long = [(i, t) for i, t in docs if len(t.split()) >= 60]
    found, n = recall({i: rows[i] for i, _ in long}, long, 0.9)
    assert found >= 0.95 and n > 60


@pytest.mark.parametrize("length", [60, 200, 600])
def test_recall_by_similarity(spark, length):
    """Pairs of their own, with scattered replacements, so that no third text can stand in for a missed link."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, of = [], {}
    for least in (0.80, 0.85, 0.90, 0.95):
        for _ in range(150):
            a = [word() for _ in range(length)]
            b = list(a)
            for at in rng.sample(range(length), round((1 - least) * length)):
                b[at] = word()
            of[len(docs)] = least
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    got = classes_of(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    found = {k: sum(got[i] == got[i + 1] for i, v in of.items() if v == k) / 150 for k in (0.80, 0.85, 0.90, 0.95)}
    assert found[0.80] >= 0.9 and found[0.85] >= 0.97 and found[0.90] == found[0.95] == 1.0, found
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_shared_words_bound_what_texts_have_in_common():
    rng = random.Random(4)
    texts = [np.array([rng.randrange(30) for _ in range(rng.randrange(1, 80))]) for _ in range(25)]
    bound = neardup.shared_words(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert bound[i, j] >= (Counter(a.tolist()) & Counter(b.tolist())).total() and bound[i, j] <= min(len(a), len(b))


@pytest.mark.parametrize("seed", range(12))
def test_leaders_rule_out_no_link(seed, monkeypatch):
    """Classes with many members beside texts that are near, just beyond and far: the same classes come out as by all pairs."""
    rng = random.Random(seed)
    texts, classes = [], []
    base = [rng.randrange(10**6) for _ in range(100)]
    for k, (copies, edits) in enumerate([(20, 3), (15, rng.choice([6, 24])), (6, 15), (10, 30), (5, 90)]):
        own = list(base)
        for at in rng.sample(range(100), min(99, edits)):
            own[at] = rng.randrange(10**6)
        for c in range(copies):
            w = list(own)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(100)] = rng.randrange(10**6)
            texts.append(np.array(w))
            classes.append(k if k < 2 else 100 * k + c)
    order = rng.sample(range(len(texts)), len(texts))
    texts, classes = [texts[i] for i in order], [classes[i] for i in order]

    def joined(found):
        up = list(range(len(texts)))
        root = lambda i: i if up[i] == i else root(up[i])
        ties = [*found, *((classes.index(c), i) for i, c in enumerate(classes))]
        for a, b in ties:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(texts))]

    got = neardup.block_links(list(range(len(texts))), texts, classes, 0.8)
    monkeypatch.setattr(neardup.Leaders, "apart", lambda *a: False)
    assert joined(got) == joined(neardup.block_links(list(range(len(texts))), texts, classes, 0.8))


@pytest.mark.parametrize("limits", [{"block": 2}, {"block": 3, "heads": 1}, {"block_words": 300}])
def test_blocks_lose_no_link(spark, limits):
    docs = planted(6)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert classes_of(near_duplicates(df, **limits).collect()) == classes_of(near_duplicates(df).collect())


def test_large_group_with_others_in_its_buckets(spark):
    """Copies that share a passage with unlike texts: the passage's buckets hold them all."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, base = [word() for _ in range(60)], [word() for _ in range(20)]
    docs = []
    for i in range(60):
        w = passage + base
        w[rng.randrange(60, 80)] = word()
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(passage + [word() for _ in range(rng.choice([16, 40]))])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    small = classes_of(near_duplicates(df, block=8, heads=2).collect())
    assert small == classes_of(near_duplicates(df).collect()) and recall(small, docs)[0] >= 0.9


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    rows = near_duplicates(table).collect()
    found, n = recall(classes_of(rows), docs)
    assert found >= 0.95, n
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_order_matters(spark):
    """The same shingles in another order have another sample and don't align."""
    rng = random.Random(1)
    parts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(4)]
    docs = [(0, " ".join(parts)), (1, " ".join(parts[::-1]))]
    assert set(classes_of(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()).values()) == {0, 1}


@pytest.mark.parametrize("seed", range(60))
def test_alignment(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(neardup, "CHUNK", rng.choice([3, 16, 4096]))
    a = [rng.randrange(6) for _ in range(rng.randrange(60))]
    b = [rng.randrange(6) for _ in range(rng.randrange(60))] if rng.random() < 0.2 else list(a)
    for _ in range(rng.randrange(12)):
        at = rng.randrange(len(b) + 1)
        b[at : at + rng.randrange(3)] = [rng.randrange(6) for _ in range(rng.randrange(3))]
    n, limit = levenshtein(a, b), rng.randrange(40)
    found = neardup.edits(np.array(a, np.uint32), np.array(b, np.uint32), limit)
    assert found == n if n <= limit else found > limit


def test_long_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in neardup.classes(edges, Scratch(spark)).collect()}
    assert found == {i: 0 for i in range(1, 71)} | {101: 100}


def test_stars_with_members_in_common_are_one_class_after_a_round(spark):
    """As the blocks of a bucket make them: each ties its own members and all heads to its least."""
    blocks = [[k, *range(100, 104), *range(1000 + 10 * k, 1010 + 10 * k)] for k in range(1, 9)]
    edges = spark.createDataFrame([(b[0], x) for b in blocks for x in b[1:]], "a long, b long")
    settled = []

    class Counting(Scratch):
        def settle(self, df, name):
            settled.append(name)
            return super().settle(df, name)

    found = {r.node: r.root for r in neardup.classes(edges, Counting(spark)).collect()}
    assert found == {x: 1 for b in blocks for x in b if x != 1} and settled == ["stars"]


def test_a_task_ties_what_it_joins_to_the_least():
    assert sorted(neardup.ties([(5, 7), (9, 7), (2, 3), (9, 1), (7, 5)])) == [(1, 5), (1, 7), (1, 9), (2, 3)]


def test_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = defaultdict(set)
    for r in rows:
        of[r.class_id].add(r.doc_id)
    assert of[0] == {0, 1, 2} and of[3] == {3, 4} and of[7] >= {7, 8} and of[None] == {None}
    assert near_duplicates(none).collect() == []


def unlike(n, seed=5):
    """Texts that share a passage and a common line's words but little else, one in ten with a near copy beyond the passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common, docs = [word() for _ in range(12)], []
    passage = [word() for _ in range(30)]
    for i in range(n):
        w = passage + [rng.choice(common) if rng.random() < 0.3 else word() for _ in range(30)]
        docs.append(" ".join(w))
        if i % 10 == 0:
            for at in rng.sample(range(30, 60), 6):
                w[at] = word()
            docs.append(" ".join(w))
    return list(enumerate(docs))


def test_meetings_of_a_large_bucket_grow_as_its_members(spark, monkeypatch):
    """All share a passage's buckets: four times as many texts of one length make about four times as many rows, not sixteen."""
    made, real = [], neardup.links

    def links(rows, least):
        made.append(rows.selectExpr("sum(size(_tasks))").first()[0])
        return real(rows, least)

    monkeypatch.setattr(neardup, "links", links)
    sums = []
    for n in (100, 400):
        docs = unlike(n)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        rows = classes_of(near_duplicates(df, block=8, heads=2).collect())
        sums.append(sum(made[1:]))
        made.clear()
        assert rows == brute(docs) if n == 100 else recall(rows, docs)[0] == 1.0
    assert sums[1] <= 6 * sums[0], sums


def test_lengths_part_a_large_bucket(spark):
    """Pairs at the least ratio of lengths are met, whichever step each falls in."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, docs = [word() for _ in range(40)], []
    for length in range(60, 140, 2):
        w = passage + [word() for _ in range(length - 40)]
        docs += [" ".join(w), " ".join(w[: -int(0.2 * length)])]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes_of(near_duplicates(df).collect())
    assert classes_of(near_duplicates(df, block=4, heads=1).collect()) == want and recall(want, docs)[0] == 1.0
