import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievelake.llm import divergence
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """Rows (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        own = Counter(WORD.findall(text.translate(LOW)))
        counts[lang, source] += own
        docs[lang].update(own.keys())
        groups.add((lang, source))
    out = []
    for lang in docs.keys() | {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        mine = sorted(s for x, s in groups if x == lang)
        all_ = Counter()
        for s in mine:
            all_ += counts[lang, s]

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 2)) // (n + 2 * len(kept)) for t in kept}  # noqa: B023

        q, p = share(all_), {s: share(counts[lang, s]) for s in mine}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            own = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", own)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def got(df, **how):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(df, **how).collect())


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    want = brute(rows)
    assert got(df) == want and {r[2] for r in want} == {"pair", "term"}


@pytest.mark.parametrize("chunk, stretch, block, held", [(3, 2, 2, 5), (5, 1, 3, 10_000), (8192, 8, 16, 1)])
def test_tiles_and_chunks(spark, chunk, stretch, block, held):
    """Several blocks, chunks, stretches and tables of counts, with groups that have none of the terms."""
    rng = np.random.default_rng(3)
    rows = [("en" if i % 3 else None, f"s{rng.integers(7)}", " ".join(f"w{chr(97 + min(25, int(rng.geometric(0.15))))}É{'x' * int(rng.integers(3))}" for _ in range(12))) for i in range(160)]
    rows += [("en", "bare", "!!! 123"), ("fr", "a", "Uno"), ("fr", "b", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(df, chunk=chunk, stretch=stretch, block=block, held_entries=held) == brute(rows)


def test_odd_rows_and_empty_tables(odd, none):
    rows = [(r[2], r[3], r[1]) for r in odd_rows()]
    assert got(odd, least_docs=1) == brute(rows, least=1)
    assert got(odd) == brute(rows)
    assert divergence.audit(none).collect() == []


def test_bytes_that_are_no_utf8(spark):
    df = spark.range(12).selectExpr("'en' as lang", "cast(id % 2 as string) as source", "cast(unhex('41ff4220c3a9') as string) as text")
    found = divergence.audit(df).collect()
    assert {r.part for r in found} == {"pair"} and len(found) == 2


def test_long_division_is_exact():
    n = np.array([0, 1, 7, 10**12, 10**15])
    for total, kept in ((10**15 + 3, 5), (3 * 10**15, 10**9)):
        assert divergence.shares(n, total, kept).tolist() == [1 + (10**9 * (int(x) + 2)) // (total + 2 * kept) for x in n]
