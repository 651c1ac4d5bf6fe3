import hashlib
import re

import numpy as np
import pytest

from sievelake.llm import personal, registry
from tests.llm.conftest import odd_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m[0])]


def found(df, **how):
    named = lambda spans: [(personal.KINDS[s.kind], s.start, s.end) for s in spans]
    return [(r.doc_id, named(r.base), named(r.added)) for r in personal.find_personal(df, **how).collect()]


HARD = [
    "a@b.c_x@d.e a@b..c @x.y a@b. é.f@g.h-i.j.", "x@y@z.w a.b@c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.000 1.2.3 1..2.3.4 0255.1.1.1 1.2.3.2560",
    "4111111111111111 4111-1111 1111-1111 4111  1111 1111 1111 41111111111111112 4111 1111 1111 1111 9 4111111111111112", "0000000000000000 5500-0000-0000-0004 1 2-3 4111 1111 1111 1111",
    "+1 (788) 555-0037. +12345678 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++1 555 000 1111 2 +49.30.123456-+1 222 333 4444", "😀+1 (788) 555-0037 😀 x@y.zz 😀 9.9.9.9", "4111111111111111.1.2.3", "",
    "1" * 3000, "a" * 3000 + "@b", "@".join(["a"] * 300) + ".b", "+1" + " " * 2000 + "2", "1 " * 1500, "1." * 1500, "(" * 500 + "+1" * 500, "1:" * 800, "a at b dot " * 200,
]


def test_base_spans_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for i, base, more in found(df):
        assert sorted(base) == sorted(brute(HARD[i])), HARD[i][:80]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in base for b in more)


def test_long_runs_take_no_stack(spark):
    texts = ["1" * 100_000, "1 2-" * 20_000, "a" * 100_000, "a." * 50_000 + "@", "x@" + "y." * 50_000 + "z", "1.2" * 20_000, "+1" + "(" * 100_000, "ab:" * 20_000, "1 (" * 20_000]
    rows = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(rows) == len(texts) and [r[1] for r in rows if r[0] == 4] == [[("email", 0, len(texts[4]))]]


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op13_personal(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in PATTERNS]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)


@pytest.fixture(scope="module")
def learnt():
    """Documents with personal data and with numbers that are none, and others with spellings that no base pattern has."""
    rng = np.random.default_rng(5)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        while not luhn(d := "4" + number(15)):
            pass
        return d

    rows = []
    for i in range(600):
        octets = ".".join(str(x) for x in rng.integers(1, 255, 4))
        good = [f"mail{i}.{number(2)}@host{i % 7}.example.com", octets, card(), f"+1 ({number(3)}) {number(3)}-{number(4)}"][i % 4]
        bad = [f"x{i}@host", f"{number(3)}.{900 + i % 90}.1.2", "9" + number(15), f"20{number(2)}-{10 + i % 3}-{10 + i % 18}"][(i // 4) % 4]
        rows.append((i, f"some words {good} then {bad} and more words"))
    grouped = lambda d, mark: mark.join(d[k : k + 4] for k in range(0, 16, 4))
    other = ["ann.01 (at) host1 (dot) example (dot) com", "bob.02 at host2 dot example dot com", "10[.]20[.]30[.]40", grouped(card(), "."), grouped(card(), " - "), "(212) 555-0123"]
    rows += [(1000 + k, f"some words {x} then more words") for k, x in enumerate(other)]
    clean = ["plain words only", "version 1.2.3 of 2024-01-15", f"n = \"{'1a19e9019a7ceca6f2adb7b9e0121960'}\"", "at 12:30:45 on 01/02/2023", f"number {'9' + '1' * 15} here", "300.400.500.600", "look at this. He was at home"]
    return rows + [(2000 + k, x) for k, x in enumerate(clean)], len(other), len(clean)


def test_trees_add_other_spellings_and_leave_clean_texts(spark, learnt):
    rows, n_other, n_clean = learnt
    got = {i: (base, more) for i, base, more in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    texts = dict(rows)
    assert all(sorted(got[i][0]) == sorted(brute(t)) for i, t in texts.items())
    for i in range(1000, 1000 + n_other):
        assert [texts[i][a:b] for _, a, b in got[i][1]] == [texts[i].removeprefix("some words ").removesuffix(" then more words")], (texts[i], got[i])
    assert all(got[i] == ([], []) for i in range(2000, 2000 + n_clean))
    assert not any(more for i, (_, more) in got.items() if i < 600)


def test_odd_rows_and_empty_tables(spark, odd, none):
    assert sorted(str(r[0]) for r in found(odd)) == sorted(str(r[0]) for r in odd_rows())
    assert personal.find_personal(none).collect() == []
    rows = [(1, None), (None, "x@y.zz 1.2.3.4"), (1, "x@y.zz"), (1, "x@y.zz")]
    assert sorted(map(str, found(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted(map(str, [(i, brute(t or ""), []) for i, t in rows]))
    bad = spark.range(2).selectExpr("id as doc_id", "cast(unhex('ff7840792e7a7aff') as string) as text")
    assert [r[1] for r in found(bad)] == [[("email", 1, 7)]] * 2


def test_thresholds_keep_precision():
    scores, y, n = np.array([3.0, 2.0, 1.0, 0.5, -1.0]), np.array([1, 1, 0, 1, 1.0]), np.ones(5)
    kinds = np.zeros(5)
    assert personal.thresholds(scores, y, kinds, n, 0.9) == [1.5] + [personal.NEVER] * 3
    assert personal.thresholds(scores, y, kinds, n, 0.7)[0] == 0.0


def test_every_held_span_counts_for_the_thresholds(spark, monkeypatch):
    """However few rows the trees get."""
    docs = spark.range(800).selectExpr("id as doc_id", "concat(repeat('word ', int(id % 3)), 'a', repeat('b', int(id % 40)), '@', repeat('c', int(id % 37)), 'x.com and 900.1.2.', id % 200) as text")
    seen = []
    monkeypatch.setattr(personal, "thresholds", lambda scores, y, kinds, weights, precision, real=personal.thresholds: seen.append((kinds, y, weights)) or real(scores, y, kinds, weights, precision))
    personal.find_personal(docs, sample=60).collect()
    held = docs.filter("pmod(xxhash64(text, 13), 4) = 0").count()
    [(kinds, y, weights)] = seen
    assert weights[(kinds == 0) & (y == 1)].sum() == weights[(kinds == 1) & (y == 0)].sum() == held > 60
