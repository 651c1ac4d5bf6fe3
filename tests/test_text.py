import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.functions import detectors, hygiene, markdown
from sievelake.functions.codepoints import HOMOGLYPHS, STRIPPED, SUBSTITUTED
from sievelake.operators import text
from sievelake.options import TextOptions

ODD = st.text(alphabet=st.sampled_from(list("ab Z.\n" + STRIPPED + "".join(SUBSTITUTED) + "".join(HOMOGLYPHS) + "\uff0c\uff21\u26a1\U0001f600\u00e9\u0416\ufe0f<>thinkTHINK[]/INSs")), max_size=40)


@pytest.mark.parametrize("given_,cleaned,items", [("Hel\u200blo", "Hello", 1), ("The quick brown fox.", "The quick brown fox.", 0), ("Привет мир", "Привет мир", 0), ("", "", 0), ("\u2026\u2014", "...-", 2), ("\ufb01\uff21", "fiA", 1)] + [(f"a{c}b", "ab", 1) for c in STRIPPED])
def test_hygiene(given_, cleaned, items):
    out, log, confidence = hygiene.clean(given_)
    assert out == cleaned and len(log) == items
    assert confidence == (min(1.0, 0.5 + 0.05 * items) if items else 0.0)


def test_positions_are_utf16():
    assert hygiene.clean("\U0001f600\u200bx\u2014")[1][:2] == [("unicode-strip", 2, 1, "Zero-Width Space"), ("unicode-substitute", 4, 1, "U+2014 to '-'")]
    assert [m[3:] for m in detectors.find("\U0001f600\u200b\u200b")] == [(2, 2)]


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_hygiene_leaves_nothing_and_is_idempotent(t):
    out, _, _ = hygiene.clean(t)
    assert not set(out) & set(STRIPPED) and not set(out) & set(SUBSTITUTED)
    assert hygiene.clean(out)[0] == out


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_candidates_cover_all_matches_and_removers_end_them(t):
    if detectors.find(t):
        assert detectors.regex.search(detectors.plain(f"{detectors._ANY}|{detectors._THINK}|{detectors._TOKENS}"), t)
    for vendor in ("OpenAI", "Gemini", "Mistral"):
        out = detectors.REMOVERS[vendor](t)
        assert vendor == "Mistral" or not detectors.find(out, (vendor,))
        assert detectors.find(t, (vendor,)) or out == t or vendor != "Mistral"


CASES = [
    ("Claude", "zero-width-sequence", "word\u200b\u200cword", 1, "wordword"),
    ("Claude", "homoglyph-substitution", "b\u0430d", 1, "bad"),
    ("Claude", None, "Сон", 0, "Сон"),
    ("Gemini", "synthid-token-marker", "word \u200b word", 1, "word  word"),
    ("Gemini", "variation-selector", "a\ufe0f\ufe0eb", 1, "ab"),
    ("OpenAI", "mid-stream-joiner", "word\u2060word", 1, "wordword"),
    ("OpenAI", None, "\ufeffword", 0, "word"),
    ("OpenAI", "bidi-override", "a\u202eb\u202c", 2, "ab"),
    ("DeepSeek", "reasoning-block", "<think>a</THINK>b", 2, "ab"),
    ("DeepSeek", "fullwidth-punctuation", "Hello\uff0cworld", 1, "Hello,world"),
    ("DeepSeek", "fullwidth-punctuation", "tilde like\uff5ethis", 1, "tilde like~this"),
    ("DeepSeek", None, "\u4f60\uff0c\u597d", 0, "\u4f60\uff0c\u597d"),
    ("Grok", "emoji-burst", "\u26a1\u26a1\u26a1\u26a1hello", 1, "\u26a1hello"),
    ("Grok", "em-dash-cluster", "well\u2014\u2014\u2014that's odd", 1, "well\u2014that's odd"),
    ("Grok", None, "one \u26a1 and \u2014 dash", 0, "one \u26a1 and \u2014 dash"),
    ("Grok", None, "\U0001f600", 0, "\U0001f600"),
    ("Grok", "emoji-burst", "\U0001f600\U0001f600", 1, "\U0001f600"),
    ("Mistral", "template-leak", "[INST]hi[/INST]", 2, "hi"),
    ("Mistral", "template-leak", "a[INST]b", 1, "a b"),
    ("Mistral", "template-leak", "<<SYS>>x<</SYS>> <s>y</s>", 4, "x y"),
    ("Mistral", None, "[inst]", 0, "[inst]"),
]


@pytest.mark.parametrize("vendor,pattern,t,n,cleaned", CASES)
def test_detectors(vendor, pattern, t, n, cleaned):
    found = detectors.find(t, (vendor,))
    assert len(found) == n and all(m[1] == pattern for m in found)
    assert detectors.REMOVERS[vendor](t) == cleaned


def test_counts_agree_with_matches(spark):
    texts = [c[2] for c in CASES] + ["x\u200b", "\u200bx", "\u0430b\u0430", "\uff21a\uff22", "\u26a1\u200d\u26a1", "\u200d\u26a1", "", None, "e\u0301\u200b!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    for r in df.select("id", "t", detectors.counts(F.col("t")).alias("c")).collect():
        for d in detectors.DETECTORS:
            assert r.c[d.name] == (None if r.t is None else sum(m[:2] == (d.vendor, d.pattern) for m in detectors.find(r.t))), (r.t, d.name)


def test_clean_text(spark):
    df = spark.createDataFrame([(1, "Hello\u200bworld"), (2, "[INST]  hi"), (3, None), (4, ""), (5, "plain  text"), (6, "b\u0430d")], "id long, text string")
    rows = {r.id: r for r in text.clean_text(df, options=TextOptions(collapse_whitespace=True)).collect()}
    assert [rows[i].clean_text for i in range(1, 7)] == ["Helloworld", " hi", None, "", "plain text", "bad"]
    assert rows[2].clean_confidence == 0.99 and [d.pattern for d in rows[2].clean_detections] == ["template-leak"]
    assert rows[4].clean_removed == [] and rows[3].clean_removed is None and len(rows[6].clean_source_sha256) == 64
    off = {r.id: r.clean_text for r in text.clean_text(df, options=TextOptions(unicode=False, vendors=False)).collect()}
    assert off == {r.id: r.text for r in df.collect()}


def test_registered_functions(spark):
    from sievelake.plans.register import register

    names = register(spark)
    assert {"clean_text", "clean_markdown", "clean_metadata", "detect_text", "detect_markdown", "detect_regions", "inspect_metadata", "classify"} <= set(names)
    assert spark.sql("SELECT size(detect_text('<think>'))").first()[0] == 1
    t = "a\u200bb\u2014\u2019c\u2026 \u00a0"
    row = spark.createDataFrame([(t, "x/Y.JPG")], "t string, p string").createOrReplaceTempView("odd_texts") or spark.sql("SELECT strip_invisible(t) a, count_invisible(t) n, substitute_punctuation(t) b, clean_text(t).cleaned c, clean_markdown('# h').cleaned d, classify(p) e, classify('a.b/c') f, inspect_metadata(unhex('00'), '.png').error_code g FROM odd_texts").first()
    assert tuple(row) == ("ab\u2014\u2019c\u2026 \u00a0", 1, "a\u200bb-'c...  ", "ab-'c...  ", "h\n", "metadata", "text", "METADATA_STRIP_FAILED")


def test_code_keeps_all_but_invisible(spark):
    from sievelake.functions.markdown import code_invisible

    assert spark.createDataFrame([("c\u200bo\ufffed\u2014e",)], "t string").select(code_invisible(F.col("t"))).first()[0] == "co\ufffed\u2014e"


ODD_SCHEMA = "text string, _cleaned string, _m string, match string, vendor string, clean_text string, id long"


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([("a\u200b\u200cb", "1", "2", "3", "4", "5", 6)], ODD_SCHEMA)
    (r,) = text.clean_text(df).collect()
    assert (r._cleaned, r._m, r.match, r.vendor, r.id, r.clean_text) == ("1", "2", "3", "4", 6, "ab")
    found = text.detect_text(df)
    assert found.columns == ["_cleaned", "_m", "clean_text", "id", "match", "vendor", "pattern", "confidence", "position", "length"]
    r = found.filter("pattern = 'zero-width-sequence'").first()
    assert (r._cleaned, r._m, r.vendor, r.position, r.length) == ("1", "2", "Claude", 1, 2)


def test_bytes_that_are_no_utf8(spark):
    raw = [b"plain", b"caf\xe9 [INST]", b"\xff\xe2\x80\x8b\xe2\x80\x8bx", b"# h\xc3\n"]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(raw)], "id long, raw binary").selectExpr("id", "cast(raw as string) as text")
    out = {r.id: r.clean_text for r in text.clean_text(df).collect()}
    assert out[0] == "plain" and out[1] == "caf\ufffd " and out[2] == "\ufffdx"
    assert {(r.id, r.pattern, r.position) for r in text.detect_text(df).collect()} >= {(1, "template-leak", 5), (2, "zero-width-sequence", 1)}
    rows = df.select(markdown.clean_markdown(F.col("text")).alias("m"), markdown.detect_markdown(F.col("text")), markdown.markdown_segments(F.col("text"))).collect()
    assert len(rows) == 4
    assert text.normalise(df).count() == text.removal_log(df).join(df, "id", "right").select("id").distinct().count() == 4


@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=40))
def test_quick_check_lets_no_change_pass(t):
    if not re.search(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", hygiene.QUICK_CLASS), t):
        assert unicodedata.normalize("NFKC", t) == t


def test_quick_check_leaves_common_letters_in_the_engine():
    quick = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", hygiene.QUICK_CLASS))
    assert not quick.search("Ça où à l'été, größer, señor, Привет, 漢字") and all(quick.search(c) for c in ("\uff21", "\ufb01", "e\u0301", "\u00bd", "\u1161", "\U0001d400", "\u00a0", "\u2026"))


def test_registry_goes_to_executors(spark):
    """Detectors and removers of the caller's are found by all operators; a table of thousands costs one pass."""
    mine = detectors.REGISTRY.with_detectors(detectors.Detector("Mine", "shout", 0.3, "!{3,}"), detectors.Detector.of_literal("Mine", "note", 0.2, "50% [x]"), removers={"Mine": lambda t: t.replace("!!!", "!")})
    df = spark.createDataFrame([(0, "so!!! 50% [x] \U0001f600 50% [x]"), (1, "no <s>"), (2, None), (3, "")], "id long, text string")
    want = {(0, "Mine", "shout", 2, 3), (0, "Mine", "note", 6, 7), (0, "Mine", "note", 17, 7), (1, "Mistral", "template-leak", 3, 3)}
    assert {(r.id, r.vendor, r.pattern, r.position, r.length) for r in text.detect_text(df, registry=mine).collect()} == want
    assert {(r.vendor, r.pattern, r.matches, r.texts) for r in text.signal_counts(df, [], registry=mine).collect()} == {("Mine", "shout", 1, 1), ("Mine", "note", 2, 1), ("Mistral", "template-leak", 1, 1)}
    out = {r.id: r for r in text.clean_text(df, registry=mine).collect()}
    assert out[0].clean_text.startswith("so! 50%") and {d.vendor for d in out[0].clean_detections} == {"Mine"} and out[2].clean_text is None
    # many of them, as a table
    many = spark.range(3000).selectExpr("'T' as vendor", "concat('p', id) as pattern", "0.5 as confidence", "concat('word', id, ';') as literal")
    wide = detectors.REGISTRY.with_table(many)
    texts = spark.createDataFrame([(i, f"xword{i};word{i + 1}; word{i}; [INST]") for i in range(0, 2000, 100)], "id long, text string")
    found = {(r.id, r.pattern, r.position) for r in text.detect_text(texts, registry=wide).filter("vendor = 'T'").collect()}
    assert found == {x for i in range(0, 2000, 100) for x in ((i, f"p{i}", 1), (i, f"p{i + 1}", 1 + len(f"word{i};")), (i, f"p{i}", 2 + len(f"word{i};word{i + 1};")))}
    counted = {(r.pattern, r.matches, r.texts) for r in text.signal_counts(texts, [], registry=wide).collect()}
    assert counted == {("template-leak", 20, 20)} | {x for i in range(0, 2000, 100) for x in ((f"p{i}", 2, 1), (f"p{i + 1}", 1, 1))}
    with pytest.raises(ValueError, match="same pattern"):
        mine.with_detectors(detectors.Detector("Mine", "shout", 0.1, "x"))
    with pytest.raises(ValueError, match="more than"):
        detectors.REGISTRY.with_table(many, most=10)


def test_places_without_python(spark):
    """The expressions give the rows that Python gives, in UTF-16 units, on texts of all marks; no Python node is in the plan."""
    rng = random.Random(6)
    alphabet = list("ab Z.<[\n" + "\u200b\u2060\ufeff\u202a\ufe0f\u0430\uff0c\u26a1\u2014\U0001f600\u00e9\u0416\u200d")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) + rng.choice(["", "<think>", "</s>[INST]", "\u2014\u2014\u2014", "\u26a1\u200d\u26a1x"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, None, "", "\u2014\u2014\u2014 " * 1000])), "id long, text string")
    found = text.detect_text(df)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    want = {i: detectors.find(t) for i, t in enumerate(texts)}
    got = {}
    for r in found.filter("id < 300").orderBy("id", "match").collect():
        got.setdefault(r.id, []).append((r.vendor, r.pattern, r.confidence, r.position, r.length))
    assert got == {i: m for i, m in want.items() if m} and len(got) > 200
    assert found.filter("id = 302").count() == 1000


def test_results_leave_python_in_slices(spark):
    from collections.abc import Iterator

    import pandas as pd

    from sievelake.functions.vectorised import SLICE, in_slices

    seen = []

    def lengths(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            seen.append(len(a))
            yield a.str.len() + b

    n = 3 * SLICE + 1
    batches = [(pd.Series(["ab"] * n), pd.Series(range(n))), (pd.Series(["c"]), pd.Series([0]))]
    assert pd.concat(in_slices(lengths)(iter(batches))).tolist() == [2 + i for i in range(n)] + [1] and seen == [SLICE] * 3 + [1, 1]
    docs = spark.range(n).repartition(1).select(F.col("id"), F.concat(F.lit("aа​ "), F.col("id").cast("string")).alias("text"))
    rows = docs.select("id", detectors.removers("Claude", "Gemini")(F.col("text")).alias("r"), detectors.remover("Claude")(F.col("text")).alias("one"), detectors.remover("Gemini")(F.when(F.col("id") > 5, F.col("text"))).alias("some")).collect()
    assert all(r.r["Claude"] == r.one == f"aa {r.id}" and r.r["Gemini"] == f"aа {r.id}" and r.some == (r.r["Gemini"] if r.id > 5 else None) for r in rows)
    plan = docs.select(*[detectors.removers("Claude", "Grok")(F.col("text"))[v] for v in ("Claude", "Grok")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_other_vendors_read_nothing(spark):
    registry = detectors.REGISTRY.with_detectors(detectors.Detector.of_literal("Editor", "heading", 0.5, "# Head"), detectors.Detector("Editor", "rule", 0.4, r"\*{3,}"))
    docs = spark.createDataFrame([(1, "# Head ​​ ****"), (2, "a​​b"), (3, None), (4, "x *** y # Head # Head")], "id long, text string")
    whole = text.detect_text(docs, registry=registry).filter("vendor = 'Editor'").drop("match")
    own = text.detect_text(docs, registry=registry.only("Editor")).drop("match")
    assert sorted(map(str, own.collect())) == sorted(map(str, whole.collect())) and own.count() == 5
    assert "Mistral" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_found_once_for_each_text(spark):
    found = text.detect_text(spark.createDataFrame([(1, "a​​b"), (2, "plain"), (3, None)], "id long, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("bidi-override") == 1
    assert [r.id for r in found.collect()] == [1]


def test_narrowed_class_is_the_quick_one(spark):
    """Each character of the basic plane but surrogates, and some beyond; most text needs no look at all spans."""
    chars = [(chr(c),) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1F600, 0x1F650)]]
    points = spark.createDataFrame(chars, "c string")
    assert points.filter(F.rlike("c", F.lit(hygiene.QUICK_CLASS)) != hygiene.may_change(F.col("c"))).count() == 0
    assert hygiene.QUICK_NARROWED.startswith(r"[[^\x{0}-\x{9F}\x{BF}-\x{131}]&&") and points.filter(hygiene.may_change(F.col("c"))).count() > 5000


def test_cleaning_a_long_text_looks_at_odd_characters_only(monkeypatch):
    """Names are asked for the characters that go or are replaced, not for each of the text."""
    asked = []

    class Names(dict):
        def __contains__(self, c):
            asked.append(c)
            return super().__contains__(c)

    monkeypatch.setattr(hygiene, "STRIP_NAMES", Names(hygiene.STRIP_NAMES))
    cleaned, log, _ = hygiene.clean("​" + "é" * 5000 + "\U0001f600—" + "é" * 5000 + "​")
    assert cleaned == "é" * 5000 + "\U0001f600-" + "é" * 5000 and [x[1] for x in log] == [0, 5003, 10004] and len(asked) == 3
