import random

import pytest

from sievelake.functions import markdown
from sievelake.functions.markdown import clean, detect, segments
from sievelake.options import MarkdownOptions


def md(t, **o):
    return clean(t, MarkdownOptions(**o))[0]


@pytest.mark.parametrize("t,out", [
    ("# Title\ntext", "Title\ntext\n"), ("a\r\nb\rc", "a\nb\nc\n"), ("---\ntitle: x\n---\nbody", "body\n"), ("x <!-- a\nb --> y", "x  y\n"),
    ("[//]: # (note)\nx", "x\n"), ("a\n***\nb", "a\nb\n"), ("a\n- - -\nb", "a\nb\n"), ("![i](s) x", " x\n"), ("<b>t</b>", "t\n"), ("* a\n+ b", "- a\n- b\n"),
    ("hi @user and #tag a@b", "hi  and  a@b\n"), ("- \nx", "x\n"), ("\u2500\u2500\u2500\u2500\nx", "x\n"), ("a\n\n\n\nb", "a\n\nb\n"), ("a   \t", "a\n"),
    ("body\n\n---\nGenerated with Claude Code\nmore\nand more", "body\n"), ("As an AI language model, I say\nkept", "kept\n"), ("I cannot say\nx", "x\n"),
    ("\u041f\u0440\u0438\u0432\u0435\u0442", "\u041f\u0440\u0438\u0432\u0435\u0442\n"),
])
def test_defaults(t, out):
    assert md(t) == out


def test_code_is_kept():
    t = "x\n```py\n# not a heading @user\nco\u200bde\n```\ny\n~~~~\n```\n~~~\n~~~~ \nz\n   ```\nopen"
    out, report, found, kept, _ = clean(t)
    assert out == t.replace("\u200b", "") + "\n" and found == kept == 3
    assert [a[0] for a in report.artifacts] == ["code-block-invisible"]
    assert "```" not in md(t, strip_code_fences=True).splitlines()[1]


def test_off_by_default():
    t = "> q\n- [ ] todo\n- [x] \n| a | b |\n|---|---|\n**b** `c` [l](u)"
    assert md(t) == t.replace("- [x] ", "- [x]") + "\n"
    out = clean(t, MarkdownOptions.strip_all())[0]
    assert out == "q\n- todo\na  b\nb c l\n"


def test_segments():
    s = segments("a\n```\nb\n```\nc")
    assert [(x.fence, x.closing, x.lines) for x in s] == [(None, None, ["a"]), ("```", "```", ["b"]), (None, None, ["c"])]
    assert segments("````\n```\n````x\n````")[0].lines == ["```", "````x"]


def test_detect():
    t = "a\n\u2500\u2500\u2500\n```\nx\u200b\n```\nAs an AI model, no\nWritten by ChatGPT"
    assert detect(t) == [("invisible-separator", "Box-drawing line", 2, 0), ("code-block-invisible", "Invisible character in code", 4, 0), ("ai-signature", "Signature of an AI tool", 0, 0), ("ai-boilerplate", "Disclaimer of an AI tool", 0, 0)]


def test_long_tail_after_a_signature(spark):
    t = "body\nGenerated with Claude\n" + "line\n" * 50_000
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(markdown.without_signature(markdown.F.col("t")).alias("x")).first().x == "body\n" == md(t)


def test_columns(spark):
    df = spark.createDataFrame([("# a",), (None,)], "t string")
    rows = df.select(markdown.clean_markdown(markdown.F.col("t")).alias("m"), markdown.detect_markdown(markdown.F.col("t")).alias("d"), markdown.markdown_segments(markdown.F.col("t")).alias("s")).collect()
    assert rows[0].m.cleaned == "a\n" and rows[1].m.cleaned is None and rows[1].d is None and len(rows[0].s) == 1


def test_findings_without_python(spark):
    """The fold over lines gives what the segmenter gives, whatever opens, closes or doesn't close fences."""
    rng = random.Random(9)
    lines = ["```", "````", "~~~", "   ```py", "    ```", "``` x", "```\t ", "~~~~ ", "te​xt", "a­b", "────", " │x││ ", "plain", "", "As an AI language model, I say.", "I cannot do", "Generated with Claude", "---", "`~`", "─── "]
    texts = [rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(lines) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate([*texts, None, "", "x​\n```\ny​\n" * 3000])), "id long, text string")
    found = df.select("id", markdown.detect_markdown(markdown.F.col("text")).alias("a"))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    got = {r.id: r.a if r.a is None else [tuple(x) for x in r.a] for r in found.collect()}
    assert got == dict(enumerate([*map(markdown.detect, texts), None, [], markdown.detect("x​\n```\ny​\n" * 3000)]))
    assert sum(map(bool, got.values())) > 200
