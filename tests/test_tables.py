import pytest

from sievelake.functions import tables


def test_tokens_over_turns(spark):
    tables.register(spark)
    rows = [(1, 0, "a [IN"), (1, 1, "ST] b <s"), (1, 2, ">"), (1, 3, None), (2, 1, "ST] x"), (2, 0, "y [IN"), (3, 0, "<<"), (3, 1, "/S"), (3, 2, "YS"), (3, 3, ">>"), (4, 0, "[INST]"), (4, 1, "[INST]"), (None, 0, "<"), (None, 1, "s>")]
    df = spark.createDataFrame(rows, "c long, t long, words string")
    found = spark.sql("SELECT * FROM turn_tokens(TABLE({df}), 'c', 't', 'words')", df=df)
    assert found.columns == ["c", "started", "ended", "token", "cut"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 0, 1, "[INST]", True), (1, 1, 2, "<s>", True), (2, 0, 1, "[INST]", True), (3, 0, 3, "<</SYS>>", True), (4, 0, 0, "[INST]", False), (4, 1, 1, "[INST]", False), (None, 0, 1, "<s>", True)], key=str)
    assert spark.sql("SELECT * FROM turn_tokens(TABLE({df}), 'c', 't', 'words')", df=df.limit(0)).collect() == []
    with pytest.raises(Exception, match="no such columns: nothing"):
        spark.sql("SELECT * FROM turn_tokens(TABLE({df}), 'c', 't', 'nothing')", df=df)


def test_matches_beside_rows(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "a <s> \U0001f600\U0001f600"), (2, None), (3, "plain")], "id long, text string")
    found = spark.sql("SELECT id, pattern, position, length FROM {df} AS d, LATERAL text_matches(d.text)", df=df)
    assert {tuple(r) for r in found.collect()} == {(1, "template-leak", 2, 3), (1, "emoji-burst", 6, 4)}
