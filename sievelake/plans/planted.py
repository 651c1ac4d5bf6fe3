"""Signals planted in the tables, by the same expression in Spark and in DuckDB.

The tables hold none of the signals that the detectors look for, so a query over them as they are would
pass on nothing. Twelve kinds of snippet stand before the texts, by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = 12
MARKDOWN = (
    "# Head\n* item\n+ two\n- \n***\n[//]: # (note)\n**bold** [l](u) ![i](s) <b>t</b> @user x #tag\n> q\n- [ ] todo\n| a | b |\n|---|---|\n\u2500\u2500\u2500\u2500\n"
    "```py\nco\u200bde @x\n```\n<!-- c\nd -->\nAs an AI language model, I say.\n"
)
SNIPPETS = {
    0: "Hel\u200blo\u00ad w\u2060orld\ufeff and \u202eabc\u202c. ",
    1: "\u201cQuoted\u201d \u2013 dash \u2014 and\u2026 \u2018single\u2019\u00a0x\u2033  two ",
    2: "[INST] hi [/INST]<s>x</s> <<SYS>>y<</SYS>> ",
    3: "<think>why</THINK> a <thinking b ",
    4: "well\u2014\u2014\u2014that \u26a1\u26a1\u26a1 odd \u2600\u200d\u2600 \u26a1 ",
    5: "b\u0430d p\u0430ss \u0410\u0411 \u03bfk ",
    6: "Hello\uff0cworld tilde\uff5ex \uff01 ",
    7: "a\ufe0fb word\u200b\u200cword x \u200b y ",
    8: MARKDOWN,
    9: "\u200btext\u2060 \u2066iso\u2069 ",
    10: "---\ntitle: x\n---\nbody\n\n---\nGenerated with Claude Code\n",
}


def planted(key: Column, text: Column) -> Column:
    snippet = F.lit("")
    for k, s in SNIPPETS.items():
        snippet = F.when(F.pmod(key, F.lit(KINDS)) == k, F.lit(s)).otherwise(snippet)
    return F.concat(snippet, text)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def planted_sql(key: str, text: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {quoted(s)}" for k, s in SNIPPETS.items())
    return f"(CASE {key} % {KINDS} {whens} ELSE '' END || {text})"


def planted_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", planted(F.col("doc_id"), F.col("text")))


DOCUMENTS_SQL = f"planted AS (SELECT doc_id, lang, source, {planted_sql('doc_id', 'text')} AS text FROM documents)"
