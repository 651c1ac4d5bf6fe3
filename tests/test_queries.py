import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from sievelake.plans import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf):
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return db


def cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in SQL:
        found = tables.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_planted_signals_are_all_found(spark, sf):
    found = {(r.vendor, r.pattern) for r in QUERIES["detect_text"](spark, sf).collect()}
    assert len(found) == 11


def test_like_lines_are_written_together(spark, tmp_path):
    draw = random.Random(14)
    texts = ["\n".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for _ in range(3)) for _ in range(1500)]  # more than a column's dictionary holds
    rows = [(i, texts[i % 1500] if i != 7 else None, "en" if i % 2 else None) for i in range(6000)]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang"), map(list, zip(*rows)), strict=True))), tmp_path / "documents.parquet")
    QUERIES["markdown_lines"](spark, str(tmp_path)).write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    found.coalesce(1).sortWithinPartitions("doc_id", "line_no").write.parquet(str(tmp_path / "by_id"))
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert size("found") < 0.5 * size("by_id")
    # all lines are there, each with its number
    want = {(r.doc_id, n, line) for r in queries.documents(spark, str(tmp_path)).select("doc_id", "text").collect() for n, line in enumerate(r.text.split("\n") if r.text is not None else [])}
    lines = found.select("doc_id", "line_no", "trailing").collect()
    assert len(lines) == len(want) and {(r.doc_id, r.line_no, r.trailing) for r in lines} == {(i, n, line.rstrip()) for i, n, line in want}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
