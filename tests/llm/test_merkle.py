import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sievelake.llm import merkle
from tests.llm.conftest import ODD_SCHEMA, odd_rows


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and each leaf's list of (place, siblings) upwards."""
    levels, paths = [leaves], [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(levels[-1]) > 1:
        last = levels[-1]
        for i, a in enumerate(at):
            run = last[a // 8 * 8 : a // 8 * 8 + 8]
            paths[i].append((a % 8, [x for j, x in enumerate(run) if j != a % 8]))
            at[i] = a // 8
        levels.append([h("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return levels[-1][0], paths


def brute(rows, tampered):
    """Rows (doc_id, text, lang, source, n_chars, ...)."""
    known = sorted((("" if r[2] is None else f"+{r[2]}").encode(), (0, 0) if r[0] is None else (1, r[0]), leaf(r, r[1]), leaf(r, tampered(r))) for r in rows)
    groups = [list(g) for _, g in groupby(known, key=lambda x: x[0])]
    trees = [tree([x[2] for x in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), up in zip(groups, trees, above, strict=True):
        for (_, i, own, other), path in zip(g, paths, strict=True):
            acc = other
            for at, siblings in path + up:
                acc = h("".join([*siblings[:at], acc, *siblings[at:]]))
            proof = h("".join(x for _, s in path + up for x in s))
            out.append((str(i[1] if i[0] else None), own, subroot, root, proof, acc, acc == root))
    return sorted(out)


def found(df, **how):
    rows = merkle.manifest(df, **how)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows.select("*", merkle.proof(F.col("path")).alias("proof_sha256")).collect())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 513])
def test_sizes(spark, n):
    """Lone leaves and groups, full runs and short ones, several levels."""
    rows = [(i * 7 % n, f"Text {i}", "en" if i % 4 else "de", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    change = F.when(F.col("doc_id") % 3 == 0, F.lower("text"))
    assert found(df, tampered=change) == brute(rows, lambda r: r[1].lower() if r[0] % 3 == 0 else r[1])


def test_many_groups(spark):
    """More groups than a run holds, so that their tree has levels of its own."""
    rows = [(i, f"t{i}", None if i % 23 == 0 else f"{'äz'[i % 2]}{i % 23}", None, None) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(df) == brute(rows, lambda r: r[1])


def test_odd_rows_and_empty_tables(spark, odd, none):
    """Nulls in any column, the empty string beside null, repeated ids and rows, names that clash."""
    rows = odd_rows()
    got = found(odd, tampered=F.when(F.col("doc_id") % 2 == 0, F.upper("text")))
    assert got == brute(rows, lambda r: r[1].upper() if r[0] is not None and r[0] % 2 == 0 and r[1] is not None else r[1])
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)
    assert merkle.manifest(none).collect() == []
    apart = spark.createDataFrame([(1, None, "", "", None), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(apart) == brute([(1, None, "", "", None), (2, "", None, None, 0)], lambda r: r[1])


def test_bytes_that_are_no_utf8(spark):
    df = spark.range(3).selectExpr("id as doc_id", "cast(unhex('41ff42') as string) as text", "'en' as lang", "'s' as source", "3L as n_chars")
    rows = merkle.manifest(df).collect()
    want = hashlib.sha256(b"1:0" + b"1:s" + b"2:en" + b"1:3" + b"3:A\xffB").hexdigest()
    assert len(rows) == 3 and all(r.verified for r in rows) and want in {r.leaf for r in rows}


def test_schema_has_all_fields():
    assert {"doc_id", "source", "lang", "n_chars", "text"} <= {c.split()[0] for c in ODD_SCHEMA.split(", ")}
