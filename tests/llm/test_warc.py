import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest

from sievelake.llm import warc
from sievelake.llm.common import new_folder

SCHEMA = "page_id long, url string, html string, digest string, refers long, page string"


def rows():
    x = "<p>the same page</p>" * 20
    return [(1, "http://a", x, "d", 1, "p"), (2, None, x, None, None, None), (3, "http://b\r\nX: y", None, None, None, None), (4, "u", "small", None, None, None), (5, "u", "small", None, None, None), (None, "n", x, None, None, None), (2, None, x, None, None, None), (9, "é", "ü" * 50, None, None, None), (8, "é", "ü" * 50, None, None, None), (10, "long", "WARC/1.1\r\n\r\n" * 200_000, None, None, None)]


def test_round_trip(spark):
    folder = new_folder(spark, "warc")
    files = warc.write(spark.createDataFrame(rows(), SCHEMA), folder).collect()
    assert sum(f.records for f in files) == len(rows())
    found = warc.read(spark, folder).collect()
    assert len(found) == len(rows())
    by = defaultdict(list)
    for r in found:
        by[r.page_id].append(r)
    want = {p: (h or "").encode() for p, _, h, *_ in rows()}
    for p, got in by.items():
        for r in got:
            assert r.payload_bytes == len(want[p]) and r.payload_digest == hashlib.sha256(want[p]).hexdigest()
            assert bytes(r.payload) == (want[p] if r.record_type == "response" else b"")
    assert {p: {(r.record_type, r.refers_to) for r in got} for p, got in by.items()} == {
        1: {("response", None)}, 2: {("revisit", 1)}, 3: {("response", None)}, 4: {("response", None)}, 5: {("response", None)}, None: {("revisit", 1)}, 8: {("response", None)}, 9: {("revisit", 8)}, 10: {("response", None)},
    }
    assert len(by[2]) == 2


def test_same_pages_make_the_same_files(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    seen = []
    for parts in (3, 7):
        folder = new_folder(spark, "warc")
        files = warc.write(pages.repartition(parts), folder, shards=4, roll_bytes=8_000).collect()
        assert max(f.bytes for f in files) < 60_000 and len(files) > 4
        path = Path(folder.removeprefix("file://"))
        assert not list(path.glob("_temporary*"))
        for f in files:
            assert hashlib.sha256((path / f.file).read_bytes()).hexdigest() == f.sha256
        order = [f for f in sorted(files, key=lambda f: f.file)]
        assert all(a.last_page < b.first_page for a, b in zip(order, order[1:], strict=False))
        seen.append({(f.file, f.sha256) for f in files})
        text = gzip.decompress((path / order[0].file).read_bytes())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert seen[0] == seen[1]


def test_damage_is_noticed(spark):
    folder = new_folder(spark, "warc")
    (f,) = warc.write(spark.createDataFrame(rows()[:1], SCHEMA), folder).collect()
    path = Path(folder.removeprefix("file://")) / f.file
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"same", b"sane")))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, folder).collect()


def test_no_pages(spark):
    folder = new_folder(spark, "warc")
    assert warc.write(spark.createDataFrame([], SCHEMA), folder).collect() == []
    assert warc.read(spark, folder).collect() == []
