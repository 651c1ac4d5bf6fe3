"""Texts of bytes that aren't UTF-8: defined results, and no job that dies."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from sievelake.llm import divergence, exactdedup, fingerprint, licenses, linededup, mixing, neardup, packing, registry, toxicity, urlfilter, warc
from sievelake.llm.common import new_folder

RAW = [b"plain text, nothing odd about this line", b"latin-1 caf\xe9 and a line of its own\nshared line of words", b"\xff\xfe\x00half of a pair", b"cut short \xf0\x9f\x98", b"shared line of words\nends in \xc3", b"\x80" * 50, b""]


@pytest.fixture(scope="module")
def bad(spark):
    rows = [(i, bytearray(t), "en", "src1", len(t)) for i, t in enumerate(RAW)]
    df = spark.createDataFrame(rows, "doc_id long, raw binary, lang string, source string, n_chars long")
    return df.selectExpr("doc_id", "cast(raw as string) as text", "lang", "source", "n_chars")


def test_operators(spark, bad):
    readable = {i: t.decode("utf-8", "replace") for i, t in enumerate(RAW)}
    assert len(fingerprint.fingerprints(bad).collect()) == len(RAW)
    assert len(mixing.mix(bad, registry.mix_levels(), {}, fraction=1.0, max_epochs=1).selectExpr("doc_id", "mix_epoch").collect()) == len(RAW)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(RAW))], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(bad, labels).collect())
    pieces = packing.pack(bad, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in pieces} == set(readable)
    kept = {r.doc_id: (r.n_lines, r.n_dropped, bytes(r.b)) for r in linededup.dedup_lines(bad).selectExpr("*", "cast(kept_text as binary) as b").collect()}
    assert kept[4] == (2, 1, b"ends in \xc3") and all(kept[i] == (t.count(b"\n") + 1, 0, t) for i, t in enumerate(RAW) if i != 4)
    assert {r.doc_id: r.text_sha256 for r in exactdedup.exact_dedup(bad).collect()} == {i: hashlib.sha256(t).hexdigest() for i, t in enumerate(RAW)}
    assert len(neardup.near_duplicates(bad).collect()) == len(RAW)
    assert divergence.audit(bad, least_docs=1).collect() == []
    assert len(licenses.scan_licenses(registry.license_paths(bad)).select("doc_id").collect()) == len(RAW)


def test_archives_and_urls(spark, bad):
    pages = bad.selectExpr("doc_id as page_id", "concat('http://a.net/es/', text) as url", "text as html")
    folder = new_folder(spark, "warc")
    warc.write(pages, folder)
    found = {r.page_id: (r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in warc.read(spark, folder).collect()}
    assert found == {i: (len(t), hashlib.sha256(t).hexdigest(), t) for i, t in enumerate(RAW)}
    judged = {r.page_id: (r.host, bytes(r.p), r.rule) for r in urlfilter.filter_urls(pages, registry.URL_RULES).selectExpr("*", "cast(path as binary) as p").collect()}
    assert judged == {i: ("a.net", b"/es/" + t.split(b"#")[0].split(b"?")[0], "net/es/") for i, t in enumerate(RAW)}


def test_stages(spark, sf, bad):
    docs = bad
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        # what was kept is kept as it was
        assert name == "packing" or {bytes(r.b) for r in out.selectExpr("cast(text as binary) as b").collect()} <= set(RAW)
        docs = out if name != "packing" else docs
    assert out.count() > 0
