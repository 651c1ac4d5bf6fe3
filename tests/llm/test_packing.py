import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sievelake.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(texts):
    t = Tokenizer.from_file(VOCABULARY)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs, length=2048):
    want = dict(zip([d for d, _ in docs], reference_ids([t for _, t in docs]), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(np.asarray(ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, ids in want.items():
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at
            at += n
        assert at == len(ids)
    padding = total = 0
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= 0.01 * total


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, VOCABULARY, block_tokens=20_000).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_partitions_leave_few_small_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(16, "doc_id")
    rows = packing.pack(docs, VOCABULARY).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    size = defaultdict(int)
    for r in rows:
        size[r.sequence_id] += r.length
    assert sum(n < 2048 for n in size.values()) <= 11
    many = packing.pack(docs, VOCABULARY, gather=4, block_tokens=3000).collect()
    check(many, [(r.doc_id, r.text) for r in docs.collect()])


def test_same_ids_as_the_tokenizer():
    e = packing.Encoder(VOCABULARY)
    texts = ["", " ", "a  b", "a \n b", "a\t \tb", "x \t", " lead", "it's we'll 12 345!", "no break space", "<|endoftext|> plain", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  z ", "<|endoftext| >", "é 😀 ü\n\n\n z", "a\n \nb", "tab\t tail ", "  x"]
    for t, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(e.ids(t), "<u4").tolist() == ids[:-1], repr(t)


def test_lowest_cost_with_room_comes_first():
    found = packing.assign(np.array([6, 5, 4, 1]), np.array([8, 8]), 1.0, 0.1)
    assert found[:3] == [(0, 0, 6, 0), (1, 0, 5, 1), (2, 0, 3, 1)] and (2, 3, 1, 0) in found and (3, 0, 1, 0) in found


def test_odd_rows(spark, odd, none):
    rows = packing.pack(odd, VOCABULARY).collect()
    assert sum(r.length for r in rows) == sum(map(len, reference_ids([r.text for r in odd.collect()])))
    assert packing.pack(none, VOCABULARY).collect() == []
