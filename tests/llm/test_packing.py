"""Packing: ids against the tokenizer's own library, gapless sequences, few of them."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from trackframe.llm import packing
from trackframe.llm.queries import op4_best_fit_packing
from trackframe.llm.tokens import added_tokens, ids_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def holds(rows, limit=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= limit
    return len(by)


def test_ids_equal_the_other_library():
    t = reference_tokenizer()
    for text in ["", " ", "a  b\n\n c\t", "<|endoftext|> x", "Größe 𝒳 漢字   don't we'll", "0123456789" * 50, "ab" * 5000, "\x00\x1f"]:
        assert ids_of(text, *RANKS).tolist() == t.encode(text, add_special_tokens=False).ids


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = op4_best_fit_packing(spark, sf).collect()
    t, want = reference_tokenizer(), {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [2]
        for i, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            want[d.doc_id, i] = (a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    total = sum(n for _, n, _ in want.values())
    assert holds(rows) <= 1.02 * -(-total // 1024) + 1


def test_cut():
    assert packing.cut(0, 4) == []
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rnd = np.random.default_rng(3)
    lengths = [int(n) for n in rnd.integers(1, 33, 2000)] + [7] * 900
    capacity = packing.Capacity(max_tokens=32, max_documents=5, max_cost=400 if rule == "dot" else 1024, rule=rule)
    lengths = [n for n in lengths if n * n <= capacity.max_cost]
    pieces = spark.createDataFrame([(i if i % 9 else None, 0, 0, n, 1) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, capacity).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    holds(rows, 32)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(x) <= 5 and sum(n * n for n in x) <= capacity.max_cost for x in by.values())
    assert packing.pack(pieces.limit(0), capacity).count() == 0
    with pytest.raises(ValueError):
        packing.plan_bins({40: 1}, capacity)


def test_nulls_repeats_and_whole_sequences(spark):
    long = "word " * 3000
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "x", 1), (2, "", 1), (3, long, 2)], "doc_id long, text string, piece int")
    pieces = packing.token_pieces(docs, *RANKS, with_ids=True)
    packed = packing.pack(pieces.where("true"))
    rows = packed.collect()
    assert sum(r.length == 1 and r.id == 1 for r in rows) == 2
    holds(rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)
    assert packing.token_pieces(docs.limit(0), *RANKS).count() == 0


def test_added_tokens_equal_the_other_library_by_default(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  <|endoftext|> ", "a <|endoftext|", "<|ENDOFTEXT|>", "<<|endoftext|>>\n\n", "plain"]
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    for text in texts:
        assert ids_of(text, *RANKS, added).tolist() == t.encode(text, add_special_tokens=False).ids
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, x in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in op4_best_fit_packing(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()} == want


def test_ranks_are_gapless_in_every_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    lengths = [5] * 300 + [1] * 6 + [9] * 7 + [1024]
    pieces = spark.createDataFrame([(i, 0, 0, n, 1) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
    found = {}
    for r in packing._ranked(pieces, {5: 300, 1: 6, 9: 7, 1024: 1}).collect():
        found.setdefault(r.length, []).append(r.rank)
    assert {n: sorted(x) for n, x in found.items()} == {n: list(range(lengths.count(n))) for n in set(lengths)}
