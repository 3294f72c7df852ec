"""Decontamination against brute force over all diagonals."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest

from trackframe.llm import decontamination as d
from trackframe.llm.queries import op6_benchmark_decontamination


def brute(docs, items):
    """Pairs (doc, item) with a window of 15 words (or the item's) of which four fifths are equal, at any alignment."""
    out = set()
    for key, text in docs:
        a = re.findall(r"\w+", (text or "").lower())
        for item, own in items:
            b = re.findall(r"\w+", (own or "").lower())
            need = min(len(b), 15)
            for shift in range(-len(b), len(a)):
                if not need:
                    break
                same = [0 <= i + shift < len(a) and a[i + shift] == w for i, w in enumerate(b)]
                inside = [0 <= i + shift < len(a) for i in range(len(b))]
                if any(all(inside[i : i + need]) and sum(same[i : i + need]) >= 0.8 * need for i in range(len(b) - need + 1)):
                    out.add((key, item))
                    break
    return out


def fixture():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=n))) for i, n in enumerate([30, 24, 40, 15, 16, 9, 7, 3, 1, 0])] + [(50, None)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 150)))) for i in range(60)]
    for i in range(60, 100):  # whole items or parts of 15 words at least, up to a fifth substituted
        words = rnd.choice(items[:5])[1].split()
        n = rnd.randint(15, len(words))
        a = rnd.randint(0, len(words) - n)
        part = words[a : a + n]
        for j in rnd.sample(range(n), rnd.randint(0, n // 5)):
            part[j] = "XX"
        docs.append((i, " ".join(rnd.choices(vocabulary, k=30) + [w.upper() + "," for w in part] + rnd.choices(vocabulary, k=9))))
    return docs + [(200, None), (201, ""), (202, items[5][1]), (203, "x " + items[7][1] + ". y")], items


def test_both_joins_equal_brute_force(spark):
    docs, items = fixture()
    want = brute(docs, items)
    assert len(want) > 40
    left = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    sent = d.leaks(left, right).collect()
    shuffled = d.leaks(left, right, broadcast_words=0).collect()
    assert {(r.id, r.item_id) for r in sent} == want
    assert sorted(map(tuple, sent)) == sorted(map(tuple, shuffled))
    assert all(r.similarity >= 0.75 for r in sent)
    kept = d.decontaminate(left, right)
    assert kept.columns == left.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_empty_null_and_repeated(spark):
    docs, items = fixture()
    left = spark.createDataFrame([(None, items[0][1]), (3, items[0][1]), (3, items[0][1])], "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((str(r.id), r.item_id, r.n_words) for r in d.leaks(left, right).collect()) == [("3", 0, 30), ("3", 0, 30), ("None", 0, 30)]
    for a, b in [(left.limit(0), right), (left, right.limit(0))]:
        assert d.leaks(a, b).count() == 0
    assert d.leaks(left.limit(0), right, broadcast_words=0).count() == 0


def all_leaks(docs, items):
    """Pairs (doc, item) by all diagonals of every pair of texts that share enough words."""
    number = {}
    words = lambda t: [number.setdefault(w, len(number)) for w in re.findall(r"\w+", (t or "").lower())]
    own = [(key, words(t)) for key, t in items]
    out = set()
    for key, text in docs:
        a = words(text)
        known = set(a)
        for item, b in own:
            need = min(len(b), 15)
            if not need or sum(w in known for w in b) < math.ceil(0.8 * need - 1e-9):
                continue
            equal = np.array(a)[:, None] == np.array(b)[None, :]
            for shift in range(-len(b), len(a)):
                same = np.diagonal(equal, -shift)
                if len(same) >= need and (np.convolve(same, np.ones(need), "valid") >= 0.8 * need - 1e-9).any():
                    out.add((key, item))
                    break
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = {(r.doc_id, r.item_id) for r in op6_benchmark_decontamination(spark, sf).collect()}
    assert found and found == all_leaks(docs, items)


def test_chance_hits_string_ids_and_large_items_by_both_joins(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [("a", "x y w3 w4 w5 w6 w7 z"), ("b", item), (None, "q " + item), ("c", "the " * 3000), ("d", "the " * 9 + "cat")]
    left = spark.createDataFrame(docs, "doc_id string, text string")
    right = spark.createDataFrame([("i", item), ("j", "the " * 40), ("k", "漢" * 500), ("l", None)], "item_id string, text string")
    want = sorted(map(str, {("b", "i"), (None, "i"), ("c", "j")}))
    ways = [{"broadcast_words": d.BROADCAST_WORDS}, {"broadcast_words": 0}]
    rows = [sorted(map(tuple, d.leaks(left, right, **w).collect()), key=str) for w in ways]
    assert rows[0] == rows[1] and sorted({str(r[:2]) for r in rows[0]}) == want
    for name in ("BROADCAST_BYTES", "BROADCAST_ITEMS"):
        monkeypatch.setattr(d, name, 1)
        assert sorted(map(tuple, d.leaks(left, right).collect()), key=str) == rows[0]
    monkeypatch.undo()
    monkeypatch.setattr(d, "HITS_AT_ONCE", 100)
    index = d.Index([(7, "the " * 40), (8, item)])
    assert {x[0] for x in index.leaks("the " * 300 + item, d.MIN_OVERLAP, d.SIMILARITY)} == {7, 8}


@pytest.mark.parametrize("n", range(1, 16))
def test_every_allowed_substitution_is_found(n):
    words = [f"w{i}" for i in range(n)]
    index = d.Index([(7, " ".join(words))])
    for k in range(n // 5 + 1):
        for changed in combinations(range(n), k):
            text = " ".join(["a", "b", *("XX" if i in changed else w for i, w in enumerate(words)), "c"])
            assert [x[0] for x in index.leaks(text, d.MIN_OVERLAP, d.SIMILARITY)] == [7], changed


def test_other_thresholds_miss_nothing():
    for need, similarity, k in [(8, 0.6, 3), (6, 0.5, 3), (9, 1.0, 0), (15, 0.7, 4)]:
        words = [f"w{i}" for i in range(need)]
        index = d.Index([(7, " ".join(words))], need, similarity)
        for changed in combinations(range(need), k):
            text = " ".join("XX" if i in changed else w for i, w in enumerate(words))
            assert index.leaks(text, need, similarity), (need, changed)


def test_short_items_by_both_joins(spark):
    items = [(i, " ".join(f"q{i}w{j}" for j in range(n))) for i, n in enumerate([5, 6, 7, 10, 11, 12])]
    docs = []
    for i, text in items:
        words = text.split()
        for j in range(len(words)):
            docs.append((len(docs), " ".join(["a", *words[:j], "XX", *words[j + 1 :], "b"]), i))
    left = spark.createDataFrame(docs, "doc_id long, text string, made_of long")
    right = spark.createDataFrame(items, "item_id long, text string")
    for words in (d.BROADCAST_WORDS, 0):
        assert sorted((r.id, r.item_id) for r in d.leaks(left, right, broadcast_words=words).collect()) == [(a, i) for a, _, i in docs]


def test_null_and_repeated_ids_by_both_joins(spark):
    docs, items = fixture()
    left = spark.createDataFrame([(None, items[0][1]), (None, items[1][1]), (3, items[0][1]), (3, items[2][1]), (9, items[2][1])], "doc_id long, text string")
    right = spark.createDataFrame([(None, items[0][1]), (7, items[1][1]), (7, items[2][1]), (None, items[2][1])], "item_id long, text string")
    want = sorted(map(str, [(None, None), (None, 7), (3, None), (3, 7), (3, None), (9, 7), (9, None)]))
    for words in (d.BROADCAST_WORDS, 0):
        assert sorted(str((r.id, r.item_id)) for r in d.leaks(left, right, broadcast_words=words).collect()) == want


def test_repetitions_give_rows_linear_in_their_texts(spark):
    """300 repetitions of a sentence against items that repeat it: a stretch each, by both joins; two passages apart are two."""
    sentence = "the quick brown fox jumps over it "
    docs = [(1, sentence * 300), (2, f"{sentence * 3} {' '.join(f'x{i}' for i in range(50))} {sentence * 3}"), (3, "nothing of that")]
    items = [(i, sentence * (20 + i)) for i in range(20)] + [(90, sentence * 3)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(map(tuple, d.leaks(left, right, **w).collect())) for w in ({}, {"broadcast_words": 0})]
    assert rows[0] == rows[1]
    assert sorted(r[:2] for r in rows[0]) == sorted([(1, i) for i, _ in items] + [(2, i) for i, _ in items for _ in range(2)])
    assert {(r[2], r[4], r[5]) for r in rows[0] if r[:2] == (2, 90)} == {(0, 21, 21), (71, 21, 21)}
    assert {r[4] for r in rows[0] if r[:2] == (1, 5)} == {7 * 25}
