"""Periodic runs: every run against a plain search, the grammar's extensions against comparing words, the query against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from trackframe.llm import periodicity
from trackframe.llm.queries import op12_periodic_runs


def brute(w, shortest=24, repeats=3):
    """(start, length, period) of all runs."""
    found = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(shortest, repeats * p):
                found.setdefault((s, i + p - s), p)  # periods rise: the smallest comes first
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def row(words):
    runs = brute(words)
    kept = [True] * len(words)
    for s, n, p in runs:
        kept[s + p : s + n] = [False] * (n - p)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for w, k in zip(words, kept, strict=True) if k)))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_periodic_runs(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert tuple(r)[1:] == row(planted(r.doc_id, split(docs[r.doc_id]))), r.doc_id


def test_all_runs_of_random_texts():
    rnd = random.Random(1)
    for _ in range(800):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            w = rnd.choices(range(rnd.randint(1, 4)), k=rnd.randint(0, 60))
            if rnd.random() < 0.6 and w:
                q = rnd.randint(1, 9)
                w = w[: rnd.randint(0, len(w))] + w[:q] * rnd.randint(2, 12) + w[rnd.randint(0, len(w) - 1) :]
            texts.append(w)
        texts.sort(key=len, reverse=True)
        shortest, repeats = rnd.choice([2, 6, 24]), rnd.choice([2, 3])
        got = periodicity.find_runs(np.array([x for w in texts for x in w], np.int64), np.array(list(map(len, texts))), shortest, repeats)
        want = [(i, *r) for i, w in enumerate(texts) for r in brute(w, shortest, repeats)]
        assert [tuple(x) for x in got.tolist()] == sorted(want, key=lambda x: (x[0], x[1], x[3])), (texts, shortest, repeats)


def test_extensions_of_the_grammar():
    rnd = random.Random(2)
    for _ in range(200):
        k = rnd.randint(1, 5)
        w = rnd.choices(range(k), k=rnd.randint(2, 90)) + rnd.choice([[], [0] * 40, [0, 1, 1] * 15])
        grammar = periodicity.Grammar(np.array(w, np.int64))
        pairs = [tuple(sorted(rnd.sample(range(len(w)), 2))) for _ in range(60)]
        i, j = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        ahead, back = grammar.extend(i, j, True), grammar.extend(i, j, False)
        for n, (a, b) in enumerate(pairs):
            m = next((d for d in range(len(w) - b) if w[a + d] != w[b + d]), len(w) - b)
            assert ahead[n] == m, (w, a, b)
            m = next((d for d in range(a) if w[a - 1 - d] != w[b - 1 - d]), a)
            assert back[n] == m, (w, a, b)


def test_levels_shrink():
    rng = np.random.default_rng(3)
    for sequence in (rng.integers(0, 50, 5000), np.zeros(5000, np.int64), np.tile(np.arange(7), 700), np.arange(5000)):
        grammar = periodicity.Grammar(sequence)
        assert grammar.symbols[-1].size == 1 and len(grammar.symbols) < 80
        assert sum(s.size for s in grammar.symbols) < 10 * sequence.size


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000)) + " end"
    nbsp = "\u00a0"
    texts = [None, "", "   \t\n", "one", "a " * 23, "a " * 24, "a\x0bb\x0c" * 24, f"x{nbsp}y " * 30, "\x1c " * 30, long, "é 漢 𝒳 " * 9, "a b " * 40 + "c " * 30 + "a b " * 40]
    docs = list(enumerate(texts)) + [(None, "q r " * 20), (None, None), (5, texts[5]), (5, texts[5])]
    frame = spark.createDataFrame([(*x, "n", 1) for x in docs], "doc_id long, text string, id string, n_runs long")
    rows = periodicity.periodic_runs(frame).collect()
    want = sorted(str((i, *row(split(t)))) for i, t in docs if t is not long)
    assert sorted(str(tuple(r)) for r in rows if r.id != 9) == want
    assert [tuple(r)[1:6] for r in rows if r.id == 9] == [(1, 0, 40_000, 977, 40_941)]
    assert periodicity.periodic_runs(frame.limit(0)).count() == 0
    assert periodicity.periodic_runs(frame.where("doc_id IS NULL"), rewrite=periodicity.plant).count() == 2
    named = frame.select(F.concat(F.lit("k"), F.col("doc_id")).alias("doc_id"), "text")
    assert periodicity.periodic_runs(named).count() == len(docs)
