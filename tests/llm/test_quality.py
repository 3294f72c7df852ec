"""Co-training: against a plain version, held-out accuracy, edges."""

import math

import numpy as np
from pyspark.sql import functions as F

from trackframe.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(3)) == 0
    scored = quality.classify(docs, labels.where(~apart)).join(labels.where(apart), F.col("id") == F.col("doc_id"))
    rows = scored.select("quality", "keep", "score").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    print(len(good), len(bad), sum(r.keep for r in good), sum(r.keep for r in bad))
    assert sum(r.keep for r in good) > 0.97 * len(good)
    assert sum(not r.keep for r in bad) > 0.9 * len(bad)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 1), (1, "", "en", "a", 3, 1), (None, "some text", "en", "a", 9, 1), (3, "x" * 100_000, "en", None, -1, 2)],
        "doc_id long, text string, lang string, source string, n_chars long, keep int",
    )
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (3, None, 1)], "doc_id long, quality int, label int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == 4
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 4


def test_one_class_and_rare_class(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more words", "en", "a", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.classify(docs, ones).where("keep").count() == 30
    rare = docs.select("doc_id", F.when(F.col("doc_id") == 3, 0).otherwise(1).alias("quality"))
    assert quality.classify(docs, rare).count() == 30


def newton(x, y, ridge):
    """Logistic regression on standardised columns, ridge on the weights."""
    n = len(y)
    spread = x.std(0)
    used = spread > 1e-9
    z = np.c_[(x[:, used] - x[:, used].mean(0)) / spread[used], np.ones(n)]
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (y - p) - ridge * n * np.r_[w[:-1], 0]
        hess = z.T @ (z * (p * (1 - p))[:, None]) + ridge * n * np.diag(np.r_[np.ones(len(w) - 1), 0]) + 1e-10 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        while np.abs(step).max() > 2:
            step /= 2
        w += step
    full = np.zeros(x.shape[1])
    full[used] = w[:-1] / spread[used]
    return full, w[-1] - full @ x.mean(0)


def plain_co_training(rows, label, fold, order):
    """Scores of all rows, with lists instead of tables."""
    views = [np.array([r[v] for r in rows], float) for v in ("text_view", "meta_view")]
    known = np.array([i for i, r in enumerate(rows) if r.id in label])
    y = np.array([label[rows[i].id] for i in known], float)
    held = np.array([fold[rows[i].id] == 0 for i in known])
    rest = [i for i, r in enumerate(rows) if r.id not in label]
    extra = [([], []), ([], [])]
    for turn in range(quality.ROUNDS + 1):
        odds = []
        for v in (0, 1):
            at = [*known[~held], *extra[v][0]]
            w, b = newton(views[v][at], np.array([*y[~held], *extra[v][1]]), 1e-3)
            raw = np.clip(views[v] @ w + b, -12, 12)
            c, d = newton(raw[known[held]][:, None], y[held], 1e-4)
            odds.append(np.clip((views[v] @ w + b) * c[0] + d, -12, 12))
        if turn == quality.ROUNDS:
            break
        for v in (0, 1):
            p = 1 / (1 + np.exp(-odds[v]))
            tops = []
            for good, sure in ((lambda x: x >= quality.HIGH, lambda x: x), (lambda x: x <= quality.LOW, lambda x: 1 - x)):
                own = sorted((-round(sure(round(p[i], 2)), 2), order[rows[i].id], i) for i in rest if good(p[i]))[: quality.EXCHANGED]
                tops.append(list({tuple(views[0][i]) + tuple(views[1][i]): i for *_, i in own[::-1]}.values())[::-1])
            n = min(map(len, tops))
            for k, own in enumerate(tops):
                extra[1 - v][0].extend(own[:n])
                extra[1 - v][1].extend([1 - k] * n)
    prior = (y.sum() + 1) / (len(y) + 2)
    total = odds[0] + odds[1] - math.log(prior / (1 - prior))
    return {r.id: 1 / (1 + math.exp(-t)) for r, t in zip(rows, total, strict=True)}


def test_query_equals_plain_co_training(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 600")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    order, fold = F.xxhash64("text_view", "meta_view").alias("o"), F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)).alias("f")
    rows = quality.feature_rows(docs).select("id", "text_view", "meta_view", order, fold).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    label = {r.id: known[r.id] for r in rows if r.id in known}
    assert 0 < sum(label.values()) < len(label)
    want = plain_co_training(rows, label, {r.id: r.f for r in rows}, {r.id: r.o for r in rows})
    got = {r.id: r.score for r in quality.classify(docs, labels).collect()}
    worst = max(abs(got[i] - want[i]) for i in want)
    print("largest difference", worst)
    assert got.keys() == want.keys() and worst < 1e-3
