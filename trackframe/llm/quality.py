"""Quality classifier by co-training on two views of a document.

One view is the text's content (shares of character classes, repetition, word
lengths, hashed words and byte trigrams), the other the page's metadata (language
and source, nothing that follows from the text). Each view has a logistic
regression. In every round each scores all documents, and what it is confident about
is added, with the label it gives, to the other's training rows. Scores are
calibrated on held-out labelled rows before they count as confident and before the
two views are combined.

Only training rows are bounded: ``TRAIN_ROWS`` labelled rows (those of the lowest
hashes of their ids; the others count as unlabelled) and ``EXCHANGED`` pseudo-labels
of a class and round. They are fitted in one task. Features and scores cover every
document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import materialize, quoted, small_batches

TRAIN_ROWS = 20_000
EXCHANGED = 300
ROUNDS = 3
#: Calibrated probabilities that count as confident.
HIGH, LOW = 0.95, 0.2
THRESHOLD = 0.5
LANG_SLOTS, SOURCE_SLOTS = 8, 32


def _class_of_byte() -> np.ndarray:
    kinds = np.full(256, 7)
    for at, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"?()-", "!", "|", "\n"]):
        kinds[[ord(c) for c in chars]] = at
    kinds[[9, 13, 32]] = 8
    kinds[128:] = 9
    return kinds


_CLASSES = _class_of_byte()
HASHED = 64


def text_view(text: str | None) -> np.ndarray:
    """Content features of a whole text (null: empty)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, total = max(1, len(words)), max(1, len(raw))
    data = np.frombuffer(raw, np.uint8)
    shares = np.bincount(_CLASSES, np.bincount(data, minlength=256), 10) / total
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    longest = max(map(len, words), default=0)
    counts = Counter(words)
    top = max(counts.values(), default=0) / n
    slots = np.fromiter((zlib.crc32(w) % HASHED for w in counts), np.int64, len(counts))
    hashed = np.bincount(slots, np.fromiter(counts.values(), np.float64, len(counts)), HASHED) / n
    wide = data.astype(np.uint32)
    trigrams = (wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA77 + wide[2:] * 0xC2B2AE3D) >> np.uint32(26) if len(wide) > 2 else wide[:0]
    spread = np.bincount(trigrams, minlength=HASHED) / total
    rest = [math.log1p(len(words)), len(raw) / n, repeats, len(counts) / n, math.log1p(longest), top]
    return np.concatenate([shares, rest, hashed, spread]).astype(np.float32)


def meta_view(lang: str | None, source: str | None) -> np.ndarray:
    """Metadata features; a null has a feature of its own."""
    out = np.zeros(LANG_SLOTS + SOURCE_SLOTS + 2, np.float32)
    for value, first, slots, missing in ((lang, 0, LANG_SLOTS, -2), (source, LANG_SLOTS, SOURCE_SLOTS, -1)):
        out[missing if value is None else first + zlib.crc32(value.encode("utf-8", "surrogatepass")) % slots] = 1.0
    return out


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text_view, meta_view[, kept_...]) of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("text_view array<float>, meta_view array<float>")
    def views(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang, source in batches:
            yield pd.DataFrame({"text_view": [text_view(t) for t in text], "meta_view": [meta_view(*x) for x in zip(lang, source, strict=True)]})

    own = views(text_col, F.col(lang_col).cast("string"), F.col(source_col).cast("string"))
    kept = [F.col(quoted(k)).alias(f"kept_{k}") for k in keep]
    return docs.select(F.col(id_col).alias("id"), own.alias("v"), *kept).select("id", "v.*", *(quoted(f"kept_{k}") for k in keep))


@dataclass(frozen=True)
class Linear:
    """A fitted view: log-odds are weights * features + bias, then scaled by the calibration."""

    weights: tuple[float, ...]
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def log_odds(self, view: str) -> Column:
        raw = F.lit(self.bias)
        if self.weights:
            weights = F.array(*map(F.lit, self.weights))
            raw = F.aggregate(F.zip_with(view, weights, lambda x, w: x * w), raw, lambda a, x: a + x)
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), raw * self.scale + self.shift))


def probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method on standardised features; a constant where only one class, or none, is there."""
    n, ones = len(y), float(y.sum())
    if ones in (0.0, float(n)):
        return np.zeros(0), math.log((ones + 1) / (n - ones + 1))
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = np.inf  # a constant feature has no weight
    z = np.concatenate([(x - mean) / scale, np.ones((n, 1))], 1)
    penalty = np.full(z.shape[1], ridge * n)
    penalty[-1] = 1e-9
    w = np.zeros(z.shape[1])
    w[-1] = math.log(ones / (n - ones))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def fit_view(rows: DataFrame, view: str) -> Linear:
    """Fit a view on the rows (label, held_out, and the view) that aren't held out, and calibrate its log-odds on those that are.

    The rows are bounded, so one task takes them.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["label"].to_numpy(np.float64), b["held_out"].to_numpy(bool), np.stack(b[view].to_list()).astype(np.float64)) for b in batches if len(b)]
        if not parts:
            return
        y, held, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        weights, bias = logistic(x[~held], y[~held], 1e-3)
        scale, shift = 1.0, 0.0
        if len(weights):
            odds = np.clip(x[held] @ weights + bias, -12, 12)
            slope, shift = logistic(odds[:, None], y[held], 1e-4)
            scale = float(slope[0]) if len(slope) else 0.0
        yield pd.DataFrame([(weights.tolist(), bias, scale, shift)], columns=["weights", "bias", "scale", "shift"])

    # in a stated order, so that sums don't depend on how rows arrive
    ordered = rows.select("label", "held_out", view).coalesce(1).sortWithinPartitions("held_out", "label", F.xxhash64(view))
    found = ordered.mapInPandas(fit, "weights array<double>, bias double, scale double, shift double").first()
    return Linear(tuple(found.weights), found.bias, found.scale, found.shift) if found else Linear((), 0.0)


@dataclass(frozen=True)
class CoTrained:
    text: Linear
    meta: Linear
    prior: float

    def score(self, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(id, p_text, p_meta, score[, kept_...]): both views' odds over the prior's, as if the views were independent."""
        prior = math.log(self.prior / (1 - self.prior))
        a, b = self.text.log_odds("text_view"), self.meta.log_odds("meta_view")
        return rows.select("id", probability(a).alias("p_text"), probability(b).alias("p_meta"), probability(a + b - prior).alias("score"), *(quoted(f"kept_{k}") for k in keep))


def _told(rows: DataFrame, models: dict[str, Linear]) -> dict[str, DataFrame]:
    """By view, the (label, held_out, text_view, meta_view) that it is confident about: as many of either class as the rarer one has.

    Ties are broken by the hash of the features, equal rows count once. One pass over all documents, which
    keeps ``EXCHANGED`` rows of each view and class in each task.
    """
    chance = F.array(*(F.struct(F.lit(view).alias("view"), probability(model.log_odds(view)).alias("p")) for view, model in models.items()))
    scored = rows.select("text_view", "meta_view", F.explode(chance).alias("c")).select("text_view", "meta_view", "c.*").where((F.col("p") >= HIGH) | (F.col("p") <= LOW))
    scored = scored.withColumn("label", (F.col("p") >= HIGH).cast("double"))
    sure = F.when(F.col("label") > 0, F.round("p", 2)).otherwise(1 - F.round("p", 2))
    order = F.row_number().over(Window.partitionBy("view", "label").orderBy(sure.desc(), F.xxhash64("text_view", "meta_view")))
    best = scored.withColumn("rank", order).where(F.col("rank") <= EXCHANGED)
    best = best.groupBy("view", "label", "text_view", "meta_view").agg(F.min("rank").alias("rank"))
    best = materialize(best.withColumn("rank", F.row_number().over(Window.partitionBy("view", "label").orderBy("rank"))), "confident")
    counts = {(r["view"], r["label"]): r["count"] for r in best.groupBy("view", "label").count().collect()}
    told = {}
    for view in models:
        n = min(counts.get((view, 0.0), 0), counts.get((view, 1.0), 0))
        told[view] = best.where((F.col("view") == view) & (F.col("rank") <= n)).select("label", F.lit(False).alias("held_out"), "text_view", "meta_view")
    return told


def co_train(rows: DataFrame, labels: DataFrame, rounds: int = ROUNDS, train_rows: int = TRAIN_ROWS) -> CoTrained:
    """Fit both views on ``rows`` (id and views) and ``labels`` (id, label of 0 or 1).

    Labels of one id are averaged and those that then tie are left out.
    """
    known = labels.where("label is not null and id is not null").groupBy("id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    known = known.where("label <> 0.5").withColumn("label", F.round("label"))
    # ids first, so that no features are shuffled
    ids = known.join(rows.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(train_rows)
    ids = materialize(ids, "labelled")
    held_out = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)) == 0
    sample = rows.join(F.broadcast(ids), "id").select("label", held_out.alias("held_out"), "text_view", "meta_view")
    sample = materialize(sample.orderBy(F.xxhash64("text_view", "meta_view")).limit(train_rows), "sample")
    unlabelled = rows.join(F.broadcast(ids.select("id")), "id", "left_anti")
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    sets = {"text_view": sample, "meta_view": sample}
    models = {view: fit_view(own, view) for view, own in sets.items()}
    for _ in range(rounds if 0 < ones < n else 0):
        told = _told(unlabelled, models)
        sets = {"text_view": sets["text_view"].unionByName(told["meta_view"]), "meta_view": sets["meta_view"].unionByName(told["text_view"])}
        models = {view: fit_view(own, view) for view, own in sets.items()}
    return CoTrained(models["text_view"], models["meta_view"], (ones + 1) / (n + 2))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, keep: tuple[str, ...] = (), **columns) -> DataFrame:
    rows = materialize(feature_rows(docs, id_col, keep=keep, **columns), "features")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    return co_train(rows.select("id", "text_view", "meta_view"), known).score(rows, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD, **columns) -> DataFrame:
    """(id, p_text, p_meta, score, keep) of every row of ``docs``.

    Null texts count as empty; null metadata has features of its own; null ids
    are scored but never trained on; repeated rows stay. Without labels of both
    classes the score is constant. Other columns are ignored; an empty table
    gives no rows.
    """
    return _scored(docs, labels, id_col, label_col, **columns).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The rows of ``docs`` that are not rejected, whatever their id; all columns stay."""
    scored = _scored(docs, labels, id_col, label_col, tuple(docs.columns), **columns)
    return scored.where(F.col("score") >= threshold).select(*(F.col(quoted(f"kept_{k}")).alias(k) for k in docs.columns))
