"""Hypotheses of a clip: rescoring, ranking, confidence, alternatives, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.params import Decoding, Preprocessing


def fuse(decoder: Column, ctc: Column, lm: Column, length: Column, p: Decoding = Decoding()) -> Column:
    """Weighted sum of component scores."""
    return decoder * (1 - p.ctc) + ctc * p.ctc + lm * p.lm + length * p.length


def confidence(score: Column, tokens: Column) -> Column:
    """exp of the score per token, at most 1; 0 without tokens."""
    return F.when(tokens <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.exp(score / tokens)))


def tier(value: Column) -> Column:
    return F.when(value < 0.4, "weak").when(value < 0.6, "warn").otherwise("signal")


def percent(value: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(value * 100 + 0.5).cast("int")


def rank(hypotheses: DataFrame, clip: str, score: str, tie: str, n_best: int = 3) -> DataFrame:
    """The best max(1, n) hypotheses of each clip with ``rank`` from 1; equal scores go by ``tie``."""
    place = F.row_number().over(Window.partitionBy(clip).orderBy(F.col(score).desc(), tie))
    return hypotheses.withColumn("rank", place).where(F.col("rank") <= max(1, n_best))


def best_and_rest(ranked: DataFrame, clip: str, text: str) -> DataFrame:
    """(clip, text, confidence, alternatives): the best, and the others in rank order with 4-digit confidence."""
    item = F.struct("rank", F.col(text).alias("text"), F.bround("confidence", 4).alias("confidence"))
    rows = ranked.groupBy(clip).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    rest = F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0)))
    first = F.col("_all")[0]
    return rows.select(clip, first["text"].alias("text"), first["confidence"].alias("confidence"), F.transform(rest, lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"))).alias("alternatives"))


def clip_summary(frames: DataFrame, clip: str, detected: Column, cropped: Column, fps: Column) -> DataFrame:
    """(clip, total_frames, detected_frames, detection_ratio, duration_s): ratio and duration are 0 where they have no base."""
    rows = frames.groupBy(clip).agg(F.count("*").alias("total_frames"), F.least(F.count_if(detected), F.count_if(cropped)).alias("detected_frames"), F.max(fps).alias("_fps"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return rows.select(clip, "total_frames", "detected_frames", div(F.col("detected_frames"), F.col("total_frames")).alias("detection_ratio"), div(F.col("total_frames"), F.col("_fps")).alias("duration_s"))


def outcome(ratio: Column, total_frames: Column, ready: Column, hypotheses: Column, p: Preprocessing = Preprocessing()) -> Column:
    """(mouth_detected, error): the first failing condition gives the message, null if all hold."""
    seen = ratio >= p.min_detection_ratio
    # The four messages.
    message = (
        F.when(~seen, F.format_string("The mouth was only visible in %d%% of frames, which is too little to read. Face the camera and keep your mouth in view.", F.rint(ratio * 100).cast("int")))
        .when(total_frames < p.min_frames, F.format_string("Clip is %d frames; at least %d are needed.", total_frames, F.lit(p.min_frames)))
        .when(~ready, F.lit("The speech model is not loaded."))
        .when(hypotheses <= 0, F.lit("The model produced no transcript for this clip."))
    )
    return F.struct(seen.alias("mouth_detected"), message.alias("error"))


def result_json(text: Column, confidence_: Column, frames: Column, error: Column, diagnostics: Column) -> Column:
    """One JSON object; empty error and diagnostics are left out."""
    shown = F.when(F.size(diagnostics) > 0, diagnostics)
    return F.to_json(F.struct(text.alias("text"), F.bround(confidence_, 4).alias("confidence"), frames.alias("frames_processed"), F.nullif(error, F.lit("")).alias("error"), shown.alias("diagnostics")))


def merged(*maps: Column) -> Column:
    """Diagnostics of several steps in one map; of equal keys the later one counts."""
    out = maps[0]
    for later in maps[1:]:
        own = later
        out = F.map_concat(F.map_filter(out, lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False))), own)  # noqa: B023
    return out
