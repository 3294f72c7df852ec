"""The offline path of a clip: resampled frames, filled and smoothed points, cropped patches, one outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.operators import nbest, pixels, timeseries
from trackframe.params import Preprocessing
from trackframe.streaming import scorers


def sampled(frames: DataFrame, clip: str, t: str, points: str, p: Preprocessing = Preprocessing(), width: float = 60.0) -> DataFrame:
    """(clip, n, source_t, detected, the other columns): frames on the grid of ``p.target_fps``, at most ``p.max_frames`` of a clip, ``points`` filled and smoothed.

    ``points`` is an array of x, y, x, y, ... or null where nothing was detected; a clip without any keeps nulls. ``width`` is in the unit of ``t``.
    """
    row = F.struct(*(c for c in frames.columns if c not in (clip, t)))
    rows = timeseries.resample(frames.withColumn("_row", row), clip, t, "_row", p.target_fps, width, p.max_frames)
    rows = rows.select(clip, "n", "source_t", "_row.*").withColumn("detected", F.col(points).isNotNull())
    rows = timeseries.interpolate(rows, clip, "n", points, p.target_fps * width)
    found = F.col(points).isNotNull()
    smooth = timeseries.smooth(rows.where(found), clip, "n", points, p.smoothing, p.target_fps * width)
    return smooth.unionByName(rows.where(~found))


def patches(rows: DataFrame, points: str, p: Preprocessing = Preprocessing()) -> DataFrame:
    """``sampled`` frames with their images cut to ``p.crop`` pixels around the middle of ``points``, and ``error``."""

    def middle(axis: int) -> Column:
        own = F.filter(points, lambda _, k: k % 2 == axis)
        return F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / F.size(own)

    return pixels.crop(rows.withColumn("_x", middle(0)).withColumn("_y", middle(1)), "_x", "_y", p.crop).drop("_x", "_y")


def transcripts(cut: DataFrame, clip: str, factory: Callable[[], scorers.Scorer], p: Preprocessing = Preprocessing()) -> DataFrame:
    """(clip_id, total_frames, detection_ratio, mouth_detected, text, error) of every clip of ``patches``.

    A clip of too few frames or detections is not scored; a scorer's exception is the clip's error.
    """
    summary = nbest.clip_summary(cut, clip, F.col("detected"), F.col("error").isNull(), F.lit(p.target_fps)).withColumn("clip_id", F.col(clip).cast("string"))
    fit = (F.col("detection_ratio") >= p.min_detection_ratio) & (F.col("total_frames") >= p.min_frames)
    wanted = summary.where(fit).select(F.col(clip).alias("_clip"))
    own = cut.join(wanted, F.col(clip).eqNullSafe(F.col("_clip")), "left_semi")
    scored = scorers.transcribe(own, clip, "n", factory, p.max_frames).select(F.col("clip_id").alias("_id"), "hypotheses", F.col("error").alias("_error"))
    rows = summary.join(scored, F.col("clip_id").eqNullSafe(F.col("_id")), "left")
    ended = nbest.outcome(F.col("detection_ratio"), F.col("total_frames"), F.lit(True), F.coalesce(F.size("hypotheses"), F.lit(0)), p)
    rows = rows.withColumn("_o", ended)
    return rows.select("clip_id", "total_frames", "detection_ratio", "_o.mouth_detected", F.get("hypotheses", F.lit(0))["text"].alias("text"), F.coalesce("_error", "_o.error").alias("error"))
