"""Parameter sweeps over labelled streams."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.operators import timeseries
from trackframe.operators.segments import segment, segment_counts, walk
from trackframe.params import Segmenting


def settings(statistics: list[str], windows: list[int], starts: list[float], stops: list[float]) -> list[tuple[str, int, float, float]]:
    """All combinations whose stop is below the start."""
    return [x for x in product(statistics, windows, starts, stops) if x[3] < x[2]]


def sweep(motion: DataFrame, stream: str, t: str, aperture: str, label: Column, grid: list[tuple[str, int, float, float]], lengths: Segmenting, width: float = 600.0) -> DataFrame:
    """(statistic, window, start, stop, hits, misses, false_alarms, score), best first.

    ``label`` is true for streams that should have a segment. The energies of all
    (statistic, window) are computed in one order of the frames, and one walk along them
    tries all settings, so no frame is copied for a setting.
    """
    labelled = motion.groupBy(stream).agg(F.bool_or(label).alias("wanted"))
    names = {pair: f"e{i}" for i, pair in enumerate(dict.fromkeys(x[:2] for x in grid))}
    energies = timeseries.motion_energies(motion.select(stream, t, aperture), stream, t, aperture, {name: (window, statistic) for (statistic, window), name in names.items()}, width)
    frames = energies.select(stream, F.col(t).cast("double").alias("t"), *names.values()).where("t is not null")
    found = walk(frames, stream, lengths, [(start, stop, names[statistic, window]) for statistic, window, start, stop in grid])
    hit = found.select(F.col(stream).alias("_s"), "setting").distinct()
    every = labelled.select(F.col(stream).alias("_s"), "wanted", F.explode(F.array(*map(F.lit, range(len(grid))))).alias("setting"))
    out = every.join(hit.withColumn("found", F.lit(True)), ["_s", "setting"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    scored = out.groupBy("setting").agg(
        F.count_if(F.col("wanted") & F.col("found")).alias("hits"),
        F.count_if(F.col("wanted") & ~F.col("found")).alias("misses"),
        F.count_if(~F.col("wanted") & F.col("found")).alias("false_alarms"),
    )
    named = F.array(*(F.struct(F.lit(s).alias("statistic"), F.lit(w).alias("window"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for s, w, a, b in grid))
    scored = scored.select(F.get(named, F.col("setting")).alias("p"), "hits", "misses", "false_alarms").select("p.*", "hits", "misses", "false_alarms")
    return scored.withColumn("score", F.col("hits") - 2 * F.col("false_alarms") - F.col("misses"))


def leaderboard(scored: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` best settings; ties go by the setting itself."""
    return scored.orderBy(F.desc("score"), "false_alarms", F.desc("hits"), "statistic", "window", "start", "stop").limit(n)


def report(motion: DataFrame, stream: str, t: str, aperture: str, energy: str, label: Column, p: Segmenting) -> DataFrame:
    """Per stream: unfitted frames, positive-energy p50 and p90 (0 if none), segments, verdict."""
    stats = motion.groupBy(stream).agg(F.count_if(F.col(aperture).isNull()).alias("unfitted"), F.bool_or(label).alias("wanted"))
    positive = motion.select(F.col(stream).alias("_s"), F.when(F.col(energy) > 0, F.col(energy)).alias("_e"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    spread = timeseries.percentiles(positive, "_s", "_e", {"p50": 0.5, "p90": 0.9})
    stats = stats.join(spread, F.col(stream).eqNullSafe(F.col("_s"))).select(stream, "unfitted", zero("p50"), zero("p90"), "wanted")
    counts = segment_counts(segment(motion, stream, t, energy, p), motion, stream)
    return stats.join(counts, stream).withColumn("right", (F.col("segments") > 0) == F.col("wanted")).drop("wanted")
