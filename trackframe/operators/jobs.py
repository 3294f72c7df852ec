"""Transcription jobs of a stream: load shedding, stale jobs, results, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.timeseries import numbered


def number(jobs: DataFrame, stream: str, order: str, width: float = 600.0) -> DataFrame:
    """Adds ``sequence``: a job's number within its stream, from 1."""
    return numbered(jobs, stream, order, width, "_at").withColumn("sequence", F.col("_at") + 1).drop("_at")


def shed(jobs: DataFrame, stream: str, sequence: str, queue: int = 2, width: float = 4096.0) -> DataFrame:
    """Of the jobs pending at one time the newest ``queue`` of each stream stay: adds ``status`` and ``displaced_older``.

    ``status`` is ``queued`` or ``displaced``; ``displaced_older`` flags a job whose arrival pushed another one out.
    """
    rows = numbered(jobs, stream, sequence, width, "_age", "_all")
    status = F.when(F.col("_all") - F.col("_age") <= queue, "queued").otherwise("displaced")
    return rows.withColumn("status", status).withColumn("displaced_older", F.col("_age") >= queue).drop("_all", "_age")


def stale(jobs: DataFrame, created: Column, now: Column, max_age: float = 6.0) -> DataFrame:
    """Adds ``dropped`` and ``error``: jobs older than ``max_age`` seconds get a result that says so."""
    age = now - created
    text = F.format_string("Discarded: waited %.1f s, more than %.1f s.", age, F.lit(max_age))
    return jobs.withColumn("dropped", age > max_age).withColumn("error", F.when(age > max_age, text))


def stats(jobs: DataFrame, stream: str) -> DataFrame:
    """(stream, submitted, completed, dropped, depth); a failed job counts as completed."""
    return jobs.groupBy(stream).agg(
        F.count("*").alias("submitted"),
        F.count_if(F.col("status").isin("done", "failed")).alias("completed"),
        F.count_if(F.col("status") == "displaced").alias("dropped"),
        F.count_if(F.col("status") == "queued").alias("depth"),
    )


def results(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs joined with their results; ``queue_wait_ms`` truncated to whole milliseconds."""
    return jobs.join(done, keys).withColumn("queue_wait_ms", ((F.col("started") - F.col("created")) * 1000).cast("long"))


def history(results: DataFrame, stream: str, received: str, dropped: str, n: int = 12) -> DataFrame:
    """(stream, position, item..., latest): the newest ``n`` results; a dropped one is never the latest."""
    rank = F.row_number().over(Window.partitionBy(stream).orderBy(F.col(received).desc()))
    newest = F.max(F.when(~F.col(dropped), F.col(received))).over(Window.partitionBy(stream))
    rows = results.withColumn("position", rank).withColumn("latest", F.coalesce(F.col(received) == newest, F.lit(False)))
    return rows.where(F.col("position") <= n)


def session_stats(frames: DataFrame, stream: str, t: str, payload_size: Column, seconds: float, fps: float, max_message: int) -> DataFrame:
    """(stream, received, rejected, buffered_frames, buffered_seconds, evicted): too large messages are rejected, the buffer keeps ``seconds`` at ``fps``."""
    capacity = round(seconds * fps)
    sized = frames.withColumn("_ok", payload_size <= max_message)
    taken = F.row_number().over(Window.partitionBy(stream, "_ok").orderBy(F.col(t).desc()))
    rows = sized.withColumn("_rank", taken).withColumn("_held", F.col("_ok") & (F.col("_rank") <= capacity))
    held_t = F.when(F.col("_held"), F.col(t))
    return rows.groupBy(stream).agg(
        F.count_if("_ok").alias("received"),
        F.count_if(~F.col("_ok")).alias("rejected"),
        F.count_if("_held").alias("buffered_frames"),
        F.coalesce(F.max(held_t) - F.min(held_t), F.lit(0.0)).alias("buffered_seconds"),
        F.greatest(F.lit(0).cast("long"), F.count_if("_ok") - capacity).alias("evicted"),
    )
