"""Live streams under Structured Streaming: energy, segments, status, tracking, shedding and results.

The stateful operators keep one small record for each stream: the open segment, the
previous aperture and its recent changes, the frame rate, the times that a buffer of
some seconds would hold, the last box. So state does not grow with a stream. Within a
trigger a stream's rows are taken in time order; how many there may be is the source's
limit (``source``), which is also what keeps a fast producer back.

A query needs the RocksDB state store (``ROCKSDB`` as
``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import jobs
from trackframe.operators.segments import Hysteresis
from trackframe.operators.tracking import SIDES, Subject
from trackframe.params import Live, Segmenting
from trackframe.streaming.control import action
from trackframe.streaming.ordered import Streams

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SEGMENTS = "stream_id long, sequence long, start_time double, end_time double, reason string"
MESSAGES = "stream_id long, t double, is_text boolean, message binary, aperture double"
STATUS = "stream_id long, frames_received long, rejected long, t double, state string, utterance_seconds double, energy double, fps double, buffered_frames long, buffered_seconds double"
TRACK = "stream_id long, frame long, cand long, x int, y int, width int, height int"


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files as a stream; at most ``files_per_trigger`` new ones are taken at a time, the rest wait."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def messages(spark: SparkSession, path: str, most_bytes: int = 512 << 10) -> DataFrame:
    """``MESSAGES`` files as a stream, oldest first, of which one trigger takes ``most_bytes`` at most (or one file): so far ahead of the consumer a producer can be.

    Offsets are the file source's own, so a restarted query goes on where it stopped.
    """
    return spark.readStream.schema(MESSAGES).option("maxBytesPerTrigger", most_bytes).parquet(path)


def admitted(rows: DataFrame, live: Live = Live()) -> DataFrame:
    """Adds ``size`` and ``kind`` to messages: ``frame``, an action of ``control``, ``oversized``, ``unknown`` or ``error`` (text that is no JSON object).

    A frame is a message in bytes; a control message is text. Frames larger than ``live.max_message`` are oversized, whatever is in them.
    """
    size = F.length("message").cast("long")
    kind = F.when(~F.col("is_text"), F.when(size > live.max_message, "oversized").otherwise("frame")).otherwise(action(F.col("message").cast("string")))
    return rows.where("message IS NOT NULL AND is_text IS NOT NULL").withColumn("size", size).withColumn("kind", kind)


def counters(rows: DataFrame) -> DataFrame:
    """(stream_id, frames, oversized, controls, malformed) of admitted messages so far."""
    kind = F.col("kind")
    return rows.groupBy("stream_id").agg(
        F.count_if(kind == "frame").alias("frames"),
        F.count_if(kind == "oversized").alias("oversized"),
        F.count_if(kind.isin("ping", "flush", "reset", "close")).alias("controls"),
        F.count_if(kind.isin("error", "unknown")).alias("malformed"),
    )


class Session:
    """The state of one stream; ``frame`` and ``flush`` return a closed segment (sequence, start, end, reason) or None."""

    def __init__(self, p: Segmenting, live: Live, saved: str | None = None):
        self.live, self.segmenter = live, Hysteresis(p)
        self.aperture = self.gap = None
        self.changes: list[float] = []
        self.times: list[float] = []
        self.level, self.sequence, self.frames, self.rejected = 0.0, 0, 0, 0
        if saved:
            own, self.aperture, self.gap, self.changes, self.times, self.level, self.sequence, self.frames, self.rejected = json.loads(saved)
            self.segmenter.start, self.segmenter.active, self.segmenter.last = own

    def save(self) -> str:
        own = [self.segmenter.start, self.segmenter.active, self.segmenter.last]
        return json.dumps([own, self.aperture, self.gap, self.changes, self.times, self.level, self.sequence, self.frames, self.rejected])

    def energy(self, aperture: float | None) -> float:
        """Mean of the recent changes; a missing aperture resets."""
        if aperture is None:
            self.aperture, self.changes = None, []
            return 0.0
        if self.aperture is not None:
            self.changes = [*self.changes, abs(aperture - self.aperture)][-self.live.energy_window :]
        self.aperture = aperture
        return sum(self.changes) / len(self.changes) if self.changes else 0.0

    def frame(self, t: float, e: float) -> tuple | None:
        if self.segmenter.last is not None:
            gap = max(t - self.segmenter.last, 0.001)
            self.gap = gap if self.gap is None else 0.9 * self.gap + 0.1 * gap
        self.frames, self.level = self.frames + 1, e
        # never more than the buffer holds
        self.times = [*self.times, t][-max(1, round(self.live.buffer_seconds * self.live.fps)) :]
        return self._closed(self.segmenter.frame(t, e))

    def flush(self) -> tuple | None:
        return self._closed(self.segmenter.flush())

    def reset(self) -> None:
        """Forget the open segment, the motion and the buffer; numbers go on."""
        self.segmenter.reset()
        self.aperture, self.changes, self.times = None, [], []

    def status(self, t: float) -> tuple:
        opened = self.segmenter.start
        return (
            self.frames, self.rejected, t, "idle" if opened is None else "speaking", 0.0 if opened is None else t - opened, self.level,
            1 / self.gap if self.gap else 0.0, len(self.times), t - self.times[0],
        )

    def _closed(self, found: tuple | None) -> tuple | None:
        if found is None:
            return None
        self.sequence += 1
        return (self.sequence, *found)


class _Sessions(Streams):
    """Rows (stream_id, t, aperture, energy, kind[, size]) walked through a ``Session`` each stream."""

    state = "saved:string"

    def __init__(self, p: Segmenting, live: Live, sized: bool, every: int | None = None):
        self.p, self.live, self.every = p, live, every
        self.row = "t double, aperture double, energy double, kind string" + ", size long" * sized
        self.result = STATUS if every else SEGMENTS

    def step(self, stream: Any, state: tuple | None, rows: list[tuple], watermark: int) -> tuple[list[tuple], tuple, None]:
        session = Session(self.p, self.live, state[0] if state else None)
        closed: list[tuple | None] = []
        told: list[tuple] = []
        for t, aperture, energy, kind, *size in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0.0)):
            if kind == "reset":
                session.reset()
            elif kind == "flush":
                closed.append(session.flush())
            elif kind == "frame" and size and size[0] is not None and size[0] > self.live.max_message:
                session.rejected += 1
            elif kind == "frame":
                t = float("nan") if t is None else t
                own = session.energy(aperture)
                closed.append(session.frame(t, own if energy is None else energy))
                if self.every and session.frames % self.every == 0:
                    told.append(session.status(t))
        return [(stream, *x) for x in (told if self.every else closed) if x], (session.save(),), None


def segments(frames: DataFrame, p: Segmenting = Segmenting(), live: Live = Live()) -> DataFrame:
    """``SEGMENTS`` of a streaming DataFrame (stream_id, t, aperture, energy, kind) as they close.

    ``kind`` is ``frame``, ``flush`` (closes the open segment) or ``reset`` (forgets it, the motion and the
    buffer); others do nothing. A null energy is derived from the aperture.
    """
    return _Sessions(p, live, "size" in frames.columns).over(frames)


def statuses(frames: DataFrame, p: Segmenting = Segmenting(), live: Live = Live()) -> DataFrame:
    """``STATUS`` after every ``live.status_every``-th frame of each stream, with its counters so far.

    Takes what ``segments`` takes, and ``size``, the bytes of a message: those larger than ``live.max_message`` are rejected.
    """
    return _Sessions(p, live, "size" in frames.columns, live.status_every).over(frames)


class _Tracker(Streams):
    """Rows (stream_id, frame, cand, x, y, width, height, kind) to the chosen candidates; the last box is the state."""

    row = f"frame long, kind string, cand long, {', '.join(f'{x} int' for x in SIDES)}"
    result = TRACK
    state = "saved:string"

    def __init__(self, least_iou: float):
        self.least_iou = least_iou

    def step(self, stream: Any, state: tuple | None, rows: list[tuple], watermark: int) -> tuple[list[tuple], tuple, None]:
        last = json.loads(state[0]) if state else None
        subject, out = Subject(self.least_iou, last and tuple(last)), []
        # a reset comes before its frame's candidates; nulls come last
        rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] != "reset", *((x is None, x or 0) for x in r[2:])))
        for (frame, boxes), own in groupby(rows, key=lambda r: (r[0], r[1] != "reset")):
            if not boxes:
                subject.last = None
                continue
            best = subject.choose([(r[2], r[3:]) for r in own])
            out.append((stream, frame, best[0], *best[1]))
        return out, (json.dumps(subject.last),), None


def track(candidates: DataFrame, least_iou: float = 0.2) -> DataFrame:
    """``TRACK``: one candidate of every frame of a streaming DataFrame (stream_id, frame, cand, x, y, width, height, kind).

    A frame's candidates come in one trigger. ``kind`` ``reset`` forgets the last box before that frame.
    """
    return _Tracker(least_iou).over(candidates)


def shedding(path: str, dropped_path: str, queue: int = 2) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the newest ``queue`` jobs of a stream and trigger are kept, the others written apart."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = jobs.shed(batch, "stream_id", "sequence", queue).withColumn("batch", F.lit(batch_id))
        # a repeated trigger writes the same folder again
        marked.where("status = 'queued'").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        marked.where("status = 'displaced'").write.mode("overwrite").parquet(f"{dropped_path}/batch={batch_id}")

    return write


def results(path: str, score: Callable[[DataFrame], DataFrame], now: Column, queue: int = 2, max_age: float = 6.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends a row (stream_id, sequence, text, error, dropped, queue_wait_ms) for each job that is run or too old.

    Jobs are closed segments. Of a stream and trigger the newest ``queue`` are run, those older than ``max_age``
    at ``now`` are dropped with an error that says so. ``score`` takes the others and gives (stream_id, sequence, text, error).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = jobs.shed(batch, "stream_id", "sequence", queue).where("status = 'queued'")
        kept = jobs.stale(kept, F.col("end_time"), now, max_age).withColumnRenamed("error", "stale")
        done = score(kept.where("not dropped")).select("stream_id", "sequence", "text", "error")
        rows = kept.join(done, ["stream_id", "sequence"], "left").withColumn("queue_wait_ms", ((now - F.col("end_time")) * 1000).cast("long"))
        rows = rows.select("stream_id", "sequence", "text", F.coalesce("stale", "error").alias("error"), "dropped", "queue_wait_ms")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def rates(frames: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """Frames in each tumbling window, for rows at most ``delay`` late."""
    return frames.withWatermark(ts, delay).groupBy("stream_id", F.window(ts, width).alias("w")).count()
