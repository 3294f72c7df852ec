"""Utterance segments: hysteresis, hangover, shortest and longest length.

``Hysteresis`` says what a segmenter does, frame by frame, and serves live streams. Whole streams are cut into chunks of time,
which tasks walk at once (``scan``): a chunk may be entered idle, or with a segment that one of the frames of the last
``max_length`` opened. A stream that never falls quiet is shared by all tasks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators import scan
from trackframe.operators.timeseries import carry, numbered
from trackframe.params import Segmenting


class Hysteresis:
    """A segmenter's state. ``frame`` and ``flush`` return a closed segment (start_time, end_time, reason) or None."""

    __slots__ = ("p", "high", "low", "start", "active", "last")

    def __init__(self, p: Segmenting, start: float | None = None, stop: float | None = None):
        self.p, self.high, self.low = p, p.start if start is None else start, p.stop if stop is None else stop
        self.start = self.active = self.last = None

    def frame(self, t: float, e: float) -> tuple[float, float, str] | None:
        """The opening frame emits nothing; length beats silence."""
        self.last = t
        if self.start is None:
            if e >= self.high:
                self.start = self.active = t
            return None
        if e >= self.low:
            self.active = t
        length = t - self.start
        if length >= self.p.max_length:
            return self._close(t, "max_length")
        if t - self.active >= self.p.hangover:
            return self._close(t, "silence" if length >= self.p.min_length else None)
        return None

    def flush(self) -> tuple[float, float, str] | None:
        if self.start is None:
            return None
        return self._close(self.last, "stream_end" if self.last - self.start >= self.p.min_length else None)

    def reset(self) -> None:
        self.start = self.active = None

    def _close(self, t: float, reason: str | None) -> tuple[float, float, str] | None:
        closed = (self.start, t, reason) if reason else None
        self.start = self.active = None
        return closed


class _Openings:
    """The frames of a chunk as jumps: from each frame that may open a segment to the frame that closes it, and on to the next opening.

    When a segment closes depends on its opening alone: the first frame ``max_length`` after it, or the first ``hangover`` after
    the last active frame, which is the same for all openings before it.
    """

    def __init__(self, t: np.ndarray, e: np.ndarray, own: int, p: Segmenting, high: float, low: float):
        """``own`` is the chunk's first own row; those before it have not closed what they may have opened."""
        self.t, self.p, self.n = t, p, t.size
        self.loud = loud = np.flatnonzero(e >= high)
        self.first = int(np.searchsorted(loud, own))
        active = np.maximum.accumulate(np.where(e >= low, np.arange(t.size), -1))
        silent = np.flatnonzero((active >= 0) & (t - t[active] >= p.hangover))
        silent = np.append(silent[silent >= own], t.size)
        long = np.searchsorted(t, t[loud] + p.max_length)
        while (more := (long > 0) & (t[long - 1] - t[loud] >= p.max_length)).any():  # as subtraction rounds
            long = long - more
        while (more := (long < t.size) & (t[np.minimum(long, t.size - 1)] - t[loud] < p.max_length)).any():
            long = long + more
        later = np.maximum(loud + 1, own)
        self.close = np.minimum(np.maximum(long, later), silent[np.searchsorted(silent, later)])
        self.then = np.searchsorted(loud, self.close, "right")

    def exits(self) -> dict[str | None, str | None]:
        """The state at the chunk's end by the state at its beginning: the time of the opening frame, null if idle."""
        exit_: list[str | None] = [None] * (self.loud.size + 1)
        for i in range(self.loud.size - 1, -1, -1):
            exit_[i] = exit_[self.then[i]] if self.close[i] < self.n else repr(float(self.t[self.loud[i]]))
        found = {repr(float(self.t[self.loud[i]])): exit_[i] for i in range(self.first)}
        return found | {None: exit_[self.first]}

    def segments(self, entry: str | None, final: bool) -> Iterator[tuple[float, float, str]]:
        """(start_time, end_time, reason) of what closes here."""
        i = self.first if entry is None else int(np.searchsorted(self.t[self.loud], float(entry)))
        while i < self.loud.size:
            start, at = float(self.t[self.loud[i]]), int(self.close[i])
            if at < self.n:
                end = float(self.t[at])
                reason = "max_length" if end - start >= self.p.max_length else "silence"
            elif final:
                end, reason = float(self.t[-1]), "stream_end"
            else:
                return
            if reason == "max_length" or end - start >= self.p.min_length:
                yield start, end, reason
            i = int(self.then[i]) if at < self.n else self.loud.size


def walk(frames: DataFrame, stream: str, p: Segmenting, thresholds: list[tuple[float, float] | tuple[float, float, str]]) -> DataFrame:
    """(stream, setting, start_time, end_time, reason) of frames (stream, t, e); ``setting`` numbers the (start, stop) pairs.

    A third entry of a pair names another column of energies than ``e``. Frames of one time are taken by rising energy.
    A stream of one chunk is walked once.
    """
    settings = [(*x, "e")[:3] for x in thresholds]
    energies = list(dict.fromkeys(x[2] for x in settings))
    named = frames.select(F.col(stream).alias("key"), "t", *energies)
    rows = scan.chunks(named, "key", "t", 64 * p.max_length, p.max_length)
    kind = rows.schema["key"].dataType.simpleString()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, pa.RecordBatch]]:
        """(key, chunk, rows) of each chunk."""
        parts: list[pa.RecordBatch] = []
        whole = lambda: parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        for first, part in scan.by_chunk(batches):
            if first and parts:
                yield parts[0]["key"][0].as_py(), parts[0]["_chunk"][0].as_py(), whole()
                parts = []
            parts.append(part)
        if parts:
            yield parts[0]["key"][0].as_py(), parts[0]["_chunk"][0].as_py(), whole()

    def openings(batch: pa.RecordBatch) -> Iterator[_Openings]:
        t, own = (batch[n].to_numpy(zero_copy_only=False) for n in ("t", "_own"))
        columns = {n: batch[n].to_numpy(zero_copy_only=False) for n in energies}
        if t.size > 1 and (np.diff(t) == 0).any():
            columns = {n: e[np.lexsort((e, t))] for n, e in columns.items()}
        for high, low, n in settings:
            yield _Openings(t, columns[n], int(own.size - own.sum()), p, high, low)

    def batches_of(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        """Many streams have few rows each, so rows of many go together."""
        while held := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))

    def seen(batches: Iterator[pa.RecordBatch], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        """Tells the key's type, which Spark has given it."""
        for batch in batches:
            kinds["key"] = batch.schema.field("key").type
            yield batch

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.null(), "setting": pa.int32(), "chunk": pa.int64(), "entry": pa.string(), "exit": pa.string()}
        found = ((key, i, chunk, a, b) for key, chunk, rows in gathered(seen(batches, kinds)) for i, o in enumerate(openings(rows)) for a, b in o.exits().items())
        yield from batches_of(found, kinds)

    def told(batch: pa.RecordBatch) -> tuple[dict[int, tuple[str | None, bool]], pa.RecordBatch]:
        """What each setting enters the chunk with and whether it is the last (a sole chunk is told nothing); the frames."""
        n = batch.num_rows - batch["setting"].null_count
        entries = batch.slice(0, n).select(["setting", "entry", "final"]).to_pylist() if n else []
        return {r["setting"]: (r["entry"], r["final"]) for r in entries}, batch.slice(n)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.null(), "setting": pa.int32(), "start_time": pa.float64(), "end_time": pa.float64(), "reason": pa.string()}
        chunks = ((key, *told(rows)) for key, _, rows in gathered(seen(batches, kinds)))
        yield from batches_of(((key, i, *s) for key, entries, rows in chunks for i, o in enumerate(openings(rows)) for s in o.segments(*entries.get(i, (None, True)))), kinds)

    maps = scan.dealt(rows.where("not _sole"), None, "t").mapInArrow(mapped, f"key {kind}, setting int, chunk long, entry string, exit string")
    found = scan.dealt(rows, scan.entered(maps, ["key", "setting"]), "t").mapInArrow(walked, f"key {kind}, setting int, start_time double, end_time double, reason string")
    return found.withColumnRenamed("key", stream)


def _frames(frames: DataFrame, stream: str, t: str, energy: str) -> DataFrame:
    return frames.where(F.col(t).isNotNull() & F.col(energy).isNotNull()).select(stream, F.col(t).cast("double").alias("t"), F.col(energy).cast("double").alias("e"))


def segment(frames: DataFrame, stream: str, t: str, energy: str, p: Segmenting = Segmenting()) -> DataFrame:
    """(stream, sequence, start_time, end_time, reason) of every stream; ``sequence`` counts from 1.

    Rows without energy or time are left out. An activity time of 0 is a time like any other.
    """
    found = walk(_frames(frames, stream, t, energy), stream, p, [(p.start, p.stop)])
    found = numbered(found, stream, "start_time", 64 * p.max_length, "_at")
    return found.select(stream, (F.col("_at") + 1).cast("int").alias("sequence"), "start_time", "end_time", "reason")


def segment_counts(segments: DataFrame, streams: DataFrame, stream: str) -> DataFrame:
    """(stream, segments) of all streams, those without a segment included."""
    counts = segments.groupBy(stream).agg(F.count("*").alias("segments"))
    return streams.select(stream).distinct().join(counts, stream, "left").select(stream, F.coalesce("segments", F.lit(0).cast("long")).alias("segments"))


def collect(segments: DataFrame, frames: DataFrame, stream: str, t: str, lead_in: float, width: float) -> DataFrame:
    """Segments joined with their frames from ``lead_in`` before the start to the end.

    Both sides are dealt into time buckets of ``width``, so the join is an equi
    join; a segment is in as many buckets as it spans.
    """
    first = F.floor((F.col("start_time") - lead_in) / width)
    dealt = segments.withColumn("_bucket", F.explode(F.sequence(first, F.floor(F.col("end_time") / width))))
    rows = frames.withColumn("_bucket", F.floor(F.col(t) / width))
    inside = F.col(t).between(F.col("start_time") - lead_in, F.col("end_time"))
    return dealt.join(rows, [stream, "_bucket"]).where(inside).drop("_bucket")


def collect_by_count(segments: DataFrame, frames: DataFrame, stream: str, t: str, lead_in: float, width: float, fps: float, most_seconds: float) -> DataFrame:
    """Like ``collect``, but of each segment only the last round(length * fps) frames, as a buffer that counts frames gives.

    A capture faster than ``fps`` loses the beginning of its segments. Length is
    that of the segment and the lead-in, at most ``most_seconds``. A segment that has no
    frame of its own (they may have been left out of ``frames``) has as many of the last
    frames before its end, whatever their age.
    """
    wanted = F.rint(F.least(F.col("end_time") - F.col("start_time") + lead_in, F.lit(most_seconds)) * fps)
    rows = collect(segments, frames, stream, t, lead_in, width)
    rank = F.row_number().over(Window.partitionBy(stream, "sequence").orderBy(F.col(t).desc()))
    own = rows.withColumn("_rank", rank).where(F.col("_rank") <= wanted).drop("_rank")

    empty = segments.join(rows.select(stream, "sequence").distinct(), [stream, "sequence"], "left_anti")
    # how many frames of the stream there are up to the end, by one order of both; then an equi join on their numbers
    placed = numbered(frames, stream, t, width, "_i")
    ends = empty.select(stream, F.col("end_time").alias("_t"), F.struct(*empty.columns).alias("_s"))
    both = placed.select(stream, F.col(t).alias("_t"), "_i").unionByName(ends, allowMissingColumns=True)
    last = carry(both, stream, "_t", F.col("_i"), "_last", width).where("_s is not null").select("_s.*", "_last")
    numbers = F.sequence(F.greatest(F.lit(0), F.col("_last") - wanted.cast("long") + 1), F.col("_last"))
    dealt = last.where((F.col("_last") >= 0) & (wanted >= 1)).withColumn("_i", F.explode(numbers)).drop("_last")
    return own.unionByName(dealt.join(placed, [stream, "_i"]).drop("_i").select(own.columns))
