"""Live sessions in event time: frames put in order, payloads held for some seconds, streams that end when frames stop.

Rows of a stream may come late by up to a delay, in any order and over any number of triggers (``ordered``): results are those of the
stream's rows in order. A stream that has been idle for ``Live.idle`` seconds is woken by a timer: that ends
its session, closes an open segment and removes all of its state. A frame that comes later begins a new session.

The state of a stream is one small record, the rows within the delay, and the frames that a buffer of ``Live.buffer_seconds`` holds.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import Any

from pyspark.sql import DataFrame

from trackframe.params import Live, Segmenting
from trackframe.streaming.live import Session
from trackframe.streaming.ordered import Ordered, apply

#: ``session`` is the time of a session's first frame.
ENDED = "stream_id long, session double, sequence long, start_time double, end_time double, reason string"
FRAMES = f"{ENDED}, n long, source_t double, payload binary"
#: At one time, frames come before control messages.
_KINDS = {"frame": 0, "flush": 1, "reset": 2}


def resampled(frames: list[tuple[float, Any]], fps: float) -> list[tuple[float, Any]]:
    """The (time, payload) nearest to each grid time, the earlier of two equally near; fewer than two pass as they are."""
    if len(frames) < 2:
        return frames
    times, out = [t for t, _ in frames], []
    for k in range(round((times[-1] - times[0]) * fps) + 1):
        target = times[0] + k / fps
        after = bisect_left(times, target)
        near = [times[i] for i in (after - 1, after) if 0 <= i < len(times)]
        out.append(frames[bisect_left(times, min(near, key=lambda t: abs(t - target)))])
    return out


def frames_of(held: list[tuple[float, Any]], start: float, end: float, live: Live, fps: float) -> list[tuple[float, Any]]:
    """A segment's frames out of a buffer's: of as many last ones as its length and lead-in ask for those from the lead-in on, or all of them if none is; on the grid."""
    wanted = round(min(end - start + live.lead_in, live.buffer_seconds) * live.fps)
    window = held[-wanted:] if wanted > 0 else []
    return resampled([x for x in window if x[0] >= start - live.lead_in] or window, fps)


class _Sessions(Ordered):
    """Rows walked through a ``Session`` each stream, and with ``fps`` the frames that its buffer holds."""

    row = "t double, aperture double, energy double, kind string, size long, payload binary"
    own = "saved:string,began:double,last:double,held:array<struct<t:double,payload:binary>>"
    nothing = (None, None, None, [])

    def __init__(self, p: Segmenting, live: Live, fps: float | None):
        self.p, self.live, self.fps = p, live, fps
        self.result = FRAMES if fps else ENDED

    def rank(self, row: tuple) -> tuple:
        """Frames before control messages, by energy."""
        return _KINDS.get(row[3], 3), row[2] is not None, row[2] or 0.0

    def walk(self, key: Any, own: tuple | None, due: list[tuple], watermark: float) -> tuple[list[tuple], tuple | None, float | None]:
        saved, began, last, held = own or (None, None, None, [])
        session = Session(self.p, self.live, saved) if own else None
        held = [(t, None if x is None else bytes(x)) for t, x in held]
        out: list[tuple] = []
        capacity = round(self.live.buffer_seconds * self.live.fps)

        def closed(found: tuple | None) -> None:
            if found is None:
                return
            if self.fps is None:
                out.append((key, began, *found))
            else:
                out.extend((key, began, *found, n, *x) for n, x in enumerate(frames_of(held, found[1], found[2], self.live, self.fps)))

        for t, aperture, energy, kind, size, payload in due:
            if session is not None and t - last > self.live.idle:
                closed(session.flush())
                session, held = None, []
            if session is None:
                if kind != "frame" or (size is not None and size > self.live.max_message):
                    continue
                session, began = Session(self.p, self.live), t
            if kind == "reset":
                session.reset()
                held = []
            elif kind == "flush":
                closed(session.flush())
            elif kind == "frame" and size is not None and size > self.live.max_message:
                session.rejected += 1
            elif kind == "frame":
                last = t
                moved = session.energy(aperture)
                if self.fps:
                    held = [*held, (t, payload)][-capacity:]
                closed(session.frame(t, moved if energy is None else energy))
        if session is not None and watermark > last + self.live.idle:
            closed(session.flush())
            session = None
        if session is None:
            return out, None, None
        return out, (session.save(), began, last, held), last + self.live.idle


def segments(frames: DataFrame, delay: str, p: Segmenting = Segmenting(), live: Live = Live()) -> DataFrame:
    """``ENDED``: the segments of each session of a streaming DataFrame (stream_id, ts, t, kind[, aperture, energy, size]).

    ``ts`` is the timestamp of ``t`` seconds; rows more than ``delay`` behind the newest are too late and dropped. ``kind``
    is ``frame``, ``flush`` or ``reset``; a null energy is derived from the aperture; a frame of more than ``live.max_message`` bytes is
    rejected. ``live.idle`` seconds without a frame end a session, with a last segment if one is open and long enough. Rows of a null time are dropped.
    """
    return apply(frames, delay, _Sessions(p, live, None))


def segment_frames(frames: DataFrame, delay: str, fps: float, p: Segmenting = Segmenting(), live: Live = Live()) -> DataFrame:
    """``FRAMES``: like ``segments``, a row for each frame of a closed segment, on a grid of ``fps`` frames a second.

    Each stream's state holds the payloads of its last ``live.buffer_seconds`` at ``live.fps`` frames a second. A segment's frames
    are those from ``live.lead_in`` before it, as far as the buffer goes back.
    """
    return apply(frames, delay, _Sessions(p, live, fps))
