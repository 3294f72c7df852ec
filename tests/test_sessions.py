"""Live sessions: shuffled arrival over several triggers against a plain walk in order, late rows, controls, frames of segments, state that ends."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trackframe.params import Live, Segmenting
from trackframe.streaming import live, sessions

P = Segmenting(0.5, 0.3, 0.5, 0.7, 4.0)
SCHEMA = "stream_id long, t double, energy double, kind string, size long, payload binary"


def run(spark, folder, triggers, operator, mode="append"):
    """(rows of the sink, progress of each trigger) of ``triggers``, one file each."""
    for rows in triggers:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    stream = live.source(spark, f"{folder}/in", SCHEMA, 1).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    spark.conf.set(live.PROVIDER, live.ROCKSDB)
    try:
        out = operator(stream)
        q = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/c").outputMode(mode).format("parquet").start(f"{folder}/out")
        q.awaitTermination()
    finally:
        spark.conf.unset(live.PROVIDER)
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()], q.recentProgress


def nearest(frames, fps):
    if len(frames) < 2:
        return frames
    a, b = frames[0][0], frames[-1][0]
    return [min(frames, key=lambda x: (abs(x[0] - (a + k / fps)), x[0])) for k in range(round((b - a) * fps) + 1)]


def plain(rows, p, lv, fps):
    """(segments, frames) of a stream's rows in order of time."""
    out, frames, session, began, last, held = [], [], None, None, None, []

    def closed(found):
        if found:
            out.append((began, *found))
            n = round(min(found[2] - found[1] + lv.lead_in, lv.buffer_seconds) * lv.fps)
            window = held[-n:]
            chosen = [x for x in window if x[0] >= found[1] - lv.lead_in] or window
            frames.extend((began, *found, k, *x) for k, x in enumerate(nearest(chosen, fps)))

    for _, t, e, kind, size, payload in sorted(rows, key=lambda r: (r[1], r[3] != "frame", r[2] is not None, r[2] or 0.0)):
        if session and t - last > lv.idle:
            closed(session.flush())
            session = None
        if session is None:
            if kind != "frame" or (size or 0) > lv.max_message:
                continue
            session, began, held = live.Session(p, lv), t, []
        if kind == "reset":
            session.reset()
            held = []
        elif kind == "flush":
            closed(session.flush())
        elif (size or 0) <= lv.max_message:
            last, held = t, [*held, (t, payload)][-round(lv.buffer_seconds * lv.fps) :]
            closed(session.frame(t, e))
    if session:
        closed(session.flush())
    return out, frames


def capture(rnd, stream, n, controls=True):
    t, rows = 10.0, []
    for k in range(n):
        t = round(t + (rnd.choice([0.04, 0.05, 0.04, 0.3]) if rnd.random() < 0.97 else rnd.choice([3.0, 8.5])), 3)
        kind = rnd.choices(["frame", "flush", "reset"], [60, 1, 1])[0] if controls else "frame"
        rows.append((stream, t, rnd.choice([0.1, 0.4, 0.6, 0.9]), kind, rnd.choice([None, 9, 1 << 30]) if rnd.random() < 0.1 else None, f"{stream}:{k}".encode()))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_shuffled_arrival_equals_the_walk_in_order(spark, tmp_path, seed):
    rnd, lv = random.Random(seed), Live(idle=6.0, buffer_seconds=3.0)
    streams = {s: capture(rnd, s, n) for s, n in ((0, 400), (1, 300), (2, 5), (3, 1))}
    rows = sorted((r for own in streams.values() for r in own), key=lambda r: r[1] + rnd.random() * 2.9)
    step = len(rows) // 5 + 1
    triggers = [rows[i : i + step] for i in range(0, len(rows), step)] + [[(99, max(r[1] for r in rows) + 100, 0.0, "tick", None, None)], [(99, 1e6, 0.0, "tick", None, None)]]
    want = {s: plain(own, P, lv, 25.0) for s, own in streams.items()}
    got, progress = run(spark, f"{tmp_path}/a", triggers, lambda x: sessions.segments(x, "3 seconds", P, lv))
    assert sorted(got) == sorted((s, *x) for s, (found, _) in want.items() for x in found) and len(got) > 20
    assert max(x["stateOperators"][0]["numRowsTotal"] for x in progress) > 3
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # the last tick waits, no stream is left
    got, _ = run(spark, f"{tmp_path}/b", triggers, lambda x: sessions.segment_frames(x, "3 seconds", 25.0, P, lv))
    assert sorted(got) == sorted((s, *x) for s, (_, found) in want.items() for x in found)


def test_a_segment_closes_when_frames_stop(spark, tmp_path):
    """Nothing more comes of the stream: the timer ends it, on the time that another stream brings."""
    rows = [(1, 1 + i / 25, 0.9, "frame", None, b"x") for i in range(40)]  # the watermark begins at 0
    triggers = [rows, [(2, 9.0, 0.1, "frame", None, b"y")], [(2, 20.0, 0.1, "frame", None, b"y")]]
    got, progress = run(spark, str(tmp_path), triggers, lambda x: sessions.segments(x, "1 second", P, Live(idle=0.5)))
    assert got == [(1, 1.0, 1, 1.0, 2.56, "stream_end")]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 4


def test_rows_later_than_the_delay_are_dropped(spark, tmp_path):
    rows = [(1, 1 + i / 25, 0.9, "frame", None, b"x") for i in range(40)]  # the watermark begins at 0
    triggers = [rows, [(1, 50.0, 0.1, "frame", None, b"y")], [(1, 1.5, 0.0, "reset", None, None)], [(1, 99.0, 0.1, "frame", None, b"y")]]
    got, _ = run(spark, str(tmp_path), triggers, lambda x: sessions.segments(x, "1 second", P, Live()))
    assert got == [(1, 1.0, 1, 1.0, 2.56, "stream_end")]


def test_frames_of_a_segment():
    """0.8 s and the lead-in of 0.25 s at 25 frames a second, from a capture of 50 frames; of a faster one the grid's."""
    held = [(i / 25, i) for i in range(50)]
    found = sessions.frames_of(held, 0.8, 1.6, Live(), 25.0)
    assert [x[1] for x in found] == list(range(24, 50)) and 24 <= len(found) <= 28
    fast = [(i / 30, i) for i in range(30)]
    assert [x[1] for x in sessions.resampled(fast, 25.0)] == [x[1] for x in nearest(fast, 25.0)] and len(sessions.resampled(fast, 25.0)) == 25
    assert sessions.frames_of(held, 9.0, 9.5, Live(), 25.0) == sessions.resampled(held[-19:], 25.0)  # none is its own: the window as it is
    assert sessions.resampled([(1.0, "a")], 25.0) == [(1.0, "a")] and sessions.resampled([], 25.0) == []
    assert [x[1] for x in sessions.resampled([(0.0, "a"), (0.0, "b"), (0.04, "c")], 25.0)] == ["a", "c"]
