"""Streams that hold most of the rows, and live streams over several triggers, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from trackframe.operators import jobs, segments, timeseries, tracking
from trackframe.params import Live, Segmenting
from trackframe.streaming import live, scorers


@pytest.fixture
def hot(spark, monkeypatch):
    """(rows by stream, frame): stream 1 has 90 % of the rows; blocks are small."""
    monkeypatch.setattr(timeseries, "BLOCK", 40)
    rnd, rows = random.Random(8), {}
    for stream, n in ((1, 900), (2, 60), (3, 39), (4, 1)):
        t = 0.0
        for _ in range(n):
            t += rnd.choice([0.04, 0.04, 0.04, 0.9])
            rows.setdefault(stream, []).append((round(t, 3), None if rnd.random() < 0.1 else rnd.choice([0.0, 0.01, 0.03, 0.05])))
    flat = [(s, t, a, i) for s, own in rows.items() for i, (t, a) in enumerate(own)]
    rnd.shuffle(flat)
    return rows, spark.createDataFrame(flat, "s int, t double, a double, i int")


def test_blocks_equal_whole_streams(hot):
    rows, frame = hot
    energy = {(r.s, r.i): r.energy for r in timeseries.motion_energy(frame, "s", "t", "a", 3, "mean", 5.0).collect()}
    for s, own in rows.items():
        session = live.Session(Segmenting(), Live())
        assert [round(energy[s, i], 9) for i in range(len(own))] == [round(session.energy(a), 9) for _, a in own]
    assert all(r.frame_index == r.i for r in timeseries.frame_index(frame, "s", "t", width=3.0).collect())
    fps = {r.s: r.ema for r in timeseries.inter_arrival_fps(frame, "s", "t", width=4.0).collect()}
    for s, own in rows.items():
        ema = None
        for (a, _), (b, _) in zip(own, own[1:]):
            ema = max(b - a, 0.001) if ema is None else 0.9 * ema + 0.1 * max(b - a, 0.001)
        assert fps[s] == pytest.approx(ema) if ema else fps[s] is None
    odd = frame.withColumn("k", F.when(F.col("i") == 77, 500).otherwise(F.col("i") * 2))
    got = {r.s: (r.rows, r.not_increasing, r.not_sequential) for r in timeseries.order_violations(odd, "s", "t", "k", 64).collect()}
    for s, own in rows.items():
        order = sorted((500 if i == 77 else 2 * i, t) for i, (t, _) in enumerate(own))
        pairs = list(zip(order, order[1:]))
        assert got[s] == (len(own), sum(b[1] <= a[1] for a, b in pairs), sum(b[0] - a[0] != 1 for a, b in pairs))
    points = frame.withColumn("p", F.array(F.col("t"), F.col("i") * 1.0))
    smooth = {(r.s, r.i): r.p for r in timeseries.smooth(points, "s", "i", "p", 6, 100.0).collect()}
    assert len(smooth) == 1000 and all(smooth[s, i] == pytest.approx([t, i]) for s, own in rows.items() for i, (t, _) in enumerate(own))  # a sole point is its own centroid
    shed = jobs.shed(jobs.number(frame, "s", "t", 2.0), "s", "sequence", 2, 16.0).collect()
    assert all(r.sequence == r.i + 1 and (r.status == "queued") == (r.i >= len(rows[r.s]) - 2) and r.displaced_older == (r.i >= 2) for r in shed)
    steady = {r.s: r.max_jump for r in tracking.stability(frame, "s", "i", "t", "i", 50.0).collect()}
    assert steady[1] == pytest.approx(max((1 + (b[0] - a[0]) ** 2) ** 0.5 for a, b in zip(rows[1], rows[1][1:])))


def test_a_stream_that_is_never_quiet(spark):
    p = Segmenting()
    frames = [(1, i / 25, 0.05) for i in range(20_000)] + [(2, i / 25, 0.05 * (i % 90 < 60)) for i in range(2_000)]
    want = []
    for s in (1, 2):
        session = segments.Hysteresis(p)
        own = [x for k, t, e in frames if k == s and (x := session.frame(t, e))]
        want += [(s, i, *x) for i, x in enumerate([*own, *filter(None, [session.flush()])], 1)]
    got = segments.segment(spark.createDataFrame(frames, "s int, t double, e double").repartition(7), "s", "t", "e", p).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 150


def test_numbers_of_null_streams_and_orders(spark):
    rows = [(None, 1.0), (None, 2.0), (1, None), (1, 5.0), (1, 4.0)]
    got = timeseries.numbered(spark.createDataFrame(rows, "s int, t double"), "s", "t", 1.0, "n", "all").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 1.0, 0, 2), (None, 2.0, 1, 2), (1, None, 0, 3), (1, 4.0, 1, 3), (1, 5.0, 2, 3)]))


def feed(spark, tmp_path, parts, schema, make, read):
    """Run ``make`` of a stream whose files are taken one a trigger."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.conf.set(live.PROVIDER, live.ROCKSDB)
        stream = make(live.source(spark, str(tmp_path / "in"), schema, 1))
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        spark.conf.unset(live.PROVIDER)
    return spark.read.schema(read).parquet(str(tmp_path / "out")).collect()


def test_controls_and_status_over_triggers(spark, tmp_path):
    rnd, p, settings = random.Random(2), Segmenting(), Live(status_every=7, buffer_seconds=1.0, max_message=100)
    rows = []
    for i in range(700):
        kind = "flush" if i % 161 == 160 else "reset" if i % 317 == 316 else "note" if i % 97 == 5 else "frame"
        rows.append((1, i / 25, None if rnd.random() < 0.02 else rnd.random() * 0.1, None, kind, 200 if i % 50 == 49 else 10))
    session, closed, told = live.Session(p, settings), [], []
    for _, t, a, _, kind, size in rows:
        if kind == "frame" and size > 100:
            session.rejected += 1
        elif kind == "frame":
            closed.append(session.frame(t, session.energy(a)))
            told += [(1, *session.status(t))] if session.frames % 7 == 0 else []
        elif kind in ("flush", "reset"):
            closed.append(getattr(session, kind)())
    parts = [rows[a : a + 175] for a in range(0, 700, 175)]
    schema = "stream_id long, t double, aperture double, energy double, kind string, size int"
    got = feed(spark, tmp_path / "a", parts, schema, lambda s: live.segments(s, p, settings), live.SEGMENTS)
    assert sorted(map(tuple, got)) == sorted((1, *x) for x in closed if x) and {r.reason for r in got} >= {"stream_end", "max_length"}
    got = feed(spark, tmp_path / "b", parts, schema, lambda s: live.statuses(s, p, settings), live.STATUS)
    assert sorted(map(tuple, got)) == sorted(told) and {r.state for r in got} <= {"idle", "speaking"} and max(r.buffered_frames for r in got) == 25 and max(r.rejected for r in got) > 5


def test_tracking_over_triggers(spark, tmp_path):
    rnd, rows, want, last = random.Random(3), [], [], None
    for frame in range(60):
        if frame == 31:
            rows.append((5, frame, 0, 0, 0, 0, 0, "reset"))
            last = None
        own = [(c, (rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(5, 30), rnd.randint(5, 30))) for c in range(rnd.choice([0, 1, 2, 3]))]
        rows += [(5, frame, c, *b, "box") for c, b in own]
        if own:
            best = own[0]
            if len(own) > 1:
                near = max(own, key=lambda x: tracking.overlap(last, x[1])) if last else None
                best = near if near and tracking.overlap(last, near[1]) >= 0.2 else max(own, key=lambda x: x[1][2] * x[1][3])
            last = best[1]
            want.append((5, frame, best[0], *best[1]))
    schema = "stream_id long, frame long, cand long, x int, y int, width int, height int, kind string"
    parts = [[r for r in rows if a <= r[1] < a + 20] for a in (0, 20, 40)]
    assert sorted(map(tuple, feed(spark, tmp_path, parts, schema, live.track, live.TRACK))) == want


def test_scorers_are_made_once_a_task_and_never_hold_a_long_clip(spark, tmp_path):
    made = str(tmp_path / "made")

    def factory():
        with open(made, "a") as f:
            f.write("x")
        return lambda rows: [(",".join(map(str, rows["i"])), -1.0, [len(rows)])]

    rows = [(c, i) for c in range(30) for i in range(4)] + [(99, i) for i in range(5000)] + [(None, 2), (None, 1)]
    frame = spark.createDataFrame(rows, "c long, i int").repartition(3)
    got = {r.clip_id: r for r in scorers.transcribe(frame.coalesce(1), "c", "i", factory, 100).collect()}
    assert len(got) == 32 and got["7"].hypotheses[0].text == "0,1,2,3" and got[None].hypotheses[0].text == "1,2"
    assert got["99"].error == "ValueError: 5000 frames, at most 100 are taken" and got["99"].frames == 5000
    with open(made) as f:
        assert len(f.read()) <= spark.sparkContext.defaultParallelism


def test_segments_without_frames_take_the_last_ones(spark):
    found = spark.createDataFrame([(1, 1, 10.0, 12.0), (1, 2, 50.0, 52.0), (2, 1, 5.0, 7.0)], "s int, sequence int, start_time double, end_time double")
    frames = spark.createDataFrame([(1, i * 0.5, i) for i in range(30)], "s int, t double, i int")
    got = segments.collect_by_count(found, frames, "s", "t", 0.25, 4.0, 2.0, 8.0).collect()
    by = {}
    for r in got:
        by.setdefault((r.s, r.sequence), []).append(r.i)
    assert {k: sorted(v) for k, v in by.items()} == {(1, 1): [21, 22, 23, 24], (1, 2): [26, 27, 28, 29]}


def test_streams_share_keys_of_the_state(spark, tmp_path):
    """A key costs milliseconds a trigger, so many streams are no more keys than there are buckets; each is tracked by itself."""
    from trackframe.streaming.ordered import BUCKETS

    n = 3 * BUCKETS
    rows = spark.range(n).selectExpr("id AS stream_id", "explode(array(1L, 2L)) AS frame", "id").selectExpr("stream_id", "frame", "id % 7 AS cand", "cast(id AS int) AS x", "0 AS y", "9 AS width", "9 AS height", "'box' AS kind")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.track(live.source(spark, f"{tmp_path}/in", rows.schema, 1))
    before = spark.conf.get(live.PROVIDER, None)
    spark.conf.set(live.PROVIDER, live.ROCKSDB)
    try:
        q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(live.PROVIDER, before) if before else spark.conf.unset(live.PROVIDER)
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= BUCKETS
    got = spark.read.schema(live.TRACK).parquet(f"{tmp_path}/out").collect()
    assert {(r.stream_id, r.frame, r.x) for r in got} == {(i, f, i) for i in range(n) for f in (1, 2)} and len(got) == 2 * n
