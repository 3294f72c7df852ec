"""Operators on small inputs: golden values, brute force, edges."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.functions import geometry, tensor, text
from trackframe.operators import jobs, nbest, segments, sweeps, timeseries, tracking
from trackframe.params import Decoding, Live, Segmenting
from trackframe.plans import registry
from trackframe.streaming import live, scorers
from trackframe.streaming.control import action


def loop_segments(frames, p):
    session = live.Session(p, Live())
    out = [session.frame(t, e) for t, e in frames]
    return [x for x in [*out, session.flush()] if x]


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_a_plain_loop(spark, seed):
    rnd, p, rows, want = random.Random(seed), Segmenting(), [], []
    for stream in range(30):
        t, e, frames = rnd.choice([0.0, -3.0, 100.0]), 0.0, []
        for _ in range(rnd.randint(1, 400)):
            e = rnd.choice([0.0, 0.009, 0.02, 0.03]) if rnd.random() < 0.15 else e
            frames.append((t, e if rnd.random() < 0.8 else 0.0))
            t += rnd.choice([0.04, 0.04, 0.04, 0.2, 0.7, 5.0]) if rnd.random() < 0.2 else 0.04
        rows += [(stream, *f) for f in frames]
        want += [(stream, *s) for s in loop_segments(frames, p)]
    rnd.shuffle(rows)
    got = segments.segment(spark.createDataFrame(rows, "s int, t double, e double"), "s", "t", "e", p).collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(want)


def test_segment_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "s int, t double, e double")
    run = lambda rows: [tuple(r)[2:] for r in segments.segment(frame(rows), "s", "t", "e").orderBy("start_time").collect()]
    steady = [(1, i / 25, 0.02) for i in range(130)]
    assert run(steady)[0] == (0.0, 4.0, "max_length") and len(run(steady)) == 1  # the rest is too short
    assert run([(1, 0.0, 0.02), *((1, i / 25, 0.0) for i in range(1, 60))]) == []  # quiet before it is long enough
    assert run([(1, i / 25, 0.02) for i in range(40)]) == [(0.0, 1.56, "stream_end")]
    assert run([(1, None, 1.0), (1, 1.0, None)]) == [] and segments.segment(frame([]), "s", "t", "e").count() == 0
    with pytest.raises(ValueError):
        Segmenting(start=1.0, stop=2.0)


def clip(spark, n, fps):
    return spark.createDataFrame([(1, i / fps, i) for i in range(n)], "s int, t double, i int")


@pytest.mark.parametrize(("n", "fps", "rows", "last"), [(120, 60, 50, 1.96), (30, 15, 49, 1.92), (60, 30, 50, 1.96), (3000, 25, 3000, 119.96), (1, 25, 1, 0.0)])
def test_resampled_lengths(spark, n, fps, rows, last):
    got = timeseries.resample(clip(spark, n, fps), "s", "t", "i", 25.0, 2.0).orderBy("n").collect()
    assert (len(got), round(got[-1].target, 6)) == (rows, last)
    for r in got:  # the nearest, the earlier of two
        assert r.i == min(range(n), key=lambda i: (round(abs(i / fps - r.target), 9), i))


def test_resample_picks_and_limits(spark):
    got = timeseries.resample(clip(spark, 30, 30), "s", "t", "i", 25.0, 2.0, max_frames=5).orderBy("n").collect()
    assert len(got) == 5 and got[1].i == 1
    live_grid = timeseries.resample(clip(spark, 31, 30), "s", "t", "i", 25.0, 2.0, live=True)
    assert live_grid.count() == 26
    with pytest.raises(ValueError):
        timeseries.grid(clip(spark, 3, 30), "s", "t", 0)


def test_interpolation(spark):
    rows = [(1, i, v) for i, v in enumerate([None, [0.0], None, None, [3.0], None])] + [(2, 0, None), (2, 1, None)]
    got = timeseries.interpolate(spark.createDataFrame(rows, "s int, i int, v array<double>"), "s", "i", "v", 2.0).orderBy("s", "i").collect()
    assert [r.v and r.v[0] for r in got] == [0.0, 0.0, 1.0, 2.0, 3.0, 3.0, None, None]


@pytest.mark.parametrize("n", [1, 5, 40])
def test_smoothing_equals_numpy(spark, n):
    points = np.random.default_rng(n).normal(size=(n, 4, 2))
    want = []
    for i in range(n):
        m = min(6, i, n - 1 - i)
        mean = points[i - m : i + m + 1].mean(axis=0)
        want.append(mean + points[i].mean(axis=0) - mean.mean(axis=0))
    frame = spark.createDataFrame([(1, i, p.ravel().tolist()) for i, p in enumerate(points)], "s int, i int, p array<double>")
    got = timeseries.smooth(frame, "s", "i", "p", 12).orderBy("i").collect()
    assert np.allclose([r.p for r in got], [w.ravel() for w in want])


def test_energy_resets_on_missing_frames(spark):
    series = [1.0, 1.5, 1.0, 4.0, None, 2.0, 2.5]
    frame = spark.createDataFrame([(1, float(i), a) for i, a in enumerate(series)], "s int, t double, a double")
    energy = lambda **k: [round(r.energy, 6) for r in timeseries.motion_energy(frame, "s", "t", "a", **k).orderBy("t").collect()]
    assert energy() == [0.0, 0.5, 0.5, round(4 / 3, 6), 0.0, 0.0, 0.5]
    assert energy(window=2, statistic="max") == [0.0, 0.5, 0.5, 3.0, 0.0, 0.0, 0.5]
    session = live.Session(Segmenting(), Live())
    assert [round(session.energy(a), 6) for a in series] == energy()


def test_session_state_survives_saving():
    rnd, p = random.Random(1), Segmenting()
    frames = [(i / 25, rnd.choice([0.0, 0.0, 0.02])) for i in range(900)]
    whole, saved, out = loop_segments(frames, p), None, []
    for at in range(0, 900, 37):
        session = live.Session(p, Live(), saved)
        out += [x for t, e in frames[at : at + 37] if (x := session.frame(t, e))]
        saved = session.save()
    assert out + [x for x in [live.Session(p, Live(), saved).flush()] if x] == whole and whole
    session = live.Session(p, Live())
    session.frame(0.0, 1.0)
    session.reset()
    assert session.flush() is None


def words_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_equal_brute_force(spark):
    rnd = random.Random(7)
    make = lambda: " ".join(rnd.choices(["é", "on", "the", "漢字", "a", "b", "don't"], k=rnd.randint(0, 25)))
    rows = [(make(), make()) for _ in range(150)] + [("a b", None), ("", "a"), ("", "")] + [(" ".join(f"w{i}" for i in range(21_000)), "w1 w20999 x")]
    got = spark.createDataFrame(rows, "r string, h string").select("r", "h", text.word_errors(F.col("r"), F.col("h")).alias("w"), text.character_errors(F.col("r"), F.col("h")).alias("c")).collect()
    for r in got[:-1]:
        assert (r.w.errors, r.w.total) == (words_distance(r.r.split(), (r.h or "").split()), len(r.r.split()))
        a, b = r.r.replace(" ", ""), (r.h or "").replace(" ", "")
        assert (r.c.errors, r.c.total) == (words_distance(a, b), len(a))
    assert got[-1].w.errors == 20_999  # two words stay, one is inserted


def test_normalisation(spark):
    cases = ["Don't STOP—now!  é", "ﬁne ①", " a b\tc ", "", None, "under_score 12"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(text.normalise(F.col("t"), compose=False), text.normalise(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["don't stop now é", "ﬁne ①", "a b c", "", None, "under_score 12"]
    assert rows[1][1] == unicodedata.normalize("NFKC", "ﬁne ①")


def test_rate_text_and_tokens(spark):
    row = spark.range(1).select(
        text.rate_text(F.lit(1), F.lit(8)), text.rate_text(F.lit(3), F.lit(0)), text.sentence_case(F.lit("hELLO")),
        text.strip_special(F.array(*map(F.lit, [9, 9, 1, 9, 2, 9, 9])), F.lit(9)), text.strip_special(F.array(F.lit(9)), F.lit(9)), text.strip_special(F.array().cast("array<int>"), F.lit(9)),
        text.piece_ids(F.array(F.lit("a"), F.lit("z")), F.create_map(F.lit("a"), F.lit(3), F.lit("<unk>"), F.lit(1))), text.unit_line(F.lit(" ▁the 12 ")), text.unit_line(F.lit("  ")),
    ).first()
    assert list(row)[:3] == ["12.5% (1/8)", "0.0% (3/0)", "Hello"]
    assert list(row)[3:7] == [[9, 1, 9, 2], [], [], [3, 1]] and tuple(row[7]) == ("▁the", 12) and row[8] is None


def test_boxes(spark):
    box = lambda *v: geometry.box(*map(F.lit, v))
    row = spark.range(1).select(
        geometry.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)).alias("half"), geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("none"), geometry.iou(box(0, 0, 5, 5), box(0, 0, 5, 5)).alias("same"),
        geometry.fit_long_side(F.lit(1280), F.lit(720), 640).alias("fit"), geometry.crop_window(F.lit(10.0), F.lit(470.0), 96, F.lit(640), F.lit(480)).alias("crop"),
        geometry.pixel_box(F.lit(0.5), F.lit(0.1), F.lit(0.0), F.lit(0.1), F.lit(100), F.lit(100)).alias("flat"),
    ).first()
    assert (row.half, row.none, row.same, tuple(row.fit), row.flat) == (50 / 150, 0.0, 1.0, (640, 360), None)
    assert row.crop.asDict() == {"x0": 0, "x1": 58, "pad_x0": 38, "pad_x1": 0, "y0": 422, "y1": 480, "pad_y0": 0, "pad_y1": 38}


@pytest.mark.parametrize(("dx", "dy", "scale", "turn"), [(0, 0, 1, 0), (30, -20, 1, 0), (5, 5, 1.7, 0), (-9, 40, 0.6, 0.5)])
def test_similarity_recovers_the_pose(spark, dx, dy, scale, turn):
    reference = [(89.3, 94.6), (169.5, 94.6), (129.4, 141.2), (129.4, 183.5)]
    a, c = np.cos(turn) * scale, np.sin(turn) * scale
    moved = [(a * x - c * y + dx, c * x + a * y + dy) for x, y in reference]
    points = lambda ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))
    m = geometry.similarity_fit(points(moved), points(reference))
    back = spark.range(1).select(geometry.transform_points(points(moved), m), geometry.similarity_fit(points([(1, 1)] * 4), points(reference))).first()
    assert np.allclose([tuple(p) for p in back[0]], reference) and back[1] is None


def test_robust_fit_ignores_an_outlier(spark):
    reference = [(89.3, 94.6), (169.5, 94.6), (129.4, 141.2), (129.4, 183.5)]
    a, c = np.cos(0.3) * 1.4, np.sin(0.3) * 1.4
    moved = [(a * x - c * y + 7, c * x + a * y - 3) for x, y in reference]
    points = lambda ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))
    spoiled = [*moved[:2], (moved[2][0] + 60, moved[2][1] - 45), moved[3]]
    row = spark.range(1).select(geometry.robust_fit(points(spoiled), points(reference), 4), geometry.robust_fit(points([(2, 2)] * 4), points(reference), 4)).first()
    back = spark.range(1).select(geometry.transform_points(points(moved), F.struct(*(F.lit(row[0][k]).alias(k) for k in row[0].__fields__)))).first()
    assert np.allclose([tuple(p) for p in back[0]], reference) and row[1] is None


def test_tracking_keeps_its_subject(spark):
    near, far = (10, 10, 40, 40), (200, 10, 90, 90)
    rows = [(1, 0, 0, near)] + [(1, f, c, b) for f in range(1, 9) if f != 4 for c, b in enumerate([far, (near[0] + f, *near[1:])])] + [(1, 9, 0, far), (1, 10, 0, near), (1, 10, 1, far)]
    rows += [(2, 0, 0, near), (2, 0, 1, far), (2, 1, 0, near), (2, 1, 1, far)]
    frame = spark.createDataFrame(rows, "s int, f long, c int, b struct<x:int,y:int,width:int,height:int>")
    got = {(r.s, r.f): tuple(r.b) for r in tracking.track(frame, "s", "f", "c", "b").collect()}
    assert len(got) == 12 and all(got[1, f][0] == 10 + f for f in range(1, 9) if f != 4)
    assert got[1, 9] == far and got[1, 10] == far and got[2, 0] == far and got[2, 1] == far
    assert tracking.track(frame.limit(0), "s", "f", "c", "b").count() == 0


def test_images(spark):
    image = np.random.default_rng(0).integers(0, 256, (5, 7)).tolist()
    row = spark.createDataFrame([(image,)], "i array<array<int>>").select(
        tensor.denormalise(tensor.normalise(F.col("i"))).alias("back"), tensor.centre_crop(F.col("i"), 3).alias("crop"), tensor.shape(F.array("i", "i")).alias("shape"), tensor.luma(tensor.promote(F.col("i"))).alias("grey")
    ).first()
    assert row.back == image and row.crop == [r[2:5] for r in image[1:4]] and tuple(row["shape"]) == (2, 5, 7, True)
    assert np.allclose(row.grey, np.array(image) * 0.9999)
    rois = [("a", 0, 5, 7, 1, bytearray(np.array(image, np.uint8).tobytes())), ("a", 1, 5, 7, 3, bytearray(b"x"))]
    got = scorers.normalised_images(spark.createDataFrame(rois, "clip_id string, frame_index int, height int, width int, channels int, pixels binary"), 3).orderBy("frame_index").collect()
    assert np.allclose(np.array(got[0].tensor).reshape(3, 3), (np.array(row.crop) / 255 - 0.421) / 0.165) and got[1].tensor is None and "bad image" in got[1].error


def test_jobs_and_history(spark):
    frame = spark.createDataFrame([(1, i) for i in range(1, 5)] + [(2, 1)], "s int, n int")
    got = {(r.s, r.n): (r.status, r.displaced_older) for r in jobs.shed(frame, "s", "n").collect()}
    assert got == {(1, 1): ("displaced", False), (1, 2): ("displaced", False), (1, 3): ("queued", True), (1, 4): ("queued", True), (2, 1): ("queued", False)}
    aged = jobs.stale(frame, F.col("n"), F.lit(8.0)).where("s = 1").orderBy("n").collect()
    assert [r.dropped for r in aged] == [True, False, False, False] and "7.0 s" in aged[0].error


def test_outcomes_and_scores(spark):
    case = lambda *v: nbest.outcome(*map(F.lit, v))
    row = spark.range(1).select(case(0.125, 20, True, 1), case(0.5, 3, False, 1), case(0.5, 9, False, 1), case(0.5, 9, True, 0), case(0.5, 9, True, 1)).first()
    assert "12% of frames" in row[0].error and "3 frames" in row[1].error and "not loaded" in row[2].error and "no transcript" in row[3].error and row[4].error is None
    c = spark.range(1).select(nbest.confidence(F.lit(-1.0), F.lit(0)), nbest.confidence(F.lit(2.0), F.lit(1)), nbest.fuse(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4), Decoding(ctc=0.25, lm=1.0, length=0.5))).first()
    assert tuple(c) == (0.0, 1.0, 6.25)


def test_scorers_and_control(spark):
    scorers.register("stub", None)
    assert scorers.available()["stub"] is False
    with pytest.raises(NotImplementedError):
        scorers.create("stub")
    with pytest.raises(KeyError, match="Known"):
        scorers.create("nothing")
    rows = spark.createDataFrame([("[1]",), ("",), (None,), ('{"type":"reset"}',)], "m string").select(action(F.col("m"))).collect()
    assert [r[0] for r in rows][2:] == ["error", "reset"]


def test_sweep_settings():
    assert sweeps.settings(["mean"], [3], [2.0, 1.0], [1.0, 0.5]) == [("mean", 3, 2.0, 1.0), ("mean", 3, 2.0, 0.5), ("mean", 3, 1.0, 0.5)]


def _reference_normal(t):
    t = re.sub(r"[^\w\s']", " ", unicodedata.normalize("NFKC", t).lower())
    return re.sub(r"\s+", " ", t).strip()


def test_transcript_queries_compose_first(spark, tmp_path):
    pairs = [("Cafe\u0301 au lait", "café au lait"), ("Ｆｕｌｌ　Ｗｉｄｔｈ １２", "full width 12"), ("ﬁne oﬃce", "fine office"), ("plain words", "plain word")]
    turns = [(i, j, "user", t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()
    rows = {r.doc_id: r for r in found["normalise_text"](spark, str(tmp_path)).collect()}
    assert {i: (r.normal, r.n_words) for i, r in rows.items()} == {i: (n := _reference_normal(p[0]), len(n.split())) for i, p in enumerate(pairs)}
    joined = {(r.conv_id, r.turn): (r.ref, r.hyp) for r in found["reference_join"](spark, str(tmp_path)).collect()}
    assert all(joined[i, 0] == tuple(map(_reference_normal, p)) for i, p in enumerate(pairs))
    assert [joined[i, 0][0] == joined[i, 0][1] for i in range(4)] == [True, True, True, False]


def test_stacked_frames_collect_nothing(spark):
    plan = registry.queries()["stacked_frames"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "count(" in plan
