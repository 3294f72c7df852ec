"""Streams in chunks: segments and tracks against plain loops, over many chunks, streams that never fall quiet and null streams."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import loop_segments
from trackframe.operators import scan, segments, timeseries, tracking
from trackframe.params import Segmenting


def streams(rnd):
    """Long, busy, sparse, periodically quiet and null streams of (t, e)."""
    for key, gaps in ((0, [0.04, 0.04, 0.1, 0.3]), (1, [0.04]), (2, [0.04, 0.04, 5.0, 700.0]), (3, [0.04, 0.05]), (None, [0.04, 1.0])):
        t, frames = -400.0, []
        for i in range(rnd.choice([4, 2500, 4000])):
            t += rnd.choice(gaps)
            e = 1.0 if key == 1 else float(i % 200 > 0) if key == 3 else rnd.choice([0.1, 0.4, 0.6, 0.9])
            frames.append((t, e))
        yield key, frames


@pytest.mark.parametrize("seed", range(3))
def test_segments_over_many_chunks_equal_a_plain_loop(spark, seed):
    rnd, p = random.Random(seed), Segmenting(0.5, 0.3, 0.5, 0.7, 4.0)
    both = [(0.5, 0.3), (0.7, 0.5)]
    rows, want = [], []
    for key, frames in streams(rnd):
        rows += [(key, *f) for f in frames]
        for i, (high, low) in enumerate(both):
            want += [(key, i, *x[1:]) for x in loop_segments(frames, Segmenting(high, low, 0.5, 0.7, 4.0))]
    rnd.shuffle(rows)
    got = segments.walk(spark.createDataFrame(rows, "s int, t double, e double"), "s", p, both).collect()
    assert len(want) > 100 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_walk_along_several_energies_equals_a_loop_for_each(spark):
    """Frames of one time stand in another order in each column; streams of one chunk, of many and null."""
    rnd, p = random.Random(9), Segmenting(0.5, 0.3, 0.5, 0.7, 4.0)
    settings = [(0.5, 0.3, "a"), (0.7, 0.5, "b"), (0.7, 0.3, "a")]
    rows, want = [], []
    for key, n in ((0, 3000), (1, 9000), (2, 3), (None, 2000), (4, 1)):
        times = sorted(rnd.choice([0.1, 0.2, 0.3]) * rnd.randint(0, 3 * n) for _ in range(n))
        frames = [(t, rnd.random(), rnd.random()) for t in times]
        rows += [(key, *f) for f in frames]
        for i, (high, low, name) in enumerate(settings):
            own = sorted((t, {"a": a, "b": b}[name]) for t, a, b in frames)
            want += [(key, i, *x[1:]) for x in loop_segments(own, Segmenting(high, low, 0.5, 0.7, 4.0))]
    rnd.shuffle(rows)
    got = segments.walk(spark.createDataFrame(rows, "s int, t double, a double, b double"), "s", p, settings).collect()
    assert len({t for _, t, *_ in rows}) < len(rows) and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("seed", range(2))
def test_tracks_over_many_chunks_equal_a_plain_loop(spark, seed):
    rnd, rows, want = random.Random(seed), [], {}
    for key in (0, 1, None):
        subject = tracking.Subject(0.2)
        for f in sorted(rnd.sample(range(500), 200)):
            boxes = [(k, tuple(rnd.randint(0, 8) for _ in range(2)) + tuple(rnd.randint(3, 9) for _ in range(2))) for k in range(1 if key == 1 and rnd.random() < 0.1 else rnd.randint(2, 4))]
            rows += [(key, f, *b) for b in boxes]
            want[key, f] = subject.choose(boxes)
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "s int, f long, c int, b struct<x:int,y:int,width:int,height:int>")
    got = {(r.s, r.f): (r.c, tuple(r.b)) for r in tracking.track(frame, "s", "f", "c", "b", bucket=7.0).collect()}
    assert got == want


def test_a_busy_stream_is_shared_by_all_tasks(spark):
    """Nine tenths of the rows are one stream that never falls quiet."""
    n, p = 200_000, Segmenting()
    rows = spark.range(n).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 7 + 1).alias("key"), (F.col("id") / 25).alias("t"), F.lit(1.0).alias("e"))
    dealt = scan.dealt(scan.chunks(rows, "key", "t", 64 * p.max_length, p.max_length), None, "t", "e")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    try:
        sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and n < sum(sizes) < 1.05 * n and max(sizes) < 0.5 * n
    found = segments.segment(rows.where("key = 0"), "key", "t", "e", p)
    assert found.count() == pytest.approx(n / 25 / 4.04, rel=0.01)


def test_reach_is_bounded(spark):
    with pytest.raises(ValueError):
        scan.chunks(spark.createDataFrame([(1, 1.0)], "s int, t double"), "s", "t", 1.0, 2.0)


def test_rows_of_null_streams_and_times_stay(spark):
    rows = [(None, 1.0, 5.0), (None, 2.0, None), (1, 1.0, 7.0), (1, None, None), (1, None, 3.0), (1, 3.0, None)]
    frame = spark.createDataFrame(rows, "s int, t double, v double")
    got = timeseries.hold_last(frame, "s", "t", "v", 10.0).select("s", "t", "v").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 1.0, 5.0), (None, 2.0, 5.0), (1, 1.0, 7.0), (1, None, None), (1, None, 3.0), (1, 3.0, 7.0)]))
    filled = timeseries.resample(frame.where("t IS NOT NULL"), "s", "t", "v", 1.0, 10.0).where("s IS NULL").collect()
    assert sorted((r.n, r.source_t) for r in filled) == [(0, 1.0), (1, 2.0)]


def test_thin_buckets_are_one_chunk(spark):
    """A row in each of many buckets; a chunk costs more than a row."""
    rows = spark.range(3000).selectExpr("id % 3 AS key", "cast(id * 10 AS double) AS t")
    got = scan.chunks(rows, "key", "t", 5.0, 5.0)
    assert got.select("key", "_chunk").distinct().count() == 3 and got.count() == 3000 and got.where("_sole AND _own").count() == 3000


def test_chunks_of_single_buckets_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 1)
    test_tracks_over_many_chunks_equal_a_plain_loop(spark, 0)
    test_segments_over_many_chunks_equal_a_plain_loop(spark, 1)
    monkeypatch.setattr(scan, "ROWS", 40)
    test_tracks_over_many_chunks_equal_a_plain_loop(spark, 1)
