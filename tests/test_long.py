"""Long texts, hot streams and pixels: distances by bits, percentiles by counts, stacks in blocks, crops past the edge."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.functions import text
from trackframe.operators import pixels, timeseries


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_by_bits_equals_the_table():
    rnd = random.Random(1)
    for _ in range(600):
        k = rnd.randint(1, 5)
        a = rnd.choices("abcdef"[:k], k=rnd.randint(0, 40))
        b = rnd.choices("abcdef"[:k], k=rnd.randint(0, 90)) if rnd.random() < 0.5 else [x for x in a if rnd.random() < 0.9] + rnd.choices("ab", k=rnd.randint(0, 3))
        assert text.distance_bits(a, b) == text.distance_bits("".join(b), "".join(a)) == table_distance(a, b), (a, b)


def test_twenty_thousand_words_in_a_second():
    rnd = random.Random(2)
    a = [f"w{rnd.randint(0, 5000)}" for _ in range(20_000)]
    b = [x if rnd.random() < 0.7 else "other" for x in a if rnd.random() < 0.95]
    began = time.process_time()
    found = text.distance_bits(a, b)
    assert 5_000 < found < 9_000 and time.process_time() - began < 2


def test_long_and_short_texts_in_one_column(spark):
    rnd = random.Random(3)
    make = lambda n: " ".join(rnd.choices(["ab", "c", "déf", "𝒳"], k=n))
    rows = [(make(n), make(m)) for n, m in ((3, 4), (0, 5), (600, 700), (1, 1200), (30, 30))] + [("a b", None), ("", "")]
    frame = spark.createDataFrame(rows, "r string, h string")
    got = frame.select(text.word_errors(F.col("r"), F.col("h")).alias("w"), text.character_errors(F.col("r"), F.col("h")).alias("c")).collect()
    for (r, h), x in zip(rows, got, strict=True):
        a, b = (r or "").split(), (h or "").split()
        assert tuple(x.w) == (table_distance(a, b), len(a))
        assert tuple(x.c) == (text.distance_bits("".join(a), "".join(b)), len("".join(a)))


def test_percentiles_equal_those_of_all_values(spark):
    rnd = random.Random(4)
    values = {
        1: [rnd.gauss(0, 1) for _ in range(5000)], 2: [3.5] * 400, 3: [rnd.choice([-1.0, 0.0, 1e-300, 1e300, 7.25]) for _ in range(999)],
        4: [2.0 ** rnd.randint(-40, 40) for _ in range(77)], 5: [1.0], 6: [1.0, 2.0], None: [rnd.random() for _ in range(10)], 8: [float(i) for i in range(1000)], 9: [float("-inf"), -0.0, 1.0, float("inf")],
    }
    rows = [(k, v) for k, own in values.items() for v in own] + [(7, None), (1, None), (6, float("nan"))]
    rnd.shuffle(rows)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    got = {r.s: r for r in timeseries.percentiles(spark.createDataFrame(rows, "s int, v double"), "s", "v", shares).collect()}
    assert got.keys() == values.keys() | {7} and all(got[7][n] is None for n in shares)
    for k, own in values.items():
        for n, q in shares.items():
            if k == 9 and n not in "acf":
                continue
            assert got[k][n] == pytest.approx(0.5 if (k, n) == (9, "c") else np.quantile(np.array(own), q) if k != 9 else {"a": float("-inf"), "f": float("inf")}[n], rel=1e-12), (k, n)


def test_no_state_holds_a_hot_streams_values(spark):
    """A third of a million different values of one stream: ranked rows are those of a few buckets."""
    rows = spark.range(300_000).select(F.lit(1).alias("s"), (F.pmod(F.col("id") * 7919, F.lit(300_000)) / 7.0 + 1).alias("v"))
    got = timeseries.percentiles(rows, "s", "v", {"p50": 0.5, "p90": 0.9}).first()
    exact = rows.agg(F.percentile("v", 0.5), F.percentile("v", 0.9)).first()
    assert tuple(got)[1:] == pytest.approx(tuple(exact))


def image(h, w, c, value=None):
    rng = np.random.default_rng(h * 100 + w * 10 + c)
    return (rng.integers(0, 256, (h, w, c)) if value is None else np.full((h, w, c), value)).astype(np.uint8)


ROW = "clip string, i long, height int, width int, channels int, pixels binary, x double, y double, error_code int"


def row(clip, i, a, x=0.0, y=0.0):
    return (clip, i, *a.shape, a.tobytes(), x, y, 5)


def test_crops(spark):
    """The size asked for, channels kept, black beyond an edge, the point in the middle."""
    dot = image(256, 256, 1, 0)
    dot[128, 100] = 255
    bright, grey = image(256, 256, 3, 200), image(256, 256, 1, 200)
    rows = [row("a", 0, bright, 5.0, 5.0), row("a", 1, grey, 252.0, 252.0), row("a", 2, dot, 100.0, 128.0), row("a", 3, grey, None, 1.0), row("a", 4, grey, 900.0, -900.0), ("a", 5, 4, 4, 1, b"x", 1.0, 1.0, 5), ("a", 6, None, None, None, None, 1.0, 1.0, 5)]
    got = pixels.crop(spark.createDataFrame(rows, ROW), "x", "y").orderBy("i").collect()
    patch = [None if r.pixels is None else np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels) for r in got]
    assert [p.shape for p in patch[:3]] == [(96, 96, 3), (96, 96, 1), (96, 96, 1)] and {r.error_code for r in got} == {5}
    assert patch[0][0, 0].tolist() == [0] * 3 and patch[0][-1, -1].tolist() == [200] * 3 and patch[1][-1, -1, 0] == 0 and patch[2][48, 48, 0] == 255 and patch[2].sum() == 255
    assert [r.error for r in got] == [None, None, None, "no centre", None, "bad image 4x4x1 of 1 bytes", "no image"] and not patch[4].any()


def test_stacks_in_blocks(spark):
    long = [image(2, 3, 1, k % 251) for k in range(700)]
    rows = [row("long", k, a) for k, a in enumerate(long)]
    mixed = [image(4, 4, 1), image(4, 4, 3), image(4, 4, 1)]
    rows += [row("mixed", k, a) for k, a in enumerate(mixed)] + [row(None, 0, mixed[1])] + [row("odd", 0, mixed[0]), row("odd", 1, long[0])] + [("bad", 3, 2, 2, 3, b"", 0.0, 0.0, 1)]
    random.Random(5).shuffle(rows)
    got = {(r.clip, r.block): r for r in pixels.stack(spark.createDataFrame(rows, ROW), "clip", "i", 300, 64.0).collect()}
    assert set(got) == {("long", 0), ("long", 1), ("long", 2), ("mixed", 0), (None, 0), ("odd", 0), ("bad", 0)}
    assert [got["long", b].frames for b in range(3)] == [300, 300, 100]
    assert b"".join(got["long", b].pixels for b in range(3)) == b"".join(a.tobytes() for a in long)
    three = got["mixed", 0]
    assert (three.height, three.width, three.channels) == (4, 4, 3)
    assert np.array_equal(np.frombuffer(three.pixels, np.uint8).reshape(3, 4, 4, 3), np.stack([np.broadcast_to(a, (4, 4, 3)) for a in mixed]))
    assert got[None, 0].pixels == mixed[1].tobytes()
    assert got["odd", 0].error == "frame 1: 2x3, not 4x4" and got["odd", 0].pixels is None
    assert got["bad", 0].error == "frame 0: bad image 2x2x3 of 0 bytes"
    assert pixels.stack(spark.createDataFrame([], ROW), "clip", "i").count() == 0
