"""Operators over keyed, time-ordered frames.

A stream may be most of the input, so no window spans one. What looks back or ahead
without limit works in two levels: windows within (stream, time bucket), and a small
window over the buckets' own values. What looks at a number of neighbours works in
blocks of consecutive rows, to which the neighbours' edge rows are copied.

``width`` is the length of a time bucket in the unit of the order column; it changes
the work, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def carry(df: DataFrame, stream: str, t: str, value: Column, name: str, width: float, back: bool = True, strict: bool = False) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` up to and at a row's ``t``, or (not ``back``) the first from it on.

    ``strict`` leaves the row itself out. A null stream is a stream like others; a row without a time is beside no other: it
    has its own value, or none if ``strict``. Of several values at one time the largest is the last one (chance, if they hold maps, which have no order).

    ``width`` is the bucket's length in the unit of ``t``; it changes the work, not the result.
    """
    buckets = df.withColumn("_value", value).withColumn("_bucket", F.floor(F.col(t) / width))
    order = F.col(t) if back else F.col(t).desc()
    ties = [] if "map<" in buckets.schema["_value"].dataType.simpleString() else ["_value"]
    # rows without a time are apart from each other, so each is its own window
    alone = F.when(F.col("_bucket").isNull(), F.monotonically_increasing_id())
    inside = Window.partitionBy(stream, "_bucket", "_alone").orderBy(order, F.col("_value").isNull(), *(F.col(c) if back else F.col(c).desc() for c in ties)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    rows = buckets.withColumn("_alone", alone).withColumn("_own", F.last("_value", ignorenulls=True).over(inside))
    pick = F.max_by if back else F.min_by
    at = F.struct(t, *ties)
    held = buckets.where(F.col("_bucket").isNotNull()).groupBy(stream, "_bucket").agg(pick("_value", F.when(F.col("_value").isNotNull(), at)).alias("_edge"))
    along = Window.partitionBy(stream).orderBy(F.col("_bucket") if back else F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col(stream).alias("_held_stream"), F.col("_bucket").alias("_held_bucket"), F.last("_edge", ignorenulls=True).over(along).alias("_carried"))
    joined = rows.join(held, F.col(stream).eqNullSafe(F.col("_held_stream")) & (F.col("_bucket") == F.col("_held_bucket")), "left")
    return joined.withColumn(name, F.coalesce("_own", "_carried")).drop("_value", "_bucket", "_alone", "_own", "_carried", "_held_stream", "_held_bucket")


def numbered(df: DataFrame, stream: str, order: str, width: float, name: str, total: str | None = None) -> DataFrame:
    """Adds ``name``, the position of each row within its stream from 0, and ``total``, the stream's number of rows."""
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    up_to = Window.partitionBy(stream).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(stream, "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col(stream).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(stream)).alias("_total"))
    own = F.row_number().over(Window.partitionBy(stream, "_bucket").orderBy(order))
    # null-safe: a null stream or order is a key like others
    joined = rows.withColumn("_own", own).join(sizes, F.col(stream).eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b"))).drop("_s", "_b")
    joined = joined.withColumn(name, F.col("_first") + F.col("_own") - 1)
    return (joined.withColumn(total, F.col("_total")) if total else joined).drop("_bucket", "_own", "_first", "_total")


#: Rows in one block.
BLOCK = 8192


def blocks(df: DataFrame, stream: str, order: str, width: float, before: int = 0, after: int = 0, total: str | None = None) -> DataFrame:
    """Rows with ``_i`` (position within the stream) and ``_block``, each block with ``before`` and ``after`` rows of its neighbours.

    Windows over (stream, ``_block``) in the order of ``_i`` see what windows over whole streams would, within that
    reach; only rows with ``_inside`` count then. ``after`` and ``before`` are at most ``BLOCK``.
    """
    rows = numbered(df, stream, order, width, "_i", total)
    own, place = F.floor(F.col("_i") / BLOCK), F.col("_i") % BLOCK
    copies = [F.struct(own.alias("b"), F.lit(True).alias("inside"))]
    if before:
        copies.append(F.when(place >= BLOCK - before, F.struct((own + 1).alias("b"), F.lit(False).alias("inside"))))
    if after:
        copies.append(F.when((place < after) & (own > 0), F.struct((own - 1).alias("b"), F.lit(False).alias("inside"))))
    dealt = rows.withColumn("_c", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    return dealt.withColumn("_block", F.col("_c.b")).withColumn("_inside", F.col("_c.inside")).drop("_c")


def along(stream: str) -> WindowSpec:
    """The window along the rows of a block of ``blocks``."""
    return Window.partitionBy(stream, "_block").orderBy("_i")


def _ended(rows: DataFrame, *drop: str) -> DataFrame:
    return rows.where("_inside").drop("_i", "_block", "_inside", *drop)


def frame_index(df: DataFrame, stream: str, t: str, name: str = "frame_index", width: float = 600.0) -> DataFrame:
    """Adds the position of each row within its stream, from 0."""
    return numbered(df, stream, t, width, name)


def grid(frames: DataFrame, stream: str, t: str, fps: float, max_frames: int | None = None, live: bool = False) -> DataFrame:
    """(stream, n, target): target times start + n / fps of every stream.

    Offline the grid runs up to the last frame plus a millionth of a period; live
    it has round((last - first) * fps) + 1 points.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    ends = frames.groupBy(stream).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    span = (F.col("_b") - F.col("_a")) * fps
    last = F.rint(span) if live else F.floor(span + 1e-6)
    if max_frames is not None:
        last = F.least(last, F.lit(max_frames - 1))
    rows = ends.select(stream, "_a", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("n"))
    return rows.select(stream, "n", (F.col("_a") + F.col("n") / fps).alias("target"))


def resample(frames: DataFrame, stream: str, t: str, payload: str, fps: float, width: float, max_frames: int | None = None, live: bool = False) -> DataFrame:
    """(stream, n, target, source_t, payload): the frame nearest to each grid time, the earlier of two equally near.

    Grid and frames are carried along one order, so there is no range join. Live,
    streams of fewer than two frames pass through as they are.
    """
    points = grid(frames, stream, t, fps, max_frames, live).withColumnRenamed("target", "_t")
    seen = frames.select(stream, F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), F.col(payload).alias("p")).alias("_f"))
    both = points.withColumn("_f", F.lit(None).cast(seen.schema["_f"].dataType)).unionByName(seen.withColumn("n", F.lit(None).cast("long")))
    both = carry(both, stream, "_t", F.col("_f"), "_before", width)
    both = carry(both, stream, "_t", F.col("_f"), "_after", width, back=False).where("n is not null")
    before, after = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    near = F.when(F.col("_after").isNull() | (before <= after), F.col("_before")).otherwise(F.coalesce("_after", "_before"))
    return both.withColumn("_near", near).select(stream, "n", F.col("_t").alias("target"), F.col("_near.t").alias("source_t"), F.col("_near.p").alias(payload))


def interpolate(df: DataFrame, stream: str, order: str, value: str, width: float) -> DataFrame:
    """Replaces null ``value`` arrays: linear between known rows, held at the ends, null if a stream has none.

    ``order`` is the position of the row, which is also the distance that is interpolated over.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    rows = carry(df, stream, order, known, "_prev", width)
    rows = carry(rows, stream, order, known, "_next", width, back=False)
    share = (F.col(order) - F.col("_prev.i")) / (F.col("_next.i") - F.col("_prev.i"))
    between = F.zip_with("_prev.v", "_next.v", lambda a, b: a + share * (b - a))
    filled = F.coalesce(F.col(value), F.when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), between), F.col("_prev.v"), F.col("_next.v"))
    return rows.withColumn(value, filled).drop("_prev", "_next")


def smooth(df: DataFrame, stream: str, order: str, points: str, window: int, width: float = 600.0) -> DataFrame:
    """Mean shape over a symmetric margin that shrinks at the ends, put back on the frame's own centroid.

    ``points`` is an array of x, y, x, y, ...; rows are consecutive in ``order``.
    """
    half = window // 2
    rows = blocks(df, stream, order, width, half, half, "_n")
    rows = rows.withColumn("_near", F.collect_list(points).over(along(stream).rowsBetween(-half, half))).where("_inside")
    margin = F.least(F.lit(half), F.col("_i"), F.col("_n") - 1 - F.col("_i"))
    rows = rows.withColumn("_m", margin.cast("int"))
    # the collected rows begin at most ``half`` before this one
    taken = F.slice("_near", F.least(F.lit(half), F.col("_i")).cast("int") - F.col("_m") + 1, F.col("_m") * 2 + 1)
    count = F.size(points)
    mean = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.aggregate(taken, F.lit(0.0), lambda a, p: a + p[k]) / F.size(taken))
    rows = rows.withColumn("_mean", mean)

    def centre(a: Column, axis: int) -> Column:
        return F.aggregate(F.filter(a, lambda x, k: k % 2 == axis), F.lit(0.0), lambda s, x: s + x) * 2 / count

    shifts = [centre(F.col(points), axis) - centre(F.col("_mean"), axis) for axis in (0, 1)]
    rows = rows.withColumn("_dx", shifts[0]).withColumn("_dy", shifts[1])
    moved = F.transform("_mean", lambda x, k: x + F.when(k % 2 == 0, F.col("_dx")).otherwise(F.col("_dy")))
    return rows.withColumn(points, moved).drop("_i", "_block", "_inside", "_n", "_near", "_m", "_mean", "_dx", "_dy")


def motion_energies(df: DataFrame, stream: str, t: str, aperture: str, wanted: dict[str, tuple[int, str]], width: float = 600.0) -> DataFrame:
    """Adds columns: each name's mean or max (its statistic) of the last (its window) absolute changes of ``aperture``.

    A null aperture resets; it and the first frame after it have energy 0. The frames are put in order once for all.
    """
    ordered = along(stream)
    rows = blocks(df, stream, t, width, max(window for window, _ in wanted.values()))
    rows = rows.withColumn("_change", F.abs(F.col(aperture) - F.lag(aperture).over(ordered)))
    # the changes since the last row without one: the null itself, the first known frame, or the beginning
    rows = rows.withColumn("_run", F.count_if(F.col("_change").isNull()).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    pick = {"mean": F.avg, "max": F.max}
    within = Window.partitionBy(stream, "_block", "_run").orderBy("_i")
    energies = {name: pick[statistic]("_change").over(within.rowsBetween(-(window - 1), 0)) for name, (window, statistic) in wanted.items()}
    return _ended(rows.withColumns({name: F.when(F.col("_change").isNull(), 0.0).otherwise(e) for name, e in energies.items()}), "_run", "_change")


def motion_energy(df: DataFrame, stream: str, t: str, aperture: str, window: int = 3, statistic: str = "mean", width: float = 600.0) -> DataFrame:
    """Adds ``energy``, one of ``motion_energies``."""
    return motion_energies(df, stream, t, aperture, {"energy": (window, statistic)}, width)


def inter_arrival_fps(df: DataFrame, stream: str, t: str, keep: float = 0.9, least: float = 0.001, width: float = 600.0) -> DataFrame:
    """(stream, ema, fps) of the smoothed gap between frames; 0 fps where there is one frame only.

    ema = keep * previous + (1 - keep) * gap, begun with the first gap, each at
    least ``least``. Written as a weighted sum: the weights fall geometrically, so
    it is an aggregation and not a walk along the stream.
    """
    rows = blocks(df.select(stream, t), stream, t, width, 1, total="_n")
    rows = rows.withColumn("_gap", F.greatest(F.col(t) - F.lag(t).over(along(stream)), F.lit(least))).where("_inside")
    weight = F.pow(F.lit(keep), F.col("_n") - 1 - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1 - keep)
    gap = F.when(F.col("_i") > 0, F.col("_gap"))
    sums = rows.groupBy(stream).agg(F.sum(weight * gap).alias("ema"))
    return sums.withColumn("fps", F.when(F.col("ema") > 0, 1 / F.col("ema")).otherwise(0.0))


def latest(df: DataFrame, stream: str, t: str, n: int) -> DataFrame:
    """The last ``n`` rows of each stream, newest first in ``recency`` (1 is newest)."""
    rank = F.row_number().over(Window.partitionBy(stream).orderBy(F.col(t).desc()))
    return df.withColumn("recency", rank).where(F.col("recency") <= n)


def oldest(df: DataFrame, stream: str, t: str, n: int) -> DataFrame:
    """The first ``n`` rows of each stream, as a consumer takes them."""
    rank = F.row_number().over(Window.partitionBy(stream).orderBy(t))
    return df.withColumn("position", rank).where(F.col("position") <= n)


def window_of(df: DataFrame, stream: str, t: str, seconds: float, fps: float) -> DataFrame:
    """The last round(seconds * fps) rows of each stream, as a buffer that counts frames gives for a time."""
    return latest(df, stream, t, round(seconds * fps))


def drain(df: DataFrame, stream: str, t: str, seconds: float, fps: float) -> DataFrame:
    """All that a buffer of round(seconds * fps) frames still holds, oldest first in ``position`` (1 is oldest)."""
    held = latest(df, stream, t, round(seconds * fps))
    size = F.max("recency").over(Window.partitionBy(stream))  # of at most as many rows as the buffer holds
    return held.withColumn("position", size - F.col("recency") + 1).drop("recency")


def order_violations(df: DataFrame, stream: str, t: str, index: str, width: float = 600.0) -> DataFrame:
    """(stream, rows, not_increasing, not_sequential) of rows in the order of ``index``; ``width`` is in its unit."""
    rows = blocks(df.select(stream, t, index), stream, index, width, 1)
    rows = rows.withColumn("_dt", F.col(t) - F.lag(t).over(along(stream))).withColumn("_di", F.col(index) - F.lag(index).over(along(stream))).where("_inside")
    return rows.groupBy(stream).agg(F.count("*").alias("rows"), F.count_if(F.col("_dt") <= 0).alias("not_increasing"), F.count_if(F.col("_di") != 1).alias("not_sequential"))


def tumbling_rate(df: DataFrame, stream: str, t: str, width: float) -> DataFrame:
    """(stream, window_start, frames, rate) of windows of ``width`` seconds."""
    start = F.floor(F.col(t) / width) * width
    return df.groupBy(stream, start.cast("double").alias("window_start")).agg(F.count("*").alias("frames")).withColumn("rate", F.col("frames") / width)


def hold_last(df: DataFrame, stream: str, t: str, value: str, width: float) -> DataFrame:
    """Replaces null ``value`` by the last one before it; ``error`` says where none has been seen yet."""
    rows = carry(df, stream, t, F.col(value), "_held", width)
    return rows.withColumn(value, F.col("_held")).withColumn("error", F.when(F.col("_held").isNull(), "no value yet")).drop("_held")


#: Buckets of ``percentiles`` to a doubling of the value.
PER_DOUBLING = 1024


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column for each of ``shares``): exact percentiles, between two values by their distance; null for a key without values.

    Selection by counts: values are counted in buckets that keep their order (some 0.07 % wide), the counts tell
    which bucket holds a rank, and only rows of those buckets are ranked. No aggregate holds a key's values. A null key is a key; NaN counts as no value.
    """
    v = F.col("_v")
    width = lambda x: F.floor(F.log2(x) * PER_DOUBLING) + 2_000_000
    bucket = F.when(v > 0, width(v)).when(v < 0, -width(-v)).otherwise(F.lit(0).cast("long"))
    every = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    rows = every.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", F.when(F.abs(v) == float("inf"), F.signum(v) * 4_000_000).otherwise(bucket).cast("long"))
    along = Window.partitionBy("_k").orderBy("_b")
    counts = rows.groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(along)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_k")))
    ranks = [f(q * (F.col("_all") - 1)).cast("long") for q in shares.values() for f in (F.floor, F.ceil)]
    first = F.col("_upto") - F.col("_n")
    wanted = counts.withColumn("_ranks", F.filter(F.array_distinct(F.array(*ranks)), lambda r: (r >= first) & (r < F.col("_upto")))).where(F.size("_ranks") > 0)
    wanted = wanted.select(F.col("_k").alias("_wk"), F.col("_b").alias("_wb"), "_ranks", first.alias("_first"), "_all")
    near = rows.join(wanted, F.col("_k").eqNullSafe(F.col("_wk")) & (F.col("_b") == F.col("_wb")))
    equal = near.groupBy("_k", "_b", "_v").agg(F.count("*").alias("_n"), F.first("_ranks").alias("_ranks"), F.first("_first").alias("_first"), F.first("_all").alias("_all"))
    upto = F.col("_first") + F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_v"))
    placed = equal.withColumn("_upto", upto)
    held = placed.withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))))
    # a value for each rank: at most two a share
    found = held.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"), F.first("_all").alias("_all"))
    columns = []
    for name, q in shares.items():
        place = q * (F.col("_all") - 1)
        low, high = (F.element_at("_m", f(place).cast("long")) for f in (F.floor, F.ceil))
        columns.append(F.when(low == high, low).otherwise(low + (place - F.floor(place)) * (high - low)).alias(name))
    found = found.select(F.col("_k").alias("_fk"), *columns)
    keys = every.select("_k").distinct()
    return keys.join(found, F.col("_k").eqNullSafe(F.col("_fk")), "left").select(F.col("_k").alias(key), *shares)
