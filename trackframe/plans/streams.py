"""Queries over event streams, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import jobs, segments, sweeps, timeseries, tracking
from trackframe.plans.tables import EVENT_PARAMS, EVENTS_SQL, KEYPOINTS_SQL, WEEK, events, keypoints

P = EVENT_PARAMS
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GRID_FPS = 1 / 21600  # a frame every six hours


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _energy_sql(statistic: str, window: int) -> str:
    return f"""runs AS (SELECT *, count(*) FILTER (WHERE aperture IS NULL) OVER (PARTITION BY stream_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM events_),
changes AS (SELECT *, abs(aperture - lag(aperture) OVER (PARTITION BY stream_id, run ORDER BY t)) AS change FROM runs),
motion AS (SELECT *, CASE WHEN change IS NULL THEN 0 ELSE {statistic}(change) OVER (PARTITION BY stream_id, run ORDER BY t ROWS {window - 1} PRECEDING) END AS energy FROM changes)"""


@query(f"WITH {EVENTS_SQL}, {_energy_sql('avg', 3)} SELECT event_id, stream_id, t, round(energy, 6) AS energy FROM motion")
def motion_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeseries.motion_energy(events(spark, sf_dir), "stream_id", "t", "aperture", width=WEEK)
    return _rounded(found.select("event_id", "stream_id", "t", "energy"), "energy")


@query(f"WITH {EVENTS_SQL}, {_energy_sql('max', 5)} SELECT event_id, stream_id, t, round(energy, 6) AS energy FROM motion")
def motion_energy_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeseries.motion_energy(events(spark, sf_dir), "stream_id", "t", "aperture", 5, "max", WEEK)
    return _rounded(found.select("event_id", "stream_id", "t", "energy"), "energy")


def _segments_sql(source: str, start: float = P.start, stop: float = P.stop, name: str = "segments") -> str:
    """The recurrence as a recursive CTE over ``source`` (stream_id, t, e)."""
    open_ = f"e >= {start}"
    active = f"CASE WHEN f.e >= {stop} THEN f.t ELSE s.active END"
    length, quiet = "f.t - s.start_t", f"f.t - coalesce({active}, f.t)"
    closed = f"s.start_t IS NOT NULL AND ({length} >= {P.max_length} OR ({quiet} >= {P.hangover} AND {length} >= {P.min_length}))"
    over = f"s.start_t IS NOT NULL AND ({length} >= {P.max_length} OR {quiet} >= {P.hangover})"
    fresh = f"CASE WHEN f.{open_} THEN f.t END"
    return f"""{name}_n AS (SELECT stream_id, t, e, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i FROM {source}),
{name}_s AS (
  SELECT stream_id, i, t, CASE WHEN {open_} THEN t END AS start_t, CASE WHEN {open_} THEN t END AS active, NULL::DOUBLE AS seg_start, NULL::VARCHAR AS reason FROM {name}_n WHERE i = 1
  UNION ALL
  SELECT f.stream_id, f.i, f.t, CASE WHEN {over} THEN NULL WHEN s.start_t IS NOT NULL THEN s.start_t ELSE {fresh} END,
    CASE WHEN {over} THEN NULL WHEN s.start_t IS NOT NULL THEN {active} ELSE {fresh} END,
    CASE WHEN {closed} THEN s.start_t END, CASE WHEN {closed} THEN CASE WHEN {length} >= {P.max_length} THEN 'max_length' ELSE 'silence' END END
  FROM {name}_s s JOIN {name}_n f ON f.stream_id = s.stream_id AND f.i = s.i + 1),
{name}_a AS (
  SELECT stream_id, seg_start AS start_time, t AS end_time, reason FROM {name}_s WHERE reason IS NOT NULL
  UNION ALL
  SELECT stream_id, start_t, t, 'stream_end' FROM (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY i DESC) = 1) WHERE t - start_t >= {P.min_length}),
{name} AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_time) AS sequence, start_time, end_time, reason FROM {name}_a)"""


_E = "e_ AS (SELECT stream_id, t, value AS e FROM events_)"
_SEGMENTS = f"WITH RECURSIVE {EVENTS_SQL}, {_E}, {_segments_sql('e_')}"


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment(events(spark, sf_dir), "stream_id", "t", "value", P)


@query(f"{_SEGMENTS} SELECT * FROM segments")
def utterance_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_segments(spark, sf_dir)


@query(f"{_SEGMENTS} SELECT reason, count(*) AS segments, round(sum(end_time - start_time), 3) AS seconds FROM segments GROUP BY reason")
def segment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_segments(spark, sf_dir)
    return found.groupBy("reason").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("end_time") - F.col("start_time")), 3).alias("seconds"))


@query(f"{_SEGMENTS} SELECT u.stream_id, count(sequence) AS segments FROM (SELECT DISTINCT stream_id FROM events_) u LEFT JOIN segments s ON s.stream_id = u.stream_id GROUP BY ALL")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_counts(event_segments(spark, sf_dir), events(spark, sf_dir), "stream_id")


@query(f"{_SEGMENTS} SELECT s.stream_id, sequence, event_id, t FROM segments s JOIN events_ e ON s.stream_id = e.stream_id AND t BETWEEN start_time - 3600 AND end_time")
def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = segments.collect(event_segments(spark, sf_dir), events(spark, sf_dir), "stream_id", "t", 3600.0, P.max_length)
    return joined.select("stream_id", "sequence", "event_id", "t")


@query(
    f"""{_SEGMENTS}, j AS (SELECT s.stream_id, sequence, event_id, start_time, end_time, row_number() OVER (PARTITION BY s.stream_id, sequence ORDER BY t DESC) AS r FROM segments s JOIN events_ e ON s.stream_id = e.stream_id AND t BETWEEN start_time - 3600 AND end_time)
SELECT stream_id, sequence, event_id FROM j WHERE r <= round_even(least(end_time - start_time + 3600, 300000) * {GRID_FPS}, 0)"""
)
def segment_frames_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = segments.collect_by_count(event_segments(spark, sf_dir), events(spark, sf_dir), "stream_id", "t", 3600.0, P.max_length, GRID_FPS, 300_000.0)
    return joined.select("stream_id", "sequence", "event_id")


@query(
    f"""{_SEGMENTS}, k AS (SELECT * FROM events_ WHERE value >= 90), n AS (SELECT *, round_even(least(end_time - start_time + 3600, 300000) * {GRID_FPS}, 0) AS wanted FROM segments),
j AS (SELECT n.stream_id, sequence, event_id, t, wanted, t >= start_time - 3600 AS own FROM n JOIN k ON n.stream_id = k.stream_id AND t <= end_time),
r AS (SELECT *, bool_or(own) OVER (PARTITION BY stream_id, sequence) AS has FROM j)
SELECT stream_id, sequence, event_id FROM r WHERE own = has QUALIFY row_number() OVER (PARTITION BY stream_id, sequence ORDER BY t DESC) <= wanted"""
)
def segment_frames_or_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a capture that kept loud frames only: a segment without frames takes the last ones before its end."""
    kept = events(spark, sf_dir).where("value >= 90")
    joined = segments.collect_by_count(event_segments(spark, sf_dir), kept, "stream_id", "t", 3600.0, P.max_length, GRID_FPS, 300_000.0)
    return joined.select("stream_id", "sequence", "event_id")


@query(
    f"""WITH {EVENTS_SQL}, h AS (SELECT event_id, stream_id, last_value(aperture IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS aperture FROM events_)
SELECT event_id, stream_id, aperture, CASE WHEN aperture IS NULL THEN 'no value yet' END AS error FROM h"""
)
def hold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.hold_last(events(spark, sf_dir), "stream_id", "t", "aperture", WEEK).select("event_id", "stream_id", "aperture", "error")


def _resample_sql(points: str, live: bool = False) -> str:
    return f"""WITH {EVENTS_SQL}, ends AS (SELECT stream_id, min(t) AS a, max(t) AS b FROM events_ GROUP BY 1),
grid AS (SELECT stream_id, n, a + n / {GRID_FPS} AS target FROM (SELECT stream_id, a, unnest(range(0, {points})) AS n FROM ends)),
near AS (SELECT g.stream_id, n, target, event_id FROM grid g JOIN events_ e ON g.stream_id = e.stream_id QUALIFY row_number() OVER (PARTITION BY g.stream_id, n ORDER BY abs(t - target), t) = 1)
SELECT stream_id, n::BIGINT AS n, target, event_id FROM near"""


@query(_resample_sql(f"least(400, floor((b - a) * {GRID_FPS} + 1e-6)::BIGINT + 1)"))
def resample_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeseries.resample(events(spark, sf_dir), "stream_id", "t", "event_id", GRID_FPS, WEEK, max_frames=400)
    return found.select("stream_id", "n", "target", "event_id")


@query(_resample_sql(f"round_even((b - a) * {GRID_FPS}, 0)::BIGINT + 1"))
def resample_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeseries.resample(events(spark, sf_dir), "stream_id", "t", "event_id", GRID_FPS, WEEK, live=True)
    return found.select("stream_id", "n", "target", "event_id")


@query(
    f"""WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) - 1 AS i FROM events_),
k AS (SELECT *, max(CASE WHEN aperture IS NOT NULL THEN i END) OVER (PARTITION BY stream_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p,
  min(CASE WHEN aperture IS NOT NULL THEN i END) OVER (PARTITION BY stream_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM n)
SELECT k.event_id, k.stream_id, k.i AS frame_index, round(CASE WHEN k.aperture IS NOT NULL THEN k.aperture WHEN a.aperture IS NOT NULL AND b.aperture IS NOT NULL
  THEN a.aperture + (k.i - p) / (q - p) * (b.aperture - a.aperture) ELSE coalesce(a.aperture, b.aperture) END, 6) AS aperture
FROM k LEFT JOIN n a ON a.stream_id = k.stream_id AND a.i = p LEFT JOIN n b ON b.stream_id = k.stream_id AND b.i = q"""
)
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.frame_index(events(spark, sf_dir), "stream_id", "t", width=WEEK)
    rows = rows.withColumn("aperture", F.when(F.col("aperture").isNotNull(), F.array("aperture")))
    filled = timeseries.interpolate(rows, "stream_id", "frame_index", "aperture", 64.0)
    return filled.select("event_id", "stream_id", F.col("frame_index").cast("long").alias("frame_index"), F.round(F.col("aperture")[0], 6).alias("aperture"))


@query(
    f"""WITH {KEYPOINTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS c FROM keypoints),
m AS (SELECT *, least(6, i, c - 1 - i) AS m FROM n),
s AS (SELECT a.stream_id, a.vec_id, any_value(a.points) AS own, {", ".join(f"avg(b.points[{k}]) AS s{k}" for k in range(1, 9))} FROM m a JOIN n b ON a.stream_id = b.stream_id AND b.i BETWEEN a.i - a.m AND a.i + a.m GROUP BY ALL),
d AS (SELECT *, (own[1] + own[3] + own[5] + own[7] - s1 - s3 - s5 - s7) / 4 AS dx, (own[2] + own[4] + own[6] + own[8] - s2 - s4 - s6 - s8) / 4 AS dy FROM s)
SELECT stream_id, vec_id, {", ".join(f"round(s{k} + {'dx' if k % 2 else 'dy'}, 5) AS p{k}" for k in range(1, 9))} FROM d"""
)
def smooth_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.smooth(keypoints(spark, sf_dir), "stream_id", "vec_id", "points", 12, 4096)
    return rows.select("stream_id", "vec_id", *(F.round(F.col("points")[k], 5).alias(f"p{k + 1}") for k in range(8)))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, g AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i, greatest(t - lag(t) OVER (PARTITION BY stream_id ORDER BY t), 0.001) AS gap FROM events_),
r AS (SELECT stream_id, i, gap AS ema FROM g WHERE i = 2 UNION ALL SELECT g.stream_id, g.i, 0.9 * ema + 0.1 * gap FROM r JOIN g ON g.stream_id = r.stream_id AND g.i = r.i + 1)
SELECT u.stream_id, round(ema, 4) AS ema, round(coalesce(1 / ema, 0), 9) AS fps FROM (SELECT DISTINCT stream_id FROM events_) u
LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY i DESC) = 1) l ON l.stream_id = u.stream_id"""
)
def inter_arrival_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeseries.inter_arrival_fps(events(spark, sf_dir), "stream_id", "t", width=WEEK)
    return found.select("stream_id", F.round("ema", 4).alias("ema"), F.round("fps", 9).alias("fps"))


@query(f"WITH {EVENTS_SQL} SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) AS recency FROM events_ QUALIFY recency <= 20")
def rolling_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.latest(events(spark, sf_dir), "stream_id", "t", 20).select("stream_id", "event_id", "recency")


@query(f"WITH {EVENTS_SQL} SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) AS recency FROM events_ QUALIFY recency <= round_even(1.5 * 5, 0)")
def buffer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of the last second and a half, counted at five a second."""
    return timeseries.window_of(events(spark, sf_dir), "stream_id", "t", 1.5, 5.0).select("stream_id", "event_id", "recency")


@query(f"WITH {EVENTS_SQL}, h AS (SELECT * FROM events_ QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) <= 40) SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS position FROM h")
def buffer_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a buffer of eight seconds at five frames a second holds, oldest first."""
    return timeseries.drain(events(spark, sf_dir), "stream_id", "t", 8.0, 5.0).select("stream_id", "event_id", "position")


@query(f"WITH {EVENTS_SQL} SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS position FROM events_ QUALIFY position <= 5")
def buffer_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.oldest(events(spark, sf_dir), "stream_id", "t", 5).select("stream_id", "event_id", "position")


@query(
    f"""WITH {EVENTS_SQL}, d AS (SELECT stream_id, t - lag(t) OVER w AS dt, event_id - lag(event_id) OVER w AS di FROM events_ WINDOW w AS (PARTITION BY stream_id ORDER BY event_id))
SELECT stream_id, count(*) AS rows, count(*) FILTER (WHERE dt <= 0) AS not_increasing, count(*) FILTER (WHERE di <> 1) AS not_sequential FROM d GROUP BY 1"""
)
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.order_violations(events(spark, sf_dir), "stream_id", "t", "event_id", 4096)


@query(f"WITH {EVENTS_SQL} SELECT stream_id, floor(t / 604800) * 604800 AS window_start, count(*) AS frames, count(*) / 604800 AS rate FROM events_ GROUP BY ALL")
def tumbling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.tumbling_rate(events(spark, sf_dir), "stream_id", "t", WEEK)


@query(f"WITH {EVENTS_SQL} SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS frames_received FROM events_ QUALIFY frames_received % 5 = 0")
def status_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.frame_index(events(spark, sf_dir), "stream_id", "t", width=WEEK).withColumn("frames_received", F.col("frame_index") + 1)
    return rows.where(F.col("frames_received") % 5 == 0).select("stream_id", "event_id", F.col("frames_received").cast("long").alias("frames_received"))


@query(
    f"""WITH {EVENTS_SQL}, r AS (SELECT *, value * 100 <= 15000 AS ok FROM events_), h AS (SELECT *, ok AND row_number() OVER (PARTITION BY stream_id, ok ORDER BY t DESC) <= 40 AS held FROM r)
SELECT stream_id, count(*) FILTER (WHERE ok) AS received, count(*) FILTER (WHERE NOT ok) AS rejected, count(*) FILTER (WHERE held) AS buffered_frames,
  coalesce(max(t) FILTER (WHERE held) - min(t) FILTER (WHERE held), 0) AS buffered_seconds, greatest(0, count(*) FILTER (WHERE ok) - 40) AS evicted FROM h GROUP BY 1"""
)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message sizes are a hundred times the value; the buffer holds forty frames."""
    return jobs.session_stats(events(spark, sf_dir), "stream_id", "t", F.col("value") * 100, 8.0, 5.0, 15_000)


_SWEEP = sweeps.settings(["avg", "max"], [3, 5], [60.0, 110.0], [30.0, 60.0])


def _sweep_sql() -> str:
    """Every setting's segments; ``max`` and ``avg`` name the statistic in both."""
    parts, names = [EVENTS_SQL], []
    for statistic, window in dict.fromkeys(x[:2] for x in _SWEEP):
        key = f"{statistic}{window}"
        own = _energy_sql(statistic, window)
        for name in ("runs", "changes", "motion"):
            own = own.replace(f"{name} AS", f"{name}_{key} AS").replace(f"FROM {name}", f"FROM {name}_{key}")
        parts += [own, f"m_{key} AS (SELECT stream_id, t, energy AS e FROM motion_{key})"]
        for start, stop in (x[2:] for x in _SWEEP if x[:2] == (statistic, window)):
            name = f"s_{key}_{int(start)}_{int(stop)}"
            parts.append(_segments_sql(f"m_{key}", start, stop, name))
            names.append(f"SELECT '{'mean' if statistic == 'avg' else 'max'}' AS statistic, {window} AS \"window\", {start}::DOUBLE AS \"start\", {stop}::DOUBLE AS \"stop\", u.stream_id, u.stream_id % 2 = 0 AS wanted, count(s.sequence) > 0 AS found FROM u LEFT JOIN {name} s ON s.stream_id = u.stream_id GROUP BY ALL")
    union = " UNION ALL ".join(names)
    return f"""WITH RECURSIVE {", ".join(parts)}, u AS (SELECT DISTINCT stream_id FROM events_), every_ AS ({union})
SELECT statistic, "window", "start", "stop", count(*) FILTER (WHERE wanted AND found) AS hits, count(*) FILTER (WHERE wanted AND NOT found) AS misses, count(*) FILTER (WHERE NOT wanted AND found) AS false_alarms,
  hits - 2 * false_alarms - misses AS score FROM every_ GROUP BY ALL ORDER BY score DESC, false_alarms, hits DESC, statistic, "window", "start", "stop" LIMIT 5"""


@query(_sweep_sql())
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of even users should have a segment; the five best settings."""
    grid = [("mean" if s == "avg" else s, *rest) for s, *rest in _SWEEP]
    scored = sweeps.sweep(events(spark, sf_dir), "stream_id", "t", "aperture", F.col("stream_id") % 2 == 0, grid, P, WEEK)
    return sweeps.leaderboard(scored, 5)


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, {_energy_sql('avg', 3)}, m_ AS (SELECT stream_id, t, energy AS e FROM motion), {_segments_sql('m_')},
c AS (SELECT stream_id, count(*) AS n FROM segments GROUP BY 1)
SELECT m.stream_id, count(*) FILTER (WHERE aperture IS NULL) AS unfitted, round(coalesce(quantile_cont(energy, 0.5) FILTER (WHERE energy > 0), 0), 6) AS p50,
  round(coalesce(quantile_cont(energy, 0.9) FILTER (WHERE energy > 0), 0), 6) AS p90, any_value(coalesce(n, 0)) AS segments, (any_value(coalesce(n, 0)) > 0) = (m.stream_id % 2 = 0) AS "right"
FROM motion m LEFT JOIN c ON c.stream_id = m.stream_id GROUP BY m.stream_id"""
)
def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    motion = timeseries.motion_energy(events(spark, sf_dir), "stream_id", "t", "aperture", width=WEEK)
    return _rounded(sweeps.report(motion, "stream_id", "t", "aperture", "energy", F.col("stream_id") % 2 == 0, P), "p50", "p90")


@query(
    f"""{_SEGMENTS} SELECT stream_id, sequence, CASE WHEN row_number() OVER (PARTITION BY stream_id ORDER BY sequence DESC) <= 2 THEN 'queued' ELSE 'displaced' END AS status,
row_number() OVER (PARTITION BY stream_id ORDER BY sequence) > 2 AS displaced_older FROM segments"""
)
def shed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.shed(event_segments(spark, sf_dir), "stream_id", "sequence").select("stream_id", "sequence", "status", "displaced_older")


@query(
    f"""{_SEGMENTS}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY stream_id ORDER BY sequence DESC) <= 2 THEN 'queued' ELSE 'displaced' END AS status FROM segments)
SELECT stream_id, count(*) AS submitted, 0::BIGINT AS completed, count(*) FILTER (WHERE status = 'displaced') AS dropped, count(*) FILTER (WHERE status = 'queued') AS depth FROM s GROUP BY 1"""
)
def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stats(jobs.shed(event_segments(spark, sf_dir), "stream_id", "sequence"), "stream_id")


@query(
    f"""{_SEGMENTS}, n AS (SELECT max(t) AS now FROM events_)
SELECT stream_id, sequence, now - end_time > 604800 AS dropped, CASE WHEN now - end_time > 604800 THEN printf('Discarded: waited %.1f s, more than %.1f s.', now - end_time, 604800.0) END AS error FROM segments, n"""
)
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = events(spark, sf_dir).agg(F.max("t")).first()[0]
    return jobs.stale(event_segments(spark, sf_dir), F.col("end_time"), F.lit(now), WEEK).select("stream_id", "sequence", "dropped", "error")


@query(
    f"""WITH {EVENTS_SQL}, a AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS sequence, t AS created FROM events_ WHERE event_type = 'signup'),
b AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS sequence, t AS started FROM events_ WHERE event_type = 'purchase')
SELECT a.stream_id, a.sequence, created, started, trunc((started - created) * 1000)::BIGINT AS queue_wait_ms FROM a JOIN b USING (stream_id, sequence)"""
)
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups stand for jobs, purchases for their results."""
    rows = events(spark, sf_dir)
    made = jobs.number(rows.where("event_type = 'signup'").select("stream_id", F.col("t").alias("created")), "stream_id", "created", WEEK)
    done = jobs.number(rows.where("event_type = 'purchase'").select("stream_id", F.col("t").alias("started")), "stream_id", "started", WEEK)
    return jobs.results(made, done, ["stream_id", "sequence"])


@query(
    f"""WITH {EVENTS_SQL} SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) AS position,
coalesce(t = max(t) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY stream_id), false) AS latest FROM events_ QUALIFY position <= 12"""
)
def result_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("dropped", F.col("event_type") == "error")
    return jobs.history(rows, "stream_id", "t", "dropped").select("stream_id", "event_id", "position", "latest")


@query(
    f"""WITH {EVENTS_SQL}, u AS (SELECT stream_id, t, event_id, 'frame' AS kind FROM events_ WHERE event_type <> 'signup' UNION ALL SELECT stream_id, t, NULL, 'flush' FROM events_ WHERE event_type = 'signup')
SELECT stream_id, event_id, kind, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS sequence FROM u"""
)
def control_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and control messages as one ordered stream; signups stand for flush messages."""
    rows = events(spark, sf_dir)
    frames = rows.where("event_type <> 'signup'").select("stream_id", "t", "event_id", F.lit("frame").alias("kind"))
    control = rows.where("event_type = 'signup'").select("stream_id", "t", F.lit("flush").alias("kind"))
    return jobs.number(frames.unionByName(control, allowMissingColumns=True), "stream_id", "t", WEEK).select("stream_id", "event_id", "kind", "sequence")


@query(
    f"""WITH {KEYPOINTS_SQL}, d AS (SELECT stream_id, vec_id, points[7] AS x, points[8] AS y, points[7] - lag(points[7]) OVER w AS dx, points[8] - lag(points[8]) OVER w AS dy FROM keypoints WINDOW w AS (PARTITION BY stream_id ORDER BY vec_id))
SELECT stream_id, round(stddev_pop(x), 6) AS std_x, round(stddev_pop(y), 6) AS std_y, round(avg((abs(dx) + abs(dy)) / 2), 6) AS mean_change, round(max(sqrt(dx * dx + dy * dy)), 6) AS max_jump FROM d GROUP BY 1"""
)
def track_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread, mean change and largest jump of the fourth point of every stream."""
    rows = keypoints(spark, sf_dir).select("stream_id", "vec_id", F.col("points")[6].alias("x"), F.col("points")[7].alias("y"))
    return _rounded(tracking.stability(rows, "stream_id", "vec_id", "x", "y", 4096), "std_x", "std_y", "mean_change", "max_jump")
