"""Streaming queries: a table is replayed until it is used up, the result read from what the sink wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.timing import seconds
from trackframe.operators import jobs
from trackframe.params import Live
from trackframe.plans import clips
from trackframe.plans.streams import _SEGMENTS, GRID_FPS, _segments_sql
from trackframe.plans.tables import EVENT_PARAMS, EVENTS_SQL, WEEK, events, folder_of
from trackframe.streaming import live, queue, scorers, sessions, sink
from trackframe.streaming.sink import FORMAT

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return folder_of(spark, "live")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = live.source(spark, f"{sf_dir}/events.parque[t]", schema)
    return rows.select(
        F.col("user_id").alias("stream_id"), F.timestamp_micros(F.round(seconds(F.col("ts")) * 1e6).cast("long")).alias("ts"), seconds(F.col("ts")).alias("t"), F.lit(None).cast("double").alias("aperture"),
        F.col("value").alias("energy"), F.lit("frame").alias("kind"), "event_type", "event_id",
    )


def _run(stream: DataFrame, folder: str, each=None, mode: str = "append", sink: str | None = None) -> None:
    """Run a stream until its source is used up; the session's state store is put back afterwards."""
    conf = stream.sparkSession.conf
    before = conf.get(live.PROVIDER, None)
    conf.set(live.PROVIDER, live.ROCKSDB)
    try:
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
        writer = writer.foreachBatch(each) if each else writer.format(FORMAT).option("path", sink) if sink else writer.format("parquet").option("path", f"{folder}/out")
        writer.start().awaitTermination()
    finally:
        conf.set(live.PROVIDER, before) if before else conf.unset(live.PROVIDER)


_CLOSED = "closed AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY sequence DESC) AS newness FROM segments WHERE reason <> 'stream_end')"


@query(f"{_SEGMENTS} SELECT stream_id, sequence, start_time, end_time, reason FROM segments WHERE reason <> 'stream_end'")
def live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that close while the stream runs; nothing flushes it."""
    folder = _folder(spark)
    _run(live.segments(replay(spark, sf_dir), EVENT_PARAMS), folder)
    return spark.read.schema(live.SEGMENTS).parquet(f"{folder}/out")


#: Signups flush a stream, every 29th event resets it, other events are frames; errors miss their subject.
_KIND = "CASE WHEN event_type = 'signup' THEN 'flush' WHEN event_id % 29 = 0 THEN 'reset' ELSE 'frame' END"


def _controls_sql() -> str:
    """Energy, segmenter and control messages as one recursion."""
    p = EVENT_PARAMS
    length, active = "t - start_t", f"CASE WHEN e >= {p.stop} THEN t ELSE active END"
    over = f"({length} >= {p.max_length} OR t - coalesce({active}, t) >= {p.hangover})"
    return f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT stream_id, t, aperture, {_KIND} AS kind, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i FROM events_),
s AS (SELECT DISTINCT stream_id, 0::BIGINT AS i, NULL::DOUBLE AS start_t, NULL::DOUBLE AS active, NULL::DOUBLE AS last_t, NULL::DOUBLE AS prev, []::DOUBLE[] AS changes, NULL::DOUBLE AS seg_start, NULL::DOUBLE AS seg_end, NULL::VARCHAR AS reason FROM n
  UNION ALL
  SELECT stream_id, i,
    CASE WHEN kind <> 'frame' THEN NULL WHEN start_t IS NULL THEN CASE WHEN e >= {p.start} THEN t END WHEN {over} THEN NULL ELSE start_t END,
    CASE WHEN kind <> 'frame' THEN NULL WHEN start_t IS NULL THEN CASE WHEN e >= {p.start} THEN t END WHEN {over} THEN NULL ELSE {active} END,
    CASE WHEN kind = 'frame' THEN t ELSE last_t END, CASE kind WHEN 'frame' THEN aperture WHEN 'flush' THEN prev END, changes,
    start_t, CASE WHEN kind = 'frame' THEN t ELSE last_t END,
    CASE WHEN start_t IS NULL OR kind = 'reset' THEN NULL WHEN kind = 'flush' THEN CASE WHEN last_t - start_t >= {p.min_length} THEN 'stream_end' END
      WHEN {length} >= {p.max_length} THEN 'max_length' WHEN {over} AND {length} >= {p.min_length} THEN 'silence' END
  FROM (SELECT *, CASE WHEN kind = 'frame' THEN coalesce(list_avg(changes), 0) END AS e FROM (
    SELECT f.stream_id, f.i, f.t, f.kind, f.aperture, start_t, active, last_t, prev, CASE WHEN f.kind = 'flush' THEN changes WHEN f.kind = 'reset' OR f.aperture IS NULL THEN [] WHEN prev IS NULL THEN changes
      WHEN len(changes) < 3 THEN list_append(changes, abs(f.aperture - prev)) ELSE list_append(changes[2:], abs(f.aperture - prev)) END AS changes
    FROM s JOIN n f ON f.stream_id = s.stream_id AND f.i = s.i + 1)))
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY i) AS sequence, seg_start AS start_time, seg_end AS end_time, reason FROM s WHERE reason IS NOT NULL"""


@query(_controls_sql())
def live_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy from the aperture, and flush and reset messages, within a running stream."""
    folder = _folder(spark)
    rows = replay(spark, sf_dir).withColumn("kind", F.expr(_KIND)).withColumn("aperture", F.when(F.col("event_type") != "error", F.col("energy"))).withColumn("energy", F.lit(None).cast("double"))
    _run(live.segments(rows, EVENT_PARAMS), folder)
    return spark.read.schema(live.SEGMENTS).parquet(f"{folder}/out")


@query(
    f"""{_SEGMENTS}, g AS (SELECT stream_id, t, row_number() OVER w AS i, greatest(t - lag(t) OVER w, 0.001) AS gap, t - first_value(t) OVER (PARTITION BY stream_id ORDER BY t ROWS 39 PRECEDING) AS held FROM events_ WINDOW w AS (PARTITION BY stream_id ORDER BY t)),
r AS (SELECT stream_id, i, gap AS ema FROM g WHERE i = 2 UNION ALL SELECT g.stream_id, g.i, 0.9 * ema + 0.1 * gap FROM r JOIN g ON g.stream_id = r.stream_id AND g.i = r.i + 1)
SELECT s.stream_id, s.i AS frames_received, CASE WHEN start_t IS NULL THEN 'idle' ELSE 'speaking' END AS state, round(coalesce(s.t - start_t, 0), 3) AS utterance_seconds, round(coalesce(1 / ema, 0), 9) AS fps,
  least(s.i, 40) AS buffered_frames, round(held, 3) AS buffered_seconds FROM segments_s s JOIN g ON g.stream_id = s.stream_id AND g.i = s.i LEFT JOIN r ON r.stream_id = s.stream_id AND r.i = s.i WHERE s.i % 5 = 0"""
)
def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame's status: counters, state, frame rate and what the buffer of forty frames holds."""
    folder = _folder(spark)
    _run(live.statuses(replay(spark, sf_dir), EVENT_PARAMS, Live(buffer_seconds=8.0, fps=5.0)), folder)
    rows = spark.read.schema(live.STATUS).parquet(f"{folder}/out")
    return rows.select("stream_id", "frames_received", "state", F.round("utterance_seconds", 3).alias("utterance_seconds"), F.round("fps", 9).alias("fps"), "buffered_frames", F.round("buffered_seconds", 3).alias("buffered_seconds"))


@query(clips.ORACLES["subject_tracking"])
def live_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of ``subject_tracking`` as a stream of three triggers; the last box is its state."""
    folder = _folder(spark)
    made = clips.candidates(spark, sf_dir).select("stream_id", "frame", "cand", "box.*", F.lit("box").alias("kind"))
    made.write.parquet(f"{folder}/made")  # once, for all triggers
    rows = spark.read.schema(made.schema).parquet(f"{folder}/made")
    low, high = rows.agg(F.min("frame"), F.max("frame")).first()
    for i in range(3):  # whole frames in a file, earlier ones first
        rows.where(F.floor((F.col("frame") - low) * 3 / (high - low + 1)) == i).repartition(1).write.mode("append").parquet(f"{folder}/candidates")
    _run(live.track(live.source(spark, f"{folder}/candidates", rows.schema, 1)), folder)
    return spark.read.schema(live.TRACK).parquet(f"{folder}/out").select("stream_id", "frame", "cand", "x", "y")


@query(f"{_SEGMENTS}, {_CLOSED} SELECT stream_id, sequence, CASE WHEN newness <= 2 THEN 'queued' ELSE 'displaced' END AS status FROM closed")
def live_shedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a stream's queue of two keeps of a trigger. The SQL is that of one trigger, as a table of one file has."""
    folder = _folder(spark)
    _run(live.segments(replay(spark, sf_dir), EVENT_PARAMS), folder, live.shedding(f"{folder}/kept", f"{folder}/dropped"))
    both = [spark.read.parquet(f"{folder}/{part}").select("stream_id", "sequence", "status") for part in ("kept", "dropped")]
    return both[0].unionByName(both[1])


@query(
    f"""{_SEGMENTS}, {_CLOSED}, n AS (SELECT max(t) AS now FROM events_) SELECT stream_id, sequence, CASE WHEN now - end_time <= 604800 THEN round(end_time - start_time)::BIGINT || ' s' END AS text,
CASE WHEN now - end_time > 604800 THEN printf('Discarded: waited %.1f s, more than %.1f s.', now - end_time, 604800.0) END AS error, now - end_time > 604800 AS dropped, trunc((now - end_time) * 1000)::BIGINT AS queue_wait_ms FROM closed, n WHERE newness <= 2"""
)
def live_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a continuous sink has of every job that was run or was too old; a segment's length stands for its transcript. One trigger, as above."""
    folder, now = _folder(spark), events(spark, sf_dir).agg(F.max("t")).first()[0]
    score = lambda jobs: jobs.select("stream_id", "sequence", F.concat(F.round(F.col("end_time") - F.col("start_time")).cast("long").cast("string"), F.lit(" s")).alias("text"), F.lit(None).cast("string").alias("error"))
    _run(live.segments(replay(spark, sf_dir), EVENT_PARAMS), folder, live.results(f"{folder}/results", score, F.lit(now), 2, WEEK))
    return spark.read.parquet(f"{folder}/results").drop("batch")


@query(f"WITH {EVENTS_SQL} SELECT stream_id, floor(t / 604800) * 604800 AS window_start, count(*) AS frames FROM events_ GROUP BY ALL")
def live_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each week, as windows of the stream. A trigger writes the windows that it changed; the last writing counts."""
    folder = _folder(spark)
    write = lambda batch, i: batch.withColumn("at", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
    _run(live.rates(replay(spark, sf_dir), "ts", "7 days", "30 days"), folder, write, "update")
    rows = spark.read.parquet(f"{folder}/out").groupBy("stream_id", F.unix_micros("w.start").alias("m")).agg(F.max_by("count", "at").alias("frames"))
    return rows.select("stream_id", (F.col("m") / 1e6).alias("window_start"), "frames")


#: Frames and clips of several seconds, scaled to events hours apart: a session ends after three days, a buffer holds sixteen frames.
_LIVE = Live(lead_in=3600.0, buffer_seconds=345600.0, fps=GRID_FPS, idle=259200.0)
_DELAY = 20 * 86400


def shuffled(spark: SparkSession, sf_dir: str, folder: str, parts: int = 5) -> DataFrame:
    """``events`` as a stream of ``parts`` triggers in which rows arrive up to ``_DELAY`` seconds late, and a last one with a row of another stream, far later."""
    rows = events(spark, sf_dir).select("stream_id", "t", F.col("value").alias("energy"), F.lit("frame").alias("kind"), F.col("event_id").cast("string").cast("binary").alias("payload"), "event_type")
    rows = rows.withColumn("_arrival", F.col("t") + F.pmod(F.xxhash64("payload"), F.lit(_DELAY)))
    low, high = rows.agg(F.min("_arrival"), F.max("_arrival")).first()
    step = (high - low) / parts
    for i in range(parts):  # one after the other: the source takes files by their age
        upper = F.lit(True) if i == parts - 1 else F.col("_arrival") < low + (i + 1) * step
        rows.where((F.col("_arrival") >= low + i * step) & upper).drop("_arrival").repartition(1).write.mode("append").parquet(f"{folder}/in")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("stream_id"), F.lit(high + 2 * _DELAY).alias("t"), F.lit(0.0).alias("energy"), F.lit("tick").alias("kind"), F.lit(None).cast("binary").alias("payload"), F.lit("tick").alias("event_type"))
    last.repartition(1).write.mode("append").parquet(f"{folder}/in")
    stream = live.source(spark, f"{folder}/in", rows.drop("_arrival").schema, 1)
    return stream.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))


def _sessions_sql() -> str:
    """Sessions by gaps; each is a stream of its own."""
    sessions = f"""gaps AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY stream_id ORDER BY t) > {_LIVE.idle})::INT, 0) AS new FROM events_),
parts AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY t) AS part FROM gaps),
began AS (SELECT *, min(t) OVER (PARTITION BY stream_id, part) AS session FROM parts),
e_ AS (SELECT {{'s': stream_id, 'b': session}} AS stream_id, t, value AS e FROM began)"""
    return f"WITH RECURSIVE {EVENTS_SQL}, {sessions}, {_segments_sql('e_')}"


@query(f"{_sessions_sql()} SELECT stream_id.s AS stream_id, stream_id.b AS session, sequence, start_time, end_time, reason FROM segments")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of sessions that end when frames stop, of rows that arrive in any order over six triggers."""
    folder = _folder(spark)
    _run(sessions.segments(shuffled(spark, sf_dir, folder), f"{_DELAY} seconds", EVENT_PARAMS, _LIVE), folder)
    return spark.read.schema(sessions.ENDED).parquet(f"{folder}/out")


@query(
    f"""{_sessions_sql()}, j AS (SELECT s.*, b.t, b.event_id, row_number() OVER (PARTITION BY s.stream_id, sequence ORDER BY b.t DESC) AS back FROM segments s JOIN began b ON b.stream_id = s.stream_id.s AND b.session = s.stream_id.b AND b.t <= end_time),
w AS (SELECT * FROM j WHERE back <= round_even(least(end_time - start_time + {_LIVE.lead_in}, {_LIVE.buffer_seconds}) * {_LIVE.fps}, 0) AND t >= start_time - {_LIVE.lead_in}),
ends AS (SELECT stream_id, sequence, start_time, end_time, reason, min(t) AS a, max(t) AS b FROM w GROUP BY ALL),
grid AS (SELECT *, unnest(range(0, round_even((b - a) * {2 * GRID_FPS}, 0)::BIGINT + 1)) AS n FROM ends)
SELECT g.stream_id.s AS stream_id, g.stream_id.b AS session, g.sequence, g.reason, n, event_id FROM grid g JOIN w ON w.stream_id = g.stream_id AND w.sequence = g.sequence
QUALIFY row_number() OVER (PARTITION BY g.stream_id, g.sequence, n ORDER BY abs(t - (a + n / {2 * GRID_FPS})), t) = 1"""
)
def live_segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads (here event numbers) of the frames of each closed segment, from its lead-in on, on a grid of a frame every three hours."""
    folder = _folder(spark)
    _run(sessions.segment_frames(shuffled(spark, sf_dir, folder), f"{_DELAY} seconds", 2 * GRID_FPS, EVENT_PARAMS, _LIVE), folder)
    rows = spark.read.schema(sessions.FRAMES).parquet(f"{folder}/out")
    return rows.select("stream_id", "session", "sequence", "reason", "n", F.col("payload").cast("string").cast("long").alias("event_id"))


def _queue_sql() -> str:
    """Signups are jobs, purchases say that the worker is free; a queue of two, three days of patience, as a recursion over a stream's messages."""
    fresh, age = "list_filter(pending, lambda x: n.t - x.c <= 259200)", "list_filter(pending, lambda x: n.t - x.c > 259200)"
    outcome = lambda job, what, wait: f"{{'q': {job}, 'o': '{what}', 'w': {wait}}}"
    stale = f"list_transform({age}, lambda x: {outcome('x.q', 'stale', 'n.t - x.c')})"
    return f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT stream_id, t, event_id, event_type = 'signup' AS job, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i FROM events_ WHERE event_type IN ('signup', 'purchase')),
s AS (SELECT DISTINCT stream_id, 0::BIGINT AS i, NULL::DOUBLE AS t, NULL::BIGINT AS busy, []::STRUCT(q BIGINT, c DOUBLE)[] AS pending, 0 AS submitted, 0 AS completed, []::STRUCT(q BIGINT, o VARCHAR, w DOUBLE)[] AS told FROM n
  UNION ALL
  SELECT n.stream_id, n.i, n.t, CASE WHEN job THEN coalesce(busy, event_id) WHEN busy IS NULL THEN NULL ELSE {fresh}[1].q END,
    CASE WHEN job THEN CASE WHEN busy IS NULL THEN [] WHEN len(pending) < 2 THEN list_append(pending, {{'q': event_id, 'c': n.t}}) ELSE list_append(pending[2:], {{'q': event_id, 'c': n.t}}) END WHEN busy IS NULL THEN pending ELSE {fresh}[2:] END,
    submitted + job::INT, completed + (NOT job AND busy IS NOT NULL)::INT,
    CASE WHEN job THEN CASE WHEN busy IS NULL THEN [{outcome('event_id', 'taken', '0.0')}] WHEN len(pending) < 2 THEN [] ELSE [{outcome('pending[1].q', 'displaced', 'n.t - pending[1].c')}] END
      WHEN busy IS NULL THEN [] ELSE list_concat({stale}, CASE WHEN len({fresh}) > 0 THEN [{outcome(f'{fresh}[1].q', 'taken', f'n.t - {fresh}[1].c')}] ELSE [] END) END
  FROM s JOIN n ON n.stream_id = s.stream_id AND n.i = s.i + 1),
o AS (SELECT stream_id, i, t, submitted, completed, unnest(told, recursive := true), unnest(range(1, len(told) + 1)) AS k, len(pending) AS depth FROM s)
SELECT stream_id, q AS sequence, o AS outcome, floor(w * 1000)::BIGINT AS queue_wait_ms, submitted::BIGINT AS submitted, completed::BIGINT AS completed,
  count(*) FILTER (WHERE o <> 'taken') OVER (PARTITION BY stream_id ORDER BY i, k) AS dropped FROM o"""


@query(_queue_sql())
def live_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each job of a queue that lives through six triggers of rows in any order; the last part of the stream is still in it."""
    folder = _folder(spark)
    rows = shuffled(spark, sf_dir, folder).withColumn("sequence", F.col("payload").cast("string").cast("long"))
    made, done = rows.where("event_type = 'signup'"), rows.where("event_type IN ('purchase', 'tick')").withColumn("sequence", F.lit(None).cast("long"))
    _run(queue.outcomes(made, done, f"{_DELAY} seconds", 2, 259200.0, 1e9), folder)
    return spark.read.schema(queue.OUTCOME).parquet(f"{folder}/out").select("stream_id", "sequence", "outcome", "queue_wait_ms", "submitted", "completed", "dropped")


#: Signups are jobs, purchases results; the fifth of a stream's jobs has the fifth result, if it comes within five days.
_PAIRS = f"""WITH {EVENTS_SQL}, a AS (SELECT stream_id, t, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS sequence FROM events_ WHERE event_type = 'signup'),
b AS (SELECT stream_id, t, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS sequence FROM events_ WHERE event_type = 'purchase')"""


@query(
    f"""{_PAIRS} SELECT a.stream_id, a.sequence, b.event_id IS NULL AS dropped, b.event_id::VARCHAR AS text, floor((b.t - a.t) * 1000)::BIGINT AS wait_ms
FROM a LEFT JOIN b ON b.stream_id = a.stream_id AND b.sequence = a.sequence AND b.t BETWEEN a.t AND a.t + 432000"""
)
def live_job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two running streams joined: jobs and their results, or that none came within five days."""
    folder = _folder(spark)
    for name, kind in (("jobs", "signup"), ("results", "purchase")):
        rows = jobs.number(events(spark, sf_dir).where(F.col("event_type") == kind).select("stream_id", "t", F.col("event_id").cast("string").alias("text")), "stream_id", "t", WEEK)
        rows = rows.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long"))).select("stream_id", F.col("sequence").cast("long"), "ts", "text")
        low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
        for i in range(3):
            part = F.least(F.lit(2), F.floor((F.unix_micros("ts") - low) * 3 / (high - low + 1)))
            rows.where(part == i).repartition(1).write.mode("append").parquet(f"{folder}/{name}")
        last = spark.range(1).select(F.lit(-1).cast("long").alias("stream_id"), F.col("id").alias("sequence"), F.timestamp_micros(F.lit(high + 100 * 86_400_000_000)).alias("ts"), F.lit(None).cast("string").alias("text"))
        last.repartition(1).write.mode("append").parquet(f"{folder}/{name}")
    schema = "stream_id long, sequence long, ts timestamp, text string"
    made, done = (live.source(spark, f"{folder}/{name}", schema, 1) for name in ("jobs", "results"))
    _run(queue.joined(made, done.withColumnRenamed("ts", "done_ts"), "10 days", 432000.0), folder)
    rows = spark.read.schema("stream_id long, sequence long, created timestamp, finished timestamp, text string, dropped boolean, wait_ms long").parquet(f"{folder}/out")
    return rows.where("stream_id >= 0").select("stream_id", "sequence", "dropped", "text", "wait_ms")


@query(f"{_SEGMENTS} SELECT stream_id, sequence, start_time, end_time, reason FROM segments WHERE reason <> 'stream_end'")
def live_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``live_segments`` through the sink that commits by trigger."""
    folder = _folder(spark)
    sink.register(spark)
    _run(live.segments(replay(spark, sf_dir), EVENT_PARAMS), folder, sink=f"{folder}/results")
    return sink.committed(spark, f"{folder}/results", live.SEGMENTS).drop("batch")


def message_files(spark: SparkSession, sf_dir: str, folder: str, parts: int = 4) -> DataFrame:
    """``events`` as files of messages: frames of ten bytes, errors without a subject, JSON control messages, some malformed or too large."""
    rows = events(spark, sf_dir).withColumn("kind", F.expr(_KIND))
    control = F.when(F.col("event_id") % 7 == 0, F.lit('{"type": ')).otherwise(F.concat(F.lit('{"type": "'), "kind", F.lit('"}')))
    frame = F.repeat(F.lit("x"), F.when(F.col("event_id") % 31 == 0, 40).otherwise(10))
    text = F.col("kind") != "frame"
    made = rows.select("stream_id", "t", text.alias("is_text"), F.when(text, control).otherwise(frame).cast("binary").alias("message"), "aperture")
    low, high = made.agg(F.min("t"), F.max("t")).first()
    for i in range(parts):  # one after the other: the source takes files by their age
        made.where(F.least(F.lit(parts - 1), F.floor((F.col("t") - low) * parts / (high - low))) == i).repartition(1).write.mode("append").parquet(f"{folder}/messages")
    return live.admitted(live.messages(spark, f"{folder}/messages", 1 << 10), Live(max_message=20))


#: What ``message_files`` makes of an event, and what is left of it.
_ADMITTED = _KIND.replace("THEN 'flush'", "THEN CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'flush' END").replace("THEN 'reset'", "THEN CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'reset' END").replace("ELSE 'frame'", "WHEN event_id % 31 = 0 THEN 'oversized' ELSE 'frame'")


@query(_controls_sql().replace(f"{_KIND} AS kind, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i FROM events_", f"kind, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i FROM (SELECT *, {_ADMITTED} AS kind FROM events_) WHERE kind IN ('frame', 'flush', 'reset')"))
def live_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and control messages in one stream of files, a few bytes a trigger; malformed and oversized ones are left out."""
    folder = _folder(spark)
    rows = message_files(spark, sf_dir, folder).where("kind IN ('frame', 'flush', 'reset')").withColumn("energy", F.lit(None).cast("double"))
    _run(live.segments(rows.drop("size"), EVENT_PARAMS), folder)
    return spark.read.schema(live.SEGMENTS).parquet(f"{folder}/out")


@query(
    f"""WITH {EVENTS_SQL}, k AS (SELECT stream_id, {_ADMITTED} AS kind FROM events_) SELECT stream_id, count(*) FILTER (WHERE kind = 'frame') AS frames, count(*) FILTER (WHERE kind = 'oversized') AS oversized,
count(*) FILTER (WHERE kind IN ('flush', 'reset')) AS controls, count(*) FILTER (WHERE kind = 'error') AS malformed FROM k GROUP BY 1"""
)
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's messages by what became of them; a trigger writes the counts that it changed, the last writing counts."""
    folder = _folder(spark)
    write = lambda batch, i: batch.withColumn("at", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
    _run(live.counters(message_files(spark, sf_dir, folder)), folder, write, "update")
    rows = spark.read.parquet(f"{folder}/out")
    names = ("frames", "oversized", "controls", "malformed")
    return rows.groupBy("stream_id").agg(*(F.max_by(n, "at").alias(n) for n in names))


def _loudest():
    """A scorer that says how many frames are loud, and fails on clips of under five frames."""

    def score(rows):
        if len(rows) < 5:
            raise ValueError("too few frames")
        loud = int((rows["value"] >= EVENT_PARAMS.start).sum())
        return [(f"{loud} loud", -float(len(rows) - loud), [loud])]

    return score


@query(
    "SELECT user_id::VARCHAR AS clip_id, count(*) AS frames, CASE WHEN count(*) BETWEEN 5 AND 1500 THEN count(*) FILTER (WHERE value >= 50) || ' loud' END AS text, CASE WHEN count(*) < 5 THEN 'ValueError: too few frames' WHEN count(*) > 1500 THEN 'ValueError: ' || count(*) || ' frames, at most 1500 are taken' END AS error FROM events GROUP BY 1"
)
def scored_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's model over every clip; its failures are rows."""
    scorers.register("loudest", _loudest)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    found = scorers.transcribe(rows, "user_id", "event_id", scorers.create("loudest"))
    return found.select("clip_id", "frames", F.get("hypotheses", F.lit(0))["text"].alias("text"), "error")
