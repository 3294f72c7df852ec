"""Queues over several triggers against a plain worker; a sink whose query is killed between write and commit; back-pressure by bytes."""

import json
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trackframe.params import Live
from trackframe.streaming import live, queue, sink

SCHEMA = "stream_id long, t double, sequence long, kind string"


def write(spark, folder, triggers, schema):
    for rows in triggers:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def plain(events, size, max_age):
    """[(sequence, outcome)] and the counters of one stream's (t, kind, sequence) in order."""
    busy, pending, out, submitted, completed, dropped = None, [], [], 0, 0, 0
    for t, kind, sequence in sorted(events, key=lambda e: (e[0], e[1] != "done", e[2] or 0)):
        if kind == "submit":
            submitted += 1
            if busy is not None and len(pending) == size:
                out.append((pending.pop(0)[0], "displaced"))
                dropped += 1
            pending.append((sequence, t))
        elif busy is not None and sequence in (None, busy):
            busy, completed = None, completed + 1
        while busy is None and pending:
            sequence, made = pending.pop(0)
            if t - made > max_age:
                out.append((sequence, "stale"))
                dropped += 1
            else:
                busy = sequence
                out.append((sequence, "taken"))
    return out, (submitted, completed, dropped, len(pending))


@pytest.mark.parametrize("seed", range(2))
def test_outcomes_over_seven_triggers_equal_a_plain_worker(spark, tmp_path, seed):
    rnd, rows = random.Random(seed), []
    for s in range(3):
        t = 5.0
        for k in range(90):
            t = round(t + rnd.choice([0.1, 0.5, 3.0, 4.0]), 1)
            kind = rnd.choices(["submit", "done"], [3, 2])[0]
            rows.append((s, t, k if kind == "submit" else rnd.choice([None, k - 1]), kind))
    want = {s: plain([(t, k, q) for x, t, q, k in rows if x == s], 2, 6.0) for s in range(3)}
    end = max(r[1] for r in rows)
    late = sorted(rows, key=lambda r: r[1] + rnd.random() * 1.9)
    step = len(late) // 5 + 1
    write(spark, f"{tmp_path}/in", [late[i : i + step] for i in range(0, len(late), step)] + [[(9, end + 20.0, None, "tick")], [(9, end + 21.0, None, "tick")]], SCHEMA)
    stream = live.source(spark, f"{tmp_path}/in", SCHEMA, 1).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    found = queue.outcomes(stream.where("kind = 'submit'"), stream.where("kind <> 'submit'"), "2 seconds", 2, 6.0, 1000.0)
    spark.conf.set(live.PROVIDER, live.ROCKSDB)
    try:
        q = found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
    finally:
        spark.conf.unset(live.PROVIDER)
    assert len([x for x in q.recentProgress if x["numInputRows"]]) == 7
    got = spark.read.schema(queue.OUTCOME).parquet(f"{tmp_path}/out").collect()
    for s, (outcomes, counters) in want.items():
        own = sorted((r for r in got if r.stream_id == s), key=lambda r: (r.t, r.submitted, r.completed, r.dropped))
        assert sorted((r.sequence, r.outcome) for r in own) == sorted(outcomes)
        assert {"taken", "displaced", "stale"} <= {r.outcome for r in own}
        assert own[-1].submitted <= counters[0] and own[-1].dropped == counters[2]


def test_a_queue_keeps_the_newest_work():
    """One waits behind the job at work; its place goes to the next."""
    q = queue.Queue(1, 6.0)
    assert [x[2] for x in q.submit(0.0, 1)] == ["taken"] and q.submit(1.0, 2) == []
    assert [(x[0], x[2]) for x in q.submit(2.0, 3)] == [(2, "displaced")]
    assert [(x[0], x[2], x[3]) for x in q.done(3.0, 1)] == [(3, "taken", 1000)] and q.done(4.0, 1) == []
    q = queue.Queue(4, 0.1, queue.Queue(4, 0.1).save())
    q.submit(0.0, 1), q.submit(0.1, 2)
    found = q.done(0.5, None)
    assert [(x[0], x[2]) for x in found] == [(2, "stale")] and found[0][4] == "Discarded: waited 0.4 s, more than 0.1 s." and found[0][5:] == (2, 1, 1, 0)
    q.submit(1.0, 3), q.submit(1.1, 4)
    assert [(x[0], x[2]) for x in q.end(9.0)] == [(3, "abandoned"), (4, "abandoned")] and q.end(9.0) == []


def test_results_are_there_once_after_a_kill_between_write_and_commit(spark, tmp_path):
    folder, flag = str(tmp_path), tmp_path / "kill"
    write(spark, f"{folder}/in", [[(k,) for k in range(i * 10, i * 10 + 10)] for i in range(4)], "i long")

    class Killed(sink._Writer):
        """Dies after the third trigger's files are written, and tidies nothing up."""

        def commit(self, messages, batchId):
            if batchId == 2 and flag.exists():
                raise RuntimeError("killed")
            super().commit(messages, batchId)

        def abort(self, messages, batchId):
            pass

    class Killable(sink.Results):
        @classmethod
        def name(cls):
            return "killable"

        def streamWriter(self, schema, overwrite):
            return Killed(self.options["path"])

    spark.dataSource.register(Killable)

    def run():
        stream = live.source(spark, f"{folder}/in", "i long", 1)
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/c").format("killable").option("path", f"{folder}/results").start().awaitTermination()

    flag.touch()
    with pytest.raises(StreamingQueryException):
        run()
    seen = sink.committed(spark, f"{folder}/results", "i long").collect()
    assert sorted(r.i for r in seen) == list(range(20))
    assert spark.read.parquet(f"{folder}/results/data").count() == 30  # the lost trigger's file lies there
    flag.unlink()
    run()
    seen = sink.committed(spark, f"{folder}/results", "i long").collect()
    assert sorted(r.i for r in seen) == list(range(40)) and {r.batch for r in seen} == {0, 1, 2, 3}


def test_a_trigger_is_committed_once(tmp_path):
    """A trigger that is written again leaves the first record and removes its own files."""
    import pyarrow as pa

    writer = sink._Writer(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"i": [1, 2]})
    first, second, none = writer.write(iter([batch])), writer.write(iter([batch])), writer.write(iter([]))
    writer.commit([first, None, none], 7)
    writer.commit([second], 7)
    assert json.loads((tmp_path / "commits" / "7.json").read_text()) == {"batch": 7, "files": first.files} and none.files == []
    assert [x.name for x in (tmp_path / "data").iterdir()] == first.files
    third = writer.write(iter([batch]))
    writer.abort([third], 8)
    assert [x.name for x in (tmp_path / "data").iterdir()] == first.files


def test_a_producer_is_held_back_by_bytes(spark, tmp_path):
    rows = [[(1, float(i), False, bytes(random.Random(i).randbytes(40_000)), 0.1)] for i in range(12)]
    write(spark, f"{tmp_path}/in", rows, live.MESSAGES)
    size = max(x.stat().st_size for x in (tmp_path / "in").glob("*.parquet"))
    stream = live.admitted(live.messages(spark, f"{tmp_path}/in", 3 * size))
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").format("parquet").start(f"{tmp_path}/out")
    q.awaitTermination()
    taken = [x["numInputRows"] for x in q.recentProgress if x["numInputRows"]]
    assert sum(taken) == 12 and max(taken) <= 3 and len(taken) >= 4


def test_admission(spark):
    texts = ['{"type": "flush"}', '{"type": "dance"}', "{", "[]", "", None]
    rows = [(1, 0.0, True, None if t is None else t.encode(), None) for t in texts] + [(1, 0.0, False, b"x" * n, None) for n in (0, 20, 21)] + [(None, 0.0, None, b"x", None)]
    got = live.admitted(spark.createDataFrame(rows, live.MESSAGES), Live(max_message=20))
    assert [r.kind for r in got.collect()] == ["flush", "unknown", "error", "error", "error", "frame", "frame", "oversized"]
    assert [tuple(r) for r in live.counters(got).collect()] == [(1, 2, 1, 1, 4)]


def test_waits_are_those_of_seconds_as_doubles(spark):
    """Times a whole number of milliseconds apart, which doubles may bring just below it."""
    rnd = random.Random(3)
    pairs = [(i, at := 1_704_067_200_000_000 + rnd.randrange(10**12), at + 1000 * rnd.randrange(432_000_000)) for i in range(300)]
    wanted = {i: int((b / 1e6 - a / 1e6) * 1000) for i, a, b in pairs}
    assert any(wanted[i] != (b - a) // 1000 for i, a, b in pairs)
    rows = spark.createDataFrame(pairs, "sequence long, a long, b long").selectExpr("1L AS stream_id", "sequence", "timestamp_micros(a) AS ts", "timestamp_micros(b) AS done_ts", "'' AS text")
    got = queue.joined(rows.select("stream_id", "sequence", "ts"), rows.select("stream_id", "sequence", "done_ts", "text"), "10 days", 432000.0)
    assert {r.sequence: r.wait_ms for r in got.collect()} == wanted
