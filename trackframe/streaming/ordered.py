"""Stateful operators over many streams: those of a bucket at once, and in the order of time, whatever order rows come in."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from math import ceil
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Streams are dealt by hash to so many buckets, each a key of the stateful operator. A key costs milliseconds a trigger, whatever is in it, a stream in it
#: microseconds; a bucket is one task's, which holds the states of its streams (their number divided by this).
BUCKETS = 1024


def plain(batch: pd.DataFrame, row: str) -> Iterator[tuple]:
    """The rows of a batch by the schema ``row``: pandas has numbers for nulls and floats for whole numbers beside them; a state wants neither."""
    kinds = {"long": int, "int": int, "double": float}
    columns = []
    for name, kind in (x.split() for x in row.split(", ")):
        to = kinds.get(kind)
        values = batch[name].tolist()
        columns.append([None if x is None or x != x else to(x) for x in values] if to else [None if x is None or x != x else x for x in values])
    return zip(*columns, strict=True)


class Streams(ABC):
    """The streams of a bucket, each with its own state. Rows of a trigger come to ``step``, stream by stream.

    States come and go in the same batches as the rows; asking a state server for each stream's cost many times the work on the rows.
    """

    #: Columns of a row and of the result, and the fields of a stream's state (``a:long,b:string``).
    row: str
    result: str
    state: str

    @abstractmethod
    def step(self, stream: Any, state: tuple | None, rows: list[tuple], watermark: int) -> tuple[list[tuple], tuple | None, int | None]:
        """(results, state or None, when to wake, if no row comes) of a stream's new rows; times in milliseconds. Wakes once the watermark is beyond it."""

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() if self.timed else 0
        states = {own[0]: own for own in state.get[0]} if state.exists else {}
        rows: dict[Any, list[tuple]] = {stream: [] for stream, wake, *_ in states.values() if wake is not None and wake < watermark}
        for batch in batches:
            for stream, *row in plain(batch, f"stream_id long, {self.row}"):
                rows.setdefault(stream, []).append(tuple(row))
        out = []
        for stream, new in rows.items():
            old = states.pop(stream, None)
            told, own, wake = self.step(stream, None if old is None else tuple(old[2:]), new, watermark)
            out += told
            if own is not None:
                states[stream] = (stream, wake, *own)
        if states:
            state.update((list(states.values()),))
            wakes = [own[1] for own in states.values() if own[1] is not None]
            if wakes:
                state.setTimeoutTimestamp(max(1, watermark, min(wakes)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in self.result.split(", ")])

    #: Whether rows have a watermark.
    timed = False

    def over(self, rows: DataFrame) -> DataFrame:
        """The operator's results of a streaming DataFrame (stream_id, its row's columns)."""
        bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS)).cast("int"))
        schema = f"streams array<struct<stream_id:long,wake:long,{self.state}>>"
        return bucketed.groupBy("_bucket").applyInPandasWithState(self.__call__, self.result, schema, "append", "EventTimeTimeout" if self.timed else "NoTimeout")


class Ordered(Streams):
    """Rows wait in the state until the watermark has passed them; then ``walk`` gets them in order.

    A timeout wakes a bucket when a stream's next row is due, or at the time that ``walk`` asks for. State holds the rows within
    the delay, those of the current trigger included, so the source's limits bound it.
    """

    #: Fields of the operator's own state, and what they hold without one; the first column of ``row`` is ``t`` in seconds.
    own: str
    nothing: tuple
    timed = True

    @property
    def state(self) -> str:
        return f"kept:boolean,{self.own},waiting:array<struct<{self.row.replace(', ', ',').replace(' ', ':')}>>"

    @abstractmethod
    def rank(self, row: tuple) -> tuple:
        """The order of rows of one time."""

    @abstractmethod
    def walk(self, key: Any, own: tuple | None, due: list[tuple], watermark: float) -> tuple[list[tuple], tuple | None, float | None]:
        """(results, own state, when to wake next) of rows in order; no row up to ``watermark`` seconds can come any more."""

    def step(self, stream: Any, state: tuple | None, rows: list[tuple], watermark: int) -> tuple[list[tuple], tuple | None, int | None]:
        kept, *own, waiting = state or (False, [])
        rows = [*(tuple(r) for r in waiting), *rows]
        later = [r for r in rows if r[0] * 1000 > watermark]
        due = sorted((r for r in rows if r[0] * 1000 <= watermark), key=lambda r: (r[0], *self.rank(r)))
        out, mine, wake = self.walk(stream, tuple(own) if kept else None, due, watermark / 1000)
        if mine is None and not later:
            return out, None, None
        times = [ceil(min(r[0] for r in later) * 1000) - 1] if later else []
        times += [] if wake is None else [int(wake * 1000)]
        return out, (mine is not None, *(mine or self.nothing), later), min(times)


def apply(rows: DataFrame, delay: str, operator: Ordered) -> DataFrame:
    """An operator over a streaming DataFrame (stream_id, ts, t, ...), ``ts`` being the timestamp of ``t`` seconds.

    Columns of the operator's row that are missing are null. Rows more than ``delay`` behind the newest, and those without a time, are dropped.
    """
    given = {n: k for n, k in (x.split() for x in operator.row.split(", "))}
    columns = [F.col(n).cast(k).alias(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in given.items()]
    timed = rows.withWatermark("ts", delay).select("stream_id", "ts", *columns).where("t IS NOT NULL AND ts IS NOT NULL")
    return operator.over(timed)
