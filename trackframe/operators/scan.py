"""State machines along streams, many tasks to a stream.

A machine's state after a row depends on all rows before it, so one stream is walked in order. Here streams are cut into
chunks of time, whatever their rows are, and walked three times:

1. Each chunk is walked from *every* state that it may be entered with. ``chunks`` gives it the rows just before it, from
   which those states are known. Walks that come to one state go on as one.
2. ``entered`` composes the chunks' maps from entry to exit states: within groups of chunks, along the groups, and
   back within groups. It sees a few states a chunk and no rows.
3. Each chunk is walked once from the state that it is really entered with.

All chunks are walked at once in the first and the third, so a stream of any length, quiet or not, is shared by all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks in one group.
GROUP = 512
#: Thin buckets in a row become one chunk of some so many rows.
ROWS = 4096


def chunks(rows: DataFrame, key: str, order: str, width: float, reach: float) -> DataFrame:
    """Rows with ``_chunk`` and ``_own``; each chunk also has, not ``_own``, those rows of its stream before it that come at
    most ``reach`` before the last of them. ``reach`` is at most ``width``. ``_sole``: the stream has no other chunk.

    A chunk is one bucket of ``width``, or as many thin ones in a row as hold some ``ROWS`` rows together: a chunk costs more than a row.
    """
    if reach > width:
        raise ValueError("reach must not exceed width")
    rows = rows.withColumn("_bucket", F.floor(F.col(order) / width))
    buckets = rows.groupBy(F.col(key).alias("_k"), F.col("_bucket").alias("_b")).agg(F.max(order).alias("_last"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row for each bucket
    merged = buckets.where("_b IS NOT NULL").withColumn("_chunk", F.floor(F.coalesce(before, F.lit(0)) / ROWS)).groupBy("_k", "_chunk").agg(F.max("_last").alias("_last"), F.collect_list("_b").alias("_bs"))
    in_order = Window.partitionBy("_k").orderBy("_chunk")
    follows = merged.withColumn("_next", F.lead("_chunk").over(in_order)).withColumn("_next_last", F.lead("_last").over(in_order)).withColumn("_after", F.lead("_chunk", 2).over(in_order))
    ends = follows.withColumn("_sole", F.col("_next").isNull() & (F.col("_chunk") == 0)).withColumn("_b", F.explode("_bs")).drop("_bs")
    near = F.when(F.col("_next").isNotNull() & (F.col(order) >= F.col("_last") - reach), F.col("_next"))
    # a chunk in between that spans two buckets is longer than the reach
    far = F.when(F.col(order) >= F.col("_next_last") - reach, F.col("_after"))
    places = F.filter(F.array(F.struct(F.col("_chunk").alias("c"), F.lit(True).alias("o")), *(F.struct(x.alias("c"), F.lit(False).alias("o")) for x in (near, far))), lambda x: x["c"].isNotNull())
    joined = rows.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))).withColumn("_place", F.explode(places))
    return joined.select(*(c for c in rows.columns if c != "_bucket"), F.col("_place.c").alias("_chunk"), F.col("_place.o").alias("_own"), "_sole")


def _by_group(rows: DataFrame, group: list[str], order: list[str], one: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``one`` of the rows (group, order, others) of each group in order, for groups of any number and a bounded size.

    Plain tuples in one pass over sorted partitions: a group of two rows costs microseconds.
    """
    names = [*group, *order, *(c for c in rows.columns if c not in (*group, *order))]
    results = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        kinds: dict[str, pa.DataType] = {"entry": pa.string(), "exit": pa.string(), "chunk": pa.int64(), "_group": pa.int64(), "final": pa.bool_()}

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(results, zip(*out, strict=True), strict=True)], results)

        for batch in batches:
            kinds |= {n: batch.schema.field(n).type for n in group if n not in kinds}
            for row in zip(*(batch[n].to_pylist() for n in names), strict=True):
                if held and row[: len(group)] != held[0][: len(group)]:
                    out += one(held)
                    held = []
                    if len(out) >= 10_000:
                        yield table()
                        out = []
                held.append(row)
        if held:
            out += one(held)
        if out:
            yield table()

    dealt_ = rows.select(*names).repartition(*group).sortWithinPartitions(*group, *(F.asc_nulls_first(c) for c in order))
    return dealt_.mapInArrow(run, schema)


def _maps(rows: list[tuple], at: int) -> list[tuple[int, dict]]:
    """(chunk, its exits by entry) of rows (..., chunk, ..., entry, exit) in order of the chunk, which is column ``at``."""
    found: list[tuple[int, dict]] = []
    for row in rows:
        if not found or found[-1][0] != row[at]:
            found.append((row[at], {}))
        found[-1][1][row[-2]] = row[-1]
    return found


def entered(maps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, entry, final) of every chunk: the state that it is entered with, and whether it is its stream's last.

    ``maps`` has (keys, chunk, entry, exit), a row for each state (a string) that a chunk may be entered with; every chunk has
    one for null, the state at the stream's beginning.
    """
    k = len(keys)
    named = maps.select(*keys, F.floor(F.col("chunk") / GROUP).alias("_group"), "chunk", "entry", "exit")
    kinds = ", ".join(f"{n} {named.schema[n].dataType.simpleString()}" for n in keys)

    def composed(rows: list[tuple]) -> list[tuple]:
        """A group's exits by its first chunk's entries; entries that come to one state go on as one."""
        maps_ = _maps(rows, k + 1)
        states = {e: e for e in maps_[0][1]}
        for _, exits in maps_:
            states = {e: exits[s] for e, s in states.items()}
        return [(*rows[0][: k + 1], e, s) for e, s in states.items()]

    def followed(rows: list[tuple]) -> list[tuple]:
        state, found = None, []
        for group, exits in _maps(rows, k):
            found.append((*rows[0][:k], group, state, False))
            state = exits[state]
        found[-1] = (*found[-1][:-1], True)
        return found

    def within(rows: list[tuple]) -> list[tuple]:
        """The first row, without a chunk, tells what the group is entered with."""
        (*_, final, state, _), rows = rows[0], rows[1:]
        found = []
        for chunk, exits in _maps(rows, k + 1):
            found.append((*rows[0][:k], chunk, state, False))
            state = exits[state]
        found[-1] = (*found[-1][:-1], final)
        return found

    groups = _by_group(named, [*keys, "_group"], ["chunk"], composed, f"{kinds}, _group long, entry string, exit string")
    along = _by_group(groups, keys, ["_group"], followed, f"{kinds}, _group long, entry string, final boolean")
    both = named.unionByName(along, allowMissingColumns=True).select(*keys, "_group", "chunk", "final", "entry", "exit")
    return _by_group(both, [*keys, "_group"], ["chunk"], within, f"{kinds}, chunk long, entry string, final boolean")


def dealt(rows: DataFrame, entries: DataFrame | None, *order: str) -> DataFrame:
    """Rows by (key, ``_chunk``) in order, a chunk's ``entries`` (key, chunk, ...; null in ``order``) before its rows."""
    if entries is not None:
        rows = rows.unionByName(entries.withColumnRenamed("chunk", "_chunk"), allowMissingColumns=True)
    return rows.repartition("key", "_chunk").sortWithinPartitions("key", "_chunk", *(F.asc_nulls_first(c) for c in order))


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether it begins a chunk, rows) of dealt rows: parts of batches that hold one chunk's rows."""
    at = None
    for batch in batches:
        chunk, key = batch["_chunk"], batch["key"]
        place = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(chunk.to_numpy()) != 0) | (np.diff(place) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a < b:
                name = key[a].as_py(), chunk[a].as_py()
                yield name != at, batch.slice(a, b - a)
                at = name
