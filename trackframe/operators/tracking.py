"""One subject through the candidate boxes of every frame."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators import scan
from trackframe.operators.timeseries import along, blocks


def preferred(candidates: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """The candidates of the first detector that has any on a frame."""
    first = candidates.groupBy(*keys).agg(F.min(priority).alias("_first"))
    return candidates.join(first, keys).where(F.col(priority) == F.col("_first")).drop("_first")


class Subject:
    """A tracker's state, the last chosen box. Boxes are (x, y, width, height)."""

    def __init__(self, least_iou: float, last: tuple | None = None):
        self.least_iou, self.last = least_iou, last

    def choose(self, candidates: list[tuple]) -> tuple:
        """Of a frame's (cand, box) in order: a sole one; else that of largest overlap with the last box, if enough; else the largest. Ties: the first."""
        best = candidates[0]
        if len(candidates) > 1:
            near = max(candidates, key=lambda c: overlap(self.last, c[1])) if self.last else None
            best = near if near and overlap(self.last, near[1]) >= self.least_iou else max(candidates, key=lambda c: c[1][2] * c[1][3])
        self.last = best[1]
        return best


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes, 0 without overlap or area; the plain form of ``geometry.iou``."""
    common = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - common
    return common / union if common > 0 and union > 0 else 0.0


def track(candidates: DataFrame, stream: str, frame: str, cand: str, box: str, least_iou: float = 0.2, bucket: float = 1e4) -> DataFrame:
    """(stream, frame, cand, box) of the chosen candidate of every frame that has one.

    The last box survives frames without candidates. Streams are cut into chunks of ``bucket`` frames that tasks walk at
    once (``scan``): a chunk may be entered with any candidate of the frame before it. A task holds one frame.
    """
    rows = candidates.select(F.col(stream).alias("key"), F.col(frame).alias("frame"), F.col(cand).alias("cand"), *(F.col(box)[k].alias(k) for k in SIDES))
    rows = scan.chunks(rows, "key", "frame", bucket, 0)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = ("frame", "cand", *SIDES)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Schema, tuple, list[tuple]]]:
        """(whether it begins a chunk, schema, (key, chunk, frame, own, entry), [(cand, box)]) of each frame, and of each chunk's entry, whose frame is null."""
        at, held, begun, schema = None, [], False, None
        for batch in batches:
            schema = batch.schema
            names = ("key", "_chunk", "frame", "_own", *(["entry"] if "entry" in batch.schema.names else []))
            for place, cand_, *sides in zip(zip(*(batch[n].to_pylist() for n in names), strict=True), *(batch[n].to_pylist() for n in ("cand", *SIDES)), strict=True):
                if place != at:
                    if held:
                        yield begun, schema, at, held
                    begun = at is None or place[:2] != at[:2]
                    at, held = place, []
                held.append((cand_, tuple(sides)))
        if held:
            yield begun, schema, at, held

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str | None, tuple | None] = {}
        found: list[tuple] = []
        key_type = pa.null()

        def done() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (key_type, pa.int64(), pa.string(), pa.string()), strict=True)], ["key", "chunk", "entry", "exit"])

        name: tuple = ()
        for begun, schema, place, held in frames(batches):
            if begun:
                found += [(*name, entry, json.dumps(x) if x else None) for entry, x in states.items()]
                if len(found) >= 10_000:
                    yield done()
                    found = []
                states, name, key_type = {None: None}, place[:2], schema.field("key").type
            if place[3]:
                chosen = {last: Subject(least_iou, last).choose(held)[1] for last in set(states.values())}
                states = {entry: chosen[last] for entry, last in states.items()}
            else:
                states |= {json.dumps(b): b for _, b in held}
        found += [(*name, entry, json.dumps(x) if x else None) for entry, x in states.items()]
        if found:
            yield done()

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject, out, schema = None, [], None

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, ("key", *order), strict=True)], ["key", *order])

        for begun, schema, place, held in frames(batches):
            if begun:
                subject = Subject(least_iou, tuple(json.loads(place[4])) if place[4] else None)
            if place[3]:  # a sole chunk has no entry
                best = subject.choose(held)
                out.append((place[0], place[2], best[0], *best[1]))
                if len(out) == 10_000:
                    yield batch()
                    out = []
        if out:
            yield batch()

    maps = scan.dealt(rows.where("not _sole"), None, *order).mapInArrow(mapped, f"key {kinds['key']}, chunk long, entry string, exit string")
    picked = scan.dealt(rows, scan.entered(maps, ["key"]), *order).mapInArrow(walked, ", ".join(f"{n} {kinds[n]}" for n in ("key", *order)))
    return picked.select(F.col("key").alias(stream), F.col("frame").alias(frame), F.col("cand").alias(cand), F.struct(*SIDES).alias(box))


#: The fields of a box.
SIDES = ("x", "y", "width", "height")


def stability(points: DataFrame, stream: str, order: str, x: str, y: str, width: float = 600.0) -> DataFrame:
    """(stream, std_x, std_y, mean_change, max_jump): how still a point of consecutive frames is."""
    rows = blocks(points.select(stream, order, F.col(x).alias("_x"), F.col(y).alias("_y")), stream, order, width, 1)
    rows = rows.withColumn("_dx", F.col("_x") - F.lag("_x").over(along(stream))).withColumn("_dy", F.col("_y") - F.lag("_y").over(along(stream))).where("_inside")
    return rows.groupBy(stream).agg(
        F.stddev_pop("_x").alias("std_x"),
        F.stddev_pop("_y").alias("std_y"),
        F.avg((F.abs("_dx") + F.abs("_dy")) / 2).alias("mean_change"),
        F.max(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).alias("max_jump"),
    )


def with_detections(frames: DataFrame, detections: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All frames with their detection, and ``detected``."""
    return frames.join(detections, keys, "left").withColumn("detected", F.col(value).isNotNull())
