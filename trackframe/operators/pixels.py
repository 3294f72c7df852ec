"""Frames of pixels in bytes: crops that run past the edge, stacks in blocks of bounded size.

Images are columns (height, width, channels, pixels): unsigned bytes, row by row, the channels of a pixel together. The work is done
in Arrow batches by numpy; what is wrong with an image is its row's ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators.timeseries import numbered
from trackframe.params import Preprocessing

IMAGE = ("height", "width", "channels", "pixels")


def _image(height: int | None, width: int | None, channels: int | None, pixels: bytes | None) -> np.ndarray | str:
    """The image, or what is wrong with it."""
    if None in (height, width, channels, pixels):
        return "no image"
    if min(height, width) < 1 or channels not in (1, 3) or len(pixels) != height * width * channels:
        return f"bad image {height}x{width}x{channels} of {len(pixels)} bytes"
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def crop(frames: DataFrame, x: str, y: str, size: int = Preprocessing.crop) -> DataFrame:
    """``frames`` with their images cut to ``size`` x ``size`` pixels around (x, y), and ``error``.

    The window's edges are rounded half to even; what lies outside the image is black. A bad image, or one without
    a centre, is null and has an error; other columns stay.
    """
    names = frames.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", error string"
    half = size / 2

    def cut(image: np.ndarray, cx: float, cy: float) -> np.ndarray:
        top, left = round(cy - half), round(cx - half)
        rows, columns = np.arange(top, top + size), np.arange(left, left + size)
        inside = ((rows >= 0) & (rows < image.shape[0]))[:, None] & ((columns >= 0) & (columns < image.shape[1]))
        found = image[np.clip(rows, 0, image.shape[0] - 1)[:, None], np.clip(columns, 0, image.shape[1] - 1)]
        return np.where(inside[:, :, None], found, 0).astype(np.uint8)

    def crops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for *image, cx, cy in zip(*(batch[n].to_pylist() for n in (*IMAGE, x, y)), strict=True):
                found = _image(*image)
                found = "no centre" if not isinstance(found, str) and (cx is None or cy is None) else found
                made.append((None, None, None, None, found) if isinstance(found, str) else (size, size, found.shape[2], cut(found, cx, cy).tobytes(), None))
            columns = dict(zip((*IMAGE, "error"), zip(*made, strict=True) if made else [()] * 5, strict=True))
            arrays = [pa.array(columns[n], batch.schema.field(n).type) if n in columns else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns["error"], pa.string())], [*names, "error"])

    return frames.mapInArrow(crops, schema)


def stack(frames: DataFrame, clip: str, order: str, most: int = Preprocessing.max_frames, width: float = 4096.0) -> DataFrame:
    """(clip, block, frames, height, width, channels, pixels, error): images of a clip in order, one after the other, ``most`` to a block.

    Grey images beside coloured ones are promoted to three equal channels. A block whose images differ in size, or of which one
    is bad, has an error that names the first such image and no pixels. A clip of any length is several blocks, so a task holds
    one block; ``width`` is in the unit of ``order``. A null clip is a clip.
    """
    rows = numbered(frames.select(F.col(clip).alias("key"), F.col(order).alias("_o"), *IMAGE), "key", "_o", width, "_i")
    rows = rows.withColumn("_block", F.floor(F.col("_i") / most)).drop("_o").repartition("key", "_block").sortWithinPartitions("key", "_block", "_i")
    kind = rows.schema["key"].dataType.simpleString()
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def block(rows_: list[tuple]) -> tuple:
        images = [_image(*r) for r in rows_]
        bad = next((f"frame {i}: {x}" for i, x in enumerate(images) if isinstance(x, str)), None)
        first = images[0]
        if bad is None:
            bad = next((f"frame {i}: {x.shape[0]}x{x.shape[1]}, not {first.shape[0]}x{first.shape[1]}" for i, x in enumerate(images) if x.shape[:2] != first.shape[:2]), None)
        if bad:
            return len(images), None, None, None, None, bad
        channels = max(x.shape[2] for x in images)
        return len(images), *first.shape[:2], channels, b"".join(np.broadcast_to(x, (*x.shape[:2], channels)).tobytes() for x in images), None

    def stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, key_type = None, [], None

        def done() -> pa.RecordBatch:
            made = (at[1], *block(held))
            return pa.RecordBatch.from_arrays([pa.array([at[0]], key_type), *(pa.array([x], k) for x, k in zip(made, kinds, strict=True))], ["key", "block", "frames", *IMAGE, "error"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            for key, number, *image in zip(*(batch[n].to_pylist() for n in ("key", "_block", *IMAGE)), strict=True):
                if at != (key, number):
                    if held:
                        yield done()
                    at, held = (key, number), []
                held.append(tuple(image))
        if held:
            yield done()

    found = rows.mapInArrow(stacks, f"key {kind}, block long, frames int, height int, width int, channels int, pixels binary, error string")
    return found.withColumnRenamed("key", clip)
