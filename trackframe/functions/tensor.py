"""Small images as arrays of rows: normalisation and shapes. Large ones go through ``scorers``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEAN, STD = 0.421, 0.165
#: Weights of red, green and blue in the brightness.
LUMA = (0.2989, 0.587, 0.114)


def centre_crop(image: Column, size: int) -> Column:
    """The middle ``size`` rows and columns; the offset is rounded half to even."""
    offset = lambda n: F.rint((n - size) / 2).cast("int") + 1
    rows = F.slice(image, offset(F.size(image)), F.lit(size))
    return F.transform(rows, lambda r: F.slice(r, offset(F.size(r)), F.lit(size)))


def luma(image: Column) -> Column:
    """Brightness of pixels [r, g, b]."""
    return F.transform(image, lambda row: F.transform(row, lambda p: p[0] * LUMA[0] + p[1] * LUMA[1] + p[2] * LUMA[2]))


def normalise(image: Column, mean: float = MEAN, std: float = STD) -> Column:
    """0..255 to standard units."""
    return F.transform(image, lambda row: F.transform(row, lambda x: (x / 255.0 - mean) / std))


def denormalise(image: Column, mean: float = MEAN, std: float = STD) -> Column:
    """Standard units to whole numbers 0..255."""
    value = lambda x: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * std + mean)) * 255).cast("int")
    return F.transform(image, lambda row: F.transform(row, value))


def promote(image: Column) -> Column:
    """Grey to three equal channels."""
    return F.transform(image, lambda row: F.transform(row, lambda x: F.array(x, x, x)))


def shape(frames: Column) -> Column:
    """(frames, height, width, regular) of a nested list."""
    h, w = F.size(frames[0]), F.size(frames[0][0])
    regular = F.forall(frames, lambda f: (F.size(f) == h) & F.forall(f, lambda r: F.size(r) == w))
    return F.struct(F.size(frames).alias("frames"), h.alias("height"), w.alias("width"), regular.alias("regular"))
