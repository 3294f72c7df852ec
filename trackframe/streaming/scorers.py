"""User models over clips: a registry of scorers, applied batch-wise; failures become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trackframe.functions.tensor import MEAN, STD
from trackframe.params import Preprocessing

#: A scorer takes a clip's frames (one row each, in order) and returns [(text, score, token_ids)].
Scorer = Callable[[pd.DataFrame], list[tuple[str, float, list[int]]]]
RESULT = "clip_id string, frames long, hypotheses array<struct<text:string,score:double,token_ids:array<int>>>, error string"


class Registry:
    """Scorer factories by name; a stub has none."""

    def __init__(self) -> None:
        self.factories: dict[str, tuple[Callable[[], Scorer] | None, bool]] = {}

    def register(self, name: str, factory: Callable[[], Scorer] | None, implemented: bool = True) -> None:
        self.factories[name] = (factory, implemented and factory is not None)

    def available(self) -> dict[str, bool]:
        """Names, sorted, and whether they are implemented."""
        return {name: self.factories[name][1] for name in sorted(self.factories)}

    def create(self, name: str) -> Callable[[], Scorer]:
        if name not in self.factories:
            raise KeyError(f"Unknown model '{name}'. Known: {', '.join(sorted(self.factories))}")
        factory, implemented = self.factories[name]
        if not implemented:
            raise NotImplementedError(name)
        return factory


_SHARED = Registry()
register, available, create = _SHARED.register, _SHARED.available, _SHARED.create


def transcribe(frames: DataFrame, clip: str, order: str, factory: Callable[[], Scorer], most_frames: int = Preprocessing.max_frames) -> DataFrame:
    """One row of ``RESULT`` for each clip. A scorer's exception is the row's error.

    Each task makes one scorer and reads its clips in order. A scorer takes a whole
    clip; a clip of more than ``most_frames`` frames is never held, its row has an error.
    """
    rows = frames.repartition(clip).sortWithinPartitions(clip, order)
    where, kind = frames.columns.index(clip), frames.schema[clip].dataType

    def clips(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(clip, number of frames, its parts, or None if they are too many)."""
        key, n, parts = None, 0, []
        for batch in batches:
            own = batch.iloc[:, where]
            starts = np.flatnonzero((own != own.shift()) & ~(own.isna() & own.shift().isna())).tolist() if len(own) else []
            for a, b in zip([0, *starts], [*starts, len(batch)], strict=True):
                if a == b:
                    continue
                if n and not (own.iloc[a] == key or (pd.isna(own.iloc[a]) and pd.isna(key))):
                    yield key, n, parts
                    n, parts = 0, []
                key, n = own.iloc[a], n + b - a
                parts = None if parts is None or n > most_frames else [*parts, batch.iloc[a:b]]
        if n:
            yield key, n, parts

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for key, n, parts in clips(batches):
            try:
                if parts is None:
                    raise ValueError(f"{n} frames, at most {most_frames} are taken")
                scorer = scorer or factory()
                found, error = scorer(pd.concat(parts, ignore_index=True)), None
            except Exception as e:  # the clip fails, not the job
                found, error = [], f"{type(e).__name__}: {e}"
            named = [{"text": t, "score": float(s), "token_ids": list(ids)} for t, s, ids in found]
            name = None if pd.isna(key) else str(int(key)) if isinstance(kind, IntegralType) else str(key)
            yield pd.DataFrame([(name, n, named, error)], columns=["clip_id", "frames", "hypotheses", "error"])

    return rows.mapInPandas(score, RESULT)


def normalised_images(rois: DataFrame, size: int, mean: float = MEAN, std: float = STD) -> DataFrame:
    """(clip_id, frame_index, tensor, error) of images in bytes (height, width, channels, pixels): centre crop, brightness, standard units.

    For images too large for array expressions. A row of wrong size has an error and no tensor.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for clip, index, h, w, c, raw in batch.itertuples(index=False):
                if len(raw) != h * w * c or c not in (1, 3) or min(h, w) < size:
                    rows.append((clip, index, None, f"bad image {h}x{w}x{c} of {len(raw)} bytes"))
                    continue
                image = np.frombuffer(raw, np.uint8).reshape(h, w, c).astype(np.float64) / 255
                top, left = round((h - size) / 2), round((w - size) / 2)
                image = image[top : top + size, left : left + size]
                grey = image @ np.array([0.2989, 0.587, 0.114]) if c == 3 else image[:, :, 0]
                rows.append((clip, index, ((grey - mean) / std).ravel(), None))
            yield pd.DataFrame(rows, columns=["clip_id", "frame_index", "tensor", "error"])

    picked = rois.select(F.col("clip_id").cast("string"), "frame_index", "height", "width", "channels", "pixels")
    return picked.mapInPandas(convert, "clip_id string, frame_index int, tensor array<double>, error string")
