"""Parameters of the operators; the defaults are those of 25 fps frame tracks, in seconds and pixels."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Segmenting:
    """Hysteresis thresholds on the energy, and lengths in seconds."""

    start: float = 0.016
    stop: float = 0.008
    hangover: float = 0.5
    min_length: float = 1.2
    max_length: float = 4.0

    def __post_init__(self) -> None:
        if self.stop > self.start:
            raise ValueError("stop must not exceed start")


@dataclass(frozen=True)
class Preprocessing:
    target_fps: float = 25.0
    aligned_size: int = 256
    crop: int = 96
    input_size: int = 88
    mean: float = 0.421
    std: float = 0.165
    smoothing: int = 12
    long_side: int = 640
    max_frames: int = 1500
    min_frames: int = 8
    min_detection_ratio: float = 0.3
    track_iou: float = 0.2


@dataclass(frozen=True)
class Live:
    lead_in: float = 0.25
    buffer_seconds: float = 8.0
    fps: float = 25.0
    queue: int = 2
    max_age: float = 6.0
    energy_window: int = 3
    status_every: int = 5
    max_message: int = 4 << 20
    history: int = 12
    idle: float = 8.0


@dataclass(frozen=True)
class Decoding:
    ctc: float = 0.1
    length: float = 0.0
    lm: float = 0.0
    n_best: int = 3
