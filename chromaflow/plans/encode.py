"""A clip from frames to an animation file."""

from __future__ import annotations

from dataclasses import dataclass, field
from time import perf_counter

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaflow.operators import delta, dither, filters, gif, hist, palette
from chromaflow.sources.clip import Clip, read_clip, to_rgba

ALIASES = {"bn": "bluenoise", "sierra2_4a": "sierra2"}


@dataclass
class Options:
    """Ranges are checked when an encode starts."""

    colors: int = 256
    dither: str = "auto"
    dither_gate: int = 16
    loop: int | None = 0  # None plays once
    lossy: int = 0
    hold: int = 0
    smooth: int = 0
    stats: dict = field(default_factory=dict)  # filled: seconds by phase, palette size, frames, bytes

    def check(self) -> Options:
        for name, low, high in (("colors", 2, 256), ("dither_gate", 0, 720), ("lossy", 0, 200), ("hold", 0, 765), ("smooth", 0, 765)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        self.dither = ALIASES.get(self.dither, self.dither)
        if self.dither not in dither.MODES:
            raise ValueError(f"dither must be one of {dither.MODES}")
        if self.loop is not None and not 0 <= self.loop <= 65_535:
            raise ValueError("loop must be 0 to 65535")
        return self


def encoded_frames(frames: DataFrame, clip: Clip, options: Options, held: list[DataFrame] | None = None) -> tuple[DataFrame, np.ndarray]:
    """encoded(frame, delay_cs, body, disposal) and the palette.  `held` gets the tables
    that are kept between passes, for the caller to release."""
    options.check()
    clock, marks = perf_counter(), options.stats
    if options.smooth:
        frames = filters.smooth(frames, clip.width, clip.height, options.smooth)
    if options.hold:
        frames = filters.hold(frames, clip.width, clip.height, options.hold)
    frames = frames.persist(StorageLevel.MEMORY_AND_DISK)
    # one pass counts colours and tells whether anything is transparent
    counted = hist.frame_histogram(frames, clear=True).persist(StorageLevel.MEMORY_AND_DISK)
    n_keys, n_clear = counted.agg(F.count("*"), F.count_if(F.col("rgb") == hist.CLEAR)).first()
    counts, n_colors, clear = counted.where(F.col("rgb") != hist.CLEAR), n_keys - n_clear, n_clear > 0
    exact = n_colors < options.colors
    colors = palette.build_palette(hist.palette_entries(counts), options.colors - 1)
    marks |= {"palette_s": perf_counter() - clock, "colors": len(colors), "distinct": n_colors}
    scaled = bool(options.lossy) and options.dither == "none"
    idx = dither.quantize(frames, clip.width, clip.height, colors, options.dither, options.dither_gate, exact, scaled).persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held += [frames, counted, idx]
    timing = delta.frame_delays(frames, clip.fps_num, clip.fps_den)
    return gif.encode_frames(idx, timing, clip.width, clip.height, colors, clear, options.lossy), colors


def encode(frames: DataFrame, clip: Clip, **options) -> bytes:
    """frames(frame, data) of RGBA bytes to a whole file.  Bodies come to the driver
    in order, one partition at a time."""
    settings = Options(**options)
    clock = perf_counter()
    held: list[DataFrame] = []
    encoded, colors = encoded_frames(frames, clip, settings, held)
    # sorting samples its input first: bodies are made once
    encoded = encoded.persist(StorageLevel.MEMORY_AND_DISK)
    held.append(encoded)
    ordered = encoded.orderBy("frame").toLocalIterator()
    out = b"".join(gif.mux(clip.width, clip.height, colors, ((r["delay_cs"], bytes(r["body"]), r["disposal"]) for r in ordered), settings.loop))
    for kept in held:
        kept.unpersist()
    settings.stats |= {"total_s": perf_counter() - clock, "bytes": len(out)}
    return out


def encode_file(spark: SparkSession, path: str, size: str | None = None, fps: str | None = None, format: str = "auto", **options) -> bytes:  # noqa: A002
    clip, frames = read_clip(spark, path, size, fps, format)
    return encode(to_rgba(frames, clip), clip, **options)


def encode_summary(frames: DataFrame, clip: Clip, **options) -> DataFrame:
    """One row a frame: its delay and the size of its body."""
    encoded, _ = encoded_frames(frames, clip, Options(**options))
    return encoded.select("frame", "delay_cs", F.length("body").cast("long").alias("body_bytes"), "disposal")
