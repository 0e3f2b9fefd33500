"""Clips as DataFrames: raw RGBA and planar YUV streams, and synthetic rasters.

Frames of a raw stream have one size, so a file is cut into ranges of frames
that are read in parallel; the y4m reader checks that frame headers have no
parameters of their own before it relies on that, and reads in one range otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chromaflow.functions import color as C

MAGIC = b"YUV4MPEG2"
MAX_SIDE = 65_535
FRAMES_SCHEMA = "frame int, kind string, data binary"
PX_SCHEMA = "frame int, y int, x int, r int, g int, b int, a int"


@dataclass(frozen=True)
class Clip:
    width: int
    height: int
    fps_num: int = 30
    fps_den: int = 1
    chroma: str | None = None  # "420", "422", "444", "mono"; None is RGBA

    def __post_init__(self) -> None:
        if not (0 < self.width <= MAX_SIDE and 0 < self.height <= MAX_SIDE):
            raise ValueError(f"size must be 1 to {MAX_SIDE}")
        if self.fps_num <= 0 or self.fps_den <= 0:
            raise ValueError("the frame rate must be positive")

    def frame_bytes(self) -> int:
        w, h = self.width, self.height
        if self.chroma is None:
            return 4 * w * h
        half = (w + 1) // 2
        return w * h + {"420": 2 * half * ((h + 1) // 2), "422": 2 * half * h, "444": 2 * w * h, "mono": 0}[self.chroma]


def parse_size(text: str) -> tuple[int, int]:
    w, _, h = text.lower().partition("x")
    return int(w), int(h)


def parse_rate(text: str) -> tuple[int, int]:
    num, _, den = text.replace(":", "/").partition("/")
    rate = int(num), int(den or 1)
    if min(rate) <= 0:
        raise ValueError("the frame rate must be positive")
    return rate


def is_y4m(head: bytes) -> bool:
    """Whether a stream's first nine bytes are those of y4m; fewer are no input."""
    if len(head) < len(MAGIC):
        raise ValueError("no input")
    return head[: len(MAGIC)] == MAGIC


def parse_header(line: str) -> Clip:
    """A y4m header line; unknown tags are skipped, depths other than 8 and alpha are refused."""
    words = line.split()
    if not words or words[0] != MAGIC.decode():
        raise ValueError("not a y4m header")
    tags = {w[:1]: w[1:] for w in words[1:]}
    chroma = tags.get("C", "420")
    if chroma == "444alpha" or any(f"p{d}" in chroma for d in (9, 10, 12, 14, 16)) or chroma.startswith("mono") and chroma != "mono":
        raise ValueError(f"unsupported pixel format {chroma}")
    for known in ("420", "422", "444", "mono"):
        if chroma.startswith(known):
            chroma = known
            break
    else:
        raise ValueError(f"unsupported pixel format {chroma}")
    num, den = parse_rate(tags.get("F", "25:1"))
    return Clip(int(tags.get("W", 0)), int(tags.get("H", 0)), num, den, chroma)


def probe(path: str, size: str | None = None, fps: str | None = None, kind: str = "auto") -> Clip:
    """What a stream holds; RGBA needs its size, `fps` overrides the header's."""
    with open(path, "rb") as f:
        y4m = kind == "y4m" or kind == "auto" and is_y4m(f.read(len(MAGIC)))
        f.seek(0)
        if y4m:
            clip = parse_header(f.readline().decode())
        elif size is None:
            raise ValueError("raw RGBA needs a size")
        else:
            clip = Clip(*parse_size(size))
    if fps is None:
        return clip
    num, den = parse_rate(fps)
    return replace(clip, fps_num=num, fps_den=den)


class _Range(InputPartition):
    def __init__(self, first: int, count: int, offset: int):
        self.first, self.count, self.offset = first, count, offset


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per = options["path"], int(options.get("framesperpartition", 64))
        self.clip = probe(self.path, options.get("size"), options.get("fps"), options.get("format", "auto"))

    def _marker(self) -> tuple[int, int]:
        """Where the first frame begins and how long frame headers are: 0 for RGBA, -1 if not one length."""
        if self.clip.chroma is None:
            return 0, 0
        size, marker = self.clip.frame_bytes(), len(b"FRAME\n")
        with open(self.path, "rb") as f:
            start = len(f.readline())
            f.seek(0, 2)
            body = f.tell() - start
            if body % (size + marker):
                return start, -1
            for at in range(start, start + body, size + marker):
                f.seek(at)
                if f.read(marker) != b"FRAME\n":
                    return start, -1
        return start, marker

    def partitions(self) -> list[_Range]:
        import os

        start, marker = self._marker()
        if marker < 0:
            return [_Range(0, -1, start)]
        step = self.clip.frame_bytes() + marker
        total = os.path.getsize(self.path) - start
        if total % step:
            raise ValueError("the last frame is cut short")
        n = total // step
        return [_Range(k, min(self.per, n - k), start + k * step) for k in range(0, n, self.per)] or [_Range(0, 0, start)]

    def read(self, part: _Range) -> Iterator[tuple]:
        size, kind = self.clip.frame_bytes(), "rgba" if self.clip.chroma is None else f"yuv{self.clip.chroma}"
        with open(self.path, "rb") as f:
            f.seek(part.offset)
            number = part.first
            while part.count < 0 or number < part.first + part.count:
                if self.clip.chroma is not None:
                    line = f.readline()
                    if not line:
                        return
                    if not line.startswith(b"FRAME"):
                        raise ValueError("a frame header is missing")
                data = f.read(size)
                if len(data) < size:
                    raise ValueError("the last frame is cut short")
                yield number, kind, data
                number += 1


class ClipSource(DataSource):
    """spark.read.format("chromaflow_clip").option("path", ...), with size, fps, format, framesPerPartition.

    The path must be readable by every executor (a shared mount)."""

    @classmethod
    def name(cls) -> str:
        return "chromaflow_clip"

    def schema(self) -> str:
        return FRAMES_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_clip(spark: SparkSession, path: str, size: str | None = None, fps: str | None = None, kind: str = "auto") -> tuple[Clip, DataFrame]:
    spark.dataSource.register(ClipSource)
    reader = spark.read.format("chromaflow_clip").option("path", path).option("format", kind)
    if size:
        reader = reader.option("size", size)
    if fps:
        reader = reader.option("fps", fps)
    return probe(path, size, fps, kind), reader.load()


def planes_to_rgba(data: bytes, clip: Clip) -> bytes:
    """A planar frame as RGBA bytes, chroma by the nearest sample."""
    w, h = clip.width, clip.height
    luma = np.frombuffer(data, np.uint8, w * h).reshape(h, w)
    out = np.full((h, w, 4), 255, dtype=np.uint8)
    if clip.chroma == "mono":
        grey = np.full_like(luma, 128)
        out[..., :3] = C.yuv_to_rgb_np(luma, grey, grey)
        return out.tobytes()
    cw, ch = (w, h) if clip.chroma == "444" else ((w + 1) // 2, (h + 1) // 2 if clip.chroma == "420" else h)
    u, v = np.frombuffer(data, np.uint8, 2 * cw * ch, w * h).reshape(2, ch, cw)
    rows = np.arange(h) >> (clip.chroma == "420")
    cols = np.arange(w) >> (clip.chroma != "444")
    out[..., :3] = C.yuv_to_rgb_np(luma, u[np.ix_(rows, cols)], v[np.ix_(rows, cols)])
    return out.tobytes()


def to_rgba(frames: DataFrame, clip: Clip) -> DataFrame:
    """frames(frame, kind, data) to frames(frame, data) of RGBA bytes."""
    if clip.chroma is None:
        return frames.select("frame", "data")
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([planes_to_rgba(d, clip) for d in b.column(1).to_pylist()], pa.binary())], names=["frame", "data"])

    return frames.select("frame", "data").mapInArrow(run, "frame int, data binary")


def to_px(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Long form of frames(frame, data) with RGBA bytes."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, xs = (a.ravel().astype(np.int32) for a in np.mgrid[:height, :width])
        for b in batches:
            for frame, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), frame, np.int32)), pa.array(ys), pa.array(xs), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(4))], names=["frame", "y", "x", "r", "g", "b", "a"])

    return frames.select("frame", "data").mapInArrow(run, PX_SCHEMA)


def moving_square(spark: SparkSession, width: int = 64, height: int = 48, frames: int = 12) -> DataFrame:
    """px of an 8x8 square that moves one pixel a frame along the diagonal."""
    i = spark.range(width * height * frames)
    at = i.select((F.col("id") / (width * height)).cast("int").alias("frame"), ((F.col("id") / width).cast("long") % height).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    inside = F.col("x").between(F.col("frame"), F.col("frame") + 7) & F.col("y").between(F.col("frame"), F.col("frame") + 7)
    pick = lambda a, b: F.when(inside, a).otherwise(b)
    return at.select("*", pick(200, 40).alias("r"), pick(30, 80).alias("g"), pick(30, 120).alias("b"), F.lit(255).alias("a"))


def to_frames(px: DataFrame) -> DataFrame:
    """Block form frames(frame, data) of a raster in long form; a frame's pixels are one group."""
    byte = lambda c: F.substring(F.unhex(F.lpad(F.hex(F.col(c)), 2, "0")), 1, 1)
    pixel = F.struct("y", "x", F.concat(*(byte(c) for c in "rgba")).alias("p"))
    whole = px.groupBy("frame").agg(F.sort_array(F.collect_list(pixel)).alias("s"))
    return whole.select("frame", F.unhex(F.array_join(F.transform("s", lambda e: F.hex(e["p"])), "")).alias("data"))
