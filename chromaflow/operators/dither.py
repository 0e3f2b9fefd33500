"""Quantising pixels to a palette: nearest, Bayer, blue noise, auto and Sierra.

Long-form operators are window and array expressions that any table can take;
the block kernels quantise whole frames inside Arrow batches with the same
arithmetic, and keep one table from colour to index per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaflow.functions import color as C

from .nearest import band_table
from .palette import nearest as nearest_index

# Least run, side of a tile, pixels a contour pixel stands for, and the share of tiles above which all are live.
RUN, TILE, DENSITY, WHOLE_NUM, WHOLE_DEN = 8, 32, 50, 4, 3
# Fixed value: activity up to which the lossy scale is least.
SCALE_GATE = 16
#: Pairs that may be broadcast: those of 256 palette colours.
MOST_PAIRS = 65_536
MODES = ("none", "bayer", "bluenoise", "sierra2", "auto")


# Long form.


def activity(px: DataFrame) -> DataFrame:
    """px with `act`: L1 difference to the left pixel and to the upper one (itself at a border)."""
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    here = [F.col(c) for c in "rgb"]
    left = C.l1(here, [F.coalesce(F.lag(c).over(row), F.col(c)) for c in "rgb"])
    upper = C.l1(here, [F.coalesce(F.lag(c).over(column), F.col(c)) for c in "rgb"])
    return px.withColumn("_left", left).withColumn("act", F.col("_left") + upper).drop("_left")


def with_attenuation(px: DataFrame, gate: int) -> DataFrame:
    return activity(px).withColumn("att", C.attenuation(F.col("act"), gate))


def _islands(df: DataFrame, line: list[str], at: str) -> DataFrame:
    w = Window.partitionBy(*line).orderBy(at)
    new = F.coalesce((F.col("idx") != F.lag("idx").over(w)).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w)).drop("_new")


def long_runs(idx_px: DataFrame, least: int = RUN) -> DataFrame:
    """idx_px(frame, y, x, idx) with `long_run`: whether x is in a run of `least` equal indexes of its row."""
    size = F.count("*").over(Window.partitionBy("frame", "y", "_island"))
    return _islands(idx_px, ["frame", "y"], "x").withColumn("long_run", size >= least).drop("_island")


def contours(flagged: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """long_runs rows with `contours` 0..2: borders to the left and above between long
    runs of different indexes; with `pairs(i, j, eligible)` only between eligible ones."""
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    near = flagged
    for name, w in (("left", row), ("up", column)):
        near = near.withColumn(f"_{name}", F.lag("idx").over(w)).withColumn(f"_{name}_run", F.lag("long_run").over(w))
    total = F.lit(0)
    if pairs is not None:
        pairs = pairs.where("eligible").select("i", "j")
        small = pairs.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS
    for name in ("left", "up"):
        border = F.col("long_run") & F.coalesce(F.col(f"_{name}_run"), F.lit(False)) & (F.col("idx") != F.col(f"_{name}"))
        if pairs is not None:
            own = pairs.select(F.col("i").alias(f"_i_{name}"), F.col("j").alias(f"_j_{name}"))
            near = near.join(F.broadcast(own) if small else own, (F.col("idx") == F.col(f"_i_{name}")) & (F.col(f"_{name}") == F.col(f"_j_{name}")), "left")
            border = border & F.col(f"_i_{name}").isNotNull()
        total = total + border.cast("int")
    return near.withColumn("contours", total).select(*flagged.columns, "contours")


def tiles(scored: DataFrame, size: int = TILE, density: int = DENSITY) -> DataFrame:
    """Tiles with contour count, area and whether they are live; all are where more than
    three quarters of a frame's tiles are."""
    ty, tx = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    by = scored.groupBy("frame", ty.alias("ty"), tx.alias("tx")).agg(F.sum("contours").alias("contour"), F.count("*").alias("area"))
    own = by.withColumn("_own", F.col("contour") * density > F.col("area"))
    whole = Window.partitionBy("frame")
    all_live = F.sum(F.col("_own").cast("int")).over(whole) * WHOLE_NUM > F.count("*").over(whole) * WHOLE_DEN
    return own.withColumn("live", F.col("_own") | all_live).drop("_own")


def bayer_offset(y: Column, x: Column) -> Column:
    """What Bayer dithering adds to each channel at a position: -8..7."""
    matrix = F.array(*(F.lit(int(v)) for v in C.bayer8().ravel()))
    return F.shiftright(F.get(matrix, (y % 8) * 8 + x % 8), 2) - 8


# Block form.


class ColorTable:
    """Colour to palette index and back, filled for the colours that come up.

    Answers are kept in a table over all 2^24 colours, 32 MiB a running task."""

    def __init__(self, palette: np.ndarray):
        self.palette = np.asarray(palette, dtype=np.uint8)
        self.lab = C.oklab_np(self.palette)
        self.table = np.zeros(1 << 24, dtype=np.uint16)  # index + 1

    def index(self, rgb: np.ndarray) -> np.ndarray:
        """Indexes of (..., 3) integer colours."""
        rgb = rgb.astype(np.int32)
        key = rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]
        found = self.table[key]
        if (found == 0).any():
            new = np.unique(key[found == 0])
            parts = np.stack([new >> 16, new >> 8 & 255, new & 255], axis=-1)
            self.table[new] = nearest_index(C.oklab_np(parts), self.lab) + 1
            found = self.table[key]
        return (found - 1).astype(np.uint8)

    def color(self, idx: np.ndarray) -> np.ndarray:
        return self.palette[idx].astype(np.int32)


def activity_np(rgb: np.ndarray) -> np.ndarray:
    rgb = rgb.astype(np.int32)
    act = np.zeros(rgb.shape[:2], dtype=np.int32)
    act[:, 1:] += np.abs(rgb[:, 1:] - rgb[:, :-1]).sum(axis=2)
    act[1:] += np.abs(rgb[1:] - rgb[:-1]).sum(axis=2)
    return act


def attenuation_np(rgb: np.ndarray, gate: int) -> np.ndarray:
    if gate == 0:
        return np.full(rgb.shape[:2], 256, dtype=np.int32)
    return np.clip((gate + 64 - activity_np(rgb)) * 4, 0, 256)


def long_runs_np(idx: np.ndarray, least: int = RUN) -> np.ndarray:
    new = np.ones(idx.shape, dtype=bool)
    new[:, 1:] = idx[:, 1:] != idx[:, :-1]
    island = np.cumsum(new.ravel()) - 1
    return (np.bincount(island)[island] >= least).reshape(idx.shape)


def live_np(idx: np.ndarray, eligible: np.ndarray) -> np.ndarray:
    """Per pixel whether its tile is live."""
    run = long_runs_np(idx)
    found = np.zeros(idx.shape, dtype=np.int64)
    found[:, 1:] += run[:, 1:] & run[:, :-1] & eligible[idx[:, 1:], idx[:, :-1]]
    found[1:] += run[1:] & run[:-1] & eligible[idx[1:], idx[:-1]]
    h, w = idx.shape
    ys, xs = np.arange(0, h, TILE), np.arange(0, w, TILE)
    count = np.add.reduceat(np.add.reduceat(found, ys, axis=0), xs, axis=1)
    area = np.outer(np.diff(np.append(ys, h)), np.diff(np.append(xs, w)))
    live = count * DENSITY > area
    if live.sum() * WHOLE_NUM > live.size * WHOLE_DEN:
        live[:] = True
    return np.repeat(np.repeat(live, TILE, axis=0)[:h], TILE, axis=1)[:, :w]


def blue_noise_np(rgb: np.ndarray, near: np.ndarray, att: np.ndarray, table: ColorTable) -> np.ndarray:
    """Indexes after the ordered choice between the nearest and the far colour."""
    out = near.copy()
    rows, cols = np.nonzero(att > 0)
    p, c1 = rgb[rows, cols].astype(np.int64), table.color(near[rows, cols]).astype(np.int64)
    err = p - c1
    far = table.index(np.clip(p + 2 * err, 0, 255))
    span = table.color(far).astype(np.int64) - c1
    along = np.maximum((err * span).sum(axis=1), 0)
    mask = C.blue_noise()[rows & 63, cols & 63].astype(np.int64)
    take = (err != 0).any(axis=1) & (mask * (span * span).sum(axis=1) < along * att[rows, cols])
    out[rows[take], cols[take]] = far[take]
    return out


def toward_zero(e: np.ndarray, by: int) -> np.ndarray:
    return np.sign(e) * (np.abs(e) // by)


def sierra_np(rgb: np.ndarray, clear: np.ndarray, table: ColorTable, trans: int) -> np.ndarray:
    """Sierra-2-4A error diffusion of a stack (n, h, w, 3); one step handles a pixel of every frame."""
    n, h, w, _ = rgb.shape
    out = np.empty((n, h, w), dtype=np.uint8)
    coming = np.zeros((n, w + 2, 3), dtype=np.int32)
    for y in range(h):
        below = np.zeros_like(coming)
        carry = np.zeros((n, 3), dtype=np.int32)
        for x in range(w):
            want = np.clip(rgb[:, y, x].astype(np.int32) + carry + coming[:, x + 1], 0, 255)
            idx = table.index(want)
            err = np.where(clear[:, y, x, None], 0, want - table.color(idx))
            out[:, y, x] = np.where(clear[:, y, x], trans, idx)
            carry = toward_zero(err, 2)
            down = toward_zero(err, 4)
            below[:, x] += down
            below[:, x + 1] += down
        coming = below
    return out


def quantize_np(frames: np.ndarray, table: ColorTable, mode: str, gate: int = 16, exact: bool = False, scaled: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Indexes of a stack (n, h, w, 4) of RGBA frames, transparent pixels at the index after
    the palette's, and the lossy scale map of plain quantising where it is asked for."""
    if mode not in MODES:
        raise ValueError(f"dither must be one of {MODES}")
    trans = len(table.palette)
    rgb, clear = frames[..., :3], frames[..., 3] < 128
    if mode == "sierra2":
        return sierra_np(rgb, clear, table, trans), None
    idx = table.index(rgb)
    scale = None
    if not exact and mode == "bayer":
        h, w = idx.shape[1:]
        offset = (C.bayer8()[np.arange(h)[:, None] & 7, np.arange(w)[None, :] & 7] >> 2) - 8
        moved = table.index(np.clip(rgb.astype(np.int32) + offset[None, :, :, None], 0, 255))
        same = (table.color(idx) == rgb).all(axis=-1)
        idx = np.where(same, idx, moved)
    elif not exact and mode in ("bluenoise", "auto"):
        eligible = band_table(table.palette) if mode == "auto" else None
        for k in range(len(idx)):
            att = attenuation_np(rgb[k], gate)
            if eligible is not None:
                att = np.where(live_np(idx[k], eligible), att, 0)
            idx[k] = blue_noise_np(rgb[k], idx[k], att, table)
    elif mode == "none" and scaled:
        scale = np.stack([8 + (256 - attenuation_np(f, SCALE_GATE)) * 247 // 256 for f in rgb]).astype(np.uint8)
    return np.where(clear, trans, idx).astype(np.uint8), scale


def quantize(frames: DataFrame, width: int, height: int, palette: np.ndarray, mode: str = "auto", gate: int = 16, exact: bool = False, scaled: bool = False, batch: int = 16) -> DataFrame:
    """frames(frame, data) of RGBA bytes to idx_frames(frame, idx, scale)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ColorTable(palette)
        for b in batches:
            if not b.num_rows:
                continue
            stack = np.stack([np.frombuffer(d, dtype=np.uint8).reshape(height, width, 4) for d in b.column(1).to_pylist()])
            idx, scale = quantize_np(stack, table, mode, gate, exact, scaled)
            scales = [None] * len(idx) if scale is None else [s.tobytes() for s in scale]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.tobytes() for i in idx], pa.binary()), pa.array(scales, pa.binary())], names=["frame", "idx", "scale"])

    frames.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    return frames.select(F.col("frame").cast("int").alias("frame"), "data").mapInArrow(run, "frame int, idx binary, scale binary")
