"""Noise filters: spatial smoothing and the temporal hold.

The hold is recursive per pixel, so it folds over the frames of a strip of rows
in order, a batch at a time; strips are independent.  Its windows depend on unheld frames
only, so they are found for all frames first, with ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .delta import before

BINS, LEAST_WINDOW = 256, 4
FRACTION, RATE = 7, 3
STRIP_ROWS = 32


def noise_histogram(px: DataFrame, every: int = 4, chunk: int = 16) -> DataFrame:
    """(frame, d, n): how often a pixel of a frame differs by d (capped at 255) in L1 over four
    bytes from the frame before.  The first pair counts all pixels, later ones the first
    of every `every` chunks of `chunk` positions."""
    d = sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in "gba"), F.abs(F.col("r") - F.col("_r")))
    near = before(px, {f"_{c}": c for c in "rgba"}).where("_r is not null").withColumn("d", F.least(d, F.lit(BINS - 1)))
    sampled = (F.col("frame") == 1) | (F.floor(F.col("pos") / chunk) % every == 0)
    return near.where(sampled).groupBy("frame", "d").agg(F.count("*").alias("n"))


def quantile(hist: DataFrame, group: str, value: str, num: int, den: int, name: str) -> DataFrame:
    """The least value whose running count reaches num/den of its group's total."""
    order, whole = Window.partitionBy(group).orderBy(value), Window.partitionBy(group)
    reach = hist.withColumn("_a", F.sum("n").over(order)).withColumn("_t", F.sum("n").over(whole))
    return reach.where(F.col("_a") * den >= F.col("_t") * num).groupBy(group).agg(F.min(value).alias(name))


def window_of(p50: Column, p75: Column, cap: int) -> Column:
    wide = F.greatest(F.floor((p50 * 5 + 1) / 2).cast("int"), p75)
    return F.greatest(F.lit(LEAST_WINDOW), F.least(wide, F.lit(max(cap, LEAST_WINDOW))))


def hold_windows(hist: DataFrame, cap: int) -> DataFrame:
    """(frame, window): frame 1 uses its own pair, frame k the pair before it."""
    own = quantile(hist, "frame", "d", 1, 2, "p50").join(quantile(hist, "frame", "d", 3, 4, "p75"), "frame")
    own = own.select("frame", window_of(F.col("p50"), F.col("p75"), cap).alias("own"))
    late = own.select((F.col("frame") + 1).alias("frame"), F.col("own").alias("window"))
    return own.where("frame = 1").select("frame", F.col("own").alias("window")).unionByName(late)


class HoldState:
    """Held bytes and running means (fixed point) of the pixels of a strip."""

    def __init__(self, first: np.ndarray):
        self.held = first.astype(np.int32)
        self.mean = self.held << FRACTION

    def step(self, now: np.ndarray, window: int) -> np.ndarray:
        now = now.astype(np.int32)
        middle = (self.mean + (1 << (FRACTION - 1))) >> FRACTION
        keep = (np.abs(now - middle).sum(axis=-1) < window) & (np.abs(now - self.held).sum(axis=-1) < window + window // 2)
        moved = self.mean + (((now << FRACTION) - self.mean) >> RATE)
        self.mean = np.where(keep[..., None], moved, now << FRACTION)
        self.held = np.where(keep[..., None], self.held, now)
        return self.held.astype(np.uint8)


def hold_np(frames: np.ndarray, windows: list[int]) -> np.ndarray:
    """A stack (n, ..., 4) with the windows of frames 1 on."""
    state, out = HoldState(frames[0]), [frames[0]]
    for f, w in zip(frames[1:], windows, strict=True):
        out.append(state.step(f, w))
    return np.stack(out)


def pair_histograms(frames: DataFrame, width: int, height: int) -> DataFrame:
    """`noise_histogram` from frames(frame, data): every frame meets the one before in an equi join."""
    late = frames.select((F.col("frame") + 1).alias("frame"), F.col("data").alias("before"))
    pairs = frames.select("frame", "data").join(late, "frame")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = (np.arange(width * height) // 16) % 4 == 0
        for b in batches:
            for frame, now, before in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                d = np.abs(np.frombuffer(now, np.uint8).astype(np.int32) - np.frombuffer(before, np.uint8)).reshape(-1, 4).sum(axis=1)
                n = np.bincount(np.minimum(d if frame == 1 else d[sampled], BINS - 1), minlength=BINS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), frame), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["frame", "d", "n"])

    return pairs.mapInArrow(count, "frame int, d int, n long")


def hold(frames: DataFrame, width: int, height: int, cap: int, strip: int = STRIP_ROWS) -> DataFrame:
    """frames(frame, data) with pixels that only shimmer kept.  Strips fold in parallel; a task
    reads its strips in order and holds the state of one and a batch of its frames."""
    windows = hold_windows(pair_histograms(frames, width, height), cap)
    rows = F.sequence(F.lit(0), F.lit((height - 1) // strip))
    size = width * 4 * strip
    met = frames.join(windows, "frame", "left").select(F.col("frame").cast("int").alias("frame"), F.coalesce("window", F.lit(LEAST_WINDOW)).alias("window"), F.explode(rows).alias("strip"), "data")
    cut = met.select("frame", "strip", "window", F.expr(f"substring(data, strip * {size} + 1, {size})").alias("data"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for b in batches:
            out = []
            for strip, window, data in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                now = np.frombuffer(data, np.uint8).reshape(-1, 4)
                if strip != last:
                    state, last = HoldState(now), strip
                    out.append(data)
                else:
                    out.append(state.step(now, window).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["frame", "strip", "data"])

    held = cut.repartition("strip").sortWithinPartitions("strip", "frame").mapInArrow(fold, "frame int, strip int, data binary")
    whole = held.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("strip", "data"))).alias("s"))
    return whole.select("frame", F.aggregate("s", F.lit(b""), lambda acc, s: F.concat(acc, s["data"])).alias("data"))


def hold_px(px: DataFrame, window: int | DataFrame) -> DataFrame:
    """`hold` in long form, with one window or windows(frame, window).  Positions are dealt
    over the tasks; a task reads its frames in order and holds a state of each of its
    positions, which does not grow with the number of frames."""
    windowed = px.withColumn("window", F.lit(window)) if isinstance(window, int) else px.join(window, "frame", "left").withColumn("window", F.coalesce("window", F.lit(LEAST_WINDOW)))
    rows = windowed.select("frame", "y", "x", *"rgba", "window").repartition("y", "x").sortWithinPartitions("frame", "y", "x")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, mean = np.zeros(0, np.int64), np.zeros((0, 4), np.int32), np.zeros((0, 4), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            frame, y, x, *rgba, windows = (b.column(c).to_numpy(zero_copy_only=False) for c in range(8))
            key, now = y.astype(np.int64) << 32 | x, np.stack(rgba, axis=1).astype(np.int32)
            fresh, first = np.unique(key, return_index=True)
            isnew = ~np.isin(fresh, known)
            if isnew.any():  # a position opens with what it shows first
                known = np.concatenate([known, fresh[isnew]])
                order = np.argsort(known)
                known = known[order]
                held = np.concatenate([held, now[first[isnew]]])[order]
                mean = np.concatenate([mean, now[first[isnew]] << FRACTION])[order]
            at = np.searchsorted(known, key)
            out = np.empty_like(now)
            starts = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1))
            for i, j in zip(starts, np.append(starts[1:], len(frame)), strict=True):
                own = at[i:j]
                state = HoldState(held[own])
                state.mean = mean[own]
                out[i:j] = state.step(now[i:j], int(windows[i]))
                held[own], mean[own] = state.held, state.mean
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(np.ascontiguousarray(out[:, k]), pa.int32()) for k in range(4))], names=["frame", "y", "x", *"rgba"])

    return rows.mapInArrow(fold, "frame int, y int, x int, r int, g int, b int, a int")


def smooth_np(frame: np.ndarray, limit: int) -> np.ndarray:
    """A frame (h, w, 4): each pixel the rounded mean of its 5x5 neighbours within `limit` in L1 over four bytes; alpha stays."""
    h, w, _ = frame.shape
    padded = np.pad(frame, ((2, 2), (2, 2), (0, 0)), mode="edge").astype(np.int32)
    here, total, count = frame.astype(np.int32), np.zeros((h, w, 3), np.int32), np.zeros((h, w), np.int32)
    for dy in range(5):
        for dx in range(5):
            near = padded[dy : dy + h, dx : dx + w]
            use = np.abs(near - here).sum(axis=2) < limit
            use |= dy == 2 and dx == 2
            total += np.where(use[..., None], near[..., :3], 0)
            count += use
    out = frame.copy()
    out[..., :3] = (total + (count // 2)[..., None]) // count[..., None]
    return out


def smooth(frames: DataFrame, width: int, height: int, limit: int) -> DataFrame:
    """frames(frame, data) smoothed, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [smooth_np(np.frombuffer(d, np.uint8).reshape(height, width, 4), limit).tobytes() for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["frame", "data"])

    return frames.select("frame", "data").mapInArrow(run, "frame int, data binary")


def smooth_px(px: DataFrame, limit: int, width: int, height: int) -> DataFrame:
    """`smooth` in long form: every pixel is sent to the 25 positions that see it, borders
    replicated, and one aggregate gathers them."""
    at = lambda c, last: F.greatest(F.lit(0), F.least(F.lit(last - 1), c))
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-2, 3) for dx in range(-2, 3)))
    seen = px.select("frame", "y", "x", *(F.col(c).alias(f"{c}0") for c in "rgba"), F.explode(offsets).alias("o"))
    seen = seen.withColumn("ny", at(F.col("y") + F.col("o.dy"), height)).withColumn("nx", at(F.col("x") + F.col("o.dx"), width))
    near = px.select(F.col("frame").alias("f2"), F.col("y").alias("ny2"), F.col("x").alias("nx2"), "r", "g", "b", "a")
    pairs = seen.join(near, (F.col("frame") == F.col("f2")) & (F.col("ny") == F.col("ny2")) & (F.col("nx") == F.col("nx2")))
    d = sum((F.abs(F.col(c) - F.col(f"{c}0")) for c in "gba"), F.abs(F.col("r") - F.col("r0")))
    use = (d < limit) | ((F.col("o.dy") == 0) & (F.col("o.dx") == 0))
    sums = pairs.where(use).groupBy("frame", "y", "x").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "rgb"), F.max("a0").alias("a"))
    mean = [F.floor((F.col(c) + F.floor(F.col("n") / 2)) / F.col("n")).cast("int").alias(c) for c in "rgb"]
    return sums.select("frame", "y", "x", *mean, "a")
