"""Nearest palette colours and the pair tables of a palette.

A palette has at most 255 colours and a vector table's centroids are few, so
they travel as one array literal and the argmin is a narrow expression: no
join, no shuffle.  Colours repeat, so a lookup table over the distinct colours
is computed once and joined back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaflow.functions import color as C
from chromaflow.functions.color import oklab_np

#: Colours that a lookup table may have to be broadcast: 16 bytes each.
BROADCAST_COLORS = 1_000_000
# OkLab distances between palette colours whose border can show as a band.
BAND_LOW, BAND_HIGH = 0.012, 0.05
# Colours that may stand for one, and the squared RGB distance a lossy level allows, as 40 times it.
FAN_OUT, RADIUS = 16, 40


def palette_array(palette: np.ndarray) -> Column:
    """array<struct<r, g, b>> literal."""
    return F.array(*(F.struct(*(F.lit(int(v)).alias(k) for k, v in zip("rgb", p, strict=True))) for p in palette))


def argmin(items: Column, distance) -> Column:
    """Position of the least distance, the first on ties."""
    scored = F.transform(items, lambda p, i: F.struct(distance(p).alias("d"), i.alias("i")))
    return F.array_min(scored)["i"]


def nearest_rgb(palette: Column, r: Column, g: Column, b: Column) -> Column:
    """Nearest by squared RGB distance: exact in integers."""
    return argmin(palette, lambda p: (p["r"] - r) * (p["r"] - r) + (p["g"] - g) * (p["g"] - g) + (p["b"] - b) * (p["b"] - b))


def nearest_lab(palette: np.ndarray, lab: tuple[Column, Column, Column]) -> Column:
    """Nearest by squared OkLab distance in float32, as the kernels see it."""
    colors = F.array(*(F.struct(*(F.lit(float(v)).cast("float").alias(k) for k, v in zip("lab", p, strict=True))) for p in oklab_np(palette)))
    lum, a, b = (c.cast("float") for c in lab)
    return argmin(colors, lambda p: (p["l"] - lum) * (p["l"] - lum) + (p["a"] - a) * (p["a"] - a) + (p["b"] - b) * (p["b"] - b))


def build_lut(hist: DataFrame, palette: np.ndarray) -> DataFrame:
    """lut(rgb, idx) of the distinct colours."""
    colors = hist.select("rgb").distinct()
    return colors.select("rgb", nearest_lab(palette, C.oklab(*C.channels(F.col("rgb")))).alias("idx"))


def map_colors(px: DataFrame, lut: DataFrame) -> DataFrame:
    """px(rgb, ...) with idx.  A table of at most BROADCAST_COLORS colours is broadcast;
    a larger one is joined by shuffle, where Spark splits colours that are common."""
    small = lut.limit(BROADCAST_COLORS + 1).count() <= BROADCAST_COLORS
    return px.join(F.broadcast(lut) if small else lut, "rgb")


def band_pairs(palette: DataFrame, low: float = BAND_LOW, high: float = BAND_HIGH) -> DataFrame:
    """palette(idx, r, g, b), at most 256 rows, to pairs(i, j, eligible)."""
    lab = palette.select("idx", *(c.alias(k) for k, c in zip("lab", C.oklab(*(F.col(c) for c in "rgb")), strict=True)))
    i, j = lab.select(*(F.col(c).alias(f"{c}1") for c in lab.columns)), lab.select(*(F.col(c).alias(f"{c}2") for c in lab.columns))
    d = F.sqrt(sum(((F.col(f"{k}1") - F.col(f"{k}2")) * (F.col(f"{k}1") - F.col(f"{k}2")) for k in "ab"), (F.col("l1") - F.col("l2")) * (F.col("l1") - F.col("l2"))))
    return i.crossJoin(F.broadcast(j)).select(F.col("idx1").alias("i"), F.col("idx2").alias("j"), ((d >= low) & (d < high)).alias("eligible"))


def band_table(palette: np.ndarray, low: float = BAND_LOW, high: float = BAND_HIGH) -> np.ndarray:
    lab = oklab_np(palette).astype(np.float64)
    d = np.sqrt(((lab[:, None] - lab[None]) ** 2).sum(axis=2))
    return (d >= low) & (d < high)


def substitutes(palette: DataFrame, level: int) -> DataFrame:
    """palette(idx, r, g, b) to the colours that may stand for each: (i, j, d, rank)."""
    i, j = palette.select(*(F.col(c).alias(f"{c}1") for c in palette.columns)), palette.select(*(F.col(c).alias(f"{c}2") for c in palette.columns))
    d = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "gb"), (F.col("r1") - F.col("r2")) * (F.col("r1") - F.col("r2")))
    pairs = i.crossJoin(F.broadcast(j)).where("idx1 != idx2").select(F.col("idx1").alias("i"), F.col("idx2").alias("j"), d.alias("d")).where(F.col("d") <= RADIUS * level)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= FAN_OUT)


def substitute_table(palette: np.ndarray, level: int) -> list[list[int]]:
    p = palette.astype(np.int64)
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(p)):
        own = [j for j in np.lexsort((np.arange(len(p)), d[i])).tolist() if j != i and d[i, j] <= RADIUS * level]
        out.append(own[:FAN_OUT])
    return out
