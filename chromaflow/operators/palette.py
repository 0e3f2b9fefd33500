"""Palettes: weighted median cut in OkLab and k-means refinement.

A cut works on at most 262,144 entries (histograms are folded before), so it
runs in NumPy on the driver in a fixed order, which makes it the same at any
number of partitions.  Its steps are operators on tables of any size too:
`box_moments`, `weighted_split` and `kmeans_step`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaflow.functions import color as C

#: Share of a box or cluster from which its commonest colour stands for it exactly.
DOMINANT = 0.99
REFINE_ROUNDS = 3


def _rgb(key: np.ndarray) -> np.ndarray:
    return np.stack([key >> 16 & 255, key >> 8 & 255, key & 255], axis=-1)


def _key(rgb: np.ndarray) -> np.ndarray:
    rgb = rgb.astype(np.int64)
    return rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]


class _Box:
    """Entries in the order of their colours, with their error by channel."""

    def __init__(self, rgb: np.ndarray, n: np.ndarray, lab: np.ndarray):
        self.rgb, self.n, self.lab = rgb, n, lab
        w = n[:, None].astype(np.float64)
        self.total, self.sum = float(n.sum()), (w * lab).sum(axis=0)
        error = np.maximum((w * lab * lab).sum(axis=0) - self.sum**2 / self.total, 0.0)
        self.axis = int(error.argmax())
        self.score = float(error[self.axis]) if len(n) > 1 else -1.0

    def halves(self) -> tuple[_Box, _Box]:
        order = np.lexsort((self.rgb, self.lab[:, self.axis] + 0.0))
        reach = np.cumsum(self.n[order])
        border = -(-int(self.total) // 2)
        cut = min(int(np.searchsorted(reach, border, side="right")) + 1, len(order) - 1)
        left = np.zeros(len(order), dtype=bool)
        left[order[:cut]] = True
        return self._only(left), self._only(~left)

    def _only(self, which: np.ndarray) -> _Box:
        return _Box(self.rgb[which], self.n[which], self.lab[which])

    def color(self) -> np.ndarray:
        top = int(self.n.argmax())
        if len(self.n) == 1 or self.n[top] >= DOMINANT * self.total:
            return _rgb(self.rgb[top])
        return C.oklab_to_rgb_np(self.sum / self.total)


def median_cut(rgb: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """At most `most` colours (k, 3) for entries with counts.  No entry gives black; as
    many colours as fit are kept exactly, in the order of their keys."""
    order = np.argsort(rgb, kind="stable")
    rgb, n = np.asarray(rgb)[order].astype(np.int64), np.asarray(n)[order].astype(np.int64)
    if not len(rgb):
        return np.zeros((1, 3), dtype=np.uint8)
    if len(rgb) <= most:
        return _rgb(rgb).astype(np.uint8)
    boxes = [_Box(rgb, n, C.oklab_np(_rgb(rgb)).astype(np.float64))]
    while len(boxes) < most:
        worst = max(range(len(boxes)), key=lambda i: boxes[i].score)
        if boxes[worst].score < 0:
            break
        boxes[worst], right = boxes[worst].halves()
        boxes.append(right)
    return np.stack([b.color() for b in boxes]).astype(np.uint8)


def nearest(lab: np.ndarray, palette_lab: np.ndarray) -> np.ndarray:
    """Index of the nearest palette colour, the lowest on ties."""
    out = np.empty(len(lab), dtype=np.int64)
    columns = [np.ascontiguousarray(c) for c in palette_lab.T]
    for at in range(0, len(lab), 1024):  # the distances of a part stay in cache
        part = lab[at : at + 1024]
        total = np.zeros((len(part), len(palette_lab)), dtype=lab.dtype)
        for k, column in enumerate(columns):
            gap = part[:, k, None] - column
            gap *= gap
            total += gap
        out[at : at + 1024] = total.argmin(axis=1)
    return out


def refine(palette: np.ndarray, rgb: np.ndarray, n: np.ndarray, rounds: int = REFINE_ROUNDS) -> np.ndarray:
    """k-means of the entries from the palette's colours; a slot without entries keeps its colour."""
    if len(rgb) <= len(palette):
        return palette
    order = np.argsort(rgb, kind="stable")
    rgb, n = np.asarray(rgb)[order].astype(np.int64), np.asarray(n)[order].astype(np.int64)
    lab, palette = C.oklab_np(_rgb(rgb)), palette.copy()
    for _ in range(rounds):
        at = nearest(lab, C.oklab_np(palette))
        for k in np.unique(at):
            own = np.flatnonzero(at == k)
            weight, top = float(n[own].sum()), own[n[own].argmax()]
            if n[top] >= DOMINANT * weight:
                palette[k] = _rgb(rgb[top])
            else:
                palette[k] = C.oklab_to_rgb_np((n[own, None] * lab[own].astype(np.float64)).sum(axis=0) / weight)
    return palette


def build_palette(entries: DataFrame, most: int) -> np.ndarray:
    """The refined palette of entries(rgb, n), which hold at most 262,144 rows."""
    rows = entries.select("rgb", "n").toPandas()
    rgb, n = rows["rgb"].to_numpy(), rows["n"].to_numpy()
    return refine(median_cut(rgb, n, most), rgb, n)


def box_moments(entries: DataFrame, box: str, values: list[str], weight: str = "n", name: str = "rgb") -> DataFrame:
    """By box: total weight, weighted sums, squared errors, the commonest entry (the least
    `name` on ties) and the number of the value with the largest error."""
    w = F.col(weight)
    sums = [F.sum(w * F.col(v)).alias(f"sum_{v}") for v in values]
    squares = [F.sum(w * F.col(v) * F.col(v)).alias(f"_sq_{v}") for v in values]
    top = F.max_by(F.struct(F.col(name).alias("name"), w.alias("n")), F.struct(w, -F.col(name)))
    out = entries.groupBy(box).agg(F.sum(w).alias("total"), *sums, *squares, top.alias("_top"))
    errors = [F.greatest(F.lit(0.0), F.col(f"_sq_{v}") - F.col(f"sum_{v}") * F.col(f"sum_{v}") / F.col("total")).alias(f"err_{v}") for v in values]
    out = out.select(box, "total", *(f"sum_{v}" for v in values), *errors, F.col("_top.name").alias("dominant"))
    worst = F.greatest(*(F.col(f"err_{v}") for v in values)) if len(values) > 1 else F.col(f"err_{values[0]}")
    axis = F.coalesce(*(F.when(F.col(f"err_{v}") == worst, F.lit(i)) for i, v in enumerate(values)))
    return out.withColumn("axis", axis)


def worst_box(moments: DataFrame, box: str, values: list[str]) -> DataFrame:
    """The box with the largest error in one value, the least box on ties: the next to be split."""
    worst = F.greatest(*(F.col(f"err_{v}") for v in values)) if len(values) > 1 else F.col(f"err_{values[0]}")
    top = F.max_by(F.struct(box, "axis", "total"), F.struct(worst, -F.col(box)))
    return moments.agg(top.alias("t")).select("t.*")


def weighted_split(entries: DataFrame, box: str, value: str, weight: str = "n", name: str = "rgb") -> DataFrame:
    """Every entry with the side of the weighted median it falls on: `is_left` is the least
    prefix by (value, name) whose weight passes half, never the whole box."""
    order = Window.partitionBy(box).orderBy(value, name)
    whole = Window.partitionBy(box)
    reach = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1))
    half = F.ceil(F.sum(weight).over(whole) / 2)
    last = F.row_number().over(order) == F.count("*").over(whole)
    return entries.withColumn("is_left", (F.coalesce(reach, F.lit(0)) <= half) & ~(last & (F.count("*").over(whole) > 1)))


def kmeans_step(entries: DataFrame, assigned: str, values: list[str], weight: str = "n", name: str = "rgb") -> DataFrame:
    """By slot: weight, weighted means, commonest entry and its weight.  Partial sums form before the shuffle."""
    w = F.col(weight)
    top = F.max_by(F.struct(F.col(name).alias("name"), w.alias("n")), F.struct(w, -F.col(name)))
    means = [(F.sum(w * F.col(v)) / F.sum(w)).alias(f"mean_{v}") for v in values]
    out = entries.groupBy(assigned).agg(F.sum(w).alias("total"), *means, top.alias("_top"))
    return out.select(assigned, "total", *(f"mean_{v}" for v in values), F.col("_top.name").alias("dominant"), F.col("_top.n").alias("dominant_n"))
