"""Colour counting: histograms, stretches, runs and coarse folds.

Long form has one row per pixel, px(frame, y, x, r, g, b, a); block form has
one row per frame with its bytes.  Counting from block form adds up each batch
before anything is shuffled, so the shuffle carries colours and not pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaflow.functions import color as C

from .delta import SPAN

#: Distinct colours beyond which a histogram is folded to the grid before a palette is cut.
FOLD_ABOVE = 131_072
#: Longest run of one packed run.
PACKED_RUN = 256


def with_key(px: DataFrame) -> DataFrame:
    return px.withColumn("rgb", C.color_key(F.col("r"), F.col("g"), F.col("b")))


def color_histogram(px: DataFrame) -> DataFrame:
    """hist(rgb, n) of the opaque pixels."""
    return with_key(px.where(C.opaque(F.col("a")))).groupBy("rgb").agg(F.count("*").alias("n"))


#: Key under which `frame_histogram` counts transparent pixels, if asked to.
CLEAR = -1


def frame_histogram(frames: DataFrame, batch: int = 16, clear: bool = False) -> DataFrame:
    """hist(rgb, n) of frames(data) holding RGBA bytes; with `clear` transparent pixels count as CLEAR."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for raw in b.column(0).to_pylist():
                p = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 4)
                on = p[:, 3] >= 128
                p = p.astype(np.int32)
                own = p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]
                keys.append(np.where(on, own, CLEAR) if clear else own[on])
            rgb, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rgb, pa.int32()), pa.array(n, pa.int64())], names=["rgb", "n"])

    frames.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    return frames.select("data").mapInArrow(count, "rgb int, n long").groupBy("rgb").agg(F.sum("n").alias("n"))


def stretches(px: DataFrame, within: Column | None = None) -> DataFrame:
    """Maximal runs of frames in which a pixel keeps its colour: (y, x, first, rgb, len).
    A transparent pixel ends a stretch and has none of its own.  `within`: what a stretch
    does not cross (by default nothing)."""
    px = px.withColumn("_within", F.lit(0) if within is None else within)
    at = Window.partitionBy("y", "x", "_within").orderBy("frame")
    key = F.when(C.opaque(F.col("a")), C.color_key(F.col("r"), F.col("g"), F.col("b")))
    marked = px.withColumn("rgb", key).withColumn("new", (~F.col("rgb").eqNullSafe(F.lag("rgb").over(at)) | (F.row_number().over(at) == 1)).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(at)).where(F.col("rgb").isNotNull())
    return island.groupBy("y", "x", "_within", "island", "rgb").agg(F.min("frame").alias("first"), F.count("*").alias("len")).select("y", "x", "first", "rgb", "len")


def change_weighted_histogram(px: DataFrame) -> DataFrame:
    """hist(rgb, n) added up from stretches; equals `color_histogram`.  A stretch may be
    cut for that, so positions are dealt into spans of frames."""
    span = F.floor(F.col("frame") / SPAN)
    return stretches(px, span).groupBy("rgb").agg(F.sum("len").alias("n"))


def row_runs(px: DataFrame, packed: int | None = None) -> DataFrame:
    """Runs of equal colour along the opaque pixels of a frame: (frame, run, rgb, len).
    Transparent pixels neither break a run nor count.  `packed` splits runs longer than that."""
    at = Window.partitionBy("frame").orderBy("y", "x")
    own = with_key(px.where(C.opaque(F.col("a"))))
    marked = own.withColumn("new", F.coalesce((F.col("rgb") != F.lag("rgb").over(at)).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(at)).groupBy("frame", "run", "rgb").agg(F.count("*").alias("len"))
    if packed is None:
        return runs.select("frame", "run", "rgb", "len")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / packed)))
    return runs.withColumn("part", part).select("frame", "run", "part", "rgb", F.least(F.lit(packed).cast("long"), F.col("len") - F.col("part") * packed).alias("len"))


def coarse_fold(hist: DataFrame) -> DataFrame:
    """Grid cells with their counts and rounded mean colours: (cell, n, r, g, b)."""
    r, g, b = C.channels(F.col("rgb"))
    sums = hist.select(C.grid_key(r, g, b).alias("cell"), "n", *((F.col("n") * c).alias(k) for k, c in zip("rgb", (r, g, b), strict=True)))
    cells = sums.groupBy("cell").agg(*(F.sum(k).alias(k) for k in ("n", "r", "g", "b")))
    return cells.select("cell", "n", *(F.floor((F.col(k) + F.floor(F.col("n") / 2)) / F.col("n")).cast("int").alias(k) for k in "rgb"))


def occupied_cells(hist: DataFrame) -> DataFrame:
    return hist.select(C.grid_key(*C.channels(F.col("rgb"))).alias("cell")).distinct()


def sorted_entries(hist: DataFrame) -> DataFrame:
    """hist(rgb, n) with the `place` of each colour in their order, from 1.  Colours are dealt by
    their high bits into at most 4096 parts, each numbered from the sizes of those before."""
    part = F.shiftright("rgb", 12)
    sizes = hist.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = hist.withColumn("_part", part).withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("rgb")))
    placed = own.join(F.broadcast(sizes.select("_part", earlier.alias("_earlier"))), "_part")
    return placed.select("rgb", "n", (F.col("_earlier") + F.col("_own")).alias("place"))


def palette_entries(hist: DataFrame, fold_above: int = FOLD_ABOVE) -> DataFrame:
    """entries(rgb, n) a palette is cut from: exact colours, or cell means where there are
    more than `fold_above`.  At most 262,144 rows either way."""
    if hist.limit(fold_above + 1).count() <= fold_above:
        return hist
    folded = coarse_fold(hist)
    return folded.select(C.color_key(F.col("r"), F.col("g"), F.col("b")).alias("rgb"), "n").groupBy("rgb").agg(F.sum("n").alias("n"))


def any_transparent(px: DataFrame) -> DataFrame:
    return px.agg(F.coalesce(F.bool_or(~C.opaque(F.col("a"))), F.lit(False)).alias("any_alpha"))


def packed_sizes(px: DataFrame) -> DataFrame:
    """By frame: pixels, whether all are opaque, and the bytes it takes with alpha dropped where it says nothing."""
    by = px.groupBy("frame").agg(F.count("*").alias("pixels"), F.bool_and(C.opaque(F.col("a"))).alias("opaque"))
    return by.withColumn("bytes", F.col("pixels") * F.when(F.col("opaque"), 3).otherwise(4))
