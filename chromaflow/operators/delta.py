"""Frame-to-frame change, timing and duplicate folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest delay of a frame, in hundredths of a second.
MAX_DELAY = 65_535
#: Frames of a position that one window sorts together, and frames of a clip.
SPAN, FOLD_SPAN = 1024, 4096


def before(px: DataFrame, columns: dict[str, str], span: int = SPAN) -> DataFrame:
    """Adds values of the same position in frame-1 under new names, null where it has none.
    A position is dealt into spans of frames, so a small raster with many frames is as
    parallel as a large one; the last frame of a span also opens the next, in the same shuffle."""
    own = F.floor(F.col("frame") / span).cast("long")
    both = F.array(F.struct(own.alias("s"), F.lit(False).alias("lead")), F.struct((own + 1).alias("s"), F.lit(True).alias("lead")))
    dealt = px.withColumn("_at", F.explode(F.when(F.pmod(F.col("frame"), F.lit(span)) == span - 1, both).otherwise(F.slice(both, 1, 1))))
    dealt = dealt.withColumn("_span", F.col("_at.s")).withColumn("_lead", F.col("_at.lead")).drop("_at")
    at = Window.partitionBy("y", "x", "_span").orderBy("frame")
    follows = F.lag("frame").over(at) == F.col("frame") - 1
    met = dealt.withColumns({new: F.when(follows, F.lag(value).over(at)) for new, value in columns.items()})
    return met.where(~F.col("_lead")).drop("_span", "_lead")


def with_previous(idx_px: DataFrame, value: str = "idx") -> DataFrame:
    """Adds `prev`, the value of the same position in the frame before."""
    return before(idx_px, {"prev": value})


def changed_box(idx_px: DataFrame) -> DataFrame:
    """delta(frame, x0, y0, x1, y1, changed) of frames that differ from the one before;
    frames without a row are duplicates (or the first)."""
    moved = with_previous(idx_px).where("prev is not null and prev <> idx")
    return moved.groupBy("frame").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("changed"))


def distances(px: DataFrame) -> DataFrame:
    """L1 distance of every pixel to the frame before, over colour and over all four bytes."""
    near = before(px, {f"_{c}": c for c in "rgba"}).where("_r is not null")
    gap = {n: sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in n[1:]), F.abs(F.col(n[0]) - F.col(f"_{n[0]}"))) for n in ("rgb", "rgba")}
    return near.select("frame", "y", "x", gap["rgb"].alias("l1_rgb"), gap["rgba"].alias("l1_rgba"))


def punch(idx_px: DataFrame, trans: int) -> DataFrame:
    """Pixels that did not change become the transparent index."""
    prev = with_previous(idx_px)
    return prev.withColumn("punched", F.when(F.col("prev") == F.col("idx"), F.lit(trans)).otherwise(F.col("idx"))).drop("prev")


def punched_share(idx_px: DataFrame) -> DataFrame:
    """By frame: pixels, pixels that did not change, and the encoding to try: punched from
    three fifths unchanged, plain up to a twentieth, else both."""
    by = with_previous(idx_px).groupBy("frame").agg(F.count("*").alias("pixels"), F.count_if(F.col("prev") == F.col("idx")).alias("same"))
    choice = F.when(F.col("same") * 5 >= F.col("pixels") * 3, "punched").when(F.col("same") * 20 <= F.col("pixels"), "plain").otherwise("both")
    return by.withColumn("choice", choice)


def frame_delay(i: Column, fps_num: int, fps_den: int = 1) -> Column:
    """Delay of frame i, so that delays add up to the clip's duration, rounded once."""

    def at(k: Column) -> Column:
        return _div(k.cast("long") * (100 * fps_den) + fps_num // 2, fps_num)

    return at(i + 1) - at(i)


def _div(a: Column, by: int) -> Column:
    """Whole part of a quotient of non-negative integers."""
    return ((a - a % by) / by).cast("long")


def frame_delays(frames: DataFrame, fps_num: int, fps_den: int = 1) -> DataFrame:
    """timing(frame, delay_cs)."""
    return frames.select("frame", frame_delay(F.col("frame"), fps_num, fps_den).alias("delay_cs"))


def fold_duplicates(timing: DataFrame) -> DataFrame:
    """timing(frame, delay_cs, visible) to visible frames with the delays of the
    duplicates that follow them.  A frame finds the last visible one in its span of
    frames, or that of the spans before, of which the one global window has a row each."""
    shown = F.when(F.col("visible"), F.col("frame"))
    spans = timing.withColumn("_span", F.floor(F.col("frame") / FOLD_SPAN).cast("long"))
    last = spans.groupBy("_span").agg(F.max(shown).alias("_last"))
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_span", F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"))
    own = F.last(shown, ignorenulls=True).over(Window.partitionBy("_span").orderBy("frame"))
    met = spans.withColumn("_own", own).join(last, "_span").withColumn("_g", F.coalesce("_own", "_earlier")).where("_g is not null")
    folded = met.groupBy("_g").agg(F.min("frame").alias("frame"), F.sum("delay_cs").alias("_d"), F.count("*").alias("frames"))
    return folded.select("frame", F.least(F.col("_d"), F.lit(MAX_DELAY).cast("long")).alias("delay_cs"), "frames")
