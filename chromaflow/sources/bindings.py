"""Rasters and colour tables read from ordinary tables, so that every operator runs on them.

E-raster: events as 10x10 frames; L-colours: lineitem as a table of colours;
V-space: embeddings as points with the means of their labels as a palette;
O-runs: orders as one line of values a customer; E-signal: events as pixels
(users) over time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("click", "error", "purchase", "signup", "view")
SIDE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_of(table(spark, sf_dir, "events"))


def raster_of(events: DataFrame) -> DataFrame:
    """px(frame, y, x, r, g, b, a, pos): level 0..3 of the value sets the channels, purchases are transparent."""
    e = events.select("event_id", "event_type", F.least(F.floor(F.col("value") / 16), F.lit(3)).cast("int").alias("v"))
    pos = F.col("event_id") % 100
    return e.select(
        F.floor(F.col("event_id") / 100).cast("int").alias("frame"),
        F.floor(pos / SIDE).cast("int").alias("y"),
        (pos % SIDE).cast("int").alias("x"),
        (F.col("v") * 60 + 20).alias("r"),
        (F.lit(200) - F.col("v") * 50).alias("g"),
        F.when(F.col("event_type") == "click", 90).otherwise(30).alias("b"),
        F.when(F.col("event_type") == "purchase", 0).otherwise(255).alias("a"),
        pos.cast("int").alias("pos"),
    )


def event_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx_px(frame, y, x, idx): the level 0..3 as a palette index."""
    px = event_raster(spark, sf_dir)
    return px.select("frame", "y", "x", F.floor((F.col("r") - 20) / 60).cast("int").alias("idx"))


def line_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (r, g, b) from quantity, discount and tax."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.floor("l_quantity") * 5).cast("int").alias("r"), (F.round(F.col("l_discount") * 100) * 25).cast("int").alias("g"), (F.round(F.col("l_tax") * 100) * 31).cast("int").alias("b"))


def line_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = line_colors(spark, sf_dir)
    return c.groupBy((F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("rgb")).agg(F.count("*").alias("n"))


def order_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px of one row of pixels: customer as x, rank of the order as frame, status as colour."""
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    level = F.when(F.col("o_orderstatus") == "F", 10).when(F.col("o_orderstatus") == "O", 20).otherwise(30)
    return o.select(rank.alias("frame"), F.lit(0).alias("y"), F.col("o_custkey").alias("x"), level.alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px of one row: user as x (and pos), rank of the event as frame, value 0..255 in all channels."""
    e = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    v = F.least(F.floor("value"), F.lit(255)).cast("int")
    return e.select(rank.alias("frame"), F.lit(0).alias("y"), F.col("user_id").alias("x"), v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"), F.col("user_id").alias("pos"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("v"), "label")
