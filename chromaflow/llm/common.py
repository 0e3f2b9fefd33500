"""Helpers the training-data operators share: table access, durable
intermediate tables, arrow mapping and bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast; callers count first and join by shuffle beyond it.
BROADCAST_ROWS = 50_000
#: Places of a key in a sieve, bits a key and most bits of all (64 MB).
SIEVE_PLACES, SIEVE_RATE, SIEVE_BITS = 4, 16, 1 << 29

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a fresh local one only where it is unset in local mode (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chromaflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Spark's own readers see them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target, files = hadoop_path(spark, path)
        files.delete(target, True)
    except Exception:  # the session may already be gone
        pass


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc() is not None:
            _delete(spark, path)


class Durable:
    """A written intermediate table: survives lost executors, has no lineage,
    and can be dropped before the session ends."""

    def __init__(self, df: DataFrame, partitions_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/chromaflow-{uuid.uuid4().hex}"
        self.schema = df.schema
        out = df.write
        if partitions_by:
            out = out.partitionBy(*partitions_by)
        out.parquet(self.path)
        _written.append((self.spark, self.path))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def durable(df: DataFrame) -> DataFrame:
    return Durable(df).read()


@contextmanager
def scratch() -> Iterator[list[Durable]]:
    """Intermediate tables written inside are dropped at its end, but for those added to the list it gives."""
    start = len(_written)
    keep: list[Durable] = []
    yield keep
    paths = {d.path for d in keep}
    for spark, path in _written[start:]:
        if path not in paths:
            _delete(spark, path)


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts travel to Python in batches of this many rows, so that a batch of long texts fits."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def map_arrow(df: DataFrame, fn: Callable, schema: str, rows: int = 512) -> DataFrame:
    arrow_rows(df.sparkSession, rows)
    return df.mapInArrow(fn, schema)


def crc(col: str | Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sieve(keys: DataFrame, count: int) -> Callable[[Column], Column]:
    """A Bloom filter of the hashes `keys(key long)`, `count` of them: tells of a column of hashes which may be among them.

    None that is among them is left out; of others about one in 400 passes, more
    beyond SIEVE_BITS, so callers look up exactly what passes."""
    bits = 1 << max(15, (min(SIEVE_BITS, SIEVE_RATE * max(1, count)) - 1).bit_length())

    def places(keys: np.ndarray) -> np.ndarray:
        u = keys.astype(np.int64).view(np.uint64)
        step = (u & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return (((u >> np.uint64(32))[:, None] + step[:, None] * np.arange(SIEVE_PLACES, dtype=np.uint64)) & np.uint64(bits - 1)).view(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(b.column(0).to_numpy()).ravel() + 1)], names=["place"])

    parts = keys.select("key").mapInArrow(spread, "place long").groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("held"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for part, held in parts.collect():
        table[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, dtype=np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_hold(key: pd.Series) -> pd.Series:
        at = places(key.to_numpy())
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1))

    return may_hold


def first_rows(docs: DataFrame, first: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` named by `first(doc_id, h)`, h being xxhash64 of the text, and those without an id.

    rows(doc_id, h, ...): all rows with an id.  Texts move only to settle the rarer
    case: where most rows stay, those that a sieve of the others (and of rows that
    repeat as a whole) lets pass, else those that a sieve of the rows that stay does."""
    stay = first.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    counted = rows.groupBy("doc_id", "h").count()
    joined = counted.join(stay, (counted["doc_id"] == stay["__id"]) & (counted["h"] == stay["__h"]), "left")
    held = Durable(joined.select("doc_id", "h", F.xxhash64("doc_id", "h").alias("key"), F.col("__id").isNotNull().alias("stays"), (F.col("count") > 1).alias("again")))
    sure = F.col("stays") & ~F.col("again")
    n_sure, n_other, n_again, n_stay = held.read().agg(*(F.count_if(c) for c in (sure, ~sure, F.col("stays") & F.col("again"), F.col("stays")))).first()
    named = docs.where(F.col(id_col).cast("long").isNotNull())
    nameless = docs.where(F.col(id_col).cast("long").isNull())
    key = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col))
    if n_other <= n_sure:
        doubtful = sieve(held.read().where(~sure), n_other)
        out, asked = named.where(~doubtful(key)).unionByName(nameless), named.where(doubtful(key))
    else:
        out, asked = nameless, named.where(sieve(held.read().where("stays"), n_stay)(key))
    wanted = held.read().select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "stays", "again").where("stays")
    on = [asked[id_col].cast("long") == F.col("__id"), F.xxhash64(asked[text_col]) == F.col("__h")]
    out = out.unionByName(asked.join(wanted.where("not again"), on, "left_semi"))
    if not n_again:
        return out
    many = asked.join(wanted.where("again"), on, "left_semi").withColumn("__h", F.xxhash64(text_col)).dropDuplicates([id_col, "__h"]).drop("__h")
    return out.unionByName(many)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 8, weight: Column | None = None) -> DataFrame:
    """Null-safe join to a right side that has one row a key.  A right side
    counted at BROADCAST_ROWS or less is broadcast; a larger one is replicated
    to `salts` salts and shuffled, so no hot key meets in one task.  Rows that
    hold lists count as their `weight`."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    rows = right.limit(BROADCAST_ROWS + 1).count() if weight is None else right.agg(F.coalesce(F.sum(F.greatest(weight, F.lit(1))), F.lit(0))).first()[0]
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(r), on, how).drop(*[f"__r_{k}" for k in keys])
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*([c for c in left.columns if c not in keys][:2] or keys)), F.lit(salts)).cast("int"))
    r = r.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [left["__salt"] == r["__r_salt"]] + [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    return left.join(r, on, how).drop("__salt", "__r_salt", *[f"__r_{k}" for k in keys])
