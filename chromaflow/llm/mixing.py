"""Mixing sources to target weights.

Tokens (words) are summed per source, every source gets a target, and a
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with
probability equal to the fraction, where rate = target / size of its source.
The seed of a source is the one of a few whose draws come nearest its target.

Defined results: null text has size 0; null source is a source of its own and
comes last; a source of size 0 has target 0 and its documents are taken 0
times; repeated rows draw alike (a draw depends on the id and its source's seed only);
an empty table gives an empty result; columns named like the added ones are
replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Durable, n_words, salted_join, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED, SEEDS = 20240817, 32


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """`sources(source, source_size)` with `target` added.

    The targets are the water level L with sum(min(max_repeat*size, L*weight))
    = sum(size): with sources ordered by cap/weight, the capped ones are a
    prefix, so running sums find the level without iterating.  One row a
    source takes part, never a document."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size").cast("double") * max_repeat).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rise = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    all_ = rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    onward = rise.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    # the level of row k holds if no row from k on is above its cap: the first such row sets it
    levelled = ranked.withColumn("_level", level).withColumn("_at", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    final = F.first("_at", ignorenulls=True).over(all_)
    return levelled.withColumn("_final", final).select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final"), F.lit(float("inf"))) * F.col("_w")).alias("target"))


def uniform(key: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(seed, key), 11).cast("double") / F.lit(float(1 << 53))


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def copies_of(key: Column, seed: Column, max_repeat: int = MAX_REPEAT) -> Column:
    """floor(rate) copies and one more with probability of the fraction."""
    whole = F.floor(_rate())
    return F.least(whole + F.when(uniform(key, seed) < _rate() - whole, 1).otherwise(0), F.lit(max_repeat)).cast("long")


def source_plan(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, seeds: int = SEEDS) -> DataFrame:
    """`stats(id, source, size)` to one row a source: source, source_size, target, seed.

    Draws of a source scatter around its target; of `seeds` seeds that follow `seed`
    each source takes the one whose draws come nearest.  Sums for all seeds form in one aggregate."""
    targets = Durable(source_targets(stats.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat).coalesce(1)).read()
    drawn = salted_join(stats, targets, ["source"])
    tries = [F.sum(copies_of(F.col("id"), F.lit(seed + k), max_repeat) * F.col("size")).alias(f"t{k}") for k in range(seeds)]
    sums = drawn.groupBy("source", "source_size", "target").agg(*tries)
    miss = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("d"), F.lit(seed + k).alias("seed")) for k in range(seeds))))
    return Durable(sums.select("source", "source_size", "target", miss["seed"].alias("seed")).coalesce(1)).read()


def _stats(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size) of every row, kept so that texts are counted once."""
    return Durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))).read()


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per document: id, source, size, source_size, target, seed, copies, taken."""
    stats = _stats(docs, id_col, text_col, source_col)
    out = salted_join(stats, source_plan(stats, weights, max_repeat, seed), ["source"])
    out = out.withColumn("copies", copies_of(F.col("id"), F.col("seed"), max_repeat))
    return out.withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("id", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document as often as the plan takes it, columns unchanged.
    Texts are joined to one row a source and not shuffled while those may be broadcast."""
    plan = source_plan(_stats(docs, id_col, text_col, source_col), weights, max_repeat, seed)
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    joined = salted_join(held, plan, ["source"]).withColumn("copies", copies_of(F.col("id"), F.col("seed"), max_repeat))
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
