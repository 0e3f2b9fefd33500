"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are one class first.  Several two-level spherical k-means
clusterings, fitted on a bounded sample with different seeds, each assign
every vector to one cell; vectors are compared in blocks within every cell
they share, in double precision.  A pair that shares cells of more than one
clustering is counted in the first.  One clustering misses a near pair only if
a cell border runs between the two, so all of them miss it with the product of
small chances (the recall is measured by the tests against all pairs).  Cells
keep about CELL vectors as the table grows, so work stays in proportion to it.

Defined results: vectors that are null, zero, or hold a null or non-finite
component link with nothing, and neither do rows with a null id; vectors of
different lengths do not link; equal vectors link; repeated rows are separate
vectors that link; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import FOREST_NODES, Forest, deal, grouped, labels, runs
from .common import Durable, salted_join, table
from .components import components

THRESHOLD = 0.95
#: Clusterings, vectors a cell holds about, rows the centroids are fitted on, most cells of a clustering.
TABLES, CELL, SAMPLE, MAX_CELLS = 12, 256, 20_000, 1 << 16
BLOCK = 512


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most k unit centroids of unit vectors."""
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def fit_cells(sample: np.ndarray, n: int, tables: int, cell: int, seed: int = 11) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each clustering: upper centroids, and lower ones under each."""
    wanted = min(MAX_CELLS, max(1, n // cell))
    upper = max(1, int(round(wanted**0.5)))
    lower = max(1, -(-wanted // upper))
    fitted = []
    for t in range(tables):
        rng = np.random.default_rng(seed + t)
        top = spherical_kmeans(sample, upper, rng)
        at = (sample @ top.T).argmax(axis=1)
        below = []
        for k in range(len(top)):
            own = sample[at == k]
            below.append(spherical_kmeans(own, lower, rng) if len(own) else top[k : k + 1])
        fitted.append((top, below))
    return fitted


def assign(x: np.ndarray, fitted: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
    """Cell numbers of unit vectors."""
    top, below = fitted
    at = (x @ top.T).argmax(axis=1)
    out = np.zeros(len(x), dtype=np.int64)
    for k in np.unique(at):
        own = at == k
        out[own] = (k << 20) + (x[own] @ below[k].T).argmax(axis=1)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _compare(dim: int, tables: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        ids: list[np.ndarray] = []
        links: list[np.ndarray] = []
        for tab, cuts in runs(batches, least=4096):
            x = unit(_matrix(tab.column("v"), dim))
            cls, copies, own = (tab.column(c).to_numpy() for c in ("cls", "copies", "own"))
            cells = tab.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, tables)
            number, lo, hi = (tab.column(c).to_numpy() for c in ("number", "lo", "hi"))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                near = x[a:b] @ x[a:b].T >= threshold
                np.fill_diagonal(near, False)
                if lo[a] != hi[a]:
                    near &= own[a:b, None] != own[None, a:b]
                if not near.any():
                    continue
                root = labels(near)
                for i in np.flatnonzero(root != np.arange(b - a)).tolist():
                    forest.join(int(cls[a + i]), int(cls[a + root[i]]))
                for t in range(int(number[a])):  # counted where an earlier clustering has both in one cell
                    i, j = np.nonzero(near)
                    near[i, j] = cells[a + i, t] != cells[a + j, t]
                found = near @ copies[a:b].astype(np.float64)
                at = np.flatnonzero(found)
                ids.append(cls[a:b][at])
                links.append(found[at].astype(np.int64))
            if ids:
                one, at = np.unique(np.concatenate(ids), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate(links)).astype(np.int64)
                yield rows(0, one, total)
                ids, links = [], []
            for pairs in forest.flush(FOREST_NODES):
                yield rows(1, pairs[:, 0], pairs[:, 1])
        for pairs in forest.flush():
            yield rows(1, pairs[:, 0], pairs[:, 1])

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, cell: int = CELL, sample_rows: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    # adding 0.0 makes -0.0 and 0.0 one value
    valid = rows.where(good & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda e: e + 0.0))
    # a class is a set of equal vectors, numbered by a hash of the vector's digest: an id may have several
    keyed = valid.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda e: F.hex(e.cast("string"))), ","), 256))
    ids = Durable(keyed.select("vec_id", F.col("key")))
    classes = ids.read().groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("cls", F.xxhash64("key"))
    first = Durable(keyed.select("vec_id", "v", F.col("key").alias("k")).join(classes.withColumnRenamed("key", "c"), (F.col("k") == F.col("c")) & (F.col("vec_id") == F.col("least"))).select("cls", "copies", "v").dropDuplicates(["cls"]))
    dims = [r[0] for r in first.read().select(F.size("v")).distinct().collect()]
    found = None
    for dim in dims:
        own = first.read().where(F.size("v") == dim)
        n = own.count()
        share = min(1.0, 1.2 * sample_rows / max(n, 1))
        picked = own.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("cls"), "cls").select("v").limit(sample_rows).toPandas()
        if picked.empty:
            continue
        fitted = spark.sparkContext.broadcast(fit_cells(unit(np.stack(picked["v"].to_numpy())), n, tables, cell))

        def spread(batches: Iterator[pa.RecordBatch], fitted=fitted, dim=dim) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = unit(_matrix(b.column(2), dim))
                cells = np.stack([assign(x, f) for f in fitted.value], axis=1)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(cells.ravel()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << 48) + cells[:, t]), pa.array(np.full(len(x), t, dtype=np.int32)), b.column(0), b.column(1), b.column(2), held], names=["bucket", "number", "cls", "copies", "v", "cells"])

        cells = own.mapInArrow(spread, "bucket long, number int, cls long, copies long, v array<double>, cells array<long>")
        dealt = grouped(deal(cells, "cls", block), int(spark.conf.get("spark.sql.shuffle.partitions")))
        part = dealt.mapInArrow(_compare(dim, tables, threshold), "kind int, a long, b long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = Durable(found)
    links = found.read().where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    comps = components(found.read().where("kind = 1").select("a", "b"))
    members = Durable(classes.select("cls", "least").join(comps.withColumnRenamed("node", "cls"), "cls"))
    leasts = members.read().groupBy("component").agg(F.min("least").alias("component_id"))
    linked = members.read().join(leasts, "component").select("cls", "component_id")
    classed = classes.join(links.withColumnRenamed("a", "cls"), "cls", "left").join(linked, "cls", "left").where("copies > 1 or links > 0 or component_id is not null")
    per_class = Durable(classed.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    linked = salted_join(ids.read(), per_class.read(), ["key"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    rest = rows.where(~F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_kmeans_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""
