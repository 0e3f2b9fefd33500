"""Connected components over edges that never leave the executors.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014), written with aggregates and
equi joins: no list of neighbours is gathered, so a hub is one skewed key of a
join that Spark can split.  Every round is written out, which cuts lineage.
At most IN_TASK edges, counted first, are solved in one task instead, whose
memory that number bounds; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Durable

#: Edges that one task solves: some 100 MB.
IN_TASK = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), ascending, and the least node reachable from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        least = np.minimum(root[u], root[v])
        new = root.copy()
        for top in (root[u], root[v]):  # a root moves under the least that its edges offer; they stay until both ends agree
            np.minimum.at(new, top, least)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            break
        root = new
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, least = least_reachable(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000]), pa.array(least[at : at + 50_000])], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "k")
    return both.join(least, both["a"] == least["k"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = down.join(least, down["a"] == least["k"])
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60, in_task: int = IN_TASK) -> DataFrame:
    """`edges(a long, b long)` to `(node, component)`, component being the least
    node reachable.  Nodes without an edge are not listed.  Loops and repeated
    edges are allowed; no edges give no rows."""
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = Durable(start)
    mark = _mark(now.read())
    if mark[0] <= in_task:
        return now.read().coalesce(1).mapInArrow(_in_task, "node long, component long")
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        after = Durable(_small_star(_large_star(now.read())).distinct())
        now.drop()
        now, seen = after, _mark(after.read())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    stars = now.read()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
