"""Comparing the members of buckets without gathering a bucket in one task.

A bucket with more than `block` members is dealt into blocks by hash, and
every pair of blocks is a group of its own, so a group never has more than
about two blocks; all pairs of the bucket are still compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, member: str, block: int) -> DataFrame:
    """`rows(bucket long, member, ...)` with own, lo, hi added: the member's
    block and the pair of blocks of its group.  Buckets of one are left out."""
    sizes = rows.groupBy("bucket").count().where("count > 1").withColumnsRenamed({"bucket": "__b", "count": "__n"})
    sized = rows.join(sizes, rows["bucket"] == sizes["__b"]).drop("__b")
    blocks = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    sized = sized.withColumn("__k", blocks).withColumn("own", F.pmod(F.xxhash64(member, F.lit(7)), F.col("__k")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("__k") - 1))
    return sized.select("*", met.alias("__m")).withColumn("lo", F.least("own", "__m")).withColumn("hi", F.greatest("own", "__m")).drop("__n", "__k", "__m")


def grouped(df: DataFrame, partitions: int) -> DataFrame:
    """Groups of (bucket, lo, hi) together and in order within partitions."""
    return df.repartition(partitions, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("bucket", "lo", "hi"), least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, with the starts of their groups (and the end)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        starts = cut(table)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts
            held = table.slice(last).combine_chunks().to_batches()
            rows = table.num_rows - last
        else:
            held = [x for x in table.combine_chunks().to_batches()]
            least = max(least, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held)
        yield table, np.append(cut(table), table.num_rows)


#: Nodes a forest holds before its edges are sent on.
FOREST_NODES = 500_000


class Forest:
    """Union-find over node numbers; gives a spanning forest, so that a dense
    group of n sends n-1 links on and not all of its pairs."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def flush(self, least: int = 0) -> Iterator[np.ndarray]:
        """The edges in arrays (n, 2), after which the forest is empty; none while it holds at most `least` nodes."""
        if len(self.up) <= least:
            return
        pairs = list(self.edges())
        self.up = {}
        for at in range(0, len(pairs), 50_000):
            yield np.array(pairs[at : at + 50_000], dtype=np.int64).reshape(-1, 2)

    def edges(self) -> Iterator[tuple[int, int]]:
        for x in self.up:
            if (root := self.find(x)) != x:
                yield x, root


def labels(adjacent: np.ndarray) -> np.ndarray:
    """The least index connected to each index of a symmetric boolean matrix."""
    n = len(adjacent)
    now = np.arange(n, dtype=np.int32)
    while True:
        new = np.minimum(now, np.where(adjacent, now[None, :], np.int32(n)).min(axis=1, initial=n))
        new = new[new]
        if (new == now).all():
            return now
        now = new
