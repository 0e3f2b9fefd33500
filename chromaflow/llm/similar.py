"""Near copies for the corpus: SimHash links, and the similarity that 64 bits cannot tell.

A text is the XXH64 values of its runs of SHINGLE words.  Two texts link if
their SimHash fingerprints differ in at most 4 bits, found by pigeonring
filtering (`simhash.link_edges`), or if the Jaccard similarity of their sets of
values is `least` or more.  At a similarity of 0.8 fingerprints differ in about
ten bits of 64, where no chain of equal segments is left to filter by, so the
second rule has candidates of its own: texts that agree in a band of ROWS of
BANDS * ROWS minimum values (a pair of similarity 0.8 is missed with a chance
of 0.0003, one of 0.9 with less than 1e-7), whose sets are compared exactly.
Equal texts (but for case and white space) are one node, so copies are never
paired; bands with the same members are compared once, large ones in blocks.

Defined results: null and empty texts are copies of each other; rows without
an id stay and link nothing; of a group the row with the least id stays, then
the least hash of its text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import FOREST_NODES, Forest, deal, grouped, runs
from .common import Durable, first_rows, map_arrow, scratch, sieve
from .components import components
from .simhash import link_edges, majority

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 16, 4
#: Members of a band that are compared in one task.
BLOCK = 512

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def node_of(words: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(words), SEED)


def values_of(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The values of all runs of words; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    n = max(1, len(words) - shingle + 1)
    return np.fromiter([xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(n)], dtype=np.uint64, count=n)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct values, in order."""
    return np.unique(values_of(words, shingle))


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band of a set."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(values), 4096):
        np.minimum(least, (values[None, at : at + 4096] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    mixed = least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(31))
    return (mixed * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], least: float = LEAST) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of at least that similarity: each set
    reached is compared with those not reached yet."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    parts = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    flag = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    rest = np.arange(len(sets))
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        flat = None
        while todo and len(rest):
            i = todo.pop()
            if flat is None:
                flat = np.concatenate([parts[r] for r in rest.tolist()])
                starts = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
            flag[parts[i]] = 1
            both = np.add.reduceat(flag[flat], starts)
            flag[parts[i]] = 0
            near = both >= least * (sizes[i] + sizes[rest] - both)
            if near.any():
                for j in rest[near].tolist():
                    yield i, j
                    todo.append(j)
                rest, flat = rest[~near], None


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [words_of(t) for t in b.column(2).to_pylist()]
        nodes = np.array([node_of(w) for w in texts], dtype=np.uint64).view(np.int64)
        values = [values_of(w) for w in texts]
        fps = np.array([majority(v) if w else 0 for w, v in zip(texts, values, strict=True)], dtype=np.uint64).view(np.int64)
        keys = pa.array([bands(v).tolist() for v in values], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array(fps), keys], names=["doc_id", "h", "node", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [words_of(t) for t in b.column(0).to_pylist()]
        nodes = np.array([node_of(w) for w in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([shingles(w).tobytes() for w in texts], pa.binary())], names=["node", "held"])


def _links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for tab, cuts in runs(batches, least=2000):
            nodes, held = tab.column("node").to_pylist(), tab.column("held")
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = [np.frombuffer(v, np.uint64) for v in held.slice(a, b - a).to_pylist()]
                for i, j in linked(sets, least):
                    forest.join(nodes[a + i], nodes[a + j])
            for part in forest.flush(FOREST_NODES):
                yield pairs(part)
        for part in forest.flush():
            yield pairs(part)

    def pairs(part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])

    return run


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """`nodes(node, first, bands)` to `(a, b)`: links that connect all similar nodes."""
    spark = docs.sparkSession
    rows = nodes.select("node", "first", F.explode("bands").alias("bucket"))
    # buckets of the same members are compared once
    same = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)) % (1 << 40)).alias("s")).where("n > 1")
    once = same.groupBy("n", "x", "s").agg(F.min("bucket").alias("__bucket"))
    members = Durable(rows.join(once, rows["bucket"] == once["__bucket"]).select("bucket", "node", "first"))
    first = members.read().select(F.xxhash64("first").alias("key")).distinct()
    # texts that pass by chance have no member to meet
    wanted = docs.where(sieve(first, first.count())(F.xxhash64(docs[id_col].cast("long"))))
    sets = Durable(map_arrow(wanted.select(F.col(text_col)), _sets, "node long, held binary"))
    dealt = deal(members.read().select("bucket", "node"), "node", BLOCK)
    held = sets.read().dropDuplicates(["node"]).withColumnRenamed("node", "__node")
    full = dealt.join(held, dealt["node"] == held["__node"]).drop("__node")
    return grouped(full, int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_links(least), "a long, b long")


def simhash_links(nodes: DataFrame) -> DataFrame:
    """`nodes(node, fp)` to `(a, b)`: every node whose fingerprint others have or link to
    is tied to it, and linked fingerprints to each other; a fingerprint is a node by its hash."""
    fps = Durable(nodes.groupBy("fp").agg(F.count("*").alias("n")))
    near = Durable(link_edges(fps.read().select("fp"), fps.read().count()))
    met = near.read().select(F.col("a").alias("__fp")).unionByName(near.read().select(F.col("b").alias("__fp"))).unionByName(fps.read().where("n > 1").select(F.col("fp").alias("__fp"))).distinct()
    tied = nodes.join(met, nodes["fp"] == met["__fp"], "left_semi").select(F.col("node").alias("a"), F.xxhash64("fp", F.lit(SEED)).alias("b"))
    return tied.unionByName(near.read().select(F.xxhash64("a", F.lit(SEED)).alias("a"), F.xxhash64("b", F.lit(SEED)).alias("b")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row of each group, columns unchanged."""
    named = docs.where(F.col(id_col).cast("long").isNotNull())
    picked = named.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col))
    with scratch() as kept:
        rows = Durable(map_arrow(picked, _nodes, "doc_id long, h long, node long, fp long, bands array<long>"))
        nodes = Durable(rows.read().groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
        near = Durable(simhash_links(nodes.read().select("node", "fp")))
        edges = Durable(links(named, nodes.read().drop("fp", "row"), id_col, text_col, least).unionByName(near.read()))
        comps = components(edges.read()).withColumnsRenamed({"node": "__node", "component": "__root"})
        held = nodes.read().select("node", "row")
        first = Durable(held.join(comps, held["node"] == comps["__node"], "left").groupBy(F.coalesce("__root", "node").alias("root")).agg(F.min("row").alias("row")).select("row.*"))
        kept += [rows, first]
    out = first_rows(docs, first.read(), rows.read().select("doc_id", "h"), id_col, text_col)
    rows.drop()
    first.drop()
    return out
