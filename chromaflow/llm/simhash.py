"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles.  The 64 bits are a ring of 8 segments.  If two fingerprints differ
in at most 4 bits, some segment starts a chain in which every prefix of l
segments differs in at most l*4/8 bits (pigeonring principle, Qin and Xiao,
VLDB 2018).  Hence the first segment of the chain is equal and so is one of
the next two, two of the next four, three of the next six: a fingerprint is
keyed by each start and each such choice of equal segments, those that share a
key are candidates, candidates must pass the chain of cumulative budgets, and
only what remains gets the full Hamming check.  How many segments a key holds
grows with the number of distinct fingerprints, so buckets stay small; the
links found are all links at any depth.

Equal fingerprints are one node, nodes that link form components, and no pair
of copies is written.

Defined results: null and empty texts have fingerprint zero and link as such;
repeated rows share a component; a class whose ids are all null has a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import FOREST_NODES, Forest, deal, grouped, labels, runs
from .common import Durable, first_rows, map_arrow, salted_join, table
from .components import components

SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
SEGMENTS = 8
#: Members of a bucket that are compared in one task.
BLOCK = 1024
#: Most distinct fingerprints for keys of two and of three segments: buckets of some tens.
DEPTHS = ((2, 1 << 21), (3, 1 << 29), (4, 1 << 62))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = len(words) - shingle + 1
    hashes = np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64, count=n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """`(doc_id, fp)`; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, fp long")


def chains(depth: int) -> list[tuple[int, ...]]:
    """Offsets of the segments that may be the first `depth` equal ones of a
    chain: the k-th equal one (from 0) is at most at 2k."""
    return [(0, *rest) for rest in combinations(range(1, SEGMENTS), depth - 1) if all(at <= 2 * (k + 1) for k, at in enumerate(rest))]


def keys_of(fps: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(table, bucket) of uint64 fingerprints for every start and chain."""
    segments = fps.view(np.uint8).reshape(-1, SEGMENTS).astype(np.int64)
    for number, (start, chain) in enumerate((s, c) for s in range(SEGMENTS) for c in chains(depth)):
        key = np.zeros(len(fps), dtype=np.int64)
        for at in chain:
            key = (key << 8) | segments[:, (start + at) % SEGMENTS]
        yield number, (np.int64(number) << 32) | key


def _mask(start: int, length: int) -> np.uint64:
    return np.uint64(sum(0xFF << (8 * ((start + k) % SEGMENTS)) for k in range(length)))


def passing(x: np.ndarray, start: int, max_distance: int = MAX_DISTANCE) -> np.ndarray:
    """Which XORs pass the chain that begins at `start` and then the full check.
    Only the lengths whose budget is not implied by the next one are looked at."""
    ok = np.ones(x.shape, dtype=bool)
    for length in range(1, SEGMENTS):
        budget = length * max_distance // SEGMENTS
        if (length + 1) * max_distance // SEGMENTS == budget and length + 1 < SEGMENTS:
            continue
        ok &= np.bitwise_count(x & _mask(start, length)) <= budget
    ok[ok] = np.bitwise_count(x[ok]) <= max_distance
    return ok


def _edges(starts_per_table: int, max_distance: int):
    small = 48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for tab, cuts in runs(batches):
            fps = tab.column("fp").to_numpy()
            u = fps.view(np.uint64) if fps.flags["C_CONTIGUOUS"] else np.ascontiguousarray(fps).view(np.uint64)
            start_of = (tab.column("bucket").to_numpy() >> 32) // starts_per_table
            own, lo, hi = (tab.column(c).to_numpy() for c in ("own", "lo", "hi"))
            counts = np.diff(cuts)
            # small groups together: compare each member with the d-th after it
            group = np.repeat(np.arange(len(counts)), counts)
            left = np.repeat(cuts[1:], counts) - np.arange(len(u))  # members from here to the end of the group
            is_small = counts[group] <= small
            for d in range(1, min(small, int(counts.max(initial=1)))):
                at = np.flatnonzero((left > d) & is_small)
                if not len(at):
                    break
                x = u[at] ^ u[at + d]
                s = start_of[at]
                for start in np.unique(s):
                    pick = np.flatnonzero(s == start)
                    for i in at[pick[passing(x[pick], int(start), max_distance)]].tolist():
                        forest.join(int(fps[i]), int(fps[i + d]))
            for g in np.flatnonzero(counts > small).tolist():
                a, b = int(cuts[g]), int(cuts[g + 1])
                part = u[a:b]
                adjacent = passing(part[:, None] ^ part[None, :], int(start_of[a]), max_distance)
                if lo[a] != hi[a]:
                    adjacent &= own[a:b, None] != own[None, a:b]
                root = labels(adjacent)
                for i in np.flatnonzero(root != np.arange(b - a)).tolist():
                    forest.join(int(fps[a + i]), int(fps[a + root[i]]))
            for part in forest.flush(FOREST_NODES):
                yield pairs(part)
        for part in forest.flush():
            yield pairs(part)

    def pairs(part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])

    return run


def link_edges(distinct: DataFrame, count: int, max_distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """`distinct(fp)` to `(a, b)`: links that connect all fingerprints within
    `max_distance`, a spanning forest per task rather than every pair."""
    if not 0 <= max_distance <= 4:
        raise ValueError("max_distance must be 0 to 4")
    depth = next(d for d, most in DEPTHS if count <= most)
    spark = distinct.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.ascontiguousarray(b.column(0).to_numpy())
            for _, bucket in keys_of(fps.view(np.uint64), depth):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0)], names=["bucket", "fp"])

    rows = distinct.mapInArrow(keyed, "bucket long, fp long")
    dealt = grouped(deal(rows, "fp", block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(_edges(len(chains(depth)), max_distance), "a long, b long")


def rooted(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`fps(doc_id, fp)` to `(fp, least, n, root)`, a row a fingerprint: its least id, its rows and its class."""
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    distinct = Durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    count = distinct.read().count()
    edges = Durable(link_edges(distinct.read().select("fp"), count, max_distance))
    comps = components(edges.read()).withColumnsRenamed({"node": "fp", "component": "root"})
    return Durable(distinct.read().join(comps, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))).read()


def classes(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`fps(doc_id, fp)` to `(doc_id, fp, component_id)`."""
    linked = rooted(fps, max_distance)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    mapped = Durable(linked.join(least, "root").select("fp", "component_id"))
    out = salted_join(fps, mapped.read(), ["fp"], "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`(doc_id, fp, component_id)`, one row per input row."""
    fps = Durable(fingerprints(docs, id_col, text_col, **{k: v for k, v in options.items() if k in ("shingle", "seed")}))
    return classes(fps.read(), options.get("max_distance", MAX_DISTANCE))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, columns unchanged: that with the least id, then the
    least hash of its text.  Rows without an id stay."""
    shingle, seed = options.get("shingle", SHINGLE), options.get("seed", SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "h", "fp"])

    named = docs.where(F.col(id_col).cast("long").isNotNull())
    rows = Durable(map_arrow(named.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col)), run, "doc_id long, h long, fp long"))
    roots = rooted(rows.read().select("doc_id", "fp"), options.get("max_distance", MAX_DISTANCE)).select("fp", "root")
    found = Durable(salted_join(rows.read(), roots, ["fp"]).groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.*"))
    return first_rows(docs, found.read(), rows.read(), id_col, text_col)


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
