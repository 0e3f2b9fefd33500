"""Quartile bucket digests of whole texts.

Hashed byte triplets (three choices of positions in a sliding window of five
bytes) are counted in buckets.  Each bucket is written as the quartile its
count falls in, two bits a bucket, after a code of the length.  Two digests
are compared bucket by bucket: the difference of two quartile codes, 0 to 3,
adds to a score, a far pair (0 against 3) adds double, and the difference of
the length codes adds up to a bound.  Likeness is 1 - score / largest score.

Defined results: a null text counts as empty; texts too short for a triplet
have all-zero quartiles; equal texts have equal digests; rows that repeat an id
are ordered by their text; a null id comes last; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, map_arrow, table

BUCKETS = 64
#: Offsets of the second and third byte of a triplet.
TRIPLETS = ((1, 2), (1, 3), (2, 4))
LENGTH_BOUND = 24
FAR = 6
#: Rows of a range of ids, while there are at most MAX_RANGES ranges.
RANGE_ROWS, MAX_RANGES = 1000, 20_000


def digest(data: bytes, buckets: int = BUCKETS) -> str:
    """Hex digits: two for the length code, then two bits for each bucket."""
    a = np.frombuffer(data, dtype=np.uint8)
    counts = np.zeros(buckets, dtype=np.int64)
    for start in range(0, len(a), 1 << 20):  # a window reaches four bytes into the next part
        part = a[start : start + (1 << 20) + 4].astype(np.uint32)
        for number, (i, j) in enumerate(TRIPLETS):
            n = min(len(part) - j, 1 << 20)
            if n <= 0:
                continue
            key = (part[:n] | (part[i : i + n] << np.uint32(8)) | (part[j : j + n] << np.uint32(16))) + np.uint32(number << 24)
            key *= np.uint32(2654435761)
            key ^= key >> np.uint32(15)
            key *= np.uint32(2246822519)
            counts += np.bincount(key >> np.uint32(24), minlength=256)[:256].reshape(buckets, -1).sum(axis=1)
    length = min(255, int(round(16 * np.log2(len(a) + 1)))) if len(a) else 0
    if counts.any():
        q1, q2, q3 = np.partition(counts, [buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1])[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
        codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    else:
        codes = np.zeros(buckets, dtype=np.uint8)
    four = codes.reshape(-1, 4)
    return bytes([length]).hex() + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes().hex()


@lru_cache(maxsize=1)
def _differences() -> np.ndarray:
    """Score of two bytes of four codes each."""
    codes = np.array([[x >> s & 3 for s in (6, 4, 2, 0)] for x in range(256)])
    d = np.abs(codes[:, None, :] - codes[None, :, :])
    return np.where(d == 3, FAR, d).sum(axis=2)


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most FAR * buckets + LENGTH_BOUND."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    return int(_differences()[x[1:], y[1:]].sum()) + min(LENGTH_BOUND, abs(int(x[0]) - int(y[0])))


def likeness(a: str, b: str) -> float:
    """1 for equal digests; 0 at half of the largest difference, which unrelated bytes stay below, and beyond."""
    buckets = (len(a) - 2) * 2
    return max(0.0, 1.0 - difference(a, b) / (buckets * 1.5 + LENGTH_BOUND))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, fingerprint)` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(ids: DataFrame) -> tuple[list[int], list[tuple[int, int]]]:
    """Upper bounds of the ranges of `rank`, and (range, least rank) of those that have rows."""
    total = ids.count()
    parts = min(MAX_RANGES, max(1, total // RANGE_ROWS))
    cuts: list[int] = []
    if parts > 1:
        share = [(k + 1) / parts for k in range(parts - 1)]
        cuts = sorted(set(ids.agg(F.percentile_approx("rank", share, max(10_000, 4 * parts))).first()[0]))
    least = ids.select("rank", _range_of(cuts)("rank").alias("part")).groupBy("part").agg(F.min("rank").alias("least"))
    return cuts, sorted((r["part"], r["least"]) for r in least.collect())


def _range_of(cuts: list[int]):
    edges = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def part(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, rank.to_numpy(), side="left").astype(np.int32))

    return part


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text, of its edited text and of the next text by
    descending id (after the last comes the first).  The edited text has its
    last n div 2 code points replaced by the first as many, or all, of the next.

    Ids are dealt into ranges of about RANGE_ROWS rows.  The first row of a
    range is sent to the range before it as well, where it follows the last
    row (the first of all to the last range).  So a text is shuffled once, and
    one row a range twice; the bounds of the ranges, at most MAX_RANGES,
    pass through the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # descending ids are ascending ranks; null ids come last
    rows = rows.withColumn("rank", F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)
    cuts, least = _ranges(rows.select("rank"))
    before = {first: least[k - 1][0] for k, (_, first) in enumerate(least)}
    firsts = np.array(sorted(before), dtype=np.int64)
    goes = np.array([before[f] for f in firsts.tolist()], dtype=np.int32)

    @F.pandas_udf("int")
    def also(rank: pd.Series) -> pd.Series:
        values = rank.to_numpy()
        at = np.minimum(np.searchsorted(firsts, values), len(firsts) - 1)
        return pd.Series(np.where(firsts[at] == values, goes[at], -1).astype(np.int32))

    placed = rows.withColumns({"part": _range_of(cuts)("rank"), "also": also("rank")})
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("role"))
    there = F.struct(F.col("also").alias("part"), F.lit(1).alias("role"))
    sent = placed.select("doc_id", "text", "rank", F.explode(F.when(F.col("also") >= 0, F.array(here, there)).otherwise(F.array(here))).alias("to"))
    flat = sent.select(F.col("to.part").alias("part"), F.col("to.role").alias("role"), "doc_id", "rank", "text")
    ordered = flat.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "role", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # range, id, text, fingerprint of the row that waits for the next
        out: list[tuple] = []

        def pair(text: str, print_: str, next_text: str, next_print: str) -> tuple:
            half = len(text) // 2
            edited = (text[: len(text) - half] + next_text[:half]).encode("utf-8", "surrogatepass")
            edited_print = digest(edited)
            return len(text), hashlib.sha256(edited).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)

        for b in batches:
            for part, role, doc_id, text in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                if role and held is None:
                    continue  # the first row of another range that repeats
                print_ = digest(text.encode("utf-8", "surrogatepass"))
                if held is not None:
                    out.append((held[1], *pair(held[2], held[3], text, print_)))
                held = None if role else (part, doc_id, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_SCHEMA)
                out = []

    arrow_rows(spark)
    return ordered.mapInArrow(run, OUT)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def op4_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))
