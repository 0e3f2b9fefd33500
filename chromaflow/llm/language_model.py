"""Language-model scores from a log-frequency Bloom filter.

Texts are split into words of ASCII white space, ASCII letters lowered, with
one end token a text.  Documents are coded in blocks: a block holds its texts
as indexes into its own vocabulary, written once and used by every later pass.

Unigram counts are exact: each block sends the hashes and training counts of
its vocabulary to shards by hash, where they are added up and sent back.
Bigram counts are added up in shards too; those of `min_count` and more are
quantised by powers of BASE and put into a Bloom filter as the keys (bigram,
1), ..., (bigram, q) (Talbot and Osborne, ACL 2007), BITS_A_KEY bits a key, a
range of bits for each shard.  A count is read by probing for level after
level until one is missing.  A filter of at most `max_filter_mb` is broadcast.
A larger one stays in its shards: blocks send the bigrams they hold to them
and get the levels back.  The bits are the same, so scores do not depend on
the way.

P(w|v) = alpha * c(vw) / c(v) + (1 - kappa) * (c(w) + 1) / (N + V + 1).
kappa is, for contexts of about v's frequency, the share of training tokens
whose bigram would still be known if the token were left out; alpha scales the
kept bigrams to that share.  The context of a first word is the end token.

Defined results: null and empty texts are the end token alone; repeated rows
are learnt from as often as they stand; rows with a null id follow `learn`
(false where it is null); without training texts every base probability is 1
and the counts are 0; an empty table gives an empty result; other columns are
ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Durable, arrow_rows, crc, map_arrow, table

#: Tokens of a block.
BLOCK_TOKENS = 300_000
#: Tokens that are scored at a time.
PART_TOKENS = 100_000
BASE, MIN_COUNT, HASHES, BITS_A_KEY, MAX_FILTER_MB = 1.5, 2, 5, 12, 256
#: Entries of a shard, about; shards grow in number with the input.
SHARD_ENTRIES = 1_000_000
BUCKETS, LEVELS, GRAM_BITS = 40, 64, 44
END = np.uint64(0)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def trim() -> None:
    """Gives memory that large blocks have left behind back to the system, where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def pack(**arrays) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> dict:
    return pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def small(x: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the narrowest type."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def encode_blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of blocks: block, texts (packed), hashes and training counts of its vocabulary, training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        base, number = TaskContext.get().partitionId() << 24, 0

        def fresh():
            vocab: defaultdict[bytes, int] = defaultdict()
            vocab.default_factory = vocab.__len__
            vocab[b" "]  # no word holds a space: the end token
            return vocab, [], [], [], 0

        vocab, ids, learnt, coded, tokens = fresh()

        def block() -> pa.RecordBatch:
            hashes = np.fromiter((xxh64_intdigest(w) or 1 for w in vocab), dtype=np.uint64, count=len(vocab))
            hashes[0] = END
            sizes = np.array([len(c) for c in coded])
            flat = np.concatenate(coded)
            flags = np.array(learnt, dtype=bool)
            counts = np.bincount(flat[np.repeat(flags, sizes)], minlength=len(vocab))
            texts = pack(ids=np.array([i or 0 for i in ids], dtype=np.int64), null=np.array([i is None for i in ids]), learnt=flags, sizes=small(sizes), flat=small(flat))
            return pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([texts], pa.binary()), pa.array([hashes.tobytes()], pa.binary()), pa.array([pack(c=small(counts))], pa.binary()), pa.array([int(counts.sum())]), pa.array([len(vocab)])], names=["block", "texts", "hashes", "counts", "train", "words"])

        for b in batches:
            for i, text, use in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                code = np.fromiter(map(vocab.__getitem__, words), dtype=np.uint32, count=len(words))
                coded.append(np.append(code, np.uint32(0)))
                ids.append(i)
                learnt.append(bool(use))
                tokens += len(words) + 1
                if tokens >= block_tokens:
                    yield block()
                    trim()
                    number += 1
                    vocab, ids, learnt, coded, tokens = fresh()
        if ids:
            yield block()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), learn.alias("learn"))
    return map_arrow(picked, run, "block long, texts binary, hashes binary, counts binary, train long, words long")


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(shards)).astype(np.int64)


def _cut(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard, and the starts of the shards in it."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def count_unigrams(blocks: DataFrame, shards: int) -> DataFrame:
    """`(block, shard, counts, distinct)`: total training counts of a block's words
    in the order of the shard; distinct: words of the shard that training texts hold."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            for number, raw, packed in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                hashes, counts = np.frombuffer(raw, dtype=np.uint64), unpack(packed)["c"]
                order, starts = _cut(shard_of(hashes, shards), shards)
                parts = [(s, order[a:z]) for s, (a, z) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([number] * len(parts)), pa.array([hashes[o].tobytes() for _, o in parts], pa.binary()), pa.array([pack(c=counts[o]) for _, o in parts], pa.binary())], names=["shard", "block", "hashes", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        trim()
        rows = rows.sort_values("block")
        hashes = [np.frombuffer(h, dtype=np.uint64) for h in rows["hashes"]]
        one, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack(c)["c"] for c in rows["counts"]]).astype(np.float64), minlength=len(one)).astype(np.int64)
        back = np.split(total[at], np.cumsum([len(h) for h in hashes])[:-1])
        distinct = np.zeros(len(rows), dtype=np.int64)
        distinct[0] = int((total > 0).sum())
        return pd.DataFrame({"block": rows["block"].to_numpy(), "shard": rows["shard"].to_numpy(), "counts": [pack(c=small(x)) for x in back], "distinct": distinct})

    sent = blocks.select("block", "hashes", "counts").mapInArrow(send, "shard int, block long, hashes binary, counts binary")
    return sent.groupBy("shard").applyInPandas(add, "block long, shard int, counts binary, distinct long")


def totals(hashes: np.ndarray, parts: list[bytes], shards: int) -> np.ndarray:
    """A block's total counts in the order of its vocabulary, from those of its shards in turn."""
    out = np.zeros(len(hashes), dtype=np.int64)
    out[_cut(shard_of(hashes, shards), shards)[0]] = np.concatenate([unpack(p)["c"].astype(np.int64) for p in parts])
    return out


def bigrams(flat: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GRAM_BITS-bit hashes of (word before, word) for every token, and the indexes of the words before."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(sizes) - sizes] = 0
    with np.errstate(over="ignore"):
        return mix(hashes[before] * _MIX[0] + mix(hashes[flat])) >> np.uint64(64 - GRAM_BITS), before


def gram_shard(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so ascending hashes are in the order of shards."""
    return (grams * np.uint64(shards)) >> np.uint64(GRAM_BITS)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Frequency classes of contexts: two to the octave."""
    return np.minimum((2 * np.log2(np.maximum(count, 1))).astype(np.int64), BUCKETS - 1)


def level_of(count: np.ndarray, least: float) -> np.ndarray:
    """Levels a count takes in the filter: 0 below `least`."""
    q = 1 + np.floor(np.log(np.maximum(count, 1) / least) / np.log(BASE) + 1e-9).astype(np.int64)
    return np.where(count >= least, q, 0)


def value_of(level: np.ndarray, least: float) -> np.ndarray:
    """The least count of a level."""
    return np.where(level > 0, np.ceil(least * BASE ** (level - 1.0) - 1e-9), 0.0)


def _ascending(grams: np.ndarray) -> dict:
    """Ascending hashes as the first and the differences."""
    return {"first": grams[:1], "gaps": small(np.diff(grams))}


def _grams(p: dict) -> np.ndarray:
    return np.cumsum(np.concatenate([p["first"], p["gaps"].astype(np.uint64)]), dtype=np.uint64)


def count_bigrams(full: DataFrame, words_in: int, shards: int, min_count: int) -> DataFrame:
    """`(shard, grams, tokens, table)`: bigrams of min_count and more with their counts;
    training tokens by class of the context; and bigrams by class and level.  Words are in `words_in` shards, bigrams in `shards`."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            for packed, raw, counted in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                t, hashes = unpack(packed), np.frombuffer(raw, dtype=np.uint64)
                total = totals(hashes, counted, words_in)
                sizes = t["sizes"].astype(np.int64)
                grams, before = bigrams(t["flat"].astype(np.int64), sizes, hashes)
                use = np.repeat(t["learnt"], sizes)
                if not use.any():
                    continue
                one, at, n = np.unique(grams[use], return_index=True, return_counts=True)
                bucket = bucket_of(total[before[use][at]].astype(np.float64)).astype(np.uint8)
                starts = np.searchsorted(gram_shard(one, shards), np.arange(shards + 1))
                parts = [(s, pack(**_ascending(one[a:z]), n=small(n[a:z]), b=bucket[a:z])) for s, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["shard", "grams"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        trim()
        parts = [unpack(p) for p in rows["grams"]]
        grams = np.concatenate([_grams(p) for p in parts])
        n = np.concatenate([p["n"].astype(np.int64) for p in parts])
        b = np.concatenate([p["b"] for p in parts])
        order = np.argsort(grams, kind="stable")
        grams, n, b = grams[order], n[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        total, grams, b = np.add.reduceat(n, first), grams[first], b[first]
        tokens = np.bincount(b, weights=total.astype(np.float64), minlength=BUCKETS)
        keep = total >= min_count
        grams, total, b = grams[keep], total[keep], b[keep]
        by = np.zeros((BUCKETS, LEVELS), dtype=np.int64)
        np.add.at(by, (b, np.minimum(level_of(total, min_count), LEVELS - 1)), 1)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "grams": [pack(**_ascending(grams), n=small(total)) if len(grams) else b""], "tokens": [tokens.tobytes()], "by": [by.tobytes()]})

    sent = full.select("texts", "hashes", "parts").mapInArrow(send, "shard int, grams binary")
    return sent.groupBy("shard").applyInPandas(add, "shard int, grams binary, tokens binary, by binary")


def places(grams: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """The bits of (gram, level) within a shard's range."""
    with np.errstate(over="ignore"):
        h = mix(grams + np.uint64(level) * _MIX[0])
        step = mix(h ^ _MIX[2]) | np.uint64(1)
        for i in range(HASHES):
            yield ((h + np.uint64(i) * step) >> np.uint64(11)) % np.uint64(size)


def build_range(grams: np.ndarray, levels: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in places(grams[levels >= level], level, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """The shards' bits from shard `first` on: `size` bits for each, after one another."""

    def __init__(self, bits: np.ndarray, shards: int, size: int, least: float, first: int = 0):
        self.bits, self.shards, self.size, self.least, self.first = bits, shards, size, least, first

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level read for each gram: probes go on until one misses."""
        out = np.zeros(len(grams), dtype=np.int64)
        if not self.size:
            return out
        alive, level = np.arange(len(grams)), 0
        while len(alive) and level < LEVELS:
            level += 1
            own = grams[alive]
            start = (gram_shard(own, self.shards) - np.uint64(self.first)) * np.uint64(self.size)
            hit = np.arange(len(alive))
            for at in places(own, level, self.size):
                at = at[hit] + start[hit]
                here = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                hit = hit[here == 1]
                if not len(hit):
                    break
            alive = alive[hit]
            out[alive] = level
        return out


def smoothing(counted: DataFrame, shards: int, min_count: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of a shard, and kappa and alpha by class of the context.  What comes
    to the driver is a fixed number of sums for each shard."""
    tokens, by = np.zeros(BUCKETS), np.zeros((BUCKETS, LEVELS), dtype=np.int64)
    most = 0
    for r in counted.select("tokens", "by").toLocalIterator():
        own = np.frombuffer(r["by"], dtype=np.int64).reshape(BUCKETS, LEVELS)
        tokens, by = tokens + np.frombuffer(r["tokens"]), by + own
        most = max(most, int((own.sum(axis=0) * np.arange(LEVELS)).sum()))
    value = value_of(np.arange(LEVELS), min_count)
    alone = np.where(value - 1 >= min_count, value - 1, 0.0)
    safe = np.maximum(tokens, 1.0)
    kappa = np.minimum(by @ alone / safe, 0.99)
    kept = by @ value / safe
    alpha = np.where(kept > 0, kappa / np.maximum(kept, 1e-12), 0.0)
    return -(-most * BITS_A_KEY // 8) * 8, kappa, alpha


def shard_bits(packed: bytes, size: int, min_count: int) -> bytes:
    """The bits of a shard from its bigrams and counts."""
    if not packed:
        return bytes(size // 8)
    p = unpack(packed)
    return build_range(_grams(p), level_of(p["n"].astype(np.int64), min_count), size)


def whole_filter(counted: DataFrame, shards: int, size: int, min_count: int) -> Filter:
    """The filter on the driver; the caller has checked its size."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shard_bits(packed, size, min_count) for packed in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["shard", "bits"])

    bits = np.zeros(shards * size // 8, dtype=np.uint8)
    if size:
        for r in counted.select("shard", "grams").mapInArrow(fill, "shard int, bits binary").toLocalIterator():
            at = r["shard"] * size // 8
            bits[at : at + size // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Filter(bits, shards, size, min_count)


def levels_in_shards(full: DataFrame, counted: DataFrame, shards: int, size: int, min_count: int) -> DataFrame:
    """`(block, shard, levels)`: levels of a block's distinct bigrams, ascending, read in the shards that hold their bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            for number, packed, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                t = unpack(packed)
                one = np.unique(bigrams(t["flat"].astype(np.int64), t["sizes"].astype(np.int64), np.frombuffer(raw, dtype=np.uint64))[0])
                starts = np.searchsorted(gram_shard(one, shards), np.arange(shards + 1))
                parts = [(s, pack(**_ascending(one[a:z]))) for s, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([p for _, p in parts], pa.binary())], names=["shard", "block", "grams"])

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        trim()
        shard, asked = int(rows["shard"].iloc[0]), rows[rows["block"] >= 0]
        held = rows.loc[rows["block"] < 0, "grams"]
        bits = np.frombuffer(shard_bits(held.iloc[0] if len(held) else b"", size, min_count), dtype=np.uint8)
        own = Filter(bits, shards, size, min_count, shard)
        return pd.DataFrame({"block": asked["block"].to_numpy(), "shard": asked["shard"].to_numpy(), "levels": [pack(c=own.levels(_grams(unpack(p))).astype(np.uint8)) for p in asked["grams"]]})

    sent = full.select("block", "texts", "hashes").mapInArrow(send, "shard int, block long, grams binary")
    both = sent.unionByName(counted.select("shard", F.lit(-1).cast("long").alias("block"), "grams"))
    return both.groupBy("shard").applyInPandas(probe, "block long, shard int, levels binary")


def by_block(parts: DataFrame, column: str) -> DataFrame:
    """The shards' answers to each block, in the order of the shards."""
    return parts.groupBy(F.col("block").alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", column))), lambda p: p[column]).alias(column))


OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """One row per document: its tokens, those that training texts hold, the
    training tokens, the base (unigram) and the model's log10 probability."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = Durable(encode_blocks(docs, id_col, text_col, learn))
    arrow_rows(spark, 1)  # a row is a block
    train, words = blocks.read().agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = max(2 * partitions, int(words) // SHARD_ENTRIES)
    unigrams = Durable(count_unigrams(blocks.read(), shards))
    distinct = unigrams.read().agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    # the shards' counts go back to their blocks
    lists = by_block(unigrams.read(), "counts")
    met = blocks.read().select("block", "texts", "hashes").join(lists.hint("shuffle_hash"), F.col("block") == F.col("_b")).select("block", "texts", "hashes", F.col("counts").alias("parts"))
    full = Durable(met)
    blocks.drop()
    unigrams.drop()
    ranges = max(2 * partitions, int(train) // (2 * SHARD_ENTRIES))
    counted = Durable(count_bigrams(full.read(), shards, ranges, min_count))
    size, kappa, alpha = smoothing(counted.read(), ranges, min_count)
    scored = full.read()
    if ranges * size <= max_filter_mb << 23:
        scored = scored.withColumn("levels", F.lit(None).cast("array<binary>"))
        whole = spark.sparkContext.broadcast(whole_filter(counted.read(), ranges, size, min_count))
    else:
        read = Durable(levels_in_shards(full.read(), counted.read(), ranges, size, min_count))
        scored = scored.join(by_block(read.read(), "levels"), F.col("block") == F.col("_b"))
        whole = None
    counted.drop()
    below = float(train + distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            for packed, raw, counts, found in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                t, hashes = unpack(packed), np.frombuffer(raw, dtype=np.uint64)
                total = totals(hashes, counts, shards).astype(np.float64)
                sizes, flat = t["sizes"].astype(np.int64), t["flat"]
                ends = np.cumsum(sizes)
                one = (total + 1) / below
                if found is not None:
                    levels = np.concatenate([unpack(p)["c"] for p in found])[np.unique(bigrams(flat.astype(np.int64), sizes, hashes)[0], return_inverse=True)[1]]
                # a part of a block at a time: whole texts, about PART_TOKENS tokens
                edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PART_TOKENS, int(ends[-1]), PART_TOKENS)) + 1, [len(sizes)]]))
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own, size = flat[ends[a] - sizes[a] : ends[z - 1]].astype(np.int64), sizes[a:z]
                    starts = np.cumsum(size) - size
                    grams, before = bigrams(own, size, hashes)
                    context, base = total[before], one[own]
                    kind = bucket_of(context)
                    level = whole.value.levels(grams) if found is None else levels[ends[a] - sizes[a] : ends[z - 1]].astype(np.int64)
                    seen = np.minimum(value_of(level, min_count), context)
                    p = np.where(context > 0, alpha[kind] * seen / np.maximum(context, 1) + (1 - kappa[kind]) * base, base)
                    columns = [
                        pa.array(t["ids"][a:z], mask=t["null"][a:z]),
                        pa.array(size),
                        pa.array(np.add.reduceat((total > 0)[own].astype(np.int64), starts)),
                        pa.array(np.full(z - a, train, dtype=np.int64)),
                        pa.array(np.add.reduceat(np.log10(base), starts)),
                        pa.array(np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return scored.select("texts", "hashes", "parts", "levels").mapInArrow(score, OUT)


def op2_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc("doc_id") % 7 == 2, F.lit(False))
    found = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
