"""Vector bin packing of token sequences for instruction data.

An example asks for (tokens, segments, loss-bearing tokens); a sequence has a
limit on each.  Within every input partition, full-length runs of a long
example become sequences of their own and the rests wait in a bounded pool.
A sequence is filled by the dot-product heuristic: of the waiting rests that
fit, take the one whose demand has the largest weighted dot product with the
room left; weights are the pool's demand over the limits.  When none fits, the
longest rest is cut to the room that is left.  What remains at the end of a
partition is cut into sequences whose lengths are powers of two, which need no
padding, so partitions may be as many as one likes.

Defined results: null and empty texts are the end id alone; repeated rows are
packed once each; an empty table gives no piece; other columns are ignored.
A partition's pieces depend on its rows only, so a task that runs again gives
the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .wordbpe import default_path, shared

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 512, 2048
END_ID = 1
#: Rests that wait in a partition: at most POOL * max_tokens ids.
POOL = 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


class Packer:
    """Packs (key, doc_tokens, ids, prompt) examples; emit(sequence, pieces) gets each closed sequence."""

    def __init__(self, emit, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=MAX_LOSS, pool=POOL):
        self.emit, self.size = emit, pool
        self.limit = np.array([max_tokens, max_segments, max_loss], dtype=np.int64)
        self.demand = np.zeros((pool + 1, 3), dtype=np.int64)
        self.items: list[tuple] = []
        self.closed = 0

    @staticmethod
    def _loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def add(self, key, ids: bytes, prompt: int = 0) -> None:
        """ids: 4 bytes an id; the first `prompt` ids bear no loss."""
        n, at, full = len(ids) // 4, 0, int(self.limit[0])
        while n - at >= full and self._loss(at, full, prompt) <= self.limit[2]:
            self._close([(key, n, ids, prompt, at, full)])
            at += full
        while n - at > 0:
            take = min(n - at, full)
            if self._loss(at, take, prompt) > self.limit[2]:  # more loss than a sequence may bear
                take = max(0, prompt - at) + int(self.limit[2])
            self._wait((key, n, ids, prompt, at, take))
            at += take

    def _wait(self, item: tuple) -> None:
        self._put_back(item)
        while len(self.items) > self.size:
            self._fill(int(self.limit[0]))

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], len(self.items) - 1
        self.items[i], self.demand[i] = self.items[last], self.demand[last]
        self.items.pop()
        return item

    def _put_back(self, item: tuple) -> None:
        if len(self.items) >= len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.items)] = (item[5], 1, self._loss(item[4], item[5], item[3]))
        self.items.append(item)

    def _fill(self, target: int) -> None:
        room = self.limit.copy()
        room[0] = target
        weight = self.demand[: len(self.items)].sum(axis=0) / self.limit.astype(float) ** 2
        chosen: list[tuple] = []
        while self.items and room[0] > 0 and room[1] > 0:
            d = self.demand[: len(self.items)]
            score = np.where((d <= room).all(axis=1), d @ (weight * room), -1.0)
            i = int(score.argmax())
            if score[i] < 0:  # none fits: cut the longest
                i = int(d[:, 0].argmax())
                key, n, ids, prompt, at, length = self.items[i]
                cut = min(length, int(room[0]), max(0, prompt - at) + int(room[2]))
                if cut <= 0:
                    break
                item = self._take(i)
                chosen.append((key, n, ids, prompt, at, cut))
                if cut < length:
                    self._put_back((key, n, ids, prompt, at + cut, length - cut))
            else:
                chosen.append(self._take(i))
            room -= (chosen[-1][5], 1, self._loss(chosen[-1][4], chosen[-1][5], chosen[-1][3]))
        self._trim(chosen)
        self._close(chosen)

    def _trim(self, chosen: list[tuple]) -> None:
        """A short sequence is cut back to a power of two; what is cut waits again."""
        total = sum(x[5] for x in chosen)
        if total == self.limit[0] or total & (total - 1) == 0:
            return
        over = total - (1 << (total.bit_length() - 1))
        while over:
            key, n, ids, prompt, at, length = chosen.pop()
            back = min(over, length)
            if back < length:
                chosen.append((key, n, ids, prompt, at, length - back))
            self._put_back((key, n, ids, prompt, at + length - back, back))
            over -= back

    def _close(self, chosen: list[tuple]) -> None:
        self.emit(self.closed, chosen)
        self.closed += 1

    def finish(self) -> None:
        while self.items:
            left = int(self.demand[: len(self.items), 0].sum())
            self._fill(int(self.limit[0]) if left >= self.limit[0] else 1 << (left.bit_length() - 1))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    pool: int = POOL,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece.  An example's ids are those of its prompt (no loss),
    of its text and the end id.  sequence_id holds the partition in its upper bits."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bpe, end = shared(path), np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def emit(sequence: int, pieces: list[tuple]) -> None:
            offset = 0
            for key, n, ids, prompt, at, length in pieces:
                part = ids[at * 4 : (at + length) * 4]
                rows.append((key, at, length, zlib.crc32(part), n, base + sequence, offset, Packer._loss(at, length, prompt), part if with_ids else None))
                offset += length

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return out

        packer = Packer(emit, max_tokens, max_segments, max_loss, pool)
        for b in batches:
            keys, texts, prompts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for key, text, prompt in zip(keys, texts, prompts, strict=True):
                head = bpe.encode(prompt)
                packer.add(key, head + bpe.encode(text) + end, len(head) // 4)
            if len(rows) >= 2048:
                yield batch()
        packer.finish()
        if rows:
            yield batch()

    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    out = map_arrow(picked, run, SCHEMA)
    return out if with_ids else out.drop("ids")


#: Of the query: most pieces of a sequence, so that one of very short texts stays a few documents.
QUERY_SEGMENTS = 16


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), max_segments=QUERY_SEGMENTS, with_ids=False)
