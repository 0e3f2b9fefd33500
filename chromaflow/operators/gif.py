"""Frame bodies and the container of an indexed animation, written and read."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delta import MAX_DELAY
from .lzw import Lossy, decode, encode, encode_lossy
from .nearest import substitute_table

KEEP, RESTORE = 1, 2


def table_bits(slots: int) -> int:
    """Bits of the colour table for so many slots."""
    return max(1, (slots - 1).bit_length())


def sub_blocks(data: bytes, min_bits: int) -> bytes:
    parts = [bytes([min_bits])]
    for at in range(0, len(data), 255):
        piece = data[at : at + 255]
        parts += [bytes([len(piece)]), piece]
    return b"".join([*parts, b"\0"])


def frame_body(idx: np.ndarray, previous: np.ndarray | None, trans: int, min_bits: int, lossy: Lossy | None = None, scale: np.ndarray | None = None) -> bytes:
    """The image of an indexed frame (h, w): whole without a previous frame, else the changed
    rectangle, punched where that pays; empty if nothing changed."""

    def pack(part: np.ndarray, scales: np.ndarray | None) -> bytes:
        data = np.ascontiguousarray(part, dtype=np.uint8).tobytes()
        if lossy is None:
            return sub_blocks(encode(data, min_bits), min_bits)
        return sub_blocks(encode_lossy(data, min_bits, lossy, None if scales is None else np.ascontiguousarray(scales).tobytes()), min_bits)

    def at(x: int, y: int, w: int, h: int) -> bytes:
        return b"\x2c" + struct.pack("<4H", x, y, w, h) + b"\0"

    h, w = idx.shape
    if previous is None:
        return at(0, 0, w, h) + pack(idx, scale)
    ys, xs = np.nonzero(idx != previous)
    if not len(ys):
        return b""
    y0, y1, x0, x1 = int(ys.min()), int(ys.max()) + 1, int(xs.min()), int(xs.max()) + 1
    plain, before = idx[y0:y1, x0:x1], previous[y0:y1, x0:x1]
    scales = None if scale is None else scale[y0:y1, x0:x1]
    same = int((plain == before).sum())
    tries = []
    if same * 20 > plain.size:
        tries.append(pack(np.where(plain == before, trans, plain), scales))
    if same * 5 < plain.size * 3:
        tries.append(pack(plain, scales))
    return at(x0, y0, x1 - x0, y1 - y0) + min(tries, key=len)


def encode_frames(idx_frames: DataFrame, timing: DataFrame, width: int, height: int, palette: np.ndarray, has_alpha: bool, lossy: int = 0, batch: int = 8) -> DataFrame:
    """idx_frames(frame, idx, scale) to encoded(frame, delay_cs, body, disposal).
    A frame needs the indexes of the one before only: an equi join on its number."""
    slots = len(palette) + 1
    trans, min_bits = len(palette), max(2, table_bits(slots))
    late = idx_frames.select((F.col("frame") + 1).alias("frame"), F.col("idx").alias("before"))
    whole = F.lit(None).cast("binary")
    met = idx_frames.join(late, "frame", "left").withColumn("before", whole if has_alpha else F.col("before"))
    met = met.join(timing, "frame").select("frame", "delay_cs", "idx", "before", "scale")
    disposal = RESTORE if has_alpha else KEEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Lossy(palette, trans, lossy, substitute_table(palette, lossy)) if lossy else None

        def grid(raw: bytes | None) -> np.ndarray | None:
            return None if raw is None else np.frombuffer(raw, np.uint8).reshape(height, width)

        for b in batches:
            bodies = [frame_body(grid(i), grid(p), trans, min_bits, search, grid(s)) for i, p, s in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.binary()), pa.array([disposal] * len(bodies), pa.int32())], names=["frame", "delay_cs", "body", "disposal"])

    idx_frames.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    return met.mapInArrow(run, "frame int, delay_cs long, body binary, disposal int")


def mux(width: int, height: int, palette: np.ndarray, frames: Iterable[tuple[int, bytes, int]], loop: int | None = 0) -> Iterator[bytes]:
    """The file in pieces, from (delay, body, disposal) in order.  Frames without a body
    lengthen the one before; one frame is held at a time."""
    trans = len(palette)
    bits = table_bits(trans + 1)
    colors = np.zeros((1 << bits, 3), dtype=np.uint8)
    colors[:trans] = palette
    yield b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF0 | (bits - 1), 0, 0) + colors.tobytes()
    if loop is not None:
        yield b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<HB", loop, 0)

    def image(delay: int, body: bytes, disposal: int) -> bytes:
        return b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | 1, min(delay, MAX_DELAY), trans, 0) + body

    held: tuple[int, bytes, int] | None = None
    for delay, body, disposal in frames:
        if not body and held is not None:
            held = held[0] + delay, *held[1:]
            continue
        if held is not None:
            yield image(*held)
        held = delay, body, disposal
    if held is not None and held[1]:
        yield image(*held)
    yield b"\x3b"


def read(data: bytes) -> dict:
    """A file's size, loop count and frames: delay and the canvas (h, w, 4) after each."""
    width, height, packed = struct.unpack_from("<HHB", data, 6)
    bits = (packed & 7) + 1
    at = 13 + 3 * (1 << bits)
    palette = np.frombuffer(data[13:at], np.uint8).reshape(-1, 3)
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    out: dict = {"width": width, "height": height, "loop": None, "palette": palette, "frames": []}
    control = (0, 0, 0)

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind, (body, end) = data[at + 1], blocks(at + 2)
            if kind == 0xF9:
                flags, delay, trans = struct.unpack("<BHB", body)
                control = (delay, flags >> 2 & 7, trans)
            elif kind == 0xFF:
                out["loop"] = struct.unpack("<H", body[12:14])[0]
            at = end
            continue
        x, y, w, h = struct.unpack_from("<4H", data, at + 1)
        body, end = blocks(at + 11)
        idx = np.frombuffer(decode(body, data[at + 10]), np.uint8).reshape(h, w)
        shown = canvas.copy()
        part = shown[y : y + h, x : x + w]
        on = idx != control[2]
        part[on, :3], part[on, 3] = palette[idx[on]], 255
        out["frames"].append({"delay": control[0], "canvas": shown, "box": (x, y, w, h), "indexes": idx})
        canvas = np.zeros_like(canvas) if control[1] == RESTORE else shown
        at = end
    return out
