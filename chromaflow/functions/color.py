"""Colour arithmetic as Column builders, with NumPy twins for block form.

Columns stay inside code generation; the twins work on arrays of any shape and
are what the block kernels call.  Channels are INT columns 0..255.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# BT.601 limited range in 16.16 fixed point.
CY, CRV, CGU, CGV, CBU, HALF = 76309, 104597, 25675, 53279, 132201, 32768
# Linear sRGB to cone responses, cube roots to OkLab, and back (Ottosson 2020).
TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
TO_LAB = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)
FROM_LAB = (
    (1.0, 0.3963377774, 0.2158037573),
    (1.0, -0.1055613458, -0.0638541728),
    (1.0, -0.0894841775, -1.2914855480),
)
FROM_LMS = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.7076147010),
)


def clamp8(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """One pixel of limited-range BT.601, rounded in fixed point."""
    base = (y - 16) * CY + HALF
    du, dv = u - 128, v - 128
    parts = base + dv * CRV, base - du * CGU - dv * CGV, base + du * CBU
    return tuple(clamp8(F.shiftright(p, 16)) for p in parts)


def yuv_to_rgb_np(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    base = (y.astype(np.int32) - 16) * CY + HALF
    du, dv = u.astype(np.int32) - 128, v.astype(np.int32) - 128
    parts = np.stack([base + dv * CRV, base - du * CGU - dv * CGV, base + du * CBU], axis=-1)
    return np.clip(parts >> 16, 0, 255).astype(np.uint8)


def mono_to_rgb(y: Column) -> Column:
    return clamp8(F.shiftright((y - 16) * CY + HALF, 16))


def chroma_at(chroma: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Column and row of the chroma sample of a pixel: nearest, no filter."""
    if chroma == "444":
        return x, y
    return F.shiftright(x, 1), F.shiftright(y, 1) if chroma == "420" else y


def opaque(a: Column) -> Column:
    return a >= 128


def color_key(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def channels(key: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(key, 16).bitwiseAND(255), F.shiftright(key, 8).bitwiseAND(255), key.bitwiseAND(255)


def grid_key(r: Column, g: Column, b: Column) -> Column:
    """Six bits a channel."""
    return F.shiftleft(F.shiftright(r, 2), 12) + F.shiftleft(F.shiftright(g, 2), 6) + F.shiftright(b, 2)


def slab_key(r: Column, g: Column, b: Column) -> Column:
    """The grid key without its red part."""
    return F.shiftleft(F.shiftright(g, 2), 6) + F.shiftright(b, 2)


def tiled_key(r: Column, g: Column, b: Column) -> Column:
    """The grid key with the low two bits of each channel behind it."""
    low = F.shiftleft(r.bitwiseAND(3), 4) + F.shiftleft(g.bitwiseAND(3), 2) + b.bitwiseAND(3)
    return F.shiftleft(grid_key(r, g, b), 6) + low


def _mix(rows, parts: list[Column]) -> list[Column]:
    return [sum((F.lit(k) * p for k, p in zip(row[1:], parts[1:], strict=True)), F.lit(row[0]) * parts[0]) for row in rows]


def srgb_to_linear(v: Column) -> Column:
    s = v / F.lit(255.0)
    return F.when(s <= 0.04045, s / F.lit(12.92)).otherwise(F.pow((s + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


@lru_cache(maxsize=1)
def linear_table() -> np.ndarray:
    s = np.arange(256) / 255.0
    return np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lms = _mix(TO_LMS, [srgb_to_linear(c) for c in (r, g, b)])
    return tuple(_mix(TO_LAB, [F.cbrt(c) for c in lms]))


def oklab_np(rgb: np.ndarray) -> np.ndarray:
    """(..., 3) bytes to OkLab, in float32 as palettes are compared."""
    lms = linear_table()[rgb] @ np.array(TO_LMS).T
    return (np.cbrt(lms) @ np.array(TO_LAB).T).astype(np.float32)


def linear_to_srgb(c: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    s = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return F.floor(s * 255.0 + 0.5).cast("int")


def oklab_to_rgb(lum: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    cubed = [c * c * c for c in _mix(FROM_LAB, [lum, a, b])]
    return tuple(linear_to_srgb(c) for c in _mix(FROM_LMS, cubed))


def oklab_to_rgb_np(lab: np.ndarray) -> np.ndarray:
    lin = np.clip((lab.astype(np.float64) @ np.array(FROM_LAB).T) ** 3 @ np.array(FROM_LMS).T, 0, 1)
    s = np.where(lin <= 0.0031308, lin * 12.92, 1.055 * np.power(lin, 1 / 2.4) - 0.055)
    return np.floor(s * 255 + 0.5).astype(np.uint8)


def lossy_scale(att: Column) -> Column:
    """Scale of the lossy cap from the dither strength 0..256: 8 to 255."""
    return F.lit(8) + F.floor((F.lit(256) - att) * 247 / 256).cast("int")


def far_probe(p: Column, near: Column) -> Column:
    """A channel mirrored past its nearest colour, twice the error away."""
    return clamp8(p + (p - near) * 2)


def l1(left: list[Column], right: list[Column]) -> Column:
    return sum((F.abs(a - b) for a, b in zip(left[1:], right[1:], strict=True)), F.abs(left[0] - right[0]))


def attenuation(activity: Column, gate: int) -> Column:
    """Dither strength 0..256: whole up to the gate, none from gate+64; gate 0 is no gate."""
    if gate == 0:
        return F.lit(256)
    return F.greatest(F.lit(0), F.least(F.lit(256), (F.lit(gate + 64) - activity) * 4))


def picks_far(mask: Column, err: list[Column], span: list[Column], att: Column) -> Column:
    """Whether the ordered threshold takes the far colour, in exact integers."""
    err, span = [e.cast("long") for e in err], [s.cast("long") for s in span]
    along = err[0] * span[0] + err[1] * span[1] + err[2] * span[2]
    size = span[0] * span[0] + span[1] * span[1] + span[2] * span[2]
    return mask.cast("long") * size < F.greatest(F.lit(0).cast("long"), along) * att


@lru_cache(maxsize=1)
def bayer8() -> np.ndarray:
    """The 8x8 ordered-dither matrix, 0..63, by the doubling rule."""
    m = np.zeros((1, 1), dtype=int)
    while len(m) < 8:
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return m


@lru_cache(maxsize=2)
def blue_noise(size: int = 64, seed: int = 1, rounds: int = 150, width: float = 1.2) -> np.ndarray:
    """A blue-noise threshold mask with values 0..255, each equally often.

    Made in the frequency plane (after the filtering of Mitsa and Parker, JOSA A
    1992): white noise is high-passed by the complement of a Gaussian and its
    values are made uniform again by rank, in turns."""
    f2 = np.add.outer(np.fft.fftfreq(size) ** 2, np.fft.fftfreq(size) ** 2)
    high = -np.expm1(-2 * (np.pi * width) ** 2 * f2)
    ranks = np.random.default_rng(seed).permutation(size * size)
    for _ in range(rounds):
        passed = np.fft.ifft2(np.fft.fft2(ranks.reshape(size, size)) * high).real
        # rounded, so that equal mathematics gives equal ranks on any machine
        ranks = passed.round(6).ravel().argsort(kind="stable").argsort(kind="stable")
    return (ranks * 256 // (size * size)).reshape(size, size)
