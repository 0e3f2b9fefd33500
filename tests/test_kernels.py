"""Kernels against slow, plain forms."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaflow.functions import color as C
from chromaflow.operators import delta, dither, filters, gif, hist, lzw, nearest, palette
from pyspark.sql import functions as F


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 8))
def test_codes_round_trip(data, bits):
    data = bytes(b & (1 << bits) - 1 for b in data)
    assert lzw.decode(lzw.encode(data, bits), bits) == data


def test_long_streams_round_trip():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 256, 90_000), np.repeat(rng.integers(0, 16, 30_000), 5), np.zeros(100_000)):
        raw = data.astype(np.uint8).tobytes()
        assert lzw.decode(lzw.encode(raw, 8), 8) == raw


def test_lossy_stays_within_its_cap():
    rng = np.random.default_rng(1)
    colors = rng.integers(0, 60, (15, 3))
    level, trans = 20, 15
    search = lzw.Lossy(colors, trans, level, nearest.substitute_table(colors, level))
    data = rng.integers(0, 16, 4000).astype(np.uint8)
    out = np.frombuffer(lzw.decode(lzw.encode_lossy(data.tobytes(), 4, search), 4), np.uint8)
    assert len(out) == len(data) and ((out == trans) == (data == trans)).all()
    changed = out != data
    assert changed.any()
    gap = ((colors[data[changed]] - colors[out[changed]]) ** 2).sum(axis=1)
    assert gap.max() <= 4 * level * 10
    none = lzw.Lossy(colors, trans, 0, nearest.substitute_table(colors, 0))
    assert lzw.encode_lossy(data.tobytes(), 4, none) == lzw.encode(data.tobytes(), 4)


@pytest.mark.parametrize("w,h", list(itertools.product((1, 2, 9, 33), (1, 3, 17))))
def test_box_is_tight(w, h):
    rng = np.random.default_rng(w * 100 + h)
    a = rng.integers(0, 4, (h, w)).astype(np.uint8)
    b = a.copy()
    for y, x in zip(rng.integers(0, h, 2), rng.integers(0, w, 2), strict=True):
        b[y, x] ^= 1
    body = gif.frame_body(b, a, 4, 3)
    if (a == b).all():
        assert body == b""
        return
    ys, xs = np.nonzero(a != b)
    x, y, bw, bh = np.frombuffer(body[1:9], "<u2")
    assert (x, y, bw, bh) == (xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1)


def test_palette_keeps_what_fits():
    rgb = np.array([0x102030, 0x000001, 0xFFFFFF])
    assert palette.median_cut(rgb, np.array([5, 1, 2]), 3).tolist() == [[0, 0, 1], [16, 32, 48], [255, 255, 255]]
    assert palette.median_cut(np.zeros(0), np.zeros(0), 4).tolist() == [[0, 0, 0]]


def test_refinement_does_not_raise_the_error():
    rng = np.random.default_rng(2)
    rgb = np.unique(rng.integers(0, 1 << 24, 4000))
    n = rng.integers(1, 50, len(rgb))
    parts = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=1)
    lab = C.oklab_np(parts)

    def error(p):
        pl = C.oklab_np(p)
        return float((n * ((lab - pl[palette.nearest(lab, pl)]) ** 2).sum(axis=1)).sum())

    cut = palette.median_cut(rgb, n, 32)
    assert len(cut) == 32 and error(palette.refine(cut, rgb, n)) <= error(cut) * 1.001
    heavy = n.copy()
    heavy[7] = 10**9
    assert parts[7].tolist() in palette.refine(palette.median_cut(rgb, heavy, 32), rgb, heavy).tolist()


def test_color_twins(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(0, 256, (300, 3))
    df = spark.createDataFrame([tuple(map(int, r)) for r in p], "r int, g int, b int")
    rgb = df.select(*C.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))).toPandas().to_numpy()
    assert (rgb == C.yuv_to_rgb_np(p[:, 0], p[:, 1], p[:, 2])).all()
    lab = df.select(*C.oklab(F.col("r"), F.col("g"), F.col("b"))).toPandas().to_numpy()
    assert np.abs(lab - C.oklab_np(p)).max() < 1e-6
    assert (C.oklab_to_rgb_np(lab) == p).all()


def test_blue_noise_is_even():
    m = C.blue_noise()
    assert (np.bincount(m.ravel(), minlength=256) == 16).all()
    low = (m < 32).astype(int)
    near = sum(np.roll(low, s, a) for s in (-1, 1) for a in (0, 1)) * low
    assert near.sum() < 0.1 * low.sum()  # low thresholds keep apart


def test_sierra_against_single_frames():
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (2, 6, 7, 3)).astype(np.uint8)
    clear = rng.random((2, 6, 7)) < 0.1
    table = dither.ColorTable(rng.integers(0, 256, (5, 3)))
    got = dither.sierra_np(rgb, clear, table, 5)
    for k in range(2):
        down = [[[0] * 3 for _ in range(9)] for _ in range(7)]
        for y in range(6):
            carry = [0] * 3
            for x in range(7):
                if clear[k, y, x]:
                    assert got[k, y, x] == 5
                    carry = [0] * 3
                    continue
                want = [min(255, max(0, int(rgb[k, y, x, c]) + carry[c] + down[y][x + 1][c])) for c in range(3)]
                i = int(table.index(np.array(want)))
                assert got[k, y, x] == i
                err = [want[c] - int(table.palette[i][c]) for c in range(3)]
                carry = [int(e / 2) for e in err]
                for c in range(3):
                    down[y + 1][x][c] += int(err[c] / 4)
                    down[y + 1][x + 1][c] += int(err[c] / 4)


def test_auto_dithers_only_bands(spark):
    ramp = np.zeros((64, 64, 4), np.uint8)
    ramp[..., :3] = (100 + np.arange(64) // 8)[None, :, None]
    ramp[..., 3] = 255
    table = dither.ColorTable(np.array([[100, 100, 100], [104, 104, 104], [108, 108, 108], [112, 112, 112]]))
    flat = ramp.copy()
    flat[..., :3] = 102
    none, _ = dither.quantize_np(np.stack([flat]), table, "none")
    auto, _ = dither.quantize_np(np.stack([flat]), table, "auto")
    assert (none == auto).all()
    blue, _ = dither.quantize_np(np.stack([ramp]), table, "bluenoise", gate=0)
    assert len(np.unique(blue[0, :, 20:24])) > 1


def test_hold_against_pixels():
    rng = np.random.default_rng(5)
    stack = rng.integers(90, 110, (12, 3, 3, 4)).astype(np.uint8)
    windows = rng.integers(4, 40, 11).tolist()
    got = filters.hold_np(stack, windows)
    for y, x in itertools.product(range(3), range(3)):
        held, mean = stack[0, y, x].astype(int), stack[0, y, x].astype(int) * 128
        for f in range(1, 12):
            now, t = stack[f, y, x].astype(int), windows[f - 1]
            if np.abs(now - ((mean + 64) >> 7)).sum() < t and np.abs(now - held).sum() < t + t // 2:
                mean = mean + ((now * 128 - mean) >> 3)
            else:
                held, mean = now, now * 128
            assert got[f, y, x].tolist() == held.tolist()


def test_smoothing_twins(spark):
    rng = np.random.default_rng(6)
    frame = rng.integers(100, 130, (9, 8, 4)).astype(np.uint8)
    rows = [(0, y, x, *map(int, frame[y, x])) for y in range(9) for x in range(8)]
    px = spark.createDataFrame(rows, "frame int, y int, x int, r int, g int, b int, a int")
    long = filters.smooth_px(px, 30, 8, 9).orderBy("y", "x").toPandas()[list("rgba")].to_numpy()
    assert (long == filters.smooth_np(frame, 30).reshape(-1, 4)).all()


def test_histograms_agree(spark):
    rng = np.random.default_rng(7)
    rows = [(f, y, x, *(int(v) for v in rng.integers(0, 3, 3)), int(rng.integers(0, 2) * 255)) for f in range(6) for y in range(3) for x in range(5)]
    px = spark.createDataFrame(rows, "frame int, y int, x int, r int, g int, b int, a int")
    a, b = (sorted(map(tuple, d.collect())) for d in (hist.color_histogram(px), hist.change_weighted_histogram(px)))
    assert a == b
    runs = hist.row_runs(px)
    assert sorted(map(tuple, runs.groupBy("rgb").agg(F.sum("len")).collect())) == a


def test_empty_tables(spark):
    px = spark.createDataFrame([], "frame int, y int, x int, r int, g int, b int, a int")
    assert hist.color_histogram(px).count() == hist.change_weighted_histogram(px).count() == hist.row_runs(px).count() == 0
    assert delta.changed_box(px.withColumnRenamed("r", "idx")).count() == 0
    assert hist.any_transparent(px).first()[0] is False


def test_delays_over_a_long_clip(spark):
    total = delta.frame_delays(spark.range(30_000).select(F.col("id").cast("int").alias("frame")), 30_000, 1001).agg(F.sum("delay_cs")).first()[0]
    assert total == 100_100


def _raster(spark, stack):
    rows = [(f, y, x, *map(int, stack[f, y, x])) for f, y, x in itertools.product(*(range(n) for n in stack.shape[:3]))]
    return spark.createDataFrame(rows, "frame int, y int, x int, r int, g int, b int, a int").repartition(5)


def test_hold_in_long_and_block_form_against_stacks(spark):
    rng = np.random.default_rng(8)
    stack = rng.integers(90, 110, (40, 5, 3, 4)).astype(np.uint8)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # batches end inside frames
    try:
        got = filters.hold_px(_raster(spark, stack), 30).orderBy("frame", "y", "x").toPandas()[list("rgba")].to_numpy()
        assert (got.reshape(stack.shape) == filters.hold_np(stack, [30] * 39)).all()
        frames = spark.createDataFrame([(f, bytearray(stack[f].tobytes())) for f in range(40)], "frame int, data binary")
        windows = {r["frame"]: r["window"] for r in filters.hold_windows(filters.pair_histograms(frames, 3, 5), 60).collect()}
        want = filters.hold_np(stack, [windows.get(f, filters.LEAST_WINDOW) for f in range(1, 40)])
        for strip in (1, 2, 32):
            held = {r["frame"]: bytes(r["data"]) for r in filters.hold(frames, 3, 5, 60, strip).collect()}
            assert [held[f] for f in range(40)] == [f.tobytes() for f in want]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_noise_histogram_has_no_row_of_the_first_frame(spark):
    stack = np.random.default_rng(9).integers(0, 256, (4, 2, 2, 4))
    px = _raster(spark, stack).withColumn("pos", F.col("y") * 2 + F.col("x"))
    frames = spark.createDataFrame([(f, bytearray(stack[f].astype(np.uint8).tobytes())) for f in range(4)], "frame int, data binary")
    long, block = (sorted((r["frame"], r["d"], r["n"]) for r in h.collect()) for h in (filters.noise_histogram(px), filters.pair_histograms(frames, 2, 2)))
    assert long == block and min(r[0] for r in long) == 1


@pytest.mark.parametrize("span", (1, 2, 3, 100))
def test_frame_before_at_any_span(spark, span):
    rows = [(f, 0, x, f * 10 + x) for f in (0, 1, 2, 3, 5, 6) for x in range(2)]
    px = spark.createDataFrame(rows, "frame int, y int, x int, idx int")
    got = sorted((r["frame"], r["x"], r["prev"]) for r in delta.before(px, {"prev": "idx"}, span).collect())
    assert got == sorted((f, x, None if f in (0, 5) else (f - 1) * 10 + x) for f, _, x, _ in rows)


def test_duplicates_fold_across_spans(spark):
    shown = [f in (2, 3, 4090, 9000) for f in range(13_000)]
    timing = spark.createDataFrame([(f, 2, s) for f, s in enumerate(shown)], "frame int, delay_cs long, visible boolean")
    got = sorted(map(tuple, delta.fold_duplicates(timing).collect()))
    assert got == [(2, 2, 1), (3, 2 * 4087, 4087), (4090, 2 * 4910, 4910), (9000, 8000, 4000)]


def test_sorted_entries_number_all_colors(spark):
    rgb = np.unique(np.random.default_rng(10).integers(0, 1 << 24, 500))
    df = spark.createDataFrame([(int(v), 1) for v in rgb], "rgb int, n long").repartition(7)
    assert sorted((r["place"], r["rgb"]) for r in hist.sorted_entries(df).collect()) == list(enumerate(rgb.tolist(), 1))
