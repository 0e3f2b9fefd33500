"""Clips encoded and read back with the package's own reader."""

import numpy as np
import pytest

from chromaflow.operators import filters, gif
from chromaflow.plans.encode import Options, encode, encode_file
from chromaflow.sources.clip import Clip, moving_square, parse_header, parse_rate, planes_to_rgba, read_clip, to_frames, to_px, to_rgba


def frames_of(spark, stack, parts=3):
    rows = [(i, bytearray(np.ascontiguousarray(f, dtype=np.uint8).tobytes())) for i, f in enumerate(stack)]
    return spark.createDataFrame(rows, "frame int, data binary").repartition(parts)


def run(spark, stack, fps=(10, 1), **options):
    stack = np.asarray(stack, dtype=np.uint8)
    h, w = stack.shape[1:3]
    return gif.read(encode(frames_of(spark, stack), Clip(w, h, *fps), **options))


def solid(color, h=32, w=32, n=1):
    out = np.empty((n, h, w, 4), np.uint8)
    out[:] = (*color, 255)
    return out


def test_moving_square_is_exact(spark):
    px = moving_square(spark)
    got = gif.read(encode(to_frames(px), Clip(64, 48, 20, 1)))
    assert [f["delay"] for f in got["frames"]] == [5] * 12 and got["loop"] == 0
    want = {r["frame"]: np.frombuffer(r["data"], np.uint8).reshape(48, 64, 4) for r in to_frames(px).collect()}
    assert all((f["canvas"] == want[i]).all() for i, f in enumerate(got["frames"]))


def test_duplicates_fold(spark):
    got = run(spark, np.concatenate([solid((10, 200, 10), n=3), solid((200, 10, 10), n=2)]))
    assert [f["delay"] for f in got["frames"]] == [30, 20]


def test_no_loop(spark):
    got = run(spark, solid((1, 2, 3), 16, 16), loop=None)
    assert got["loop"] is None and len(got["frames"]) == 1


def test_transparent_clip_keeps_full_frames(spark):
    stack = solid((90, 90, 90), 16, 16, 3)
    stack[1, 4:8, 4:8, 3] = 0
    stack[2, ..., 0] = 10
    got = run(spark, stack)
    assert [f["box"] for f in got["frames"]] == [(0, 0, 16, 16)] * 3
    assert (got["frames"][1]["canvas"][4:8, 4:8, 3] == 0).all() and got["frames"][1]["canvas"][..., 3].sum() == 255 * (256 - 16)
    assert (got["frames"][2]["canvas"][..., 3] == 255).all()


def test_half_transparent_counts_as_opaque(spark):
    stack = solid((50, 60, 70), 16, 16)
    stack[0, ..., 3] = (128 + np.arange(256) // 2).reshape(16, 16)
    assert (run(spark, stack)["frames"][0]["canvas"][..., 3] == 255).all()


def test_bayer_leaves_an_exact_palette_alone(spark):
    stack = np.empty((4, 32, 32, 4), np.uint8)
    for f in range(4):
        stack[f, ..., :3] = (4 * np.arange(32))[:, None, None]
        stack[f, f : f + 4, f : f + 4, :3] = 250
    stack[..., 3] = 255
    got = run(spark, stack, dither="bayer")
    assert all((g["canvas"] == s).all() for g, s in zip(got["frames"], stack, strict=True))


def test_hold_folds_noise(spark):
    rng = np.random.default_rng(3)
    noisy = solid((99, 149, 199), n=4)
    noisy[..., :3] += rng.integers(0, 2, (4, 32, 32, 3)).astype(np.uint8)
    stack = np.concatenate([noisy, solid((200, 10, 10))])
    assert [f["delay"] for f in run(spark, stack, hold=8)["frames"]] == [40, 10]
    assert len(run(spark, stack)["frames"]) > 2


def test_smoothing_keeps_the_edge(spark):
    rng = np.random.default_rng(4)
    fill = np.concatenate([solid((60, 120, 180), 16, 16, 2), solid((200, 80, 40), 16, 16, 2)], axis=2)
    grain = fill.copy()
    grain[..., :3] = np.clip(fill[..., :3].astype(int) + rng.integers(-2, 3, fill[..., :3].shape), 0, 255)
    out = filters.smooth(frames_of(spark, grain), 32, 16, 24).orderBy("frame").collect()
    for r, f in zip(out, fill, strict=True):
        got = np.frombuffer(r["data"], np.uint8).reshape(16, 32, 4).astype(int)
        # corners see few different neighbours, the two halves never mix
        assert np.abs(got - f).max() <= 2 and (np.abs(got - f) <= 1).mean() > 0.99


def test_delays_add_up(spark):
    stack = np.stack([solid((3 * f, 0, 0), 4, 4)[0] for f in range(30)])
    assert sum(f["delay"] for f in run(spark, stack, (30, 1))["frames"]) == 100
    assert all(f["delay"] == 2 for f in run(spark, stack, (50, 1))["frames"])


@pytest.mark.parametrize("mode", ["none", "bayer", "bluenoise", "auto", "sierra2"])
def test_same_bytes_at_any_partitioning(spark, mode):
    rng = np.random.default_rng(5)
    base = np.kron(rng.integers(0, 256, (9, 9, 3)), np.ones((5, 5, 1))).astype(np.uint8)
    stack = np.stack([np.dstack([np.roll(base, f, 1), np.full(base.shape[:2], 255)]) for f in range(9)]).astype(np.uint8)
    found = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.add(encode(frames_of(spark, stack, parts), Clip(45, 45, 24, 1), dither=mode, colors=17, lossy=30 if mode == "none" else 0, hold=12))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


def test_lossy_shrinks_within_bounds(spark):
    rng = np.random.default_rng(6)
    ramp = np.add.outer(np.arange(64), np.arange(64)).astype(int)
    stack = np.empty((3, 64, 64, 4), np.uint8)
    for f in range(3):
        stack[f, ..., :3] = np.clip(ramp[..., None] + rng.integers(-3, 4, (64, 64, 3)) + f, 0, 255)
    stack[..., 3] = 255
    clip, df = Clip(64, 64, 10, 1), frames_of(spark, stack)
    plain, lossy = encode(df, clip, dither="none"), encode(df, clip, dither="none", lossy=30)
    assert len(lossy) < len(plain)
    a, b = gif.read(plain), gif.read(lossy)
    for x, y in zip(a["frames"], b["frames"], strict=True):
        assert np.abs(x["canvas"].astype(int) - y["canvas"].astype(int)).max() <= 2 * 300**0.5


def test_options_are_checked():
    for bad in ({"colors": 1}, {"colors": 257}, {"lossy": 201}, {"hold": 766}, {"smooth": -1}, {"dither": "x"}, {"dither_gate": 721}, {"loop": 70_000}):
        with pytest.raises(ValueError):
            Options(**bad).check()
    assert Options(dither="bn").check().dither == "bluenoise"


def y4m(path, head, planes):
    path.write_bytes(head.encode() + b"\n" + b"".join(b"FRAME\n" + p for p in planes))
    return str(path)


def test_y4m_grey(spark, tmp_path):
    path = y4m(tmp_path / "a.y4m", "YUV4MPEG2 W4 H4 F25:1 C444", [bytes([128]) * 48] * 2)
    got = gif.read(encode_file(spark, path))
    assert [f["delay"] for f in got["frames"]] == [8]
    assert np.abs(got["frames"][0]["canvas"][..., :3].astype(int) - 130).max() <= 1


def test_y4m_with_filters(spark, tmp_path):
    frame = lambda y: bytes([y]) * 32 + bytes([128]) * 16
    path = y4m(tmp_path / "b.y4m", "YUV4MPEG2 W8 H4 F10:1 C420", [frame(120), frame(121), frame(180)])
    got = gif.read(encode_file(spark, path, hold=8, smooth=16))
    assert [f["delay"] for f in got["frames"]] == [20, 10]
    assert int(got["frames"][1]["canvas"][0, 0, 0]) - int(got["frames"][0]["canvas"][0, 0, 0]) > 40


def test_y4m_frame_parameters_and_ranges(spark, tmp_path):
    plain = y4m(tmp_path / "c.y4m", "YUV4MPEG2 W4 H2 F10:1 Cmono", [bytes([20 * k]) * 8 for k in range(9)])
    odd = tmp_path / "d.y4m"
    odd.write_bytes((tmp_path / "c.y4m").read_bytes().replace(b"FRAME\n", b"FRAME Ip\n"))
    spark.dataSource.register(__import__("chromaflow.sources.clip", fromlist=["ClipSource"]).ClipSource)
    rows = [sorted((r["frame"], bytes(r["data"])) for r in spark.read.format("chromaflow_clip").option("path", p).option("framesPerPartition", 2).load().collect()) for p in (plain, str(odd))]
    assert rows[0] == rows[1] and [r[0] for r in rows[0]] == list(range(9))
    clip, df = read_clip(spark, plain)
    assert to_px(to_rgba(df, clip), 4, 2).where("r = g and g = b and a = 255").count() == 72


def test_raw_rgba(spark, tmp_path):
    stack = solid((9, 8, 7), 6, 5, 2)
    path = tmp_path / "e.rgba"
    path.write_bytes(stack.tobytes())
    got = gif.read(encode_file(spark, str(path), size="5x6", fps="10"))
    assert got["width"] == 5 and [f["delay"] for f in got["frames"]] == [20]
    path.write_bytes(stack.tobytes()[:-1])
    with pytest.raises(Exception, match="cut short"):
        encode_file(spark, str(path), size="5x6")


def test_headers():
    c = parse_header("YUV4MPEG2 W640 H360 F30000:1001 Ip A1:1 C420jpeg")
    assert (c.width, c.height, c.fps_num, c.fps_den, c.chroma) == (640, 360, 30000, 1001, "420")
    assert parse_header("YUV4MPEG2 W3 H3").frame_bytes() == 9 + 2 * 4 and parse_header("YUV4MPEG2 W3 H3 C422").frame_bytes() == 9 + 2 * 6
    for bad in ("YUV4MPEG2 W4 H4 C420p10", "YUV4MPEG2 W4 H4 C444alpha", "YUV4MPEG2 W0 H4", "YUV4MPEG2 W4 H4 F0:1", "RIFF"):
        with pytest.raises(ValueError):
            parse_header(bad)
    assert parse_rate("24") == (24, 1)


def test_planes():
    c = Clip(3, 3, chroma="420")
    data = bytes(range(16, 25)) + bytes([128] * 4) + bytes([128, 128, 128, 200])
    got = np.frombuffer(planes_to_rgba(data, c), np.uint8).reshape(3, 3, 4)
    assert got[2, 2, 0] > got[2, 2, 1] and (got[:2, :2, 0] == got[:2, :2, 1]).all()
