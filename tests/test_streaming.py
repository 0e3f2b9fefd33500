"""Streaming forms give what the batch forms give."""

import numpy as np

from chromaflow.operators import filters, hist
from chromaflow.streaming.live import running_histogram, streaming_hold

PX = "frame int, y int, x int, r int, g int, b int, a int"


def _clip(spark, path, n=6):
    rng = np.random.default_rng(1)
    stack = rng.integers(100, 108, (n, 2, 3, 4)).astype(np.uint8)
    stack[..., 3] = 255
    for f in range(n):
        rows = [(f, y, x, *map(int, stack[f, y, x])) for y in range(2) for x in range(3)]
        spark.createDataFrame(rows, PX).coalesce(1).write.mode("append").parquet(path)
    return stack


def _run(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_running_histogram(spark, tmp_path):
    path = str(tmp_path / "px")
    _clip(spark, path)
    live = _run(spark, running_histogram(spark.readStream.schema(PX).parquet(path)), "complete", "live_hist")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, hist.color_histogram(spark.read.parquet(path)).collect()))


def test_hold(spark, tmp_path):
    path = str(tmp_path / "px")
    stack = _clip(spark, path)
    held = _run(spark, streaming_hold(spark.readStream.schema(PX).option("maxFilesPerTrigger", 100).parquet(path), 12), "append", "live_hold")
    want = filters.hold_np(stack, [12] * (len(stack) - 1))
    rows = held.collect()
    assert len(rows) == stack.shape[0] * 6
    assert all(want[r["frame"], r["y"], r["x"]].tolist() == [r["r"], r["g"], r["b"], r["a"]] for r in rows)
