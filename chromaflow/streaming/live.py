"""Streaming forms: the running histogram and the temporal hold per pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chromaflow.operators.filters import HoldState
from chromaflow.operators.hist import color_histogram

HELD_SCHEMA = "y int, x int, frame int, r int, g int, b int, a int"
STATE_SCHEMA = "held array<int>, mean array<int>"


def running_histogram(px: DataFrame) -> DataFrame:
    """The histogram of a stream of pixels, for update or complete output."""
    return color_histogram(px)


def streaming_hold(px: DataFrame, window: int) -> DataFrame:
    """`hold` with one fixed window over a stream px(frame, y, x, r, g, b, a): eight numbers
    of state a pixel.  Frames must not come in later batches than their successors."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("frame")
        own: HoldState | None = None
        if state.exists:
            held, mean = state.get
            own = HoldState(np.array([held], dtype=np.int32))
            own.mean = np.array([mean], dtype=np.int32)
        out = []
        for r in rows.itertuples():
            now = np.array([[r.r, r.g, r.b, r.a]], dtype=np.int32)
            if own is None:
                own = HoldState(now)
                out.append(now[0])
            else:
                out.append(own.step(now, window)[0])
        state.update((own.held[0].tolist(), own.mean[0].tolist()))
        yield pd.DataFrame({"y": key[0], "x": key[1], "frame": rows["frame"].to_numpy(), **{c: [int(v[k]) for v in out] for k, c in enumerate("rgba")}})

    return px.groupBy("y", "x").applyInPandasWithState(step, HELD_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
