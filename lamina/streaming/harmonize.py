"""Consistent ids over five slices, as slices arrive.

A stream of slices (volume, z and its runs) keeps the last slices of each volume as
state. A slice leaves, final, when the window has passed it, so memory stays at five
slices a volume however long the stack.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.functions import spans as L
from lamina.operators.postproc import harmonize_window

RUN = "volume long, z int, y int, x0 int, x1 int, id long"


def _emit(volume: int, z: int, line: L.Slice, width: int) -> pd.DataFrame:
    y, a, b, v = L.to_runs(line, width)
    return pd.DataFrame({"volume": volume, "z": np.int32(z), "y": y.astype(np.int32), "x0": a.astype(np.int32), "x1": b.astype(np.int32), "id": v.astype(np.int64)})


def harmonize_stream(runs: DataFrame, shape: tuple[int, int], depth: int, least: float = 0.95) -> DataFrame:
    """A streaming frame of runs with harmonized ids; append mode.

    ``runs`` streams whole slices in order of z, a slice within one micro-batch; ``depth``
    is the number of slices of a volume, after which its last slices leave.
    """
    width = shape[1] + L.SPARE

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, window = pickle.loads(state.get[0]) if state.exists else (0, [])
        rows = pd.concat(list(batches))
        last = int(rows["z"].max())
        for z in range(first + len(window), last + 1):
            r = rows[rows["z"] == z]
            window.append(L.of_runs(r["y"], r["x0"], r["x1"], r["id"], width))
            if len(window) == 5:
                yield _emit(key[0], first, window[0], width)
                window, first = harmonize_window(window, least)[0], first + 1
        if last == depth - 1:
            for k, line in enumerate(window):
                yield _emit(key[0], first + k, line, width)
            state.remove()
        else:
            state.update((pickle.dumps((first, window)),))

    return runs.groupBy("volume").applyInPandasWithState(step, RUN, "window binary", "append", GroupStateTimeout.NoTimeout)
