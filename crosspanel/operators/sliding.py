"""Order statistics of sliding windows: ranks, medians, places of extremes, in one pass over a group's rows.

Spark has no sliding form of these, and a list for each row takes as many values as the window is long. Here a task holds the
rows of a group once and a skip list, or a part of the windows, beside them; a group is a symbol, or a block of its time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Values of windows that are looked at together.
CELLS = 1 << 20


def rank_of_last(x: np.ndarray, d: int) -> np.ndarray:
    """Average rank of each value among the last d, over d; missing unless all d are there."""
    return pd.Series(x).rolling(d, min_periods=d).rank(method="average", pct=True).to_numpy()


def median(x: np.ndarray, d: int, least: int) -> np.ndarray:
    return pd.Series(x).rolling(d, min_periods=least).median().to_numpy()


def place_of_extreme(x: np.ndarray, d: int, greatest: bool) -> np.ndarray:
    """Place, from the oldest row (1), of the first extreme of the last d rows; missing if one of them is. Infinities count."""
    out = np.full(len(x), np.nan)
    if len(x) < d:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, d)
    step = max(1, CELLS // d)
    for a in range(0, len(windows), step):
        part = windows[a : a + step]
        whole = ~np.isnan(part).any(axis=1)
        found = (part.argmax(axis=1) if greatest else part.argmin(axis=1)) + 1.0
        out[d - 1 + a : d - 1 + a + len(part)] = np.where(whole, found, np.nan)
    return out


#: Operators by name: from a group's values in order of time, whether infinities are missing first.
SLIDING: dict[str, tuple[Callable[..., np.ndarray], bool]] = {
    "ts_rank": (rank_of_last, True),
    "ts_median": (lambda x, d: median(x, d, d), True),
    "median_min": (median, True),
    "ts_argmax": (lambda x, d: place_of_extreme(x, d, True), False),
    "ts_argmin": (lambda x, d: place_of_extreme(x, d, False), False),
}


def slide(df: DataFrame, by: list[str], order: str, jobs: list[tuple[str, str, str, tuple[int, ...]]]) -> DataFrame:
    """Adds a column for each job (name, input column, operator, lengths) to the groups of ``by``, in the order of ``order``."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name, *_ in jobs)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        for name, source, op, lengths in jobs:
            x = table[source].to_numpy(zero_copy_only=False).astype(float)
            kernel, drop = SLIDING[op]
            got = kernel(np.where(np.isfinite(x), x, np.nan) if drop else x, *lengths)
            table = table.append_column(name, pa.array(got, pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*by).applyInArrow(run, schema)
