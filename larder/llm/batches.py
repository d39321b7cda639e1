"""Small helpers for tasks that read pandas batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one key together; the partition must be sorted by the keys, which must not be NULL."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        change = np.zeros(len(frame) - 1, dtype=bool)
        for k in keys:
            values = frame[k].to_numpy()
            change |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield frame.iloc[a:b]
        rest = frame.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield rest


def as_text(column: str) -> Column:
    """An id on its way through pandas, where whole numbers beside NULL would become floating point."""
    return F.col(column).cast("string").alias(column)
