"""What the operators on vectors share: which vectors are usable, and vectors as bytes on their way through tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True if the vector is there and each of its components is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def stacked(raw: Sequence[bytes], kind: str, width: int) -> np.ndarray:
    """Rows of bytes as a matrix."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), width)
