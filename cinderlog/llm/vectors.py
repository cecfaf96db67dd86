"""Vectors that can be compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 0))


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the vectors: the length, the places of such vectors, and these as rows."""
    lengths, values = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy()
    ends = np.cumsum(lengths)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, at, values.reshape(-1, d) if len(at) == len(lengths) else values[(ends[at] - d)[:, None] + np.arange(d)]
