"""Finding the interval of sorted edges that a value falls in, by binary search in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def reached(value: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` are at or below the value; 0 for null, all for NaN.

    The edges travel as one array with the function, so the plan is the same size
    for any number of them. Callers bound that number (a grid, a map's blocks).
    """
    at = np.asarray(edges, dtype=np.float64)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, v.to_numpy(), side="right").astype(np.int32))

    return F.when(value.isNull(), F.lit(0)).otherwise(place(value.cast("double")))


def value_at(place: Column, values: Sequence[float]) -> Column:
    """The ``place``-th of ``values``, from 0; null beyond them."""
    of = np.append(np.asarray(values, dtype=np.float64), np.nan)

    @F.pandas_udf("double")
    def pick(p: pd.Series) -> pd.Series:
        k = p.to_numpy()
        return pd.Series(of[np.where((k >= 0) & (k < len(of) - 1), k, len(of) - 1)])

    return pick(place.cast("int"))
