"""Python functions of the user surface: scalar and grouped over Arrow batches, and a table function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType


@pandas_udf(LongType())
def cents(price: pd.Series) -> pd.Series:
    """Whole cents of a price, rounded down; null stays null."""
    return np.floor(price * 100).astype("Int64")


_POINT = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


@pandas_udf(BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    """Points as little-endian well-known binary; null where a coordinate is null."""
    rows = np.zeros(len(x), _POINT)
    rows["order"], rows["kind"], rows["x"], rows["y"] = 1, 1, x, y
    raw, n = rows.tobytes(), _POINT.itemsize
    some = x.notna() & y.notna()
    return pd.Series([raw[n * i : n * i + n] if ok else None for i, ok in enumerate(some)], dtype=object)


@pandas_udf(DoubleType())
def concentration(n: pd.Series) -> float:
    """Sum of the squared shares of a group's counts."""
    return float(((n / n.sum()) ** 2).sum())


@udtf(returnType=StructType().add("pos", LongType()).add("word", StringType()))
class words:
    """The words of a text at single spaces, with their places; none for a null text."""

    def eval(self, text: str):
        if text is not None:
            yield from enumerate(text.split(" "))
