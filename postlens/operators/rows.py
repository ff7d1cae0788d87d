"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row per non-null element of ``array``, beside the ``keep`` columns.

    A plain ``explode`` lets Catalyst add a filter on the array's size, which
    computes the array a second time. The outer form does not, and the null it
    leaves for an empty array is dropped afterwards.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    else:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())
