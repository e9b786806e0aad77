"""Small helpers over whole DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`withColumns` whose values are computed once a row.

    A filter over a computed column moves below the projection and computes the column anew for each time it is named
    there, regular expressions included. Nothing moves below a generator that makes the column, so it is computed once.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))).select(*kept, *columns)
