"""Shared by the registry modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every fractional column; the nudge keeps exact halves from falling either way."""
    return df.select(
        *[
            F.round(F.col(f.name) + 10.0 ** -(digits + 3), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
