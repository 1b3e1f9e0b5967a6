"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The right side is a global aggregate, so its size bound is one row; it
    is broadcast and the big side is never shuffled."""
    return df.crossJoin(F.broadcast(one_row))


def numeric_columns(df: DataFrame, exclude: tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def round_doubles(df: DataFrame, dp: int = 4, overrides: dict | None = None) -> DataFrame:
    """Round floating columns (for value-hash comparison with an oracle)."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # "+ 0.0" turns a rounded -0.0 into 0.0 (same bits on every engine)
            cols.append((F.round(F.col(f.name), overrides.get(f.name, dp)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def present(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if c in df.columns]
