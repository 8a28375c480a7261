"""The dialect's relational operators on DataFrames; each only declares, Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, kind: str, on: Column | None) -> DataFrame:
    """inner, left, right or cross; any predicate.  Equal conjuncts become join keys, the rest a residual."""
    return left.crossJoin(right) if kind == "cross" else left.join(right, on, kind)


def sort(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """NULLs come last in both directions."""
    return df.orderBy(*[k.asc_nulls_last() if up else k.desc_nulls_last() for k, up in keys]) if keys else df


def cut(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    """Skip, then keep; with a sort below, Spark runs both as one top-k."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def count(df: DataFrame, columns: list[tuple[str, Column | None]]) -> DataFrame:
    """One row of counts, also over no rows; None counts rows."""
    return df.agg(*[F.count(F.lit(1) if c is None else c).alias(n) for n, c in columns])
