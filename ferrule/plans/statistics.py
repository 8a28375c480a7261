"""Table statistics, for those who look at them; plans and their costs are Catalyst's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import OTHER, of_spark


@dataclass(frozen=True)
class ColumnStats:
    distinct: int
    low: object
    high: object
    nulls: int


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)


def gather(df: DataFrame) -> TableStats:
    """All columns' statistics in one aggregation (distinct counts approximate, as they are for planning)."""
    plain = [f for f in df.schema.fields if of_spark(f.dataType) != OTHER]
    parts = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(plain):
        c = F.col(f"`{f.name}`")
        parts += [F.approx_count_distinct(c, 0.02).alias(f"d{k}"), F.min(c).alias(f"l{k}"), F.max(c).alias(f"h{k}"), F.count(c).alias(f"c{k}")]
    r = df.agg(*parts).first()
    cols = {f.name: ColumnStats(r[f"d{k}"], r[f"l{k}"], r[f"h{k}"], r.n - r[f"c{k}"]) for k, f in enumerate(plain)}
    return TableStats(r.n, cols)
