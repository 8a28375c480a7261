"""SELECT to a DataFrame: scans, joins, filter, projection or counts, sort, offset, limit.

Every scanned column gets an inner name of its own, so equal names on both sides
of a join never meet; the last projection gives the names the query asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import checked, is_aggregate
from ..operators import relational
from ..sql import ast as A
from .lower import Field, Lowering, Scope, Typed


def scanned(df: DataFrame, place: int) -> tuple[DataFrame, list[Field]]:
    fields = [Field(f.name, f"_{place}_{k}_{f.name}", f.dataType) for k, f in enumerate(df.schema.fields)]
    return df.toDF(*[f.inner for f in fields]), fields


def plan(q: A.Select, table: Callable[[str], DataFrame]) -> DataFrame:
    """``table`` gives the user columns of a table as the query's snapshot sees it."""
    scope = Scope()
    df, fields = scanned(table(q.first.name), 0)
    scope.add(q.first.name, q.first.alias, fields)
    for k, j in enumerate(q.joins, 1):
        right, fields = scanned(table(j.table.name), k)
        scope.add(j.table.name, j.table.alias, fields)
        df = relational.join(df, right, j.kind, None if j.on is None else Lowering(scope).truth(j.on))
    low = Lowering(scope)
    if q.where is not None:
        df = df.filter(low.truth(q.where))

    if is_aggregate(q.items):
        counts = [(i.alias or "count", None if isinstance(arg := checked(i), A.Star) else low.value(arg).column) for i in q.items]
        for key in q.order:  # one row needs no order, but names must still be known
            Lowering(scope, {n: Typed(F.lit(0), "INT") for n, _ in counts}).value(key.expr)
        return relational.cut(relational.count(df, counts), q.limit, q.offset)

    outputs: list[tuple[str, Typed]] = []
    for k, item in enumerate(q.items, 1):
        if isinstance(item.expr, A.Star):
            outputs += [(f.name, Typed(F.col(f.inner), f.type, f.spark)) for f in scope.fields]
        else:
            outputs.append((item.alias or (item.expr.name if isinstance(item.expr, A.Column) else f"col{k}"), low.value(item.expr)))
    named: dict[str, Typed] = {}
    for n, t in outputs:
        named.setdefault(n, t)
    by = Lowering(scope, named)
    df = relational.sort(df, [(by.value(k.expr).column, k.ascending) for k in q.order])
    return relational.cut(df.select(*[t.column.alias(n) for n, t in outputs]), q.limit, q.offset)
