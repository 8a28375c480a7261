"""The dialect's aggregate, COUNT."""

from __future__ import annotations

from ..errors import AnalysisError
from ..sql import ast as A


def is_aggregate(items: tuple[A.Item, ...]) -> bool:
    """Any call at the top of the select list makes the query an aggregate."""
    return any(isinstance(i.expr, A.Call) for i in items)


def checked(item: A.Item) -> A.Expr:
    """The argument of an aggregate query's item."""
    if not isinstance(item.expr, A.Call):
        raise AnalysisError("an aggregate query can select aggregates only")
    if item.expr.name.upper() != "COUNT" or len(item.expr.args) != 1:
        raise AnalysisError(f"unsupported aggregate {item.expr.name} with {len(item.expr.args)} argument(s); there is COUNT(*) and COUNT(expr)")
    return item.expr.args[0]
