"""Arithmetic as the dialect has it, on columns (for plans) and on values (for constants).

NULL in gives NULL out.  INT wraps at 64 bits, its division cuts toward zero and
fails on zero; anything with a FLOAT is IEEE double arithmetic.  Columns assume a
session without ANSI mode, where Spark's own integers wrap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from ..types import FLOAT, INT, wrap

ZERO = "division by zero"


def column(op: str, left: Column, right: Column, kind: str) -> Column:
    """``left op right``; both already of ``kind``, INT (long) or FLOAT (double)."""
    if op == "/":
        return _int_division(left, right) if kind == INT else _float_division(left, right)
    return {"+": left + right, "-": left - right, "*": left * right}[op]


def _int_division(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & (right == 0), F.raise_error(F.lit(ZERO)).cast("long")).otherwise(F.call_function("div", left, right))


def _float_division(left: Column, right: Column) -> Column:
    inf = F.when(right.cast("string") == "-0.0", F.lit(-math.inf)).otherwise(F.lit(math.inf))
    at_zero = F.when((left == 0) | F.isnan(left), F.lit(math.nan)).when(left > 0, inf).when(left < 0, -inf)
    return F.when(right == 0, at_zero).otherwise(left / right)


def value(op: str, left, right):
    if left is None or right is None:
        return None
    if isinstance(left, float) or isinstance(right, float):
        left, right = float(left), float(right)
        if op == "/" and right == 0:
            return math.nan if left == 0 or math.isnan(left) else math.copysign(math.inf, left) * math.copysign(1, right)
        try:
            return {"+": left.__add__, "-": left.__sub__, "*": left.__mul__, "/": left.__truediv__}[op](right)
        except OverflowError:
            return math.copysign(math.inf, left) * math.copysign(1, right)
    if op == "/":
        if right == 0:
            raise EngineError(ZERO)
        q = abs(left) // abs(right)
        return wrap(q if (left < 0) == (right < 0) else -q)
    return wrap({"+": left + right, "-": left - right, "*": left * right}[op])


def common_type(left: str, right: str) -> str:
    return FLOAT if FLOAT in (left, right) else INT
