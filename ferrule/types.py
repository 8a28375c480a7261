"""The dialect's four types and their Spark counterparts."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import SerializationError

INT, FLOAT, VARCHAR, BOOL = "INT", "FLOAT", "VARCHAR", "BOOL"
#: A column of an external file whose type the dialect lacks: it can be projected, compared with its like and counted.
OTHER = "OTHER"
#: The type of a bare NULL.
NULL = "NULL"

SPELLINGS = {s: t for t, names in {INT: "INT INTEGER BIGINT", FLOAT: "FLOAT DOUBLE REAL", VARCHAR: "VARCHAR TEXT STRING CHAR", BOOL: "BOOL BOOLEAN"}.items() for s in names.split()}
SPARK = {INT: T.LongType(), FLOAT: T.DoubleType(), VARCHAR: T.StringType(), BOOL: T.BooleanType()}
NUMERIC = (INT, FLOAT)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def of_spark(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(kind, T.StringType):
        return VARCHAR
    return BOOL if isinstance(kind, T.BooleanType) else OTHER


def of_value(value) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    return INT if isinstance(value, int) else FLOAT if isinstance(value, float) else VARCHAR


def wrap(value: int) -> int:
    """64-bit two's complement."""
    return (value - LOW) % (1 << 64) + LOW


def stored(value, kind: str, column: str):
    """``value`` as a column of type ``kind`` holds it: the one silent cast is INT to FLOAT."""
    found = of_value(value)
    if found in (NULL, kind):
        return value
    if found == INT and kind == FLOAT:
        return float(value)
    raise SerializationError(f"column {column} holds {kind}, not {found} ({value!r})")
