"""A PySpark-native relational engine with transactional tables.

A compact SQL dialect is parsed in Python and lowered to lazy DataFrames, so
Catalyst optimises and Tungsten runs every query; tables are versioned Parquet
with snapshot reads, atomic commits and write-write conflict detection.

>>> engine = Engine.open(spark, "/data/shop")
>>> engine.execute("CREATE TABLE t (id INT, v INT)")
>>> engine.execute("SELECT COUNT(*) FROM t").rows()
[(0,)]
"""

from .errors import ConflictError, ConstraintError, EngineError, ParseError, SerializationError, StorageError
from .session import Engine, Result

__all__ = ["ConflictError", "ConstraintError", "Engine", "EngineError", "ParseError", "Result", "SerializationError", "StorageError"]
