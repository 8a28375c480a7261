"""Structured Streaming into a table: each micro-batch is one transaction.

A batch that Spark runs again after a failure is found in the table's log by its
stream's name and number, and is not inserted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Engine


def append_stream(engine: Engine, stream: DataFrame, table: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    mark = f"_{name}_batches"
    if mark not in engine.store.tables:
        engine.execute(f"CREATE TABLE {mark} (batch INT)")

    def batch(df: DataFrame, number: int) -> None:
        with engine.transaction() as t:
            if not engine.execute(f"SELECT batch FROM {mark} WHERE batch = {number} LIMIT 1", t).rows():
                engine.append(table, df, t)
                engine.execute(f"INSERT INTO {mark} VALUES ({number})", t)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
