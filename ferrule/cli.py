"""An interactive shell: ``python -m ferrule.cli DIRECTORY``."""

from __future__ import annotations

import sys

from .errors import EngineError
from .session import Engine, Result
from .transactions import Transaction


def cell(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def shown(result: Result) -> str:
    if result.df is None:
        return f"OK, {result.changed} row(s) affected"
    rows = result.rows()
    return "\n".join([" | ".join(result.columns), *(" | ".join(map(cell, r)) for r in rows), f"({len(rows)} row(s))"])


class Shell:
    """One line in, one text out; keeps the open transaction."""

    def __init__(self, engine: Engine):
        self.engine, self.open = engine, None  # type: Engine, Transaction | None

    def handle(self, line: str) -> str:
        text = line.strip().rstrip(";").strip()
        word = " ".join(text.upper().split())
        try:
            if not text:
                return ""
            if word in ("BEGIN", "BEGIN TRANSACTION", "START TRANSACTION"):
                if self.open:
                    return "ERROR: a transaction is open"
                self.open = self.engine.begin()
                return f"BEGIN (transaction {self.open.xid})"
            if word in ("COMMIT", "ABORT", "ROLLBACK"):
                if not self.open:
                    return "ERROR: no transaction is open"
                t, self.open = self.open, None
                (self.engine.commit if word == "COMMIT" else self.engine.abort)(t)
                return "COMMIT" if word == "COMMIT" else "ABORT"
            return shown(self.engine.execute(text, self.open))
        except Exception as e:
            said = str(e).splitlines()[0] if isinstance(e, EngineError) or str(e) else type(e).__name__
            if self.open:
                self.engine.abort(self.open)
                self.open = None
                return f"ERROR (transaction aborted): {said}"
            return f"ERROR: {said}"


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("ferrule").config("spark.ui.enabled", "false").getOrCreate()
    engine = Engine.open(spark, args[0] if args else "ferrule-db", vacuum=False)
    shell = Shell(engine)
    try:
        while True:
            try:
                line = input("ferrule> ")
            except EOFError:
                break
            if line.strip().lower() in ("exit", "quit"):
                break
            if said := shell.handle(line):
                print(said)
    finally:
        engine.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
