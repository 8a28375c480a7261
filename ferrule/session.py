"""The engine: statements in, results out."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AnalysisError, ConstraintError, EngineError, StorageError
from .plans import statistics
from .plans.lower import Lowering, Scope, constant
from .plans.select import plan, scanned
from .sources.external import parquet
from .sources.store import IDENTITY, Meta, Store
from .sql import ast as A
from .sql import parse
from .transactions import GRACE, REPEATABLE_READ, Transaction, Transactions, VacuumTimer
from .types import FLOAT, INT, SPARK, stored

#: The dialect's rules that are session settings in Spark; set on the engine's own session, the caller's keeps its own.
SETTINGS = {"spark.sql.ansi.enabled": "false", "spark.sql.caseSensitive": "true", "spark.sql.adaptive.enabled": "true"}


@dataclass
class Result:
    """A query's lazy DataFrame, or the number of rows a statement changed."""

    df: DataFrame | None = None
    changed: int = 0

    @property
    def columns(self) -> list[str]:
        return [] if self.df is None else self.df.columns

    def rows(self) -> list[tuple]:
        return [] if self.df is None else [tuple(r) for r in self.df.collect()]

    @property
    def affected(self) -> int:
        return self.changed if self.df is None else self.df.count()


@dataclass(frozen=True)
class Recovery:
    """What opening found: transactions in the log, and lost ones whose writes it removed."""

    committed: list[int]
    undone: list[int]


def own_session(spark: SparkSession) -> SparkSession:
    session = spark.newSession()
    for k, v in SETTINGS.items():
        session.conf.set(k, v)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(k, spark.conf.get(k))
    return session


class Reader:
    """SELECT over Parquet files, without a database: ``Reader(spark, {name: path})``."""

    def __init__(self, spark: SparkSession, tables: dict[str, str]):
        self.spark, self.tables = own_session(spark), tables

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise StorageError(f"unknown table {name}")
        return parquet(self.spark, self.tables[name])

    def query(self, sql: str) -> DataFrame:
        q = parse(sql)
        if not isinstance(q, A.Select):
            raise AnalysisError("only SELECT runs over files")
        return plan(q, self.table)


class Engine:
    """A database directory.  ``execute`` commits each statement by itself unless given a transaction."""

    def __init__(self, spark: SparkSession, path: str, vacuum: bool = False):
        self.spark = own_session(spark)
        self.store = Store(self.spark, path)
        self.recovery = Recovery(*self.store.recover())
        self.transactions = Transactions(self.store)
        self.stats: dict[str, statistics.TableStats] = {}
        self.timer = VacuumTimer(self.transactions)
        self.closed = False
        if vacuum:
            self.timer.start()

    @classmethod
    def open(cls, spark: SparkSession, path: str, vacuum: bool = False) -> Engine:
        """Create the directory, or reopen it as of its last commit; ``vacuum`` starts the timer."""
        return cls(spark, path, vacuum)

    # -- transactions

    def begin(self, isolation: str = REPEATABLE_READ) -> Transaction:
        return self.transactions.begin(isolation)

    def commit(self, t: Transaction) -> None:
        self.transactions.commit(t)

    def abort(self, t: Transaction) -> None:
        self.transactions.abort(t)

    @contextlib.contextmanager
    def transaction(self, isolation: str = REPEATABLE_READ) -> Iterator[Transaction]:
        """Commits at the end, aborts on an error."""
        t = self.begin(isolation)
        try:
            yield t
        except BaseException:
            if t.state == "active":
                self.abort(t)
            raise
        self.commit(t)

    def execute(self, sql: str, t: Transaction | None = None) -> Result:
        """Run one statement.  An error in a given transaction leaves it to the caller, who may abort it."""
        if self.closed:
            raise EngineError("the engine is closed")
        q = parse(sql)
        if t is not None:
            return self._run(q, t)
        with self.transaction() as own:
            return self._run(q, own)

    def _run(self, q: A.Statement, t: Transaction) -> Result:
        n = self.transactions.statement(t)
        if isinstance(q, A.Select):
            return Result(plan(q, lambda name: self.table(name, t)))
        if isinstance(q, A.CreateTable):
            return self._create(q)
        if isinstance(q, A.CreateIndex):
            return self._index(q)
        if isinstance(q, A.DropTable):
            self._define(lambda: self.store.meta(q.table) and {"drop": q.table})
            self.stats.pop(q.table, None)
            return Result()
        table = self.store.meta(q.table)
        if table.external:
            raise StorageError(f"{q.table} is external and read-only")
        if isinstance(q, A.Insert):
            return self._insert(q, table, t, n)
        if isinstance(q, A.Delete):
            rows, _, _ = self._matched(q, table, t)
            return Result(changed=self.transactions.delete(t, table, rows, n))
        return self._update(q, table, t, n)

    # -- tables

    def table(self, name: str, t: Transaction) -> DataFrame:
        """A table's user columns as a transaction sees them."""
        m = self.store.meta(name)
        return parquet(self.spark, m.external) if m.external else self.transactions.visible(t, m).drop(*IDENTITY)

    def register(self, name: str, path: str) -> None:
        """Make a Parquet file or folder a read-only table."""
        self._define(lambda: self._free(name) | {"columns": [], "external": path})

    def _define(self, make) -> None:
        """Log a definition; ``make`` checks it against what every engine has logged before."""
        with self.transactions.lock:
            self.store.append(make)

    def _free(self, name: str) -> dict:
        if name in self.store.tables:
            raise StorageError(f"table {name} exists")
        return {"create": name, "id": self.store.next_table}

    def _create(self, q: A.CreateTable) -> Result:
        names = [c.name for c in q.columns]
        if len(set(names)) < len(names):
            raise AnalysisError(f"duplicate column name in {q.table}")
        if taken := set(names) & set(IDENTITY):
            raise AnalysisError(f"column name {sorted(taken)[0]} is taken")
        self._define(lambda: self._free(q.table) | {"columns": [(c.name, c.type, c.nullable) for c in q.columns]})
        return Result()

    def _index(self, q: A.CreateIndex) -> Result:
        def entry() -> dict:
            table = self.store.meta(q.table)
            self._column(table, q.column)
            if q.name in table.indexes:
                raise StorageError(f"index {q.name} exists")
            return {"index": q.name, "table": q.table, "column": q.column}

        self._define(entry)
        self.transactions.vacuum({q.table: q.column})
        return Result()

    def _column(self, table: Meta, name: str) -> tuple[str, str, bool]:
        for c in table.columns:
            if c[0] == name:
                return c
        raise AnalysisError(f"unknown column {table.name}.{name}")

    def catalog(self) -> dict[str, DataFrame]:
        """``tables``, ``columns`` and ``indexes`` as DataFrames."""
        ms = list(self.store.tables.values())
        make = self.spark.createDataFrame
        return {
            "tables": make([(m.id, m.name, m.external) for m in ms], "table_id long, name string, external string"),
            "columns": make([(m.id, n, t, k, null) for m in ms for k, (n, t, null) in enumerate(m.columns)], "table_id long, name string, type string, position long, nullable boolean"),
            "indexes": make([(m.id, i, c) for m in ms for i, c in m.indexes.items()], "table_id long, name string, column_name string"),
        }

    # -- writes

    def _insert(self, q: A.Insert, table: Meta, t: Transaction, n: int) -> Result:
        targets = [self._column(table, c) for c in q.columns] or table.columns
        if len({c[0] for c in targets}) < len(targets):
            raise AnalysisError("a column is named twice")
        rows = []
        for r in q.rows:
            if len(r) != len(targets):
                raise AnalysisError(f"{len(targets)} values expected, {len(r)} given")
            given = {c: stored(constant(e), k, c) for (c, k, _), e in zip(targets, r, strict=True)}
            rows.append(tuple(self._checked(given.get(c), c, null) for c, _, null in table.columns))
        self.transactions.insert(t, table, self.spark.createDataFrame(rows, table.schema).coalesce(1), n)
        return Result(changed=len(rows))

    def append(self, name: str, df: DataFrame, t: Transaction | None = None) -> int:
        """Insert a DataFrame's rows, columns by name; for loads too large for VALUES."""
        table = self.store.meta(name)
        cols = []
        for c, k, null in table.columns:
            col = F.col(c).cast(SPARK[k]) if c in df.columns else F.lit(None).cast(SPARK[k])
            cols.append((col if null else F.when(col.isNull(), F.raise_error(F.lit(f"NULL in {name}.{c}")).cast(SPARK[k])).otherwise(col)).alias(c))
        with contextlib.nullcontext(t) if t else self.transaction() as own:
            n = self.transactions.statement(own)
            path = self.transactions.insert(own, table, df.select(*cols), n)
            return self.spark.read.parquet(self.store.files.url(path)).count()

    @staticmethod
    def _checked(value, column: str, nullable: bool):
        if value is None and not nullable:
            raise ConstraintError(f"column {column} is NOT NULL")
        return value

    def _matched(self, q: A.Update | A.Delete, table: Meta, t: Transaction) -> tuple[DataFrame, Scope, Lowering]:
        """Visible rows that fulfil WHERE, in inner names but for their identity."""
        visible = self.transactions.visible(t, table)
        _, fields = scanned(visible.drop(*IDENTITY), 0)
        scope = Scope()
        scope.add(table.name, None, fields)
        low = Lowering(scope)
        rows = visible.toDF(*[f.inner for f in fields], *IDENTITY)
        return (rows if q.where is None else rows.filter(low.truth(q.where))), scope, low

    def _update(self, q: A.Update, table: Meta, t: Transaction, n: int) -> Result:
        rows, scope, low = self._matched(q, table, t)
        sets = {}
        for name, e in q.assignments:
            _, kind, null = self._column(table, name)
            got = low.value(e)
            if got.type not in (kind, "NULL") and not (got.type == INT and kind == FLOAT):
                raise AnalysisError(f"column {name} holds {kind}, not {got.type}")
            col = got.column.cast(SPARK[kind])
            sets[name] = col if null else F.when(col.isNull(), F.raise_error(F.lit(f"column {name} is NOT NULL")).cast(SPARK[kind])).otherwise(col)
        image = rows.select(*[(sets[f.name] if f.name in sets else F.col(f.inner)).alias(f.name) for f in scope.fields])
        # both writes read the snapshot before either is part of it: every right side sees the old row
        changed = self.transactions.delete(t, table, rows, n)
        if changed:
            try:
                self.transactions.insert(t, table, image, n)
            except Exception as e:
                with self.transactions.lock:
                    t.gone.pop()
                if "NOT NULL" in str(e):
                    raise ConstraintError(str(e).splitlines()[0]) from e
                raise
        return Result(changed=changed)

    # -- indexes, statistics, plans

    def search(self, table: str, column: str, key, t: Transaction | None = None) -> DataFrame:
        """Rows whose column equals ``key``."""
        return self.range_scan(table, column, key, key, t)

    def range_scan(self, table: str, column: str, low=None, high=None, t: Transaction | None = None) -> DataFrame:
        """Rows with ``low <= column <= high`` (None: open), ascending; sorted files are pruned by their statistics."""
        with contextlib.nullcontext(t) if t else self.transaction() as own:
            df = self.table(table, own)
        c = F.col(column)
        df = df.filter(c.isNotNull())
        df = df if low is None else df.filter(c >= low)
        df = df if high is None else df.filter(c <= high)
        return df.orderBy(c)

    def analyze(self, name: str) -> statistics.TableStats:
        with self.transaction() as t:
            self.stats[name] = statistics.gather(self.table(name, t))
        return self.stats[name]

    def explain(self, sql: str) -> str:
        """Rows of the tables where :meth:`analyze` gathered them, and Catalyst's plan with its own size estimates."""
        q = parse(sql)
        if not isinstance(q, A.Select):
            raise AnalysisError("EXPLAIN takes a SELECT")
        names = dict.fromkeys([q.first.name, *[j.table.name for j in q.joins]])
        known = [f"{n}: {self.stats[n].rows} rows" for n in names if n in self.stats]
        with self.transaction() as t:
            df = plan(q, lambda n: self.table(n, t))
        return "\n".join([*known, df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))])

    # -- row addresses, the log

    def addressed(self, name: str, t: Transaction | None = None) -> DataFrame:
        """A table's rows with their addresses, the columns ``_xmin, _stmt, _seq``; a row keeps its address until it is updated."""
        with contextlib.nullcontext(t) if t else self.transaction() as own:
            return self.transactions.visible(own, self._stored(name))

    def fetch(self, name: str, addresses: DataFrame, t: Transaction | None = None) -> DataFrame:
        """The visible rows at ``addresses`` (``_xmin, _stmt, _seq``); an address of a deleted row gives none."""
        with contextlib.nullcontext(t) if t else self.transaction() as own:
            return self.transactions.fetch(own, self._stored(name), addresses).drop(*IDENTITY)

    def _stored(self, name: str) -> Meta:
        table = self.store.meta(name)
        if table.external:
            raise StorageError(f"{name} is external; its rows have no addresses")
        return table

    def history(self, low: int = 1, high: int | None = None) -> DataFrame:
        """The log from entry ``low`` to ``high``, whatever checkpoints lie between."""
        return self.store.history(low, high)

    def status(self, xid: int) -> str:
        return self.transactions.status(xid)

    # -- life

    def vacuum(self, grace: float = GRACE) -> int:
        return self.transactions.vacuum(grace=grace)

    def flush(self) -> int:
        """The number of the last durable log entry.  A commit's entry is durable when it returns; this adds its name's folder."""
        self.store.files.sync("_log")
        return self.store.last

    def checkpoint(self) -> None:
        with self.transactions.lock:
            self.store.checkpoint()

    def close(self) -> None:
        """Abort what is open; commits are durable already."""
        if not self.closed:
            self.timer.stop()
            for t in list(self.transactions.active.values()):
                self.abort(t)
            self.store.leave()
            self.closed = True

    def crash(self) -> None:
        """For tests: forget everything in memory, leave the directory as it is."""
        self.timer.stop()
        self.transactions.active.clear()
        self.store.leave()
        self.closed = True
