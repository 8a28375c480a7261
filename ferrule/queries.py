"""Named queries over the driver's tables, one or more for each operator, with the SQL that checks them.

``DIALECT`` maps a name to (dialect SQL, DuckDB SQL); None where the text serves
both.  Float literals are cast in the SQL because DuckDB reads them as decimals.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConflictError, EngineError
from .plans import statistics
from .session import Engine, Reader
from .sources.files import shared_folder
from .transactions import READ_COMMITTED, REPEATABLE_READ, Snapshot

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"

DIALECT: dict[str, tuple[str, str | None]] = {
    "scan_all_nation": ("SELECT * FROM nation", None),
    "project_expr_alias": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem", None),
    "project_star_plus": ("SELECT *, n_nationkey + 1 AS next_key FROM nation", "SELECT *, CAST(n_nationkey AS BIGINT) + 1 AS next_key FROM nation"),
    "default_col_name": ("SELECT c_custkey, c_acctbal * 2 FROM customer", "SELECT c_custkey, c_acctbal * 2 AS col2 FROM customer"),
    "cmp_eq": ("SELECT p_partkey FROM part WHERE p_size = 15", None),
    "cmp_ne": ("SELECT p_partkey FROM part WHERE p_size <> 15", None),
    "cmp_lt": ("SELECT p_partkey FROM part WHERE p_size < 15", None),
    "cmp_gt": ("SELECT p_partkey FROM part WHERE p_size > 15", None),
    "cmp_gt_float": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.0", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000"),
    "leftmost_name": ("SELECT doc_id, toxic FROM labels x RIGHT JOIN documents y ON x.doc_id = y.doc_id", "SELECT x.doc_id, x.toxic FROM documents y LEFT JOIN labels x ON x.doc_id = y.doc_id"),
    "chained_comparison": ("SELECT p_partkey, p_size < 10 = TRUE AS small FROM part", "SELECT p_partkey, (p_size < 10) = TRUE AS small FROM part"),
    "cmp_le": ("SELECT p_partkey FROM part WHERE p_size <= 15", None),
    "cmp_ge": ("SELECT p_partkey FROM part WHERE p_size >= 15", None),
    "and_or_precedence": ("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = 5 AND c_acctbal > 0", None),
    "not_null_2vl": (f"SELECT d.doc_id FROM {LABELLED} WHERE NOT (l.toxic = 1)", f"SELECT d.doc_id FROM {LABELLED} WHERE NOT coalesce(l.toxic = 1, false)"),
    "compare_with_null": ("SELECT c_custkey FROM customer WHERE NOT (c_acctbal = NULL)", "SELECT c_custkey FROM customer"),
    "bool_projection_2vl": (f"SELECT d.doc_id AS id, l.toxic = 1 AS is_toxic FROM {LABELLED}", f"SELECT d.doc_id AS id, coalesce(l.toxic = 1, false) AS is_toxic FROM {LABELLED}"),
    "non_bool_predicate": ("SELECT r_name FROM region WHERE r_regionkey", "SELECT r_name FROM region WHERE false"),
    "int_div_trunc": ("SELECT event_id, (0 - event_id) / 7 AS q FROM events", "SELECT event_id, (0 - event_id) // 7 AS q FROM events"),
    "int_div_guarded": ("SELECT o_orderkey FROM orders WHERE o_custkey <> 10 AND 1000 / (o_custkey - 10) > 3", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_custkey <> 10 THEN 1000 // (o_custkey - 10) > 3 ELSE false END"),
    "float_div_ieee": ("SELECT l_orderkey, l_linenumber, l_extendedprice / (l_discount - l_discount) AS q FROM lineitem WHERE l_extendedprice > 0", "SELECT l_orderkey, l_linenumber, CAST('Infinity' AS DOUBLE) AS q FROM lineitem WHERE l_extendedprice > 0"),
    "mixed_promotion": ("SELECT l_orderkey, l_linenumber, l_linenumber * l_quantity AS x FROM lineitem", None),
    "unary_minus": ("SELECT c_custkey, -c_acctbal AS neg, -c_nationkey AS negkey FROM customer", "SELECT c_custkey, -c_acctbal AS neg, -CAST(c_nationkey AS BIGINT) AS negkey FROM customer"),
    "parentheses": ("SELECT p_partkey, (p_size + 1) * (p_size - 1) AS x FROM part", "SELECT p_partkey, CAST((p_size + 1) * (p_size - 1) AS BIGINT) AS x FROM part"),
    "range_predicate": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 2000", None),
    "literal_on_left": ("SELECT s_suppkey FROM supplier WHERE 0 < s_acctbal", None),
    "inner_join": ("SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "left_join_on_residual": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", None),
    "right_join": ("SELECT l.doc_id AS labelled, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id", None),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "theta_join": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey", None),
    "self_join_alias": ("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey", None),
    "five_way_join": (
        "SELECT r.r_name, n.n_name, c.c_custkey, o.o_orderkey, l.l_linenumber FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey "
        "JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45 AND r.r_name = 'ASIA'", None),
    "implicit_where_join": ("SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r WHERE n.n_regionkey = r.r_regionkey", None),
    "on_single_table_pred": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey > 1", None),
    "count_star": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "count_empty": ("SELECT COUNT(*) FROM lineitem WHERE l_quantity < 0", "SELECT count(*) AS count FROM lineitem WHERE l_quantity < 0"),
    "count_col_nulls": (f"SELECT COUNT(*) AS n, COUNT(l.toxic) AS labelled FROM {LABELLED}", None),
    "count_bool_expr": (f"SELECT COUNT(l.toxic = 1) AS n FROM {LABELLED}", f"SELECT count(coalesce(l.toxic = 1, false)) AS n FROM {LABELLED}"),
    "join_count": ("SELECT COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice > 100000", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "sort_unprojected": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", None),
    "sort_alias": ("SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice * l_quantity AS x FROM lineitem ORDER BY x DESC, k, n LIMIT 25", None),
    "sort_nulls_last_asc": (f"SELECT d.doc_id AS id, l.quality AS q FROM {LABELLED} ORDER BY q, id LIMIT 450", f"SELECT d.doc_id AS id, l.quality AS q FROM {LABELLED} ORDER BY q ASC NULLS LAST, id LIMIT 450"),
    "sort_nulls_last_desc": (f"SELECT d.doc_id AS id, l.quality AS q FROM {LABELLED} ORDER BY q DESC, id LIMIT 450", f"SELECT d.doc_id AS id, l.quality AS q FROM {LABELLED} ORDER BY q DESC NULLS LAST, id LIMIT 450"),
    "limit_offset": ("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 7 OFFSET 11", None),
    "offset_only": ("SELECT p_partkey FROM part ORDER BY p_partkey OFFSET 1990", None),
    "limit_zero": ("SELECT p_partkey FROM part LIMIT 0", None),
    "string_order": ("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'FURNITURE' AND c_name < 'Customer#000000500'", None),
    "pass_through_types": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1995-01-01'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'"),
}

FLAGSHIP = "SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10"
DIALECT["flagship"] = FLAGSHIP, None


def reader(spark: SparkSession, sf_dir: str) -> Reader:
    return Reader(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


def dialect(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir).query(sql)


def scratch_engine(spark: SparkSession) -> Engine:
    """A new database in the shared folder."""
    return Engine.open(spark, f"{shared_folder(spark)}/ferrule/db-{uuid.uuid4().hex[:12]}")


def _accounts(spark: SparkSession, sf_dir: str) -> Engine:
    e = scratch_engine(spark)
    e.execute("CREATE TABLE acct (id INT NOT NULL, nation INT, balance FLOAT, segment VARCHAR)")
    e.append("acct", spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))
    return e


ACCOUNTS = "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer"


def dml_insert_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _accounts(spark, sf_dir)
    e.execute("INSERT INTO acct (id, segment) VALUES (-1, 'it''s'), (0 - 2, NULL)")
    return e.execute("SELECT * FROM acct").df


def dml_delete_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _accounts(spark, sf_dir)
    e.execute("DELETE FROM acct WHERE balance < 0 OR nation = 7")
    return e.execute("SELECT * FROM acct").df


def dml_update_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _accounts(spark, sf_dir)
    e.execute("UPDATE acct SET balance = balance * 1.1, nation = nation + 1 WHERE segment = 'BUILDING'")
    return e.execute("SELECT * FROM acct").df


def txn_rollback_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _accounts(spark, sf_dir)
    t = e.begin()
    e.execute("DELETE FROM acct WHERE nation < 20", t)
    e.execute("INSERT INTO acct VALUES (1, 1, 1.0, 'x')", t)
    e.abort(t)
    return e.execute("SELECT * FROM acct").df


def txn_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older transaction's view after another has committed a delete."""
    e = _accounts(spark, sf_dir)
    old = e.begin()
    e.execute("DELETE FROM acct WHERE nation > 3")
    return e.execute("SELECT COUNT(*) AS n, COUNT(balance > 0) AS m FROM acct", old).df


def vacuum_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _accounts(spark, sf_dir)
    e.execute("UPDATE acct SET nation = 0 - nation WHERE nation > 12")
    e.execute("CREATE INDEX by_nation ON acct (nation)")
    e.vacuum()
    return e.range_scan("acct", "nation", -24, 5)


def reopened_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed work survives a crash, uncommitted work does not."""
    e = _accounts(spark, sf_dir)
    e.execute("DELETE FROM acct WHERE nation = 1")
    t = e.begin()
    e.execute("DELETE FROM acct", t)
    e.crash()
    return Engine.open(spark, e.store.files.root).execute("SELECT id, balance FROM acct").df


def mvcc_visible_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row versions derived from events, seen by a snapshot with transactions still running."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 97 + 1).alias("xmin"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 89 + 2).alias("xmax"))
    return df.filter(Snapshot(40, 80, frozenset({45, 60, 77})).row_visible(F.col("xmin"), F.col("xmax"), own=77)).select("event_id")


def vacuum_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 89 + 2).alias("xmax"))
    return df.filter(Snapshot(40, 40).sees_column(F.col("xmax"))).agg(F.count(F.lit(1)).alias("reclaimable"))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.gather(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    return spark.createDataFrame([(n, s.rows, c.nulls, str(c.low) if isinstance(c.low, str) else None, float(c.low) if not isinstance(c.low, str) else None, float(c.high) if not isinstance(c.high, str) else None) for n, c in s.columns.items()], "name string, n long, nulls long, low_text string, low double, high double")


#: Statements that must fail on a table ``acct``, and how; run in this order.
REJECTED = (
    ("count in WHERE", "SELECT id FROM acct WHERE COUNT(id) > 1", "AnalysisError"), ("unknown function", "SELECT SUM(id) FROM acct", "AnalysisError"), ("count beside a column", "SELECT id, COUNT(*) FROM acct", "AnalysisError"),
    ("unknown column", "SELECT nope FROM acct", "AnalysisError"), ("unknown qualifier", "SELECT q.id FROM acct", "AnalysisError"), ("types that do not compare", "SELECT id FROM acct WHERE id = 'x'", "AnalysisError"),
    ("too few values", "INSERT INTO acct VALUES (1, 2)", "AnalysisError"), ("too many values", "INSERT INTO acct (id) VALUES (1, 2)", "AnalysisError"), ("NULL for NOT NULL", "INSERT INTO acct (nation) VALUES (1)", "ConstraintError"),
    ("value of another type", "INSERT INTO acct (id) VALUES ('x')", "SerializationError"), ("table that exists", "CREATE TABLE acct (id INT)", "StorageError"), ("outside the dialect", "SELECT DISTINCT id FROM acct", "ParseError"),
    ("", "DROP TABLE acct", ""), ("dropped table", "SELECT id FROM acct", "StorageError"), ("dropped twice", "DROP TABLE acct", "StorageError"),
)


def rejected_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = _accounts(spark, sf_dir), []
    for name, sql, _ in REJECTED:
        try:
            e.execute(sql)
            out.append((name, ""))
        except EngineError as x:
            out.append((name, type(x).__name__))
    return spark.createDataFrame(out, "statement string, error string")


def bool_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch_engine(spark)
    e.execute("CREATE TABLE flags (id INT, rich BOOL)")
    e.append("flags", spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 5000).alias("rich")))
    return e.execute("SELECT id FROM flags WHERE rich").df


def write_conflict_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions change one row: the second fails, whether the first is open, committed, or another engine's."""
    e = _accounts(spark, sf_dir)
    other = Engine.open(spark, e.store.files.root)
    one, two, late, far = e.begin(), e.begin(), e.begin(), other.begin()
    met = 0
    e.execute("UPDATE acct SET balance = 1.0 WHERE nation = 3", one)
    other.execute("UPDATE acct SET balance = 4.0 WHERE nation = 3", far)
    for t, before in ((two, None), (late, lambda: e.commit(one))):
        if before:
            before()
        try:
            e.execute("DELETE FROM acct WHERE nation <= 3", t)
        except ConflictError:
            met += 1
    try:
        other.commit(far)
    except ConflictError:
        met += 1
    return e.execute(f"SELECT *, {met} AS met FROM acct").df


def two_engines_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _accounts(spark, sf_dir)
    b = Engine.open(spark, a.store.files.root)
    one, two = a.begin(), b.begin()
    a.execute("DELETE FROM acct WHERE nation < 5", one)
    b.execute("UPDATE acct SET nation = 100 WHERE nation > 20", two)
    a.commit(one)
    b.commit(two)
    return a.execute("SELECT * FROM acct").df


def read_committed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two isolation levels see before and after another's commit."""
    e = _accounts(spark, sf_dir)
    out = []
    for level in (REPEATABLE_READ, READ_COMMITTED):
        t = e.begin(level)
        before = e.execute("SELECT COUNT(*) FROM acct", t).rows()[0][0]
        e.execute(f"DELETE FROM acct WHERE nation = {len(out)}")
        out.append((level, before, e.execute("SELECT COUNT(*) FROM acct", t).rows()[0][0]))
        e.commit(t)
    return spark.createDataFrame(out, "level string, before long, after long")


def vacuum_timer_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timer folds a deletion in; what is left is one folder of live rows."""
    e = _accounts(spark, sf_dir)
    e.execute("DELETE FROM acct WHERE nation > 9")
    e.timer.seconds = 0.05
    e.timer.start()
    for _ in range(600):
        if not e.store.meta("acct").gone:
            break
        time.sleep(0.05)
    e.timer.stop()
    return e.execute(f"SELECT id, nation, {len(e.store.meta('acct').gone)} AS deletions FROM acct").df


def checkpoint_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint between changes, then a new opening."""
    e = _accounts(spark, sf_dir)
    e.execute("DELETE FROM acct WHERE nation = 2")
    e.checkpoint()
    e.execute("DELETE FROM acct WHERE nation = 4")
    e.close()
    return Engine.open(spark, e.store.files.root).execute("SELECT * FROM acct").df


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _accounts(spark, sf_dir)
    e.execute("CREATE INDEX by_nation ON acct (nation)")
    c = e.catalog()
    return c["tables"].join(c["columns"].withColumnRenamed("name", "column_name"), "table_id").join(c["indexes"].withColumnRenamed("name", "index_name"), ["table_id", "column_name"], "left").select("name", "column_name", "type", "position", "nullable", "index_name")


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries 2 to 4 by number, with a checkpoint between them."""
    e = _accounts(spark, sf_dir)
    e.execute("DELETE FROM acct WHERE nation = 2")
    e.checkpoint()
    e.execute("INSERT INTO acct (id) VALUES (-1)")
    e.execute("DROP TABLE acct")
    entry = F.from_json("entry", "xid long, data array<array<string>>, gone array<array<string>>")
    return e.history(2, 4).select("number", F.size(entry["data"]).alias("inserts"), F.size(entry["gone"]).alias("deletions"))


def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening after a crash finds, and how transactions ended."""
    e = _accounts(spark, sf_dir)
    done, undone, lost = e.begin(), e.begin(), e.begin()
    for t in (done, undone, lost):
        e.execute(f"DELETE FROM acct WHERE id = {t.xid - done.xid + 1}", t)
    e.commit(done)
    e.abort(undone)
    e.flush()
    e.crash()
    e = Engine.open(spark, e.store.files.root)
    rows = [(n, e.status(t.xid), t.xid in e.recovery.committed, t.xid in e.recovery.undone) for n, t in (("done", done), ("undone", undone), ("lost", lost))]
    return spark.createDataFrame(rows, "name string, status string, redone boolean, rolled_back boolean")


def rid_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by address, taken before some were deleted and the rest rewritten by vacuum."""
    e = _accounts(spark, sf_dir)
    at = e.addressed("acct").filter("balance > 9000").select("_xmin", "_stmt", "_seq")
    e.execute("DELETE FROM acct WHERE nation < 3")
    e.vacuum()
    return e.fetch("acct", at)


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key, some of them inserted after the index was built."""
    e = _accounts(spark, sf_dir)
    e.execute("CREATE INDEX by_nation ON acct (nation)")
    e.execute("INSERT INTO acct (id, nation) VALUES (-1, 7), (-2, NULL)")
    return e.search("acct", "nation", 7)


DERIVED = "SELECT event_id, event_id % 97 + 1 AS xmin, CASE WHEN event_id % 3 = 0 THEN event_id % 89 + 2 END AS xmax FROM events"
SEEN = "({0} > 0 AND {0} < 80 AND {0} NOT IN (45, 60, 77))"
BUILT: dict[Callable[[SparkSession, str], DataFrame], str] = {
    dml_insert_image: ACCOUNTS + " UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 'it''s'), (-2, NULL, NULL, NULL)",
    dml_delete_image: f"SELECT * FROM ({ACCOUNTS}) WHERE NOT coalesce(balance < 0 OR nation = 7, false)",
    dml_update_image: f"SELECT id, CASE WHEN segment = 'BUILDING' THEN nation + 1 ELSE nation END AS nation, CASE WHEN segment = 'BUILDING' THEN balance * CAST(1.1 AS DOUBLE) ELSE balance END AS balance, segment FROM ({ACCOUNTS})",
    txn_rollback_image: ACCOUNTS,
    txn_snapshot_read: f"SELECT count(*) AS n, count(*) AS m FROM ({ACCOUNTS})",
    vacuum_image: f"SELECT * FROM (SELECT id, CASE WHEN nation > 12 THEN -nation ELSE nation END AS nation, balance, segment FROM ({ACCOUNTS})) WHERE nation BETWEEN -24 AND 5",
    reopened_image: f"SELECT id, balance FROM ({ACCOUNTS}) WHERE nation <> 1",
    mvcc_visible_scan: f"SELECT event_id FROM ({DERIVED}) WHERE (xmin = 77 OR {SEEN.format('xmin')}) AND NOT coalesce(xmax = 77 OR {SEEN.format('xmax')}, false)",
    vacuum_reclaimable: f"SELECT count(*) AS reclaimable FROM ({DERIVED}) WHERE xmax > 0 AND xmax < 40",
    rejected_statements: "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{x}')" for n, _, x in REJECTED) + ") v(statement, error)",
    bool_predicate: "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000",
    write_conflict_image: f"SELECT id, nation, CASE WHEN nation = 3 THEN 1 ELSE balance END AS balance, segment, CAST(3 AS BIGINT) AS met FROM ({ACCOUNTS})",
    two_engines_image: f"SELECT id, CASE WHEN nation > 20 THEN 100 ELSE nation END AS nation, balance, segment FROM ({ACCOUNTS}) WHERE nation >= 5",
    read_committed_counts: f"SELECT 'REPEATABLE READ' AS level, count(*) AS before, count(*) AS after FROM ({ACCOUNTS}) UNION ALL SELECT 'READ COMMITTED', count(*) FILTER (nation <> 0), count(*) FILTER (nation > 1) FROM ({ACCOUNTS})",
    vacuum_timer_image: f"SELECT id, nation, CAST(0 AS BIGINT) AS deletions FROM ({ACCOUNTS}) WHERE nation <= 9",
    checkpoint_image: f"SELECT * FROM ({ACCOUNTS}) WHERE nation NOT IN (2, 4)",
    catalog_scan: "SELECT * FROM (VALUES ('acct', 'id', 'INT', CAST(0 AS BIGINT), false, NULL), ('acct', 'nation', 'INT', 1, true, 'by_nation'), ('acct', 'balance', 'FLOAT', 2, true, NULL), ('acct', 'segment', 'VARCHAR', 3, true, NULL)) v(name, column_name, type, position, nullable, index_name)",
    log_scan: "SELECT * FROM (VALUES (CAST(2 AS BIGINT), 1, 0), (3, 0, 1), (4, 1, 0)) v(number, inserts, deletions)",
    recovery_report: "SELECT * FROM (VALUES ('done', 'committed', true, false), ('undone', 'aborted', false, false), ('lost', 'aborted', false, true)) v(name, status, redone, rolled_back)",
    rid_fetch: f"SELECT * FROM ({ACCOUNTS}) WHERE balance > 9000 AND nation >= 3",
    index_search: f"SELECT * FROM ({ACCOUNTS}) WHERE nation = 7 UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(7 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR))",
    column_stats: "SELECT 'o_orderkey' AS name, count(*) AS n, count(*) - count(o_orderkey) AS nulls, CAST(NULL AS VARCHAR) AS low_text, CAST(min(o_orderkey) AS DOUBLE) AS low, CAST(max(o_orderkey) AS DOUBLE) AS high FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), NULL, min(o_totalprice), max(o_totalprice) FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), min(o_orderstatus), NULL, NULL FROM orders",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(dialect, sql) for n, (sql, _) in DIALECT.items()} | {f.__name__: f for f in BUILT}


def oracle_sql() -> dict[str, str]:
    return {n: check or sql for n, (sql, check) in DIALECT.items()} | {f.__name__: sql for f, sql in BUILT.items()}
