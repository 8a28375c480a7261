import threading

import pytest

from ferrule import ConflictError, ConstraintError, Engine, EngineError, SerializationError, StorageError
from ferrule.cli import Shell
from ferrule.sources.store import Numbers
from ferrule.transactions import READ_COMMITTED, Snapshot


def count(e, t=None, table="t"):
    return e.execute(f"SELECT COUNT(*) FROM {table}", t).rows()[0][0]


@pytest.fixture
def t(engine):
    engine.execute("CREATE TABLE t (id INT, v INT)")
    return engine


def test_dml_counts(moons):
    assert moons.execute("UPDATE moons SET days = days + 5, id = days WHERE days < 9").affected == 2
    assert sorted(moons.execute("SELECT id, days FROM moons").rows()) == [(1, 9), (3, 8), (3, 14), (8, 13)]
    assert moons.execute("DELETE FROM moons WHERE NOT days = 9").affected == 3
    assert moons.execute("INSERT INTO moons (name) VALUES ('x')").affected == 1
    assert moons.execute("SELECT * FROM moons WHERE name = 'x'").rows() == [(None, None, "x")]
    assert moons.execute("DELETE FROM moons").affected == 2 and count(moons, table="moons") == 0


def test_write_errors(engine):
    engine.execute("CREATE TABLE c (id INT NOT NULL, x FLOAT)")
    engine.execute("INSERT INTO c VALUES (1 + 1, 3)")
    assert engine.execute("SELECT * FROM c").rows() == [(2, 3.0)]
    for sql, error in (
        ("INSERT INTO c VALUES (NULL, 1.0)", ConstraintError), ("INSERT INTO c (x) VALUES (1.0)", ConstraintError), ("INSERT INTO c VALUES (1)", EngineError), ("INSERT INTO c VALUES ('a', 1.0)", SerializationError),
        ("UPDATE c SET id = NULL", ConstraintError), ("INSERT INTO nope VALUES (1)", StorageError), ("CREATE TABLE c (a INT)", StorageError), ("CREATE TABLE d (a INT, a INT)", EngineError),
    ):
        with pytest.raises(error):
            engine.execute(sql)
    assert engine.execute("SELECT * FROM c").rows() == [(2, 3.0)]


def test_snapshot_reads(t):
    one = t.begin()
    t.execute("INSERT INTO t VALUES (1, 1)", one)
    two = t.begin()
    assert count(t, one) == 1 and count(t, two) == 0
    t.commit(one)
    assert count(t, two) == 0 and count(t) == 1
    committed = t.begin(READ_COMMITTED)
    t.execute("INSERT INTO t VALUES (2, 2)")
    assert count(t, committed) == 2 and count(t, two) == 0


def test_abort_and_own_writes(t):
    t.execute("INSERT INTO t VALUES (1, 1)")
    x = t.begin()
    t.execute("UPDATE t SET v = v + 1", x)
    t.execute("UPDATE t SET v = v + 1", x)
    assert t.execute("SELECT v FROM t", x).rows() == [(3,)]
    t.abort(x)
    assert t.execute("SELECT v FROM t").rows() == [(1,)]
    with pytest.raises(EngineError):
        t.execute("SELECT v FROM t", x)


def test_conflicts(t):
    t.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    one, two, three = t.begin(), t.begin(), t.begin()
    t.execute("UPDATE t SET v = 10 WHERE id = 1", one)
    with pytest.raises(ConflictError):  # with a live transaction
        t.execute("UPDATE t SET v = 20 WHERE id = 1", two)
    t.execute("UPDATE t SET v = 20 WHERE id = 2", two)  # another row is free
    t.commit(one)
    with pytest.raises(ConflictError):  # with one that has committed since
        t.execute("DELETE FROM t WHERE id = 1", three)
    t.commit(two)
    assert sorted(t.execute("SELECT v FROM t").rows()) == [(10,), (20,)]


def test_parallel_inserts(t):
    errors = []

    def work(k):
        try:
            for i in range(3):
                t.execute(f"INSERT INTO t VALUES ({k}, {i})")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and count(t) == 12


def test_crash_and_reopen(t, spark):
    t.execute("INSERT INTO t VALUES (1, 1), (2, 2), (3, 3)")
    t.execute("DELETE FROM t WHERE id = 1")
    t.execute("UPDATE t SET v = 9 WHERE id = 2")
    x = t.begin()
    t.execute("INSERT INTO t VALUES (4, 4)", x)
    root = t.store.files.root
    for _ in range(2):
        t.crash()
        t = Engine.open(spark, root)
        assert sorted(t.execute("SELECT * FROM t").rows()) == [(2, 9), (3, 3)]
    t.checkpoint()
    t.execute("INSERT INTO t VALUES (5, 5)")
    t.close()
    assert count(Engine.open(spark, root)) == 3


def test_vacuum_and_index(t):
    t.execute("INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    t.execute("UPDATE t SET v = v + 1")
    old = t.begin()
    t.execute("DELETE FROM t WHERE id = 3")
    assert t.vacuum() == 3 and count(t, old) == 3 and count(t) == 2
    t.commit(old)
    assert t.vacuum() == 1 and t.vacuum() == 0 and count(t) == 2
    t.execute("CREATE INDEX i ON t (v)")
    assert t.range_scan("t", "v", 11, 20).collect()[0].v == 11 and t.search("t", "v", 21).count() == 1
    t.execute("INSERT INTO t VALUES (7, 21), (8, NULL)")
    assert t.search("t", "v", 21).count() == 2 and t.range_scan("t", "v").count() == 3
    assert [r.name for r in t.catalog()["indexes"].collect()] == ["i"]
    t.timer.start()
    t.timer.start()
    t.timer.stop()
    t.timer.stop()


def test_snapshot_rules():
    s = Snapshot(5, 9, frozenset({6}))
    assert [x for x in range(-1, 12) if s.sees(x)] == [1, 2, 3, 4, 5, 7, 8]


def test_drop_register_history(t, spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/x.parquet")
    t.register("x", f"file://{tmp_path}/x.parquet")
    assert count(t, table="x") == 3
    with pytest.raises(StorageError):
        t.execute("DELETE FROM x")
    t.execute("DROP TABLE t")
    with pytest.raises(StorageError):
        t.execute("SELECT * FROM t")
    assert t.history().count() == 3


def test_shell(t):
    s = Shell(t)
    assert s.handle("INSERT INTO t VALUES (1, NULL);") == "OK, 1 row(s) affected"
    assert s.handle("SELECT * FROM t") == "id | v\n1 | NULL\n(1 row(s))"
    assert s.handle("commit").startswith("ERROR") and s.handle("").strip() == ""
    assert s.handle("begin transaction").startswith("BEGIN")
    assert s.handle("DELETE FROM t") == "OK, 1 row(s) affected"
    assert s.handle("SELECT nope FROM t").startswith("ERROR (transaction aborted): ")
    assert s.handle("SELECT COUNT(*) FROM t") == "count\n1\n(1 row(s))"
    s.handle("START TRANSACTION")
    s.handle("DELETE FROM t")
    assert s.handle("ROLLBACK") == "ABORT" and count(t) == 1


def test_stream(t, spark, tmp_path):
    from ferrule.streaming.sink import append_stream

    spark.range(4).selectExpr("id", "id * 2 AS v").write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        df = t.spark.readStream.schema("id long, v long").parquet(f"file://{tmp_path}/in")
        append_stream(t, df, "t", "s", f"file://{tmp_path}/marks").awaitTermination()
    assert count(t) == 4


def two(spark, tmp_path):
    root = f"file://{tmp_path}/shared"
    return Engine.open(spark, root), Engine.open(spark, root)


def test_two_engines_write_one_table(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("CREATE TABLE t (id INT)")
    one, other = a.begin(), b.begin()
    assert one.xid != other.xid
    a.execute("INSERT INTO t VALUES (1)", one)
    b.execute("INSERT INTO t VALUES (2)", other)
    a.commit(one)
    assert count(b, other) == 1  # what committed later is not in its snapshot
    b.commit(other)
    for e in (a, b, Engine.open(spark, a.store.files.root)):
        assert sorted(e.execute("SELECT id FROM t").rows()) == [(1,), (2,)]
    with pytest.raises(StorageError):
        b.execute("CREATE TABLE t (id INT)")
    a.execute("CREATE TABLE u (id INT)")
    b.execute("CREATE TABLE v (id INT)")
    assert len({m.id for m in Engine.open(spark, a.store.files.root).store.tables.values()}) == 3


def test_two_engines_conflict_at_commit(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("CREATE TABLE t (id INT, v INT)")
    a.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    one, other, third = a.begin(), b.begin(), b.begin()
    a.execute("UPDATE t SET v = 10 WHERE id = 1", one)
    b.execute("UPDATE t SET v = 20 WHERE id = 1", other)  # neither engine sees the other's staged work
    b.execute("UPDATE t SET v = 30 WHERE id = 2", third)
    a.commit(one)
    with pytest.raises(ConflictError):
        b.commit(other)
    b.commit(third)
    assert other.state == "aborted" and sorted(a.execute("SELECT * FROM t").rows()) == [(1, 10), (2, 30)]


def test_two_engines_insert_in_parallel(spark, tmp_path):
    engines = two(spark, tmp_path)
    engines[0].execute("CREATE TABLE t (id INT)")
    errors = []

    def work(k):
        try:
            for i in range(3):
                engines[k % 2].execute(f"INSERT INTO t VALUES ({10 * k + i})")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and sorted(engines[0].execute("SELECT id FROM t").rows()) == [(10 * k + i,) for k in range(4) for i in range(3)]


def test_vacuum_spares_other_engines(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("CREATE TABLE t (id INT)")
    a.execute("INSERT INTO t VALUES (1), (2)")
    reader, writer = b.begin(), b.begin()
    b.execute("INSERT INTO t VALUES (3)", writer)
    a.execute("DELETE FROM t WHERE id = 1")
    a.vacuum(grace=0)
    assert count(b, reader) == 2  # a deletion that it does not see is not carried out under it
    b.commit(reader)
    b.commit(writer)
    assert sorted(a.execute("SELECT id FROM t").rows()) == [(2,), (3,)]
    assert a.vacuum(grace=0) == 1 and count(b) == 2 == count(Engine.open(spark, a.store.files.root))


def test_lazy_results_outlive_vacuum(t):
    t.execute("INSERT INTO t VALUES (1, 1)")
    t.execute("INSERT INTO t VALUES (2, 2)")
    late = t.execute("SELECT id FROM t")
    t.execute("UPDATE t SET v = 3")
    t.execute("CREATE INDEX i ON t (v)")
    t.vacuum()
    assert sorted(late.rows()) == [(1,), (2,)]


def test_log_entries_are_whole_on_other_stores(spark, tmp_path):
    from ferrule.sources.files import Files

    f = Files(spark, f"file://{tmp_path}/x")
    f.make("")
    f.local = False  # as on a distributed file system: no links
    f.create("a", "one")
    with pytest.raises(FileExistsError):
        f.create("a", "two")
    assert f.read("a") == "one" and f.names("_tmp") == []


def test_status_recovery_flush(t, spark):
    one = t.begin()
    assert t.status(one.xid) == "active" and t.status(one.xid + 50) == "unknown"
    t.execute("INSERT INTO t VALUES (1, 1)", one)
    t.commit(one)
    two = t.begin()
    t.execute("INSERT INTO t VALUES (2, 2)", two)
    t.abort(two)
    lost = t.begin()
    t.execute("INSERT INTO t VALUES (3, 3)", lost)
    assert t.status(one.xid) == "committed" and t.status(two.xid) == "aborted" and t.flush() == 2
    t.crash()
    t = Engine.open(spark, t.store.files.root)
    assert t.recovery.committed == [one.xid] and t.recovery.undone == [lost.xid] and t.status(lost.xid) == "aborted"
    assert count(t) == 1 and Engine.open(spark, t.store.files.root).recovery.undone == []


def test_committed_numbers_are_runs():
    n = Numbers()
    for x in (5, 3, 4, 9, 1, 3, 8):
        n.add(x)
    assert n.runs == [[1, 1], [3, 5], [8, 9]] and 4 in n and 2 not in n and 0 not in n and list(n) == [1, 3, 4, 5, 8, 9] and len(n) == 6


def test_history_reads_across_checkpoints(t):
    for k in range(3):
        t.execute(f"INSERT INTO t VALUES ({k}, 0)")
        t.checkpoint()
    t.execute("INSERT INTO t VALUES (9, 0)")
    got = {r.number: r.entry for r in t.history().collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and "create" in got[1]
    assert sorted(r.number for r in t.history(2, 4).collect()) == [2, 3, 4]


def test_rows_by_address(t):
    t.execute("INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    at = t.addressed("t").filter("id >= 2").select("_xmin", "_stmt", "_seq").collect()
    spots = t.spark.createDataFrame(at, "_xmin long, _stmt long, _seq long")
    old = t.begin()
    t.execute("DELETE FROM t WHERE id = 3")
    assert t.fetch("t", spots).collect() == [(2, 20)] and sorted(t.fetch("t", spots, old).collect()) == [(2, 20), (3, 30)]
    t.commit(old)
    t.vacuum()
    assert t.fetch("t", spots).collect() == [(2, 20)]
