import math

import pytest

from ferrule import EngineError
from ferrule.errors import AnalysisError


def rows(engine, sql):
    return engine.execute(sql).rows()


def test_filter_project_sort(moons):
    assert rows(moons, "SELECT name FROM moons WHERE days > 5 ORDER BY days DESC LIMIT 2") == [("oberon",), ("ariel",)]
    assert moons.execute("SELECT id, days + 1, days AS d FROM moons").columns == ["id", "col2", "d"]
    assert moons.execute("SELECT *, id * 2 AS d FROM moons").columns == ["id", "days", "name", "d"]
    assert rows(moons, "SELECT id FROM moons ORDER BY name DESC") == [(4,), (3,), (2,), (1,)]
    assert rows(moons, "SELECT id FROM moons ORDER BY id LIMIT 2 OFFSET 3") == [(4,)]
    assert rows(moons, "SELECT id FROM moons LIMIT 0") == [] == rows(moons, "SELECT id FROM moons OFFSET 9")


def test_two_valued_logic(engine):
    engine.execute("CREATE TABLE t (id INT, v INT, b BOOL)")
    engine.execute("INSERT INTO t VALUES (1, NULL, NULL), (2, 1, TRUE), (3, 2, FALSE)")
    assert rows(engine, "SELECT id FROM t WHERE NOT v = 1 ORDER BY id") == [(1,), (3,)]
    assert rows(engine, "SELECT id FROM t WHERE v = NULL OR NOT (v <> NULL) ORDER BY id") == [(1,), (2,), (3,)]
    assert rows(engine, "SELECT v = 1 AS x, b FROM t ORDER BY id") == [(False, None), (True, True), (False, False)]
    assert rows(engine, "SELECT id FROM t WHERE b") == [(2,)] and rows(engine, "SELECT id FROM t WHERE 1") == []
    assert rows(engine, "SELECT COUNT(*), COUNT(v), COUNT(v = 1), COUNT(b) FROM t") == [(3, 2, 3, 2)]
    assert rows(engine, "SELECT id FROM t ORDER BY v DESC") == [(3,), (2,), (1,)] and rows(engine, "SELECT id FROM t ORDER BY v") == [(2,), (3,), (1,)]


def test_arithmetic(engine):
    engine.execute("CREATE TABLE t (a INT, b INT, x FLOAT, z FLOAT)")
    engine.execute("INSERT INTO t VALUES (-7, 2, 1.5, 0.0), (9223372036854775807, 1, -1.0, 0.0)")
    got = rows(engine, "SELECT a / b, a + b, a * 1.0, x / z, -x FROM t ORDER BY b DESC")
    assert got[0] == (-3, -5, -7.0, math.inf, -1.5) and got[1][1] == -(1 << 63) and got[1][3] == -math.inf
    assert math.isnan(rows(engine, "SELECT z / z FROM t LIMIT 1")[0][0])
    with pytest.raises(Exception, match="division by zero"):
        rows(engine, "SELECT a / (b - b) FROM t")
    assert rows(engine, "SELECT b FROM t WHERE b <> 2 AND a / (b - 2) < 0") == [(1,)]
    for bad in ("SELECT a + 'x' FROM t", "SELECT a FROM t WHERE a = 'x'", "SELECT nope FROM t", "SELECT q.a FROM t", "SELECT SUM(a) FROM t", "SELECT a, COUNT(*) FROM t", "SELECT a FROM t WHERE COUNT(a) > 1"):
        with pytest.raises(AnalysisError):
            rows(engine, bad)


def test_joins(engine):
    engine.execute("CREATE TABLE a (id INT NOT NULL, av INT)")
    engine.execute("CREATE TABLE b (aid INT, bv INT)")
    engine.execute("INSERT INTO a VALUES (1, 100), (2, 200), (3, 300), (4, 400), (5, 500), (6, 600)")
    engine.execute("INSERT INTO b VALUES (1, 1), (2, 2), (2, 3), (3, 4), (5, 5), (99, 6), (NULL, 7)")
    assert len(rows(engine, "SELECT * FROM a JOIN b ON a.id = b.aid")) == 5
    assert len(rows(engine, "SELECT * FROM a CROSS JOIN b")) == 42
    assert len(rows(engine, "SELECT * FROM a LEFT JOIN b ON a.id = b.aid AND b.bv > 2")) == 6
    assert len(rows(engine, "SELECT * FROM a RIGHT JOIN b ON id = aid")) == 7
    assert rows(engine, "SELECT x.id, y.id FROM a x JOIN a y ON x.id > y.id WHERE x.av = 200") == [(2, 1)]
    assert engine.execute("SELECT * FROM a x JOIN a y ON x.id = y.id WHERE x.id > 10").columns == ["id", "av", "id", "av"]
    assert rows(engine, "SELECT COUNT(*) FROM a JOIN b ON a.id = b.aid AND a.id > 2") == [(2,)]
    with pytest.raises(AnalysisError, match="duplicate"):
        rows(engine, "SELECT * FROM a JOIN a ON a.id = a.id")


def test_plans(moons):
    def text(sql):
        return moons.execute(sql).df._jdf.queryExecution().toString()

    assert "BroadcastHashJoin" in text("SELECT x.id FROM moons x JOIN moons y ON x.id = y.days WHERE x.days > 1 AND y.id > 2")
    assert "PushedFilters: [IsNotNull(days), GreaterThan(days,5)]" in text("SELECT id FROM moons WHERE days > 5")
    assert "TakeOrderedAndProject" in text("SELECT id FROM moons ORDER BY name LIMIT 2")
    assert "name" not in text("SELECT id FROM moons WHERE days > 5").split("ReadSchema")[1].split("\n")[0]


def test_explain_and_statistics(moons):
    s = moons.analyze("moons")
    assert s.rows == 4 and s.columns["days"].low == 3 and s.columns["days"].distinct == 4
    said = moons.explain("SELECT id FROM moons WHERE days > 5 ORDER BY id LIMIT 1")
    assert "moons: 4 rows" in said and "Physical Plan" in said and "sizeInBytes" in said


def test_closed(moons):
    moons.close()
    with pytest.raises(EngineError):
        moons.execute("SELECT * FROM moons")
