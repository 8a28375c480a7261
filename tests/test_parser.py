import pytest

from ferrule import ParseError
from ferrule.sql import ast as A
from ferrule.sql import parse
from ferrule.sql.lexer import tokenize


def where(text):
    return parse(f"SELECT * FROM t WHERE {text}").where


def test_tokens_and_comments():
    kinds = [(t.kind, t.text) for t in tokenize("select a -- x\n, 'it''s' <> 1.5")]
    assert kinds == [("keyword", "SELECT"), ("name", "a"), ("sign", ","), ("text", "'it''s'"), ("sign", "<>"), ("float", "1.5"), ("end", "end of input")]


def test_precedence():
    e = where("a = 1 OR b = 2 AND NOT c = 3")
    assert e.op == "OR" and e.right.op == "AND" and e.right.right.op == "NOT"
    e = where("1 + 2 * -3 < 4 - 5 - 6")
    assert e.op == "<" and e.left.right.op == "*" and e.left.right.right.op == "-" and e.right.left.op == "-"
    assert where("a < b < c").left.op == "<"


def test_select_clauses():
    q = parse("SELECT a x, t.b AS y, COUNT(*), f(1, 2) FROM t u LEFT JOIN v ON u.a = v.a CROSS JOIN w ORDER BY x DESC, y LIMIT 3 OFFSET 4;")
    assert [i.alias for i in q.items] == ["x", "y", None, None]
    assert [j.kind for j in q.joins] == ["left", "cross"] and q.joins[1].on is None
    assert [k.ascending for k in q.order] == [False, True] and (q.limit, q.offset) == (3, 4)
    assert parse("SELECT a FROM t OFFSET 5").offset == 5
    assert parse("SELECT a FROM t LEFT OUTER JOIN u ON TRUE").joins[0].kind == "left"


def test_other_statements():
    assert parse("INSERT INTO t (a, b) VALUES (1, NULL), (TRUE, 'x')").rows[1] == (A.Literal(True), A.Literal("x"))
    assert parse("UPDATE t SET a = a + 1, b = 2 WHERE c").assignments[1] == ("b", A.Literal(2))
    assert parse("DELETE FROM t") == A.Delete("t")
    c = parse("CREATE TABLE moons (mass FLOAT NULL, named VARCHAR(40) NOT NULL, days INT, ringed BOOL)").columns
    assert [(x.name, x.type, x.nullable) for x in c] == [("mass", "FLOAT", True), ("named", "VARCHAR", False), ("days", "INT", True), ("ringed", "BOOL", True)]
    assert parse("CREATE INDEX i ON t (c)") == parse("CREATE INDEX i ON t c") == A.CreateIndex("i", "t", "c")
    assert parse("DROP TABLE t") == A.DropTable("t")


@pytest.mark.parametrize(
    "text, said",
    [
        ("", "a statement"), ("SELECT", "an expression"), ("SELECT 1", "'FROM'"), ("SELECT a FROM", "a table name"), ("SELECT a FROM t WHERE", "an expression"),
        ("SELECT a FROM t LIMIT x", "an integer"), ("SELECT a FROM t JOIN u", "'ON'"), ("SELECT a FROM t u v w", "end of input"), ("INSERT INTO t VALUES 1", "'('"),
        ("CREATE TABLE t (a BLOB)", "a column type"), ("SELECT 'x FROM t", "unterminated string"), ("SELECT a ! b FROM t", "did you mean '!='"), ("SELECT a # b FROM t", "'#'"),
        ("SELECT DISTINCT a FROM t", "unsupported"), ("SELECT a FROM t GROUP BY a", "unsupported"), ("SELECT 9223372036854775808 FROM t", "64 bits"), ("SELECT a FROM t FULL JOIN u ON TRUE", "unsupported"),
    ],
)
def test_errors_say_where(text, said):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert said in str(e.value) and "expected" in str(e.value) and "found" in str(e.value) and "position" in str(e.value) and text in str(e.value)
