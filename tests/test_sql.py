"""Which statements the SQL front end takes, and by which name it rejects the others."""

import pytest

from millrace.errors import QueryError
from millrace.plans.engine import Engine
from millrace.plans.sql import parse


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.sql("SELECT 'm1' machine, cast(18.5 AS double) heat, cast(41 AS double) damp, timestamp_micros(1700000000000000) ts, parse_json('{\"t\":1}') extra, true up, array(1L, 2L) xs")
    e = Engine(spark)
    for name in ("meters", "other"):
        e.register_stream(name, df, ["ts"], "ts", "ts")
    e.register_table("sites", spark.sql("SELECT 'm1' id, 'hall' site, cast(0 AS bigint) a, cast(null AS bigint) b"), ["id"], "a", "b")
    e.register_table("places", spark.sql("SELECT 'm1' machine, 'hall' site"), ["machine"])
    return e


ACCEPTED = [
    "SELECT * FROM meters", "SELECT heat, damp FROM meters;", "SELECT heat AS h FROM meters", "SELECT m.heat h FROM meters m", "SELECT heat + 1 FROM meters -- a comment", 'SELECT "heat" FROM meters', "select machine from meters where heat > 20 and not up",
    "SELECT * FROM meters WHERE damp IS NOT NULL OR heat BETWEEN 10 AND 40", "SELECT * FROM meters WHERE machine NOT IN ('a', 'b') AND heat <> 0", "SELECT CAST(heat AS BIGINT), TRY_CAST(machine AS DOUBLE) d, SAFE_CAST(heat AS VARCHAR(10)) v FROM meters",
    "SELECT ABS(-heat) x, COALESCE(damp, 0) y, LOWER(machine) z FROM meters", "SELECT CAST(extra.t AS DOUBLE) + 1 e FROM meters", "SELECT CASE machine WHEN 'm1' THEN 1 ELSE 0 END c, up IS NOT TRUE n FROM meters", "SELECT heat % 2 m FROM meters",
    "SELECT machine, COUNT(*) n FROM meters GROUP BY machine, TUMBLE(ts, INTERVAL '1' MINUTE)", "SELECT COUNT(heat) n, window_end FROM meters GROUP BY TUMBLE(PROCTIME, 60000000)", "SELECT MAX(heat) FROM meters GROUP BY HOP(ts, INTERVAL '30' SECOND, INTERVAL '1' MINUTE, 5, 10)",
    "SELECT SUM(heat) s FROM meters GROUP BY machine, COUNT_WINDOW(3)", "SELECT AVG(heat) s, count_end e FROM meters GROUP BY machine, COUNT_WINDOW(3, 2)", "SELECT FIRST(heat) f FROM meters GROUP BY SLIDING(ts, INTERVAL 10 SECOND, 5)", "SELECT STDDEV_POP(heat) f FROM meters GROUP BY machine, SESSION(PROCESSING_TIME, 5, 10)",
    "SELECT m.heat, s.site FROM meters m LEFT JOIN places s ON s.machine = m.machine WHERE s.site = 'hall'", "SELECT m.heat, s.site FROM meters m JOIN sites FOR SYSTEM_TIME AS OF ts s ON m.machine = s.id", "SELECT * FROM meters m JOIN places p ON m.machine = p.machine",
    "SELECT a.heat, b.heat h FROM meters a LEFT JOIN other b ON a.machine = b.machine AND INTERVAL_MATCH(a.ts, b.ts, 5, INTERVAL '1' SECOND, 0)", "SELECT * FROM meters a JOIN other b ON a.machine = b.machine AND WINDOW_MATCH(a.ts, b.ts, 1000)", "SELECT m.machine, u.x, u.n FROM meters m CROSS JOIN UNNEST(m.xs) WITH ORDINALITY AS u(x, n) WHERE u.x > 1",
]
REJECTED = [
    ("SELECT heat FROM meters ORDER BY heat", "ORDER BY"), ("SELECT heat FROM meters LIMIT 3", "LIMIT"), ("SELECT heat FROM meters OFFSET 3", "OFFSET"), ("SELECT DISTINCT heat FROM meters", "DISTINCT"), ("SELECT TOP 3 heat FROM meters", "TOP"), ("SELECT heat FROM meters FETCH FIRST 1 ROWS ONLY", "FETCH"),
    ("SELECT machine FROM meters GROUP BY machine, TUMBLE(ts, 5) HAVING COUNT(*) > 1", "HAVING"), ("WITH x AS (SELECT 1) SELECT * FROM x", "CTE"), ("SELECT * FROM (SELECT * FROM meters)", "subquery"), ("SELECT * FROM meters WHERE machine IN (SELECT id FROM sites)", "subquery"), ("SELECT (SELECT 1) FROM meters", "subquery"),
    ("SELECT SUM(heat) OVER (PARTITION BY machine) FROM meters", "OVER"), ("SELECT RANK() OVER (ORDER BY heat) FROM meters", "OVER|RANK"), ("SELECT ROW_NUMBER() FROM meters", "ROW_NUMBER"), ("SELECT heat FROM meters UNION SELECT heat FROM other", "UNION"), ("SELECT heat FROM meters EXCEPT SELECT heat FROM other", "EXCEPT"),
    ("SELECT machine, SUM(heat) s FROM meters GROUP BY machine", "without a window"), ("SELECT SUM(heat) FROM meters", "GROUP BY"), ("SELECT TUMBLE(ts, 5) FROM meters", "TUMBLE"), ("SELECT COUNT(*) n FROM meters GROUP BY TUMBLE(ts, 5), HOP(ts, 5, 10)", "one window"), ("SELECT COUNT(DISTINCT heat) n FROM meters GROUP BY TUMBLE(ts, 5)", "DISTINCT"),
    ("SELECT SUM(heat) + 1 FROM meters GROUP BY TUMBLE(ts, 5)", "selects group keys"), ("SELECT heat, COUNT(*) n FROM meters GROUP BY machine, TUMBLE(ts, 5)", "selects group keys"), ("SELECT machine FROM meters GROUP BY machine, TUMBLE(ts, 5)", "aggregate"), ("SELECT COUNT(*) n FROM meters GROUP BY HOP(PROCTIME, 5, 10)", "unknown column"),
    ("SELECT COUNT(*) n FROM meters GROUP BY HOP(ts, 1, 100)", "overlap"), ("SELECT COUNT(*) n FROM meters GROUP BY TUMBLE(ts, 0)", "positive"), ("SELECT COUNT(*) n FROM meters GROUP BY SESSION(ts, 5)", "arguments"), ("SELECT COUNT(*) n FROM meters GROUP BY TUMBLE(ts, INTERVAL '1' MONTH)", "INTERVAL|unexpected|not supported"),
    ("SELECT * FROM meters, other", "cross join"), ("SELECT * FROM meters m RIGHT JOIN places p ON m.machine = p.machine", "RIGHT"), ("SELECT * FROM meters m FULL OUTER JOIN places p ON m.machine = p.machine", "FULL"), ("SELECT * FROM meters m CROSS JOIN places p", "CROSS"), ("SELECT * FROM meters m JOIN places p USING (machine)", "USING"),
    ("SELECT * FROM meters m JOIN places p ON m.heat > p.machine", "equal"), ("SELECT * FROM meters a JOIN other b ON a.machine = b.machine", "INTERVAL_MATCH"), ("SELECT machine FROM meters a JOIN other b ON a.machine = b.machine AND WINDOW_MATCH(a.ts, b.ts, 5)", "ambiguous"), ("SELECT * FROM meters m JOIN nowhere n ON m.machine = n.id", "unknown"),
    ("SELECT m.* FROM meters m", "wildcard"), ("SELECT mystery(heat) FROM meters", "mystery"), ("SELECT nope FROM meters", "nope"), ("SELECT * FROM nope", "nope"), ("SELECT extra + 1 FROM meters", "CAST"), ("SELECT machine + 1 FROM meters", "number"), ("SELECT * FROM meters WHERE heat", "Boolean"), ("SELECT heat h, damp h FROM meters", "repeat"),
    ("CREATE TABLE x (a INT)", "CREATE"), ("INSERT INTO meters VALUES (1)", "INSERT"), ("UPDATE meters SET heat = 1", "UPDATE"), ("DELETE FROM meters", "DELETE"), ("DROP TABLE meters", "DROP"), ("", "empty"), ("SELECT heat FROM meters WHERE EXISTS (SELECT 1)", "EXISTS"), ("SELECT heat FROM meters WHERE machine LIKE 'a%'", "LIKE"),
    ("SELECT COUNT(*) n FROM meters m CROSS JOIN UNNEST(m.xs) AS u(x) GROUP BY TUMBLE(ts, 5)", "GROUP BY"), ("SELECT heat FROM meters; SELECT 1", "not supported"), ("SELECT 'open FROM meters", "unexpected"),
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(engine, text):
    engine.sql(text).collect()


@pytest.mark.parametrize(("text", "names"), REJECTED, ids=[t for t, _ in REJECTED])
def test_rejected(engine, text, names):
    with pytest.raises(QueryError, match=names):
        engine.sql(text)


def test_precedence():
    e = parse("SELECT a OR b AND NOT c = 1 + 2 * 3 FROM t").items[0].expr
    assert e["op"] == "or" and e["right"]["op"] == "and" and e["right"]["right"]["k"] == "not"
    assert e["right"]["right"]["expr"]["right"]["right"]["op"] == "*"


def test_validate_and_explain(engine):
    assert engine.validate("SELECT heat FROM meters").names == ["heat"]
    text = engine.explain("SELECT machine, COUNT(*) n FROM meters WHERE heat > 5 GROUP BY machine, TUMBLE(ts, 5)")
    assert "identity:" in text and "state: aggregate" in text
    assert engine.explain("SELECT heat FROM meters").split("\n")[0] != engine.explain("SELECT damp FROM meters").split("\n")[0]


def test_finite_queries(engine, spark):
    own = spark.sql("SELECT 5 AS v UNION ALL SELECT 7")
    assert sorted(r["v"] for r in engine.query("SELECT v FROM mine WHERE v > 5", {"mine": own}).collect()) == [7]
    with pytest.raises(QueryError):
        engine.query("SELECT v FROM mine", {})
