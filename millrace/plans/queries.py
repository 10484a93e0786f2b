"""The registered queries over the star schema and the event stream, each beside its DuckDB SQL.

Event time is ``ts`` in UTC microseconds, arrival order ``event_id``, the key
``user_id``.  Floats are rounded on both sides, since sums depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expr import select
from millrace.operators import joins, routing, state, windows
from millrace.plans.engine import Engine
from millrace.plans.sql import parse

HOUR = 3_600_000_000
DAY = 24 * HOUR
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle where SQL can express it."""

    def add(of: Query) -> Query:
        QUERIES[name] = of
        if sql:
            ORACLE[name] = sql
        return of

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with event time ``t`` in microseconds; the raw time column is not read twice."""
    df = table(spark, sf_dir, "events")
    return df.withColumn("t", windows.micros(F.col("ts"), df.schema["ts"].dataType)).drop("ts")


def engine(spark: SparkSession, sf_dir: str, names: set[str]) -> Engine:
    """An engine that knows the named streams and tables; what a query does not name is not opened."""
    e = Engine(spark)
    raw = lambda name: table(spark, sf_dir, name)
    streams = {
        "events": (lambda: events(spark, sf_dir), ["event_id"], "t"),
        "readings": (lambda: events(spark, sf_dir).filter("event_type in ('click', 'view')"), ["event_id"], "t"),
        "orders": (lambda: raw("orders"), ["o_orderkey"], None),
        "lineitem": (lambda: raw("lineitem"), ["l_orderkey", "l_linenumber"], None),
        "documents": (lambda: raw("documents"), ["doc_id"], None),
    }
    tables = {
        "customer": (lambda: raw("customer"), ["c_custkey"]),
        "part": (lambda: raw("part"), ["p_partkey"]),
        "segments": (lambda: versions(spark, sf_dir), ["seg_key"], "valid_from", "valid_to"),
    }
    for name in names:
        if name in streams:
            of, order, time = streams[name]
            e.register_stream(name, of(), order, time, time)
        else:
            of, *rest = tables[name]
            e.register_table(name, of(), *rest)
    return e


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table made of customers: two half-open slices each, with a gap before the first."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seg_key"), "c_mktsegment", (F.lit(1_704_067_200_000_000) + (F.col("c_custkey") % 10) * DAY).alias("first"))
    old = c.select("seg_key", F.col("c_mktsegment").alias("segment"), F.col("first").alias("valid_from"), (F.col("first") + 7 * DAY).alias("valid_to"))
    new = c.select("seg_key", F.concat("c_mktsegment", F.lit("+")).alias("segment"), (F.col("first") + 7 * DAY).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return old.unionByName(new)


def by_sql(name: str, text: str, oracle: str, rounded: tuple[str, ...] = (), digits: int = 6) -> None:
    """A query in the engine's dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = parse(text)
        df = engine(spark, sf_dir, {q.table} | ({q.join.table} if q.join and q.join.table else set())).sql(text)
        return df.withColumns({c: F.round(c, digits) for c in rounded}) if rounded else df

    query(name, oracle)(run)


def col(name: str) -> dict:
    return {"k": "col", "name": name}


def lit(v) -> dict:
    kind = {bool: "bool", int: "int64", float: "float64", str: "utf8", type(None): "null"}[type(v)]
    return {"k": "lit", "value": {"t": kind} | ({} if v is None else {"v": v})}


def call(name: str, *args) -> dict:
    return {"k": "call", "name": name, "args": [a if isinstance(a, dict) else lit(a) for a in args]}


def op(o: str, a, b) -> dict:
    return {"k": "bin", "op": o, "left": a if isinstance(a, dict) else lit(a), "right": b if isinstance(b, dict) else lit(b)}


def projection(name: str, source: str, items: list[tuple[dict, str]], oracle: str, rounded: tuple[str, ...] = ()) -> None:
    """A projection written as an expression tree."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = select(events(spark, sf_dir) if source == "events" else table(spark, sf_dir, source), items)
        return df.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else df

    query(name, oracle)(run)


EV = "SELECT *, epoch_us(ts) AS t FROM events"

# filters, projections, operators, casts

by_sql("filter_project", "SELECT event_id, user_id, value * 2 AS twice FROM events WHERE value > 100 AND event_type <> 'click'", "SELECT event_id, user_id, value * 2 AS twice FROM events WHERE value > 100 AND event_type <> 'click'")
by_sql("between_in_not", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 10000 AND 50000 AND o_orderstatus IN ('O', 'F') AND NOT o_orderpriority = '1-URGENT'", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 10000 AND 50000 AND o_orderstatus IN ('O', 'F') AND NOT o_orderpriority = '1-URGENT'")
by_sql("three_valued_logic", "SELECT event_id, NULLIF(event_type, 'click') IS NULL AS c, (NULLIF(event_type, 'click') = 'view' OR value > 50) AS d FROM events WHERE NOT (NULLIF(event_type, 'view') = 'click' AND value < 10)", "SELECT event_id, nullif(event_type, 'click') IS NULL AS c, (nullif(event_type, 'click') = 'view' OR value > 50) AS d FROM events WHERE NOT (nullif(event_type, 'view') = 'click' AND value < 10)")
by_sql("select_star", "SELECT * FROM orders WHERE o_totalprice < 20000", "SELECT * FROM orders WHERE o_totalprice < 20000")
by_sql("int_div_null", "SELECT l_orderkey, l_linenumber, l_partkey / (l_linenumber - 3) AS q, l_quantity / (l_discount * 0) AS n, -l_partkey / 7 AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey // (l_linenumber - 3) END AS q, CAST(NULL AS DOUBLE) AS n, -(l_partkey // 7) AS m FROM lineitem")
by_sql("checked_arith", "SELECT l_orderkey, l_linenumber, l_orderkey * 3 + l_partkey - l_suppkey AS a, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_quantity >= 25", "SELECT l_orderkey, l_linenumber, l_orderkey * 3 + l_partkey - l_suppkey AS a, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem WHERE l_quantity >= 25", ("charge",))
by_sql("casts", "SELECT event_id, CAST(value AS BIGINT) AS whole, CAST(event_id AS DOUBLE) AS f, TRY_CAST(event_type AS BIGINT) AS bad, TRY_CAST(SUBSTRING(props, 7, 2) AS BIGINT) AS k FROM events", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, CAST(event_id AS DOUBLE) AS f, TRY_CAST(event_type AS BIGINT) AS bad, CASE WHEN regexp_matches(substring(props, 7, 2), '^[0-9]+$') THEN CAST(substring(props, 7, 2) AS BIGINT) END AS k FROM events")
by_sql("case_is_true", "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band, (value > 100) IS TRUE AS hot, -value AS neg FROM events", "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band, (value > 100) IS TRUE AS hot, -value AS neg FROM events")

# scalar functions by family

projection("text_functions", "customer", [(col("c_custkey"), "c_custkey"), (call("length", col("c_name")), "n"), (call("concat", col("c_name"), "/", col("c_mktsegment")), "joined"), (call("substring", col("c_name"), 10, 4), "part"), (call("replace", col("c_mktsegment"), "E", "-"), "rep"), (call("contains", col("c_mktsegment"), "HINE"), "has"), (call("starts_with", col("c_mktsegment"), "B"), "starts"), (call("ends_with", col("c_mktsegment"), "Y"), "ends"), (call("trim", call("concat", " \t", col("c_mktsegment"), " ")), "trimmed")],
           "SELECT c_custkey, length(c_name) AS n, c_name || '/' || c_mktsegment AS joined, substring(c_name, 10, 4) AS part, replace(c_mktsegment, 'E', '-') AS rep, contains(c_mktsegment, 'HINE') AS has, starts_with(c_mktsegment, 'B') AS starts, ends_with(c_mktsegment, 'Y') AS ends, c_mktsegment AS trimmed FROM customer")
projection("ascii_case", "documents", [(col("doc_id"), "doc_id"), (call("sha256", call("lower", col("text"))), "low"), (call("sha256", call("upper", col("text"))), "up"), (call("char_length", col("text")), "n")],
           "SELECT doc_id, sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS low, sha256(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS up, length(text) AS n FROM documents")
projection("math_functions", "events", [(col("event_id"), "event_id"), (call("abs", op("-", 50, col("value"))), "a"), (call("round", col("value")), "r"), (call("floor", col("value")), "f"), (call("ceil", col("value")), "c"), (call("greatest", col("value"), 100.0, lit(None)), "g"), (call("least", col("value"), 100.0), "l"), (call("coalesce", lit(None), col("user_id"), 1), "co"), (call("nullif", col("user_id"), 3), "ni")],
           "SELECT event_id, round(abs(50 - value), 6) AS a, round(value) AS r, floor(value) AS f, ceil(value) AS c, greatest(value, 100.0) AS g, least(value, 100.0) AS l, user_id AS co, nullif(user_id, 3) AS ni FROM events", ("a",))
projection("conversions", "events", [(col("event_id"), "event_id"), (call("to_int64", col("value")), "i"), (call("to_float64", call("to_string", col("event_id"))), "f"), (call("to_string", col("user_id")), "s"), (call("to_int64", call("concat", "1", call("to_string", col("user_id")))), "j")],
           "SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, CAST(event_id AS DOUBLE) AS f, CAST(user_id AS VARCHAR) AS s, CAST('1' || user_id AS BIGINT) AS j FROM events")
projection("json_get_pointer", "events", [(col("event_id"), "event_id"), (call("to_int64", call("json_get", col("props"), "/k")), "k"), ({"k": "is_null", "expr": call("json_get", col("props"), "/none")}, "none")],
           "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS none FROM events")
projection("json_build", "events", [(col("event_id"), "event_id"), (call("json_stringify", call("json_object", "a", col("user_id"), "b", col("event_type"), "c", lit(None))), "doc")],
           "SELECT event_id, '{\"a\":' || user_id || ',\"b\":\"' || event_type || '\",\"c\":null}' AS doc FROM events")
projection("encode_hash", "documents", [(col("doc_id"), "doc_id"), (call("sha256", call("base64_encode", col("text"))), "b"), (call("sha256", call("hex_encode", col("text"))), "h"), (call("sha256", call("base64_decode", call("base64_encode", col("text")))), "bd"), (call("sha256", call("hex_decode", call("hex_encode", col("text")))), "hd")],
           "SELECT doc_id, sha256(base64(encode(text))) AS b, sha256(lower(hex(encode(text)))) AS h, sha256(text) AS bd, sha256(text) AS hd FROM documents")
projection("collections", "documents", [(col("doc_id"), "doc_id"), (call("array_length", call("split", col("source"), "r")), "n"), (call("array_get", call("split", col("source"), "r"), 1), "one"), (call("array_get", call("split", col("source"), "r"), 9), "none"), (call("array_contains", call("split", col("source"), "r"), "s"), "has"), (call("array_join", call("array_append", call("array_concat", call("split", col("source"), "r"), call("split", col("lang"), "e")), "z"), "|"), "joined"), (call("array_join", call("array_slice", call("split", col("source"), "r"), 1, 5), "|"), "tail")],
           "WITH d AS (SELECT doc_id, string_split(source, 'r') AS a, string_split(lang, 'e') AS b FROM documents) SELECT doc_id, len(a) AS n, a[2] AS one, a[10] AS none, list_contains(a, 's') AS has, array_to_string(list_append(list_concat(a, b), 'z'), '|') AS joined, array_to_string(a[2:6], '|') AS tail FROM d")


@query("objects", "SELECT event_id, 'user,type' AS keys, CAST(user_id AS VARCHAR) AS one, false AS has, 'type' AS rest, event_type || '!' AS changed FROM events")
def objects(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("m", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")))
    m = col("m")
    return select(df, [(col("event_id"), "event_id"), (call("array_join", call("object_keys", m), ","), "keys"), (call("array_get", call("object_values", m), 0), "one"), (call("object_has_key", m, "none"), "has"), (call("array_join", call("object_keys", call("object_remove", m, "user")), ","), "rest"), (call("object_get", call("object_set", m, "type", call("concat", col("event_type"), "!")), "type"), "changed")])


@query("ts_format_parse", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, epoch_us(ts) AS back FROM events")
def ts_format_parse(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("at", F.timestamp_micros("t"))
    text = call("format_timestamp", col("at"))
    return select(df, [(col("event_id"), "event_id"), (text, "text"), (call("to_int64", call("parse_timestamp", text)), "back")])


# windows

AGGS = "COUNT(*) AS n, SUM(value) AS s, AVG(value) AS a, MIN(value) AS lo, MAX(value) AS hi, FIRST(event_type) AS f, LAST(event_type) AS l"
ORACLE_AGGS = "count(*) AS n, round(sum(value), 6) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, arg_min(event_type, (t, event_id)) AS f, arg_max(event_type, (t, event_id)) AS l"
FRAME = "count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s, round(avg(value) OVER w, 6) AS a, min(value) OVER w AS lo, max(value) OVER w AS hi"
ROUND = ("s", "a")
by_sql("tumble_aggs", f"SELECT user_id, window_start, window_end, {AGGS} FROM events WHERE value > 5 GROUP BY user_id, TUMBLE(t, INTERVAL '24' HOUR)", f"SELECT user_id, t // {DAY} * {DAY} AS window_start, t // {DAY} * {DAY} + {DAY} AS window_end, {ORACLE_AGGS} FROM ({EV}) WHERE value > 5 GROUP BY ALL", ROUND)
by_sql("tumble_processing", f"SELECT window_start, {AGGS} FROM events GROUP BY TUMBLE(PROCESSING_TIME, INTERVAL '6' HOUR)", f"SELECT t // {6 * HOUR} * {6 * HOUR} AS window_start, {ORACLE_AGGS} FROM ({EV}) GROUP BY ALL", ROUND)
by_sql("hop_aggs", f"SELECT user_id, window_start, {AGGS} FROM events GROUP BY user_id, HOP(t, INTERVAL '12' HOUR, INTERVAL '48' HOUR)", f"SELECT user_id, s0 AS window_start, {ORACLE_AGGS} FROM (SELECT *, unnest([t // {12 * HOUR} * {12 * HOUR} - i * {12 * HOUR} FOR i IN range(4)]) AS s0 FROM ({EV})) GROUP BY ALL", ROUND)
by_sql("hop_processing", "SELECT event_type, window_end, COUNT(*) AS n FROM events GROUP BY event_type, HOP(PROCESSING_TIME, INTERVAL '24' HOUR, INTERVAL '72' HOUR)", f"SELECT event_type, s0 + {3 * DAY} AS window_end, count(*) AS n FROM (SELECT *, unnest([t // {DAY} * {DAY} - i * {DAY} FOR i IN range(3)]) AS s0 FROM ({EV})) GROUP BY ALL")
by_sql("extended_stats", "SELECT event_type, window_start, VAR_POP(value) AS vp, VAR_SAMP(value) AS vs, STDDEV_POP(value) AS sp, STDDEV_SAMP(value) AS ss FROM events GROUP BY event_type, TUMBLE(t, INTERVAL '24' HOUR)", f"SELECT event_type, t // {DAY} * {DAY} AS window_start, round(var_pop(value), 6) AS vp, round(var_samp(value), 6) AS vs, round(stddev_pop(value), 6) AS sp, round(stddev_samp(value), 6) AS ss FROM ({EV}) GROUP BY ALL", ("vp", "vs", "sp", "ss"))
by_sql("count_tumble", f"SELECT user_id, count_start, count_end, {AGGS} FROM events GROUP BY user_id, COUNT_WINDOW(8)", f"SELECT user_id, 0::BIGINT AS count_start, 8::BIGINT AS count_end, {ORACLE_AGGS} FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS g FROM ({EV})) GROUP BY user_id, g HAVING count(*) = 8", ROUND)
by_sql("count_sliding", "SELECT user_id, count_start, count_end, COUNT(*) AS n, SUM(value) AS s, AVG(value) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY user_id, COUNT_WINDOW(5, 2)", f"SELECT user_id, rn - 5 AS count_start, rn AS count_end, n, s, a, lo, hi FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, {FRAME} FROM ({EV}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE rn >= 5 AND rn % 2 = 0", ROUND)
by_sql("sliding_et", "SELECT user_id, window_start, window_end, COUNT(*) AS n, SUM(value) AS s, AVG(value) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY user_id, SLIDING(t, INTERVAL '24' HOUR)", f"SELECT user_id, t - {DAY} + 1 AS window_start, t + 1 AS window_end, {FRAME} FROM ({EV}) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)", ROUND)
by_sql("sliding_et_delay", "SELECT user_id, window_start, window_end, COUNT(*) AS n, SUM(value) AS s, AVG(value) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY user_id, SLIDING(t, INTERVAL '24' HOUR, INTERVAL '6' HOUR)", f"SELECT user_id, t - {DAY} + 1 AS window_start, t + {6 * HOUR} + 1 AS window_end, {FRAME} FROM ({EV}) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND {6 * HOUR} FOLLOWING)", ROUND)
by_sql("sliding_processing", "SELECT user_id, window_end, COUNT(*) AS n, SUM(value) AS s, MAX(value) AS hi FROM events GROUP BY user_id, SLIDING(PROCESSING_TIME, INTERVAL '24' HOUR)", f"SELECT user_id, t + 1 AS window_end, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s, max(value) OVER w AS hi FROM ({EV}) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)", ("s",))
SESSION_SQL = """
    WITH RECURSIVE e AS (SELECT user_id, value, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
    f AS (SELECT user_id, value, event_id, t, rn, t AS first FROM e WHERE rn = 1
          UNION ALL
          SELECT e.user_id, e.value, e.event_id, e.t, e.rn, CASE WHEN e.t >= least(f.t + {gap}, f.first + {most}) THEN e.t ELSE f.first END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, first AS window_start, least(max(t) + {gap}, first + {most}) AS window_end, count(*) AS n, round(sum(value), 6) AS s FROM f GROUP BY user_id, first
"""
by_sql("session_gap", "SELECT user_id, window_start, window_end, COUNT(*) AS n, SUM(value) AS s FROM events GROUP BY user_id, SESSION(t, INTERVAL '8' HOUR, INTERVAL '9000' HOUR)", SESSION_SQL.format(gap=8 * HOUR, most=9000 * HOUR), ("s",))
by_sql("session_max_duration", "SELECT user_id, window_start, window_end, COUNT(*) AS n, SUM(value) AS s FROM events GROUP BY user_id, SESSION(t, INTERVAL '12' HOUR, INTERVAL '20' HOUR)", SESSION_SQL.format(gap=12 * HOUR, most=20 * HOUR), ("s",))
by_sql("session_processing", "SELECT user_id, window_start, window_end, COUNT(*) AS n, SUM(value) AS s FROM events GROUP BY user_id, SESSION(PROCESSING_TIME, INTERVAL '8' HOUR, INTERVAL '48' HOUR)", SESSION_SQL.format(gap=8 * HOUR, most=48 * HOUR), ("s",))


@query("late_rows", f"""
    WITH e AS (SELECT event_id, (event_id * 7919) % 10007 AS arrival, epoch_us(ts) AS t FROM events),
    m AS (SELECT *, greatest(coalesce(max(t) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {HOUR}, 0), 0) - {DAY} AS mark FROM e)
    SELECT event_id, t // {DAY} * {DAY} + {DAY} <= mark AND mark > 0 AS late FROM m
""")
def late_rows(spark, sf_dir):
    shuffled = events(spark, sf_dir).withColumn("arrival", (F.col("event_id") * 7919) % 10007)
    return windows.late_split(shuffled, "t", ["arrival", "event_id"], DAY, out_of_orderness=HOUR, lateness=DAY).select("event_id", "late")


# joins and lookups

by_sql("lookup_left", "SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
by_sql("lookup_where_after", "SELECT l.l_orderkey, l.l_linenumber, p.p_brand, l.l_quantity * p.p_retailprice AS worth FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 25 AND l.l_quantity > 10", "SELECT l_orderkey, l_linenumber, p_brand, round(l_quantity * p_retailprice, 6) AS worth FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 AND l_quantity > 10", ("worth",))
by_sql("versioned_lookup", "SELECT e.event_id, e.user_id, s.segment FROM events e LEFT JOIN segments FOR SYSTEM_TIME AS OF t s ON e.user_id = s.seg_key",
       f"WITH c AS (SELECT c_custkey, c_mktsegment AS seg, 1704067200000000 + (c_custkey % 10) * {DAY} AS f FROM customer), s AS (SELECT c_custkey AS k, seg AS segment, f AS a, f + {7 * DAY} AS b FROM c UNION ALL SELECT c_custkey, seg || '+', f + {7 * DAY}, NULL FROM c) SELECT event_id, user_id, segment FROM ({EV}) LEFT JOIN s ON user_id = k AND t >= a AND (b IS NULL OR t < b)")


@query("lookup_multi_key", "SELECT s_suppkey, n_name, n_regionkey FROM supplier LEFT JOIN (SELECT n_nationkey, n_nationkey % 5 AS bucket, n_name, n_regionkey FROM nation) ON s_nationkey = n_nationkey AND s_suppkey % 5 = bucket")
def lookup_multi_key(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").withColumn("mod", F.col("s_suppkey") % 5)
    nation = table(spark, sf_dir, "nation").withColumn("bucket", (F.col("n_nationkey") % 5).cast("long"))
    return joins.lookup(supplier, nation, [("s_nationkey", "n_nationkey"), ("mod", "bucket")], ["n_name", "n_regionkey"]).select("s_suppkey", "n_name", "n_regionkey")


PAIR = f"({EV} WHERE event_type IN ('click', 'view'))"
BOUNDS = f"b.t BETWEEN a.t - {HOUR} AND a.t + {2 * HOUR}"
by_sql("interval_join_inner", "SELECT a.event_id AS x, b.event_id AS y, join_time FROM events a JOIN readings b ON a.user_id = b.user_id AND INTERVAL_MATCH(a.t, b.t, INTERVAL '1' HOUR, INTERVAL '2' HOUR)", f"SELECT a.event_id AS x, b.event_id AS y, greatest(a.t, b.t) AS join_time FROM ({EV}) a JOIN {PAIR} b ON a.user_id = b.user_id AND {BOUNDS}")
by_sql("interval_join_left", "SELECT a.event_id AS x, b.event_id AS y, join_time, join_left_ordinal, join_right_ordinal FROM events a LEFT JOIN readings b ON a.user_id = b.user_id AND INTERVAL_MATCH(a.t, b.t, INTERVAL '1' HOUR, INTERVAL '2' HOUR)", f"SELECT a.event_id AS x, b.event_id AS y, CASE WHEN b.t IS NULL THEN a.t ELSE greatest(a.t, b.t) END AS join_time, a.n AS join_left_ordinal, b.n AS join_right_ordinal FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM ({EV})) a LEFT JOIN (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM {PAIR}) b ON a.user_id = b.user_id AND {BOUNDS}")
by_sql("window_join_inner", "SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN readings b ON a.user_id = b.user_id AND WINDOW_MATCH(a.t, b.t, INTERVAL '6' HOUR)", f"SELECT a.event_id AS x, b.event_id AS y FROM ({EV}) a JOIN {PAIR} b ON a.user_id = b.user_id AND a.t // {6 * HOUR} = b.t // {6 * HOUR}")
by_sql("window_join_left", "SELECT a.event_id AS x, b.event_id AS y, join_time FROM events a LEFT JOIN readings b ON a.user_id = b.user_id AND WINDOW_MATCH(a.t, b.t, INTERVAL '6' HOUR)", f"SELECT a.event_id AS x, b.event_id AS y, CASE WHEN b.t IS NULL THEN a.t ELSE greatest(a.t, b.t) END AS join_time FROM ({EV}) a LEFT JOIN {PAIR} b ON a.user_id = b.user_id AND a.t // {6 * HOUR} = b.t // {6 * HOUR}")
by_sql("unnest_ordinality", "SELECT d.doc_id, u.item, u.ord, unnest_input FROM documents d CROSS JOIN UNNEST(SPLIT(d.source, 'r')) WITH ORDINALITY AS u(item, ord)", "SELECT doc_id, unnest(string_split(source, 'r')) AS item, unnest(range(1, len(string_split(source, 'r')) + 1)) AS ord, n AS unnest_input FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents)")


@query("unnest_embeddings", "SELECT vec_id, round(unnest(embedding)::DOUBLE, 5) + 0.0 AS item, unnest(range(1, len(embedding) + 1)) AS unnest_ordinal FROM embeddings")
def unnest_embeddings(spark, sf_dir):
    out = joins.unnest(table(spark, sf_dir, "embeddings"), col("embedding"), max_rows=4096)
    return out.select("vec_id", (F.round(F.col("item").cast("double"), 5) + 0.0).alias("item"), "unnest_ordinal")


@query("external_lookup", "SELECT event_id, user_id, user_id * 10 AS score, 'u' || user_id AS label FROM events")
def external_lookup(spark, sf_dir):
    from pyspark.sql import types as T

    added = T.StructType([T.StructField("score", T.LongType()), T.StructField("label", T.StringType())])
    df = events(spark, sf_dir).select("event_id", "user_id")
    return joins.external_lookup(df, ["user_id"], lambda keys: {k: {"score": k[0] * 10, "label": f"u{k[0]}"} for k in keys}, added)


# routing

CASES = [(op(">", col("o_totalprice"), 200000.0), "big"), (op("=", col("o_orderstatus"), "F"), "done")]


def routed(spark, sf_dir, mode):
    outs = routing.route(table(spark, sf_dir, "orders"), CASES, "rest", mode)
    return routing.union_all([df.select("o_orderkey", F.lit(name).alias("to")) for name, df in outs.items()])


query("route_first_match", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS \"to\" FROM orders")(lambda s, d: routed(s, d, "first_match"))
query("route_all_match", "SELECT o_orderkey, 'big' AS \"to\" FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'done' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'rest' FROM orders WHERE NOT (o_totalprice > 200000 OR o_orderstatus = 'F')")(lambda s, d: routed(s, d, "all_match"))


@query("branch_union", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def branch_union(spark, sf_dir):
    both = routing.branch(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["a", "b"])
    return routing.union_all([both["a"], routing.filter_rows(both["b"], op(">", col("o_totalprice"), 100000.0))])


@query("rule_reject", "SELECT event_id FROM events WHERE NOT coalesce(nullif(event_type, 'click') = 'view', false)")
def rule_reject(spark, sf_dir):
    return routing.rejected(events(spark, sf_dir), op("=", call("nullif", col("event_type"), "click"), "view")).select("event_id")


@query("graph_filter_window", f"SELECT user_id, t // {DAY} * {DAY} AS window_start, t // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS n, max(value) AS hi FROM ({EV}) WHERE value > 25 GROUP BY ALL")
def graph_filter_window(spark, sf_dir):
    spec = {"version": 1, "pipeline_id": 1, "revision_id": 1, "nodes": [
        {"id": 1, "kind": "memory_source", "table": "events", "event_time_field": "t", "out": [2]},
        {"id": 2, "kind": "filter", "predicate": op(">", col("value"), 25.0), "out": [3]},
        {"id": 3, "kind": "window_agg", "window": {"kind": "event_time", "size_micros": DAY, "event_time_field": "t"}, "keys": ["user_id"], "aggs": [{"fn": "count", "alias": "n"}, {"fn": "max", "expr": col("value"), "alias": "hi"}], "out": [4]},
        {"id": 4, "kind": "capture_sink", "name": "out"},
    ]}
    return engine(spark, sf_dir, {"events"}).graph(spec)["out"]


# keyed state

LAG = "lag({c}) OVER (PARTITION BY user_id ORDER BY event_id)"


@query("change_detect", f"SELECT event_id, user_id, event_type FROM (SELECT *, {LAG.format(c='event_type')} AS p FROM events) WHERE p IS NULL OR p <> event_type")
def change_detect(spark, sf_dir):
    return state.change_detect(events(spark, sf_dir), ["user_id"], ["event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


@query("deadband_last_input", f"SELECT event_id, value FROM (SELECT *, {LAG.format(c='value')} AS p FROM events) WHERE p IS NULL OR abs(value - p) > 20")
def deadband_last_input(spark, sf_dir):
    return state.deadband(events(spark, sf_dir), ["user_id"], "value", 20.0, ["event_id"], baseline="last_input").select("event_id", "value")


FOLD = """
    WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, value, t, rn, {first} AS st, true AS emit FROM e WHERE rn = 1
          UNION ALL
          SELECT e.user_id, e.event_id, e.value, e.t, e.rn, CASE WHEN {hit} THEN {new} ELSE f.st END, {hit} FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, value FROM f WHERE emit
"""


@query("deadband_last_output", FOLD.format(first="value", hit="abs(e.value - f.st) > 20", new="e.value"))
def deadband_last_output(spark, sf_dir):
    return state.deadband(events(spark, sf_dir), ["user_id"], "value", 20.0, ["event_id"]).select("event_id", "value")


@query("deadband_relative", FOLD.format(first="value", hit="(CASE WHEN f.st = 0 THEN e.value <> 0 ELSE abs(e.value - f.st) / abs(f.st) > 0.5 END)", new="e.value"))
def deadband_relative(spark, sf_dir):
    return state.deadband(events(spark, sf_dir), ["user_id"], "value", 0.5, ["event_id"], relative=True).select("event_id", "value")


@query("hysteresis", """
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, value, rn, value >= 60 AS st, true AS emit FROM e WHERE rn = 1
          UNION ALL
          SELECT e.user_id, e.event_id, e.value, e.rn, CASE WHEN f.st THEN e.value > 20 ELSE e.value >= 60 END, (CASE WHEN f.st THEN e.value > 20 ELSE e.value >= 60 END) <> f.st FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, value FROM f WHERE emit
""")
def hysteresis(spark, sf_dir):
    return state.hysteresis(events(spark, sf_dir), ["user_id"], "value", 60.0, 20.0, ["event_id"]).select("event_id", "value")


@query("dedup_ttl", FOLD.format(first="t", hit=f"e.t - f.st >= {DAY}", new="e.t"))
def dedup_ttl(spark, sf_dir):
    return state.deduplicate(events(spark, sf_dir), ["user_id"], DAY, ["event_id"], "t").select("event_id", "value")


@query("change_detect_ttl", """
    WITH e AS (SELECT *, epoch_us(ts) AS t FROM events),
    p AS (SELECT *, lag(event_type) OVER w AS p, lag(t) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, event_type FROM p WHERE pt IS NULL OR pt + 43200000000 <= t OR p <> event_type
""")
def change_detect_ttl(spark, sf_dir):
    return state.change_detect(events(spark, sf_dir), ["user_id"], ["event_type"], ["event_id"], ttl=12 * HOUR, clock="t").select("event_id", "event_type")


GRID = f"""
    WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events),
    k AS (SELECT user_id, min(t) // {DAY} * {DAY} + {DAY} AS g0, max(t) AS g1 FROM e GROUP BY user_id),
    g AS (SELECT user_id, unnest(range(g0, g1 + 1, {DAY})) AS g FROM k)
"""


@query("resample_last", GRID + f"SELECT g.user_id, g AS resample_time, arg_max(value, (t, event_id)) AS value, count(value) = 0 AS resample_missing, count(value) AS samples FROM g LEFT JOIN e ON e.user_id = g.user_id AND t >= g - {DAY} AND t < g GROUP BY ALL")
def resample_last(spark, sf_dir):
    out = state.resample(events(spark, sf_dir), ["user_id"], ["value"], DAY, ["event_id"], "t")
    return out.select("user_id", "resample_time", "value", "resample_missing", F.col("resample_samples").cast("long").alias("samples"))


@query("resample_mean", GRID + f"SELECT g.user_id, g AS resample_time, round(avg(value), 6) AS value, count(value) AS samples FROM g LEFT JOIN e ON e.user_id = g.user_id AND t >= g - {DAY} AND t < g GROUP BY ALL")
def resample_mean(spark, sf_dir):
    out = state.resample(events(spark, sf_dir), ["user_id"], ["value"], DAY, ["event_id"], "t", "mean")
    return out.select("user_id", "resample_time", F.round("value", 6).alias("value"), F.col("resample_samples").cast("long").alias("samples"))


@query("resample_interpolate", GRID + f""",
    p AS (SELECT g.user_id, g, max(t) FILTER (t < g) AS lt, arg_max(value, (t, event_id)) FILTER (t < g) AS lv, min(t) FILTER (t >= g) AS rt, arg_min(value, (t, event_id)) FILTER (t >= g) AS rv FROM g JOIN e ON e.user_id = g.user_id GROUP BY ALL)
    SELECT user_id, g AS resample_time,
           round(CASE WHEN rt = g THEN rv WHEN rt < g + {DAY} AND rt - lt <= {2 * DAY} THEN lv + (rv - lv) * ((g - lt)::DOUBLE / (rt - lt)) END, 6) AS value,
           CASE WHEN rt = g THEN 1 WHEN rt < g + {DAY} AND rt - lt <= {2 * DAY} THEN 2 ELSE 0 END::BIGINT AS samples
    FROM p
""")
def resample_interpolate(spark, sf_dir):
    out = state.resample(events(spark, sf_dir), ["user_id"], ["value"], DAY, ["event_id"], "t", "interpolate", max_wait=DAY, max_gap=2 * DAY)
    return out.select("user_id", "resample_time", F.round("value", 6).alias("value"), F.col("resample_samples").cast("long").alias("samples"))


def conditions(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "t", (F.col("value") >= 60).alias("high"), (F.col("value") < 20).alias("low"))


@query("hold_for", f"""
    WITH e AS (SELECT event_id, user_id, value >= 60 AS high, epoch_us(ts) AS t FROM events),
    r AS (SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
    s AS (SELECT *, min(t) OVER (PARTITION BY user_id, run) AS t0 FROM r WHERE high),
    n AS (SELECT user_id, run, max(event_id) FILTER (t < t0 + {6 * HOUR}) AS event_id, any_value(t0) + {6 * HOUR} AS due, max(event_id) AS top FROM s GROUP BY user_id, run),
    nx AS (SELECT n.*, coalesce((SELECT min(e.t) FROM e WHERE e.user_id = n.user_id AND e.event_id > n.top), (SELECT max(e.t) FROM e WHERE e.user_id = n.user_id)) AS seen,
                  (SELECT max(e.t) FROM e WHERE e.user_id = n.user_id AND e.event_id <= n.top) AS own FROM n)
    SELECT user_id, event_id FROM nx WHERE due <= greatest(seen, own)
""")
def hold_for(spark, sf_dir):
    return state.hold_for(conditions(spark, sf_dir), ["user_id"], "high", 6 * HOUR, ["event_id"], "t").select("user_id", "event_id")


@query("debounce", f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, t, rn, t AS start, t + {4 * HOUR} AS due, 1 AS burst FROM e WHERE rn = 1
          UNION ALL
          SELECT e.user_id, e.event_id, e.t, e.rn, CASE WHEN e.t >= f.due THEN e.t ELSE f.start END, CASE WHEN e.t >= f.due THEN e.t + {4 * HOUR} ELSE least(e.t + {4 * HOUR}, f.start + {12 * HOUR}) END,
                 f.burst + CASE WHEN e.t >= f.due THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1),
    b AS (SELECT user_id, burst, min(event_id) AS first, max(event_id) AS last, burst < max(burst) OVER (PARTITION BY user_id) AS closed FROM f GROUP BY user_id, burst)
    SELECT user_id, first AS event_id FROM b UNION ALL SELECT user_id, last FROM b WHERE last > first AND closed
""")
def debounce(spark, sf_dir):
    return state.debounce(conditions(spark, sf_dir), ["user_id"], ["high"], 4 * HOUR, 12 * HOUR, ["event_id"], "t", leading=True).select("user_id", "event_id")


ALARM = {"activate": 2 * HOUR, "resolve": HOUR, "cooldown": 12 * HOUR, "max_age": 8 * HOUR}


@query("alarm", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, value >= 60 AS hi, value < 20 AS lo, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (
        SELECT user_id, event_id, rn, CASE WHEN hi THEN 'pending' ELSE 'normal' END AS phase, CASE WHEN hi THEN t + {activate} END AS due, 0::BIGINT AS quiet_to, NULL::BIGINT AS since, 0::BIGINT AS episode,
               NULL::BIGINT AS held, NULL::BIGINT AS n1_at, NULL::VARCHAR AS n1_phase, NULL::BIGINT AS c_at, NULL::VARCHAR AS c_event, false AS c_notify, NULL::BIGINT AS n2_at, 0::BIGINT AS old_episode
        FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, event_id, rn,
               CASE WHEN p2 = 'normal' AND hi THEN 'pending' WHEN p2 = 'pending' AND NOT hi THEN 'normal' WHEN p2 = 'active' AND lo THEN 'recovering' WHEN p2 = 'recovering' AND NOT lo THEN 'active' ELSE p2 END,
               CASE WHEN p2 = 'normal' AND hi THEN t + {activate} WHEN p2 = 'pending' AND NOT hi THEN NULL WHEN p2 = 'active' AND lo THEN t + {resolve} WHEN p2 = 'recovering' AND NOT lo THEN NULL ELSE d2 END,
               CASE WHEN n2 AND s2 + {max_age} > a2 THEN a2 + {cooldown} ELSE q2 END, CASE WHEN n2 THEN NULL ELSE s2 END, ep2,
               held, CASE WHEN n1 AND since + {max_age} > a0 THEN a0 END, phase, CASE WHEN c THEN due END, CASE WHEN c AND phase = 'pending' THEN 'activate' WHEN c THEN 'resolve' END, c AND (phase <> 'pending' OR due >= q1), CASE WHEN n2 AND s2 + {max_age} > a2 THEN a2 END, episode
        FROM (SELECT *, CASE WHEN s2 IS NOT NULL THEN least(q2, s2 + {max_age}) END AS a2, coalesce(a2 <= t, false) AS n2
              FROM (SELECT *, CASE WHEN c AND phase = 'pending' THEN 'active' WHEN c THEN 'normal' ELSE phase END AS p2, CASE WHEN c THEN NULL ELSE due END AS d2,
                           CASE WHEN c AND (phase <> 'pending' OR due >= q1) THEN due + {cooldown} ELSE q1 END AS q2,
                           CASE WHEN c AND phase = 'pending' AND due < q1 THEN due WHEN c THEN NULL ELSE s1 END AS s2, episode + CASE WHEN c AND phase = 'pending' THEN 1 ELSE 0 END AS ep2
                    FROM (SELECT *, CASE WHEN n1 AND since + {max_age} > a0 THEN a0 + {cooldown} ELSE quiet_to END AS q1, CASE WHEN n1 THEN NULL ELSE since END AS s1
                          FROM (SELECT *, coalesce(a0 <= t AND (due IS NULL OR a0 < due), false) AS n1, coalesce(due <= t, false) AS c
                                FROM (SELECT e.*, f.event_id AS held, f.phase, f.due, f.quiet_to, f.since, f.episode, CASE WHEN f.since IS NOT NULL THEN least(f.quiet_to, f.since + {max_age}) END AS a0
                                      FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)))))
    )
    SELECT user_id, held AS event_id, 'notify' AS alarm_event, n1_phase AS alarm_phase, old_episode AS alarm_episode, n1_at AS alarm_time, true AS alarm_notify FROM f WHERE n1_at IS NOT NULL
    UNION ALL SELECT user_id, held, c_event, CASE c_event WHEN 'activate' THEN 'active' ELSE 'normal' END, old_episode + CASE c_event WHEN 'activate' THEN 1 ELSE 0 END, c_at, c_notify FROM f WHERE c_at IS NOT NULL
    UNION ALL SELECT user_id, held, 'notify', 'active', episode, n2_at, true FROM f WHERE n2_at IS NOT NULL
""".format(**ALARM))
def alarm(spark, sf_dir):
    out = state.alarm(conditions(spark, sf_dir), ["user_id"], "high", "low", ["event_id"], "t", **ALARM)
    return out.select("user_id", "event_id", "alarm_event", "alarm_phase", F.col("alarm_episode").cast("long").alias("alarm_episode"), "alarm_time", "alarm_notify")


@query("silence", f"""
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events),
    s AS (SELECT user_id, t + {DAY} AS due, t AS seen, nxt FROM e WHERE nxt IS NULL AND t + {DAY} <= 1706659200000000 OR t + {DAY} < nxt)
    SELECT user_id, 'silent' AS silence_event, due AS silence_time, seen AS silence_last_seen FROM s
    UNION ALL SELECT user_id, 'resumed', nxt, nxt FROM s WHERE nxt IS NOT NULL
    UNION ALL SELECT user_id, 'silent', 1704067200000000 + {DAY}, NULL FROM (SELECT user_id, min(t) AS t FROM e GROUP BY user_id) WHERE t < 0
""")
def silence(spark, sf_dir):
    out = state.silence(events(spark, sf_dir), ["user_id"], DAY, ["event_id"], "t", since=1_704_067_200_000_000, until=1_706_659_200_000_000)
    return out.select("user_id", "silence_event", "silence_time", "silence_last_seen")
