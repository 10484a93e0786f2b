"""Registered queries that go through files, streams, reference tables, graphs and user functions, each beside its DuckDB SQL.

What they write lies in the folder that the cluster shares; the rows they return
are read back from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError
from millrace.functions import udf
from millrace.functions.expr import select
from millrace.functions.types import schema
from millrace.operators import joins, state, windows
from millrace.plans.engine import Engine
from millrace.plans.queries import DAY, EV, FOLD, HOUR, PAIR, call, col, engine, events, lit, op, query, table
from millrace.plans.tables import ReferenceTables
from millrace.session import scratch_path
from millrace.sources import connectors, formats, sinks
from millrace.streaming import windows as live

EVENT = schema([("event_id", "int64", True), ("user_id", "int64", True), ("event_type", "utf8", True), ("value", "float64", True), ("t", "int64", True)])


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream of finite sources gives, through the durable table sink."""
    path = scratch_path(spark, name)
    stream.writeStream.foreachBatch(sinks.table(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def replayed(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """The events as a stream of NDJSON files."""
    path = scratch_path(spark, "replay")
    sinks.to_ndjson(events(spark, sf_dir).select(*EVENT.names).repartitionByRange(files, "event_id"), path)
    return formats.stream_files(spark, path, EVENT)


# files


@query("ndjson_round_trip", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, o_totalprice, o_orderpriority FROM orders")
def ndjson_round_trip(spark, sf_dir):
    path = scratch_path(spark, "ndjson")
    sinks.to_ndjson(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS status", "o_totalprice", "o_orderpriority"), path)
    return formats.read_ndjson(spark, path, schema([("o_orderkey", "int64", False), ("status", "utf8", True), ("o_totalprice", "float64", True), ("o_orderpriority", "utf8", True)]))


@query("csv_round_trip", "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE nullif(c_mktsegment, 'BUILDING') END AS segment, 'say \"' || c_name || '\", twice' AS quoted, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE nullif(c_mktsegment, 'BUILDING') END AS segment", "concat('say \"', c_name, '\", twice') AS quoted", "c_acctbal")
    sinks.to_csv(rows, path)
    return formats.read_csv(spark, path, schema([("c_custkey", "int64", False), ("segment", "utf8", True), ("quoted", "utf8", True), ("c_acctbal", "float64", True)]))


LINES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k":' || event_id WHEN 1 THEN '{"k":1,"k":2}' WHEN 2 THEN '{"v":1}' WHEN 3 THEN '{"k":"x"}' ELSE '{"k":' || event_id || ',"v":' || user_id || '}' END AS line FROM events"""


def lines(spark, sf_dir) -> DataFrame:
    """A record for each event, most of them bad in some way."""
    table(spark, sf_dir, "events").createOrReplaceTempView("millrace_events")
    return spark.sql(LINES.replace("FROM events", "FROM millrace_events"))


@query("decode_errors", f"SELECT line AS record, CASE event_id % 6 WHEN 2 THEN 'k is missing' WHEN 1 THEN 'malformed record or repeated key' ELSE 'malformed record' END AS reason FROM ({LINES}) WHERE event_id % 6 < 4")
def decode_errors(spark, sf_dir):
    e = Engine(spark)
    e.register_records("lines", lines(spark, sf_dir), "line", schema([("k", "int64", False), ("v", "int64", True)]), ["k"])
    nodes = [{"id": 1, "kind": "memory_source", "table": "lines", "out": [2], "side_output": {"kind": "decode_error", "to": 3, "full": "drop"}}, {"id": 2, "kind": "capture_sink", "name": "good"}, {"id": 3, "kind": "capture_sink", "name": "bad"}]
    return e.graph({"version": 1, "pipeline_id": 1, "revision_id": 1, "nodes": nodes})["bad"]


@query("decoded_records", "SELECT event_id AS k, user_id AS v FROM events WHERE event_id % 6 >= 4")
def decoded_records(spark, sf_dir):
    return formats.decode_json(lines(spark, sf_dir), "line", schema([("k", "int64", False), ("v", "int64", True)]), "side")[0]


@query("finite_rows", "SELECT * FROM (VALUES (1::BIGINT, 'a', 3.0::DOUBLE), (2, NULL, 5.0)) v(n, k, twice)")
def finite_rows(spark, sf_dir):
    rows = formats.from_rows(spark, [{"n": 1, "k": "a", "x": 1.5}, '{"n":2,"x":2.5}', {"n": 3, "k": "c", "x": None}], schema([("n", "int64", False), ("k", "utf8", True), ("x", "float64", True)]))
    return Engine(spark).query("SELECT n, k, x * 2 AS twice FROM rows_in WHERE x > 1", {"rows_in": rows})


# output documents and texts for other stores


@query("output_mapping", """SELECT o_orderkey, '{"id":' || o_orderkey || ',"state":{"code":"' || o_orderstatus || '","list":["x",null,' || o_custkey || ']}}' AS doc FROM orders""")
def output_mapping(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    template = {"id": {"$field": "o_orderkey"}, "state": {"code": {"$field": "o_orderstatus"}, "list": [{"$literal": "x"}, None, {"$field": "o_custkey"}]}}
    return df.select("o_orderkey", sinks.mapped(df, template).alias("doc"))


@query("influx_lines", f"SELECT event_id, 'readings,kind=' || event_type || ' user=' || user_id || 'i,at=\"{{\\\"kk\" ' || t AS line FROM ({EV})")
def influx_lines(spark, sf_dir):
    df = events(spark, sf_dir).withColumns({"kind": F.col("event_type"), "user": F.col("user_id"), "at": F.substring("props", 1, 3), "when": F.timestamp_micros("t")})
    df = df.withColumn("at", F.concat("at", F.lit("k")))
    return df.select("event_id", sinks.line_protocol(df, "readings", ["kind"], ["user", "at"], "when").alias("line"))


@query("redis_commands", """SELECT c_custkey, '["HSET","' || c_name || '","doc","{\\"key\\":' || c_custkey || '}"]' AS command FROM customer""")
def redis_commands(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", sinks.redis_commands(df, "HSET", "c_name", {"key": {"$field": "c_custkey"}}).alias("command"))


# streams


@query("file_replay", "SELECT event_id, user_id, value * 2 AS twice FROM events WHERE value > 100")
def file_replay(spark, sf_dir):
    e, path = Engine(spark), scratch_path(spark, "job")
    e.register_stream("live", replayed(spark, sf_dir), ["event_id"], None, "t")
    for q in e.start("replay", "SELECT event_id, user_id, value * 2 AS twice FROM live WHERE value > 100", sinks.table(f"{path}/rows"), f"{path}/checkpoint", {"availableNow": True}):
        q.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", "user_id", "twice")


@query("bus_topic", "SELECT n_nationkey, n_name FROM nation")
def bus_topic(spark, sf_dir):
    folder = scratch_path(spark, "bus")
    bus = connectors.Bus(folder.removeprefix("file://"))
    bus.sink("nations")(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 0)
    got = drained(spark, bus.stream(spark, "nations"), "bus")
    return formats.decode_json(got, "record", schema([("n_nationkey", "int64", False), ("n_name", "utf8", True)]))[0].select(F.col("n_nationkey").cast("int"), "n_name")


@query("dedup_stream", FOLD.format(first="t", hit=f"e.t - f.st >= {DAY}", new="e.t").replace("SELECT event_id, value FROM f", "SELECT event_id, user_id FROM f"))
def dedup_stream(spark, sf_dir):
    return drained(spark, state.deduplicate(replayed(spark, sf_dir), ["user_id"], DAY, ["event_id"], "t").select("event_id", "user_id"), "dedup")


@query("window_stream", f"""
    WITH e AS (SELECT user_id, value, epoch_us(ts) AS t, epoch_us(ts) // {6 * HOUR} * {6 * HOUR} AS window_start FROM events)
    SELECT user_id, window_start, count(*) AS n, max(value) AS hi FROM e
    WHERE window_start + {6 * HOUR} <= (SELECT max(t) FROM e) // 1000 * 1000 - {HOUR} GROUP BY user_id, window_start
""")
def window_stream(spark, sf_dir):
    """Windows that the watermark, an hour behind the latest event, has closed."""
    timed = live.with_watermark(replayed(spark, sf_dir).withColumn("ts", F.timestamp_micros("t")), "ts", HOUR, skew=None)
    aggs = [{"fn": "count", "alias": "n"}, {"fn": "max", "expr": col("value"), "alias": "hi"}]
    out = windows.aggregate(timed, windows.WindowSpec("tumble_et", size=6 * HOUR), ["user_id"], aggs, "ts")
    return drained(spark, out.select("user_id", "window_start", "n", "hi"), "windows")


@query("interval_join_stream", f"SELECT a.event_id AS x, b.event_id AS y, greatest(a.t, b.t) AS join_time FROM ({EV}) a JOIN {PAIR} b ON a.user_id = b.user_id AND b.t BETWEEN a.t AND a.t + {HOUR}")
def interval_join_stream(spark, sf_dir):
    # every row is in time: the delay covers the whole replay
    timed = lambda df: live.with_watermark(df.withColumn("ts", F.timestamp_micros("t")), "ts", 400 * DAY, skew=None)
    rows = replayed(spark, sf_dir)
    out = live.interval_join_stream(timed(rows), timed(rows.filter("event_type IN ('click', 'view')")), [("user_id", "user_id")], ("ts", "ts"), 0, HOUR)
    return drained(spark, out.select(F.col("left_event_id").alias("x"), F.col("right_event_id").alias("y"), "join_time"), "pairs")


LATE = f"""
    WITH e AS (SELECT *, (event_id * 7919) % 10007 AS arrival, epoch_us(ts) AS t FROM events),
    m AS (SELECT *, greatest(coalesce(max(t) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) - {2 * DAY} AS mark FROM e),
    s AS (SELECT *, t // {DAY} * {DAY} + {DAY} <= mark AND mark > 0 AS late FROM m)
"""


def late_graph(spark, sf_dir) -> dict[str, DataFrame]:
    e = Engine(spark)
    e.register_stream("shuffled", events(spark, sf_dir).withColumn("arrival", (F.col("event_id") * 7919) % 10007), ["arrival", "event_id"], "t")
    nodes = [
        {"id": 1, "kind": "memory_source", "table": "shuffled", "out": [2]},
        {"id": 2, "kind": "window_agg", "keys": ["user_id"], "window": {"kind": "event_time", "size_micros": DAY, "lateness_micros": 2 * DAY}, "aggs": [{"fn": "count", "alias": "n"}], "out": [3], "side_output": {"kind": "late", "to": 4, "full": "drop"}},
        {"id": 3, "kind": "capture_sink", "name": "windows"}, {"id": 4, "kind": "capture_sink", "name": "late"},
    ]
    return e.graph({"version": 1, "pipeline_id": 1, "revision_id": 1, "nodes": nodes})


query("late_side_output", LATE + "SELECT event_id, user_id FROM s WHERE late")(lambda s, d: late_graph(s, d)["late"].select("event_id", "user_id"))
query("windows_without_late", LATE + f"SELECT user_id, t // {DAY} * {DAY} AS window_start, count(*) AS n FROM s WHERE NOT late GROUP BY ALL")(lambda s, d: late_graph(s, d)["windows"].select("user_id", "window_start", "n"))


@query("best_effort_branch", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def best_effort_branch(spark, sf_dir):
    nodes = [
        {"id": 1, "kind": "memory_source", "table": "orders", "out": [2]},
        {"id": 2, "kind": "route", "routes": [{"predicate": op(">", col("o_totalprice"), 150000.0), "to": 3}], "default_out": 4, "out": [3, 4], "best_effort": [4]},
        {"id": 3, "kind": "capture_sink", "name": "kept"}, {"id": 4, "kind": "best_effort_sink", "name": "rest"},
    ]
    return engine(spark, sf_dir, {"orders"}).graph({"version": 1, "pipeline_id": 1, "revision_id": 1, "nodes": nodes})["kept"].select("o_orderkey", "o_totalprice")


# reference tables


@query("table_mutate", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_name || '!' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 <> 3 UNION ALL SELECT 1000, 'NEW'")
def table_mutate(spark, sf_dir):
    tables, rows = ReferenceTables(spark, scratch_path(spark, "tables")), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tables.put("nation", rows, ["n_nationkey"])
    new = rows.filter("n_nationkey % 5 = 0").selectExpr("n_nationkey", "concat(n_name, '!') AS n_name").unionByName(spark.sql("SELECT 1000 AS n_nationkey, 'NEW' AS n_name"))
    tables.mutate("nation", 1, upserts=new, deletes=rows.filter("n_nationkey % 7 = 3 AND n_nationkey % 5 <> 0"))
    return tables.get("nation")


@query("table_rollback", """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (n_nationkey % 3 = 1) AS gone FROM nation)
    SELECT 1::BIGINT AS number, n AS rows, true AS as_first FROM c UNION ALL SELECT 2, n - gone, false FROM c UNION ALL SELECT 3, n, true FROM c
""")
def table_rollback(spark, sf_dir):
    """Revisions after a mutation and a rollback: numbers, rows, and whether the content's hash is the first's."""
    tables, rows = ReferenceTables(spark, scratch_path(spark, "tables")), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tables.put("nation", rows, ["n_nationkey"])
    tables.mutate("nation", 1, deletes=rows.filter("n_nationkey % 3 = 1"))
    tables.rollback("nation", 1)
    found = tables.revisions("nation")
    return spark.createDataFrame([(r.number, r.rows, r.sha256 == found[0].sha256) for r in found], "number long, rows long, as_first boolean")


@query("live_lookup", "SELECT s_suppkey, n_name AS before, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '?' ELSE n_name END AS after FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def live_lookup(spark, sf_dir):
    tables, rows = ReferenceTables(spark, scratch_path(spark, "tables")), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tables.put("nation", rows, ["n_nationkey"])
    look = lambda df, name: joins.follow_latest(df, tables, "nation", [("s_nationkey", "n_nationkey")], ["n_name"]).withColumnRenamed("n_name", name)
    first = look(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "before")
    tables.mutate("nation", 1, upserts=rows.filter("n_nationkey % 2 = 0").selectExpr("n_nationkey", "concat(n_name, '?') AS n_name"))
    return look(first, "after").select("s_suppkey", "before", "after")


# user functions, casts, checks


def registered(register, name: str, *args) -> str:
    try:
        return register(name, 1, *args)
    except QueryError:  # by an earlier call
        return f"{name}@1"


@query("plugin_call", "SELECT event_id, round(value * 2 + 1, 6) AS y, CASE WHEN event_type <> 'click' THEN event_type || '?' END AS z FROM events")
def plugin_call(spark, sf_dir):
    scaled = registered(udf.register_scalar, "scaled", lambda x: x * 2 + 1, [T.DoubleType()], T.DoubleType())
    asked = registered(udf.register_scalar, "asked", lambda x: x.fillna("none") + "?", [T.StringType()], T.StringType())
    plug = lambda name, x: {"k": "plugin", "name": name, "args": [x]}
    out = select(events(spark, sf_dir), [(col("event_id"), "event_id"), (plug(scaled, col("value")), "y"), (plug(asked, call("nullif", col("event_type"), "click")), "z")])
    return out.withColumn("y", F.round("y", 6))


def _signs(batches):
    import pandas as pd

    for b in batches:
        yield pd.concat([b[["o_orderkey"]].assign(sign=s) for s in (-1, 1)])


@query("plugin_transform", "SELECT o_orderkey, unnest([-1, 1])::BIGINT AS sign FROM orders WHERE o_totalprice > 100000")
def plugin_transform(spark, sf_dir):
    name = registered(udf.register_transform, "signs", _signs, T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("sign", T.LongType())]))
    return udf.transform(table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_orderkey"), name)


@query("casts_at_the_edges", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 9223372036854775807 WHEN 2 THEN -9223372036854775808 ELSE CAST(trunc(value) AS BIGINT) END AS whole,
           CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id END AS some, CASE WHEN event_id % 3 = 0 THEN event_id END AS positive
    FROM events
""")
def casts_at_the_edges(spark, sf_dir):
    df = events(spark, sf_dir).withColumns({
        "x": F.expr("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN 1e300D WHEN 2 THEN -1e300D ELSE value END"),
        "text": F.expr("CASE WHEN event_id % 4 = 1 THEN '9223372036854775808' ELSE string(event_id) END"), "signed": F.expr("CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 - event_id END"),
    })
    cast = lambda kind, x, ty: {"k": kind, "expr": x, "ty": ty}
    return select(df, [(col("event_id"), "event_id"), (cast("cast", col("x"), "int64"), "whole"), (cast("try_cast", col("text"), "int64"), "some"), (cast("cast", cast("try_cast", col("signed"), "uint64"), "int64"), "positive")])


@query("casts_to_dynamic", """SELECT event_id, CAST(event_id AS VARCHAR) AS n, '"' || event_type || '"' AS s, 'true' AS b, user_id AS back FROM events""")
def casts_to_dynamic(spark, sf_dir):
    dyn = lambda x: {"k": "cast", "expr": x, "ty": "dynamic"}
    text = lambda x: call("json_stringify", dyn(x))
    return select(events(spark, sf_dir), [(col("event_id"), "event_id"), (text(col("event_id")), "n"), (text(col("event_type")), "s"), (text(lit(True)), "b"), ({"k": "cast", "expr": dyn(col("user_id")), "ty": "int64"}, "back")])


#: Statements of forms that the dialect does not have.
FORMS = (
    "SELECT DISTINCT event_id FROM events", "SELECT event_id FROM events LIMIT 3", "SELECT event_id FROM events ORDER BY event_id", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id",
    "SELECT user_id, COUNT(DISTINCT value) AS n FROM events GROUP BY user_id, TUMBLE(t, INTERVAL '1' HOUR)", "SELECT event_id FROM events UNION ALL SELECT event_id FROM events", "SELECT a.event_id FROM events a FULL OUTER JOIN readings b ON a.user_id = b.user_id",
    "SELECT event_id FROM (SELECT event_id FROM events) x", "SELECT TUMBLE(t, INTERVAL '1' HOUR) AS w FROM events", "SELECT event_id FROM events WHERE value", "SELECT nothing FROM events", "SELECT event_id FROM nowhere",
)


@query("rejected_forms", "SELECT unnest(range(12)) AS form, true AS rejected")
def rejected_forms(spark, sf_dir):
    e = engine(spark, sf_dir, {"events", "readings"})

    def rejected(text: str) -> bool:
        try:
            e.validate(text)
        except (QueryError, ValueError):
            return True
        return False

    return spark.createDataFrame([(i, rejected(text)) for i, text in enumerate(FORMS)], "form long, rejected boolean")


@query("validated_schema", "SELECT * FROM (VALUES (0::BIGINT, 'user_id', 'bigint'), (1, 'window_start', 'bigint'), (2, 'n', 'bigint'), (3, 'a', 'double')) v(nth, name, type)")
def validated_schema(spark, sf_dir):
    found = engine(spark, sf_dir, {"events"}).validate("SELECT user_id, window_start, COUNT(*) AS n, AVG(value) AS a FROM events GROUP BY user_id, TUMBLE(t, INTERVAL '1' HOUR)")
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(found.fields)], "nth long, name string, type string")
