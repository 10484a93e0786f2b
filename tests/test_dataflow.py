"""Graphs, joins, event-time streams, formats, sinks, connectors and reference tables."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError, RevisionConflict
from millrace.functions.types import schema
from millrace.operators import joins, ordering, windows
from millrace.plans.engine import Engine
from millrace.plans.tables import ReferenceTables
from millrace.sources import connectors, formats, sinks
from millrace.streaming import windows as live

COL = {"k": "col", "name": "v"}


def graph(*nodes):
    return {"version": 1, "pipeline_id": 1, "revision_id": 1, "nodes": list(nodes)}


SOURCE = {"id": 1, "kind": "memory_source", "table": "s", "out": [2]}
SINK = {"id": 9, "kind": "capture_sink", "name": "out"}


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    df = spark.createDataFrame([(i, "ab"[i % 2], i * 10, i % 4) for i in range(12)], "n long, k string, t long, v long")
    e.register_stream("s", df, ["n"], "t", "t")
    e.register_stream("s2", df, ["n"], "t", "t")
    e.register_table("names", spark.createDataFrame([("a", "first")], "key string, name string"), ["key"])
    e.register_table("slices", spark.createDataFrame([("a", 0, 50, "old"), ("a", 50, None, "new")], "key string, f long, u long, name string"), ["key"], "f", "u")
    return e


def test_routes_unions_and_rejects(engine):
    case = lambda n, to: {"predicate": {"k": "bin", "op": "eq", "left": COL, "right": {"k": "lit", "value": {"t": "int64", "v": n}}}, "to": to}
    got = engine.graph(graph(SOURCE, {"id": 2, "kind": "route", "routes": [case(0, 3), case(1, 4)], "default_out": 5, "out": [3, 4, 5], "best_effort": [5]}, {"id": 3, "kind": "project", "exprs": [{"alias": "v", "expr": COL}], "out": [6]}, {"id": 4, "kind": "map", "exprs": [{"alias": "v", "expr": COL}], "out": [6]}, {"id": 6, "kind": "union_all", "out": [9]}, {"id": 5, "kind": "best_effort_sink", "name": "rest"}, SINK))
    assert got["out"].count() == 6 and got["rest"].count() == 6
    got = engine.graph(graph(SOURCE, {"id": 2, "kind": "filter", "predicate": case(0, 0)["predicate"], "out": [9], "side_output": {"kind": "rule_reject", "to": 8, "full": "drop"}}, SINK, {"id": 8, "kind": "capture_sink", "name": "rejected"}))
    assert got["out"].count() == 3 and got["rejected"].count() == 9


def test_a_graph_equals_its_sql(engine):
    by_graph = engine.query(graph(SOURCE, {"id": 2, "kind": "window_agg", "keys": ["k"], "window": {"kind": "hop", "size_micros": 60, "slide_micros": 30}, "aggs": [{"fn": "sum", "expr": COL, "alias": "s"}], "out": [9]}, SINK))
    by_sql = engine.sql("SELECT k, window_start, window_end, SUM(v) AS s FROM s GROUP BY k, HOP(t, 30, 60)")
    assert sorted(by_graph.collect()) == sorted(by_sql.collect())


def test_lookups_and_state_nodes(engine):
    out = engine.query(graph(SOURCE, {"id": 2, "kind": "lookup", "table": "names", "on": [{"stream": "k", "table": "key"}], "keep": ["name"], "out": [9]}, SINK)).collect()
    assert len(out) == 12 and {(r["k"], r["name"]) for r in out} == {("a", "first"), ("b", None)}
    out = engine.query(graph(SOURCE, {"id": 2, "kind": "lookup", "table": "slices", "temporal": True, "as_of_field": "t", "on": [{"stream": "k", "table": "key"}], "out": [9]}, SINK)).collect()
    assert {(r["t"] >= 50, r["name"]) for r in out if r["k"] == "a"} == {(False, "old"), (True, "new")}
    iot = {"keys": ["k"], "fields": ["v"], "emit_first": True, "ttl_micros": 0, "max_keys": 9, "invalid": "error"}
    assert engine.query(graph(SOURCE, {"id": 2, "kind": "change_detect", "iot": iot, "out": [9]}, SINK)).count() == 12
    assert engine.query(graph(SOURCE, {"id": 2, "kind": "deduplicate", "keys": ["k"], "ttl_micros": 40, "max_keys": 9, "out": [9]}, SINK)).count() == 6
    timing = {"kind": "resample", "mode": "last", "clock": "paused", "period_micros": 50}
    assert "resample_time" in engine.query(graph(SOURCE, {"id": 2, "kind": "resample", "iot": iot | {"timing": timing}, "out": [9]}, SINK)).columns


def test_late_rows_leave_by_their_side_output(spark):
    e = Engine(spark)
    e.register_stream("s", spark.createDataFrame([(0, 5), (1, 35), (2, 7), (3, 31), (4, 12)], "n long, t long"), ["n"], "t")
    node = {"id": 2, "kind": "window_agg", "keys": [], "window": {"kind": "event_time", "size_micros": 10, "lateness_micros": 15}, "aggs": [{"fn": "count", "alias": "c"}], "out": [9], "side_output": {"kind": "late", "to": 8, "full": "drop"}}
    got = e.graph(graph(SOURCE, node, SINK, {"id": 8, "kind": "capture_sink", "name": "late"}))
    assert [r["t"] for r in got["late"].collect()] == [7, 12] or sorted(r["t"] for r in got["late"].collect()) == [7, 12]
    assert sorted((r["window_start"], r["c"]) for r in got["out"].collect()) == [(0, 1), (30, 2)]


def test_records_that_do_not_decode_leave_by_their_side_output(spark):
    e = Engine(spark)
    e.register_records("s", spark.createDataFrame([('{"v":1}',), ("{",), ('{"v":2}',)], "r string"), "r", schema([("v", "int64", False)]), ["v"])
    got = e.graph(graph(SOURCE | {"out": [9], "side_output": {"kind": "decode_error", "to": 8, "full": "drop"}}, SINK, {"id": 8, "kind": "capture_sink", "name": "bad"}))
    assert sorted(r["v"] for r in got["out"].collect()) == [1, 2]
    assert [(r["record"], r["reason"]) for r in got["bad"].collect()] == [("{", "malformed record")]
    rows = formats.from_rows(spark, [{"v": 5}, '{"v":6}'], schema([("v", "int64", False)]))
    assert sorted(r["v"] for r in e.query("SELECT v FROM mine", {"mine": rows}).collect()) == [5, 6]
    with pytest.raises(Exception, match="decode"):
        formats.from_rows(spark, ["{"], schema([("v", "int64", False)])).collect()


BAD = [
    ({"version": 2, "nodes": [SOURCE]}, "version"), (graph(SOURCE), "unknown node"), (graph(SOURCE, {"id": 2, "kind": "filter", "out": [9]}, SINK), "predicate"), (graph(SOURCE | {"x": 1}, SINK), "unknown field"), (graph(SOURCE | {"out": [9]}, SINK, SINK), "twice"),
    (graph(SOURCE, {"id": 2, "kind": "map", "exprs": [{"alias": "v", "expr": COL}], "out": [3]}, {"id": 3, "kind": "map", "exprs": [{"alias": "v", "expr": COL}], "out": [2]}, SINK), "cycle"), (graph(SOURCE | {"out": [9], "table": "none"}, SINK), "unknown stream"),
    (graph(SOURCE, {"id": 2, "kind": "union_all", "out": [9]}, SINK), "inputs"), (graph(SOURCE, {"id": 2, "kind": "join", "out": [9]}, SINK), "join"), (graph(SOURCE, {"id": 2, "kind": "retract", "out": [9]}, SINK), "retraction"), (graph(SOURCE, {"id": 2, "kind": "nothing", "out": [9]}, SINK), "nothing"),
    (graph(SOURCE | {"out": [9], "best_effort": [9]}, SINK), "best-effort edge"), (graph(SOURCE | {"out": [9]}, {"id": 9, "kind": "best_effort_sink"}), "stands behind"), (graph(SOURCE | {"out": [9], "side_output": {"kind": "decode_error", "to": 8, "full": "drop"}}, SINK, SINK | {"id": 8, "name": "x"}), "decode_error"),
    (graph(SOURCE, {"id": 2, "kind": "window_agg", "window": {"kind": "session"}, "aggs": [], "out": [9]}, SINK), "time domain"), (graph(SOURCE, {"id": 2, "kind": "branch", "out": [9], "iot": {}}, SINK), "belong"), (graph(SOURCE, {"id": 2, "kind": "route", "routes": [], "out": [9]}, SINK), "default"),
]


@pytest.mark.parametrize(("spec", "names"), BAD, ids=[n for _, n in BAD])
def test_bad_graphs_are_named(engine, spec, names):
    with pytest.raises(QueryError, match=names):
        engine.validate(spec)


# joins


def test_join_keys_that_match_nothing(spark):
    left = spark.createDataFrame([(0, 1.0, 5), (1, float("nan"), 5), (2, None, 5)], "n long, k double, t long")
    out = joins.interval_join(left, left, [("k", "k")], ("t", "t"), 0, 0, "left", (["n"], ["n"])).collect()
    assert sorted((r["left_n"], r["right_n"]) for r in out if r["right_n"] is not None) == [(0, 0)] and len(out) == 3
    assert joins.window_join(left, left, [("k", "k")], ("t", "t"), 10).count() == 1


def test_interval_bounds_are_inclusive(spark):
    left = spark.createDataFrame([(0, "a", 100)], "n long, k string, t long")
    right = spark.createDataFrame([(i, "a", t) for i, t in enumerate([94, 95, 100, 103, 104])], "n long, k string, t long")
    for orders in (((), ()), (["n"], ["n"])):
        out = joins.interval_join(left, right, [("k", "k")], ("t", "t"), 5, 3, "left", orders).collect()
        assert sorted(r["right_t"] for r in out) == [95, 100, 103] and {r["join_time"] for r in out} == {100, 103}


def test_external_lookup_policies(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k long")
    added = T.StructType([T.StructField("name", T.StringType())])

    def fetch(keys):
        if (2,) in keys:
            raise OSError("down")
        return {k: {"name": "x"} for k in keys}

    assert joins.external_lookup(df, ["k"], fetch, added, "null", batch_keys=1).filter("name is not null").count() == 1
    assert joins.external_lookup(df, ["k"], fetch, added, "drop", batch_keys=1).count() == 2
    with pytest.raises(Exception, match="down"):
        joins.external_lookup(df, ["k"], fetch, added).collect()


def test_unnest_limits_and_numbers(spark):
    df = spark.createDataFrame([(0, ["x", None]), (1, []), (2, None), (3, ["y"])], "n long, a array<string>")
    out = joins.unnest(df, {"k": "col", "name": "a"}, "item", "ord", ["n"], "src").collect()
    assert sorted((r["unnest_input"], r["unnest_ordinal"], r["ord"], r["item"] or "", r["unnest_source"]) for r in out) == [(1, 1, 1, "x", "src"), (1, 2, 2, "", "src"), (4, 1, 1, "y", "src")]
    with pytest.raises(Exception, match="more than 1"):
        joins.unnest(df, {"k": "col", "name": "a"}, max_rows=1).collect()


def test_global_numbers_without_one_task(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 100)
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("o"), "id")
    got = ordering.numbered(df, ["o", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001)) and [r["o"] for r in got] == sorted(r["o"] for r in got)
    best, rows = None, ordering.running_max_before(df, ["o", "id"], F.col("id"), "m").orderBy("o", "id").collect()
    for r in rows:
        assert r["m"] == best
        best = r["id"] if best is None else max(best, r["id"])


# streams


def events(spark, path):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(40)], "n long, k string, s string, v double").select("n", "k", F.to_timestamp("s").alias("ts"), "v")
    for i in range(4):
        df.filter(F.col("n").between(i * 10, i * 10 + 9)).coalesce(1).write.parquet(f"{path}/p{i}")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def drained(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_final_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    df, s = events(spark, tmp_path / "in")
    for spec in (windows.WindowSpec("tumble_et", size=600_000_000), windows.WindowSpec("hop", size=600_000_000, slide=300_000_000)):
        aggs = [{"fn": "sum", "expr": COL, "alias": "s"}]
        batch = sorted(windows.aggregate(df, spec, ["k"], aggs, "ts", ["n"]).collect())
        got = sorted(drained(spark, live.aggregate_stream(live.with_watermark(s, "ts", 60_000_000), spec, ["k"], aggs, "ts"), f"w_{spec.kind}", tmp_path))
        assert got and got == [r for r in batch if r in got] and len(got) >= len(batch) - 6


def test_two_streams_join_in_their_interval(spark, tmp_path):
    df, s = events(spark, tmp_path / "in")
    mark = lambda: live.with_watermark(s, "ts", 0, skew=None)
    got = drained(spark, live.interval_join_stream(mark(), mark(), [("k", "k")], ("ts", "ts"), 120_000_000, 0), "ij", tmp_path)
    want = joins.interval_join(df, df, [("k", "k")], ("ts", "ts"), 120_000_000, 0)
    assert sorted((r["left_n"], r["right_n"]) for r in got) == sorted((r["left_n"], r["right_n"]) for r in want.collect())


def test_late_rows_of_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/marks"
    split = live.LateSplitter("ts", 600_000_000, folder=folder)
    one = spark.sql("SELECT timestamp'2024-01-01 00:31:00' ts")
    two = spark.sql("SELECT timestamp'2024-01-01 00:05:00' ts UNION ALL SELECT timestamp'2024-01-01 00:30:30'")
    counts = lambda s, batch, n: [df.count() for df in s.split(batch, n)]
    assert counts(split, one, 0) == [1, 0] and counts(split, two, 1) == [1, 1]
    # a batch that is tried again is judged alike, here and after a restart, however far later batches went
    late = spark.sql("SELECT timestamp'2024-01-01 09:00:00' ts")
    assert counts(split, late, 2) == [1, 0] and counts(split, one, 0) == [1, 0] and counts(split, two, 1) == [1, 1]
    again = live.LateSplitter("ts", 600_000_000, folder=folder)
    assert counts(again, two, 1) == [1, 1] and counts(again, one, 0) == [1, 0] and counts(again, one, 3) == [0, 1]


# formats, sinks, connectors


def test_json_records_that_do_not_decode(spark, tmp_path):
    shape = schema([("k", "utf8", False), ("v", "int64", True)])
    lines = ['{"k":"a","v":1}', '{"k":"b"', '{"v":2}', '{"k":"c","v":"x"}', None]
    good, bad = formats.decode_json(spark.createDataFrame([(x,) for x in lines], "r string"), "r", shape, "side")
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert sorted(r["reason"] for r in bad.collect()) == ["NULL record", "k is missing", "malformed record", "malformed record"]
    (tmp_path / "x.ndjson").write_text("\n".join(x for x in lines[:2]))
    assert formats.read_ndjson(spark, str(tmp_path / "x.ndjson"), shape, "drop").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        formats.read_ndjson(spark, str(tmp_path / "x.ndjson"), shape).collect()


def test_csv_tells_empty_from_null(spark, tmp_path):
    shape = schema([("a", "utf8", True), ("b", "int64", True)])
    (tmp_path / "x.csv").write_text('a,b\n"",1\n,2\n"q ""x"", y",3\nz,oops\n')
    got = formats.read_csv(spark, str(tmp_path / "x.csv"), shape, "drop").collect()
    assert sorted((r["a"] is None, r["a"] or "", r["b"]) for r in got) == [(False, "", 1), (False, 'q "x", y', 3), (True, "", 2)]
    sinks.to_csv(spark.createDataFrame([("", 1), (None, 2)], "a string, b int"), f"{tmp_path}/out")
    assert sorted((r["a"] is None, r["b"]) for r in formats.read_csv(spark, f"{tmp_path}/out", shape).collect()) == [(False, 1), (True, 2)]


def test_output_documents(spark):
    df = spark.createDataFrame([("a", None, 1.5)], "k string, n long, x double")
    template = {"id": {"$field": "k"}, "n": {"$field": "n"}, "more": [{"$literal": {"$x": 1}}, {"$field": "x"}, True]}
    assert json.loads(df.select(sinks.mapped(df, template).alias("d")).first()["d"]) == {"id": "a", "n": None, "more": [{"$x": 1}, 1.5, True]}
    with pytest.raises(QueryError):
        sinks.mapped(df, {"$field": "none"})
    assert df.withColumn("ts", F.timestamp_micros(F.lit(5))).select(sinks.line_protocol(df.withColumn("ts", F.timestamp_micros(F.lit(5))), "m", ["k"], ["x", "n"], "ts").alias("l")).first()["l"] == "m,k=a x=1.5 5"
    assert json.loads(df.select(sinks.redis_commands(df, "HSET", "k", {"x": {"$field": "x"}}).alias("c")).first()["c"]) == ["HSET", "a", "doc", '{"x":1.5}']


def test_posts_are_retried_and_kept_when_they_fail(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(5)], "v long").coalesce(1)
    seen = str(tmp_path / "seen")

    def send(docs, key):
        with open(seen, "a") as f:
            f.write(json.dumps([key, docs]) + "\n")
        if any('"v":3' in d for d in docs):
            raise OSError("no")

    sinks.post(send, batch_rows=2, retries=1, backoff=0.0, dead_letters=f"{tmp_path}/dead")(df, 7)
    calls = [json.loads(x) for x in open(seen)]
    assert [k for k, _ in calls] == ["7-0-0", "7-0-1", "7-0-1", "7-0-2"]
    assert sorted(r["doc"] for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == ['{"v":2}', '{"v":3}']
    with pytest.raises(Exception, match="no"):
        sinks.post(send, batch_rows=2, retries=0)(df, 8)
    sinks.post(send, batch_rows=2, retries=0, best_effort=True)(df, 9)
    lines = []
    sinks.log(df, emit=lines.append)
    assert lines[0] == '{"v":0}'


def test_fetched_records_stream_once(spark, tmp_path):
    left = list(range(3))
    reader = connectors._Reader(lambda n: ([str(x) for x in left[n:]], len(left)))
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["0", "1", "2"] and end == {"n": 3}
    left.append(3)
    assert [r[0] for r in reader.readBetweenOffsets({"n": 0}, {"n": 3})] == ["0", "1", "2"]
    assert [r[0] for r in reader.read(end)[0]] == ["3"]
    assert connectors.unframed(b"a\nb\r\nrest", "lines") == (["a", "b"], b"rest")
    assert connectors.unframed(b"\0\0\0\1x\0\0\0\2y", "length_prefixed") == (["x"], b"\0\0\0\2y")


# reference tables


def test_revisions(spark, tmp_path):
    tables = ReferenceTables(spark, f"file://{tmp_path}/tables")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v long")
    one = tables.put("t", frame(("a", 1), ("b", 2)), ["k"])
    two = tables.mutate("t", 1, upserts=frame(("c", 3), ("a", 9)), deletes=frame(("b", 0)).select("k"))
    assert (one.number, two.number, two.rows) == (1, 2, 2)
    assert sorted(tuple(r) for r in tables.get("t").collect()) == [("a", 9), ("c", 3)]
    with pytest.raises(RevisionConflict):
        tables.mutate("t", 1, upserts=frame(("a", 1)))
    for bad in ({"deletes": frame(("zz", 0)).select("k")}, {"upserts": frame(("a", 1), ("a", 2))}, {"upserts": frame(("a", 1)), "deletes": frame(("a", 0)).select("k")}):
        with pytest.raises(QueryError):
            tables.mutate("t", 2, **bad)
    three = tables.rollback("t", 1)
    assert three.number == 3 and three.sha256 == one.sha256 and three.of == 1 and tables.list() == ["t"]
    assert tables.gc("t", keep={1}) == [2] and [r.number for r in tables.revisions("t")] == [1, 3]
    with pytest.raises(QueryError):
        tables.put("u", frame(("a", 1), ("a", 2)), ["k"])


def batch_of(spark, stream, name, tmp_path):
    """The records that a stream's next run brings, going on from its checkpoint."""
    got = []
    q = stream.writeStream.foreachBatch(lambda df, n: got.extend(r["record"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(got)


def test_pushed_records_survive_restarts(spark, tmp_path):
    import urllib.error
    import urllib.request

    folder = f"{tmp_path}/inbox"
    inbox = connectors.Inbox(folder, capacity=2, every=60)
    server = connectors.http_listener(inbox, limit=50)
    post = lambda data: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/", data)).status
    try:
        assert [post(b'{"v":1}'), post(b'two\nlines')] == [202, 202]
        for data, code in ((b'{"v":3}', 429), (b"x" * 60, 413)):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(data)
            assert e.value.code == code
        assert inbox.refused == 1
        # the process dies with an open segment: the next one takes it over
        again = connectors.Inbox(folder, capacity=10, every=60)
        assert batch_of(spark, again.stream(spark, keep=True), "i", tmp_path) == ["two\nlines", '{"v":1}']
        assert again.offer("4") and again.offer("5")
        again.seal()
        # a restarted stream goes on where it was, and loses nothing
        assert batch_of(spark, again.stream(spark, keep=True), "i", tmp_path) == ["4", "5"]
        assert batch_of(spark, again.stream(spark, keep=True), "i", tmp_path) == []
    finally:
        server.shutdown()


def test_topics_of_a_bus(spark, tmp_path):
    bus = connectors.Bus(f"{tmp_path}/bus")
    bus.publish("t", ["a", "b"])
    assert batch_of(spark, bus.stream(spark, "t"), "one", tmp_path) == ["a", "b"]
    bus.sink("t")(spark.range(1).toDF("v"), 0)
    assert batch_of(spark, bus.stream(spark, "t"), "one", tmp_path) == ['{"v":0}']
    assert batch_of(spark, bus.stream(spark, "t"), "two", tmp_path) == ["a", "b", '{"v":0}']


def test_sockets_are_connected_again(tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for data in (b"a\nb\n", b"c\n"):
            peer, _ = server.accept()
            peer.sendall(data)
            peer.close()
        server.close()

    threading.Thread(target=serve, daemon=True).start()
    fetch = connectors.tcp_fetch("127.0.0.1", server.getsockname()[1])
    assert fetch(0) == (["a", "b"], 2) and fetch(2) == (["c"], 3) and fetch(3) == ([], 3)


def test_lookup_providers(spark):
    import socketserver
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from millrace.sources import providers

    held: dict = {"p:1": '{"name": "one"}'}

    class Redis(socketserver.StreamRequestHandler):
        def handle(self):
            while self.rfile.peek(1):
                command, *words = providers.resp_answer(self.rfile)
                if command == "MGET":
                    found = [held.get(w) for w in words]
                    self.wfile.write(b"*%d\r\n" % len(found) + b"".join(b"$-1\r\n" if v is None else b"$%d\r\n%s\r\n" % (len(v), v.encode()) for v in found))
                else:
                    held[words[0]] = words[-1]
                    self.wfile.write(b"+OK\r\n")

    class Names(BaseHTTPRequestHandler):
        def do_POST(self):
            keys = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["keys"]
            body = json.dumps([{"name": f"n{k[0]}"} if k[0] != 2 else None for k in keys]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    class Threads(socketserver.ThreadingTCPServer):
        daemon_threads = True

    added = T.StructType([T.StructField("name", T.StringType())])
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long").coalesce(1)
    with Threads(("127.0.0.1", 0), Redis) as redis, ThreadingHTTPServer(("127.0.0.1", 0), Names) as web:
        for s in (redis, web):
            threading.Thread(target=s.serve_forever, daemon=True).start()
        port = redis.server_address[1]
        sinks.redis_send("127.0.0.1", port)(['["SET","p:3","{\\"name\\": \\"three\\"}"]'], "0-0-0")
        got = joins.external_lookup(df, ["k"], providers.redis_lookup("127.0.0.1", port, "p:"), added).collect()
        assert {r["k"]: r["name"] for r in got} == {1: "one", 2: None, 3: "three"}
        got = joins.external_lookup(df, ["k"], providers.http_lookup(f"http://127.0.0.1:{web.server_address[1]}/"), added, cache_ttl=0).collect()
        assert {r["k"]: r["name"] for r in got} == {1: "n1", 2: None, 3: "n3"}
        for s in (redis, web):
            s.shutdown()


def test_upsert_and_lookup_over_jdbc(spark, tmp_path):
    from millrace.sources import providers

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string").coalesce(1)
    sinks.jdbc_insert(rows((1, "a"), (2, "b")), url, "t")
    for _ in range(2):  # a batch that comes again changes nothing
        sinks.jdbc_upsert(rows((2, "B"), (3, "c")), url, "t", ["k"], "staged")
    assert sorted(tuple(r) for r in connectors.jdbc_since(spark, url, 'SELECT "k" AS n, "v" FROM t', "n", 1).collect()) == [(2, "B"), (3, "c")]
    assert sorted(tuple(r) for r in spark.read.jdbc(url, "t").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    found = providers.jdbc_lookup(spark.createDataFrame([(3,), (9,)], "id long"), url, "t", [("id", "k")], ["v"]).collect()
    assert sorted((r["id"], r["v"]) for r in found) == [(3, "c"), (9, None)]
    with pytest.raises(QueryError):
        connectors.jdbc_since(spark, url, "SELECT 1", "k; DROP TABLE t", 1)
    with pytest.raises(QueryError):
        sinks.jdbc_upsert(rows((1, "a")), url, "t", ["none"], "staged")


def test_pointers_of_a_column_follow_the_same_rules_as_literals(spark):
    from millrace.functions.expr import select

    doc = '{"a": [10, 20], "01": 1, "": 3, "m~n": {"x/y": 4}}'
    pointers = ["", "/a/0", "/a/1", "/a/-1", "/a/01", "a", "/01", "/", "/m~0n/x~1y", "/a/2", "/none"]
    df = spark.createDataFrame([(doc, p) for p in pointers], "d string, p string")
    get = lambda p: {"k": "call", "name": "json_stringify", "args": [{"k": "call", "name": "json_get", "args": [{"k": "col", "name": "d"}, p]}]}
    by_column = [r["v"] for r in select(df, [(get({"k": "col", "name": "p"}), "v")]).collect()]
    for p, got in zip(pointers, by_column, strict=True):
        if p == "a":
            assert got == "null"
            continue
        want = select(df.limit(1), [(get({"k": "lit", "value": {"t": "utf8", "v": p}}), "v")]).first()["v"]
        assert json.loads(got) == json.loads(want)


def test_repeated_keys_are_no_record(spark, tmp_path):
    shape = schema([("v", "int64", True)])
    (tmp_path / "d.ndjson").write_text('{"v":1,"v":2}\n\n{"v":3}\n')
    assert [r["v"] for r in formats.read_ndjson(spark, str(tmp_path / "d.ndjson"), shape, "drop").collect()] == [3]
    assert sorted(r[formats.CORRUPT] or "" for r in formats.read_ndjson(spark, str(tmp_path / "d.ndjson"), shape, "side").collect()) == ["", '{"v":1,"v":2}']
    with pytest.raises(Exception, match="repeated key"):
        formats.read_ndjson(spark, str(tmp_path / "d.ndjson"), shape).collect()


def test_lines_have_fields_or_are_none(spark):
    df = spark.sql("SELECT 'a b' AS k, 1.5D AS x, timestamp_micros(5) AS ts UNION ALL SELECT 'c', double('nan'), timestamp_micros(6) UNION ALL SELECT '', 2.0D, NULL UNION ALL SELECT 'e\nf', 2.0D, timestamp_micros(7)")
    got = [r["l"] for r in df.select(sinks.line_protocol(df, "m x", ["k"], ["x"], "ts").alias("l")).collect()]
    assert got == ["m\\ x,k=a\\ b x=1.5 5", None, None, "m\\ x,k=e\\ f x=2.0 7"]


def test_two_writers_of_a_revision(spark, tmp_path):
    tables = ReferenceTables(spark, f"file://{tmp_path}/tables")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v long")
    one = tables.put("t", frame(("a", 1)), ["k"])
    tables.put("t", frame(("a", 2)), ["k"])
    # a writer that saw revision 1 and comes second
    slow = ReferenceTables(spark, f"file://{tmp_path}/tables")
    slow.revisions = lambda table: [one]
    with pytest.raises(RevisionConflict):
        slow.put("t", frame(("a", 3)), ["k"])
    assert [r["v"] for r in tables.get("t").collect()] == [2] and len(list((tmp_path / "tables" / "t").glob("data-*"))) == 2


def test_interval_join_plans_without_a_job(spark):
    e = Engine(spark)
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("t"))
    for name in ("a", "b"):
        e.register_stream(name, df, ["id"], "t")
    group = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(group(None))
    out = e.sql("SELECT x.id AS i, y.id AS j FROM a x LEFT JOIN b y ON x.k = y.k AND INTERVAL_MATCH(x.t, y.t, 50, 0)")
    assert len(group(None)) == before
    rows = [(r["i"], r["j"]) for r in out.collect()]
    want = [(i, j) for i in range(100) for j in range(100) if i % 3 == j % 3 and i * 10 - 50 <= j * 10 <= i * 10]
    assert sorted(rows) == sorted(want)


def test_posts_over_http_and_batches_in_a_table(spark, tmp_path):
    inbox = connectors.Inbox(f"{tmp_path}/posted", every=60)
    server = connectors.http_listener(inbox)
    try:
        sinks.post(sinks.http_send(f"http://127.0.0.1:{server.server_port}/"), batch_rows=3)(spark.range(4).coalesce(1).toDF("v"), 1)
    finally:
        server.shutdown()
    inbox.seal()
    assert batch_of(spark, inbox.stream(spark), "posted", tmp_path) == ['[{"v":0},{"v":1},{"v":2}]', '[{"v":3}]']
    keep = sinks.table(f"{tmp_path}/t")
    for batch in (0, 1, 1):
        keep(spark.range(3), batch)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 6


def test_a_lookup_follows_the_latest_revision(spark, tmp_path):
    tables = ReferenceTables(spark, f"file://{tmp_path}/tables")
    tables.put("t", spark.createDataFrame([("a", 1)], "k string, v long"), ["k"])
    batch = spark.createDataFrame([("a",)], "k string")
    look = lambda: joins.follow_latest(batch, tables, "t", [("k", "k")]).first()["v"]
    assert look() == 1
    tables.mutate("t", 1, upserts=spark.createDataFrame([("a", 2)], "k string, v long"))
    assert look() == 2
