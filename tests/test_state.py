"""State operators: goldens, an independent model of each fold, and streams that equal batch."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import QueryError
from millrace.functions import aggregates
from millrace.operators import folds, state, windows
from millrace.streaming.stateful import run_stream

S = 1_000_000


def frame(spark, rows, extra="x double"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n long, k string, t long, {extra}")


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("n").collect()]


def test_change_ignores_invalid_rows(spark):
    df = frame(spark, [("a", 0, 20.0), ("a", 0, 20.0), ("b", 0, None), ("b", 0, 5.0), ("a", 0, 21.5), ("b", 0, 5.0), ("a", 0, float("nan"))])
    assert values(state.change_detect(df, ["k"], ["x"], ["n"], invalid="ignore"), "k", "x") == [("a", 20.0), ("b", 5.0), ("a", 21.5)]
    assert values(state.change_detect(df, ["k"], ["x"], ["n"], emit_first=False, invalid="ignore"), "x") == [21.5]
    with pytest.raises(Exception, match="NULL or non-finite"):
        state.change_detect(df, ["k"], ["x"], ["n"]).collect()


def test_deadband_moves_its_baseline_on_output(spark):
    # a move of exactly the threshold stays inside, small steps add up against the last output alone
    df = frame(spark, [("a", i, x) for i, x in enumerate([-4.0, -2.0, 0.5, 2.5, 2.75, -9.0])])
    assert values(state.deadband(df, ["k"], "x", 2.0, ["n"]), "x") == [-4.0, 0.5, 2.75, -9.0]
    assert values(state.deadband(df, ["k"], "x", 2.0, ["n"], baseline="last_input"), "x") == [-4.0, 0.5, -9.0]
    odd = frame(spark, [("a", 0, 5.0), ("a", 1, float("nan")), ("a", 2, 6.0), ("a", 3, 8.5)])
    assert values(state.deadband(odd, ["k"], "x", 2.0, ["n"], baseline="last_input", invalid="ignore"), "x") == [5.0, 8.5]
    zero = frame(spark, [("a", i, x) for i, x in enumerate([0.0, 0.0, 1.0, 1.4, 1.6])])
    for base in ("last_input", "last_output"):
        assert values(state.deadband(zero, ["k"], "x", 0.5, ["n"], relative=True, baseline=base), "x")[:2] == [0.0, 1.0]
    late = frame(spark, [("a", 0, 1.0), ("a", 4, 1.0), ("a", 10, 1.0)])
    assert values(state.deadband(late, ["k"], "x", 1.0, ["n"], ttl=5, clock="t"), "t") == [0, 10]


def test_hysteresis_latches_at_its_thresholds(spark):
    # equality at both thresholds, jumps over the whole band, values inside it
    df = frame(spark, [("a", 0, x) for x in [-1.0, 7.0, 3.0, 8.0, 2.0, 2.5, 6.9, 100.0, -100.0, 7.0]])
    assert values(state.hysteresis(df, ["k"], "x", 7, 2, ["n"]), "x") == [-1.0, 7.0, 2.0, 100.0, -100.0, 7.0]
    assert values(state.hysteresis(df, ["k"], "x", 2, 7, ["n"], high=False), "x") == [-1.0, 7.0, 2.0, 100.0, -100.0, 7.0]
    with pytest.raises(QueryError):
        state.hysteresis(df, ["k"], "x", 50, 55, ["n"])


def test_deduplicate_counts_from_the_last_admitted(spark):
    df = frame(spark, [("a", t, 0.0) for t in [0, 5, 9, 10, 19, 20]] + [(None, 3, 0.0), (None, 4, 0.0)])
    assert sorted(values(state.deduplicate(df, ["k"], 10, ["n"], "t"), "t")) == [0, 3, 10, 20]


def test_hold_for(spark):
    rows = [("a", 0, True), ("a", 5, True), ("a", 12, True), ("a", 13, True), ("a", 14, False), ("a", 15, True), ("a", 20, False), ("b", 1, True)]
    df = frame(spark, rows, "on boolean")
    assert values(state.hold_for(df, ["k"], "on", 10, ["n"], "t"), "k", "t") == [("a", 5)]
    assert values(state.hold_for(df, ["k"], "on", 10, ["n"], "t", until=11), "k", "t") == [("a", 5), ("b", 1)]


def test_debounce(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 3, 2.0), ("a", 6, 2.0), ("a", 20, 3.0), ("a", 24, 4.0), ("a", 28, 5.0), ("a", 32, 6.0), ("a", 36, 7.0)])
    run = lambda **o: values(state.debounce(df, ["k"], ["x"], 5, 14, ["n"], "t", until=100, **o), "t")
    assert run() == [6, 32, 36]
    assert run(leading=True) == [0, 6, 20, 32, 36]
    assert run(leading=True, trailing=False) == [0, 20, 36]
    assert run(reset_on_repeat=False) == [6, 32, 36]


def test_alarm_goes_through_its_phases(spark):
    rows = [(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0), (14, 0, 1), (15, 0, 0), (16, 0, 1), (30, 0, 0), (31, 1, 0), (60, 0, 1), (90, 0, 0)]
    df = spark.createDataFrame([(i, "a", t, bool(e), bool(c)) for i, (t, e, c) in enumerate(rows)], "n long, k string, t long, e boolean, c boolean")
    out = state.alarm(df, ["k"], "e", "c", ["n"], "t", activate=10, resolve=5, cooldown=100, max_age=10, operator=7)
    got = [(r["alarm_event"], int(r["alarm_episode"]), r["alarm_time"], r["alarm_notify"]) for r in out.collect()]
    assert got == [("activate", 1, 13, True), ("resolve", 1, 21, True), ("activate", 2, 41, False), ("resolve", 2, 65, True)]
    both = df.withColumn("c", F.col("e"))
    assert state.alarm(both, ["k"], "e", "c", ["n"], "t", invalid="ignore").count() == 0


def test_alarm_notifies_after_the_cooldown(spark):
    df = spark.createDataFrame([(0, "a", 0, True, False), (1, "a", 1, False, True), (2, "a", 5, True, False), (3, "a", 50, False, False)], "n long, k string, t long, e boolean, c boolean")
    out = state.alarm(df, ["k"], "e", "c", ["n"], "t", cooldown=20, max_age=30)
    assert [(r["alarm_event"], r["alarm_time"], r["alarm_notify"]) for r in out.collect()] == [("activate", 0, True), ("resolve", 1, True), ("activate", 5, False), ("notify", 21, True)]


def test_silence_and_resumption(spark):
    df = frame(spark, [("a", 2, 0.0), ("a", 7, 0.0), ("a", 12, 0.0), ("a", 30, 0.0)])
    out = state.silence(df, ["k"], 10, ["n"], "t", since=0, registered=[("z",)], until=35)
    got = sorted((r["k"], r["silence_time"], r["silence_event"], int(r["silence_episode"]), r["silence_last_seen"], r["silence_never_seen"]) for r in out.collect())
    # a row exactly at the deadline comes first: no silence at 17 and 22 is the first verdict
    assert got == [("a", 22, "silent", 1, 12, False), ("a", 30, "resumed", 1, 30, False), ("z", 10, "silent", 1, None, True)]
    with pytest.raises(QueryError):
        state.silence(df, ["k"], 10, ["n"], "t", max_observation_gap=6)


def test_resample_modes(spark):
    df = frame(spark, [("a", 3, 1.0), ("a", 7, 3.0), ("a", 12, 5.0), ("a", 34, 9.0), ("a", 40, 11.0)])
    points = lambda mode, **o: [(r["resample_time"], r["x"], int(r["resample_samples"])) for r in state.resample(df, ["k"], ["x"], 10, ["n"], "t", mode, **o).orderBy("resample_time").collect()]
    assert points("last") == [(10, 3.0, 2), (20, 5.0, 1), (30, None, 0), (40, 9.0, 1)]
    assert points("mean") == [(10, 2.0, 2), (20, 5.0, 1), (30, None, 0), (40, 9.0, 1)]
    assert points("interpolate", max_wait=10, max_gap=10) == [(10, 3.0 + 2 * 3 / 5, 2), (20, None, 0), (30, None, 0), (40, 11.0, 1)]


def test_keys_are_checked(spark):
    df = frame(spark, [("a", 0, 1.0)])
    for keys in ([], ["x"], ["none"]):
        with pytest.raises(QueryError):
            state.change_detect(df, keys, ["x"], ["n"])


# windows


def test_sessions_are_cut_at_the_gap_and_the_duration(spark):
    df = frame(spark, [("a", t, 1.0) for t in [5, 0, 9, 15, 40, 48, 56, 64]])
    spec = windows.WindowSpec("session_et", gap=10, max_duration=20)
    out = windows.aggregate(df, spec, ["k"], [{"fn": "count", "alias": "c"}], "t", ["n"])
    assert sorted((r["window_start"], r["window_end"], r["c"]) for r in out.collect()) == [(0, 20, 4), (40, 60, 3), (64, 74, 1)]


def test_sliding_prefix_leaves_later_rows_of_the_same_time_out(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 5, 2.0), ("a", 5, 4.0), ("a", 11, 8.0)])
    out = windows.aggregate(df, windows.WindowSpec("sliding_pt", size=10), ["k"], [{"fn": "sum", "expr": {"k": "col", "name": "x"}, "alias": "s"}], "t", ["n"])
    assert sorted((r["window_end"], r["s"]) for r in out.collect()) == [(2, 1.0), (6, 3.0), (6, 7.0), (12, 14.0)]


def test_sliding_frames_equal_the_fold(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), r.randrange(40), r.choice([None, float("nan"), *[round(r.uniform(-9, 9), 2) for _ in range(8)]]), r.randrange(-5, 5)) for _ in range(160)]
    df = frame(spark, rows, "x double, y int")
    x, y = {"k": "col", "name": "x"}, {"k": "col", "name": "y"}
    aggs = [{"fn": "count", "alias": "n"}, *[{"fn": f, "expr": x, "alias": f"{f}x"} for f in ("count", "min", "max", "first", "last")], *[{"fn": f, "expr": y, "alias": f"{f}y"} for f in aggregates.NAMES]]
    spec = windows.WindowSpec("sliding_pt", size=7)
    got = windows.aggregate(df, spec, ["k"], aggs, "t", ["n"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    values, fold = windows._folded(df, spec, ["k"], aggs)
    folded = folds.run(df.select("k", *values, "t", "n"), fold, F.col("t"), [F.col("n")])
    assert got.columns == folded.columns

    def told(df):
        return sorted([tuple("-" if v is None else "nan" if v != v else round(v, 6) + 0.0 if isinstance(v, float) else v for v in row) for row in df.collect()], key=str)

    assert told(got) == told(folded) and len(told(got)) == len(rows)


def test_more_keys_than_allowed_are_an_error(spark):
    df = frame(spark, [("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, None), ("a", 1, 3.0)])
    assert state.bounded(df, ["k"], ["x"], 3).count() == 4 and state.bounded(df, ["k"], ["x"], 2, "ignore").count() == 4
    for most, invalid in ((2, "error"), (1, "ignore")):
        with pytest.raises(Exception, match=f"more than {most} keys"):
            state.bounded(df, ["k"], ["x"], most, invalid).collect()
    assert state.bounded(df.limit(0), ["k"], ["x"], 1).count() == 0


def test_aggregates_skip_null_and_nan(spark):
    df = frame(spark, [("a", 0, None), ("a", 1, float("nan")), ("a", 2, 3.0), ("a", 3, 1.0)])
    x = {"k": "col", "name": "x"}
    aggs = [{"fn": f, "expr": x, "alias": f} for f in ("min", "max", "count", "first", "last")] + [{"fn": "count", "alias": "rows"}]
    r = windows.aggregate(df, windows.WindowSpec("tumble_et", size=10), ["k"], aggs, "t", ["n"]).first()
    assert (r["min"], r["max"], r["count"], r["last"], r["rows"]) == (1.0, 3.0, 3, 1.0, 4) and r["first"] != r["first"]


# streams


def stream(spark, df, path, splits):
    """The rows of ``df`` as a stream of ``splits`` files, one to a batch."""
    rows = df.orderBy("n").collect()
    size = -(-len(rows) // splits)
    for i in range(splits):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/part{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drained(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def signals(spark, n=60, seed=1):
    r = random.Random(seed)
    t, rows = 0, []
    for _ in range(n):
        t += r.choice([0, 1, 3, 7])
        rows.append((r.choice("ab"), t, float(r.randint(0, 9))))
    return frame(spark, rows).withColumn("on", F.col("x") >= 5).withColumn("off", F.col("x") < 2)


FOLDS = {
    "change": lambda: folds.ChangeDetect(keys=["k"], fields=["x"]),
    "deadband": lambda: folds.Deadband(keys=["k"], fields=["x"], threshold=2.0),
    "hysteresis": lambda: folds.Hysteresis(keys=["k"], fields=["x"], enter=6, exit=3),
    "dedup": lambda: folds.Deduplicate(keys=["k"], ttl=10),
    "hold_for": lambda: folds.HoldFor(keys=["k"], fields=["on"], duration=5),
    "debounce": lambda: folds.Debounce(keys=["k"], fields=["x"], quiet=4, max_wait=12, leading=True),
    "alarm": lambda: folds.Alarm(keys=["k"], fields=["on", "off"], activate=2, resolve=1, cooldown=9, max_age=5),
    "silence": lambda: folds.Silence(keys=["k"], duration=6),
    "resample": lambda: folds.Resample(keys=["k"], fields=["x"], period=5),
}


@pytest.mark.parametrize("name", FOLDS)
def test_a_stream_equals_the_batch(spark, tmp_path, name):
    df = signals(spark)
    batch = folds.run(df, FOLDS[name](), F.col("t"), [F.col("n")]).collect()
    assert batch
    live = run_stream(stream(spark, df, str(tmp_path / "in"), 5), FOLDS[name](), F.col("t"), ["n"])
    assert sorted(map(str, drained(spark, live, f"live_{name}", tmp_path))) == sorted(map(str, batch))


AGGS = [{"fn": "count", "alias": "c"}, {"fn": "sum", "expr": {"k": "col", "name": "x"}, "alias": "s"}, {"fn": "last", "expr": {"k": "col", "name": "x"}, "alias": "l"}]
SPECS = [
    windows.WindowSpec("count_window", size=4), windows.WindowSpec("sliding_count", size=5, step=2), windows.WindowSpec("sliding_pt", size=12), windows.WindowSpec("sliding_et", size=12, delay=3), windows.WindowSpec("session_et", gap=9, max_duration=25),
]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.kind)
def test_a_window_over_a_stream_equals_the_batch(spark, tmp_path, spec):
    # a last row far ahead closes the windows of its key; what it opens itself stays open on the stream
    df = signals(spark)
    last = spark.createDataFrame([(1000 + i, k, 100_000, 0.0, False, True) for i, k in enumerate("ab")], df.schema)
    df = df.unionByName(last)
    batch = windows.aggregate(df, spec, ["k"], AGGS, "t", ["n"]).collect()
    live = windows.aggregate(stream(spark, df, str(tmp_path / "in"), 4), spec, ["k"], AGGS, "t", ["n"])
    got = drained(spark, live, f"win_{spec.kind}", tmp_path)
    closed = [r for r in batch if "window_end" not in r or r["window_end"] <= 100_000 or spec.kind == "sliding_pt"]
    assert got and sorted(map(str, got)) == sorted(map(str, closed))


def test_the_engine_runs_queries_on_streams(spark, tmp_path):
    from millrace.plans.engine import Engine

    df = signals(spark)
    e = Engine(spark)
    e.register_stream("s", stream(spark, df, str(tmp_path / "in"), 3), ["n"], "t", "t")
    seen = []
    queries = e.start("q", "SELECT k, x * 2 AS y FROM s WHERE x > 4", lambda b, i: seen.extend(b.collect()), str(tmp_path / "ck"), {"availableNow": True})
    spec = {"version": 1, "pipeline_id": 1, "revision_id": 1, "nodes": [{"id": 1, "kind": "memory_source", "table": "s", "out": [2]}, {"id": 2, "kind": "change_detect", "iot": {"keys": ["k"], "fields": ["on"]}, "out": [3]}, {"id": 3, "kind": "capture_sink", "name": "o"}]}
    changed = []
    queries += e.start("g", spec, {"o": lambda b, i: changed.extend(b.collect())}, str(tmp_path / "ck2"), {"availableNow": True})
    for q in queries:
        q.awaitTermination()
    assert len(seen) == df.filter("x > 4").count()
    assert len(changed) == state.change_detect(df, ["k"], ["on"], ["n"]).count()
    e.register_stream("still", df, ["n"])
    with pytest.raises(QueryError):
        e.start("x", "SELECT k FROM still", None, str(tmp_path / "ck3"))


def test_ttl_operators_are_window_functions(spark, capsys):
    """The clock of the valid row before decides, and runs over invalid rows too; no row goes through Python."""
    df = frame(spark, [("a", 0, 1.0), ("a", 4, 1.0), ("a", 8, None), ("a", 9, 1.0), ("a", 12, 1.0), ("a", 3, 1.0), ("a", 17, 1.0)])
    out = state.change_detect(df, ["k"], ["x"], ["n"], invalid="ignore", ttl=5, clock="t")
    assert values(out, "t") == [0, 9, 17]
    out.explain()
    assert "Python" not in capsys.readouterr().out and "Arrow" not in capsys.readouterr().out


def test_state_of_streams_goes_when_its_time_to_live_is_over(spark, tmp_path):
    """With a watermark, keys that have outlived their time leave the state store, and come back as new ones."""
    from pyspark.sql import functions as F

    shape = "n long, k string, t long"
    src = tmp_path / "in"
    batches = [[(0, "a", 1_000_000), (1, "b", 2_000_000)], [(2, "c", 60_000_000)], [(3, "d", 120_000_000)], [(4, "a", 121_000_000)], [(5, "e", 240_000_000)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    timed = stream.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", "0 seconds")
    out = state.deduplicate(timed, ["k"], 10_000_000, ["n"], "t")
    q = out.writeStream.format("memory").queryName("dedup_ttl_state").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in (x if isinstance(x, dict) else x.jsonValue for x in q.recentProgress) if p["stateOperators"]]
    assert sorted(r["n"] for r in spark.table("dedup_ttl_state").collect()) == [0, 1, 2, 3, 4, 5]
    assert kept and max(kept) < 5 and kept[-1] <= 2
