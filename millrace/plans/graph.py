"""Dataflow graphs: JSON nodes and edges, checked as a whole, bound to DataFrames.

Kinds: memory_source, filter, project, map, branch, route / switch, union_all,
window_agg and the named windows, deduplicate, lookup, the eight state
operators, interval_join, window_join, unnest, plugin_transform, capture_sink and
best_effort_sink.  Unknown fields, ids, kinds and cycles are errors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.errors import QueryError, UnknownName, UnsupportedError
from millrace.functions import udf
from millrace.functions.expr import select
from millrace.functions.types import schema as declared
from millrace.operators import joins, routing, state, windows

MAX_NODES, MAX_EDGES, MAX_BYTES = 64, 128, 64 * 1024
TOP = {"version", "pipeline_id", "revision_id", "catalog", "nodes"}
FIELDS = {"id", "kind", "name", "table", "predicate", "exprs", "out", "window", "keys", "aggs", "ttl_micros", "max_keys", "on", "keep", "event_time_field", "lateness_micros", "temporal", "as_of_field", "iot", "routes", "route_mode", "default_out", "best_effort", "side_output", "out_of_orderness_micros", "max_future_skew_micros", "plugin", "unnest", "stream_join"}
WINDOW_FIELDS = {"kind", "size_micros", "slide_micros", "size", "step", "delay_micros", "gap_micros", "max_duration_micros", "lateness_micros", "max_overlap", "max_buffered_rows", "event_time_field", "max_future_skew_micros"}
IOT_FIELDS = {"keys", "fields", "emit_first", "ttl_micros", "max_keys", "invalid", "threshold", "mode", "baseline", "enter", "exit", "direction", "timing"}
STATE = {"change_detect", "deadband", "hysteresis", "hold_for", "debounce", "alarm", "silence", "resample"}
WINDOWS = {"window_agg", "tumble_pt", "tumble_et", "count_window", "hop", "hop_pt", "event_time_window", "sliding", "session", "sliding_count", "sliding_pt", "sliding_et", "session_pt", "session_et"}
SINKS = {"capture_sink", "best_effort_sink"}
REJECTED = {"retract": "retraction", "late_merge": "late merge", "join": "a general stream join (use lookup, interval_join or window_join)"}


@dataclass
class Bound:
    sinks: dict[str, DataFrame] = field(default_factory=dict)
    schemas: dict[int, T.StructType] = field(default_factory=dict)


@dataclass
class Port:
    """Rows on an edge, with what is known about their order and time."""

    df: DataFrame
    order_by: list[str]
    time: str | None
    clock: str | None
    source: str | None = None


def only(what: str, found: dict, allowed: set[str]) -> None:
    if extra := set(found) - allowed:
        raise QueryError(f"{what}: unknown field {min(extra)}")


def ordered(nodes: dict[int, dict]) -> list[int]:
    """Node ids in topological order; unknown ends, cycles and too many edges are errors."""
    into = dict.fromkeys(nodes, 0)
    edges = [(n, to) for n, node in nodes.items() for to in ends(node)]
    if len(edges) > MAX_EDGES:
        raise QueryError(f"a graph has at most {MAX_EDGES} edges")
    for n, to in edges:
        if to not in nodes:
            raise QueryError(f"node {n}: unknown node {to}")
        into[to] += 1
    ready, out = sorted(n for n, k in into.items() if k == 0), []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for to in ends(nodes[n]):
            into[to] -= 1
            if into[to] == 0:
                ready.append(to)
    if len(out) < len(nodes):
        raise QueryError("the graph has a cycle")
    return out


def ends(node: dict) -> list[int]:
    side = node.get("side_output")
    return [*node.get("out", []), *([side["to"]] if side else [])]


def bind(engine, spec: dict) -> Bound:
    only("graph", spec, TOP)
    if spec.get("version") != 1:
        raise QueryError("graph version 1 is supported")
    if not 1 <= len(spec.get("nodes", [])) <= MAX_NODES:
        raise QueryError(f"a graph has 1 to {MAX_NODES} nodes")
    nodes: dict[int, dict] = {}
    for node in spec["nodes"]:
        only(f"node {node.get('id')}", node, FIELDS)
        if node["id"] in nodes:
            raise QueryError(f"node {node['id']} is there twice")
        nodes[node["id"]] = node
    shapes = {t["name"]: declared([(f["name"], f["type"], f.get("nullable", True)) for f in t["fields"]]) for t in spec.get("catalog", [])}
    _lossy_edges(nodes)
    arrives: dict[int, list[tuple[int, Port]]] = {n: [] for n in nodes}
    bound = Bound()
    for n in ordered(nodes):
        node = nodes[n]
        kind, inputs = node["kind"], [p for _, p in sorted(arrives[n], key=lambda x: x[0])]
        if kind in REJECTED:
            raise UnsupportedError(f"{REJECTED[kind]} is not supported")
        _arity(node, inputs)
        if kind in SINKS:
            name = node.get("name") or str(n)
            if name in bound.sinks:
                raise QueryError(f"sink {name} is there twice")
            bound.sinks[name] = inputs[0].df
            bound.schemas[n] = inputs[0].df.schema
            continue
        for to, port in _node(engine, node, inputs, shapes).items():
            arrives[to].append((n, port))
            bound.schemas[n] = port.df.schema
    if not any(node["kind"] in SINKS for node in nodes.values()):
        raise QueryError("a graph needs a sink")
    return bound


def _lossy_edges(nodes: dict[int, dict]) -> None:
    """A best-effort edge must not feed what needs every row; a best-effort sink stands behind nothing else."""
    required = {"union_all", "interval_join", "window_join", "capture_sink"}
    for n, node in nodes.items():
        lossy = set(node.get("best_effort", []))
        for to in ends(node):
            kind = nodes[to]["kind"] if to in nodes else None
            if to in lossy and kind in required:
                raise QueryError(f"node {n}: a best-effort edge may not lead to {kind}")
            if kind == "best_effort_sink" and to not in lossy and (node.get("side_output") or {}).get("to") != to:
                raise QueryError(f"node {n}: a best-effort sink stands behind a best-effort edge")


def _arity(node: dict, inputs: list[Port]) -> None:
    kind, n = node["kind"], node["id"]
    need = {"memory_source": (0, 0), "union_all": (2, 16), "interval_join": (2, 2), "window_join": (2, 2)}.get(kind, (1, 1))
    if not need[0] <= len(inputs) <= need[1]:
        raise QueryError(f"node {n} ({kind}) has {len(inputs)} inputs")
    if kind not in SINKS and not ends(node):
        raise QueryError(f"node {n} ({kind}) leads nowhere")
    if kind in SINKS and ends(node):
        raise QueryError(f"node {n}: a sink has no output")
    if len(set(ends(node))) < len(ends(node)):
        raise QueryError(f"node {n}: an output is there twice")
    for field_, kinds in (("iot", STATE), ("unnest", {"unnest"}), ("stream_join", {"interval_join", "window_join"}), ("plugin", {"plugin_transform"}), ("routes", {"route", "switch"})):
        if node.get(field_) is not None and kind not in kinds:
            raise QueryError(f"node {n}: {field_} does not belong to {kind}")
    if extra := set(node.get("best_effort", [])) - set(node.get("out", [])):
        raise QueryError(f"node {n}: best_effort edge {min(extra)} is no output")


def _node(engine, node: dict, inputs: list[Port], shapes: dict) -> dict[int, Port]:
    kind, out = node["kind"], node.get("out", [])
    port = inputs[0] if inputs else None

    def to_all(df: DataFrame, **change) -> dict[int, Port]:
        p = Port(df, *[change.get(k, getattr(port, k)) for k in ("order_by", "time", "clock", "source")])
        kept = Port(df, [c for c in p.order_by if c in df.columns], p.time if p.time in df.columns else None, p.clock if p.clock in df.columns else None, p.source)
        return dict.fromkeys(out, kept)

    if kind == "memory_source":
        stream = engine._stream(node["table"])
        if node["table"] in shapes:
            want = [(f.name, f.dataType) for f in shapes[node["table"]].fields]
            if [(f.name, f.dataType) for f in stream.df.schema.fields] != want:
                raise QueryError(f"stream {node['table']} does not have the declared schema")
        time = node.get("event_time_field") or stream.event_time
        found = dict.fromkeys(out, Port(stream.df, stream.order_by, time, stream.clock, node["table"]))
        if side := node.get("side_output"):
            only("side_output", side, {"kind", "to", "full"})
            if side["kind"] != "decode_error" or stream.undecoded is None:
                raise QueryError("a source of decoded records has the side output decode_error")
            found[side["to"]] = Port(stream.undecoded, [], None, None, node["table"])
        return found
    if kind == "filter":
        if node.get("predicate") is None:
            raise QueryError(f"node {node['id']}: filter needs a predicate")
        found = to_all(routing.filter_rows(port.df, node["predicate"]))
        if side := node.get("side_output"):
            only("side_output", side, {"kind", "to", "full"})
            if side["kind"] != "rule_reject":
                raise QueryError("a filter's side output is rule_reject")
            found[side["to"]] = Port(routing.rejected(port.df, node["predicate"]), port.order_by, port.time, port.clock, port.source)
        return found
    if kind in ("project", "map"):
        if not node.get("exprs"):
            raise QueryError(f"node {node['id']}: {kind} needs exprs")
        return to_all(select(port.df, [(e["expr"], e["alias"]) for e in node["exprs"]]))
    if kind == "branch":
        return to_all(port.df)
    if kind in ("route", "switch"):
        cases = [(r.get("predicate") or r.get("when"), r["to"]) for r in node.get("routes") or []]
        default = node.get("default_out")
        if default is None or default not in out or any(to not in out for _, to in cases):
            raise QueryError(f"node {node['id']}: a route leads to its outputs and has a default")
        return {to: Port(df, port.order_by, port.time, port.clock, port.source) for to, df in routing.route(port.df, cases, default, node.get("route_mode") or "first_match").items()}
    if kind == "union_all":
        return to_all(routing.union_all([p.df for p in inputs]), source=None)
    if kind in WINDOWS:
        return _window(node, port, to_all)
    if kind in ("dedup", "deduplicate"):
        clock = port.clock or port.time
        if clock is None:
            raise QueryError("deduplicate needs a clock")
        if not node.get("ttl_micros") or not node.get("max_keys"):
            raise QueryError("deduplicate needs ttl_micros and max_keys")
        return to_all(state.deduplicate(port.df, node.get("keys") or [], node["ttl_micros"], port.order_by, clock))
    if kind == "lookup":
        return to_all(_lookup(engine, node, port))
    if kind in STATE:
        return to_all(_state(node, port))
    if kind == "unnest":
        only("unnest", node["unnest"] or {}, {"expr", "as_field", "ordinality", "max_rows", "max_bytes"})
        u = node["unnest"]
        return to_all(joins.unnest(port.df, u["expr"], u.get("as_field", "item"), u.get("ordinality"), port.order_by, port.source, u.get("max_rows", 1024)))
    if kind in ("interval_join", "window_join"):
        return to_all(_join(node, inputs), order_by=[], time="join_time", clock=None, source=None)
    if kind == "plugin_transform":
        return to_all(udf.transform(port.df, (node.get("plugin") or {}).get("name", "")))
    raise UnsupportedError(f"node kind {kind} is not supported")


def _window(node: dict, port: Port, to_all) -> dict[int, Port]:
    w = dict(node.get("window") or {})
    only("window", w, WINDOW_FIELDS)
    kind = w.pop("kind", None) or (node["kind"] if node["kind"] != "window_agg" else None)
    kind = windows.KIND_NAMES.get(kind, kind)
    if kind in ("sliding", "session", None):
        raise QueryError("window.kind names the time domain: sliding_et, sliding_pt, session_et or session_pt")
    if kind in windows.PROCESSING_KINDS and (w.get("event_time_field") or node.get("event_time_field")):
        raise QueryError(f"{kind} takes no event_time_field")
    spec = windows.WindowSpec(
        kind, size=w.get("size_micros", w.get("size", 0)), slide=w.get("slide_micros", 0), step=w.get("step", 0), delay=w.get("delay_micros", 0), gap=w.get("gap_micros", 0),
        max_duration=w.get("max_duration_micros", 0), lateness=w.get("lateness_micros", node.get("lateness_micros") or 0), max_overlap=w.get("max_overlap", windows.MAX_OVERLAP), max_buffered_rows=w.get("max_buffered_rows", windows.MAX_BUFFERED),
    )
    event = w.get("event_time_field") or node.get("event_time_field") or port.time
    time = None if kind in windows.COUNT_KINDS else event if kind in windows.EVENT_KINDS else port.clock or port.time
    order_by = port.order_by or ([time] if time else [])
    made = windows.aggregate(port.df, spec, node.get("keys") or [], node.get("aggs") or [], time, order_by)
    found = to_all(made, order_by=[c for c in ("window_end", "count_end") if c in made.columns], time=None, clock=None)
    if side := node.get("side_output"):
        if side["kind"] != "late" or kind not in ("tumble_et", "hop"):
            raise QueryError("late rows leave event-time tumble and hop windows")
        split = windows.late_split(port.df, time, order_by, spec.size, spec.slide or None, node.get("out_of_orderness_micros") or 0, spec.lateness)
        made = windows.aggregate(split.filter("not late").drop("late"), spec, node.get("keys") or [], node.get("aggs") or [], time, order_by)
        found = to_all(made, order_by=[], time=None, clock=None)
        found[side["to"]] = Port(split.filter("late").drop("late"), port.order_by, port.time, port.clock, port.source)
    return found


def _lookup(engine, node: dict, port: Port) -> DataFrame:
    if node.get("table") not in engine.tables:
        raise UnknownName(f"unknown table {node.get('table')}")
    table = engine.tables[node["table"]]
    on = [(o["stream"], o["table"]) for o in node.get("on") or []]
    if not on:
        raise QueryError("lookup needs on")
    if node.get("temporal"):
        as_of = node.get("as_of_field") or port.time
        if not table.valid_from or as_of is None:
            raise QueryError("a temporal lookup needs a versioned table and an as_of_field")
        return joins.versioned_lookup(port.df, table.df, on, as_of, table.valid_from, table.valid_to, node.get("keep"))
    return joins.lookup(port.df, table.df, on, node.get("keep"))


def _state(node: dict, port: Port) -> DataFrame:
    kind, iot = node["kind"], node.get("iot")
    if not iot:
        raise QueryError(f"{kind} needs an iot configuration")
    only("iot", iot, IOT_FIELDS)
    timing = iot.get("timing") or {}
    if timing and timing.get("kind", kind) != kind:
        raise QueryError("timing is of another kind than the node")
    keys, fields, invalid, order = iot["keys"], iot.get("fields", []), iot.get("invalid", "error"), port.order_by
    clock = port.clock or port.time
    if clock is None and (kind in ("hold_for", "debounce", "alarm", "silence", "resample") or iot.get("ttl_micros")):
        raise QueryError(f"{kind} needs a clock")
    common = {"emit_first": iot.get("emit_first", True), "invalid": invalid}
    ttl = {"ttl": iot.get("ttl_micros", 0), "clock": clock}
    df = state.bounded(port.df, keys, fields, iot["max_keys"], invalid) if iot.get("max_keys") and not ttl["ttl"] else port.df
    if kind == "change_detect":
        return state.change_detect(df, keys, fields, order, **common, **ttl)
    if kind == "deadband":
        return state.deadband(df, keys, fields[0], iot["threshold"], order, relative=iot.get("mode", "absolute") == "relative", baseline=iot.get("baseline", "last_output"), **common, **ttl)
    if kind == "hysteresis":
        return state.hysteresis(df, keys, fields[0], iot["enter"], iot["exit"], order, high=iot.get("direction", iot.get("mode", "high")) == "high", **common)
    if kind == "hold_for":
        return state.hold_for(df, keys, fields[0], timing["duration_micros"], order, clock, invalid)
    if kind == "debounce":
        return state.debounce(df, keys, fields, timing["quiet_micros"], timing["max_wait_micros"], order, clock, timing.get("leading", False), timing.get("trailing", True), timing.get("reset_on_repeat", True), invalid)
    if kind == "alarm":
        if len(fields) != 2:
            raise QueryError("alarm: the fields are enter and clear")
        return state.alarm(df, keys, *fields, order, clock, timing["activate_micros"], timing["resolve_micros"], timing["cooldown_micros"], timing["notification_max_age_micros"], invalid, operator=node["id"])
    if kind == "silence":
        registered = [tuple(k) for k in timing.get("registered_keys", [])]
        return state.silence(df, keys, timing["duration_micros"], order, clock, registered=registered or None, max_observation_gap=timing.get("max_observation_gap_micros"), operator=node["id"])
    return state.resample(df, keys, fields, timing["period_micros"], order, clock, timing.get("mode", "last"), timing.get("max_wait_micros", 0), timing.get("max_gap_micros", 0), invalid, operator=node["id"])


def _join(node: dict, inputs: list[Port]) -> DataFrame:
    j = node.get("stream_join") or {}
    only("stream_join", j, {"left_input", "right_input", "left_keys", "right_keys", "left_time", "right_time", "mode", "before_micros", "after_micros", "window_size_micros", "left_prefix", "right_prefix", "max_rows_per_side", "max_matches_per_row", "max_output_bytes_per_row"})
    if (node["kind"] == "window_join") != (j.get("window_size_micros") is not None):
        raise QueryError("window_join has a window size, interval_join has bounds")
    left, right = inputs
    if j.get("left_input", 0) > j.get("right_input", 1):
        left, right = right, left
    keys = list(zip(j["left_keys"], j["right_keys"], strict=True))
    common = (left.df, right.df, keys, (j["left_time"], j["right_time"]))
    tail = {"mode": j.get("mode", "inner"), "orders": (left.order_by, right.order_by), "prefixes": (j.get("left_prefix", "left_"), j.get("right_prefix", "right_"))}
    if node["kind"] == "window_join":
        return joins.window_join(*common, j["window_size_micros"], **tail)
    return joins.interval_join(*common, j.get("before_micros") or 0, j.get("after_micros") or 0, **tail)
