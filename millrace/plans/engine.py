"""The engine: registered streams and tables, and queries over them as SQL or graphs.

A query becomes a lazy DataFrame; nothing runs before an action.  ``validate``
binds without running, ``explain`` tells what a query does and how Spark plans it.
"""

from __future__ import annotations

import hashlib
import io
import json
from contextlib import redirect_stdout
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError, UnknownName, UnsupportedError
from millrace.functions import aggregates
from millrace.functions.expr import compile_expr, predicate, select
from millrace.functions.scalars import REGISTRY
from millrace.operators import joins, windows
from millrace.plans import sql as front
from millrace.sources import formats

MAX_INPUTS, MAX_STAGES = 4, 32


@dataclass
class Stream:
    """A finite or live table of rows with its arrival order, event time and processing clock."""

    df: DataFrame
    order_by: list[str] = field(default_factory=list)
    event_time: str | None = None
    clock: str | None = None
    out_of_orderness: int = 0
    undecoded: DataFrame | None = None  # (record, reason) of what did not decode


@dataclass
class Table:
    """A reference table: unique keys, or keys with validity from and to."""

    df: DataFrame
    keys: list[str]
    valid_from: str | None = None
    valid_to: str | None = None
    revision: int = 1


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.streams: dict[str, Stream] = {}
        self.tables: dict[str, Table] = {}

    # catalog

    def register_stream(self, name: str, df: DataFrame, order_by: list[str] | None = None, event_time: str | None = None, clock: str | None = None, out_of_orderness: int = 0) -> None:
        for c in [*(order_by or []), *[x for x in (event_time, clock) if x]]:
            if c not in df.columns:
                raise QueryError(f"stream {name}: unknown column {c}")
        self.streams[name] = Stream(df, order_by or [], event_time, clock, out_of_orderness)

    def register_records(self, name: str, df: DataFrame, column: str, schema: T.StructType, order_by: list[str] | None = None, event_time: str | None = None, clock: str | None = None) -> None:
        """A stream of JSON text records: decoded rows by schema; the others leave by a source's ``decode_error`` output."""
        good, bad = formats.decode_json(df, column, schema, "side")
        self.register_stream(name, good, order_by, event_time, clock)
        self.streams[name].undecoded = bad

    def register_table(self, name: str, df: DataFrame, keys: list[str], valid_from: str | None = None, valid_to: str | None = None, revision: int = 1) -> None:
        for c in [*keys, *[x for x in (valid_from, valid_to) if x]]:
            if c not in df.columns:
                raise QueryError(f"table {name}: unknown column {c}")
        self.tables[name] = Table(df, keys, valid_from, valid_to, revision)

    def _stream(self, name: str) -> Stream:
        if name not in self.streams:
            raise UnknownName(f"unknown stream {name}")
        return self.streams[name]

    # SQL

    def sql(self, text: str) -> DataFrame:
        """The result of a statement, lazily."""
        q = front.parse(text)
        stream = self._stream(q.table)
        for item in q.items:
            if item.expr and item.expr["k"] == "call" and item.expr["name"].lower() in front.WINDOWS:
                raise UnsupportedError(f"{item.expr['name'].upper()} belongs in GROUP BY")
        if q.join is None:
            scope = {n: [q.table, q.alias] for n in stream.df.columns}
            resolve = lambda e: _resolved(e, stream.df, scope, {})
            df = stream.df.filter(predicate(resolve(q.where), stream.df.schema)) if q.where else stream.df
            return self._windowed(q, df, stream, resolve) if q.grouped else self._projected(q, df, resolve)
        if q.grouped:
            raise UnsupportedError("GROUP BY together with JOIN or UNNEST is not supported in one statement")
        if q.join.kind == "unnest":
            return self._unnested(q, stream)
        if q.join.kind == "stream" or (q.join.table in self.streams and q.join.table not in self.tables):
            return self._stream_joined(q, stream)
        return self._looked_up(q, stream)

    def _projected(self, q, df: DataFrame, resolve) -> DataFrame:
        items: list[tuple[dict, str]] = []
        for item in q.items:
            if item.expr is None:
                items += [({"k": "col", "name": c}, c) for c in df.columns]
            else:
                if any(front.is_aggregate(e) and e["name"].lower() not in REGISTRY for e in front.walk(item.expr)):
                    raise UnsupportedError("an aggregate needs GROUP BY with a window")
                e = resolve(item.expr)
                items.append((e, item.alias or (e["name"] if e["k"] == "col" else "expr")))
        return select(df, items)

    def _windowed(self, q, df: DataFrame, stream: Stream, resolve) -> DataFrame:
        if q.window is None:
            raise UnsupportedError("GROUP BY without a window is not supported")
        spec, time = window_spec(*q.window, stream, resolve)
        keys = []
        for k in q.keys:
            e = resolve(k)
            if e["k"] != "col":
                raise UnsupportedError("a group key is a column")
            keys.append(e["name"])
        bounds = ("count_start", "count_end") if spec.kind in windows.COUNT_KINDS else ("window_start", "window_end")
        aggs, output = [], []
        for item in q.items:
            if item.expr is None:
                raise UnsupportedError("* in a windowed query is not supported")
            if front.is_aggregate(item.expr):
                args = item.expr["args"]
                if len(args) > 1 or (not args and not item.expr.get("star")):
                    raise QueryError(f"{item.expr['name']}: one argument")
                alias = f"_agg{len(aggs)}"
                aggs.append({"fn": item.expr["name"], "alias": alias} | ({"expr": resolve(args[0])} if args else {}))
                output.append((alias, item.alias or item.expr["name"].lower()))
            elif item.expr["k"] == "ref" and len(item.expr["parts"]) == 1 and item.expr["parts"][0] in bounds:
                output.append((item.expr["parts"][0], item.alias or item.expr["parts"][0]))
            else:
                e = resolve(item.expr) if item.expr["k"] == "ref" else None
                if e is None or e["k"] != "col" or e["name"] not in keys:
                    raise UnsupportedError("a windowed query selects group keys, window bounds and aggregates")
                output.append((e["name"], item.alias or e["name"]))
        if not aggs:
            raise UnsupportedError("a windowed query needs an aggregate")
        names = [n for _, n in output]
        if len(set(names)) < len(names):
            raise QueryError("output names repeat")
        if spec.skew is not None:
            now = F.unix_micros(F.current_timestamp()) + spec.skew
            df = df.filter(windows.micros(F.col(f"`{time}`"), df.schema[time].dataType) <= now)
        made = windows.aggregate(df, spec, keys, aggs, time, stream.order_by)
        return made.select(*[F.col(f"`{c}`").alias(n) for c, n in output])

    def _looked_up(self, q, stream: Stream) -> DataFrame:
        join = q.join
        if join.table not in self.tables:
            raise UnknownName(f"unknown table {join.table}")
        table = self.tables[join.table]
        left, right = {q.table, q.alias}, {join.table, join.alias}
        on = [_oriented(a, b, left, right, stream.df.columns, table.df.columns) for a, b in join.on]
        fresh = [c for c in table.df.columns if c not in (table.valid_from, table.valid_to)]
        prefix = "_t_"
        if join.as_of is not None:
            if not table.valid_from:
                raise QueryError(f"table {join.table} has no versions")
            as_of = join.as_of["parts"][-1]
            if as_of not in stream.df.columns:
                raise UnknownName(f"unknown column {as_of}")
            df = joins.versioned_lookup(stream.df, table.df, on, as_of, table.valid_from, table.valid_to, keep=fresh, inner=join.inner, prefix=prefix)
        else:
            df = joins.lookup(stream.df, table.df, on, keep=fresh, inner=join.inner, prefix=prefix)
        columns = {c: c for c in stream.df.columns} | {prefix + c: c for c in fresh}
        owners = {c: left for c in stream.df.columns} | {prefix + c: right for c in fresh}

        def resolve(e):
            return _resolved(e, df, {}, {}, lambda parts: _pick(parts, columns, owners))

        if q.where:
            df = df.filter(predicate(resolve(q.where), df.schema))
        items = []
        for item in q.items:
            if item.expr is None:
                items += [({"k": "col", "name": c}, c) for c in stream.df.columns]
                items += [({"k": "col", "name": prefix + c}, c) for c in fresh if c not in stream.df.columns and c not in [b for _, b in on]]
            else:
                e = resolve(item.expr)
                items.append((e, item.alias or (columns[e["name"]] if e["k"] == "col" else "expr")))
        return select(df, items)

    def _stream_joined(self, q, stream: Stream) -> DataFrame:
        join = q.join
        if join.match is None:
            raise UnsupportedError("a join of two streams needs INTERVAL_MATCH or WINDOW_MATCH")
        other = self._stream(join.table)
        a, b = q.alias or q.table, join.alias or join.table
        if a == b:
            raise QueryError("the two sides of a join need different aliases")
        keys = [_oriented(x, y, {q.table, a}, {join.table, b}, stream.df.columns, other.df.columns) for x, y in join.on]
        name, args = join.match
        least, most = (4, 5) if name == "interval_match" else (3, 4)
        if not least <= len(args) <= most:
            raise QueryError(f"{name.upper()}: {least} to {most} arguments")
        times = _oriented(args[0], args[1], {q.table, a}, {join.table, b}, stream.df.columns, other.df.columns)
        # rows are numbered only where the statement asks for their numbers
        named = {part for item in q.items if item.expr for e in front.walk(item.expr) if e["k"] == "ref" for part in e["parts"]} | {part for e in (front.walk(q.where) if q.where else ()) if e["k"] == "ref" for part in e["parts"]}
        every = any(item.expr is None for item in q.items)
        orders = tuple(s.order_by if every or f"join_{side}_ordinal" in named else [] for s, side in ((stream, "left"), (other, "right")))
        mode, prefixes = "inner" if join.inner else "left", (f"{a}_", f"{b}_")
        if name == "interval_match":
            df = joins.interval_join(stream.df, other.df, keys, times, front.micros_of(args[2]), front.micros_of(args[3]), mode, orders, prefixes)
        else:
            df = joins.window_join(stream.df, other.df, keys, times, front.micros_of(args[2]), mode, orders, prefixes)
        columns = {f"{a}_{c}": c for c in stream.df.columns} | {f"{b}_{c}": c for c in other.df.columns} | {c: c for c in ("join_time", "join_left_ordinal", "join_right_ordinal")}
        owners = {f"{a}_{c}": {a, q.table} for c in stream.df.columns} | {f"{b}_{c}": {b, join.table} for c in other.df.columns} | {c: set() for c in ("join_time", "join_left_ordinal", "join_right_ordinal")}

        def resolve(e):
            return _resolved(e, df, {}, {}, lambda parts: _pick(parts, columns, owners))

        if q.where:
            df = df.filter(predicate(resolve(q.where), df.schema))
        items = []
        for item in q.items:
            if item.expr is None:
                items += [({"k": "col", "name": c}, c) for c in df.columns]
            else:
                e = resolve(item.expr)
                items.append((e, item.alias or (e["name"] if e["k"] == "col" else "expr")))
        return select(df, items)

    def _unnested(self, q, stream: Stream) -> DataFrame:
        join = q.join
        own = {n: [q.table, q.alias] for n in stream.df.columns}
        item = join.names[0]
        number = join.names[1] if join.ordinality and len(join.names) > 1 else None
        df = joins.unnest(stream.df, _resolved(join.expr, stream.df, own, {}), item, number, stream.order_by, q.table)
        scope = own | {n: [join.alias] for n in join.names} | {n: [None] for n in ("unnest_source", "unnest_input", "unnest_ordinal")}
        resolve = lambda e: _resolved(e, df, scope, {})
        if q.where:
            df = df.filter(predicate(resolve(q.where), df.schema))
        return self._projected(q, df, resolve)

    # graphs, checks, plans

    def graph(self, spec: dict | str) -> dict[str, DataFrame]:
        """The results of a dataflow graph by sink name."""
        from millrace.plans.graph import bind

        return bind(self, json.loads(spec) if isinstance(spec, str) else spec).sinks

    def query(self, text_or_spec: str | dict, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
        """A finite query, over registered streams or 1 to 4 inputs of its own."""
        own = Engine(self.spark)
        own.streams, own.tables = dict(self.streams), self.tables
        if inputs is not None:
            if not 1 <= len(inputs) <= MAX_INPUTS:
                raise QueryError(f"a finite query has 1 to {MAX_INPUTS} inputs")
            for name, df in inputs.items():
                old = self.streams.get(name)
                own.streams[name] = Stream(df, old.order_by, old.event_time, old.clock) if old else Stream(df)
        if isinstance(text_or_spec, str) and not text_or_spec.lstrip().startswith("{"):
            return own.sql(text_or_spec)
        sinks = own.graph(text_or_spec)
        if len(sinks) != 1:
            raise QueryError("a finite query has one sink")
        return next(iter(sinks.values()))

    def start(self, name: str, text_or_spec: str | dict, sink, checkpoint: str, trigger: dict | None = None):
        """Run a query over live streams: ``sink(batch, batch id)`` gets every micro-batch (for a graph: by sink name).

        Returns the running queries; each has its own checkpoint, from which a restart goes on.
        """
        if isinstance(text_or_spec, str) and not text_or_spec.lstrip().startswith("{"):
            results, sinks = {name: self.sql(text_or_spec)}, {name: sink}
        else:
            results = self.graph(text_or_spec)
            sinks = sink if isinstance(sink, dict) else dict.fromkeys(results, sink)
        out = []
        for key, df in results.items():
            if not df.isStreaming:
                raise QueryError(f"{key} reads no live stream")
            writer = df.writeStream.queryName(f"{name}-{key}" if len(results) > 1 else name).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{key}")
            out.append(writer.foreachBatch(sinks[key]).trigger(**(trigger or {"processingTime": "1 second"})).start())
        return out

    def validate(self, text_or_spec: str | dict) -> T.StructType | dict[str, T.StructType]:
        """Bind without running: the schema of the result, or the error."""
        if isinstance(text_or_spec, str) and not text_or_spec.lstrip().startswith("{"):
            return self.sql(text_or_spec).schema
        return {k: df.schema for k, df in self.graph(text_or_spec).items()}

    def explain(self, text_or_spec: str | dict) -> str:
        """What a query promises (inputs, time, state, identity) and Spark's formatted plan."""
        if isinstance(text_or_spec, str) and not text_or_spec.lstrip().startswith("{"):
            results = {"result": self.sql(text_or_spec)}
            identity = json.dumps(front.parse(text_or_spec), default=vars, sort_keys=True)
        else:
            spec = json.loads(text_or_spec) if isinstance(text_or_spec, str) else text_or_spec
            results, identity = self.graph(spec), json.dumps(spec, sort_keys=True)
        lines = [f"identity: {hashlib.sha256(identity.encode()).hexdigest()[:16]}"]
        for name, df in results.items():
            lines.append(f"{name}: {df.schema.simpleString()}")
            text = io.StringIO()
            with redirect_stdout(text):
                df.explain("formatted")
            plan = text.getvalue()
            lines += [f"  state: {'ordered fold' if 'InArrow' in plan else 'window' if 'Window' in plan else 'aggregate' if 'Aggregate' in plan else 'none'}; exchanges: {plan.count('Exchange hashpartitioning') or plan.count('Exchange')}", plan]
        return "\n".join(lines)


def window_spec(name: str, args: list[dict], stream: Stream, resolve) -> tuple[windows.WindowSpec, str | None]:
    """A SQL window call as a window and its time column."""
    if name == "count_window":
        n = [front.micros_of(a) if a["k"] == "lit" else 0 for a in args]
        if len(n) == 1:
            return windows.WindowSpec("count_window", size=n[0]), None
        if len(n) == 2:
            return windows.WindowSpec("sliding_count", size=n[0], step=n[1]), None
        raise QueryError("COUNT_WINDOW: 1 or 2 arguments")
    if len(args) < 2:
        raise QueryError(f"{name.upper()}: too few arguments")
    first = args[0]
    word = first["parts"][0].lower() if first["k"] == "ref" and len(first["parts"]) == 1 else ""
    processing = word in ({"processing_time"} | front.PROCESSING.get(name, set()))
    numbers = [front.micros_of(a) for a in args[1:]]
    if processing:
        time = stream.clock or stream.event_time
        if time is None:
            raise QueryError(f"{name.upper()}: the stream has no processing clock")
    else:
        e = resolve(first)
        if e["k"] != "col":
            raise QueryError(f"{name.upper()}: the first argument is a time column")
        time = e["name"]
    arity = {("tumble", False): (1, 3), ("tumble", True): (1, 1), ("hop", False): (2, 4), ("hop", True): (2, 2), ("sliding", False): (1, 2), ("sliding", True): (1, 2), ("session", False): (2, 2), ("session", True): (2, 2)}[name, processing]
    if not arity[0] <= len(numbers) <= arity[1]:
        raise QueryError(f"{name.upper()}: wrong number of arguments")
    at = lambda i, d=0: numbers[i] if len(numbers) > i else d
    if name == "tumble":
        return windows.WindowSpec("tumble_pt" if processing else "tumble_et", size=at(0), lateness=at(1), skew=at(2, None)), time
    if name == "hop":
        return windows.WindowSpec("hop_pt" if processing else "hop", slide=at(0), size=at(1), lateness=at(2), skew=at(3, None)), time
    if name == "sliding":
        return windows.WindowSpec("sliding_pt" if processing else "sliding_et", size=at(0), delay=at(1)), time
    return windows.WindowSpec("session_pt" if processing else "session_et", gap=at(0), max_duration=at(1)), time


def _oriented(a: dict, b: dict, left: set, right: set, left_columns: list[str], right_columns: list[str]) -> tuple[str, str]:
    """The (left, right) column names of two references, in whichever order they were written."""

    def side(e: dict) -> tuple[set[str], str]:
        if e["k"] != "ref" or len(e["parts"]) > 2:
            raise UnsupportedError("ON compares columns")
        name = e["parts"][-1]
        if len(e["parts"]) == 2:
            owner = e["parts"][0]
            found = {s for s, names in (("l", left), ("r", right)) if owner in names}
            if not found:
                raise UnknownName(f"unknown alias {owner}")
        else:
            found = {s for s, names in (("l", left_columns), ("r", right_columns)) if name in names}
        return found, name

    (x, p), (y, q) = side(a), side(b)
    if "l" in x and "r" in y:
        pair = (p, q)
    elif "r" in x and "l" in y:
        pair = (q, p)
    else:
        raise QueryError("ON needs a column of each side")
    if pair[0] not in left_columns or pair[1] not in right_columns:
        raise UnknownName(f"unknown column {pair[0] if pair[0] not in left_columns else pair[1]}")
    return pair


def _pick(parts: list[str], columns: dict[str, str], owners: dict[str, set]) -> str:
    """The joined column that a reference means; without an alias it must be clear."""
    if len(parts) == 2:
        found = [c for c, n in columns.items() if n == parts[1] and parts[0] in owners[c]]
    else:
        found = [c for c, n in columns.items() if n == parts[0]] or [c for c in columns if c == parts[0]]
    if not found:
        raise UnknownName(f"unknown column {'.'.join(parts)}")
    if len(found) > 1:
        raise QueryError(f"column {parts[-1]} is ambiguous")
    return found[0]


def _resolved(e: dict, df: DataFrame, scope: dict, _: dict, pick=None) -> dict:
    """An expression with references bound to columns."""
    kind = e["k"]
    if kind == "ref":
        parts = e["parts"]
        if pick is not None:
            return {"k": "col", "name": pick(parts)}
        if len(parts) > 1 and parts[0] not in scope:
            if parts[1] in scope and parts[0] in scope[parts[1]]:
                out, rest = {"k": "col", "name": parts[1]}, parts[2:]
            else:
                raise UnknownName(f"unknown column {'.'.join(parts)}")
        elif len(parts) > 1 and parts[1] in scope and parts[0] in scope[parts[1]]:
            out, rest = {"k": "col", "name": parts[1]}, parts[2:]
        else:
            if parts[0] not in scope:
                raise UnknownName(f"unknown column {parts[0]}")
            out, rest = {"k": "col", "name": parts[0]}, parts[1:]
        for key in rest:
            out = {"k": "dyn_get", "expr": out, "key": key}
        return out
    if kind == "interval":
        return front.lit("int64", e["micros"])
    if kind == "star":
        raise UnsupportedError("a qualified wildcard is not supported")
    go = lambda x: _resolved(x, df, scope, _, pick)
    out = dict(e)
    for k in ("expr", "left", "right", "else"):
        if isinstance(e.get(k), dict):
            out[k] = go(e[k])
    if "args" in e:
        out["args"] = [go(a) for a in e["args"]]
        if out.pop("star", None):
            raise UnsupportedError(f"{e['name']}(*) is not supported here")
        if kind == "call" and e["name"].lower() == "plugin_call":
            name, version = out["args"][0]["value"]["v"], out["args"][1]["value"]["v"]
            return {"k": "plugin", "name": f"{name}@{version}", "args": out["args"][2:]}
    if "whens" in e:
        out["whens"] = [[go(c), go(v)] for c, v in e["whens"]]
    return out


__all__ = ["Engine", "Stream", "Table", "compile_expr", "window_spec"]
