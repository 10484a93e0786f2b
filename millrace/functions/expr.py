"""The expression language: one JSON-like tree that SQL and graphs share, compiled to typed columns.

Nodes: col, lit, cast, try_cast, bin, is_null, is_not_null, not, call, dyn_get,
case, neg, and plugin.  Integer arithmetic is checked (ANSI), dividing by zero
is NULL, integer division truncates; a comparison with NaN is false, ``<>`` true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError, TypeMismatch, UnknownName
from millrace.functions import udf
from millrace.functions.scalars import BOOL, DOUBLE, FLOAT_TEXT, INT_TEXT, LONG, STRING, VARIANT, Typed, call, common, guarded, no_nan
from millrace.functions.types import UINT64, UINT64_MAX, is_float, is_int, is_numeric, is_time, is_uint, parse_type

OPS = {
    "add": "+", "sub": "-", "mul": "*", "div": "/", "eq": "=", "ne": "<>", "neq": "<>", "!=": "<>", "==": "=",
    "lt": "<", "le": "<=", "lte": "<=", "gt": ">", "ge": ">=", "gte": ">=", "mod": "%",
}
FIELDS = {
    "col": {"name"}, "lit": {"value"}, "cast": {"expr", "ty"}, "try_cast": {"expr", "ty"}, "bin": {"op", "left", "right"}, "is_null": {"expr"},
    "is_not_null": {"expr"}, "not": {"expr"}, "call": {"name", "args"}, "dyn_get": {"expr", "key"}, "case": {"whens", "else"}, "neg": {"expr"}, "plugin": {"name", "args"},
}


class Scope:
    """Column names and their types, as seen by an expression."""

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}

    def column(self, name: str) -> Typed:
        if name not in self.types:
            raise UnknownName(f"unknown column {name}")
        return Typed(F.col(f"`{name}`"), self.types[name])


def compile_expr(e: dict, schema: T.StructType) -> Typed:
    """The typed column of an expression over rows of ``schema``."""
    return _compile(e, Scope(schema))


def predicate(e: dict, schema: T.StructType) -> Column:
    """A Boolean expression; anything else is an error."""
    out = compile_expr(e, schema)
    if not isinstance(out.type, T.BooleanType | T.NullType):
        raise TypeMismatch(f"a predicate is Boolean, not {out.type.simpleString()}")
    return out.col.cast("boolean")


def _compile(e: dict, scope: Scope) -> Typed:
    if not isinstance(e, dict) or e.get("k") not in FIELDS:
        raise QueryError(f"not an expression: {e!r}")
    kind = e["k"]
    if extra := set(e) - FIELDS[kind] - {"k"}:
        raise QueryError(f"{kind}: unknown field {min(extra)}")
    if kind == "col":
        return scope.column(e["name"])
    if kind == "lit":
        return literal(e["value"])
    if kind in ("cast", "try_cast"):
        return cast(_compile(e["expr"], scope), parse_type(e["ty"]), kind == "try_cast")
    if kind == "bin":
        return binary(OPS.get(e["op"].lower(), e["op"].lower()), _compile(e["left"], scope), _compile(e["right"], scope))
    if kind in ("is_null", "is_not_null"):
        x = _compile(e["expr"], scope)
        null = x.col.isNull() | F.is_variant_null(x.col) if isinstance(x.type, T.VariantType) else x.col.isNull()
        return Typed(null if kind == "is_null" else ~null, BOOL)
    if kind == "not":
        return Typed(~_bool(_compile(e["expr"], scope), "NOT"), BOOL)
    if kind == "neg":
        return binary("-", Typed(F.lit(0).cast("long"), LONG, 0, True), _compile(e["expr"], scope))
    if kind == "dyn_get":
        x = _compile(e["expr"], scope)
        if isinstance(x.type, T.StructType):
            return Typed(x.col[e["key"]], x.type[e["key"]].dataType)
        return call("object_get", [x, literal({"t": "utf8", "v": e["key"]})])
    if kind == "case":
        whens = [(_bool(_compile(c, scope), "CASE"), _compile(v, scope)) for c, v in e["whens"]]
        last = _compile(e["else"], scope) if e.get("else") else Typed(F.lit(None), T.NullType())
        values, t = common([*[v for _, v in whens], last], "CASE")
        out = F.when(whens[0][0], values[0])
        for (c, _), v in zip(whens[1:], values[1:-1], strict=True):
            out = out.when(c, v)
        return Typed(out.otherwise(values[-1]), t)
    if kind == "plugin":
        return udf.apply(e["name"], [_compile(a, scope) for a in e["args"]])
    return call(e["name"], [_compile(a, scope) for a in e["args"]])


def literal(v: dict) -> Typed:
    kind, value = v.get("t"), v.get("v")
    types = {"null": T.NullType(), "bool": BOOL, "int64": LONG, "uint64": UINT64, "float64": DOUBLE, "utf8": STRING}
    if kind not in types:
        raise QueryError(f"unknown literal type {kind}")
    if kind == "null":
        return Typed(F.lit(None), T.NullType(), None, True)
    if kind == "uint64" and not 0 <= int(value) <= UINT64_MAX:
        raise QueryError("uint64 literal out of range")
    return Typed(F.lit(str(value)).cast(UINT64) if kind == "uint64" else F.lit(value).cast(types[kind]), types[kind], value, True)


def _bool(x: Typed, what: str) -> Column:
    if not isinstance(x.type, T.BooleanType | T.NullType):
        raise TypeMismatch(f"{what}: Boolean needed, not {x.type.simpleString()}")
    return x.col.cast("boolean")


def binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("and", "or"):
        x, y = _bool(a, op.upper()), _bool(b, op.upper())
        return Typed(x & y if op == "and" else x | y, BOOL)
    if op in ("+", "-", "*", "/", "%"):
        return _arithmetic(op, a, b)
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return _comparison(op, a, b)
    raise QueryError(f"unknown operator {op}")


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    for x in (a, b):
        if isinstance(x.type, T.VariantType):
            raise TypeMismatch("a dynamic value needs a CAST before arithmetic")
        if not (is_numeric(x.type) or isinstance(x.type, T.NullType)):
            raise TypeMismatch(f"{op}: {x.type.simpleString()} is not a number")
    (x, y), t = common([a, b], op)
    if isinstance(t, T.NullType):
        return Typed(F.lit(None).cast("long"), LONG)
    if is_float(t):
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y)}[op]()
        return Typed(out, DOUBLE)
    if is_uint(t):
        wide_x, wide_y = x.cast("decimal(38,0)"), y.cast("decimal(38,0)")
        out = {"+": lambda: wide_x + wide_y, "-": lambda: wide_x - wide_y, "*": lambda: wide_x * wide_y, "/": lambda: F.when(y != 0, F.call_function("div", x, F.when(y != 0, y))), "%": lambda: F.try_mod(x, y)}[op]()
        return Typed(guarded((out >= 0) & (out <= F.lit(str(UINT64_MAX)).cast("decimal(20,0)")), out, "uint64 overflow").cast(UINT64), UINT64)
    if op == "/":
        return Typed(F.call_function("div", x, F.when(y != 0, y)), LONG)
    return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: F.try_mod(x, y)}[op](), LONG)


def _comparison(op: str, a: Typed, b: Typed) -> Typed:
    if isinstance(a.type, T.VariantType) or isinstance(b.type, T.VariantType):
        raise TypeMismatch("a dynamic value needs a CAST before a comparison")
    if is_uint(a.type) != is_uint(b.type) and not is_float(a.type) and not is_float(b.type):
        x, y = a.col.cast("decimal(20,0)"), b.col.cast("decimal(20,0)")
    else:
        (x, y), _ = common([a, b], op)
    plain = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if a.is_literal or b.is_literal:
        # against a number, NaN (Spark's greatest) passes only "greater": one guard there, and the scan sees a plain comparison
        v, other, rising = (y, a, op in ("<", "<=")) if a.is_literal else (x, b, op in (">", ">="))
        if other.literal is not None and other.literal == other.literal:
            kind = b.type if a.is_literal else a.type
            return Typed(plain & ~F.isnan(v) if rising and is_float(kind) else plain, BOOL)
    nan = [F.isnan(v) for v, s in ((x, a), (y, b)) if is_float(s.type)]
    if not nan:
        return Typed(plain, BOOL)
    some = nan[0] if len(nan) == 1 else nan[0] | nan[1]
    return Typed(F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).when(some, F.lit(op == "<>")).otherwise(plain), BOOL)


def cast(x: Typed, to: T.DataType, soft: bool) -> Typed:
    """CAST (a failure is an error) or TRY_CAST (a failure is NULL)."""

    def checked(ok: Column, value: Column, message: str) -> Typed:
        return Typed(F.when(ok, value) if soft else guarded(ok, value, message), to)

    c, f = x.col, x.type
    if f == to or isinstance(f, T.NullType):
        return Typed(c.cast(to), to, x.literal, x.is_literal)
    if isinstance(to, T.VariantType):
        return Typed(F.parse_json(F.when(c.isNotNull(), call("json_stringify", [x]).col)), to)
    if isinstance(f, T.VariantType):
        name = "double" if is_float(to) else to.simpleString()
        return Typed((F.try_variant_get if soft else F.variant_get)(c, "$", name), to)
    if is_float(f) and is_int(to):
        # truncates and saturates, NaN is 0
        inside = (c > -(2.0**63)) & (c < 2.0**63)
        return Typed(F.when(F.isnan(c), F.lit(0).cast("long")).when(c >= 2.0**63, F.lit((1 << 63) - 1)).when(c <= -(2.0**63), F.lit(-(1 << 63))).otherwise(F.when(inside, c).cast("long")), to)
    if isinstance(f, T.StringType) and (is_int(to) or is_float(to)):
        pattern = INT_TEXT if is_int(to) else FLOAT_TEXT + r"|^[+-]?(?i:inf|infinity|nan)$"
        good = c.rlike(pattern)
        value = F.when(good, c)
        return checked(good if not soft else good & value.try_cast(to).isNotNull(), value.try_cast(to) if soft else value.cast(to), f"CAST: not {to.simpleString()} text")
    if is_uint(to) and (is_int(f) or is_float(f)):
        ok = (c >= 0) & (c < 2.0**64 if is_float(f) else F.lit(True))
        return checked(ok, F.when(ok, c).cast(UINT64), "CAST: out of uint64 range")
    if is_uint(f) and is_int(to):
        ok = c <= F.lit(str((1 << 63) - 1)).cast(UINT64)
        return checked(ok, F.when(ok, c).cast("long"), "CAST: out of int64 range")
    if isinstance(to, T.StringType) and not is_time(f):
        return Typed(call("to_string", [x]).col if is_float(f) and not soft else c.cast("string"), to)
    return Typed(c.try_cast(to) if soft else c.cast(to), to)


def select(df, items: list[tuple[dict, str]]):
    """Project (also Map): (expression, alias) pairs."""
    names = [n for _, n in items]
    if len(set(names)) < len(names):
        raise QueryError("output names repeat")
    return df.select(*[compile_expr(e, df.schema).col.alias(n) for e, n in items])


__all__ = ["VARIANT", "cast", "compile_expr", "no_nan", "predicate", "select"]
