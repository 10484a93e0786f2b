"""The eleven aggregates of windows, as Catalyst aggregates and as plain functions for folds.

NULL inputs are skipped (except by COUNT(*)); MIN and MAX skip NaN too; FIRST
and LAST follow an explicit order, so a shuffle cannot change them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from millrace.errors import QueryError, TypeMismatch, UnknownName
from millrace.functions.expr import compile_expr
from millrace.functions.scalars import Typed, guarded, no_nan
from millrace.functions.types import UINT64, UINT64_MAX, is_float, is_int, is_numeric, is_uint

ALIASES = {"average": "avg", "mean": "avg", "variance": "var_samp", "stddev": "stddev_samp"}
NAMES = ("count", "sum", "avg", "min", "max", "first", "last", "var_pop", "var_samp", "stddev_pop", "stddev_samp")


def name_of(fn: str) -> str:
    name = ALIASES.get(fn.lower(), fn.lower())
    if name not in NAMES:
        raise UnknownName(f"unknown aggregate {fn}")
    return name


def build(fn: str, x: Typed | None, order: Column | None = None, over: WindowSpec | None = None) -> Column:
    """An aggregate of ``x`` (None: of rows), in ``order`` for FIRST and LAST, or over a frame."""
    name = name_of(fn)
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    if x is None:
        if name != "count":
            raise QueryError(f"{name} needs an argument")
        return at(F.count("*"))
    if name == "count":
        return at(F.count(x.col))
    if name in ("min", "max"):
        return at((F.min if name == "min" else F.max)(no_nan(x)))
    if name in ("first", "last"):
        if order is None:
            raise QueryError(f"{name} needs an order")
        place = F.when(x.col.isNotNull(), order)
        return at((F.min_by if name == "first" else F.max_by)(x.col, place))
    if not is_numeric(x.type):
        raise TypeMismatch(f"{name}: {x.type.simpleString()} is not a number")
    if name == "sum":
        if is_int(x.type):
            return at(F.sum(x.col.cast("long")))
        if is_uint(x.type):
            total = at(F.sum(x.col.cast("decimal(28,0)")))
            return guarded(total <= F.lit(str(UINT64_MAX)).cast("decimal(20,0)"), total, "SUM: uint64 overflow").cast(UINT64)
        return at(F.sum(x.col.cast("double")))
    c = x.col.cast("double")
    if name == "avg":
        return at(F.avg(c))
    if is_float(x.type):
        c = guarded(~F.isnan(c) & (F.abs(c) < float("inf")), c, f"{name}: input is not finite")
    return at({"var_pop": F.var_pop, "var_samp": F.var_samp, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp}[name](c))


def over_both(fn: str, x: Typed | None, order: Column, earlier: WindowSpec, later: WindowSpec) -> Column:
    """An aggregate over the rows of two frames, of which all of ``earlier`` come before those of ``later``."""
    name = name_of(fn)
    if name in ("count", "min", "max", "first", "last"):
        a, b = (build(fn, x, order, w) for w in (earlier, later))
        if name == "count":
            return a + b
        if name in ("min", "max"):
            return (F.least if name == "min" else F.greatest)(a, b)
        return F.coalesce(a, b) if name == "first" else F.coalesce(b, a)
    if name == "sum":
        a, b = (build(fn, x, order, w) for w in (earlier, later))
        total = F.coalesce(a + b, a, b)
        return guarded(total <= F.lit(str(UINT64_MAX)).cast("decimal(20,0)"), total, "SUM: uint64 overflow").cast(UINT64) if is_uint(x.type) else total
    number = Typed(x.col.cast("double"), T.DoubleType()) if is_numeric(x.type) else x
    na, nb, sa, sb = (build(f, number, order, w) for f in ("count", "sum") for w in (earlier, later))
    n = (na + nb).cast("double")
    if name == "avg":
        return F.coalesce(sa + sb, sa, sb) / F.when(n > 0, n)
    # squares about either mean, and what lies between the means
    va, vb = (F.coalesce(build("var_pop", x, order, w), F.lit(0.0)) for w in (earlier, later))
    apart = sa / F.when(na > 0, na) - sb / F.when(nb > 0, nb)
    squares = va * na + vb * nb + F.coalesce(apart * apart * na * nb / F.when(n > 0, n), F.lit(0.0))
    spare = 1 if name.endswith("samp") else 0
    var = squares / F.when(n > spare, n - spare)
    return F.sqrt(var) if name.startswith("stddev") else var


def all_of(aggs: list[dict], schema: T.StructType, order: Column | None = None, over: WindowSpec | None = None, after: WindowSpec | None = None) -> list[Column]:
    """Columns for graph-style aggregates {fn, expr?, alias}; over two frames with ``after``."""
    if not aggs:
        raise QueryError("a window needs an aggregate")
    out = []
    for a in aggs:
        if extra := set(a) - {"fn", "expr", "alias"}:
            raise QueryError(f"aggregate: unknown field {min(extra)}")
        x = compile_expr(a["expr"], schema) if a.get("expr") else None
        made = build(a["fn"], x, order, over) if after is None else over_both(a["fn"], x, order, over, after)
        out.append(made.alias(a["alias"]))
    return out


def of_values(fn: str, values: list, star: bool = False):
    """The same aggregates over values in order, for folds that keep their rows."""
    name = name_of(fn)
    if star:
        return len(values)
    seen = [v for v in values if v is not None]
    if name == "count":
        return len(seen)
    if name in ("min", "max"):
        seen = [v for v in seen if v == v]
        return (min if name == "min" else max)(seen) if seen else None
    if not seen:
        return None
    if name in ("first", "last"):
        return seen[0 if name == "first" else -1]
    if name == "sum":
        total = sum(seen)
        if isinstance(total, int) and not -(1 << 63) <= total < 1 << 63:
            raise OverflowError("SUM: int64 overflow")
        return total
    if name == "avg":
        return math.fsum(seen) / len(seen) if all(map(math.isfinite, seen)) else sum(seen) / len(seen)
    if not all(map(math.isfinite, seen)):
        raise ValueError(f"{name}: input is not finite")
    mean = math.fsum(seen) / len(seen)
    spare = 1 if name.endswith("samp") else 0
    if len(seen) <= spare:
        return None
    var = math.fsum((v - mean) ** 2 for v in seen) / (len(seen) - spare)
    return math.sqrt(var) if name.startswith("stddev") else var


def result_type(fn: str, x: T.DataType | None) -> T.DataType:
    name = name_of(fn)
    if name == "count":
        return T.LongType()
    if name in ("min", "max", "first", "last"):
        return x
    if name == "sum" and (is_int(x) or is_uint(x)):
        return T.LongType() if is_int(x) else UINT64
    return T.DoubleType()
