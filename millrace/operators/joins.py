"""Lookups against reference tables, event-time joins of two streams, and array expansion."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError, TypeMismatch
from millrace.functions.expr import compile_expr
from millrace.functions.scalars import as_array
from millrace.functions.types import is_float
from millrace.operators.ordering import numbered
from millrace.operators.windows import micros

#: Bytes up to which a reference table is broadcast.
BROADCAST_BYTES = 64 << 20


def _small(table: DataFrame) -> DataFrame:
    """A broadcast hint where Spark's own statistics prove the size, else the table as it is."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _same(a: Column, b: Column, t: T.DataType) -> Column:
    """Equality of join keys: NULL and NaN match nothing."""
    return (a == b) & ~F.isnan(a) if is_float(t) else a == b


def lookup(df: DataFrame, table: DataFrame, on: list[tuple[str, str]], keep: list[str] | None = None, inner: bool = False, prefix: str = "") -> DataFrame:
    """Each row with the kept columns of its table row (NULL where there is none); the table's keys are unique.

    ``on``: (stream column, table column) pairs.  ``inner`` drops rows without a table row.
    """
    keep = [c for c in table.columns if c not in [b for _, b in on]] if keep is None else keep
    for a, b in on:
        if a not in df.columns or b not in table.columns:
            raise QueryError(f"lookup: unknown key {a} = {b}")
    if clash := [c for c in keep if prefix + c in df.columns]:
        raise QueryError(f"lookup: column {clash[0]} is there already")
    right = table.select(*[F.col(f"`{b}`").alias(f"_k{i}") for i, (_, b) in enumerate(on)], *[F.col(f"`{c}`").alias(prefix + c) for c in keep])
    match = [_same(df[f"`{a}`"], right[f"_k{i}"], df.schema[a].dataType) for i, (a, _) in enumerate(on)]
    condition = match[0]
    for m in match[1:]:
        condition &= m
    return df.join(_small(right), condition, "inner" if inner else "left").drop(*[f"_k{i}" for i in range(len(on))])


def versioned_lookup(df: DataFrame, table: DataFrame, on: list[tuple[str, str]], as_of: str, valid_from: str = "valid_from", valid_to: str = "valid_to", keep: list[str] | None = None, inner: bool = False, prefix: str = "") -> DataFrame:
    """Lookup in the slice of the table that was valid at ``as_of``: ``valid_from <= as_of < valid_to`` (NULL: open)."""
    keep = [c for c in table.columns if c not in [*[b for _, b in on], valid_from, valid_to]] if keep is None else keep
    right = table.select(*[F.col(f"`{b}`").alias(f"_k{i}") for i, (_, b) in enumerate(on)], F.col(f"`{valid_from}`").alias("_from"), F.col(f"`{valid_to}`").alias("_to"), *[F.col(f"`{c}`").alias(prefix + c) for c in keep])
    at = micros(df[f"`{as_of}`"], df.schema[as_of].dataType)
    low, high = (micros(right[c], right.schema[c].dataType) for c in ("_from", "_to"))
    condition = (at >= low) & (high.isNull() | (at < high))
    for i, (a, _) in enumerate(on):
        condition &= _same(df[f"`{a}`"], right[f"_k{i}"], df.schema[a].dataType)
    return df.join(_small(right), condition, "inner" if inner else "left").drop(*[f"_k{i}" for i in range(len(on))], "_from", "_to")


def follow_latest(batch: DataFrame, tables, name: str, on: list[tuple[str, str]], keep: list[str] | None = None, inner: bool = False) -> DataFrame:
    """Lookup in the latest revision of a reference table, chosen anew for each micro-batch (call it in ``foreachBatch``)."""
    return lookup(batch, tables.get(name), on, keep, inner)


def external_lookup(df: DataFrame, on: list[str], fetch: Callable[[list[tuple]], dict[tuple, dict]], added: T.StructType, on_error: str = "fail", batch_keys: int = 256, cache_keys: int = 10_000, cache_ttl: float | None = None) -> DataFrame:
    """Lookup in an external store: ``fetch`` gets a list of keys and returns rows by key.

    Keys are asked for in batches, each once while it is among the last ``cache_keys``; order is kept.  A NULL key is a
    miss.  ``on_error``: ``fail``, ``null`` (columns NULL) or ``drop`` (row dropped).  ``cache_ttl``: seconds after which a
    key is asked for again.
    """
    if on_error not in ("fail", "null", "drop"):
        raise QueryError("on_error is fail, null or drop")
    names, columns = df.columns, [f.name for f in added.fields]

    def apply(batches: Iterator[pd.DataFrame]):
        cache: dict[tuple, dict | None] = {}
        asked: dict[tuple, float] = {}
        for b in batches:
            now = time.monotonic()
            for k in [k for k, at in asked.items() if cache_ttl is not None and at + cache_ttl <= now]:
                del cache[k], asked[k]
            keys = [tuple(k) for k in b[on].itertuples(index=False, name=None)]
            usable = [not any(pd.isna(x) for x in k) for k in keys]
            failed: set[tuple] = set()
            wanted = list(dict.fromkeys(k for k, ok in zip(keys, usable, strict=True) if ok and k not in cache))
            for i in range(0, len(wanted), batch_keys):
                part = wanted[i : i + batch_keys]
                try:
                    got = fetch(part)
                    cache.update({k: got.get(k) for k in part})
                    asked.update(dict.fromkeys(part, time.monotonic()))
                except Exception:
                    if on_error == "fail":
                        raise
                    failed.update(part)
            found = [(cache.get(k) or {}) if ok else {} for k, ok in zip(keys, usable, strict=True)]
            out = b.assign(**{c: [r.get(c) for r in found] for c in columns})
            yield out[[k not in failed for k in keys]] if on_error == "drop" else out
            while len(cache) > cache_keys:
                oldest = next(iter(cache))
                del cache[oldest], asked[oldest]

    return df.mapInPandas(apply, T.StructType([*[df.schema[c] for c in names], *added.fields]))


def _sides(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], orders: tuple[list[str], list[str]], prefixes: tuple[str, str]):
    """Both sides with prefixed columns, their time, keys and number of arrival."""
    if not 1 <= len(keys) <= 8:
        raise QueryError("a stream join has 1 to 8 keys")
    out = []
    for df, time, order, prefix, names, tag in zip((left, right), times, orders, prefixes, zip(*keys, strict=True), "lr", strict=True):
        df = numbered(df, order, "_number") if order else df.withColumn("_number", F.lit(None).cast("long"))
        key_columns = [F.col(f"`{k}`").alias(f"_{tag}k{i}") for i, k in enumerate(names)]
        out.append(df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns if c != "_number"], micros(F.col(f"`{time}`"), df.schema[time].dataType).alias(f"_{tag}t"), *key_columns, F.col("_number").alias(f"_{tag}n")))
    for a, b in keys:
        if left.schema[a].dataType != right.schema[b].dataType:
            raise TypeMismatch(f"stream join: {a} and {b} have different types")
    return out


def _joined(a: DataFrame, b: DataFrame, keys: list, types: list, more: Column, mode: str) -> DataFrame:
    if mode not in ("inner", "left"):
        raise QueryError("a stream join is inner or left")
    condition = more
    for i, t in enumerate(types):
        condition &= _same(F.col(f"_lk{i}"), F.col(f"_rk{i}"), t)
    out = a.join(b, condition, mode)
    time = F.when(F.col("_rt").isNull(), F.col("_lt")).otherwise(F.greatest("_lt", "_rt"))
    hidden = [c for c in out.columns if c in ("_lt", "_rt", "_ln", "_rn", "_lb", "_rb") or c.startswith(("_lk", "_rk"))]
    kept = [c for c in out.columns if c not in hidden]
    return out.select(*[F.col(f"`{c}`") for c in kept], time.alias("join_time"), F.col("_ln").alias("join_left_ordinal"), F.col("_rn").alias("join_right_ordinal"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], before: int, after: int, mode: str = "inner", orders: tuple[list[str], list[str]] = ((), ()), prefixes: tuple[str, str] = ("left_", "right_")) -> DataFrame:
    """Pairs with equal keys and ``right_time`` in ``[left_time - before, left_time + after]``, both ends included.

    Time is cut in buckets of the interval's length.  A left row is in the bucket of its time, a right row in the two at
    most whose times could match it: one equi-join on keys and bucket, inner or left, so one very common key is spread over
    time, no pair shows twice and no row needs a number.  ``orders`` number the rows of each side for the ordinals.
    """
    if before < 0 or after < 0:
        raise QueryError("interval bounds are not negative")
    a, b = _sides(left, right, keys, times, (list(orders[0]), list(orders[1])), prefixes)
    width = before + after + 1
    bucket = lambda t: F.call_function("div", t - F.pmod(t, F.lit(width)), F.lit(width).cast("long"))
    a = a.withColumn("_lb", bucket(F.col("_lt")))
    low, high = bucket(F.col("_rt") - after), bucket(F.col("_rt") + before)
    b = b.withColumn("_rb", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
    fits = F.col("_rt").between(F.col("_lt") - before, F.col("_lt") + after)
    return _joined(a, b, keys, [left.schema[k].dataType for k, _ in keys], (F.col("_lb") == F.col("_rb")) & fits, mode)


def window_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], size: int, mode: str = "inner", orders: tuple[list[str], list[str]] = ((), ()), prefixes: tuple[str, str] = ("left_", "right_")) -> DataFrame:
    """Pairs with equal keys in the same tumbling window of ``size``: an equi-join on keys and window."""
    if size <= 0:
        raise QueryError("a window's size is positive")
    a, b = _sides(left, right, keys, times, (list(orders[0]), list(orders[1])), prefixes)
    a = a.withColumn("_lb", F.col("_lt") - F.pmod("_lt", F.lit(size)))
    b = b.withColumn("_rb", F.col("_rt") - F.pmod("_rt", F.lit(size)))
    return _joined(a, b, keys, [left.schema[k].dataType for k, _ in keys], F.col("_lb") == F.col("_rb"), mode)


def unnest(df: DataFrame, expr: dict, as_field: str = "item", ordinality: str | None = None, order_by: list[str] | None = None, source: str | None = None, max_rows: int = 1024) -> DataFrame:
    """A row for each element of an array: all input columns, the element, and where it came from.

    NULL and empty arrays give no row.  ``unnest_input`` numbers the input rows by arrival (those without elements too),
    ``unnest_ordinal`` the elements from 1.  More than ``max_rows`` elements are an error.
    """
    added = [as_field, "unnest_source", "unnest_input", "unnest_ordinal", *([ordinality] if ordinality else [])]
    if clash := [c for c in added if c in df.columns]:
        raise QueryError(f"UNNEST: column {clash[0]} is there already")
    items, _ = as_array(compile_expr(expr, df.schema), "UNNEST")
    checked = F.when(F.coalesce(F.size(items) <= max_rows, F.lit(True)), items).otherwise(F.raise_error(F.lit(f"UNNEST: more than {max_rows} elements")))
    rows = numbered(df, order_by, "_input") if order_by else df.withColumn("_input", F.lit(None).cast("long"))
    rows = rows.withColumn("_items", checked)
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], "_input", F.posexplode("_items").alias("_pos", as_field))
    ordinal = (F.col("_pos") + 1).cast("long")
    extra = [ordinal.alias(ordinality)] if ordinality else []
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{as_field}`"), F.lit(source).cast("string").alias("unnest_source"), F.col("_input").alias("unnest_input"), ordinal.alias("unnest_ordinal"), *extra)
