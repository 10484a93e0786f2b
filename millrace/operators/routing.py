"""Filters with a reject output, routes, branches and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import QueryError
from millrace.functions.expr import predicate

MAX_CASES, MAX_INPUTS = 16, 16


def filter_rows(df: DataFrame, expr: dict) -> DataFrame:
    """Rows for which the predicate is TRUE."""
    return df.filter(predicate(expr, df.schema))


def rejected(df: DataFrame, expr: dict) -> DataFrame:
    """Rows for which it is not: FALSE or NULL."""
    return df.filter(~F.coalesce(predicate(expr, df.schema), F.lit(False)))


def route(df: DataFrame, cases: list[tuple[dict, str]], default: str, mode: str = "first_match") -> dict[str, DataFrame]:
    """Outputs by name: rows go to the first case that is TRUE, or to all; without any, to the default.  NULL is no match."""
    if not 1 <= len(cases) <= MAX_CASES:
        raise QueryError(f"a route has 1 to {MAX_CASES} cases")
    if mode not in ("first_match", "all_match"):
        raise QueryError("route mode is first_match or all_match")
    hits = [F.coalesce(predicate(e, df.schema), F.lit(False)) for e, _ in cases]
    wants: dict[str, Column] = {}
    for i, (_, to) in enumerate(cases):
        want = hits[i]
        if mode == "first_match":
            want = reduce(lambda a, b: a & ~b, hits[:i], want)
        wants[to] = wants[to] | want if to in wants else want
    none = reduce(lambda a, b: a & ~b, hits[1:], ~hits[0])
    wants[default] = wants[default] | none if default in wants else none
    return {to: df.filter(want) for to, want in wants.items()}


def branch(df: DataFrame, outputs: list[str]) -> dict[str, DataFrame]:
    """Every row to every output."""
    return dict.fromkeys(outputs, df)


def union_all(inputs: list[DataFrame]) -> DataFrame:
    """All rows of 2 to 16 inputs with one schema."""
    if not 2 <= len(inputs) <= MAX_INPUTS:
        raise QueryError(f"a union has 2 to {MAX_INPUTS} inputs")
    shape = [(f.name, f.dataType) for f in inputs[0].schema.fields]
    if any([(f.name, f.dataType) for f in d.schema.fields] != shape for d in inputs[1:]):
        raise QueryError("union inputs have different schemas")
    return reduce(DataFrame.unionByName, inputs)
