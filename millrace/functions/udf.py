"""Registered scalar functions and row transforms of the user.

A scalar gets Arrow batches of its arguments as pandas Series; a transform gets
batches of rows (``mapInPandas``).  Names carry a version, so a registration is
never replaced silently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError, UnknownName
from millrace.functions.scalars import Typed

MAX_ARGS = 8
_SCALARS: dict[str, "Scalar"] = {}
_TRANSFORMS: dict[str, tuple[Callable, T.StructType]] = {}


@dataclass(frozen=True)
class Scalar:
    of: Callable
    args: tuple[T.DataType, ...]
    result: T.DataType
    null_in_null_out: bool


def register_scalar(name: str, version: int, of: Callable, args: list[T.DataType], result: T.DataType, null_in_null_out: bool = True) -> str:
    """Register ``of`` (Series, ... -> Series) and return the name to call it by."""
    key = f"{name}@{version}"
    if key in _SCALARS:
        raise QueryError(f"function {key} is registered; take a new version")
    if len(args) > MAX_ARGS:
        raise QueryError(f"a function has at most {MAX_ARGS} arguments")
    _SCALARS[key] = Scalar(of, tuple(args), result, null_in_null_out)
    return key


def apply(name: str, args: list[Typed]) -> Typed:
    if name not in _SCALARS:
        raise UnknownName(f"unknown function {name}")
    f = _SCALARS[name]
    if len(args) != len(f.args):
        raise QueryError(f"{name}: {len(f.args)} arguments, not {len(args)}")
    cols = [a.col.cast(t) for a, t in zip(args, f.args, strict=True)]
    out = F.pandas_udf(f.of, f.result)(*(cols or [F.lit(1)]))
    if f.null_in_null_out:
        for c in cols:
            out = F.when(c.isNotNull(), out)
    return Typed(out, f.result)


def register_transform(name: str, version: int, of: Callable, result: T.StructType) -> str:
    """Register ``of`` (iterator of DataFrames -> iterator of DataFrames), rows to rows."""
    key = f"{name}@{version}"
    if key in _TRANSFORMS:
        raise QueryError(f"transform {key} is registered; take a new version")
    _TRANSFORMS[key] = (of, result)
    return key


def transform(df: DataFrame, name: str) -> DataFrame:
    if name not in _TRANSFORMS:
        raise UnknownName(f"unknown transform {name}")
    of, result = _TRANSFORMS[name]
    return df.mapInPandas(of, result)
