"""Keyed state operators over finite tables and streams.

On finite tables, where the state is the row before, or the last definite state, a window function
is the whole operator and Catalyst runs it; the rest are folds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError
from millrace.functions.types import is_float
from millrace.operators import folds
from millrace.operators.windows import micros


def checked_keys(df: DataFrame, keys: list[str]) -> None:
    if not 1 <= len(keys) <= 16:
        raise QueryError("1 to 16 keys")
    for k in keys:
        if k not in df.columns:
            raise QueryError(f"unknown key {k}")
        if is_float(df.schema[k].dataType):
            raise QueryError(f"key {k} is a float")


def _finite(df: DataFrame, fields: list[str]) -> Column:
    """Whether all fields of a row are there and finite."""

    def good(f):
        c = F.col(f"`{f}`")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) if is_float(df.schema[f].dataType) else c.isNotNull()

    return F.coalesce(reduce(lambda a, b: a & b, [good(f) for f in fields], F.lit(True)), F.lit(False))


def bounded(df: DataFrame, keys: list[str], fields: list[str], max_keys: int, invalid: str = "error") -> DataFrame:
    """A finite table as it is, or an error where valid rows have more keys than ``max_keys``: state that is never forgotten.

    One subquery counts the distinct keys, no further than the first beyond the limit.
    """
    checked_keys(df, keys)
    if df.isStreaming:
        return df
    if max_keys < 0:
        raise QueryError("max_keys is positive")
    rows = df.filter(_finite(df, fields)) if invalid == "ignore" else df
    found = rows.select(*[F.col(f"`{k}`") for k in keys]).distinct().limit(max_keys + 1).agg(F.count("*")).scalar()
    return df.filter(F.when(found <= max_keys, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {max_keys} keys"))))


def _valid(df: DataFrame, fields: list[str], invalid: str) -> DataFrame:
    """Rows whose fields are all there and finite; others are skipped or an error."""
    if invalid not in ("error", "ignore"):
        raise QueryError("invalid is error or ignore")
    ok = _finite(df, fields)
    if invalid == "ignore":
        return df.filter(ok)
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"NULL or non-finite value in {', '.join(fields)}"))))


def _ordered(df: DataFrame, keys: list[str], order_by: list[str]):
    checked_keys(df, keys)
    if not order_by:
        raise QueryError("an arrival order is needed")
    return Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.col(f"`{c}`") for c in order_by])


def _clock(df: DataFrame, clock: str | None) -> Column:
    return micros(F.col(f"`{clock}`"), df.schema[clock].dataType) if clock else F.lit(0).cast("long")


def _clocked(df: DataFrame, w, ttl: int, clock: str | None) -> DataFrame:
    """With a time to live, the key's clock, which never runs backwards, as ``_now``."""
    return df.withColumn("_now", F.max(_clock(df, clock)).over(w.rowsBetween(Window.unboundedPreceding, 0))) if ttl else df


def _remembered(before: Column, w, ttl: int) -> Column:
    """What the valid row before left behind, unless it is forgotten by now."""
    return F.when(F.lag("_now").over(w) + ttl > F.col("_now"), before) if ttl else before


def _kept(df: DataFrame, emit: Column, columns: list[str]) -> DataFrame:
    return df.withColumn("_emit", emit).filter("_emit").select(*[F.col(f"`{c}`") for c in columns])


def _fold(df: DataFrame, fold: folds.Fold, clock: str | None, order_by: list[str], until: int | None = None, seeds: list[tuple] | None = None) -> DataFrame:
    """The fold over a finite table, or over a stream (whose deadlines also fire without rows if it has no clock column)."""
    if df.isStreaming:
        from millrace.streaming.stateful import run_stream

        return run_stream(df, fold, _clock(df, clock) if clock else None, order_by)
    return folds.run(df, fold, _clock(df, clock), [F.col(f"`{c}`") for c in order_by], until, seeds)


def change_detect(df: DataFrame, keys: list[str], fields: list[str], order_by: list[str], emit_first: bool = True, invalid: str = "error", ttl: int = 0, clock: str | None = None) -> DataFrame:
    """Rows in which any field differs from the key's valid row before."""
    w = _ordered(df, keys, order_by)
    if df.isStreaming:
        return _fold(df, folds.ChangeDetect(keys=keys, fields=fields, invalid=invalid, emit_first=emit_first, ttl=ttl), clock, order_by)
    rows = _valid(_clocked(df, w, ttl, clock), fields, invalid)
    now = F.struct(*[F.col(f"`{f}`") for f in fields])
    before = _remembered(F.lag(now).over(w), w, ttl)
    return _kept(rows, F.when(before.isNull(), F.lit(emit_first)).otherwise(before != now), df.columns)


def deadband(df: DataFrame, keys: list[str], field: str, threshold: float, order_by: list[str], relative: bool = False, baseline: str = "last_output", emit_first: bool = True, invalid: str = "error", ttl: int = 0, clock: str | None = None) -> DataFrame:
    """Rows whose field moved by more than the threshold from the last input or the last output."""
    if baseline not in ("last_input", "last_output"):
        raise QueryError("baseline is last_input or last_output")
    w = _ordered(df, keys, order_by)
    if baseline == "last_output" or df.isStreaming:
        return _fold(df, folds.Deadband(keys=keys, fields=[field], invalid=invalid, emit_first=emit_first, ttl=ttl, threshold=threshold, relative=relative, last_output=baseline == "last_output"), clock, order_by)
    rows = _valid(_clocked(df, w, ttl, clock), [field], invalid)
    x = F.col(f"`{field}`").cast("double")
    before = _remembered(F.lag(x).over(w), w, ttl)
    gap = F.abs(x - before)
    moved = F.when(before == 0, x != 0).otherwise(gap / F.abs(F.when(before != 0, before)) > threshold) if relative else gap > threshold
    return _kept(rows, F.when(before.isNull(), F.lit(emit_first)).otherwise(moved), df.columns)


def hysteresis(df: DataFrame, keys: list[str], field: str, enter: float, exit: float, order_by: list[str], high: bool = True, emit_first: bool = True, invalid: str = "error") -> DataFrame:
    """Rows at which the latch flips; what the last value beyond a threshold said is the latch."""
    fold = folds.Hysteresis(keys=keys, fields=[field], invalid=invalid, emit_first=emit_first, enter=enter, exit=exit, high=high)
    w = _ordered(df, keys, order_by)
    if df.isStreaming:
        return _fold(df, fold, None, order_by)
    rows = _valid(df, [field], invalid)
    x = F.col(f"`{field}`").cast("double")
    on, off = (x >= enter, x <= exit) if high else (x <= enter, x >= exit)
    rows = rows.withColumn("_latch", F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    before = F.lag("_latch").over(w)
    return _kept(rows, F.when(before.isNull(), F.lit(emit_first)).otherwise(before != F.col("_latch")), df.columns)


def deduplicate(df: DataFrame, keys: list[str], ttl: int, order_by: list[str], clock: str | None) -> DataFrame:
    """A key's first row, and each first row at least ``ttl`` after the last one let through."""
    if ttl <= 0:
        raise QueryError("deduplicate: ttl is positive")
    if missing := [k for k in keys if k not in df.columns]:
        raise QueryError(f"unknown key {missing[0]}")
    return _fold(df, folds.Deduplicate(keys=keys, ttl=ttl), clock, order_by)


def _boolean(df: DataFrame, fields: list[str]) -> None:
    for f in fields:
        if not isinstance(df.schema[f].dataType, T.BooleanType):
            raise QueryError(f"{f} is not Boolean")


def hold_for(df: DataFrame, keys: list[str], field: str, duration: int, order_by: list[str], clock: str | None, invalid: str = "error", until: int | None = None) -> DataFrame:
    """The latest row once the Boolean field has held for ``duration``."""
    checked_keys(df, keys)
    _boolean(df, [field])
    return _fold(df, folds.HoldFor(keys=keys, fields=[field], invalid=invalid, duration=duration), clock, order_by, until)


def debounce(df: DataFrame, keys: list[str], fields: list[str], quiet: int, max_wait: int, order_by: list[str], clock: str | None, leading: bool = False, trailing: bool = True, reset_on_repeat: bool = True, invalid: str = "error", until: int | None = None) -> DataFrame:
    """One or two rows for each burst."""
    checked_keys(df, keys)
    fold = folds.Debounce(keys=keys, fields=fields, invalid=invalid, quiet=quiet, max_wait=max_wait, leading=leading, trailing=trailing, reset_on_repeat=reset_on_repeat)
    return _fold(df, fold, clock, order_by, until)


def alarm(df: DataFrame, keys: list[str], enter: str, clear: str, order_by: list[str], clock: str | None, activate: int = 0, resolve: int = 0, cooldown: int = 0, max_age: int = 1, invalid: str = "error", until: int | None = None, operator: int = 0) -> DataFrame:
    """Alarm events: activate, notify and resolve, with episodes and a notification cooldown."""
    checked_keys(df, keys)
    _boolean(df, [enter, clear])
    if min(activate, resolve, cooldown) < 0 or max_age <= 0:
        raise QueryError("alarm: durations are not negative, the notification's age is positive")
    fold = folds.Alarm(keys=keys, fields=[enter, clear], invalid=invalid, activate=activate, resolve=resolve, cooldown=cooldown, max_age=max_age, operator=operator)
    return _fold(df, fold, clock, order_by, until)


def silence(df: DataFrame, keys: list[str], duration: int, order_by: list[str], clock: str | None, since: int | None = 0, registered: list[tuple] | None = None, until: int | None = None, max_observation_gap: int | None = None, operator: int = 0) -> DataFrame:
    """Keys that fall silent, and resume; registered keys may never have had a row."""
    checked_keys(df, keys)
    if duration <= 0 or (max_observation_gap is not None and duration < 2 * max_observation_gap):
        raise QueryError("silence: the duration is at least twice the observation gap")
    fold = folds.Silence(keys=keys, duration=duration, since=since, operator=operator, registered=frozenset(registered or ()))
    return _fold(df, fold, clock, order_by, until, registered)


def resample(df: DataFrame, keys: list[str], fields: list[str], period: int, order_by: list[str], clock: str | None, mode: str = "last", max_wait: int = 0, max_gap: int = 0, invalid: str = "error", until: int | None = None, operator: int = 0) -> DataFrame:
    """Values on every point of a grid."""
    checked_keys(df, keys)
    fold = folds.Resample(keys=keys, fields=fields, invalid=invalid, mode=mode, period=period, max_wait=max_wait, max_gap=max_gap, operator=operator)
    return _fold(df, fold, clock, order_by, until)
