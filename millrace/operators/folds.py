"""Ordered folds: the keyed state operators that no window function expresses.

A fold has one definition and two ways to run.  In batch, rows are sorted by key
and arrival and streamed through it (``run``): memory holds one key's state,
never a key's rows.  On streams the state lives in Spark's state store
(``millrace.streaming.stateful``).

A fold works on plain tuples.  ``row`` gets the clock and a row after all
deadlines up to the clock have been drained (``due``); silence alone applies its
row first.  The clock never runs backwards within a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.errors import QueryError
from millrace.functions import aggregates


class InvalidRow(ValueError):
    """A NULL or non-finite field where the policy is ``error``."""


def valid(values: list) -> bool:
    return all(v is not None and not (isinstance(v, float) and not math.isfinite(v)) for v in values)


@dataclass
class Fold:
    """keys and fields are column names; ``bind`` learns where they are."""

    keys: list[str]
    fields: list[str] = field(default_factory=list)
    invalid: str = "error"

    row_first = False  # of an equal clock, the row comes before the deadline

    def bind(self, names: list[str]) -> None:
        missing = [c for c in [*self.keys, *self.fields] if c not in names]
        if missing:
            raise QueryError(f"unknown column {missing[0]}")
        self.at = [names.index(c) for c in self.fields]
        self.key_at = [names.index(c) for c in self.keys]
        self.names = names

    def output(self, schema: T.StructType) -> T.StructType:
        return schema

    def start(self, key: tuple) -> dict:
        return {}

    def deadline(self, state: dict) -> int | None:
        return None

    def worthless(self, state: dict) -> int | None:
        """From when on the state is as good as none, so that it may be removed; None: never."""
        return None

    def expire(self, state: dict, at: int) -> list[tuple]:
        """What happens at the deadline ``at``; must change the state so that the deadline moves."""
        return []

    def row(self, state: dict, now: int, row: tuple) -> list[tuple]:
        raise NotImplementedError

    # shared steps

    def usable(self, row: tuple) -> list | None:
        """The fields of a valid row; None to skip it."""
        values = [row[i] for i in self.at]
        if valid(values):
            return values
        if self.invalid == "ignore":
            return None
        raise InvalidRow(f"NULL or non-finite value in {self.fields}")

    def due(self, state: dict, now: int) -> list[tuple]:
        out: list[tuple] = []
        while (at := self.deadline(state)) is not None and at <= now:
            out += self.expire(state, at)
        return out

    def step(self, state: dict, now: int, row: tuple) -> list[tuple]:
        now = max(now, state.get("now", now))
        state["now"] = now
        if self.row_first:
            return self.row(state, now, row) + self.due(state, now)
        return self.due(state, now) + self.row(state, now, row)


@dataclass
class Keyed(Fold):
    """A fold whose state is forgotten ``ttl`` after the last valid row (0: never)."""

    emit_first: bool = True
    ttl: int = 0

    def row(self, state, now, row):
        values = self.usable(row)
        if values is None:
            return []
        if self.ttl and "seen" in state and state["seen"] + self.ttl <= now:
            for k in ("seen", "value", "latch"):
                state.pop(k, None)
        first = "seen" not in state
        state["seen"] = now
        emit = self.change(state, values, first)
        return [row] if (self.emit_first if first else emit) else []

    def worthless(self, state):
        return state["seen"] + self.ttl if self.ttl and "seen" in state else None

    def change(self, state: dict, values: list, first: bool) -> bool:
        raise NotImplementedError


@dataclass
class ChangeDetect(Keyed):
    """Rows that differ from the valid row before in any field."""

    def change(self, state, values, first):
        differs = not first and state["value"] != values
        state["value"] = values
        return differs


@dataclass
class Deadband(Keyed):
    """Rows whose one field moved by more than the threshold, absolutely or relative to the baseline."""

    threshold: float = 0.0
    relative: bool = False
    last_output: bool = True

    def change(self, state, values, first):
        (x,) = values
        if first:
            state["value"] = x
            return False
        base = state["value"]
        gap = abs(float(x) - float(base))
        moved = (x != 0 if base == 0 else gap / abs(float(base)) > self.threshold) if self.relative else gap > self.threshold
        if moved or not self.last_output:
            state["value"] = x
        return moved


@dataclass
class Hysteresis(Keyed):
    """Rows at which a latch flips: ``enter`` sets it, ``exit`` clears it (both inclusive)."""

    enter: float = 0.0
    exit: float = 0.0
    high: bool = True

    def __post_init__(self):
        if (self.enter <= self.exit) if self.high else (self.enter >= self.exit):
            raise QueryError("hysteresis: enter lies above exit for high, below it for low")
        if self.ttl:
            raise QueryError("hysteresis has no ttl")

    def change(self, state, values, first):
        (x,) = values
        was = state.get("latch", False)
        on, off = (x >= self.enter, x <= self.exit) if self.high else (x <= self.enter, x >= self.exit)
        state["latch"] = not off if was else on
        return state["latch"] != was


@dataclass
class Deduplicate(Fold):
    """The first row of a key, and the first one at least ``ttl`` after the last that was let through."""

    ttl: int = 1

    def worthless(self, state):
        return state["let"] + self.ttl if "let" in state else None

    def row(self, state, now, row):
        if "let" in state and now - state["let"] < self.ttl:
            return []
        state["let"] = now
        return [row]


@dataclass
class HoldFor(Fold):
    """The latest row once its Boolean field has been true for ``duration``; silent then until a false."""

    duration: int = 1

    def row(self, state, now, row):
        values = self.usable(row)
        if values is None:
            return []
        if not values[0]:
            state.pop("row", None)
            state.pop("deadline", None)
        else:
            if "row" not in state:
                state["deadline"] = now + self.duration
            state["row"] = row
        return []

    def deadline(self, state):
        return state.get("deadline")

    def expire(self, state, at):
        del state["deadline"]
        return [state["row"]]


@dataclass
class Debounce(Fold):
    """One row for a burst: the first (leading), the last (trailing), or both; a burst ends after ``quiet`` or ``max_wait``."""

    quiet: int = 1
    max_wait: int = 1
    leading: bool = False
    trailing: bool = True
    reset_on_repeat: bool = True

    def __post_init__(self):
        if self.quiet <= 0 or self.max_wait < self.quiet or not (self.leading or self.trailing):
            raise QueryError("debounce: 0 < quiet <= max_wait, leading or trailing")

    def row(self, state, now, row):
        values = self.usable(row)
        if values is None:
            return []
        if "row" not in state:
            state.update(start=now, count=1, row=row, values=values, deadline=min(now + self.quiet, now + self.max_wait))
            return [row] if self.leading else []
        if self.reset_on_repeat or values != state["values"]:
            state["deadline"] = min(now + self.quiet, state["start"] + self.max_wait)
        state.update(count=state["count"] + 1, row=row, values=values)
        return []

    def deadline(self, state):
        return state.get("deadline")

    def expire(self, state, at):
        out = [state["row"]] if self.trailing and (not self.leading or state["count"] > 1) else []
        for k in ("start", "count", "row", "values", "deadline"):
            del state[k]
        return out


@dataclass
class Alarm(Fold):
    """Alarm lifecycle over an enter and a clear field: Normal, Pending, Active, Recovering.

    Emits the latest valid row with an event (activate, notify, resolve), phase, episode, time and whether to notify.
    """

    activate: int = 0
    resolve: int = 0
    cooldown: int = 0
    max_age: int = 1
    operator: int = 0
    generation: str = "batch"

    ADDED = (("alarm_event", "string"), ("alarm_phase", "string"), ("alarm_generation", "string"), ("alarm_operator", "decimal(20,0)"), ("alarm_episode", "decimal(20,0)"), ("alarm_time", "bigint"), ("alarm_notify", "boolean"))

    def output(self, schema):
        return T.StructType([*schema.fields, *[T.StructField(n, T._parse_datatype_string(t), True) for n, t in self.ADDED]])

    def start(self, key):
        return {"phase": "normal", "episode": 0, "not_before": 0}

    def _event(self, state, event, at, notify):
        return [(*state["row"], event, state["phase"], self.generation, self.operator, state["episode"], at, notify)]

    def _activate(self, state, at):
        state.update(phase="active", episode=state["episode"] + 1)
        notify = at >= state["not_before"]
        if notify:
            state["not_before"] = at + self.cooldown
        else:
            state["since"] = at
        return self._event(state, "activate", at, notify)

    def _resolve(self, state, at):
        state.pop("since", None)
        state.update(phase="normal", not_before=at + self.cooldown)
        return self._event(state, "resolve", at, True)

    def row(self, state, now, row):
        for v in row:
            if isinstance(v, float) and not math.isfinite(v):
                raise InvalidRow("alarm: a retained value is not finite")
        enter, clear = (row[i] for i in self.at)
        if enter is None or clear is None or (enter and clear):
            if self.invalid == "ignore":
                return []
            raise InvalidRow("alarm: enter and clear are both true, or NULL")
        state["row"] = row
        phase = state["phase"]
        if phase == "normal" and enter:
            if self.activate == 0:
                return self._activate(state, now)
            state.update(phase="pending", deadline=now + self.activate)
        elif phase == "pending" and not enter:
            state.update(phase="normal", deadline=None)
        elif phase == "active" and clear:
            if self.resolve == 0:
                return self._resolve(state, now)
            state.update(phase="recovering", deadline=now + self.resolve)
        elif phase == "recovering" and not clear:
            state.update(phase="active", deadline=None)
        return []

    def _notification(self, state):
        return min(state["not_before"], state["since"] + self.max_age) if "since" in state else None

    def deadline(self, state):
        both = [d for d in (state.get("deadline"), self._notification(state)) if d is not None]
        return min(both) if both else None

    def expire(self, state, at):
        if state.get("deadline") == at:
            state["deadline"] = None
            return self._activate(state, at) if state["phase"] == "pending" else self._resolve(state, at)
        since = state.pop("since")
        if since + self.max_age <= at:
            return []  # too old: dropped
        state["not_before"] = at + self.cooldown
        return self._event(state, "notify", at, True)


@dataclass
class Silence(Fold):
    """Keys without a row for ``duration`` of covered time: silent, and resumed at their next row.

    ``since``: start of verified coverage (None: no verdicts).  Registered keys may never have been seen.
    """

    duration: int = 1
    since: int | None = 0
    operator: int = 0
    generation: str = "batch"
    registered: frozenset = frozenset()

    row_first = True
    ADDED = (("silence_event", "string"), ("silence_generation", "string"), ("silence_operator", "decimal(20,0)"), ("silence_episode", "decimal(20,0)"), ("silence_time", "bigint"), ("silence_last_seen", "bigint"), ("silence_never_seen", "boolean"))

    def output(self, schema):
        return T.StructType([*[schema[k] for k in self.keys], *[T.StructField(n, T._parse_datatype_string(t), True) for n, t in self.ADDED]])

    def start(self, key):
        return {"key": key, "seen": None, "silent": False, "episode": 0, "known": key in self.registered}

    def _event(self, state, event, at):
        return [(*state["key"], event, self.generation, self.operator, state["episode"], at, state["seen"], state["seen"] is None)]

    def row(self, state, now, row):
        out = []
        if state["silent"]:
            state.update(silent=False)
            out = self._event(state | {"seen": now}, "resumed", now)
        state.update(seen=now, known=True)
        return out

    def step(self, state, now, row):
        # deadlines before this clock come first; at an equal clock the row does
        now = max(now, state.get("now", now))
        state["now"] = now
        return self.due(state, now - 1) + self.row(state, now, row) + self.due(state, now)

    def deadline(self, state):
        if state["silent"] or self.since is None or not state["known"]:
            return None
        return max(state["seen"] or 0, self.since) + self.duration

    def expire(self, state, at):
        state.update(silent=True, episode=state["episode"] + 1)
        return self._event(state, "silent", at)


@dataclass
class Resample(Fold):
    """A value on every point of a grid: the last of the interval before it, its mean, or a linear interpolation."""

    mode: str = "last"
    period: int = 1
    max_wait: int = 0
    max_gap: int = 0
    operator: int = 0
    generation: str = "batch"

    ADDED = (("resample_mode", "string"), ("resample_time", "bigint"), ("resample_emitted_at", "bigint"), ("resample_missing", "boolean"), ("resample_samples", "decimal(20,0)"), ("resample_generation", "string"), ("resample_operator", "decimal(20,0)"))

    def __post_init__(self):
        if self.mode not in ("last", "mean", "interpolate") or self.period <= 0:
            raise QueryError("resample: last, mean or interpolate over a positive period")
        if self.mode == "interpolate" and not (0 < self.max_wait <= self.period and self.max_gap > 0):
            raise QueryError("resample: 0 < max_wait <= period and max_gap > 0")
        if self.mode != "interpolate" and (self.max_wait or self.max_gap):
            raise QueryError("resample: max_wait and max_gap belong to interpolate")

    def output(self, schema):
        value = lambda f: T.StructField(f, schema[f].dataType if self.mode == "last" else T.DoubleType(), True)
        return T.StructType([*[schema[k] for k in self.keys], *[value(f) for f in self.fields], *[T.StructField(n, T._parse_datatype_string(t), True) for n, t in self.ADDED]])

    def start(self, key):
        return {"key": key}

    def _point(self, state, grid, at, values, samples):
        values = values if samples else [None] * len(self.fields)
        return [(*state["key"], *values, self.mode, grid, at, samples == 0, samples, self.generation, self.operator)]

    def row(self, state, now, row):
        values = self.usable(row)
        if values is None:
            return []
        out = []
        if self.mode == "interpolate":
            values = [float(v) for v in values]
            if "next" not in state:
                state["next"] = now - now % self.period + self.period
                if now % self.period == 0:
                    out += self._point(state, now, now, values, 1)
            elif (grid := state.pop("open", None)) is not None:
                left = state.get("left")
                if now == grid:
                    out += self._point(state, grid, now, values, 1)
                elif left and left[0] < grid and now - left[0] <= self.max_gap:
                    share = (grid - left[0]) / (now - left[0])
                    out += self._point(state, grid, now, [a + (b - a) * share for a, b in zip(left[1], values, strict=True)], 2)
                else:
                    out += self._point(state, grid, now, [], 0)
            state["left"] = (now, values)
            return out
        if "next" not in state:
            state["next"] = now - now % self.period + self.period
        if self.mode == "last":
            state.update(values=values, n=state.get("n", 0) + 1)
        else:
            n, mean = state.get("n", 0) + 1, state.get("values") or [0.0] * len(values)
            state.update(values=[m + (float(v) - m) / n for m, v in zip(mean, values, strict=True)], n=n)
        return []

    def deadline(self, state):
        if "next" not in state:
            return None
        return min(state["open"] + self.max_wait, state["next"]) if "open" in state else state["next"]

    def expire(self, state, at):
        if "open" in state and state["open"] + self.max_wait == at:
            out = self._point(state, state.pop("open"), at, [], 0)
            if self.deadline(state) != at:
                return out
        else:
            out = []
        if at != state["next"]:
            return out
        state["next"] = at + self.period
        if self.mode == "interpolate":
            state["open"] = at
            return out
        n, values = state.get("n", 0), state.get("values")
        state.update(n=0, values=None)
        return out + self._point(state, at, at, values, n)


@dataclass
class WindowFold(Fold):
    """Shared by windows that keep their rows: keys, two bounds, then aggregates of the kept values in order."""

    aggs: list = field(default_factory=list)  # (fn, star, alias, type), one value column each
    values: list[str] = field(default_factory=list)

    bounds = ("window_start", "window_end")

    def bind(self, names):
        super().bind(names)
        self.value_at = [names.index(v) if v else None for v in self.values]

    def output(self, schema):
        return T.StructType([*[schema[k] for k in self.keys], *[T.StructField(b, T.LongType()) for b in self.bounds], *[T.StructField(alias, t) for _, _, alias, t in self.aggs]])

    def start(self, key):
        return {"key": key, "rows": []}

    def kept(self, now, row):
        return now, [None if i is None else row[i] for i in self.value_at]

    def made(self, state, rows, start, end):
        found = [aggregates.of_values(fn, [r[1][i] for r in rows], star) for i, (fn, star, _, _) in enumerate(self.aggs)]
        return [(*state["key"], start, end, *found)]


@dataclass
class CountWindow(WindowFold):
    """Every ``size`` rows of a key, or with ``every`` the last ``size`` rows after each ``every``."""

    size: int = 1
    every: int = 0

    bounds = ("count_start", "count_end")

    def row(self, state, now, row):
        state["n"] = n = state.get("n", 0) + 1
        state["rows"] = [*state["rows"], self.kept(now, row)][-self.size :]
        if self.every:
            return self.made(state, state["rows"], n - self.size, n) if n >= self.size and n % self.every == 0 else []
        if n % self.size:
            return []
        rows, state["rows"] = state["rows"], []
        return self.made(state, rows, 0, self.size)


@dataclass
class DelayedSliding(WindowFold):
    """A window for each row at T over ``(T - size, T + delay]``, when the clock has passed ``T + delay``."""

    size: int = 1
    delay: int = 0

    def row(self, state, now, row):
        state["rows"].append(self.kept(now, row))
        state.setdefault("waiting", []).append(now)
        return []

    def deadline(self, state):
        return state["waiting"][0] + self.delay + 1 if state.get("waiting") else None

    def expire(self, state, at):
        t = state["waiting"].pop(0)
        state["rows"] = [r for r in state["rows"] if r[0] > t - self.size]
        return self.made(state, [r for r in state["rows"] if r[0] <= t + self.delay], t - self.size + 1, at)


@dataclass
class SessionWindow(WindowFold):
    """Sessions that end ``gap`` after their last row, ``longest`` after their first at the latest."""

    gap: int = 1
    longest: int = 1

    def row(self, state, now, row):
        state["rows"].append(self.kept(now, row))
        return []

    def deadline(self, state):
        rows = state["rows"]
        return min(rows[-1][0] + self.gap, rows[0][0] + self.longest) if rows else None

    def expire(self, state, at):
        rows, state["rows"] = state["rows"], []
        return self.made(state, rows, rows[0][0], at)


@dataclass
class SlidingPrefix(WindowFold):
    """A window for each row over the rows already arrived in (T - size, T]; rows of the same microsecond that follow do not change it."""

    size: int = 1

    def row(self, state, now, row):
        state["rows"] = [r for r in state["rows"] if r[0] > now - self.size] + [self.kept(now, row)]
        return self.made(state, state["rows"], now - self.size + 1, now + 1)


@dataclass
class SessionBounds(Fold):
    """Adds the start and end of each row's session: ``end = min(last + gap, first + max)``, a row at the end begins a new one.

    Two passes in one: a session's end is known at its last row, so rows are held until then and leave with it.  A session
    is cut after ``max``, so at most one session's bounds and rows are held.
    """

    gap: int = 1
    longest: int = 1

    def output(self, schema):
        return T.StructType([*schema.fields, T.StructField("session_start", T.LongType()), T.StructField("session_reach", T.LongType())])

    def row(self, state, now, row):
        if "first" not in state or now >= min(state["last"] + self.gap, state["first"] + self.longest):
            state["first"] = now
        state["last"] = now
        # the reach of this row alone; the session's end is the largest over its rows
        return [(*row, state["first"], min(now + self.gap, state["first"] + self.longest))]


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


CHUNK = 4_096


def run(df: DataFrame, fold: Fold, clock: Column, order_by: list[Column], until: int | None = None, seeds: list[tuple] | None = None) -> DataFrame:
    """Fold a finite table: each key's rows by clock order of arrival, state only in memory.

    ``until``: after a key's last row, deadlines up to this clock fire too (None: those up to the last row only).
    ``seeds``: keys that exist without a row (silence's registered keys); they need ``until``.
    """
    names = df.columns
    fold.bind(names)
    result = fold.output(df.schema)
    rows = df.select(*[F.col(f"`{c}`") for c in names], clock.cast("long").alias("_now"), F.lit(False).alias("_seed"), *[c.alias(f"_o{i}") for i, c in enumerate(order_by)])
    if seeds:
        schema = T.StructType([df.schema[k] for k in fold.keys])
        some = df.sparkSession.createDataFrame(seeds, schema)
        blank = [F.lit(None).cast(df.schema[c].dataType).alias(c) if c not in fold.keys else F.col(f"`{c}`") for c in names]
        rows = rows.unionByName(some.select(*blank, F.lit(None).cast("long").alias("_now"), F.lit(True).alias("_seed"), *[F.lit(None).cast(rows.schema[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order_by))]))
    sort = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order_by))]
    rows = rows.repartition(*[F.col(f"`{k}`") for k in fold.keys]) if fold.keys else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*[F.col(f"`{k}`") for k in fold.keys], F.col("_seed").desc(), *sort)
    width, arrow = len(names), to_arrow_schema(result)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_fit(r[i], f.type) for r in out], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

    def apply(batches):
        key, state, out = None, None, []
        for b in batches:
            for r in rows_of(b):
                mine = tuple(r[i] for i in fold.key_at)
                if state is None or mine != key:
                    if state is not None and until is not None:
                        out += fold.due(state, until)
                    key, state = mine, fold.start(mine)
                if not r[width + 1]:
                    out += fold.step(state, r[width], r[:width])
                if len(out) >= CHUNK:
                    yield made(out)
                    out = []
        if state is not None and until is not None:
            out += fold.due(state, until)
        yield made(out)

    return rows.mapInArrow(apply, result)


def _fit(v, kind: pa.DataType):
    if pa.types.is_decimal(kind) and isinstance(v, int):
        from decimal import Decimal

        return Decimal(v)
    return v
