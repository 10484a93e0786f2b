"""Group windows over finite tables: ten kinds with exact boundaries.

Output: group keys, then window_start and window_end (64-bit microseconds) or
count_start and count_end, then the aggregates.  Windows without rows never
appear.  Order within a key is explicit (``order_by``), never that of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError
from millrace.functions import aggregates
from millrace.functions.expr import compile_expr
from millrace.functions.types import is_int, is_time
from millrace.operators import folds
from millrace.operators.ordering import running_max_before

MAX_OVERLAP, MAX_BUFFERED = 8, 1024
EVENT_KINDS = ("tumble_et", "hop", "sliding_et", "session_et")
PROCESSING_KINDS = ("tumble_pt", "hop_pt", "sliding_pt", "session_pt")
COUNT_KINDS = ("count_window", "sliding_count")
#: Other names of the kinds in graphs.
KIND_NAMES = {
    "event_time": "tumble_et", "event_time_window": "tumble_et", "tumble": "tumble_et", "processing_time": "tumble_pt", "tumbling_pt": "tumble_pt", "tumbling_et": "tumble_et",
    "hop_et": "hop", "hopping": "hop", "count": "count_window", "count_tumble": "count_window",
}


@dataclass(frozen=True)
class WindowSpec:
    """What a window needs, by kind; times are microseconds."""

    kind: str
    size: int = 0
    slide: int = 0
    step: int = 0
    delay: int = 0
    gap: int = 0
    max_duration: int = 0
    lateness: int = 0
    skew: int | None = None
    max_overlap: int = MAX_OVERLAP
    max_buffered_rows: int = MAX_BUFFERED

    def __post_init__(self):
        kind = self.kind
        if kind not in (*EVENT_KINDS, *PROCESSING_KINDS, *COUNT_KINDS):
            raise QueryError(f"unknown window kind {kind}")
        if kind.startswith("session"):
            if self.gap <= 0 or self.max_duration <= 0:
                raise QueryError("SESSION: gap and maximum duration are positive")
        elif self.size <= 0:
            raise QueryError("a window's size is positive")
        if kind in ("hop", "hop_pt"):
            if not 0 < self.slide <= self.size:
                raise QueryError("HOP: 0 < slide <= size")
            if -(-self.size // self.slide) > self.max_overlap:
                raise QueryError(f"HOP: more than {self.max_overlap} windows overlap")
        if kind == "sliding_count" and not (1 <= self.step <= self.size <= self.max_buffered_rows):
            raise QueryError("COUNT_WINDOW: 1 <= step <= size, and size within the buffer")
        if self.delay < 0 or self.lateness < 0:
            raise QueryError("delay and lateness are not negative")


def micros(c: Column, t: T.DataType) -> Column:
    """Event or processing time as 64-bit microseconds."""
    if isinstance(t, T.TimestampNTZType) and SparkSession.active().conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
        # a time without zone is UTC, whatever the session's zone
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp"))
    if is_time(t):
        return F.unix_micros(c.cast("timestamp"))
    if is_int(t):
        return c.cast("long")
    raise QueryError(f"a time column is int64 or timestamp, not {t.simpleString()}")


def aggregate(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[dict], time: str | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Aggregate ``df`` by keys and window.

    ``time`` is the event-time or processing-clock column of the kinds that have one; ``order_by`` the arrival order
    (needed by count, session and processing-time kinds, and by FIRST and LAST).
    """
    for k in keys:
        if k not in df.columns:
            raise QueryError(f"unknown group key {k}")
    arrival = [F.col(f"`{c}`") for c in (order_by or [])]
    key = [F.col(f"`{k}`") for k in keys]
    kind = spec.kind
    if df.isStreaming:
        return _streamed(df, spec, keys, aggs, time, order_by or [])
    if kind in COUNT_KINDS:
        if not arrival:
            raise QueryError("a count window needs an arrival order")
        return _counted(df, spec, key, aggs, arrival)
    if time is None or time not in df.columns:
        raise QueryError(f"{kind} needs a time column")
    t = micros(F.col(f"`{time}`"), df.schema[time].dataType)
    if kind in EVENT_KINDS:
        t = F.when(t >= 0, t).otherwise(F.raise_error(F.lit("event time is NULL or negative")))
    elif kind != "tumble_pt":
        if not arrival:
            raise QueryError(f"{kind} needs an arrival order")
        # the clock never runs backwards within a key
        t = F.max(t).over(Window.partitionBy(*key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0))
    order = F.struct(F.col("_t"), *arrival) if kind in ("sliding_et", "session_et") else F.struct(*(arrival or [F.col("_t")]))
    timed = df.withColumn("_t", t)
    if kind in ("tumble_et", "tumble_pt"):
        starts = timed.withColumn("window_start", F.col("_t") - F.pmod(F.col("_t"), F.lit(spec.size)))
        return _grid(starts, spec.size, key, aggs, order)
    if kind in ("hop", "hop_pt"):
        last = F.col("_t") - F.pmod(F.col("_t"), F.lit(spec.slide))
        starts = F.transform(F.sequence(F.lit(0), F.lit(-(-spec.size // spec.slide) - 1)), lambda i: last - i * spec.slide)
        starts = timed.withColumn("window_start", F.explode(F.filter(starts, lambda s: s + spec.size > F.col("_t"))))
        return _grid(starts, spec.size, key, aggs, order)
    if kind == "sliding_pt" and spec.delay == 0:
        return _prefix(timed, spec, key, aggs, arrival)
    if kind in ("sliding_et", "sliding_pt"):
        frame = Window.partitionBy(*key).orderBy("_t").rangeBetween(-(spec.size - 1), spec.delay)
        start, end = F.col("_t") - (spec.size - 1), F.col("_t") + (spec.delay + 1)
        made = aggregates.all_of(aggs, timed.schema, order, frame)
        return timed.select(*key, start.alias("window_start"), end.alias("window_end"), *made)
    return _sessions(timed, spec, keys, key, aggs, arrival, order)


def _grid(df: DataFrame, size: int, key: list[Column], aggs: list[dict], order: Column) -> DataFrame:
    names = [a["alias"] for a in aggs]
    made = df.groupBy(*key, "window_start").agg(*aggregates.all_of(aggs, df.schema, order))
    return made.select(*key, "window_start", (F.col("window_start") + size).alias("window_end"), *[F.col(f"`{n}`") for n in names])


def _counted(df: DataFrame, spec: WindowSpec, key: list[Column], aggs: list[dict], arrival: list[Column]) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(*arrival)
    ranked = df.withColumn("_n", F.row_number().over(by).cast("long"))
    names = [F.col(f"`{a['alias']}`") for a in aggs]
    order = F.struct("_n")
    if spec.kind == "count_window":
        grouped = ranked.withColumn("_w", F.call_function("div", F.col("_n") - 1, F.lit(spec.size).cast("long")))
        made = grouped.groupBy(*key, "_w").agg(F.count("*").alias("_rows"), *aggregates.all_of(aggs, df.schema, order)).filter(F.col("_rows") == spec.size)
        return made.select(*key, F.lit(0).cast("long").alias("count_start"), F.lit(spec.size).cast("long").alias("count_end"), *names)
    frame = by.rowsBetween(-(spec.size - 1), 0)
    made = ranked.select(*key, "_n", *aggregates.all_of(aggs, df.schema, order, frame))
    made = made.filter((F.col("_n") >= spec.size) & (F.col("_n") % spec.step == 0))
    return made.select(*key, (F.col("_n") - spec.size).alias("count_start"), F.col("_n").alias("count_end"), *names)


def _folded(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[dict]) -> tuple[list[Column], folds.WindowFold]:
    """The value columns of the aggregates, and the fold that keeps them."""
    typed = [compile_expr(a["expr"], df.schema) if a.get("expr") else None for a in aggs]
    shape = {
        "keys": keys, "values": [f"_v{i}" if x else "" for i, x in enumerate(typed)],
        "aggs": [(a["fn"], x is None, a["alias"], aggregates.result_type(a["fn"], x.type if x else None)) for a, x in zip(aggs, typed, strict=True)],
    }
    if spec.kind in COUNT_KINDS:
        fold = folds.CountWindow(**shape, size=spec.size, every=spec.step)
    elif spec.kind.startswith("session"):
        fold = folds.SessionWindow(**shape, gap=spec.gap, longest=spec.max_duration)
    elif spec.kind == "sliding_pt" and spec.delay == 0:
        fold = folds.SlidingPrefix(**shape, size=spec.size)
    else:
        fold = folds.DelayedSliding(**shape, size=spec.size, delay=spec.delay)
    return [x.col.alias(f"_v{i}") for i, x in enumerate(typed) if x], fold


def _prefix(df: DataFrame, spec: WindowSpec, key: list[Column], aggs: list[dict], arrival: list[Column]) -> DataFrame:
    """The rows of the last ``size`` microseconds up to each one: those of earlier clocks, and those that arrived before it at its own."""
    earlier = Window.partitionBy(*key).orderBy("_t").rangeBetween(-(spec.size - 1), -1)
    later = Window.partitionBy(*key, "_t").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0)
    made = aggregates.all_of(aggs, df.schema, F.struct(*arrival), earlier, later)
    return df.select(*key, (F.col("_t") - (spec.size - 1)).alias("window_start"), (F.col("_t") + 1).alias("window_end"), *made)


def _streamed(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[dict], time: str | None, order_by: list[str]) -> DataFrame:
    """The same window over a stream: Spark's event-time windows where they are the same, else a fold in the state store.

    Event-time tumble and hop need a watermark on ``time``; folds take their time in order within a key, and a processing
    kind without a time column takes Spark's processing time, so that windows also end without a row.
    """
    from millrace.streaming.stateful import run_stream
    from millrace.streaming.windows import aggregate_stream

    if spec.kind in ("tumble_et", "hop"):
        return aggregate_stream(df, spec, keys, aggs, time)
    if spec.kind in ("tumble_pt", "hop_pt"):
        grid = WindowSpec("tumble_et" if spec.kind == "tumble_pt" else "hop", size=spec.size, slide=spec.slide, max_overlap=spec.max_overlap)
        clocked = df.withColumn("_clock", F.col(f"`{time}`") if time else F.current_timestamp()).withWatermark("_clock", "0 seconds")
        return aggregate_stream(clocked, grid, keys, aggs, "_clock")
    if not keys:
        raise QueryError(f"{spec.kind} over a stream needs a key")
    clock = micros(F.col(f"`{time}`"), df.schema[time].dataType) if time else None
    if clock is None and spec.kind in COUNT_KINDS:
        clock = F.lit(0).cast("long")
    values, fold = _folded(df, spec, keys, aggs)
    rows = df.select(*[F.col(f"`{k}`") for k in keys], *values, *([clock.alias("_t")] if clock is not None else []), *[F.col(f"`{c}`").alias(f"_a{i}") for i, c in enumerate(order_by)])
    return run_stream(rows, fold, F.col("_t") if clock is not None else None, [f"_a{i}" for i in range(len(order_by))])


def _sessions(df: DataFrame, spec: WindowSpec, keys: list[str], key: list[Column], aggs: list[dict], arrival: list[Column], order: Column) -> DataFrame:
    """Gap sessions by window functions; only rows past a session's maximum duration go through a fold.

    Rows before ``first + max_duration`` are in the session that ``first`` opened, whatever follows; those from there on
    open further sessions, each cut at the duration again.
    """
    if not arrival:
        raise QueryError("SESSION needs an arrival order")
    # what the aggregates read, and no other column, goes through windows and fold
    typed = [compile_expr(a["expr"], df.schema) if a.get("expr") else None for a in aggs]
    arrived = df.select(*key, "_t", F.struct(*arrival).alias("_a"), *[x.col.alias(f"_v{i}") for i, x in enumerate(typed) if x])
    aggs = [{**a, "expr": {"k": "col", "name": f"_v{i}"}} if x else a for i, (a, x) in enumerate(zip(aggs, typed, strict=True))]
    by = Window.partitionBy(*key).orderBy("_t", "_a")
    opens = F.coalesce(F.col("_t") - F.lag("_t").over(by) >= spec.gap, F.lit(True))
    ids = arrived.withColumn("_opens", F.when(opens, F.col("_t")))
    ids = ids.withColumn("_first", F.last("_opens", ignorenulls=True).over(by)).drop("_opens")
    inside = F.col("_t") < F.col("_first") + spec.max_duration
    short = ids.filter(inside).withColumns({"session_start": F.col("_first"), "session_reach": F.least(F.col("_t") + spec.gap, F.col("_first") + spec.max_duration)})
    long = folds.run(ids.filter(~inside), folds.SessionBounds(keys=[*keys, "_first"], gap=spec.gap, longest=spec.max_duration), F.col("_t"), [F.col("_t"), F.col("_a")])
    rows = short.unionByName(long)
    names = [F.col(f"`{a['alias']}`") for a in aggs]
    made = rows.groupBy(*key, "session_start").agg(F.max("session_reach").alias("_end"), *aggregates.all_of(aggs, arrived.schema, F.struct("_t", "_a")))
    return made.select(*key, F.col("session_start").alias("window_start"), F.col("_end").alias("window_end"), *names)


def late_split(df: DataFrame, time: str, order_by: list[str], size: int, slide: int | None = None, out_of_orderness: int = 0, lateness: int = 0) -> DataFrame:
    """``df`` with a Boolean ``late``: whether all windows of a row had ended when it arrived.

    The watermark before a row is the largest event time so far less ``out_of_orderness``, held back by ``lateness`` and
    never below 0; it advances with every row.
    """
    t = micros(F.col(f"`{time}`"), df.schema[time].dataType)
    # the last window that covers a row ends latest
    end = t - F.pmod(t, F.lit(slide or size)) + size
    rows = running_max_before(df, order_by, t, "_top")
    mark = F.greatest(F.coalesce(F.col("_top") - out_of_orderness, F.lit(0)), F.lit(0)) - lateness
    return rows.withColumn("late", (end <= mark) & (mark > 0)).drop("_top")
