"""Folds on streams: the state of each key lives in Spark's state store.

A micro-batch's rows of a key are put in order and go through the same fold as
in batch; deadlines up to each row's clock fire in between.  Deadlines with no
row behind them fire by timeout, when the clock is Spark's processing time.  A key's
state is removed once its time to live is over: by processing time, or, where the
clock is a column, by the input's watermark (without one it stays).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.folds import Fold, _fit

STATE = T.StructType([T.StructField("fold", T.BinaryType())])


def plain(v, kind: T.DataType):
    """A pandas cell as the plain value it stands for (None, int, ...)."""
    if v is None or (not isinstance(v, list | dict) and pd.isna(v) is True and not isinstance(kind, T.DoubleType | T.FloatType)):
        return None
    if isinstance(kind, T.DoubleType | T.FloatType):
        return None if v is None else float(v)
    if isinstance(kind, T.IntegralType):
        return int(v)
    if isinstance(kind, T.BooleanType):
        return bool(v)
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v


def run_stream(df: DataFrame, fold: Fold, clock: Column | None, order_by: list[str], output_mode: str = "append") -> DataFrame:
    """Fold a stream by the fold's keys.

    ``clock``: microseconds in each row; None takes processing time, and lets deadlines fire without a row.  A NULL in a
    double column of pandas cannot be told from NaN, so both reach the fold as NaN and count as invalid.
    """
    names = df.columns
    fold.bind(names)
    result = fold.output(df.schema)
    rows = df.withColumn("_now", clock.cast("long") if clock is not None else F.unix_micros(F.current_timestamp()))
    # with a watermark on the input, state that has outlived its time to live goes when the watermark passes
    marked = any("spark.watermarkDelayMs" in f.metadata for f in df.schema.fields)
    kinds = [f.dataType for f in df.schema.fields]
    columns = [f.name for f in result.fields]
    decimals = [isinstance(f.dataType, T.DecimalType) for f in result.fields]
    live = clock is None

    def table(out: list[tuple]) -> pd.DataFrame:
        import pyarrow as pa

        fixed = [tuple(_fit(v, pa.decimal128(20, 0)) if d else v for v, d in zip(r, decimals, strict=True)) for r in out]
        return pd.DataFrame(fixed, columns=columns, dtype=object)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(bytes(state.get[0])) if state.exists else fold.start(tuple(plain(k, df_kinds[n]) for k, n in zip(key, fold.keys, strict=True)))
        out: list[tuple] = []
        if state.hasTimedOut:
            now = state.getCurrentProcessingTimeMs() * 1000 if live else state.getCurrentWatermarkMs() * 1000
            out += fold.due(held, now) if live else []
            worthless = fold.worthless(held)
            if worthless is not None and worthless <= now:
                state.remove()
                if out:
                    yield table(out)
                return
        else:
            b = pd.concat(list(frames))
            b = b.sort_values(order_by, kind="stable") if order_by else b
            clocks = b["_now"].to_list()
            for now, r in zip(clocks, b[names].itertuples(index=False, name=None), strict=True):
                out += fold.step(held, int(now), tuple(plain(v, k) for v, k in zip(r, kinds, strict=True)))
        state.update((pickle.dumps(held),))
        worthless = fold.worthless(held)
        at = min((x for x in (fold.deadline(held), worthless) if x is not None), default=None)
        if live and at is not None:
            state.setTimeoutDuration(max(1, at // 1000 - state.getCurrentProcessingTimeMs() + 1))
        elif marked and worthless is not None:
            state.setTimeoutTimestamp(max(worthless // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield table(out)

    df_kinds = {f.name: f.dataType for f in df.schema.fields}
    timeout = GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.EventTimeTimeout if marked else GroupStateTimeout.NoTimeout
    return rows.groupBy(*fold.keys).applyInPandasWithState(step, result, STATE, output_mode, timeout)
