"""Global order without a single task: ranges of the first order column, then offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which one task orders a table, and ranges at most.
ONE_TASK_ROWS, RANGES = 50_000, 1_024


def _ranged(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``_range``: a row of a lower range comes before any of a higher one; equal values share one."""
    first = df.schema[order_by[0]].dataType
    if not isinstance(first, T.NumericType | T.TimestampType | T.TimestampNTZType | T.DateType | T.StringType):
        return df.withColumn("_range", F.lit(0)), 1
    n = df.count()
    ranges = min(RANGES, -(-n // ONE_TASK_ROWS))
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0)), 1
    c = F.col(f"`{order_by[0]}`")
    if isinstance(first, T.StringType):
        # cuts from a draw of heads, in the order of their bytes; equal heads share a range
        head = F.substring(c, 1, 64)
        drawn = sorted(r[0].encode() for r in df.select(head).filter(c.isNotNull()).sample(min(1.0, 20 * ranges / n), seed=1).limit(40 * ranges).collect())
        cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
        array = F.array(*[F.lit(x.decode()) for x in cuts]) if cuts else F.array().cast("array<string>")
        return df.withColumn("_range", F.when(c.isNull(), 0).otherwise(F.size(F.filter(array, lambda x: x <= head)))), len(cuts) + 1
    number = c.cast("double") if isinstance(first, T.NumericType) else F.unix_micros(c.cast("timestamp")).cast("double")
    cuts = sorted(set(df.select(number.alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    array = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    return df.withColumn("_range", F.when(number.isNull(), 0).otherwise(F.size(F.filter(array, lambda x: x <= number)))), len(cuts) + 1


def numbered(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """``df`` with the number of each row in the order, from 1."""
    order = [F.col(f"`{c}`") for c in order_by]
    rows, ranges = _ranged(df, order_by)
    if ranges == 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    before, at = [0] * ranges, 0
    counts = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
    for i in range(ranges):
        before[i], at = at, at + counts.get(i, 0)
    offset = F.get(_constants(before), F.col("_range"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn(name, (within + offset).cast("long")).drop("_range")


def running_max_before(df: DataFrame, order_by: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the largest ``value`` (a long) over all rows before each one in the order."""
    order = [F.col(f"`{c}`") for c in order_by]
    rows, ranges = _ranged(df.withColumn("_v", value), order_by)
    frame = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if ranges == 1:
        return rows.withColumn(name, F.max("_v").over(frame(Window.partitionBy()))).drop("_v", "_range")
    tops = {r["_range"]: r["top"] for r in rows.groupBy("_range").agg(F.max("_v").alias("top")).collect()}
    low, best = [], -(1 << 63)
    for i in range(ranges):
        low.append(best)
        best = max(best, tops.get(i) if tops.get(i) is not None else best)
    earlier = F.get(_constants(low), F.col("_range"))
    both = F.greatest(F.max("_v").over(frame(Window.partitionBy("_range"))), F.when(earlier > -(1 << 63), earlier))
    return rows.withColumn(name, both).drop("_v", "_range")


def _constants(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
