"""Event-time windows on streams: watermark, holdback, future skew and the late side output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import QueryError
from millrace.functions import aggregates
from millrace.operators.windows import WindowSpec

#: Fixed value: how far ahead of the clock an event time may lie, by default an hour.
FUTURE_SKEW = 3_600_000_000


def with_watermark(df: DataFrame, time: str, out_of_orderness: int = 0, lateness: int = 0, skew: int | None = FUTURE_SKEW, now: Column | None = None) -> DataFrame:
    """Rows not further than ``skew`` in the future, with a watermark behind the largest event time by both delays.

    Several inputs of one query advance together (Spark's ``min`` policy, its default).
    """
    c = F.col(f"`{time}`")
    if skew is not None:
        df = df.filter(c <= (now if now is not None else F.current_timestamp()) + F.make_dt_interval(secs=F.lit(skew / 1_000_000)))
    return df.withWatermark(time, f"{out_of_orderness + lateness} microseconds")


def aggregate_stream(df: DataFrame, spec: WindowSpec, keys: list[str], aggs: list[dict], time: str) -> DataFrame:
    """ET tumble or hop over a stream with a watermark: final windows only (append), 64-bit bounds."""
    if spec.kind not in ("tumble_et", "hop"):
        raise QueryError("streams aggregate event-time tumble and hop windows here; other kinds are folds")
    size = f"{spec.size} microseconds"
    w = F.window(F.col(f"`{time}`"), size, f"{spec.slide} microseconds") if spec.kind == "hop" else F.window(F.col(f"`{time}`"), size)
    made = df.groupBy(*[F.col(f"`{k}`") for k in keys], w.alias("_w")).agg(*aggregates.all_of(aggs, df.schema, F.col(f"`{time}`")))
    names = [F.col(f"`{a['alias']}`") for a in aggs]
    return made.select(*[F.col(f"`{k}`") for k in keys], F.unix_micros("_w.start").alias("window_start"), F.unix_micros("_w.end").alias("window_end"), *names)


def interval_join_stream(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], before: int, after: int, mode: str = "inner") -> DataFrame:
    """Two streams with watermarks: ``right_time`` in ``[left_time - before, left_time + after]``; unmatched left rows leave once no match can come."""
    a = left.select(*[F.col(f"`{c}`").alias(f"left_{c}") for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(f"right_{c}") for c in right.columns])
    lt, rt = F.col(f"left_{times[0]}"), F.col(f"right_{times[1]}")
    span = lambda n: F.expr(f"make_dt_interval(0, 0, 0, {n / 1_000_000:.6f})")
    condition = (rt >= lt - span(before)) & (rt <= lt + span(after))
    for x, y in keys:
        condition &= F.col(f"left_{x}") == F.col(f"right_{y}")
    out = a.join(b, condition, {"inner": "inner", "left": "leftOuter"}[mode])
    return out.withColumn("join_time", F.when(rt.isNull(), F.unix_micros(lt)).otherwise(F.greatest(F.unix_micros(lt), F.unix_micros(rt))))


class LateSplitter:
    """Late rows of a stream, told apart batch by batch (for ``foreachBatch``).

    A row is late if all its windows had ended by the watermark that earlier batches left behind: the largest event time so
    far less both delays.  Marks are kept by batch id, in ``folder`` (any file system that Spark reaches) or in memory, so a
    batch that is tried again, in this process or after a restart, is judged by the mark it was judged by before.
    """

    def __init__(self, time: str, size: int, slide: int | None = None, out_of_orderness: int = 0, lateness: int = 0, folder: str | None = None):
        self.time, self.size, self.slide = time, size, slide or size
        self.behind, self.folder = out_of_orderness + lateness, folder.rstrip("/") if folder else None
        self.marks: dict[int, tuple[int | None, int | None]] = {}  # batch id: largest event time before it and after it

    def _load(self, batch: DataFrame) -> None:
        if self.folder and not self.marks:
            spark = batch.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                for r in spark.read.parquet(self.folder).collect():
                    self.marks[r["batch"]] = (r["before"], r["after"])

    def split(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(rows in time, late rows) of a batch."""
        self._load(batch)
        t = F.unix_micros(F.col(f"`{self.time}`"))
        end = t - F.pmod(t, F.lit(self.slide)) + self.size
        if batch_id not in self.marks:
            earlier = [m for n, (_, m) in self.marks.items() if n < batch_id and m is not None]
            top, best = max(earlier, default=None), batch.agg(F.max(t)).first()[0]
            after = top if best is None else best if top is None else max(top, best)
            self.marks[batch_id] = (top, after)
            if self.folder:
                made = batch.sparkSession.createDataFrame([(batch_id, top, after)], "batch long, before long, after long")
                made.coalesce(1).write.mode("append").parquet(self.folder)
        top, _ = self.marks[batch_id]
        late = F.coalesce(end <= max(0, top - self.behind), F.lit(False)) if top is not None else F.lit(False)
        return batch.filter(~late), batch.filter(late)
