"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


KINDS = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discarded(*tables: DataFrame) -> None:
    """Delete written tables, once everything made of them has been written itself."""
    for df in tables:
        removed(df.sparkSession, df._written_to)


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id) -> "F.Column":
    """True for the quarter of ids that no model may learn from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def bounded_sample(rows: DataFrame, key, bound: int) -> DataFrame:
    """At most ``bound`` rows, drawn by a hash of ``key`` so that every run draws the same ones.

    The share is set from a count and drawn again smaller in the rare case that
    the draw exceeds the bound, so whoever broadcasts the result has proof of its size.
    """
    total = rows.count()
    share = 1.0 if total <= bound else 0.95 * bound / total
    while True:
        draw = rows if share >= 1 else rows.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
        if share >= 1 or draw.count() <= bound:
            return draw
        share *= 0.5


def appended(docs: DataFrame, keep: list[str], columns: str, of: Callable[[list], list]) -> DataFrame:
    """The columns in ``keep``, untouched, and new ones (``columns``: a schema) that ``of`` makes of a list of texts."""
    keep = list(dict.fromkeys(keep))
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].alias("text"))
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]
    names = [x.strip().split()[0] for x in columns.split(",")]

    def apply(batches):
        for b in batches:
            new = of(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(f"k{i}") for i in range(len(keep))], *[pa.array(x, type=KINDS[t]) for x, t in zip(new, types, strict=True)]], names=[*[f"k{i}" for i in range(len(keep))], *names])

    types = [x.strip().split()[1] for x in columns.split(",")]
    made = rows.mapInArrow(apply, ", ".join([*[f"k{i} {t}" for i, t in enumerate(kinds)], columns]))
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def filtered(docs: DataFrame, keep: Callable[[list], list]) -> DataFrame:
    """The rows, all columns untouched, whose text ``keep`` marks in a list of texts."""

    def apply(batches):
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), type=pa.bool_()))

    at = docs.columns.index("text")
    renamed = docs.toDF(*[f"k{i}" for i in range(len(docs.columns))])
    return renamed.mapInArrow(apply, renamed.schema).toDF(*docs.columns)
