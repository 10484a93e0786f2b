"""JSON, CSV and Protobuf records with a declared schema; what does not decode is told apart, never guessed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError

CORRUPT = "_corrupt_record"
EMPTY = "\u0001empty\u0001"
MAX_RECORD = 64 * 1024
CONTRACTS = ("append_only", "sealed", "immutable")


def from_rows(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A finite input from JSON rows (texts or dicts), strict: a row that does not decode is an error."""
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in rows]
    return decode_json(spark.createDataFrame(texts, "r string"), "r", schema)[0]


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "fail", contract: str = "sealed") -> DataFrame:
    """One JSON object on a line; blank lines are no records.  One decoder for all policies: ``fail`` stops at a bad record, ``drop`` skips it, ``side`` keeps it in ``_corrupt_record``."""
    _contract(contract)
    if on_error not in ("fail", "drop", "side"):
        raise QueryError("on_error is fail, drop or side")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    good, bad = decode_json(lines, "value", schema, on_error)
    if on_error != "side":
        return good
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return good.withColumn(CORRUPT, F.lit(None).cast("string")).unionByName(bad.select(*blank, F.col("record").alias(CORRUPT)))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "fail", header: bool = True, null_marker: str | None = None, delimiter: str = ",", multiline: bool = False, contract: str = "sealed") -> DataFrame:
    """CSV by position or header; a quoted empty field is the empty text, an unquoted one NULL."""
    _contract(contract)
    if on_error not in ("fail", "drop", "side"):
        raise QueryError("on_error is fail, drop or side")
    shape = schema if on_error == "fail" else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(shape).options(header=header, sep=delimiter, quote='"', escape='"', multiLine=multiline, mode="FAILFAST" if on_error == "fail" else "PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=not header)
    # the reader knows one text for NULL and one for a quoted empty field: the latter stands for itself until it is told apart
    reader = reader.option("emptyValue", EMPTY)
    df = (reader.option("nullValue", null_marker) if null_marker is not None else reader).csv(path)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.when(F.col(f"`{c}`") == EMPTY, "").otherwise(F.col(f"`{c}`")) for c in texts}) if texts else df
    if on_error == "drop":
        # the mark is read together with every column, so that each record is parsed whole
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.select(whole.alias("r")).filter(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])
    return df


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream (file replay); ``Trigger.AvailableNow`` replays what is there and stops."""
    if fmt not in ("json", "csv", "parquet", "text"):
        raise QueryError(f"unknown stream format {fmt}")
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def decode_json(df: DataFrame, column: str, schema: T.StructType, on_error: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(decoded rows, rows that failed with the reason) of a text column; NULL, too long and malformed records and repeated keys fail."""
    shape = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    c = F.col(f"`{column}`")
    rows = df.withColumn("_r", F.from_json(c, shape, mode))
    missing = [F.col(f"_r.{f.name}").isNull() for f in schema.fields if not f.nullable]
    reason = F.when(c.isNull(), "NULL record").when(F.octet_length(c) > MAX_RECORD, "record is too long").when(F.col(f"_r.{CORRUPT}").isNotNull(), "malformed record")
    # the variant parser takes no object that has a key twice
    reason = reason.when(F.try_parse_json(c).isNull(), "malformed record or repeated key")
    for m, f in zip(missing, [f for f in schema.fields if not f.nullable], strict=True):
        reason = reason.when(m, f"{f.name} is missing")
    rows = rows.withColumn("_reason", reason)
    good = rows.filter(F.col("_reason").isNull()).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    bad = rows.filter(F.col("_reason").isNotNull()).select(c.alias("record"), F.col("_reason").alias("reason"))
    if on_error == "fail":
        failed = F.when(F.col("_reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("decode: "), F.col("_reason"))))
        good = rows.filter(failed).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return good, bad


def decode_protobuf(df: DataFrame, column: str, message: str, descriptor: str) -> DataFrame:
    """Protobuf messages by descriptor file; needs Spark's protobuf module on the class path."""
    try:
        from pyspark.sql.protobuf.functions import from_protobuf
    except ImportError as e:
        raise QueryError("the protobuf module is not installed") from e
    return df.withColumn("value", from_protobuf(F.col(f"`{column}`"), message, descriptor, {"mode": "FAILFAST"}))


def _contract(contract: str) -> None:
    if contract not in CONTRACTS:
        raise QueryError(f"a file contract is one of {', '.join(CONTRACTS)}")
