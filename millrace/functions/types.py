"""Type names of the query language and their Spark types.

uint64 is DECIMAL(20,0) kept within 0 .. 2^64-1, dynamic is VARIANT, and
timestamps are microseconds in UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

from millrace.errors import QueryError

UINT64 = T.DecimalType(20, 0)
UINT64_MAX = (1 << 64) - 1
MAX_STRUCT_FIELDS = 64

NAMES = {
    "null": T.NullType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "int64": T.LongType(), "bigint": T.LongType(), "long": T.LongType(), "int": T.LongType(), "integer": T.LongType(), "smallint": T.LongType(), "tinyint": T.LongType(),
    "uint64": UINT64,
    "float64": T.DoubleType(), "double": T.DoubleType(), "float": T.DoubleType(), "real": T.DoubleType(),
    "utf8": T.StringType(), "varchar": T.StringType(), "string": T.StringType(), "text": T.StringType(),
    "bytes": T.BinaryType(),
    "timestamp_micros_utc": T.TimestampType(), "timestamp": T.TimestampType(),
    "dynamic": T.VariantType(), "json": T.VariantType(),
}
KEY_TYPES = (T.StringType, T.LongType, T.DecimalType)


def parse_type(text: str) -> T.DataType:
    """A type by its name: a plain one, ``array<t>``, ``map<k,v>`` or ``struct<name:t, optional?:t>``."""
    kind, rest = _parse(text.strip())
    if rest.strip():
        raise QueryError(f"type {text!r}: unexpected {rest.strip()!r}")
    return kind


def _parse(text: str) -> tuple[T.DataType, str]:
    text = text.lstrip()
    n = 0
    while n < len(text) and (text[n].isalnum() or text[n] == "_"):
        n += 1
    name, rest = text[:n].lower(), text[n:].lstrip()
    if name == "array" and rest.startswith("<"):
        item, rest = _parse(rest[1:])
        return T.ArrayType(item), _expect(rest, ">")
    if name == "map" and rest.startswith("<"):
        key, rest = _parse(rest[1:])
        if not isinstance(key, KEY_TYPES):
            raise QueryError("map keys are utf8, int64 or uint64")
        value, rest = _parse(_expect(rest, ","))
        return T.MapType(key, value), _expect(rest, ">")
    if name == "struct" and rest.startswith("<"):
        fields, rest = [], rest[1:]
        while True:
            rest = rest.lstrip()
            n = 0
            while n < len(rest) and (rest[n].isalnum() or rest[n] == "_"):
                n += 1
            label, rest = rest[:n], rest[n:].lstrip()
            optional = rest.startswith("?")
            kind, rest = _parse(_expect(rest.removeprefix("?"), ":"))
            fields.append(T.StructField(label, kind, optional))
            rest = rest.lstrip()
            if not rest.startswith(","):
                break
            rest = rest[1:]
        if len(fields) > MAX_STRUCT_FIELDS or len({f.name for f in fields}) < len(fields):
            raise QueryError(f"a struct has at most {MAX_STRUCT_FIELDS} fields, each with its own name")
        return T.StructType(fields), _expect(rest, ">")
    if name not in NAMES:
        raise QueryError(f"unknown type {name or text!r}")
    return NAMES[name], rest


def _expect(text: str, mark: str) -> str:
    text = text.lstrip()
    if not text.startswith(mark):
        raise QueryError(f"type: {mark!r} expected before {text!r}")
    return text[1:]


def schema(fields: list[tuple[str, str, bool]]) -> T.StructType:
    """A declared schema of (name, type name, nullable)."""
    names = [f[0] for f in fields]
    if len(set(names)) < len(names):
        raise QueryError("field names repeat")
    return T.StructType([T.StructField(n, parse_type(t), nullable) for n, t, nullable in fields])


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_uint(t: T.DataType) -> bool:
    return isinstance(t, T.DecimalType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.FractionalType) and not is_uint(t)


def is_numeric(t: T.DataType) -> bool:
    return is_int(t) or is_uint(t) or is_float(t)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, T.TimestampType | T.TimestampNTZType)
