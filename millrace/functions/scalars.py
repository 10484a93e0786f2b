"""The closed set of scalar functions, each a composition of Catalyst expressions.

Unless noted a NULL argument gives NULL.  Where an argument is outside a
function's domain the query fails with a message (``raise_error``), it never
continues with a made-up value.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError, TypeMismatch, UnknownName
from millrace.functions.types import UINT64, is_float, is_int, is_numeric, is_time, is_uint

STRING, LONG, DOUBLE, BOOL, BYTES, VARIANT = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.BinaryType(), T.VariantType()
MAX_ITEMS = 1024


@dataclass(frozen=True)
class Typed:
    """A column, its type, and its value where it is a literal."""

    col: Column
    type: T.DataType
    literal: object = None
    is_literal: bool = False


def guarded(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok`` is true or unknown, else an error."""
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)))


def no_nan(x: Typed) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x.col), x.col) if is_float(x.type) else x.col


def common(args: list[Typed], what: str) -> tuple[list[Column], T.DataType]:
    """Arguments of one type: ints widen to 64 bits, ints and floats meet as doubles, nulls adapt."""
    types = [a.type for a in args if not isinstance(a.type, T.NullType)]
    if not types:
        return [a.col for a in args], T.NullType()
    if all(is_numeric(t) for t in types):
        to = DOUBLE if any(is_float(t) for t in types) else UINT64 if all(is_uint(t) for t in types) else LONG
    elif all(t == types[0] for t in types) or all(is_time(t) for t in types):
        to = types[0]
    else:
        raise TypeMismatch(f"{what}: arguments of different types")
    return [a.col.cast(to) for a in args], to


def need(a: Typed, test: Callable[[T.DataType], bool], what: str) -> Column:
    if not (test(a.type) or isinstance(a.type, T.NullType)):
        raise TypeMismatch(f"{what}: {a.type.simpleString()} does not fit")
    return a.col


def text(a: Typed, what: str) -> Column:
    return need(a, lambda t: isinstance(t, T.StringType), what).cast("string")


def integer(a: Typed, what: str) -> Column:
    return need(a, lambda t: is_int(t) or is_uint(t), what).cast("long")


def as_array(a: Typed, what: str) -> tuple[Column, T.DataType]:
    if isinstance(a.type, T.ArrayType):
        return a.col, a.type.elementType
    if isinstance(a.type, T.VariantType):
        return F.variant_get(a.col, "$", "array<variant>"), VARIANT
    raise TypeMismatch(f"{what}: an array is needed")


def as_map(a: Typed, what: str) -> tuple[Column, T.DataType]:
    if isinstance(a.type, T.MapType):
        return a.col, a.type.valueType
    if isinstance(a.type, T.VariantType):
        return F.variant_get(a.col, "$", "map<string,variant>"), VARIANT
    raise TypeMismatch(f"{what}: an object is needed")


def _abs(x):
    c = need(x, is_numeric, "abs")
    return Typed(F.abs(c.cast("long") if is_int(x.type) else c), LONG if is_int(x.type) else x.type)


#: The ASCII letters, for case mapping that leaves other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_case(name, a, b):
    return lambda x: Typed(F.translate(text(x, name), a, b), STRING)


def _length(x):
    return Typed(F.char_length(text(x, "length")).cast("long"), LONG)


def _coalesce(*args):
    cols, t = common(list(args), "coalesce")
    return Typed(F.coalesce(*cols), t)


def _nullif(a, b):
    (x, y), _ = common([a, b], "nullif")
    return Typed(F.when(F.coalesce(x == y, F.lit(False)), F.lit(None)).otherwise(a.col), a.type)


def _extreme(name, pick):
    def apply(*args):
        _, t = common(list(args), name)
        cols = [no_nan(a).cast(t) for a in args]
        return Typed(cols[0] if len(cols) == 1 else pick(*cols), t)

    return apply


def _concat(*args):
    return Typed(F.concat(*[text(a, "concat") for a in args]), STRING)


def _substring(s, start, count):
    c, at, n = text(s, "substring"), integer(start, "substring"), integer(count, "substring")
    return Typed(guarded((at >= 1) & (n >= 0), F.substring(c, at.cast("int"), n.cast("int")), "substring: start from 1, count from 0"), STRING)


def _replace(s, a, b):
    old = text(a, "replace")
    return Typed(guarded(F.char_length(old) > 0, F.replace(text(s, "replace"), old, text(b, "replace")), "replace: nothing to look for"), STRING)


def _test(name, of):
    return lambda s, n: Typed(of(text(s, name), text(n, name)), BOOL)


def _trim(s):
    return Typed(F.regexp_replace(text(s, "trim"), r"(?U)^\s+|\s+$", ""), STRING)


def _round(x):
    c = need(x, is_numeric, "round")
    if not is_float(x.type):
        return Typed(c, x.type)
    finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
    # half away from zero, on the double itself
    away = F.signum(c) * F.floor(F.abs(c) + 0.5).cast("double")
    big = F.abs(c) >= float(1 << 52)
    edge = F.when(F.abs(c) == 0.49999999999999994, F.lit(0.0)).otherwise(away)
    return Typed(guarded(finite, F.when(big, c).otherwise(edge), "round: not finite"), DOUBLE)


def _whole(name, of):
    def apply(x):
        c = need(x, is_numeric, name)
        if not is_float(x.type):
            return Typed(c, x.type)
        big = F.isnan(c) | (F.abs(c) >= float(1 << 52))
        return Typed(F.when(big, c).otherwise(of(F.when(~big, c)).cast("double")), DOUBLE)

    return apply


#: Spellings of numbers that text may have.
INT_TEXT, FLOAT_TEXT = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _to_int64(x):
    if is_int(x.type) or is_uint(x.type):
        return Typed(x.col.cast("long"), LONG)
    if is_float(x.type):
        ok = ~F.isnan(x.col) & (x.col >= -(2.0**63)) & (x.col < 2.0**63)
        return Typed(guarded(ok, F.when(ok, x.col).cast("long"), "to_int64: out of range"), LONG)
    if is_time(x.type):
        return Typed(F.unix_micros(x.col.cast("timestamp")), LONG)
    if isinstance(x.type, T.VariantType):
        return Typed(F.variant_get(x.col, "$", "bigint"), LONG)
    c = text(x, "to_int64")
    return Typed(guarded(c.rlike(INT_TEXT), F.when(c.rlike(INT_TEXT), c).cast("long"), "to_int64: not an integer"), LONG)


def _to_float64(x):
    if is_numeric(x.type):
        c = x.col.cast("double")
    elif isinstance(x.type, T.VariantType):
        c = F.variant_get(x.col, "$", "double")
    else:
        s = text(x, "to_float64")
        c = guarded(s.rlike(FLOAT_TEXT), F.when(s.rlike(FLOAT_TEXT), s).cast("double"), "to_float64: not a number")
    return Typed(guarded(~F.isnan(c) & (F.abs(c) < float("inf")), c, "to_float64: not finite"), DOUBLE)


def _to_string(x):
    if is_time(x.type):
        return Typed(F.unix_micros(x.col.cast("timestamp")).cast("string"), STRING)
    if is_float(x.type):
        ok = ~F.isnan(x.col) & (F.abs(x.col) < float("inf"))
        return Typed(guarded(ok, F.regexp_replace(x.col.cast("string"), r"\.0$", ""), "to_string: not finite"), STRING)
    if isinstance(x.type, T.VariantType):
        return Typed(F.variant_get(x.col, "$", "string"), STRING)
    need(x, lambda t: is_numeric(t) or isinstance(t, T.StringType | T.BooleanType), "to_string")
    return Typed(x.col.cast("string"), STRING)


def pointer_paths(pointer: str) -> list[str]:
    """Variant paths for a JSON pointer (RFC 6901): a number is an index of an array or a key of an object."""
    if pointer == "":
        return ["$"]
    if not pointer.startswith("/"):
        raise QueryError("json_get: a pointer starts with /")
    paths = ["$"]
    for part in pointer[1:].split("/"):
        key = part.replace("~1", "/").replace("~0", "~")
        quoted = "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        index = [f"[{key}]"] if key == "0" or (key.isascii() and key.isdigit() and key[0] != "0") else []
        paths = [p + step for p in paths for step in [*index, quoted]]
    return paths


def _json_get(s, pointer):
    c = F.try_parse_json(text(s, "json_get"))
    if not pointer.is_literal:
        return Typed(F.try_parse_json(_pointed(text(s, "json_get"), text(pointer, "json_get"))), VARIANT)
    if pointer.literal is None:
        return Typed(F.lit(None).cast("variant"), VARIANT)
    found = F.coalesce(*[F.try_variant_get(c, path, "variant") for path in pointer_paths(pointer.literal)])
    return Typed(F.when(~F.is_variant_null(found), found), VARIANT)


def _pointed(doc: Column, pointer: Column) -> Column:
    """Pointers that differ from row to row: an Arrow UDF, the one function that has no built-in form; one that is none gives NULL."""

    @F.pandas_udf("string")
    def look(docs: pd.Series, pointers: pd.Series) -> pd.Series:
        def one(d, p):
            try:
                if p and not p.startswith("/"):
                    return None
                at = json.loads(d)
                for part in (p.split("/")[1:] if p else []):
                    key = part.replace("~1", "/").replace("~0", "~")
                    if isinstance(at, list) and key != "0" and not (key.isascii() and key.isdigit() and key[0] != "0"):
                        return None
                    at = at[int(key)] if isinstance(at, list) else at[key]
                return None if at is None else json.dumps(at)
            except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                return None

        return pd.Series([one(d, p) for d, p in zip(docs, pointers, strict=True)], dtype=object)

    return look(doc, pointer)


def _json_text(x: Typed) -> Column:
    """Any value as JSON text, SQL NULL as ``null``."""
    if isinstance(x.type, T.NullType):
        return F.lit("null")
    inside = F.to_json(F.struct(x.col.alias("v")), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(inside, F.lit(6), F.char_length(inside) - 6), F.lit("null"))


def _json_object(*args):
    if len(args) % 2 or not 2 <= len(args) <= 16:
        raise QueryError("json_object: 1 to 8 pairs")
    keys = [a.literal for a in args[::2] if a.is_literal]
    if len(set(keys)) < len(keys):
        raise QueryError("json_object: a key repeats")
    columns = [text(k, "json_object") for k in args[::2]]
    distinct = F.size(F.array_distinct(F.array(*columns))) == len(columns)
    body = F.concat_ws(",", *[F.concat(_json_text(k), F.lit(":"), _json_text(v)) for k, v in zip(args[::2], args[1::2], strict=True)])
    known = functools.reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return Typed(F.when(known, guarded(distinct, F.parse_json(F.concat(F.lit("{"), body, F.lit("}"))), "json_object: a key repeats")), VARIANT)


def _json_stringify(x):
    return Typed(_json_text(x), STRING)


#: RFC 3339 with a known offset, no leap second, microseconds at most.
TIME_TEXT = r"^\d{4}-\d{2}-\d{2}[Tt ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _parse_timestamp(s):
    c = text(s, "parse_timestamp")
    good = c.rlike(TIME_TEXT) & ~c.endswith("-00:00")
    return Typed(guarded(good, F.to_timestamp(F.when(good, F.upper(c))), "parse_timestamp: not RFC 3339 with a known offset"), T.TimestampType())


def _format_timestamp(t):
    c = need(t, is_time, "format_timestamp").cast("timestamp")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    return Typed(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), STRING)


def _array_length(a):
    return Typed(F.array_size(as_array(a, "array_length")[0]).cast("long"), LONG)


def _array_get(a, i):
    c, t = as_array(a, "array_get")
    at = integer(i, "array_get")
    return Typed(guarded(at >= 0, F.get(c, F.least(at, F.lit(1 << 30)).cast("int")), "array_get: negative index"), t)


def _array_contains(a, v):
    c, t = as_array(a, "array_contains")
    return Typed(F.when(v.col.isNotNull(), F.coalesce(F.array_contains(c, v.col.cast(t)), F.when(c.isNotNull(), F.lit(False)))), BOOL)


def _array_append(a, v):
    c, t = as_array(a, "array_append")
    return Typed(F.when(c.isNotNull(), F.array_append(c, v.col.cast(t))), T.ArrayType(t))


def _array_slice(a, start, count):
    c, t = as_array(a, "array_slice")
    at, n = integer(start, "array_slice"), integer(count, "array_slice")
    return Typed(guarded((at >= 0) & (n >= 0), F.slice(c, (at + 1).cast("int"), n.cast("int")), "array_slice: negative bound"), T.ArrayType(t))


def _array_concat(a, b):
    (x, t), (y, u) = as_array(a, "array_concat"), as_array(b, "array_concat")
    if t != u:
        raise TypeMismatch("array_concat: element types differ")
    return Typed(F.concat(x, y), T.ArrayType(t))


def _array_join(a, sep):
    c, t = as_array(a, "array_join")
    if isinstance(t, T.VariantType):
        c = F.transform(c, lambda x: F.variant_get(x, "$", "string"))
    elif not isinstance(t, T.StringType):
        raise TypeMismatch("array_join: text elements only")
    return Typed(F.when(~F.exists(c, lambda x: x.isNull()), F.array_join(c, sep.literal) if sep.is_literal else F.call_function("array_join", c, text(sep, "array_join"))), STRING)


def _object_keys(o):
    if isinstance(o.type, T.VariantType):
        return Typed(F.json_object_keys(F.to_json(o.col)), T.ArrayType(STRING))
    return Typed(F.map_keys(as_map(o, "object_keys")[0]), T.ArrayType(STRING))


def _object_values(o):
    c, t = as_map(o, "object_values")
    return Typed(F.map_values(c), T.ArrayType(t))


def _object_get(o, k):
    c, t = as_map(o, "object_get")
    return Typed(F.try_element_at(c, text(k, "object_get")), t)


def _object_has_key(o, k):
    c, _ = as_map(o, "object_has_key")
    return Typed(F.array_contains(F.map_keys(c), text(k, "object_has_key")), BOOL)


def _object_remove(o, k):
    c, t = as_map(o, "object_remove")
    key = text(k, "object_remove")
    return Typed(F.when(key.isNotNull(), F.map_filter(c, lambda x, _: x != key)), T.MapType(STRING, t))


def _object_set(o, k, v):
    c, t = as_map(o, "object_set")
    key, value = text(k, "object_set"), v.col.cast(t)
    there = F.transform_values(c, lambda x, old: F.when(x == key, value).otherwise(old))
    added = F.map_concat(c, F.create_map(key, value))
    return Typed(F.when(key.isNotNull(), F.when(F.array_contains(F.map_keys(c), key), there).otherwise(F.when(~F.array_contains(F.map_keys(c), key), added))), T.MapType(STRING, t))


def _split(s, sep):
    c, by = text(s, "split"), text(sep, "split")
    return Typed(guarded(F.char_length(by) > 0, F.split(c, F.concat(F.lit("\\Q"), by, F.lit("\\E")), -1), "split: empty separator"), T.ArrayType(STRING))


def _binary(x, what):
    return need(x, lambda t: isinstance(t, T.StringType | T.BinaryType), what).cast("binary")


def _base64_encode(x):
    return Typed(F.regexp_replace(F.base64(_binary(x, "base64_encode")), "[\r\n]", ""), STRING)


def _base64_decode(s):
    c = text(s, "base64_decode")
    good = c.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return Typed(guarded(good, F.unbase64(F.when(good, c)), "base64_decode: not padded base64"), BYTES)


def _hex_encode(x):
    return Typed(F.lower(F.hex(_binary(x, "hex_encode"))), STRING)


def _hex_decode(s):
    c = text(s, "hex_decode")
    good = c.rlike(r"^([0-9A-Fa-f]{2})*$")
    return Typed(guarded(good, F.unhex(F.when(good, c)), "hex_decode: not pairs of hexadecimal digits"), BYTES)


def _sha256(x):
    return Typed(F.sha2(_binary(x, "sha256"), 256), STRING)


#: name -> (least arguments, most arguments, builder)
REGISTRY: dict[str, tuple[int, int, Callable[..., Typed]]] = {
    "abs": (1, 1, _abs),
    "lower": (1, 1, _ascii_case("lower", UPPER, LOWER)),
    "upper": (1, 1, _ascii_case("upper", LOWER, UPPER)),
    "length": (1, 1, _length),
    "char_length": (1, 1, _length),
    "coalesce": (1, 16, _coalesce),
    "nullif": (2, 2, _nullif),
    "greatest": (1, 16, _extreme("greatest", F.greatest)),
    "least": (1, 16, _extreme("least", F.least)),
    "concat": (2, 16, _concat),
    "substring": (3, 3, _substring),
    "replace": (3, 3, _replace),
    "contains": (2, 2, _test("contains", F.contains)),
    "starts_with": (2, 2, _test("starts_with", F.startswith)),
    "ends_with": (2, 2, _test("ends_with", F.endswith)),
    "trim": (1, 1, _trim),
    "round": (1, 1, _round),
    "floor": (1, 1, _whole("floor", F.floor)),
    "ceil": (1, 1, _whole("ceil", F.ceil)),
    "to_int64": (1, 1, _to_int64),
    "to_float64": (1, 1, _to_float64),
    "to_string": (1, 1, _to_string),
    "json_get": (2, 2, _json_get),
    "json_object": (2, 16, _json_object),
    "json_stringify": (1, 1, _json_stringify),
    "parse_timestamp": (1, 1, _parse_timestamp),
    "format_timestamp": (1, 1, _format_timestamp),
    "array_length": (1, 1, _array_length),
    "array_get": (2, 2, _array_get),
    "array_contains": (2, 2, _array_contains),
    "array_append": (2, 2, _array_append),
    "array_slice": (3, 3, _array_slice),
    "array_concat": (2, 2, _array_concat),
    "array_join": (2, 2, _array_join),
    "object_keys": (1, 1, _object_keys),
    "object_values": (1, 1, _object_values),
    "object_get": (2, 2, _object_get),
    "object_has_key": (2, 2, _object_has_key),
    "object_remove": (2, 2, _object_remove),
    "object_set": (3, 3, _object_set),
    "split": (2, 2, _split),
    "base64_encode": (1, 1, _base64_encode),
    "base64_decode": (1, 1, _base64_decode),
    "hex_encode": (1, 1, _hex_encode),
    "hex_decode": (1, 1, _hex_decode),
    "sha256": (1, 1, _sha256),
}


def call(name: str, args: list[Typed]) -> Typed:
    """A function applied, or the error that names what is wrong."""
    found = REGISTRY.get(name.lower())
    if found is None:
        raise UnknownName(f"unknown function {name}")
    least, most, build = found
    if not least <= len(args) <= most:
        raise QueryError(f"{name}: {least} to {most} arguments, not {len(args)}")
    return build(*args)
