"""Operators, casts and the 46 functions on single values."""

import pytest

from millrace.errors import QueryError, TypeMismatch, UnknownName
from millrace.functions import udf
from millrace.functions.expr import compile_expr
from millrace.functions.scalars import REGISTRY, pointer_paths
from millrace.functions.types import parse_type


def col(n):
    return {"k": "col", "name": n}


def lit(v):
    kind = {bool: "bool", int: "int64", float: "float64", str: "utf8", type(None): "null"}[type(v)]
    return {"k": "lit", "value": {"t": kind} | ({} if v is None else {"v": v})}


def call(n, *args):
    return {"k": "call", "name": n, "args": [a if isinstance(a, dict) else lit(a) for a in args]}


def op(o, a, b):
    return {"k": "bin", "op": o, "left": a if isinstance(a, dict) else lit(a), "right": b if isinstance(b, dict) else lit(b)}


def cast(e, ty, soft=False):
    return {"k": "try_cast" if soft else "cast", "expr": e if isinstance(e, dict) else lit(e), "ty": ty}


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql("""
        SELECT cast(7 AS bigint) i, cast(0 AS bigint) z, cast(2.5 AS double) x, double('NaN') n, ' aÉb ' t, cast(null AS bigint) nu, cast(5 AS decimal(20,0)) u,
        cast('18446744073709551615' AS decimal(20,0)) umax, array('a', 'b', null) ar, map('k', 1L, 'j', 2L) m, timestamp'2024-01-02 03:04:05.000006' ts,
        '{"a":{"b":[1,null,"x"]},"0":5}' js, true b, parse_json('{"q":1.5,"r":[1,2]}') d, x'6869' bin
    """)


ARR, MAP = col("ar"), col("m")
CASES = [
    (op("/", col("i"), 2), 3), (op("/", op("-", 0, col("i")), 2), -3), (op("/", col("i"), col("z")), None), (op("/", col("x"), 0.0), None), (op("%", col("i"), 4), 3),
    (op("=", col("n"), col("n")), False), (op("<>", col("n"), 1.0), True), (op(">", col("n"), 1.0), False), (op("<", 1.0, col("n")), False), (op("<", col("n"), 1.0), False), (op(">=", col("n"), col("n")), False), (op("=", col("i"), 7.0), True),
    (op("+", col("u"), col("u")), 10), (op("and", None, False), False), (op("or", None, True), True), (op("and", None, True), None), ({"k": "not", "expr": lit(None)}, None),
    (call("abs", -3), 3), (call("lower", "ABÉ"), "abÉ"), (call("upper", "abé"), "ABé"), (call("length", col("t")), 5), (call("char_length", "é😀"), 2), (call("trim", col("t")), "aÉb"), (call("trim", " x\t"), "x"),
    (call("coalesce", col("nu"), 3), 3), (call("nullif", 3, 3), None), (call("nullif", 3, None), 3), (call("greatest", col("n"), col("x"), 1), 2.5), (call("least", col("nu"), 4), 4), (call("concat", "a", "b"), "ab"), (call("concat", "a", None), None),
    (call("substring", "hello", 2, 3), "ell"), (call("substring", "h😀llo", 2, 1), "😀"), (call("replace", "aXbX", "X", "-"), "a-b-"), (call("contains", "abc", "b"), True), (call("starts_with", "abc", "b"), False), (call("ends_with", "abc", "c"), True),
    (call("round", -1.5), -2.0), (call("round", 2.5), 3.0), (call("round", 3), 3), (call("floor", -2.5), -3.0), (call("ceil", col("x")), 3.0),
    (call("to_int64", "12"), 12), (call("to_int64", 2.9), 2), (call("to_int64", -2.9), -2), (call("to_float64", "1e3"), 1000.0), (call("to_string", 1.0), "1"), (call("to_string", True), "true"), (call("to_string", col("ts")), "1704164645000006"),
    (call("to_int64", call("json_get", col("js"), "/a/b/0")), 1), (call("json_get", col("js"), "/a/b/1"), None), (call("to_int64", call("json_get", col("js"), "/0")), 5), (call("json_get", "not json", "/a"), None), (call("to_int64", call("json_get", col("js"), call("concat", "/", "0"))), 5),
    (call("json_stringify", call("json_object", "k", 1, "n", None)), '{"k":1,"n":null}'), (call("json_stringify", 'a"b'), '"a\\"b"'), (call("json_stringify", None), "null"), (call("json_stringify", col("nu")), "null"),
    (call("format_timestamp", col("ts")), "2024-01-02T03:04:05.000006Z"), (call("to_int64", call("parse_timestamp", "2024-01-02T05:04:05+02:00")), 1704164645000000),
    (call("array_length", ARR), 3), (call("array_get", ARR, 1), "b"), (call("array_get", ARR, 9), None), (call("array_contains", ARR, "a"), True), (call("array_contains", ARR, "q"), False), (call("array_append", ARR, "z"), ["a", "b", None, "z"]),
    (call("array_slice", ARR, 1, 9), ["b", None]), (call("array_concat", ARR, ARR), ["a", "b", None] * 2), (call("array_join", ARR, ","), None), (call("array_join", call("array_slice", ARR, 0, 2), ","), "a,b"),
    (call("object_keys", MAP), ["k", "j"]), (call("object_values", MAP), [1, 2]), (call("object_get", MAP, "q"), None), (call("object_has_key", MAP, "k"), True), (call("object_remove", MAP, "k"), {"j": 2}), (call("object_set", MAP, "k", 9), {"k": 9, "j": 2}), (call("object_set", MAP, "n", 9), {"k": 1, "j": 2, "n": 9}), (call("object_has_key", col("d"), "q"), True),
    (call("split", "a.b..c", "."), ["a", "b", "", "c"]), (call("base64_encode", "x" * 100), "eHh4" * 33 + "eA=="), (call("base64_decode", "aGk="), b"hi"), (call("hex_encode", col("bin")), "6869"), (call("hex_decode", "6869"), b"hi"), (call("sha256", "a"), "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"),
    (cast(1e30, "int64"), 2**63 - 1), (cast(-1e30, "int64"), -(2**63)), (cast(col("n"), "int64"), 0), (cast(-2.9, "int64"), -2), (cast(" 5", "int64", True), None), (cast("5", "int64"), 5), (cast("x", "float64", True), None), (cast("99999999999999999999", "int64", True), None), (cast(-1, "uint64", True), None),
    ({"k": "dyn_get", "expr": MAP, "key": "k"}, 1), (cast({"k": "dyn_get", "expr": col("d"), "key": "q"}, "float64"), 1.5), ({"k": "is_null", "expr": call("json_get", col("js"), "/zz")}, True), ({"k": "neg", "expr": col("i")}, -7),
    ({"k": "case", "whens": [[op(">", col("i"), 5), lit("big")]], "else": lit("small")}, "big"),
]


def test_values(row):
    made = row.select(*[compile_expr(e, row.schema).col.alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).first()
    for (e, want), got in zip(CASES, made, strict=True):
        got = bytes(got) if isinstance(got, bytearray) else got
        assert got == want or (str(got) == str(want) and want is not None), (e, got, want)


def test_every_function_is_there():
    assert len(REGISTRY) == 46


FAILS = [
    call("substring", "x", 0, 1), call("replace", "x", "", "y"), call("split", "x", ""), call("abs", -(2**63)), op("+", 2**63 - 1, col("i")), call("to_int64", " 5"), call("to_int64", 1e300), call("to_float64", "nan"), call("round", col("n")),
    call("array_get", ARR, -1), call("base64_decode", "aGk"), call("hex_decode", "abc"), call("hex_decode", "zz"), call("parse_timestamp", "2024-01-02 03:04:05"), call("parse_timestamp", "2024-01-02T03:04:60Z"), cast("5 ", "int64"), cast(-1, "uint64"), op("+", col("umax"), col("u")),
]


@pytest.mark.parametrize("e", FAILS, ids=range(len(FAILS)))
def test_errors_at_run_time(row, e):
    with pytest.raises(Exception, match=r"(?s).+"):
        row.select(compile_expr(e, row.schema).col.alias("v")).collect()


REJECTED = [
    (call("mystery", 1), UnknownName), (col("nope"), UnknownName), (op("+", "a", 1), TypeMismatch), (op("+", col("d"), 1), TypeMismatch), (op("and", 1, True), TypeMismatch), (call("substring", "x", 1), QueryError), (call("concat", 1, 2), TypeMismatch),
    (call("json_object", "a", 1, "a", 2), QueryError), (op("=", "a", 1), TypeMismatch), ({"k": "col", "name": "i", "x": 1}, QueryError), ({"k": "what"}, QueryError), (cast("1", "quux"), QueryError),
]


@pytest.mark.parametrize(("e", "error"), REJECTED, ids=range(len(REJECTED)))
def test_errors_before_anything_runs(row, e, error):
    with pytest.raises(error):
        compile_expr(e, row.schema)


def test_type_names():
    assert parse_type("array<map<utf8,int64>>").simpleString() == "array<map<string,bigint>>"
    assert parse_type("struct<a:int64, b?:struct<c:bool>>")["a"].nullable is False
    for bad in ("map<float64,int64>", "array<", "int64>", "struct<a:int64,a:bool>"):
        with pytest.raises(QueryError):
            parse_type(bad)


def test_json_pointers():
    assert pointer_paths("") == ["$"] and pointer_paths("/a~1b") == ["$['a/b']"]
    assert pointer_paths("/0") == ["$[0]", "$['0']"] and pointer_paths("/01") == ["$['01']"]


def test_user_functions(spark, row):
    from pyspark.sql import types as T

    name = udf.register_scalar("plus_one", 1, lambda x: x + 1, [T.LongType()], T.LongType())
    e = {"k": "plugin", "name": name, "args": [col("i")]}
    assert row.select(compile_expr(e, row.schema).col.alias("v")).first()["v"] == 8
    with pytest.raises(QueryError):
        udf.register_scalar("plus_one", 1, lambda x: x, [T.LongType()], T.LongType())
    out = udf.register_transform("twice", 1, lambda batches: (b.iloc[[0, 0]] for b in batches), T.StructType([T.StructField("i", T.LongType())]))
    assert udf.transform(row.select("i"), out).count() == 2
