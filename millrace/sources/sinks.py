"""Sinks: files, log lines, batched posts with retries and a dead-letter table, and templates for other stores.

A sink is a function of (batch DataFrame, batch id) for ``foreachBatch``, and
works on finite tables too.  Delivery is at least once; batches carry their id,
so a receiver that remembers ids sees each batch once.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError
from millrace.functions.scalars import Typed, _json_text


def mapped(df: DataFrame, template: dict | list | str | float | bool | None) -> Column:
    """An output document: JSON with ``{"$field": name}`` and ``{"$literal": value}`` in it; NULL fields stay null."""

    def text(x) -> Column:
        if isinstance(x, dict):
            if set(x) == {"$field"}:
                if x["$field"] not in df.columns:
                    raise QueryError(f"output: unknown column {x['$field']}")
                return _json_text(Typed(F.col(f"`{x['$field']}`"), df.schema[x["$field"]].dataType))
            if set(x) == {"$literal"}:
                return F.lit(json.dumps(x["$literal"], ensure_ascii=False))
            if bad := [k for k in x if k.startswith("$")]:
                raise QueryError(f"output: unknown directive {bad[0]}")
            pairs = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), text(v)) for k, v in x.items()]
            return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
        if isinstance(x, list):
            return F.concat(F.lit("["), F.concat_ws(",", *[text(v) for v in x]), F.lit("]"))
        return F.lit(json.dumps(x, ensure_ascii=False))

    return text(template)


def to_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with explicit nulls; existing output is never overwritten unless asked."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def to_csv(df: DataFrame, path: str, header: bool = True, null_marker: str = "", mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=header, nullValue=null_marker, emptyValue='""', quote='"', escape='"').csv(path)


def log(df: DataFrame, batch_id: int = 0, emit: Callable[[str], None] = print) -> None:
    """One line for each row; the driver sees one row at a time."""
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).toLocalIterator():
        emit(row["r"])


def post(send: Callable[[list[str], str], None], template=None, batch_rows: int = 100, retries: int = 3, backoff: float = 0.2, dead_letters: str | None = None, best_effort: bool = False) -> Callable[[DataFrame, int], None]:
    """A sink that sends documents in batches from the executors.

    ``send(documents, batch key)`` posts one batch (an HTTP client, a message broker, Redis or InfluxDB) and raises if it
    failed.  A batch that still fails after the retries goes to the ``dead_letters`` path; without one it stops the query,
    unless the sink is best effort.
    """

    def sink(df: DataFrame, batch_id: int) -> None:
        docs = df.select((mapped(df, template) if template is not None else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("doc"))

        def deliver(batches: Iterator) -> Iterator:
            import pandas as pd
            from pyspark import TaskContext

            part, n = TaskContext.get().partitionId(), 0
            for b in batches:
                rows = list(b["doc"])
                for i in range(0, len(rows), batch_rows):
                    some, key = rows[i : i + batch_rows], f"{batch_id}-{part}-{n}"
                    n += 1
                    for attempt in range(retries + 1):
                        try:
                            send(some, key)
                            break
                        except Exception as e:
                            if attempt == retries:
                                if not dead_letters and not best_effort:
                                    raise
                                yield pd.DataFrame({"key": key, "error": str(e)[:500], "doc": some})
                            else:
                                time.sleep(backoff * 2**attempt)

        lost = docs.mapInPandas(deliver, "key string, error string, doc string")
        if dead_letters:
            lost.write.mode("append").parquet(dead_letters)
        else:
            lost.write.format("noop").mode("append").save()

    return sink


def http_send(url: str, timeout: float = 10.0, headers: dict | None = None) -> Callable[[list[str], str], None]:
    """For ``post``: one JSON array for each batch, its key as the idempotency header."""

    def send(docs: list[str], key: str) -> None:
        import urllib.request

        body = ("[" + ",".join(docs) + "]").encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Idempotency-Key": key} | (headers or {}))
        with urllib.request.urlopen(request, timeout=timeout):
            pass

    return send


def tcp_send(host: str, port: int, framing: str = "lines", timeout: float = 10.0) -> Callable[[list[str], str], None]:
    """For ``post``: documents as frames, one to a line or with four bytes of length before each."""
    if framing not in ("lines", "length_prefixed"):
        raise QueryError("framing is lines or length_prefixed")

    def send(docs: list[str], key: str) -> None:
        import socket

        frames = [d.encode() for d in docs]
        data = b"".join(f + b"\n" for f in frames) if framing == "lines" else b"".join(len(f).to_bytes(4, "big") + f for f in frames)
        with socket.create_connection((host, port), timeout) as s:
            s.sendall(data)

    return send


def table(path: str) -> Callable[[DataFrame, int], None]:
    """A durable table for ``foreachBatch``: a batch that is delivered again replaces itself, so each counts once."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return sink


def line_protocol(df: DataFrame, measurement: str, tags: list[str], fields: list[str], time_column: str) -> Column:
    """Rows as InfluxDB lines: measurement, tags, fields and a time in microseconds.

    NULL and empty tags, NULL and non-finite fields are left out; a row without any field, or without a time, is NULL.
    """
    escape = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), r"([,= ])", r"\\$1")
    name = re.sub(r"([,=\\ ])", r"\\\1", re.sub(r"[\r\n]+", " ", measurement)) if measurement else ""

    def value(f: str) -> Column:
        c, t = F.col(f"`{f}`"), df.schema[f].dataType
        if isinstance(t, T.StringType):
            return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
        if isinstance(t, T.FloatType | T.DoubleType):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string"))
        return F.concat(c.cast("string"), F.lit("i")) if isinstance(t, T.IntegralType) else c.cast("string")

    key = lambda x: F.lit(re.sub(r"([,= ])", r"\\\1", x) + "=")
    head = F.concat_ws(",", F.lit(name), *[F.when(F.col(f"`{t}`").cast("string") != "", F.concat(key(t), escape(F.col(f"`{t}`")))) for t in tags])
    body = F.concat_ws(",", *[F.concat(key(f), value(f)) for f in fields])
    at = F.unix_micros(F.col(f"`{time_column}`").cast("timestamp")).cast("string")
    return F.when((body != "") & at.isNotNull(), F.concat_ws(" ", head, body, at))


REDIS = ("SET", "HSET", "XADD", "PUBLISH", "LPUSH", "RPUSH")


def redis_commands(df: DataFrame, command: str, key: str, template) -> Column:
    """A Redis command for each row as a JSON array of its words; the client that ``post`` calls sends it."""
    if command not in REDIS:
        raise QueryError(f"a Redis command is one of {', '.join(REDIS)}")
    doc = mapped(df, template)
    name = F.to_json(F.array(F.col(f"`{key}`").cast("string")))
    head = F.concat(F.lit(f'["{command}",'), F.substring(name, F.lit(2), F.char_length(name) - 2))
    star = F.lit(',"*","doc",' if command == "XADD" else ',"doc",' if command == "HSET" else ",")
    quoted = F.to_json(F.array(doc))
    return F.concat(head, star, F.substring(quoted, F.lit(2), F.char_length(quoted) - 2), F.lit("]"))


def redis_send(host: str, port: int = 6379, timeout: float = 10.0) -> Callable[[list[str], str], None]:
    """For ``post``: the commands of ``redis_commands`` over one connection, all sent before the answers are read."""

    def send(docs: list[str], key: str) -> None:
        from millrace.sources.providers import resp, resp_answer

        import socket

        with socket.create_connection((host, port), timeout) as s:
            s.sendall(b"".join(resp(json.loads(d)) for d in docs))
            with s.makefile("rb") as answers:
                for _ in docs:
                    resp_answer(answers)

    return send


def jdbc_insert(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Append through JDBC, one transaction for each partition."""
    df.write.jdbc(url, table, mode="append", properties=properties or {})


def jdbc_upsert(df: DataFrame, url: str, table: str, keys: list[str], staging: str, properties: dict | None = None) -> None:
    """Put rows into a table by key: partitions fill a staging table in parallel, then one MERGE is one transaction.

    A batch that is delivered again changes nothing.  Keys are unique within the batch; ``staging`` is overwritten.
    """
    names = df.columns
    if not keys or [k for k in keys if k not in names] or any(not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", x) for x in (*names, table, staging)):
        raise QueryError("an upsert has keys among its columns, and plain names")
    df.write.jdbc(url, staging, mode="overwrite", properties=properties or {})
    quote = lambda c: '"' + c + '"'
    on = " AND ".join(f"t.{quote(k)} = s.{quote(k)}" for k in keys)
    rest = [c for c in names if c not in keys]
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{quote(c)} = s.{quote(c)}' for c in rest)}" if rest else ""
    merge = f"MERGE INTO {table} t USING {staging} s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({', '.join(map(quote, names))}) VALUES ({', '.join('s.' + quote(c) for c in names)})"
    jvm = df.sparkSession._jvm
    settings = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        settings.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        statement.executeUpdate(merge)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
