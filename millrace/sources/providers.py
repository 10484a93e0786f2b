"""Lookup providers for ``external_lookup``: an HTTP service, a Redis server; tables of a database are lookups by join."""

from __future__ import annotations

import json
import socket
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import DataFrame

from millrace.operators.joins import lookup

Fetch = Callable[[list[tuple]], dict[tuple, dict]]


def http_lookup(url: str, timeout: float = 10.0, headers: dict | None = None) -> Fetch:
    """POST ``{"keys": [[...], ...]}``; the answer is an array with an object, or null, for each key."""

    def fetch(keys: list[tuple]) -> dict[tuple, dict]:
        import urllib.request

        body = json.dumps({"keys": [list(k) for k in keys]}, default=str).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"} | (headers or {}))
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            found = json.load(answer)
        if not isinstance(found, list) or len(found) != len(keys):
            raise ValueError("the answer does not have a value for each key")
        return {k: v for k, v in zip(keys, found, strict=True) if v is not None}

    return fetch


def resp(words: list) -> bytes:
    """A Redis command on the wire."""
    parts = [str(w).encode() for w in words]
    return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts)


def resp_answer(stream: BinaryIO):
    """One Redis answer: text, a number, None or a list of them."""
    line = stream.readline()
    if not line.endswith(b"\r\n"):
        raise ConnectionError("the server closed the connection")
    kind, rest = line[:1], line[1:-2]
    if kind == b"-":
        raise ValueError(rest.decode())
    if kind == b":":
        return int(rest)
    if kind == b"$":
        return None if rest == b"-1" else stream.read(int(rest) + 2)[:-2].decode()
    if kind == b"*":
        return None if rest == b"-1" else [resp_answer(stream) for _ in range(int(rest))]
    return rest.decode()


def redis_lookup(host: str, port: int = 6379, prefix: str = "", separator: str = ":", timeout: float = 10.0) -> Fetch:
    """MGET of ``prefix`` and the key's parts joined; values are JSON objects."""
    held: dict = {}

    def fetch(keys: list[tuple]) -> dict[tuple, dict]:
        for again in (False, True):
            try:
                if "s" not in held:
                    held["s"] = socket.create_connection((host, port), timeout)
                    held["f"] = held["s"].makefile("rb")
                held["s"].sendall(resp(["MGET", *[prefix + separator.join(map(str, k)) for k in keys]]))
                found = resp_answer(held["f"])
                return {k: json.loads(v) for k, v in zip(keys, found, strict=True) if v is not None}
            except OSError:
                held.clear()
                if again:
                    raise

    return fetch


def jdbc_lookup(df: DataFrame, url: str, table: str, on: list[tuple[str, str]], keep: list[str] | None = None, inner: bool = False, properties: dict | None = None) -> DataFrame:
    """Lookup in a database's table, read anew by each query (and, in ``foreachBatch``, by each batch)."""
    return lookup(df, df.sparkSession.read.jdbc(url, table, properties=properties or {}), on, keep, inner)
