"""Connectors: pull sources as Python data sources, push sources through a durable spool, JDBC tracking, an in-process bus.

What is pulled is a function, ``fetch(offset) -> (records, next offset)``; Spark's
checkpoint stores the offsets.  What is pushed (brokers, sockets, listeners) is
written to a folder before it is acknowledged, and streams read that folder's
files: they survive a restart, each record counts once, and executors read them.
"""

from __future__ import annotations

import json
import os
import re
import socket
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from millrace.errors import QueryError

RECORD = "record string"


def http_fetch(url: str, timeout: float = 10.0, headers: dict | None = None, token: str | None = None, retries: int = 3, backoff: float = 0.5) -> Callable[[int], tuple[list[str], int]]:
    """GET ``url?offset=n``: a JSON array of records; the offset counts them.

    ``token`` is sent as a bearer's.  A poll that fails is tried again after growing pauses; one that fails for good gives
    no records, and the next trigger polls the same offset, so a missed tick loses nothing.  401, 403 and 404 are errors.
    """

    def fetch(offset: int) -> tuple[list[str], int]:
        import urllib.error
        import urllib.request

        every = (headers or {}) | ({"Authorization": f"Bearer {token}"} if token else {})
        request = urllib.request.Request(f"{url}{'&' if '?' in url else '?'}offset={offset}", headers=every)
        for attempt in range(retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    rows = [json.dumps(r) for r in json.load(answer)]
                return rows, offset + len(rows)
            except urllib.error.HTTPError as e:
                if e.code in (401, 403, 404):
                    raise
            except OSError:
                pass
            if attempt < retries:
                time.sleep(backoff * 2**attempt)
        return [], offset

    return fetch


def tcp_fetch(host: str, port: int, framing: str = "lines", timeout: float = 1.0, most: int = 10_000) -> Callable[[int], tuple[list[str], int]]:
    """Records from a socket, one to a line or with four bytes of length before each; what arrives within the timeout is a batch."""
    if framing not in ("lines", "length_prefixed"):
        raise QueryError("framing is lines or length_prefixed")
    held: dict = {}

    def fetch(offset: int) -> tuple[list[str], int]:
        out: list[str] = []
        try:
            if "s" not in held:
                held["s"], held["b"] = socket.create_connection((host, port), timeout), b""
            held["s"].settimeout(timeout)
            while len(out) < most:
                data = held["s"].recv(1 << 16)
                if not data:
                    # closed by the peer: connect again at the next trigger
                    held.pop("s").close()
                    break
                held["b"] += data
                records, held["b"] = unframed(held["b"], framing)
                out += records
        except TimeoutError:
            pass
        except OSError:
            if s := held.pop("s", None):
                s.close()
        return out, offset + len(out)

    return fetch


def unframed(data: bytes, framing: str) -> tuple[list[str], bytes]:
    """Whole records of a byte stream, and what is left."""
    if framing == "lines":
        *lines, rest = data.split(b"\n")
        return [x.rstrip(b"\r").decode() for x in lines if x.strip()], rest
    out, at = [], 0
    while len(data) - at >= 4 and len(data) - at - 4 >= (n := int.from_bytes(data[at : at + 4], "big")):
        out.append(data[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out, data[at:]


class Inbox:
    """A durable queue between a client's callbacks and a stream: brokers, sockets and listeners that push.

    ``offer`` returns True once the record is on disk in ``folder`` (a path that driver and executors share): only then may
    a broker's message be acknowledged.  Segments appear under their final name when full or ``every`` seconds old, and
    ``stream`` reads them as new files, so a restarted stream goes on from its checkpoint and loses nothing; a segment that
    a process left open is taken over by the next.  Streams delete what they have committed; while ``capacity`` records
    wait, ``offer`` waits up to ``wait`` seconds for room, then refuses (the caller drops the record or tells its peer).
    """

    def __init__(self, folder: str, capacity: int = 10_000, wait: float = 0.0, segment: int = 1_000, every: float = 0.5):
        self.folder, self.capacity, self.wait, self.segment, self.refused = folder, capacity, wait, segment, 0
        self.room, self.file, self.count = threading.Condition(), None, 0
        os.makedirs(folder, exist_ok=True)
        for name in sorted(os.listdir(folder)):
            if name.startswith(".open-"):
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    count = sum(1 for _ in f)
                os.rename(f"{folder}/{name}", f"{folder}/sealed-{count}-{name.removeprefix('.open-')}")
        threading.Thread(target=self._seal_by_time, args=(every,), daemon=True).start()

    def _seal_by_time(self, every: float) -> None:
        while True:
            time.sleep(every)
            self.seal()

    def waiting(self) -> int:
        """Records that no stream has committed and deleted, as far as the names of segments tell."""
        return self.count + sum(int(n.split("-")[1]) for n in os.listdir(self.folder) if n.startswith("sealed-"))

    def offer(self, record: str) -> bool:
        with self.room:
            until = time.monotonic() + self.wait
            while self.waiting() >= self.capacity:
                if time.monotonic() >= until:
                    self.refused += 1
                    return False
                self.room.wait(0.05)
            if self.file is None:
                self.file = open(f"{self.folder}/.open-{time.time_ns():020d}.txt", "w", encoding="utf-8")
            self.file.write(json.dumps(record) + "\n")
            self.file.flush()
            os.fsync(self.file.fileno())
            self.count += 1
            if self.count >= self.segment:
                self._seal()
            return True

    def seal(self) -> None:
        with self.room:
            self._seal()

    def _seal(self) -> None:
        if self.file is not None:
            name = self.file.name
            self.file.close()
            try:
                os.rename(name, f"{self.folder}/sealed-{self.count}-{os.path.basename(name).removeprefix('.open-')}")
            except FileNotFoundError:
                pass  # another process has taken the segment over, with all its records
            self.file, self.count = None, 0

    def stream(self, spark: SparkSession, keep: bool = False) -> DataFrame:
        """The records as a stream; ``keep``: committed segments stay (several streams may read them)."""
        return spooled(spark, self.folder, keep)


def spooled(spark: SparkSession, folder: str, keep: bool = True) -> DataFrame:
    lines = spark.readStream.option("cleanSource", "off" if keep else "delete").text(folder if "://" in folder else f"file://{folder}")
    return lines.select(F.from_json(F.concat(F.lit('{"record":'), "value", F.lit("}")), RECORD)["record"].alias("record"))


def http_listener(inbox: Inbox, host: str = "127.0.0.1", port: int = 0, limit: int = 64 * 1024):
    """An HTTP listener that puts each POSTed record into the inbox: 202, or 429 when it is full, 413 when it is too long.

    Returns the server; ``server.server_port`` is its port, ``server.shutdown()`` ends it.
    """
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            size = int(self.headers.get("Content-Length") or 0)
            code = 413 if size > limit else 202 if inbox.offer(self.rfile.read(size).decode("utf-8", "replace")) else 429
            self.send_response(code)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class _Reader(SimpleDataSourceStreamReader):
    """Batches are fetched on the driver and kept until committed, so a retry reads the same records."""

    def __init__(self, fetch):
        self.fetch, self.kept = fetch, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        records, end = self.fetch(start["n"])
        self.kept[start["n"], end] = records
        return iter([(r,) for r in records]), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        found = self.kept.get((start["n"], end["n"]))
        if found is None:
            found, _ = self.fetch(start["n"])
        return iter([(r,) for r in found[: end["n"] - start["n"]]])

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k[1] > end["n"]}


def stream_of(spark: SparkSession, name: str, fetch: Callable[[int], tuple[list[str], int]]) -> DataFrame:
    """A stream of text records from a fetch function; decode it with ``formats.decode_json``."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return RECORD

        def simpleStreamReader(self, schema):
            return _Reader(fetch)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def jdbc_since(spark: SparkSession, url: str, query: str, tracking: str, since, properties: dict | None = None) -> DataFrame:
    """Rows of a database query past the last tracking value (a number or text); the predicate runs in the database.

    The next call's ``since`` is the largest tracking value of this one's rows.
    """
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", tracking):
        raise QueryError(f"{tracking} is not a column name")
    if isinstance(since, bool) or not isinstance(since, int | float | str):
        raise QueryError("a tracking value is a number or text")
    value = repr(since) if isinstance(since, int | float) else "'" + since.replace("'", "''") + "'"
    return spark.read.jdbc(url, f"(SELECT * FROM ({query}) q WHERE {tracking} > {value}) t", properties=properties or {})


class Bus:
    """Topics in one process: each is a spool that any number of streams read from the start, or from their checkpoint."""

    def __init__(self, folder: str):
        self.folder, self.topics, self.lock = folder, {}, threading.Lock()

    def _topic(self, name: str) -> Inbox:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise QueryError(f"{name} is not a topic's name")
        with self.lock:
            if name not in self.topics:
                self.topics[name] = Inbox(f"{self.folder}/{name}", capacity=1 << 62)
            return self.topics[name]

    def publish(self, topic: str, records: list[str]) -> None:
        inbox = self._topic(topic)
        for r in records:
            inbox.offer(r)
        inbox.seal()

    def stream(self, spark: SparkSession, topic: str) -> DataFrame:
        return self._topic(topic).stream(spark, keep=True)

    def sink(self, topic: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each row as a JSON record of the topic (at least once)."""

        def send(df: DataFrame, batch_id: int) -> None:
            rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).toLocalIterator()
            self.publish(topic, [r["r"] for r in rows])

        return send
