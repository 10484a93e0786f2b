"""Reference tables in revisions: immutable Parquet snapshots with compare-and-set mutation.

Rows lie in a folder of their own, ``<root>/<table>/data-<unique>``.  A revision
is a manifest file ``r<number>.json`` that names them; it is created only if it is
not there yet, so of two writers one publishes and the other learns of it, and
neither sees the other's rows.  Works on any file system that Spark can reach.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import QueryError, RevisionConflict


@dataclass(frozen=True)
class Revision:
    table: str
    number: int
    keys: list[str]
    rows: int
    sha256: str
    of: int | None = None  # the revision whose content it repeats
    data: str = ""  # the folder of its rows


class ReferenceTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm

    # file system

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    # reading

    def list(self) -> list[str]:
        return [t for t in self._children() if self.revisions(t)]

    def revisions(self, table: str) -> list[Revision]:
        numbers = sorted(int(n[1:-5]) for n in self._children(table) if n.startswith("r") and n.endswith(".json") and n[1:-5].isdigit())
        return [self._manifest(table, n) for n in numbers]

    def _manifest(self, table: str, number: int) -> Revision:
        text = self.spark.read.text(f"{self.root}/{table}/r{number}.json").first()[0]
        return Revision(**json.loads(text))

    def latest(self, table: str) -> Revision:
        found = self.revisions(table)
        if not found:
            raise QueryError(f"unknown table {table}")
        return found[-1]

    def get(self, table: str, number: int | None = None) -> DataFrame:
        number = self.latest(table).number if number is None else number
        if not self._fs().exists(self._path(table, f"r{number}.json")):
            raise QueryError(f"table {table} has no revision {number}")
        return self.spark.read.parquet(f"{self.root}/{table}/{self._manifest(table, number).data}")

    # writing

    def put(self, table: str, df: DataFrame, keys: list[str], expected: int | None = None) -> Revision:
        """Publish rows as the next revision; keys are unique and not NULL."""
        self._check(df, keys)
        return self._publish(table, df, keys, expected)

    def mutate(self, table: str, expected: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Revision:
        """Apply a batch to the expected revision, all of it or nothing.

        A key that the batch holds twice, or deletes and is not there, fails.  Order is kept, new keys follow.
        """
        now = self.latest(table)
        if now.number != expected:
            raise RevisionConflict(f"table {table} is at revision {now.number}, not {expected}")
        old, keys = self.get(table, now.number), now.keys
        order = old.select("*", F.monotonically_increasing_id().alias("_at"))
        if deletes is not None:
            gone = deletes.select(*keys)
            self._check(gone, keys)
            if not gone.join(old.select(*keys), keys, "left_anti").isEmpty():
                raise QueryError("a key to delete is not there")
            if upserts is not None and not gone.join(upserts.select(*keys), keys, "left_semi").isEmpty():
                raise QueryError("a key is both deleted and put")
            order = order.join(gone, keys, "left_anti")
        if upserts is not None:
            upserts = upserts.select(*old.columns)
            self._check(upserts, keys)
            kept = order.join(upserts.select(*keys), keys, "left_anti")
            places = order.select(*keys, "_at")
            new = upserts.join(places, keys, "left").select(*[F.col(c) for c in old.columns], F.coalesce("_at", F.lit((1 << 62))).alias("_at"))
            order = kept.select(*old.columns, "_at").unionByName(new)
        return self._publish(table, order.orderBy("_at", *keys).select(*old.columns), keys, expected)

    def rollback(self, table: str, to: int, expected: int | None = None) -> Revision:
        """Publish an older revision's content as the next revision; no row is written again."""
        old = self._manifest(table, to) if to in [r.number for r in self.revisions(table)] else None
        if old is None:
            raise QueryError(f"table {table} has no revision {to}")
        found = self.revisions(table)
        self._expect(table, found, expected)
        return self._create(Revision(table, found[-1].number + 1, old.keys, old.rows, old.sha256, to, old.data))

    def gc(self, table: str, keep: set[int] | None = None) -> list[int]:
        """Delete revisions that are neither the latest nor in use; returns their numbers."""
        found = self.revisions(table)
        gone = [r for r in found[:-1] if r.number not in (keep or set())]
        used = {r.data for r in found if r not in gone}
        for r in gone:
            self._fs().delete(self._path(table, f"r{r.number}.json"), False)
            if r.data not in used:
                self._fs().delete(self._path(table, r.data), True)
        return [r.number for r in gone]

    def _check(self, df: DataFrame, keys: list[str]) -> None:
        if not keys or [k for k in keys if k not in df.columns]:
            raise QueryError("a table has keys among its columns")
        bad = df.groupBy(*keys).count().filter((F.col("count") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
        if not bad.isEmpty():
            raise QueryError("keys are unique and not NULL")

    def _expect(self, table: str, found: list[Revision], expected: int | None) -> None:
        now = found[-1].number if found else 0
        if expected is not None and expected != now:
            raise RevisionConflict(f"table {table} is at revision {now}, not {expected}")

    def _publish(self, table: str, df: DataFrame, keys: list[str], expected: int | None) -> Revision:
        found = self.revisions(table)
        self._expect(table, found, expected)
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{name}")
        data = self.spark.read.parquet(f"{self.root}/{table}/{name}")
        return self._create(Revision(table, (found[-1].number if found else 0) + 1, keys, data.count(), content_hash(data), None, name))

    def _create(self, made: Revision) -> Revision:
        """Write the manifest unless it is there: the store's conditional create decides between writers."""
        fs, path = self._fs(), self._path(made.table, f"r{made.number}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if made.of is None:
                fs.delete(self._path(made.table, made.data), True)
            raise RevisionConflict(f"table {made.table}: revision {made.number} was published by another writer") from e
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        return made


def content_hash(df: DataFrame) -> str:
    """SHA-256 of the rows whatever their order: of the sum and count of row digests, so nothing is sorted or gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    found = df.agg(F.count("*").alias("n"), *parts).first()
    import hashlib

    return hashlib.sha256(json.dumps([sorted(df.dtypes), *[str(x) for x in found]]).encode()).hexdigest()
