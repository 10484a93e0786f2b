"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing is one text sink: every row is one gzip member (or one plain record) whose
last byte is the sink's line separator, so Spark itself writes standard WARC
bytes, packed or plain, to any file system it knows (under the sink's own file
names).  A task cuts its records into files by their bytes.

Reading checks every record: gzip CRC, version line, Content-Length, record end,
block and payload digests.  After a failed check the reader looks for the next
place where a gzip member or a version line starts a record that passes all
checks, goes on there, and logs the bytes in between as a quarantined gap.  A
member that holds several records, or breaks off, gives the whole records of
what could be unpacked.

Defined cases: a null or empty payload is a response of 0 bytes; a null url has
no WARC-Target-URI; payloads under ``least`` bytes are never revisits; rows with
the smallest page_id of a payload are all responses (repeated rows too); a null
page_id is no one's smallest and reads back as null; headers and payloads of any
length up to Spark's 2 GB for a value are written and read whole; an empty table
or archive has no records; zero bytes between members are padding, not a gap;
other columns of pages are not looked at, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._tables import discarded, new_path, removed, written

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100
#: Bytes of records (before packing) after which a task begins another file.
FILE_BYTES = 64 << 20
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_VERSION_LINE, _BLANK_LINE = re.compile(rb"WARC/1\.[01]\r?\n"), re.compile(rb"\r?\n\r?\n")
_PIECE = 1 << 16


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}#{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int, date: str) -> bytes:
    """One WARC record: a response, or a revisit of ``refers_to`` that keeps the HTTP head and leaves the payload out."""
    body = b"" if refers_to is not None else payload
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + body
    key = "" if page_id is None else str(page_id)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(str(refers_to), digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    if key:
        head.append(("X-Page-ID", key))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte: its length's high byte, else an empty member follows."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += pack.flush()
    return out


def revisits(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """A table of digests, to be deleted later, and (page_id, digest, refers_to) of the pages that revisit one with an equal payload.

    Counts are pre-aggregated and the join carries ids and digests only, so a payload that a third of all pages share
    weighs no more than its ids.
    """
    ids = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("p")).filter(F.octet_length("p") >= least)
    ids = written(ids.select("page_id", F.sha2("p", 256).alias("digest")), "warc-digests")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    return ids, ids.distinct().join(first, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))).select("page_id", "digest", F.col("first").alias("refers_to"))


def write(pages: DataFrame, path: str, gzip: bool = True, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write pages(page_id, url, html) as WARC files to the folder ``path``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    ids, again = revisits(pages, least)
    again = again.withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def build(batches):
        part, file, filled = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            out, files = [], []
            for page_id, url, data, digest, to, size in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], b["size"], strict=True):
                data = record(None if pd.isna(page_id) else int(page_id), url, bytes(data or b""), digest, None if pd.isna(to) else int(to), int(size), date)
                if filled + len(data) > file_bytes and filled:
                    file, filled = file + 1, 0
                filled += len(data)
                # the sink puts the last byte
                out.append((member(data) if gzip else data)[:-1])
                files.append(f"{part:06d}-{file:05d}")
            yield pd.DataFrame({"value": out, "file": files})

    # ids travel as text: pandas would turn a nullable long into a float
    rows = rows.select(F.col("page_id").cast("string"), "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", F.col("refers_to").cast("string"), F.octet_length("payload").alias("size"))
    made = rows.mapInPandas(build, "value binary, file string").select(F.col("value").cast("string").alias("value"), "file")
    made.write.partitionBy("file").option("lineSep", "\0" if gzip else "\n").mode("errorifexists").text(path)
    discarded(ids)


class Damaged(Exception):
    pass


def unpacked(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, where it ends, and what is wrong with it (then the content is what came before that)."""
    unpack, out, start, step = zlib.decompressobj(31), [], at, _PIECE
    while not unpack.eof:
        piece = data[at : at + step]
        if not len(piece):
            return b"".join(out), at, "gzip member is cut off"
        before = unpack.copy() if step > 1 else None
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), at, "gzip: " + str(e).split(":")[-1].strip()
            # once more, in smaller pieces, up to the very byte
            unpack, step = before, max(1, step // 64)
            continue
        at += len(piece)
    return b"".join(out), max(at - len(unpack.unused_data), start + 1), None


def parsed(data: memoryview | bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends, or Damaged."""
    found = _VERSION_LINE.match(data, at)
    if not found:
        raise Damaged("no version line")
    stop = _BLANK_LINE.search(data, at)
    if not stop:
        raise Damaged("header has no end")
    fields: dict[str, str] = {}
    for line in bytes(data[found.end() : stop.start()]).split(b"\n"):
        name, colon, value = line.rstrip(b"\r").decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        fields.setdefault(name.strip().lower(), value.strip())
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no Content-Length")
    begin = stop.end()
    end = begin + int(fields["content-length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise Damaged("record does not end where Content-Length says")
    block = bytes(data[begin:end])
    if (told := fields.get("warc-block-digest", "")).startswith("sha256:") and told[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields.get("warc-type") == "response" and digest and digest != hashlib.sha256(payload).hexdigest():
        raise Damaged("payload digest")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {"fields": fields, "payload": payload, "digest": digest, "size": int(length[1]) if length else len(payload)}, end + 4


def one(data: memoryview, at: int) -> tuple[list[dict], list[str], int]:
    """The records that start at ``at``, packed or plain, what else the member holds that is none, and where it ends."""
    if bytes(data[at : at + 3]) != b"\x1f\x8b\x08":
        found, end = parsed(data, at)
        return [found], [], end
    content, end, wrong = unpacked(data, at)
    if wrong is None and not content:
        return [], [], end
    try:
        found, used = parsed(content, 0)
        if wrong is None and used == len(content):
            return [found], [], end
    except Damaged as e:
        if not _VERSION_LINE.search(content, 1):
            raise Damaged(wrong or str(e)) from None
    inside = list(salvage(content, packed=False))
    records = [x for kind, _, _, x in inside if kind == "record"]
    if not records:
        raise Damaged(wrong or next(x for kind, _, _, x in inside if kind == "gap"))
    reasons = [x for kind, _, _, x in inside if kind == "gap"]
    return records, [*reasons, wrong] if wrong else reasons, end


def salvage(content: bytes, packed: bool = True) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, record) and ("gap", start, end, reason) of an archive's bytes, in order; they cover all but padding.

    Records and gaps inside a member of several records have the place of the member.  ``packed`` is false for content
    that has been unpacked.
    """
    data, at = memoryview(content), 0
    starts = _START if packed else _VERSION_LINE
    read_at = one if packed else lambda d, x: (lambda found, end: ([found], [], end))(*parsed(d, x))
    while at < len(content):
        if content[at] == 0 or content[at : at + 2] == b"\r\n":
            at += 1 if content[at] == 0 else 2
            continue
        try:
            found, wrong, end = read_at(data, at)
        except Damaged as e:
            start, reason = at, str(e)
            while True:
                hit = starts.search(content, at + 1)
                if not hit:
                    yield "gap", start, len(content), reason
                    return
                at = hit.start()
                try:
                    found, wrong, end = read_at(data, at)
                    break
                except Damaged:
                    continue
            yield "gap", start, at, reason
        for x in found:
            yield "record", at, end, x
        for x in wrong:
            yield "gap", at, end, x
        at = end


def damaged(content: bytes, found: list, hurt: Callable[[dict], bool]) -> bytes:
    """A copy of an archive in which a byte in the middle of each record that ``hurt`` picks is inverted; ``found``: its records and gaps."""
    out = bytearray(content)
    for kind, start, end, what in found:
        if kind == "record" and hurt(what["fields"]):
            out[(start + end) // 2] ^= 0xFF
    return bytes(out)


def read(spark: SparkSession, path: str, payloads: bool = True, hurt: Callable[[dict], bool] | None = None) -> DataFrame:
    """Everything in the WARC files under ``path``: kind (record or gap), archive, start, end, reason and the record's columns.

    A file is read by one task and must fit there; the writer keeps files small.  With ``hurt`` each file is read a second
    time, damaged in memory: ``recovered`` tells whether the record was found again then, ``quarantined`` whether a gap of
    the damaged file covers it.
    """
    schema = "kind string, archive string, start long, end long, reason string, record_type string, record_id string, target_uri string, page_id string, refers_to string, payload_bytes long, payload_digest string, payload binary, recovered boolean, quarantined boolean"

    def apply(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                content, out, again, gaps = bytes(content), [], {}, []
                found = salvage(content)
                if hurt:
                    found = [(k, a, e, x if k == "gap" or payloads else x | {"payload": None}) for k, a, e, x in found]
                    for kind, start, end, what in salvage(damaged(content, found, hurt)):
                        if kind == "gap":
                            gaps.append((start, end))
                        else:
                            again[start] = what["fields"].get("warc-record-id")
                begins = [start for start, _ in gaps]
                for kind, start, end, what in found:
                    if kind == "gap":
                        out.append((kind, archive, start, end, what, *[None] * 10))
                    else:
                        f, i = what["fields"], bisect.bisect_right(begins, start) - 1
                        judged = (again.get(start) == f.get("warc-record-id"), i >= 0 and gaps[i][1] >= end) if hurt else (None, None)
                        out.append((kind, archive, start, end, None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("x-page-id"), f.get("x-refers-to-page-id"), what["size"], what["digest"], what["payload"] if payloads else None, *judged))
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(~F.col("path").rlike(r"/[._][^/]*$"))
    return files.select("path", "content").mapInPandas(apply, schema)


def hurts(fields: dict) -> bool:
    """The fixed damage of ``round_trip``: records of page ids that leave 3 when divided by 10."""
    key = fields.get("x-page-id")
    return key is not None and int(key) % 10 == 3


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages to the shared folder and read the archives back, intact and damaged, payloads left out; the archives go."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least=least)
    back = written(read(pages.sparkSession, path, payloads=False, hurt=hurts).drop("payload"), "warc-read")
    removed(pages.sparkSession, path)
    return back
