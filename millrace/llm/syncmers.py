"""Document fingerprints from closed syncmers, compared by position.

A k-mer of code points is an anchor if the smallest hash among its s-mers is
that of its first or its last s-mer.  The choice looks at the k-mer alone, so an
anchor survives every edit outside it, and any k - s + 1 consecutive k-mers hold
at least one.  Two fingerprints are matched anchor by anchor; pairs count where
enough of them agree on the shift between the two texts.

Defined cases: null is the empty text, whose fingerprint is empty; a text
shorter than k has one anchor, the whole text; equal texts have equal
fingerprints and likeness 1, also two empty ones; an empty text is unlike any
other (0).  Rows with one id are ordered by a hash of their text, null ids come
last in descending order; the only document of a table is its own neighbour;
repeated rows are neighbours of each other.  A very long text is hashed block by
block, whole.  An empty table has no row; other columns are not looked at,
whatever their names.  Ids are whole numbers.  A fingerprint holds five bytes for
each anchor (about a fourteenth of the k-mers), base64: some half a byte for each
character of a text.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import BLOCK, code_points, mixed

K, S = 32, 8
#: Rows to a range of ids, and ranges at most.
RANGE_ROWS, RANGES = 1_000, 4_096
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _window_hash(points: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every window of ``width`` code points, by doubling."""
    value, have, base = points.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, done, shift = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                # put this power of two in front of what has been collected
                out = value if out is None else value[: len(value) - done] * shift + out[have:][: len(value) - done]
                out = out[: len(points) - width + 1] if have * 2 > width else out
                shift, done = shift * base, done + have
            if have * 2 > width:
                return out
            value = value[:-have] * base + value[have:]
            base, have = base * base, have * 2


def _anchors_block(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    inner = mixed(_window_hash(points, s))
    span = k - s + 1
    low, have = inner, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    last = len(points) - k + 1
    low = np.minimum(low[:last], low[span - have :][:last])
    at = np.flatnonzero((inner[:last] == low) | (inner[span - 1 :][:last] == low))
    return at, mixed(_window_hash(points, k)[at])


@dataclass(frozen=True)
class Fingerprint:
    at: np.ndarray
    value: np.ndarray

    def __str__(self) -> str:
        """base64 of five bytes for each anchor: the step from the one before, then 32 bits of its hash."""
        if not len(self.at):
            return ""
        packed = np.empty(len(self.at), dtype=[("step", "u1"), ("value", "<u4")])
        packed["step"] = np.minimum(np.diff(self.at, prepend=0), 255)
        packed["value"] = self.value & np.uint64(0xFFFFFFFF)
        return base64.b64encode(packed.tobytes()).decode("ascii")

    def keys(self) -> np.ndarray:
        """A key for the i-th anchor of each hash, in order of the anchors."""
        order = np.argsort(self.value, kind="stable")
        ranked = self.value[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        nth = np.arange(len(ranked)) - np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
        out = np.empty_like(ranked)
        out[order] = mixed(ranked + nth.astype(np.uint64) * _BASE)
        return out


def anchors(points: np.ndarray, k: int = K, s: int = S, whole: bool = True) -> Fingerprint:
    """The anchors of a text, block by block; ``whole``: a text shorter than k is one anchor."""
    if len(points) < k:
        if not whole or not len(points):
            return Fingerprint(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))
        return Fingerprint(np.zeros(1, dtype=np.int64), mixed(_window_hash(points, len(points))))
    at, value = [], []
    for start in range(0, len(points) - k + 1, BLOCK):
        a, v = _anchors_block(points[start : start + BLOCK + k - 1], k, s)
        at.append(a + start)
        value.append(v)
    return Fingerprint(np.concatenate(at), np.concatenate(value))


def likeness(a: Fingerprint, b: Fingerprint, drift: int = 64) -> float:
    """Share of the anchors of both texts that match in position (twice the matches over all anchors).

    Matches are pairs of equal anchors whose shift is shared, to within ``drift`` code points, by at least three pairs
    (by all anchors of a shorter text).
    """
    if not len(a.at) or not len(b.at):
        return float(len(a.at) == len(b.at))
    _, i, j = np.intersect1d(a.keys(), b.keys(), assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    shift = np.sort(a.at[i] - b.at[j])
    near = np.searchsorted(shift, shift + drift, "right") - np.searchsorted(shift, shift - drift, "left")
    return 2.0 * np.count_nonzero(near >= min(3, len(a.at), len(b.at))) / (len(a.at) + len(b.at))


def edited(own: Fingerprint, points: np.ndarray, other: np.ndarray, k: int = K, s: int = S) -> Fingerprint:
    """The fingerprint of ``points`` with its last third replaced by the head of ``other``.

    Anchors are context-free: those of the part that stays are taken over, and only k-mers that reach past it are looked at.
    """
    third = len(points) // 3
    cut = len(points) - third
    head = other[:third]
    if cut + len(head) < k or len(points) < k:
        return anchors(np.concatenate((points[:cut], head)), k, s)
    stay = np.searchsorted(own.at, cut - k, "right")
    start = max(0, cut - k + 1)
    new = anchors(np.concatenate((points[start:cut], head)), k, s, whole=False)
    return Fingerprint(np.concatenate((own.at[:stay], new.at + start)), np.concatenate((own.value[:stay], new.value)))


def _literal(values: list, kind: str) -> "F.Column":
    """An array constant of any length: one string that the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def beside_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs(doc_id long, text) dealt out in ranges of ids, each sorted by descending id and followed by its next document.

    Columns: part, halo (true: not of this range, only the neighbour of its last row), doc_id, text.
    The driver sees two ids for each range; texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    parts = max(1, min(RANGES, -(-n // range_rows)))
    cuts = sorted(set(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cuts = [int(x) for x in cuts]
    if cuts:
        # two levels, so that a row is compared with few cuts
        wide = max(1, int(len(cuts) ** 0.5))
        coarse = F.size(F.filter(_literal(cuts[::wide], "bigint"), lambda x: x <= F.col("doc_id")))
        fine = F.size(F.filter(F.slice(_literal(cuts, "bigint"), F.greatest(coarse - 1, F.lit(0)) * wide + 1, F.lit(wide)), lambda x: x <= F.col("doc_id")))
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(coarse - 1, F.lit(0)) * wide + fine)
    else:
        part = F.lit(0)
    placed = docs.withColumn("part", part)
    ends = {r["part"]: r["top"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(ends)
    # the first row of a range follows the last row of the range above it
    goes = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    top = _literal([ends.get(p) if ends.get(p) is not None else -(1 << 63) for p in range(len(cuts) + 1)], "bigint")
    to = _literal([goes.get(p, -1) for p in range(len(cuts) + 1)], "int")
    is_top = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.get(top, F.col("part"))
    own = F.struct(F.col("part").cast("int").alias("part"), F.lit(False).alias("halo"))
    extra = F.struct(F.get(to, F.col("part")).alias("part"), F.lit(True).alias("halo"))
    spread = placed.select(F.explode(F.when(is_top, F.array(own, extra)).otherwise(F.array(own))).alias("p"), "doc_id", "text").select("p.*", "doc_id", "text")
    return spread.repartition("part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Per row of docs(doc_id, text): its fingerprint, that of its edited text, and the likeness of both and of the next document."""

    def apply(batches):
        waiting, part = None, None
        for b in batches:
            out = []
            for p, halo, doc_id, text in zip(b["part"], b["halo"], b["doc_id"], b["text"], strict=True):
                if p != part:
                    waiting, part = None, p
                elif waiting is None:
                    continue  # further rows with the id of the neighbour
                text = text or ""
                points = code_points(text)
                own = anchors(points, k, s)
                if waiting is not None:
                    out.append(compared(*waiting, text, points, own))
                waiting = None if halo else (doc_id, text, points, own)
            yield pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})

    def compared(doc_id, text, points, own, other, other_points, other_own):
        third = len(points) // 3
        changed = text[: len(text) - third] + other[:third]
        new = edited(own, points, other_points, k, s)
        return (None if pd.isna(doc_id) else int(doc_id), len(points), hashlib.sha256(changed.encode("utf-8")).hexdigest(), str(own), str(new), likeness(own, new), likeness(own, other_own))

    return beside_next(docs).mapInPandas(apply, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
