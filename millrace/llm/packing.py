"""Variable-capacity best-fit packing of documents into training sequences.

Best-fit decreasing looks at lengths only, so it runs on the histogram of
lengths: bins in the same state form a run of consecutive numbers, and placing
the pieces of one length splits a few runs.  What comes out is the packing that
item-by-item best fit would give to the whole table at once; the driver's work
and memory depend on the number of distinct lengths (at most the largest
permitted one), not on the number of documents.  Executors then rank the pieces
of each length and look their bins up.

Several sequence lengths are permitted.  A piece that fits no open bin opens the
size of least cost for the content it can expect; in the end each bin shrinks to
the smallest size that holds its content.

Defined cases: texts longer than the largest size are cut into full pieces and a
remainder; null and empty texts are one piece of 0 tokens in no bin (null); ties
between pieces of one length go by id, piece, then a hash of the text; repeated
rows are separate pieces; an empty table has no rows; other columns are not
looked at, whatever their names.  Lengths are counted in words and single marks,
as ``token_count`` says, not in the tokens of any model's vocabulary.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._tables import written
from millrace.llm._text import blocks, char_table, code_points, runs

SIZES = (512, 1024, 2048, 4096, 8192)
#: Pieces in a ranking group, about.
GROUP_ROWS = 2_000


def default_cost(size: int) -> float:
    """Tokens plus a fixed price for each sequence."""
    return 64.0 + size


@functools.cache
def _marks() -> np.ndarray:
    space = np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)
    return ~(space | char_table("word"))


def token_count(text: str | None) -> int:
    """Words (runs of letters and digits) and single other marks."""
    total = 0
    for piece in blocks(text or ""):
        points = code_points(piece)
        total += len(runs(char_table("word")[points])[0]) + int(np.count_nonzero(_marks()[points]))
    return total


@dataclass(frozen=True)
class Plan:
    """Placements by length and rank, and the final size of every run of bins."""

    length: np.ndarray  # of each placement, ascending with ``rank``
    rank: np.ndarray  # of its first piece among those of the length
    each: np.ndarray  # pieces in each bin
    bin: np.ndarray  # first bin
    offset: np.ndarray  # of the first piece in a bin
    run: np.ndarray  # first bin of each run, ascending
    size: np.ndarray  # of the run's bins
    bins: int

    def lookup(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, its size, and the piece's offset in it."""
        key = lambda n, r: n.astype(np.int64) << 44 | r
        at = np.searchsorted(key(self.length, self.rank), key(length, rank), "right") - 1
        past = rank - self.rank[at]
        found = self.bin[at] + past // self.each[at]
        return found, self.size[np.searchsorted(self.run, found, "right") - 1], self.offset[at] + past % self.each[at] * length


def opening(length: int, counts: dict[int, int], mass: np.ndarray, sizes: tuple[int, ...], cost: Callable[[int], float]) -> int:
    """The size of least cost for each token it can expect to hold.

    Expected are as many pieces of this length as exist and fit, and in the rest shorter pieces, as far as there are any
    that fit it (``mass``: tokens in pieces up to each length).  Ties go to the smaller size.
    """

    def price(size):
        own = min(size // length, counts[length])
        rest = size - own * length
        return cost(size) / (own * length + min(rest, int(mass[min(rest, length - 1)])))

    return min((s for s in sizes if s >= length), key=lambda s: (price(s), s))


def plan(counts: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = default_cost) -> Plan:
    """Best-fit decreasing over a histogram {length: pieces}; lengths from 1 to the largest size."""
    sizes = tuple(sorted(sizes))
    mass = np.zeros(sizes[-1] + 1, dtype=np.int64)
    for n, c in counts.items():
        mass[n] = n * c
    mass = np.cumsum(mass)
    # runs of open bins by free room: room -> [(first bin, bins, used)], the lowest bin last
    room: dict[int, list[tuple[int, int, int]]] = {}
    free: list[int] = []  # the keys of ``room``, ascending
    places: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(left: int, run: tuple[int, int, int]) -> None:
        if left not in room:
            room[left] = []
            free.insert(int(np.searchsorted(free, left)), left)
        room[left].append(run)
        room[left].sort(reverse=True)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            i = int(np.searchsorted(free, length))
            if i == len(free):
                size = opening(length, counts, mass, sizes, cost)
                need = -(-todo // (size // length))
                put(size, (bins, need, 0))
                bins += need
                continue
            left = free[i]
            first, number, used = room[left].pop()
            if not room[left]:
                del room[left]
                free.pop(i)
            each = left // length
            full = min(number, todo // each)
            if full:
                places.append((length, rank, each, first, used))
                rank, todo = rank + full * each, todo - full * each
                put(left - each * length, (first, full, used + each * length))
            if full < number and 0 < todo < each:
                places.append((length, rank, todo, first + full, used))
                put(left - todo * length, (first + full, 1, used + todo * length))
                todo, full = 0, full + 1
            if full < number:
                put(left, (first + full, number - full, used))
    ends = sorted((first, used) for x in room.values() for first, _, used in x)
    places.sort()
    column = lambda rows, i: np.array([r[i] for r in rows], dtype=np.int64)
    fits = np.array(sizes)[np.searchsorted(sizes, column(ends, 1))] if ends else np.empty(0, dtype=np.int64)
    return Plan(*(column(places, i) for i in range(5)), column(ends, 0), fits, bins)


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = default_cost, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start_token, n_tokens, bin_id, bin_size, bin_offset."""
    most = max(sizes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tie": b["tie"], "tokens": [token_count(t) for t in b["text"]]})

    lengths = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInPandas(measure, "doc_id string, tie long, tokens long")
    lengths = lengths.select(F.col("doc_id").cast(kind).alias("doc_id"), "tie", "tokens")
    last = F.greatest(F.ceil(F.col("tokens") / most).cast("int") - 1, F.lit(0))
    pieces = lengths.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece")).withColumn("start_token", F.col("piece").cast("long") * most)
    pieces = pieces.select("doc_id", "tie", "piece", "start_token", F.least(F.col("tokens") - F.col("start_token"), F.lit(most)).alias("n_tokens"))
    pieces = written(pieces, "pieces")
    counts = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    total, _ = sum(counts.values()), counts.pop(0, 0)
    made = plan(counts, sizes, cost)
    # ranks in two steps: a length that very many pieces share is spread over groups
    groups = max(1, -(-total // group_rows))
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(groups)))
    before = pieces.groupBy("n_tokens", "g").count().select("n_tokens", "g", (F.sum("count").over(Window.partitionBy("n_tokens").orderBy("g")) - F.col("count")).alias("before"))
    within = Window.partitionBy("n_tokens", "g").orderBy("doc_id", "piece", "tie")
    ranked = pieces.withColumn("nth", F.row_number().over(within)).join(before, ["n_tokens", "g"])
    ranked = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start_token", "n_tokens", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def assign(batches):
        for b in batches:
            n, some = b["n_tokens"].to_numpy(), b["n_tokens"].to_numpy() > 0
            out = {k: pd.array([pd.NA] * len(b), dtype="Int64") for k in ("bin_id", "bin_size", "bin_offset")}
            if some.any():
                for k, v in zip(out, made.lookup(n[some], b["rank"].to_numpy()[some]), strict=True):
                    out[k][some] = v
            yield b[["doc_id", "piece", "start_token", "n_tokens"]].assign(**out)

    schema = "doc_id string, piece int, start_token long, n_tokens long, bin_id long, bin_size long, bin_offset long"
    return ranked.mapInPandas(assign, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
