"""Benchmark decontamination: BM25 over the test items, every training passage a query, block-max WAND.

The index holds the test items.  Every document is cut into overlapping windows
of words, each at least twice as long as the longest item, and each window
queries the index with its distinct words for all items that reach a share
``reach`` of the score the item itself would get.  Weights are divided by the
item's threshold, so one number, 1, is everyone's bar.  An item's heaviest words
are its essential ones: what the others can add is a bound known beforehand, so
a batch of windows is first held against essential words alone, and windows that
could still reach 1 for some item are searched with block-max WAND over all
words.  Items found are verified by the word trigrams of their question and of
their answer in the window.

Items are taken in indexes of a bounded number, one after the other, so neither
the driver nor a task holds more than one of them; all weigh words by all items
(document frequencies are counted on the cluster).  A benchmark of several
indexes costs one pass over the documents for each.

Defined cases: null and empty texts have no window and no row; an item without
words is never found; equal items are found each under its own id, and items of
one id each; repeated documents are searched each, those with a null id too; of
windows of equal score and shares the first counts; a very long text is cut into
windows and searched whole, in batches of its own; an empty benchmark gives no
rows and leaves all documents; other columns are not looked at by ``leaks`` and
come along untouched in ``clean``, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._tables import discarded, filtered, written
from millrace.llm._text import shingles, word_hashes

#: BM25's constants, the share of an item's own score that counts, the share of question and answer trigrams, items to an index.
K1, B, REACH, OVERLAP, SHARD_ITEMS = 1.2, 0.75, 0.6, 0.5, 4_096
#: Share of an item's own score that its essential words make up, postings to a block of a posting list, words handled at once, slack for rounding.
ESSENTIAL, POSTINGS, BATCH_WORDS, EPS = 0.7, 4, 1 << 19, 1e-6


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence, the last third of its words."""
    text = text.strip()
    cut = [m.end() for m in re.finditer(r"[.?!:]\s+", text)]
    if cut:
        return text[: cut[-1]], text[cut[-1] :]
    words = text.split(" ")
    at = len(words) - len(words) // 3
    return " ".join(words[:at]), " ".join(words[at:])


@dataclass(frozen=True)
class Statistics:
    """What BM25 and the windows take from all items, however many indexes hold them; of the words, those of one index do."""

    items: int
    vocab: np.ndarray  # sorted word hashes
    df: np.ndarray  # items that hold each word
    mean: float  # words to an item
    longest: int

    @staticmethod
    def of(texts: Iterable[str]) -> "Statistics":
        """Those of a few texts, without Spark."""
        words = [word_hashes(x) for x in texts]
        vocab, df = np.unique(np.concatenate([np.unique(w) for w in words] or [np.empty(0, dtype=np.uint64)]), return_counts=True)
        sizes = [len(w) for w in words]
        return Statistics(len(words), vocab, df, sum(sizes) / max(len(words), 1), max(sizes, default=0))


@dataclass(frozen=True)
class Bm25Index:
    ids: list
    vocab: np.ndarray  # sorted word hashes
    start: np.ndarray  # of each word's postings
    item: np.ndarray  # items, ascending within a word
    weight: np.ndarray  # BM25 weight over the item's threshold
    top: np.ndarray  # largest weight of a word
    block_top: np.ndarray  # largest weight in each POSTINGS postings of a word, at the first of them
    essential: np.ndarray  # [word] start of its essential postings
    essential_item: np.ndarray
    essential_weight: np.ndarray
    rest: np.ndarray  # [item] what its other words can add
    parts: list  # question and answer trigrams of each item, with the n they were made with
    half: int  # words between windows
    reach: float

    @staticmethod
    def build(items: list[tuple], reach: float = REACH, of: Statistics | None = None) -> "Bm25Index":
        """items: (id, text, question, answer); ids may be any type.  ``of``: all items, where these are a part of them."""
        of = of or Statistics.of(x[1] for x in items)
        words = [np.unique(word_hashes(x[1]), return_counts=True) for x in items]
        lengths = np.array([c.sum() for _, c in words], dtype=float)
        vocab = np.unique(np.concatenate([w for w, _ in words])) if items else np.empty(0, dtype=np.uint64)
        term = [np.searchsorted(vocab, w) for w, _ in words]
        df = of.df[np.searchsorted(of.vocab, vocab)]
        idf = np.log(1 + (of.items - df + 0.5) / (df + 0.5))
        # neighbours in the index share their commonest words, so that blocks hold one language and bounds stay low
        common = [tuple(sorted(t, key=lambda x: -df[x])[:3]) for t in term]
        order = sorted(range(len(items)), key=lambda i: (common[i], i))
        rows, ids, parts = [], [], []
        for at, i in enumerate(order):
            tf, mean = words[i][1], max(of.mean, 1)
            w = idf[term[i]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean))
            if len(w):
                rows.append(np.stack([term[i], np.full(len(w), at), w / (reach * w.sum())]))
            ids.append(items[i][0])
            halves = [word_hashes(x) for x in items[i][2:4]]
            parts.append([(n := max(1, min(3, len(h))), shingles(h, n)) for h in halves if len(h)])
        flat = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0))
        flat = flat[:, np.lexsort((flat[1], flat[0]))]
        t, item, weight = flat[0].astype(np.int64), flat[1].astype(np.int64), flat[2]
        start = np.searchsorted(t, np.arange(len(vocab) + 1))
        first = start[t] + (np.arange(len(t)) - start[t]) // POSTINGS * POSTINGS
        block_top, top = np.zeros(len(t)), np.zeros(len(vocab))
        np.maximum.at(block_top, first, weight)
        np.maximum.at(top, t, weight)
        # an item's words from the heaviest on, as long as those before make up less than the essential share
        heavy = np.lexsort((-weight, item))
        mass = np.cumsum(weight[heavy])
        begins = np.searchsorted(item[heavy], np.arange(len(items) + 1))
        before = mass - weight[heavy] - np.concatenate(([0.0], mass))[begins[item[heavy]]]
        chosen = np.zeros(len(t), dtype=bool)
        chosen[heavy[before < ESSENTIAL / reach]] = True
        rest = np.bincount(item[~chosen], weights=weight[~chosen], minlength=len(items))
        essential = np.searchsorted(t[chosen], np.arange(len(vocab) + 1))
        return Bm25Index(ids, vocab, start, item, weight, top, block_top, essential, item[chosen], weight[chosen], rest, parts, max(32, of.longest), reach)

    def terms(self, words: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, -1 for others."""
        if not len(self.vocab):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, -1)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score over threshold) of all items that reach it, for distinct terms."""
        start, item, weight = self.start, self.item, self.weight
        # a cursor: item it stands at, posting, end of postings, term
        cursors = [[int(item[start[t]]), int(start[t]), int(start[t + 1]), t] for t in terms]
        out = []

        def move(c, to):
            c[1] += int(np.searchsorted(item[c[1] : c[2]], to))
            c[0] = int(item[c[1]]) if c[1] < c[2] else -1

        def block(c, at):
            """Bound and last item of the block of c's list that holds ``at`` or what follows it."""
            p = c[1] + int(np.searchsorted(item[c[1] : c[2]], at))
            if p >= c[2]:
                return 0.0, len(self.ids)
            first = start[c[3]] + (p - start[c[3]]) // POSTINGS * POSTINGS
            return self.block_top[first], int(item[min(first + POSTINGS, c[2]) - 1])

        while True:
            cursors = sorted((c for c in cursors if c[0] >= 0), key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.top[c[3]]
                if bound >= 1 - EPS:
                    pivot = i
                    break
            if pivot < 0:
                return out
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            shallow = [block(c, at) for c in cursors[: pivot + 1]]
            if sum(x for x, _ in shallow) >= 1 - EPS:
                if cursors[0][0] == at:
                    score = sum(weight[c[1]] for c in cursors[: pivot + 1])
                    if score >= 1 - EPS:
                        out.append((at, float(score)))
                    for c in cursors[: pivot + 1]:
                        move(c, at + 1)
                else:
                    for c in cursors[:pivot]:
                        if c[0] < at:
                            move(c, at)
            else:
                # no item before the end of the nearest block can reach the bar
                to = min([last + 1 for _, last in shallow] + [c[0] for c in cursors[pivot + 1 : pivot + 2]])
                for c in cursors[: pivot + 1]:
                    if c[0] < to:
                        move(c, max(to, at + 1))

    def verified(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's trigrams that a window holds; a part without words is held."""
        shares = []
        for n, part in self.parts[item]:
            shares.append(float(np.isin(part, shingles(words, n)).mean()) if len(words) >= n else 0.0)
        return (shares[0], shares[-1]) if shares else (0.0, 0.0)

    def candidates(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(text, window) of the windows whose essential words leave some item within reach."""
        sizes = np.array([len(x) for x in texts])
        term = self.terms(np.concatenate(texts))
        spans = np.diff(self.essential)
        where = np.flatnonzero((term >= 0) & (spans[np.maximum(term, 0)] > 0)) if len(self.vocab) else np.empty(0, dtype=np.int64)
        ends = np.cumsum(sizes)
        doc, term = np.searchsorted(ends, where, "right"), term[where]
        at = where - (ends - sizes)[doc]
        windows = np.maximum(1, -(-sizes // self.half) - 1)
        base = np.cumsum(windows) - windows
        # a window counts a word once: where its last occurrence lies before the window
        key = doc * len(self.vocab) + term
        order = np.argsort(key, kind="stable")
        last = np.full(len(key), -1)
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        last[order[same + 1]] = at[order[same]]
        own = at // self.half
        here = (own < windows[doc]) & (last < own * self.half)
        before = (own > 0) & (last < (own - 1) * self.half)
        window = np.concatenate((base[doc[here]] + own[here], base[doc[before]] + own[before] - 1))
        term = np.concatenate((term[here], term[before]))
        # one row for each window and item that a word is essential to
        posting = np.repeat(self.essential[term] - np.concatenate(([0], np.cumsum(spans[term])[:-1])), spans[term]) + np.arange(int(spans[term].sum())) if len(term) else np.empty(0, dtype=np.int64)
        pair = np.repeat(window, spans[term]) * len(self.ids) + self.essential_item[posting]
        pair, inverse = np.unique(pair, return_inverse=True)
        score = np.bincount(inverse, weights=self.essential_weight[posting], minlength=len(pair)) + self.rest[pair % max(len(self.ids), 1)]
        hit = np.unique(pair[score >= 1 - EPS] // max(len(self.ids), 1))
        text = np.searchsorted(base, hit, "right") - 1
        return text, hit - base[text]

    def leaks(self, texts: list[np.ndarray], overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question share, answer share, first word of the window), the best window of each."""
        best: dict[tuple[int, int], tuple] = {}
        for text, window in zip(*self.candidates(texts), strict=True):
            first = int(window) * self.half
            words = texts[text][first : first + 2 * self.half]
            terms = np.unique(self.terms(words))
            for item, score in self.search([int(t) for t in terms if t >= 0]):
                q, a = self.verified(item, words)
                if q >= overlap and a >= overlap:
                    # rounded, so that of windows that hold the same words the first is the best
                    found = (round(score * self.reach, 9), q, a, -first)
                    best[int(text), item] = max(best.get((int(text), item), found), found)
        return [(t, i, s, q, a, -f) for (t, i), (s, q, a, f) in sorted(best.items())]


def indexes(items: DataFrame, reach: float = REACH, shard_items: int = SHARD_ITEMS) -> Iterator[Bm25Index]:
    """Indexes over items(item_id, text[, question, answer]), ``shard_items`` items in each, made one at a time.

    Words, their document frequencies and the items' sizes are worked out on the cluster; the driver sees the rows of one
    index.  No result depends on who shares an index.
    """
    halves = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ("question", "answer")]
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text", *halves)

    def described(batches):
        for b in batches:
            out = []
            for item_id, text, q, a in zip(b["item_id"], b["text"], b["question"], b["answer"], strict=True):
                if not (q or a):
                    q, a = question_answer(text or "")
                text, q, a = text or f"{q or ''} {a or ''}", q or "", a or ""
                words = word_hashes(text)
                out.append((item_id, text, q, a, np.unique(words).view(np.int64), len(words)))
            yield pd.DataFrame(out, columns=["item_id", "text", "question", "answer", "words", "size"])

    rows = items.mapInPandas(described, "item_id string, text string, question string, answer string, words array<long>, size long")
    rows = written(rows.withColumn("nth", F.monotonically_increasing_id()), "items")
    n, total, longest = rows.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    df = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    known = rows.select("nth", F.explode("words").alias("word")).join(df, "word").groupBy("nth").agg(F.collect_list(F.struct("word", "df")).alias("dfs"))
    ready = rows.drop("words").join(known, "nth", "left").orderBy(F.col("item_id").cast(kind), "text", "nth")
    ready = written(ready.withColumn("nth", F.monotonically_increasing_id()), "item-words")
    # a row's number is its partition of the sort and its place there, so the partitions' sizes tell where an index begins
    sizes = sorted((r["part"], r["count"]) for r in ready.groupBy(F.shiftright("nth", 33).alias("part")).count().collect())
    ends = np.cumsum([size for _, size in sizes], dtype=np.int64)

    def number(at: int) -> int:
        i = int(np.searchsorted(ends, at, "right"))
        return (sizes[i][0] << 33) + at - int(ends[i]) + sizes[i][1]

    def built(shard: list) -> Bm25Index:
        words = {w: c for r in shard for w, c in r["dfs"] or ()}
        vocab = np.array(list(words), dtype=np.int64).view(np.uint64)
        order = np.argsort(vocab)
        of = Statistics(n, vocab[order], np.array(list(words.values()), dtype=np.int64)[order], total / n, longest)
        return Bm25Index.build([(r["item_id"], r["text"], r["question"], r["answer"]) for r in shard], reach, of)

    # one job for an index: an iterator over partitions is a job for each, and what jobs leave behind fills the driver
    for low, high in itertools.pairwise([*(number(at) for at in range(0, n, shard_items)), 1 << 62]):
        yield built(sorted(ready.filter((F.col("nth") >= low) & (F.col("nth") < high)).collect(), key=lambda r: r["nth"]))
    discarded(rows, ready)


def _batches(texts: list) -> list[tuple[int, list[np.ndarray]]]:
    """Word arrays in lists of about BATCH_WORDS words, each with the number of its first text."""
    out, first, have, size = [], 0, [], 0
    for i, text in enumerate(texts):
        have.append(word_hashes(text))
        size += len(have[-1])
        if size >= BATCH_WORDS:
            out.append((first, have))
            first, have, size = i + 1, [], 0
    return [*out, (first, have)] if have else out


def _found(docs: DataFrame, index: Bm25Index, overlap: float) -> DataFrame:
    """The rows of ``leaks`` for one index; ids travel as text, since pandas would turn nullable numbers into floats."""
    schema = "doc_id string, item_id string, score double, question_overlap double, answer_overlap double, first_word long"

    def apply(batches):
        for b in batches:
            ids = list(b["doc_id"])
            for first, words in _batches(list(b["text"])):
                rows = [(ids[first + t], index.ids[i], *rest) for t, i, *rest in index.leaks(words, overlap)]
                if rows:
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(apply, schema)


def leaks(docs: DataFrame, items: DataFrame, reach: float = REACH, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of every document and item it holds."""
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": items.schema["item_id"].dataType}
    parts: list[DataFrame] = []
    last = None
    for index in indexes(items, reach, shard_items):
        if last is not None:
            # the plan, and with it the driver, holds one index at a time
            parts.append(written(_found(docs, last, overlap), "leaks"))
        last = index
    out = _found(docs, last if last is not None else Bm25Index.build([], reach), overlap)
    for part in parts:
        out = out.unionByName(part)
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def clean(docs: DataFrame, items: DataFrame, reach: float = REACH, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The documents, all columns, that hold no item."""
    some = list(itertools.islice(indexes(items, reach, shard_items), 2))
    if len(some) > 1:
        # whether a text leaks depends on the text alone
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        found = leaks(docs.select(digest.alias("doc_id"), "text"), items, reach, overlap, shard_items)
        found = written(found.select(F.col("doc_id").alias("_digest")).distinct(), "leaking")
        return docs.join(found, digest == F.col("_digest"), "left_anti")

    def keep(texts):
        bad = {first + t for first, words in _batches(texts) for index in some for t, *_ in index.leaks(words, overlap)}
        return [i not in bad for i in range(len(texts))]

    return filtered(docs, keep)
