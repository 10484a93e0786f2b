"""Language identification with a bit-sliced Bloom filter over character n-grams.

One filter serves all languages: each slot holds a bitmask of languages, and the
AND of an n-gram's k slots is the set of languages that contain it.  A text's
n-grams are looked up at once; the popcount of each language's bit, corrected
for that language's false-positive rate, decides.

Defined cases: a text that is null or holds no letter is ``und`` with score 0;
a text whose n-grams no language contains goes to the commonest learned
language with score 0; ties go to the commoner language, then by name; with
nothing to learn from, every text is ``und``; a very long text is looked up block
by block, whole; repeated rows are told alike, each once; an empty table has no
row; other columns come along only if ``keep`` names them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._tables import appended, held_out
from millrace.llm._text import blocks, char_table, code_points, mixed

#: Documents of each language that a fit draws (expected number, drawn by a hash of the id), and n-grams of each language that the model holds at most, the commonest.
FIT_DOCS, CAPACITY = 2_000, 100_000
#: N-grams of a language that a task holds before it adds them up.
HELD = 2_000_000


def grams(text: str | None, n: int):
    """Hashes of the n-grams of a text, in blocks: letters in lower case, any run of other characters a single space."""
    if not text:
        return
    table = char_table("letter")
    for piece in blocks(text.lower()):
        points = code_points(piece)
        letter = table[points]
        letter_or_first = letter | np.concatenate(([True], letter[:-1]))
        folded = np.where(letter, points, 32)[letter_or_first]
        folded = np.concatenate(([32], folded, [32])).astype(np.uint64)
        if not letter.any() or len(folded) < n:
            continue
        value = np.zeros(len(folded) - n + 1, dtype=np.uint64)
        for j in range(n):
            value = value * np.uint64(0x100000001B3) + folded[j : j + len(value)]
        yield mixed(value)


@dataclass(frozen=True)
class BloomLanguages:
    """``slots[w]`` holds 64 languages' bits for each slot; the names are in order of frequency, then name."""

    names: tuple[str, ...]
    slots: tuple[np.ndarray, ...]
    hashes: int
    n: int

    @staticmethod
    def build(names: list[str], keys: np.ndarray, masks: list[np.ndarray], hashes: int = 3, bits: int = 16, n: int = 4) -> "BloomLanguages":
        size = 1 << max(10, int(np.ceil(np.log2(max(1, len(keys)) * bits))))
        kind = np.uint8 if len(names) <= 8 else np.uint64
        slots = []
        for mask in masks:
            word = np.zeros(size, dtype=kind)
            for at in BloomLanguages.places(keys, size, hashes):
                np.bitwise_or.at(word, at, mask.astype(kind))
            slots.append(word)
        return BloomLanguages(tuple(names), tuple(slots), hashes, n)

    @staticmethod
    def places(keys: np.ndarray, size: int, hashes: int):
        step = (keys >> np.uint64(40)) | np.uint64(1)
        for i in range(hashes):
            yield ((keys + step * np.uint64(i)) & np.uint64(size - 1)).astype(np.int64)

    def containing(self, keys: np.ndarray, word: int = 0) -> np.ndarray:
        """The bitmask of the languages that contain each n-gram."""
        slots, found = self.slots[word], None
        for at in self.places(keys, len(slots), self.hashes):
            found = slots[at] if found is None else found & slots[at]
        return found

    def false_positive(self) -> np.ndarray:
        fill = [np.count_nonzero(self.slots[i // 64] >> self.slots[0].dtype.type(i % 64) & self.slots[0].dtype.type(1)) / len(self.slots[0]) for i in range(len(self.names))]
        return np.minimum(np.array(fill) ** self.hashes, 0.99)

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """Each language's popcount, and the number of n-grams."""
        hits, total = np.zeros(len(self.names)), 0
        for keys in grams(text, self.n):
            total += len(keys)
            for w in range(len(self.slots)):
                found = self.containing(keys, w)
                here = range(64 * w, min(64 * w + 64, len(self.names)))
                if found.dtype == np.uint8:
                    seen = np.bincount(found, minlength=256)
                    hits += [seen[[m for m in range(256) if m >> i & 1]].sum() for i in here]
                else:
                    for i in here:
                        hits[i] += np.count_nonzero(found >> np.uint64(i % 64) & np.uint64(1))
        return hits, total

    def decide(self, text: str | None, fp: np.ndarray) -> tuple[str, float]:
        hits, total = self.counts(text)
        if not self.names or not text or (total == 0 and not char_table("letter")[code_points(text)].any()):
            return "und", 0.0
        real = np.maximum((hits - total * fp) / (1 - fp), 0)
        best = int(np.argmax(real))
        return self.names[best], float(real[best] / real.sum()) if real.sum() > 0 else 0.0


def fit(docs: DataFrame, n: int = 4, fit_docs: int = FIT_DOCS, capacity: int = CAPACITY, hashes: int = 3, bits: int = 16, least_docs: int = 3, share: float = 0.1) -> BloomLanguages:
    """Learn from docs(doc_id, text, lang): non-null lang, not held out, about ``fit_docs`` of each language.

    A language contains an n-gram if at least ``least_docs`` and one in 200 of its drawn documents hold it, and it is
    there at least ``share`` times as common as where it is commonest; stray foreign lines so set no bits.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not names:
        return BloomLanguages((), (np.zeros(1024, dtype=np.uint8),), hashes, n)
    chance = F.create_map(*[F.lit(x) for name in names for x in (name, int(min(1.0, fit_docs / sizes[name]) * (1 << 30)))])
    drawn = usable.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30)) < chance[F.col("lang")])

    def tally(batches):
        seen: dict[str, list] = {}
        held: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                keys = [*grams(text, n)]
                if keys:
                    seen.setdefault(lang, []).append(np.unique(np.concatenate(keys)))
                    held[lang] = held.get(lang, 0) + len(seen[lang][-1])
                # whatever the number of languages, no more than this is held
                while sum(held.values()) >= HELD:
                    most = max(held, key=held.get)
                    held.pop(most)
                    yield flat(most, seen.pop(most))
        for lang, own in seen.items():
            yield flat(lang, own)

    def flat(lang, own):
        keys, docs_with = np.unique(np.concatenate(own), return_counts=True)
        return pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "docs": docs_with})

    table = drawn.mapInPandas(tally, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    at = {x: i for i, x in enumerate(names)}
    drawn_of = F.create_map(*[F.lit(x) for name in names for x in (name, float(min(sizes[name], fit_docs)))])
    rate = F.col("docs") / drawn_of[F.col("lang")]
    table = table.withColumn("rate", rate).filter((F.col("docs") >= F.least(F.lit(least_docs), F.ceil(drawn_of[F.col("lang")] / 2))) & (F.col("rate") >= 0.005))
    # a bound for each language, so that further languages push nothing out
    table = table.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))).filter(F.col("nth") <= capacity)
    table = table.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("in"))
    model = table.select("gram", F.filter("in", lambda x: x["rate"] >= F.col("top") * share)["lang"].alias("langs")).orderBy("gram").collect()
    keys = np.array([r["gram"] for r in model], dtype=np.int64).view(np.uint64)
    masks = [np.zeros(len(keys), dtype=np.uint64) for _ in range(-(-len(names) // 64))]
    for i, r in enumerate(model):
        for lang in r["langs"]:
            masks[at[lang] // 64][i] |= np.uint64(1 << (at[lang] % 64))
    return BloomLanguages.build(names, keys, masks, hashes, bits, n)


def predict(docs: DataFrame, model: BloomLanguages, keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` of every row's whole text, beside the columns in ``keep``."""

    def of(texts):
        fp = model.false_positive() if model.names else np.zeros(0)
        found = [model.decide(t, fp) for t in texts]
        return [[x for x, _ in found], [x for _, x in found]]

    return appended(docs, ["doc_id"] if keep is None else keep, "lang_pred string, score double", of)
