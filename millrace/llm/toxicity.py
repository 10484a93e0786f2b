"""Toxicity by classifier chains.

Categories are predicted one after another.  Each has a logistic model over the
presence of words and word heads and document statistics; a later model also sees the probabilities of
the categories before it.  In training those come from models that did not see
the row (out-of-fold), in scoring from the models of the chain.

Defined cases: null and empty texts have no words and are scored by the
intercepts and their statistics; a very long text is described whole; a null
label leaves its row out of that category; a category with no positive or no
negative row has that constant probability; words of equal chi-square are taken
in order of their hashes, equal probabilities stay on one side of a threshold;
an id that is labelled, or found, several times trains with each pair, within
the bound; repeated rows are scored alike; without labels all probabilities are
0; an empty table has no row; other columns come along only if ``keep`` names
them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._tables import appended, bounded_sample, discarded, written
from millrace.llm._text import word_hashes, word_heads
from millrace.llm.quality import STATISTICS, statistics

#: Labelled rows that a fit draws at most, words that the models know at most, folds of the out-of-fold predictions, and the chi-square that a word needs.
FIT_ROWS, WORDS, FOLDS, LEAST_CHI2 = 10_000, 512, 4, 24.0
#: Lengths of the heads of words that count as features beside the words.
HEADS = range(3, 9)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of a whole text, and the set of hashes of its words and word heads."""
    words = word_hashes(text)
    return statistics(text, words), np.union1d(words, word_heads(text, HEADS))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 50, memory: int = 8) -> np.ndarray:
    """L2-penalised logistic regression by L-BFGS; the last column is the intercept's."""
    weight = np.full(len(y), 1 / len(y))
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 0

    def at(w):
        z = (x @ w.astype(x.dtype)).astype(float)
        loss = weight @ (np.logaddexp(0, z) - y * z) + 0.5 * keep @ (w * w)
        return loss, x.T @ (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(x.dtype) + keep * w

    w = np.zeros(x.shape[1])
    loss, slope = at(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = slope.copy(), []
        for s, t, r in reversed(pairs):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * t
        if pairs:
            s, t, r = pairs[-1]
            q /= r * (t @ t)
        for (s, t, r), alpha in zip(pairs, reversed(alphas), strict=True):
            q += (alpha - r * (t @ q)) * s
        size, down = 1.0 if pairs else 1 / max(np.abs(slope).sum(), 1e-12), slope @ q
        while True:
            new = w - size * q
            new_loss, new_slope = at(new)
            if new_loss <= loss - 1e-4 * size * down or size < 1e-8:
                break
            size /= 2
        s, t = new - w, new_slope - slope
        if s @ t > 1e-12:
            pairs = [*pairs[1 - memory :], (s, t, 1 / (s @ t))]
        done = loss - new_loss < 1e-7
        w, loss, slope = new, new_loss, new_slope
        if done:
            break
    return w


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which a row counts as positive: of best F1 on out-of-fold predictions, midway to the next one below."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order] > 0)
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(hits[-1], 1))
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities stay together
    at = int(np.argmax(f1))
    below = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip(np.sqrt(p[at] * max(below, 1e-6)), 0.05, 0.95))


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    words: np.ndarray  # sorted hashes
    mean: np.ndarray
    scale: np.ndarray
    models: tuple[np.ndarray | float, ...]  # a float: a constant probability
    thresholds: tuple[float, ...] = ()

    def row(self, stats: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Dense features: standardised statistics, word presence, the intercept's 1 (probabilities are put in before it)."""
        out = np.zeros(len(self.mean) + len(self.words) + 1)
        out[: len(self.mean)] = np.clip((stats - self.mean) / self.scale, -4, 4) * 0.25
        if len(self.words):
            at = np.searchsorted(self.words, words)
            at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == words)]
            out[len(self.mean) + at] = 1
        out[-1] = 1
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        done = np.zeros((len(rows), 0))
        for model in self.models:
            p = np.full(len(rows), model) if isinstance(model, float) else 1 / (1 + np.exp(-np.clip(_chained(rows, done) @ model, -30, 30)))
            done = np.hstack([done, p[:, None]])
        return done


def _chained(rows: np.ndarray, done: np.ndarray) -> np.ndarray:
    return np.hstack([rows[:, :-1], done, rows[:, -1:]])


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], fit_rows: int = FIT_ROWS, words: int = WORDS, folds: int = FOLDS) -> Chain:
    """Learn the chain from labels(doc_id, one column of 0/1 for each category, in the order of the chain).

    ``fit_rows`` labelled rows at most are drawn by a hash of the id, so the labels that are broadcast, the words that
    are counted and the rows that reach the driver are bounded.
    """
    known = labels.select("doc_id", *[F.col(c).cast("double").alias(c) for c in categories]).filter(F.col("doc_id").isNotNull())
    known = bounded_sample(known, F.col("doc_id"), fit_rows)

    def describe(batches):
        for b in batches:
            own = [features(t) for t in b["text"]]
            yield b[["doc_id", *categories]].assign(stats=[s for s, _ in own], words=[w.view(np.int64) for _, w in own])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in categories) + ", stats array<double>, words array<long>"
    made = written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInPandas(describe, schema), "toxicity-fit")
    # also where very many documents share a labelled id
    rows = bounded_sample(made, F.struct("doc_id", "stats"), fit_rows)
    totals = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in categories], *[F.sum(c).alias(f"p_{c}") for c in categories]).first()
    n, d = totals["n"], len(STATISTICS)
    if not n:
        discarded(made)
        return Chain(tuple(categories), np.empty(0, dtype=np.uint64), np.zeros(d), np.ones(d), (0.0,) * len(categories), (0.5,) * len(categories))
    # chi-square of word presence against each category, over the drawn rows
    seen = rows.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(*[F.count(c).alias(f"n_{c}") for c in categories], *[F.sum(c).alias(f"p_{c}") for c in categories])

    def chi2(c):
        a, b = F.col(f"p_{c}"), F.col(f"n_{c}") - F.col(f"p_{c}")
        pos, all_ = F.lit(float(totals[f"p_{c}"] or 0)), F.lit(float(totals[f"n_{c}"]))
        neg = all_ - pos
        return F.coalesce(all_ * F.pow(a * (neg - b) - b * (pos - a), 2) / F.nullif((a + b) * (all_ - a - b) * pos * neg, F.lit(0.0)), F.lit(0.0))

    best = seen.withColumn("chi2", F.greatest(*[chi2(c) for c in categories]) if len(categories) > 1 else chi2(categories[0]))
    best = best.filter(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "word").select("word").limit(words)
    chosen = np.sort(np.array([r["word"] for r in best.collect()], dtype=np.int64).view(np.uint64))
    local = rows.select(*categories, "stats", F.array_intersect("words", _words_literal(chosen)).alias("words"), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(folds)).alias("fold")).toPandas()
    discarded(made)
    stats = np.stack(local["stats"])
    base = Chain(tuple(categories), chosen, stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6), ())
    x = np.stack([base.row(s, np.asarray(w, dtype=np.int64).view(np.uint64)) for s, w in zip(stats, local["words"], strict=True)])
    fold, done, models, cuts = local["fold"].to_numpy(), np.zeros((len(x), 0)), [], []
    for c in categories:
        y = local[c].to_numpy(dtype=float)
        has = ~np.isnan(y)
        mixed = has.any() and 0 < y[has].mean() < 1
        if not mixed:
            constant = float(y[has].mean()) if has.any() else 0.0
            models.append(constant)
            cuts.append(0.5)
            done = np.hstack([done, np.full((len(x), 1), constant)])
            continue
        full = _chained(x, done).astype(np.float32)
        unseen = np.full(len(x), y[has].mean())
        for f in range(folds):
            train = has & (fold != f)
            if train.any() and 0 < y[train].mean() < 1:
                unseen[fold == f] = 1 / (1 + np.exp(-np.clip(full[fold == f] @ logistic(full[train], y[train]), -30, 30)))
        models.append(logistic(full[has], y[has]))
        cuts.append(threshold(unseen[has], y[has]))
        done = np.hstack([done, unseen[:, None]])
    return Chain(tuple(categories), chosen, base.mean, base.scale, tuple(models), tuple(cuts))


def _words_literal(words: np.ndarray):
    return F.split(F.lit(",".join(map(str, words.view(np.int64)))), ",").cast("array<bigint>") if len(words) else F.array().cast("array<bigint>")


def predict(docs: DataFrame, chain: Chain, keep: list[str] | None = None) -> DataFrame:
    """A probability ``p_<category>`` for each category of every row's whole text, beside the columns in ``keep``."""

    def of(texts):
        rows = [chain.row(*features(t)) for t in texts]
        p = chain.probabilities(np.stack(rows)) if rows else np.zeros((0, len(chain.categories)))
        return [p[:, i] for i in range(len(chain.categories))]

    return appended(docs, ["doc_id"] if keep is None else keep, ", ".join(f"p_{c} double" for c in chain.categories), of)
