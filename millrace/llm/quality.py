"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Each text becomes a short vector of statistics.  cos(Wx + b) with Gaussian W
approximates a Gaussian kernel over that vector, so ridge regression on the
features is kernel ridge at linear cost.  Groups of rows sum their normal
equations on the executors; the driver adds a few small matrices, solves, and
fits an isotonic curve on out-of-fold scores.

Defined cases: null and empty texts have statistics (zeros) and a score; a very
long text is described whole; rows with a null label or id are no training rows;
with no training row, or one class only, every score is that class's share (0.5
for none); an id that is labelled, or found, several times trains with each
pair, within the bound; equal fitted values share a level of the calibration;
repeated rows are scored alike, each once; an empty table has no row; other
columns come along only if ``keep`` names them (in ``accepted``: all, untouched),
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._tables import appended, bounded_sample, discarded, filtered, held_out, written
from millrace.llm._text import char_table, code_points, word_hashes

#: Characters that count as symbols, and as marks of ordinary sentences.
SYMBOLS = "#$%&*@^~<>{}[]=+\\_/"
SENTENCE = ".,;:?"
STATISTICS = ("chars", "words", "word_chars", "letters", "upper", "digits", "spaces", "symbols", "shouts", "bars", "sentence", "distinct", "doubled", "line_words", "repeated_lines", "all_caps")
#: Labelled rows that a fit draws at most, and sums to build from them.
FIT_ROWS, FOLDS, PARTS = 50_000, 5, 4
#: Score from which a document is kept.
THRESHOLD = 0.7


def statistics(text: str | None, words: np.ndarray | None = None) -> np.ndarray:
    """The statistics of one whole text, in the order of STATISTICS; ``words``: its word hashes, if known."""
    text = text or ""
    points = code_points(text)
    n = len(points)
    if n == 0:
        return np.zeros(len(STATISTICS))
    small = np.bincount(np.minimum(points, 128), minlength=129)
    upto = lambda chars: sum(small[ord(c)] for c in chars)
    letters = int(np.count_nonzero(char_table("letter")[points]))
    folded = text.lower()
    changed = code_points(folded)
    upper = int(np.count_nonzero(changed != points)) if len(changed) == n else sum(c.isupper() for c in text)
    words = word_hashes(text) if words is None else words
    lines = [x for x in text.split("\n") if x.strip()]
    shouted = sum(1 for x in lines if x.upper() == x and x.lower() != x)
    m = max(len(words), 1)
    return np.array([
        np.log1p(n), np.log1p(len(words)), letters / m, letters / n, upper / max(letters, 1), upto("0123456789") / n,
        upto(" \n\t") / n, np.sqrt(upto(SYMBOLS) / n), np.sqrt(upto("!") / n), np.sqrt(upto("|") / n), upto(SENTENCE) / m,
        len(np.unique(words)) / m, np.count_nonzero(words[1:] == words[:-1]) / m, np.log1p(m / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), shouted / max(len(lines), 1),
    ])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        phi = np.cos(z @ self.weights + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([phi, np.ones((len(phi), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.ridge, self.knots, self.levels), 0, 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels, two knots for each pool."""
    order = np.argsort(score, kind="stable")
    at, mass = np.unique(score[order], return_counts=True)
    sums = np.add.reduceat(label[order].astype(float), np.concatenate(([0], np.cumsum(mass)[:-1])))
    pools: list[list[float]] = []
    for x, w, s in zip(at, mass, sums, strict=True):
        pools.append([x, x, w, s])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            low = pools.pop(-2)
            pools[-1] = [low[0], pools[-1][1], low[2] + pools[-1][2], low[3] + pools[-1][3]]
    return np.array([x for p in pools for x in p[:2]]), np.array([p[3] / p[2] for p in pools for _ in "lr"])


def _stats_of(batch: pd.DataFrame) -> np.ndarray:
    return np.array([statistics(t) for t in batch["text"]]).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, width: int = 200, ridge: float = 1e-3, bandwidth: float = 3.0, fit_rows: int = FIT_ROWS, seed: int = 7) -> QualityModel:
    """Fit on the labelled rows that are not held out, ``fit_rows`` of them at most (drawn by a hash of the id).

    docs(doc_id, text), labels(doc_id, quality).  The drawn labels are broadcast: their number is bounded.
    """
    known = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    known = bounded_sample(known.filter(~held_out(F.col("doc_id"))).withColumn("y", (F.col("y") >= 1).cast("double")), F.col("doc_id"), fit_rows)

    def describe(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "y": b["y"], "x": list(_stats_of(b))})

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInPandas(describe, "doc_id string, y double, x array<double>")
    group = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS * PARTS)).cast("int")  # an id's rows share a fold
    # at most fit_rows short vectors, also where very many documents share a labelled id, summed in FOLDS * PARTS groups
    made = written(rows.withColumn("part", group), "quality-fit")
    rows = bounded_sample(made, F.struct("doc_id", "x"), fit_rows)
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    base = QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, width)) / bandwidth, rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), np.array([0.0]), np.array([0.5]))
    moments = rows.select(F.count("*").alias("n"), F.avg("y").alias("share"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, share = moments["n"], moments["share"]
    if not n or share in (0.0, 1.0):
        discarded(made)
        return QualityModel(*[getattr(base, k) for k in ("mean", "scale", "weights", "shift", "ridge", "knots")], np.array([0.5 if not n else share]))
    mean = np.array([moments[f"m{i}"] for i in range(d)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(d)])
    base = QualityModel(mean, np.maximum(scale, 1e-6), base.weights, base.shift, base.ridge, base.knots, base.levels)

    def sums(key, pdf):
        phi, y = base.features(np.stack(pdf["x"])), pdf["y"].to_numpy()
        # the rarer class weighs as much as the other, so the ridge cannot ignore it
        w = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))[:, None]
        return pd.DataFrame({"part": [key[0]], "a": [(phi.T @ (phi * w)).tobytes()], "b": [(phi.T @ (y[:, None] * w))[:, 0].tobytes()]})

    parts = rows.groupBy("part").applyInPandas(sums, "part int, a binary, b binary").collect()
    k = width + 1
    by_fold = {f: [np.zeros((k, k)), np.zeros(k)] for f in range(FOLDS)}
    for r in parts:
        at = by_fold[r["part"] % FOLDS]
        at[0] += np.frombuffer(r["a"]).reshape(k, k)
        at[1] += np.frombuffer(r["b"])
    a, b = sum(x for x, _ in by_fold.values()), sum(x for _, x in by_fold.values())
    solve = lambda p, q: np.linalg.solve(p + ridge * n * np.eye(k) / k, q)
    without = {f: solve(a - x, b - y) for f, (x, y) in by_fold.items()}

    def unseen(batches):
        for pdf in batches:
            if len(pdf):
                phi, fold = base.features(np.stack(pdf["x"])), pdf["part"].to_numpy() % FOLDS
                yield pd.DataFrame({"s": np.einsum("ij,ij->i", phi, np.stack([without[f] for f in fold])), "y": pdf["y"]})

    scored = rows.select("part", "x", "y").mapInPandas(unseen, "s double, y double").toPandas()
    discarded(made)
    knots, levels = isotonic(scored["s"].to_numpy(), scored["y"].to_numpy())
    return QualityModel(base.mean, base.scale, base.weights, base.shift, solve(a, b), knots, levels)


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row's ``score`` (0 to 1) and ``predicted`` (1 from the threshold up) beside the columns in ``keep``."""

    def of(texts):
        s = _scores(model, texts)
        return [s, (s >= threshold).astype("int32")]

    return appended(docs, ["doc_id"] if keep is None else keep, "score double, predicted int", of)


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score at least the threshold."""
    return filtered(docs, lambda texts: _scores(model, texts) >= threshold)


def _scores(model: QualityModel, texts: list) -> np.ndarray:
    return model.score(np.array([statistics(t) for t in texts])) if texts else np.zeros(0)
