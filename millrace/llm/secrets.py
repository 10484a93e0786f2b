"""Secret scans: fixed patterns, and strings that look random to two Markov models.

All of it is DataFrame expressions.  A match's place follows from the lengths of
the matches and of the pieces between them, so no Python sees a row.  Besides
the patterns, every long token is judged by the log-likelihood ratio of two
first-order character models, one of random strings and one of ordinary
identifiers, trained from labelled samples.  From which ratio on a token counts
as random is read off labelled samples that the models have not seen: above the
value that only the stated rate of ordinary ones reaches, and midway from there
to the value that all but the stated rate of random ones reach, which leaves
room for kinds of identifiers that are not among the samples.

Defined cases: null is the empty text; offsets count code points, ends are
exclusive; spans are in order of start, then kind; a token that patterns' spans
touch is judged by its parts outside of them, each part of ``TOKEN_LEAST``
characters or more by itself; a very long text costs time in proportion to its
length and spans; repeated rows are scanned alike, each once; an empty table has
no row; other columns of a row come along only if ``keep`` names them, and may
have any name (one that starts with an underscore and is used here is an error
of Spark's own).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._tables import bounded_sample

#: The base patterns, in order, with the group whose length counts and the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What the models judge: whole runs of these characters, this long at least (a shorter random string stays under the bar).
TOKEN_CHARS, TOKEN_LEAST = "A-Za-z0-9+/_=-", 12
TOKEN = rf"(?<![{TOKEN_CHARS}])[{TOKEN_CHARS}]{{{TOKEN_LEAST},}}+"
#: Share of held-out ordinary samples that may be taken for random, and of held-out random ones that may be missed.
FALSE_ALARM, MISSED = 1e-4, 1e-3
#: Documents drawn for ordinary identifiers at most, and random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 2_000
_STEP = 256
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SPAN = "struct<start:int,kind:int,end:int>"


def folded(rows: Column, zero: Column, step: Callable[[Column, Column], Column], item: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column], kind: str) -> tuple[Column, Column]:
    """Items of a fold over an array, and its last state: ``item`` and ``keep`` see the state before an element, ``step`` gives the one after.

    It goes in steps, so that an array of any length costs no square of its length.
    """
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _STEP).cast("int")), lambda i: F.slice(rows, i * _STEP + 1, F.lit(_STEP)))

    def one(acc, x):
        out = F.when(keep(acc["at"], x), F.array_append(acc["out"], item(acc["at"], x))).otherwise(acc["out"])
        return F.struct(step(acc["at"], x).alias("at"), out.alias("out"))

    def part(acc, some):
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.array_append(acc["out"], inner["out"]).alias("out"))

    done = F.aggregate(steps, F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), part)
    some = F.size(rows) > 0
    return F.when(some, F.flatten(done["out"])).otherwise(F.array().cast(f"array<{kind}>")), F.when(some, done["at"]).otherwise(zero)


def found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """The matches of a pattern as structs (start, kind, end), leftmost and non-overlapping; short ones are left out."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else F.transform(whole, F.char_length)
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    rows = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("size"), counted.alias("counted"))
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end"))
    return folded(rows, F.lit(0), lambda at, x: at + x["gap"] + x["size"], span, lambda at, x: x["counted"] >= least, _SPAN)[0]


def codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), F.ascii)


def labelled_samples(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random: int = SAMPLE_RANDOM) -> DataFrame:
    """(token, label): 1 for random strings in the alphabets keys are written in, 0 for ordinary identifiers.

    All are made: nobody has marked the corpus.  Ordinary ones join the words of ``sample_docs`` documents at most (drawn by
    a hash of the id) in snake, kebab, camel and path case, and bare, besides plain numbers, dates, rules and repeated characters.  Random ones
    are digests of numbers, whole and cut short.
    """
    base = spark.range(random).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.sha2(F.concat(F.lit("n"), F.col("id")), 256).alias("g"))
    packed = F.regexp_replace(F.base64(F.unhex(F.concat("h", "g"))), "[\r\n=]", "")
    randoms = base.select(F.explode(F.array(F.substring("h", 1, 40), F.col("g"), packed, F.regexp_replace(packed, "[+/]", ""), F.upper(F.regexp_replace(packed, "[+/]", "")), F.regexp_replace(F.regexp_replace(packed, r"\+", "-"), "/", "_"), F.substring("g", 9, 16), F.substring(packed, 5, 20))).alias("token")).withColumn("label", F.lit(1))
    drawn = bounded_sample(docs.select("doc_id", "text"), F.col("doc_id").cast("string"), sample_docs)
    words = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,14}(?![A-Za-z0-9])"), F.lit(0)), lambda w: F.char_length(w) > 1)
    threes = drawn.select(words.alias("w")).filter(F.size("w") >= 3).select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 2, F.lit(3))).alias("i")).select(F.slice("w", F.col("i"), F.lit(3)).alias("w"))
    low = F.transform("w", F.lower)
    made = [F.array_join(low, "_"), F.array_join(low, "-"), F.array_join(F.transform(low, F.initcap), ""), F.array_join("w", "/"), F.upper(F.array_join(low, "_")), F.array_join(low, "")]
    ordinary = threes.select(F.explode(F.array(*made)).alias("token"))
    day = F.date_format(F.timestamp_seconds(F.col("id") * 86_399), "yyyy-MM-dd/HH")
    plain = spark.range(random).select(F.explode(F.array(F.abs(F.xxhash64("id")).cast("string"), day, F.concat(F.lit("v"), F.col("id"), F.lit("_"), F.pmod("id", F.lit(97))), *[F.repeat(F.lit(c), 24) for c in "-=_+/"], F.repeat(F.chr(F.element_at(F.array(*[F.lit(ord(c)) for c in _PLAIN]), (F.pmod("id", F.lit(len(_PLAIN))) + 1).cast("int"))), (F.lit(TOKEN_LEAST) + F.floor(F.col("id") / len(_PLAIN))).cast("int")))).alias("token"))
    return randoms.unionByName(ordinary.unionByName(plain).withColumn("label", F.lit(0)))


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios of every pair of ASCII characters (128 x 128, random over ordinary), and what a token needs.

    ``least`` nats in all and ``least_mean`` nats for each pair; ``false_alarms`` and ``caught`` are the shares of held-out
    ordinary and random samples that reach both.
    """

    ratios: tuple[float, ...]
    least: float
    least_mean: float
    false_alarms: float
    caught: float


def _pairs(samples: DataFrame) -> DataFrame:
    pairs = samples.select("label", codes(F.col("token")).alias("c")).filter(F.size("c") > 1)
    pairs = pairs.select("label", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * 128 + F.get("c", i + 1))).alias("pair"))
    return pairs.filter(F.col("pair").between(0, 128 * 128 - 1)).groupBy("label", "pair").count()


def train(samples: DataFrame, smooth: float = 0.5, false_alarm: float = FALSE_ALARM, missed: float = MISSED) -> Models:
    """Both models from (token, label), and the bars from the quarter of the samples (by a hash of the token) they do not see.

    The driver sees one count for each label and pair, or pair of rounded ratios: bounds that the alphabet and the longest
    sample set.
    """
    unseen = F.pmod(F.xxhash64("token"), F.lit(4)) == 0
    counts = np.full((2, 128, 128), smooth / 64)
    for r in _pairs(samples.filter(~unseen)).collect():
        counts[int(r["label"])].flat[r["pair"]] += r["count"]
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    ratios = tuple(round(float(x), 3) for x in (logs[1] - logs[0]).ravel())
    token = F.col("token")
    judged = samples.filter(unseen & (F.char_length(token) >= TOKEN_LEAST)).select("label", ratio(token, ratios).alias("r"), (F.char_length(token) - 1).alias("n"))
    judged = judged.groupBy("label", F.floor("r").alias("whole"), F.floor(F.col("r") / F.col("n") * 20).alias("mean")).count().collect()
    rows = np.array([[r["label"], r["whole"], r["mean"] / 20, r["count"]] for r in judged], dtype=float).reshape(-1, 4)
    plain, odd = rows[rows[:, 0] == 0], rows[rows[:, 0] == 1]

    def bar(column: int, step: float, floor: float) -> float:
        """From the least value, in steps, that no more than the allowed share of ordinary samples reaches, half the way to that of random ones."""
        reach = lambda x, v: x[x[:, column] >= v, 3].sum()
        low = max([floor, *(v + step for v in set(plain[:, column]) if reach(plain, v) > false_alarm * plain[:, 3].sum())])
        high = max([v for v in set(odd[:, column]) if reach(odd, v) >= (1 - missed) * odd[:, 3].sum()], default=low)
        return (low + max(low, high)) / 2

    # a ratio below the inverse of the rate of false alarms is no evidence at that rate
    least, least_mean = bar(1, 1.0, math.ceil(-math.log(false_alarm))), bar(2, 0.05, 0.05)
    share = lambda x: float(x[(x[:, 1] >= least) & (x[:, 2] >= least_mean), 3].sum() / max(x[:, 3].sum(), 1))
    return Models(ratios, round(float(least), 1), round(float(least_mean), 3), share(plain), share(odd))


def ratio(token: Column, ratios: tuple[float, ...]) -> Column:
    """The log-likelihood ratio (nats) of a token of ASCII characters; other characters count nothing."""
    table = F.split(F.lit(",".join(f"{x:g}" for x in ratios)), ",").cast("array<double>")
    known = lambda last, c: (last >= 0) & (last < 128) & (c < 128)
    return F.aggregate(codes(token), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(known(acc["last"], c), F.get(table, acc["last"] * 128 + c)).otherwise(0.0)).alias("sum")))["sum"]


def looks_random(token: Column, models: Models) -> Column:
    """Whether the models' log-likelihood ratio for a token is high enough, in all and for each pair of characters."""
    total = ratio(token, models.ratios)
    return (total >= models.least) & (total >= models.least_mean * (F.char_length(token) - 1))


def scan(docs: DataFrame, models: Models, keep: list[str] | None = None) -> DataFrame:
    """``base`` and ``extra`` spans of every row's whole text, and ``judged``, the tokens that the models saw, beside the columns in ``keep``."""
    keep = ["doc_id"] if keep is None else keep
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(f"array<{_SPAN}>")
    hints = (r"(?i:password|passwd|secret|token|api_?key)", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")
    rows = docs.select(*[F.col(c) for c in dict.fromkeys([*keep, "text"])])
    kinds = [F.when(text.rlike(hint), found(text, p, g, n, k)).otherwise(none) for (k, (_, p, g, n)), hint in zip(enumerate(BASE), hints, strict=True)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*kinds)))
    # where base spans were there is blank, so what is left of a token stands by itself, in its place
    rows = rows.withColumn("_left", F.when(F.size("base") > 0, redacted(text, F.col("base"), None)).otherwise(text))
    left = F.col("_left")
    rows = rows.withColumn("judged", F.when(left.rlike(TOKEN), F.regexp_extract_all(left, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # most texts have no long token, most long tokens are ordinary: places are worked out for the rest
    rows = rows.withColumn("_odd", F.exists("judged", lambda t: looks_random(t, models)))
    placed = F.arrays_zip(F.col("judged").alias("token"), found(left, TOKEN, 0, 1, len(BASE)).alias("span"))
    extra = F.transform(F.filter(placed, lambda x: looks_random(x["token"], models)), lambda x: x["span"])
    return rows.select(*keep, "base", F.when(F.col("_odd"), extra).otherwise(none).alias("extra"), "judged")


def evidence(text: Column, base: Column, models: Models) -> Column:
    """The models' log-likelihood ratio of each base span's secret (of an assignment, its value), in nats."""
    whole = lambda x: text.substr(x["start"] + 1, x["end"] - x["start"])
    secret = lambda x: F.when(x["kind"] == 0, F.regexp_extract(whole(x), BASE[0][1], BASE[0][2])).otherwise(whole(x))
    return F.transform(base, lambda x: F.round(ratio(secret(x), models.ratios), 2))


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(x) for x in (*[name for name, *_ in BASE], "random")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mark: str | None = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by a mark (None: by as many blanks); ``spans`` in order of start."""
    before = lambda at, x: text.substr(at + 1, F.greatest(x["start"] - at, F.lit(0)))

    def piece(at, x):
        if mark is not None:
            return F.concat(before(at, x), F.lit(mark))
        return F.concat(before(at, x), F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(at, x["start"]), F.lit(0))))

    fresh = (lambda at, x: x["start"] >= at) if mark is not None else (lambda at, x: F.lit(True))
    pieces, at = folded(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), piece, fresh, "string")
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), text.substr(at + 1, F.char_length(text)))).otherwise(text)
