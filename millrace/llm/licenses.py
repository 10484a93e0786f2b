"""License scans: sparse cosine to templates, then inheritance from the nearest licensed directory.

Only DataFrame expressions.  Licence texts and standard headers (``licence_texts/``) are compared with windows
over consecutive lines that hold as many words as the template, and with whole
shorter files, by their counts of word pairs: comment signs and line breaks do
not count, and common words alone make no likeness.  Only distinct texts that
have one of the words without which no template reaches the threshold are cut up.

One-sentence statements are compared with lines: a line's vector weighs each token by its count and inverse document frequency,
the latter counted over all files for the templates' words (any other token
weighs as much as the templates' words do on average).  Lines that could reach
the threshold are found by the words without which a template cannot (prefix
filtering, which loses nothing); cosines are worked out for those alone, inside
the row.  A text's licence is that of its best window, else of its best line,
else of the best sentence of a line.

A file without a license of its own takes that of the nearest directory above it
that holds a licence file.  Directories are reduced to distinct ones before the
joins, so a directory with very many files weighs no more than any other.

Defined cases: null is the empty text, which has no license; a null path is in
no directory; of equal scores the greater license name counts, of several
licence files in a directory the best score, then the smallest path; repeated
rows are scanned each; very long texts are cut up on the cluster, line by line
and word by word, never in one value besides the text itself; with no files
there is no row; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._tables import discarded, written

#: Licenses and the statements by which files declare them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Fixed value: names of files that license their directory.
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([-._].*)?$"
THRESHOLD = 0.8
#: Licence texts and standard headers: <license>.txt and <license>.header.txt.
TEXTS = Path(__file__).with_name("licence_texts")
#: Words too common to tell texts apart, for the first look at a text.
_COMMON = frozenset("a an and any are as at be by for from if in is it its may no not of on or other such that the their this to under use with you your".split())
_BREAK = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BREAK), lambda t: t != "")


def _tokens(text: str) -> list[str]:
    return [t for t in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split(" ") if t]


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of files, and for each word of the vocabulary in how many of them it occurs (all files, whole texts)."""
    has = F.array_intersect(tokens(F.coalesce("text", F.lit(""))), F.array(*[F.lit(x) for x in vocabulary]))
    rows = files.select(F.explode_outer(F.array_append(has, F.lit(""))).alias("t")).groupBy("t").count().collect()
    found = {r["t"]: r["count"] for r in rows}
    return found.pop("", 0), found


def _weights(files: DataFrame, templates) -> tuple[dict[str, float], float]:
    vocabulary = sorted({t for _, text in templates for t in _tokens(text)})
    n, df = frequencies(files, vocabulary)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    return idf, sum(idf.values()) / len(idf)


def texts() -> list[tuple[str, str]]:
    """(license, text) of the licence texts and standard headers."""
    return [(re.sub(r"(\.header)?\.txt$", "", p.name), p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]


def _pairs(text: str) -> Counter:
    words = _tokens(text)
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def anchors(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[str]:
    """Words one of which every text has that reaches the threshold: without them a template's pairs weigh too little."""
    out: set[str] = set()
    for _, text in templates:
        left = {tuple(pair.split()): c * c for pair, c in _pairs(text).items()}
        bar = threshold**2 * sum(left.values()) - 1e-9
        while True:
            left = {pair: m for pair, m in left.items() if not out & set(pair)}
            if sum(left.values()) < bar:
                break
            mass: Counter = Counter()
            for pair, m in left.items():
                for word in set(pair):
                    mass[word] += m
            out.add(max(mass, key=lambda x: (x not in _COMMON and len(x) > 2, mass[x], x)))
    return sorted(out)


def block_licenses(files: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """files(key, text), each key once -> key, block: struct(score, license, line) of the texts that hold a licence text or header.

    Of every text and template two windows are judged, of those that reach and of those that just miss the template's
    number of words the one that shares most with it.
    """
    spark = files.sparkSession
    rows = []
    for k, (name, text) in enumerate(templates):
        pairs = _pairs(text)
        size, norm = len(_tokens(text)), math.sqrt(sum(c * c for c in pairs.values()))
        rows += [(k, name, size, pair, c / norm) for pair, c in pairs.items()]
    shapes = F.broadcast(spark.createDataFrame(rows, "k int, license string, size int, pair string, w double"))
    words = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(tokens(x), lambda t: F.struct(t.alias("t"), (i + 1).alias("line")))))
    pos = files.select("key", words.alias("ws")).select("key", F.posexplode(F.arrays_zip(F.col("ws").alias("x"), F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))).alias("y"))).alias("at", "z"))
    # the last word of a text has no pair, but its line counts
    pos = written(pos.select("key", "at", F.col("z.x.line").alias("line"), F.concat_ws(" ", "z.x.t", F.coalesce("z.y.t", F.lit(""))).alias("pair")), "license-pairs")
    shared = pos.join(shapes, "pair")
    # the cosine is at most the norm of what a template shares with the whole text
    held = shared.select("key", "k", "license", "size", "pair", "w").distinct().groupBy("key", "k", "license", "size").agg(F.sum(F.col("w") * F.col("w")).alias("m")).filter(F.col("m") >= threshold**2 - 1e-9).drop("m")
    held = written(held, "license-held")
    lines = pos.groupBy("key", "line").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    dots = shared.join(held.select("key", "k"), ["key", "k"]).groupBy("key", "k", "line").agg(F.sum("w").alias("dot"))
    at = lines.join(held, "key").join(dots, ["key", "k", "line"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
    # the window of a line: all lines that start before as many words as the template's have passed
    unit = 1 << 20
    at = at.withColumn("x", F.expr(f"(cast(a as bigint) * {unit}) div size"))
    frame = Window.partitionBy("key", "k").orderBy("x").rangeBetween(0, unit - 1)
    at = at.select("key", "k", "license", "size", "line", "a", "b", F.sum("dot").over(frame).alias("long"), F.last("dot").over(frame).alias("cut"), F.last("a").over(frame).alias("last_a"), F.max("b").over(frame).alias("last_b"))
    alone = F.col("last_a") == F.col("a")
    at = at.withColumns({"short": F.when(alone, F.col("long")).otherwise(F.col("long") - F.col("cut")), "short_b": F.when(alone, F.col("last_b")).otherwise(F.col("last_a"))})
    best = at.groupBy("key", "k", "license").agg(*[F.max(F.struct(F.round(dot, 9).alias("dot"), "line", "a", F.col(end).alias("b"))).alias(of) for of, dot, end in (("l", "long", "last_b"), ("s", "short", "short_b"))])
    windows = best.select("key", "k", "license", F.explode(F.array("l", "s")).alias("win")).select("key", "k", "license", "win.line", "win.a", "win.b").distinct()
    inside = pos.select("key", "at", "pair").join(windows, "key").filter((F.col("at") >= F.col("a")) & (F.col("at") < F.col("b") - 1))
    counts = inside.groupBy("key", "k", "license", "line", "a", "b", "pair").agg(F.count("*").alias("c")).join(shapes.select("k", "pair", "w"), ["k", "pair"], "left")
    scores = counts.groupBy("key", "k", "license", "line", "a", "b").agg(F.round(F.sum(F.col("c") * F.coalesce("w", F.lit(0.0))) / F.sqrt(F.sum(F.col("c") * F.col("c"))), 6).alias("score"))
    found = scores.filter(F.col("score") >= threshold).groupBy("key").agg(F.max(F.struct("score", "license", F.col("line").cast("int").alias("line"))).alias("block"))
    found = written(found, "license-blocks")
    discarded(pos, held)
    return found


def own_license(text: Column, idf: dict[str, float], other: float, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """struct(score, license, line) of the best line of a text, else of the best sentence, null if none reaches the threshold."""
    shapes, needed = [], set()
    for name, statement in templates:
        weight = {t: c * idf[t] for t, c in Counter(_tokens(statement)).items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        rest = norm
        for t in sorted(weight, key=lambda t: (-weight[t], t)):
            # as long as the other words alone reach the threshold, a unit may do without the ones before
            if rest < threshold * norm - 1e-9:
                break
            needed.add(t)
            rest = math.sqrt(max(0.0, rest * rest - weight[t] ** 2))
        shapes.append(F.struct(F.lit(name).alias("license"), F.create_map(*[F.lit(x) for t, w in weight.items() for x in (t, w / norm)]).alias("w")))
    idfs = F.create_map(*[F.lit(x) for t, w in idf.items() for x in (t, w)])
    anchor = "(?i)(?<![a-z0-9])(?:" + "|".join(sorted(needed)) + ")(?![a-z0-9])"

    once = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))  # noqa: E731  (a value that ``of`` uses often is worked out once)

    def scored(line, at):
        """Counts from the sorted tokens, so a line of any length costs no square of its tokens."""
        return once(F.array_sort(tokens(line)), lambda every: once(F.filter(F.sequence(F.lit(1), F.size(every)), lambda i: (i == 1) | (F.get(every, i - 1) != F.get(every, i - 2))), lambda firsts: once(weighed(every, firsts), lambda counted: of_counts(counted, at))))

    def weighed(every, firsts):
        def one(i, j):
            t = F.get(every, i - 1)
            return F.struct(t.alias("t"), idfs[t].isNotNull().alias("known"), ((F.coalesce(F.get(firsts, j + 1), F.size(every) + 1) - i) * F.coalesce(idfs[t], F.lit(other))).alias("w"))

        return F.transform(firsts, one)

    def of_counts(counted, at):
        norm = F.sqrt(F.aggregate(counted, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
        dot = lambda known, s: F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(s["w"][x["t"]], F.lit(0.0)))
        scores = once(norm, lambda n: once(F.filter(counted, lambda x: x["known"]), lambda known: F.array_max(F.transform(F.array(*shapes), lambda s: F.struct(F.round(dot(known, s) / n, 6).alias("score"), s["license"].alias("license"))))))
        return once(scores, lambda best: F.struct(best["score"].alias("score"), best["license"].alias("license"), at.alias("line")))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("at"))), lambda x: x["line"].rlike(anchor))
    parted = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x["line"], r"(?<=[.!?;])\s+"), lambda s: F.struct(s.alias("line"), x["at"].alias("at")))))
    sentences = F.filter(parted, lambda x: x["line"].rlike(anchor))
    best = lambda units: F.array_max(F.filter(F.transform(units, lambda x: scored(x["line"], x["at"])), lambda x: x["score"] >= threshold))
    return F.when(text.rlike(anchor), F.coalesce(best(lines), best(sentences)))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(doc_id, path, text) -> doc_id, path, license, how (file, header, inherited or none), score, line, licensed_dir."""
    files = files.select("doc_id", "path", "text")
    idf, other = _weights(files, templates)
    slash = F.length("path") - F.length(F.substring_index("path", "/", -1))
    blocks = texts()
    text = F.coalesce("text", F.lit(""))
    hint = F.lower(text).rlike("(?<![a-z0-9])(?:" + "|".join(anchors(blocks, threshold)) + ")(?![a-z0-9])")
    rows = files.select("doc_id", "path", F.when(slash > 0, F.col("path").substr(F.lit(1), slash - 1)).otherwise(F.when(F.col("path").isNotNull(), "")).alias("dir"), F.substring_index("path", "/", -1).rlike(LICENCE_FILE).alias("is_file"), own_license(text, idf, other, templates, threshold).alias("own"), F.when(hint, F.sha2(text, 256)).alias("key"))
    rows = written(rows, "licenses")
    distinct = files.filter(hint).select(F.sha2(text, 256).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    found = block_licenses(distinct, blocks, threshold)
    judged = rows.filter(F.col("key").isNotNull()).join(found, "key", "left").withColumn("own", F.coalesce("block", "own"))
    rows = rows.filter(F.col("key").isNull()).drop("key").unionByName(judged.drop("key", "block"))
    at = rows.filter(F.col("is_file") & F.col("own").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("own.score")).alias("s"), "path", F.col("own.license").alias("license"))).alias("of"))
    at = at.select(F.col("dir").alias("licensed_dir"), F.col("of.license").alias("inherited"))
    # distinct directories, each with all its ancestors and itself
    needing = rows.filter(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    above = needing.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))).alias("licensed_dir"))
    nearest = above.join(at, "licensed_dir").groupBy("dir").agg(F.max(F.struct(F.length("licensed_dir").alias("n"), "licensed_dir", "inherited")).alias("near"))
    # one row for each directory on the right: a directory with very many files is a skew that Spark splits
    out = rows.join(nearest, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path",
        F.when(has, F.col("own.license")).otherwise(F.col("near.inherited")).alias("license"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.col("own.score").alias("score"), F.col("own.line").cast("long").alias("line"),
        F.when(~has, F.col("near.licensed_dir")).alias("licensed_dir"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The scan of ``documents`` under the paths that the query gives them, for DuckDB: lines and statements alone."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    return f"""
        WITH templates(tid, license, statement) AS (VALUES {values}),
        tt AS (SELECT tid, license, tok, count(*) AS tf FROM (SELECT tid, license, unnest(string_split_regex(lower(statement), '{_BREAK}')) AS tok FROM templates) WHERE tok <> '' GROUP BY ALL),
        vocab AS (SELECT DISTINCT tok FROM tt),
        files AS (SELECT row_number() OVER () AS fid, doc_id, coalesce(text, '') AS text, {PATH_SQL} AS path FROM documents),
        n AS (SELECT count(*) AS n FROM files),
        df AS (SELECT tok, count(DISTINCT fid) AS df FROM (SELECT fid, unnest(string_split_regex(lower(text), '{_BREAK}')) AS tok FROM files) WHERE tok IN (SELECT tok FROM vocab) GROUP BY tok),
        idf AS (SELECT tok, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM vocab LEFT JOIN df USING (tok), n),
        other AS (SELECT avg(idf) AS w FROM idf),
        tv AS (SELECT tid, license, tok, tf * idf AS w FROM tt JOIN idf USING (tok)),
        tn AS (SELECT tid, sqrt(sum(w * w)) AS norm FROM tv GROUP BY tid),
        numbered AS (SELECT fid, string_split(text, chr(10)) AS ls FROM files),
        lines AS (SELECT fid, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM numbered),
        lt AS (SELECT fid, line, tok, count(*) AS tf FROM (SELECT fid, line, unnest(string_split_regex(lower(body), '{_BREAK}')) AS tok FROM lines) WHERE tok <> '' GROUP BY ALL),
        lv AS (SELECT fid, line, tok, tf * coalesce(idf, (SELECT w FROM other)) AS w FROM lt LEFT JOIN idf USING (tok)),
        ln_ AS (SELECT fid, line, sqrt(sum(w * w)) AS norm FROM lv GROUP BY ALL),
        cosines AS (SELECT lv.fid, lv.line, tv.license, tv.tid, round(sum(lv.w * tv.w) / (any_value(ln_.norm) * any_value(tn.norm)), 6) AS score
                    FROM lv JOIN tv USING (tok) JOIN ln_ USING (fid, line) JOIN tn USING (tid) GROUP BY ALL),
        own AS (SELECT fid, score, license, line FROM cosines WHERE score >= {threshold}
                QUALIFY row_number() OVER (PARTITION BY fid ORDER BY score DESC, license DESC, line DESC) = 1),
        r AS (SELECT f.*, o.score, o.license AS own, o.line, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
                     regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)^(licen[sc]e|copying|notice|unlicense)([-._].*)?$') AS is_file
              FROM files f LEFT JOIN own o USING (fid)),
        at_ AS (SELECT dir AS licensed_dir, own AS inherited FROM r WHERE is_file AND own IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
        near AS (SELECT d.dir, a.licensed_dir, a.inherited FROM (SELECT DISTINCT dir FROM r) d JOIN at_ a ON d.dir = a.licensed_dir OR starts_with(d.dir, a.licensed_dir || '/')
                 QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(a.licensed_dir) DESC) = 1)
        SELECT doc_id, path, coalesce(own, inherited) AS license,
               CASE WHEN own IS NOT NULL AND is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
               score, line, CASE WHEN own IS NULL THEN licensed_dir END AS licensed_dir
        FROM r LEFT JOIN near USING (dir)
    """


#: Where the query puts documents: directories of a hundred, of a thousand and of ten thousand ids below their source.  One
#: that opens or closes with a licence statement is a licence file, and by its id lies in any of the three levels.
_STATES = "(regexp_matches(coalesce(text, ''), '^[^\\n]*[Ll]icense[^\\n]*\\n') OR regexp_matches(coalesce(text, ''), '\\n[^\\n]*[Ll]icense[^\\n]*$'))"
PATH_SQL = f"""concat(source, '/', doc_id // 10000, CASE WHEN {_STATES} AND doc_id % 3 = 2 THEN '' ELSE concat('/', doc_id // 1000) END,
    CASE WHEN {_STATES} AND doc_id % 3 > 0 THEN '' ELSE concat('/', doc_id // 100) END, '/', CASE WHEN {_STATES} THEN 'LICENSE-' ELSE 'text-' END, doc_id, '.txt')"""


def placed(docs: DataFrame) -> DataFrame:
    """documents as files: (doc_id, path, text), see PATH_SQL; a null id counts as 0, its name has none."""
    text, n = F.coalesce("text", F.lit("")), F.expr("coalesce(doc_id, 0)")
    states = text.rlike(r"\A[^\n]*[Ll]icense[^\n]*\n") | text.rlike(r"\n[^\n]*[Ll]icense[^\n]*\z")
    level = lambda size, out: F.when(states & out, "").otherwise(F.concat(F.lit("/"), F.expr(f"coalesce(doc_id, 0) div {size}").cast("string")))
    name = F.concat(F.lit("/"), F.when(states, "LICENSE-").otherwise("text-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    path = F.concat(F.coalesce("source", F.lit("")), level(10_000, F.lit(False)), level(1_000, n % 3 == 2), level(100, n % 3 > 0), name)
    return docs.select("doc_id", path.alias("path"), "text")
