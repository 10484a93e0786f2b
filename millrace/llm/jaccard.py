"""N-gram Jaccard join by chosen paths: near duplicates on word shingles.

Texts become sets of hashed word 5-grams, equal sets one node.  Each of several
runs puts every set under the smallest of its tokens in a random order, a token
it shares with a similar set with probability equal to their Jaccard similarity.
A bucket of more than ``BUCKET`` sets is split: a few further random orders are
sampled for it and every member goes under its own smallest token in each,
recursively, so that sets which share one frequent passage part ways while
similar sets stay together.  So few orders are sampled that a member's rows grow
slowly with the levels; a pair that parts ways in one run has the other runs.
Where splitting does not thin a bucket out (its members are alike) it is dealt
in pairs of blocks.  Leaves, and pairs of blocks, are searched by brute force on
sketches.  The number of runs follows from the target recall.

A pair belongs to the least leaf that both sets are in, so it counts once however
often it meets.  Likely pairs are verified on the exact sets.  Where nearly
everything in a leaf is similar, its pairs are verified inside the leaf and leave
it as a count for each member and a spanning star, so rows stay in proportion to
members.

Defined cases: a text of fewer than five words is the set of its one shingle;
null texts and texts without words are linked to nothing and are classes of
their own; equal sets are copies of each other (similarity 1); repeated rows are
copies, and so are rows of one id and equal sets; class ids are the smallest
doc_id of the class (null ids count last); a text of any length is one set, made
block by block; columns other than doc_id and text are not looked at, whatever
their names; an empty table has no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._tables import discarded, written
from millrace.llm._text import mixed, shingles, word_hashes

SIMILARITY, WORDS, RECALL = 0.8, 5, 0.99999
#: One byte for each random order of a sketch, and the deviations below the similarity from which a pair is verified.
SKETCH, DEVIATIONS = 128, 5.5
#: Members of a leaf (larger buckets are split, alike ones dealt in blocks of as many), share of equal smallest tokens above which a bucket is alike, levels of splits at most.
BUCKET, ALIKE, DEPTH = 512, 0.4, 10
#: Likely pairs to a member that leave a leaf as rows, and members up to which leaves are searched together.
PAIRS, FEW = 8, 16
#: A key with more than one of so many rows is hot; there are no more hot keys than that.
HOT = 1024
_ORDERS = np.random.default_rng(20_240_101)
_ODD32 = _ORDERS.integers(0, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
_ADD32 = _ORDERS.integers(0, 1 << 32, SKETCH, dtype=np.uint32)


def surviving(similarity: float, orders: int) -> float:
    """Chance that a pair stays together in some leaf however deep a bucket is split, with so many orders to a level."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similarity * (1 - lost)) ** orders
    return 1 - lost


def orders_for(similarity: float) -> int:
    """Orders sampled at each split: as few as keep nine pairs of ten together."""
    return next(k for k in range(1, SKETCH) if surviving(similarity, k) >= 0.9)


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair at the similarity has met in a leaf with the target probability."""
    together = similarity * surviving(similarity, orders_for(similarity))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def likely_from(similarity: float) -> float:
    """Share of equal sketch bytes from which a pair is verified."""
    return similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / SKETCH)


def described(tokens: np.ndarray, runs: int) -> tuple[bytes, np.ndarray, bytes]:
    """Identity (128 bits), the bucket of each run, and the sketch of a set of tokens."""
    order = mixed(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(32))
    keys = np.array([mixed(mixed(tokens + order[r]).min(keepdims=True) + np.uint64(r))[0] for r in range(runs)], dtype=np.uint64)
    low, least = (tokens >> np.uint64(32)).astype(np.uint32), np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 8192):
        least = np.minimum(least, (low[at : at + 8192, None] * _ODD32 + _ADD32).min(axis=0))
    sketch = (mixed(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), keys.view(np.int64), sketch.tobytes()


def _light(docs: DataFrame, runs: int) -> DataFrame:
    """A narrow row for each document: doc_id, a hash of its text, and what ``described`` gives (null without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for b in batches:
            out = []
            for text in b["text"]:
                tokens = shingles(word_hashes(text), WORDS)
                out.append((*described(tokens, runs), len(tokens)) if len(tokens) else (None, None, None, 0))
            yield b[["doc_id", "text_hash"]].assign(**{k: [x[i] for x in out] for i, k in enumerate(("sid", "keys", "sketch", "size"))})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.mapInPandas(apply, "doc_id string, text_hash long, sid binary, keys array<long>, sketch binary, size int")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def _whole(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches again, cut so that rows with equal values of ``by`` stay in one frame."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        change = np.flatnonzero((b[by].to_numpy()[1:] != b[by].to_numpy()[:-1]).any(axis=1)) + 1
        if held and (held[-1][by].to_numpy()[-1] != b[by].to_numpy()[0]).any():
            yield pd.concat(held)
            held = []
        if len(change):
            yield pd.concat([*held, b.iloc[: change[-1]]])
            held = [b.iloc[change[-1] :]]
        else:
            held.append(b)
    if held:
        yield pd.concat(held)


def _cuts(b: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where the groups of a frame begin, and its length."""
    v = b[by].to_numpy()
    return np.concatenate(([0], np.flatnonzero((v[1:] != v[:-1]).any(axis=1)) + 1, [len(b)]))


def _earlier(leaf: int, leaves: list[np.ndarray]) -> np.ndarray:
    """[members, leaves] incidence of the lesser leaves that two members at least are in."""
    size = np.array([len(x) for x in leaves])
    who, flat = np.repeat(np.arange(len(leaves)), size), np.concatenate(leaves)
    who, flat = who[flat < leaf], flat[flat < leaf]
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    out = np.zeros((len(leaves), int(shared.sum())), dtype=np.float32)
    keep = shared[at]
    out[who[keep], (np.cumsum(shared) - 1)[at[keep]]] = 1
    return out


def _likely(sketch: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (p, q) may be similar, by their sizes and sketches."""
    fit = np.flatnonzero(np.minimum(size[p], size[q]) >= least * np.maximum(size[p], size[q]) - 1e-6)
    bar, out = likely_from(least) * SKETCH, []
    for at in range(0, len(fit), 1 << 16):
        some = fit[at : at + (1 << 16)]
        out.append(some[np.count_nonzero(sketch[p[some]] == sketch[q[some]], axis=1) >= bar])
    return np.concatenate(out) if out else fit


def _searched(batches, least: float):
    """Brute force inside leaves: likely pairs, or the members of a leaf (or pair of blocks) that is full of them, as (member, leaf, i, j, a, b)."""
    by, columns = ["leaf", "i", "j"], ["member", "leaf", "i", "j", "a", "b"]
    for b in _whole(batches, by):
        cuts, out = _cuts(b, by), []
        leaf, size, sid, leaves = b["leaf"].to_numpy(), b["size"].to_numpy(), b["sid"].to_list(), b["leaves"].to_list()
        sketch = np.frombuffer(b"".join(b["sketch"]), dtype=np.uint8).reshape(len(b), SKETCH)
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        few = (np.diff(cuts) <= FEW)[group]
        for step in range(1, FEW):
            p = np.flatnonzero(few[:-step] & (group[:-step] == group[step:])) if step < len(b) else np.empty(0, dtype=np.int64)
            p = p[_likely(sketch, size, p, p + step, least)]
            for x in p:
                common = np.intersect1d(leaves[x], leaves[x + step])
                if common[0] == leaf[x]:
                    out.append((False, leaf[x], 0, 0, sid[x], sid[x + step]))
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            n, pairs = end - at, []
            if n <= FEW:
                continue
            i, j = (int(b[c].iloc[at]) for c in ("i", "j"))
            earlier, block = _earlier(leaf[at], leaves[at:end]), b["block"].to_numpy()[at:end]
            for r in range(0, n, 64):
                rows = slice(r, min(n, r + 64))
                own = (np.arange(n) > np.arange(n)[rows, None]) & (earlier[rows] @ earlier.T == 0)
                if i != j:  # each block's own pairs belong to another group
                    own &= block[rows, None] != block
                p, q = np.nonzero(own)
                some = _likely(sketch[at:end], size[at:end], p + r, q, least)
                pairs.append((p[some] + r + at, q[some] + at))
            if sum(len(p) for p, _ in pairs) > PAIRS * n:
                out += [(True, leaf[at], i, j, s, None) for s in sid[at:end]]
            else:
                out += [(False, leaf[at], i, j, sid[x], sid[y]) for p, q in pairs for x, y in zip(p, q, strict=True)]
        yield pd.DataFrame(out, columns=columns)


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The matrix of pairs whose Jaccard similarity reaches ``least``, by products of incidence blocks."""
    sizes = np.array([len(s) for s in sets])
    token = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = count > 1
    renumber = np.cumsum(shared) - 1
    row, column = row[shared[column]], renumber[column[shared[column]]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(column, [at, at + 2048])
        block = np.zeros((len(sets), 2048), dtype=np.float32)
        block[row[i:j], column[i:j] - at] = 1
        both += block @ block.T
    either = sizes[:, None] + sizes - both
    return both >= least * either - 1e-6 * either


def _verified(batches, least: float):
    """Links and a spanning star of the members of every leaf (or pair of blocks), from the exact sets."""
    for whole in _whole(batches, ["leaf", "i", "j"]):
        cuts = _cuts(whole, ["leaf", "i", "j"])
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            g = whole.iloc[at:end]
            earlier, block = _earlier(g["leaf"].iloc[0], g["leaves"].to_list()), g["block"].to_numpy()
            link = similar([np.asarray(s, dtype=np.int64).view(np.uint64) for s in g["tokens"]], least)
            link &= earlier @ earlier.T == 0
            np.fill_diagonal(link, False)
            if g["i"].iloc[0] != g["j"].iloc[0]:
                link &= block[:, None] != block
            label = np.arange(len(g))
            while True:
                new = np.minimum(label, np.where(link, label, len(g)).min(axis=1))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            sid, copies = g["sid"].to_list(), g["copies"].to_numpy()
            some = np.flatnonzero(link.any(axis=1))
            yield pd.DataFrame({"a": [sid[x] for x in some], "b": [sid[label[x]] for x in some], "links": (link[some] @ copies).astype("int64")})


def _beside(rows: DataFrame, told: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with ``told``(*by, n, ...), where n is the number of a key's rows.

    A shuffle would bring all rows of a key to one task.  Keys with more than a ``HOT``-th of the rows, so no more than
    ``HOT`` keys, are broadcast and their rows stay where they are; the others are shuffled.
    """
    total = told.agg(F.sum("n")).first()[0] or 0
    hot = told.filter(F.col("n") * HOT > total).select(*by)
    of_hot = rows.join(F.broadcast(told.filter(F.col("n") * HOT > total)), by)
    of_others = rows.join(F.broadcast(hot), by, "left_anti").join(told.filter(F.col("n") * HOT <= total), by)
    return of_hot.unionByName(of_others)


def _leaves(nodes: DataFrame, orders: int, report: list | None) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, sid, n) of every leaf with more than one member, n above BUCKET where it is alike; and the tables to delete later.

    A split is one row for each member and sampled order.  Its orders are drawn by a hash of the bucket, so all members
    agree on them and no two runs share them.
    """
    met = nodes.select(F.explode("keys").alias("leaf"), "sid")
    counts = written(met.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "sizes")
    level = written(_beside(met, counts, ["leaf"]).select("leaf", "sid", "n"), "buckets")
    discarded(counts)
    spent, out, depth = [level], [level.filter(F.col("n") <= BUCKET)], 0
    large = level.filter(F.col("n") > BUCKET)
    first, stride = F.xxhash64("leaf", F.lit(1)), F.xxhash64("leaf", F.lit(2))
    order = lambda i: F.pmod(F.pmod(first, F.lit(SKETCH)) + i * (2 * F.pmod(stride, F.lit(SKETCH // 2)) + 1), F.lit(SKETCH)).cast("int")
    child = lambda i: F.struct(i.alias("nth"), F.xxhash64("leaf", order(i), F.substring("sketch", order(i) + 1, F.lit(1))).alias("child"))
    while not large.isEmpty():
        children = large.join(nodes.select("sid", "sketch"), "sid").select("leaf", "sid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), child)).alias("c"))
        children = written(children.select(F.col("leaf").alias("parent"), "sid", "c.nth", F.col("c.child").alias("leaf")), "children")
        sizes = written(children.groupBy("parent", "nth", "leaf").agg(F.count("*").alias("n")), "sizes")
        sums = sizes.groupBy("parent", "nth").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("same"), F.sum("n").alias("all"))
        square = F.col("all").cast("double") * F.col("all")
        spread = written(sums.groupBy("parent").agg(((F.sum("same") / F.sum(square) >= ALIKE) | F.lit(depth >= DEPTH)).alias("stop"), F.max("all").alias("n")), "spread")
        alike = _beside(large.drop("n"), spread.filter("stop").select(F.col("parent").alias("leaf"), "n"), ["leaf"]).select("leaf", "sid", "n")
        known = written(sizes.join(spread.filter(~F.col("stop")).select("parent"), "parent").filter(F.col("n") > 1), "known")
        level = written(_beside(children, known, ["parent", "nth", "leaf"]).select("leaf", "sid", "n"), "buckets")
        if report is not None:
            report.append((large.count(), alike.count(), level.count()))
        out += [alike, level.filter(F.col("n") <= BUCKET)]
        discarded(children, sizes, known)
        spent += [level, spread]
        large, depth = level.filter(F.col("n") > BUCKET), depth + 1
    leaves = out[0]
    for more in out[1:]:
        leaves = leaves.unionByName(more)
    return leaves, spent


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sid, class_id): the smallest ``rep`` of each component, by minimum labels with pointer jumping.

    Each round is two joins and a pre-aggregated minimum; tables are written, nothing is gathered.
    """
    ends = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    ends = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = F.struct(F.col("rep").isNull().alias("none"), "rep", "sid")
    labels = written(nodes.join(ends.select(F.col("a").alias("sid")).distinct(), "sid").select("sid", label.alias("label")), "labels")
    while True:
        near = ends.join(labels.select(F.col("sid").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["sid"] == near["a"]).select("sid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        before, step = labels, written(step, "steps")
        # the label's own label
        to = step.select(F.col("sid").alias("to"), F.col("label").alias("far"))
        new = written(step.join(to, F.col("label.sid") == F.col("to")).select("sid", "old", F.least("label", "far").alias("label")), "labels")
        discarded(before, step)
        if new.filter(F.col("old") != F.col("label")).isEmpty():
            discarded(ends)
            return new.select("sid", F.col("label.rep").alias("class_id"))
        labels = new.select("sid", "label")
        labels._written_to = new._written_to


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, report: list | None = None) -> DataFrame:
    """doc_id, text_hash, class_id and n_links of every row of docs(doc_id, text).

    ``n_links``: other rows whose set is at least ``similarity`` alike, copies counted each.  ``report`` gets, for each
    level of splits, the members of large buckets, those of buckets that were alike, and the rows of the next level.
    """
    if not 0 < similarity < 1 or not 0 < recall < 1:
        raise ValueError("similarity and recall lie between 0 and 1")
    runs = runs_for(recall, similarity)
    docs = docs.select("doc_id", "text")
    light = written(_light(docs, runs), "light")
    worded = light.filter(F.col("sid").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = worded.groupBy("sid").agg(first.alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    nodes = written(nodes.select("sid", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "copies", "keys", "sketch", "size"), "nodes")

    leaves, spent = _leaves(nodes, orders_for(similarity), report)
    # a set is in one leaf for each run, in a few for each level of splits: the list is bounded by both
    mine = leaves.groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("leaf", "n"))).alias("mine"))
    mine = written(nodes.join(mine, "sid").select("sid", "copies", "sketch", "size", "mine"), "members")
    blocks = F.when(F.col("m.n") > BUCKET, F.ceil(F.col("m.n") / BUCKET)).otherwise(1).cast("int")
    at = mine.select("sid", "copies", "sketch", "size", F.col("mine.leaf").alias("leaves"), F.explode("mine").alias("m"))
    at = at.select("sid", "copies", "sketch", "size", "leaves", "m.leaf", blocks.alias("blocks"))
    at = at.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "copies", "sketch", "size", "leaves")
    dealt = lambda df: df.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    found = written(dealt(at.drop("copies")).mapInPandas(lambda it: _searched(it, similarity), "member boolean, leaf long, i int, j int, a binary, b binary"), "found")
    pairs = found.filter(~F.col("member")).select("a", "b")
    members = found.filter("member").select("leaf", "i", "j", F.col("a").alias("sid"))

    # the exact sets of what is to be verified, made again from the texts
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(members.select("sid")).distinct()
    wanted = nodes.join(wanted, "sid").select("sid", "rep", "text_hash")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokens_of(batches):
        for b in batches:
            tokens = [shingles(word_hashes(t), WORDS).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"sid": b["sid"], "tokens": tokens})

    sets = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted.withColumnsRenamed({"rep": "_rep", "text_hash": "_hash"}), F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("text_hash") == F.col("_hash"))).select("sid", "text")
    made = written(sets.mapInPandas(tokens_of, "sid binary, tokens array<long>"), "sets")
    sets = made.dropDuplicates(["sid"])
    copies = nodes.select("sid", "copies")
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("tokens").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    links = written(both.filter(shared >= (similarity - 1e-6) * (F.size("ta") + F.size("tb") - shared)).select("a", "b"), "pairs")
    counted = links.join(copies.withColumnRenamed("sid", "b"), "b").select(F.col("a").alias("sid"), F.col("copies").alias("links"))
    counted = counted.unionByName(links.join(copies.withColumnRenamed("sid", "a"), "a").select(F.col("b").alias("sid"), F.col("copies").alias("links")))

    full = members.join(at.select("leaf", "i", "j", "block", "sid", "copies", "leaves"), ["leaf", "i", "j", "sid"]).join(sets, "sid")
    stars = written(dealt(full).mapInPandas(lambda it: _verified(it, similarity), "a binary, b binary, links long"), "stars")
    # links and stars hold all that follows
    discarded(found, made, mine, *spent)
    counted = counted.unionByName(stars.select(F.col("a").alias("sid"), "links")).groupBy("sid").agg(F.sum("links").alias("links"))
    classes = _components(links.unionByName(stars.select("a", "b")), nodes.select("sid", "rep"))

    told = nodes.join(counted, "sid", "left").join(classes, "sid", "left").filter((F.col("copies") > 1) | F.col("links").isNotNull())
    told = told.select("sid", F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = light.select("doc_id", "text_hash", "sid").join(told, "sid", "left")
    return out.select("doc_id", "text_hash", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).cast(kind).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents, all columns, without near duplicates: of each class the document whose id is the class's stays."""
    found = written(join(docs, similarity, recall), "classes")
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "text_hash").agg(F.max("n_links").alias("n_links"), F.count("*").alias("rows"))
    # rows of one id and different texts that are one class: the smallest hash stays
    rival = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_hash"))
    stay = written(stay.withColumn("nth", F.when(F.col("n_links") > 0, rival).otherwise(1)).filter("nth = 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "rows", "n_links"), "stay")
    kept = docs.withColumn("_text", F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    if not stay.filter("rows > 1 and n_links > 0").isEmpty():
        one = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
        kept = kept.withColumn("_nth", F.when(F.col("n_links") > 0, one).otherwise(1)).filter("_nth = 1")
    return kept.select(*[docs[c] for c in docs.columns])
