"""Operator 8, near-duplicates by DartMinHash signatures and banded joining.

A document is a multiset of five-word shingles. Each unit of a shingle's weight is a region on which darts fall as a Poisson
process in rank, the same for every document that holds the region; a document keeps, of the darts below a rank that it expects
about K ln K + 2K of, the earliest one for each of K coordinates. Two documents agree on a coordinate with the probability of
their weighted Jaccard similarity. Documents that agree on all rows of a band meet in a bucket; there the signatures suggest
links (maximum spanning forests, so a bucket of m documents suggests O(m) of them), the texts of suggested pairs decide exactly,
the pairs across components that were not suggested are checked in blocks, and the classes are the connected components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, in_rows, out_batches, positional, staged, text_or_empty
from .decontaminate import words_of

#: Coordinates; rows of a band (16 bands: a pair of similarity 0.8 meets in one with probability 0.9998).
K, ROWS = 64, 4
BANDS = K // ROWS
DARTS = K * math.log(K) + 2 * K
SIMILARITY = 0.8
#: Agreeing coordinates from which a pair is suggested: four standard deviations below what similarity 0.8 gives.
LEAST_AGREED = 38
#: Documents in a part of a bucket; larger buckets are dealt into parts, and then every pair of parts is visited.
PART = 1024
#: Edge-disjoint spanning forests suggested in a bucket at first; pairs that these leave out are met by crossing().
FORESTS = 3
SUGGESTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
_U = np.uint64
_BASE, _GOLD = 0x9E3779B97F4A7C15 | 1, _U(0x9E3779B97F4A7C15)
_powers = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 14, 2 * len(_powers[0]))
        each = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, b, _U)
            x[0] = 1
            each.append(np.cumprod(x, dtype=_U))
        _powers = (each[0], each[1])
    return _powers


def shingle_hashes(words: list[bytes], n: int = 5) -> np.ndarray:
    """A 64-bit hash of each run of n words (of all words, where they are fewer), in order; none without words."""
    if not words:
        return np.zeros(0, _U)
    n, out = min(n, len(words)), []
    for at in range(0, len(words) - n + 1, 8192):
        some = [w if len(w) <= 512 else hashlib.md5(w).hexdigest().encode() for w in words[at : at + 8192 + n - 1]]
        raw = np.frombuffer(b" ".join(some) + b" ", np.uint8)
        up, down = _powers_upto(len(raw) + 1)
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=total[1:])
        ends = np.flatnonzero(raw == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(some) - n + 1]
        ends = ends[n - 1 :]
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _GOLD))
    return np.concatenate(out)


def regions(hashes: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the c-th occurrence of a shingle is a region of its own."""
    kinds, n = np.unique(hashes, return_counts=True)
    if len(kinds) == len(hashes):
        return mix(kinds + _GOLD)
    c = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(kinds, n) + (c.astype(_U) + _U(1)) * _GOLD)


def darts(cells: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, hashes) of the darts of rank under `below` on each region: gaps between ranks are exponential, from hashes."""

    def gap(c: np.ndarray, j) -> np.ndarray:
        u = (mix(c + (j + _U(1)) * _U(0xD1342543DE82EF95)) >> _U(11)).astype(np.float64)
        return -np.log((u + 0.5) * 2.0**-53)

    step = int(below + 4 * math.sqrt(below) + 4) if below >= 1 else 1
    ranks, found, rank, j = [], [], np.zeros(len(cells)), 0
    while len(cells):
        js = np.arange(j, j + step).astype(_U)
        at = rank[:, None] + np.cumsum(gap(cells[:, None], js[None, :]), axis=1)
        inside = at < below
        ranks.append(at[inside])
        found.append(mix(mix(cells)[:, None] + (js[None, :] + _U(1)) * _GOLD)[inside])
        on = inside[:, -1]
        cells, rank, j = cells[on], at[on, -1], j + step
    return np.concatenate(ranks) if ranks else np.zeros(0), np.concatenate(found) if found else np.zeros(0, _U)


def signature(cells: np.ndarray, k: int = K) -> np.ndarray:
    """16 bits of the earliest dart of each coordinate; cells must not be empty."""
    below = (k * math.log(k) + 2 * k) / len(cells)
    while True:
        rank, dart = darts(cells, below)
        where = (dart >> _U(32)) % _U(k)
        order = np.argsort(-rank, kind="stable")
        out, hit = np.zeros(k, np.uint16), np.zeros(k, bool)
        out[where[order]] = (dart[order] & _U(0xFFFF)).astype(np.uint16)
        hit[where] = True
        if hit.all():
            return out
        below *= 2


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets, each as sorted region hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def forests(sigs: np.ndarray, ids: list[int]) -> Iterator[tuple[int, int] | None]:
    """(id, id) of edge-disjoint maximum spanning forests over the pairs that agree on LEAST_AGREED coordinates (Prim's
    method, a tree after another; of equals the first in the order given), and None at the end if such pairs are left."""
    m = len(ids)
    agreed = np.zeros((m, m), np.int16)
    for i in range(m - 1):
        agreed[i, i + 1 :] = agreed[i + 1 :, i] = (sigs[i + 1 :] == sigs[i]).sum(axis=1)
    agreed[agreed < LEAST_AGREED] = 0
    for _ in range(FORESTS):
        if not agreed.any():
            return
        best, parent, outside = np.zeros(m, np.int16), np.full(m, -1), np.ones(m, bool)
        for _ in range(m):
            k = int(np.where(outside, best, -1).argmax())
            outside[k] = False
            if best[k]:
                p = int(parent[k])
                agreed[k, p] = agreed[p, k] = 0
                yield min(ids[k], ids[p]), max(ids[k], ids[p])
            nearer = agreed[k] > best
            best[nearer], parent[nearer] = agreed[k][nearer], k
    if agreed.any():
        yield None


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), the root being its component's least node.

    Alternating star contraction: each node's larger neighbours, then its smaller ones and itself, are tied to its least
    neighbour, until all are stars; every round is written, so none is computed again. Nodes in no edge aren't returned."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = staged(small.distinct(), "edges")
        ends = after.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(after.select("v", F.lit(0), F.lit(1)))
        unfinished = ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low + high > 1")
        drop_staged(now)
        now = after
        if unfinished.isEmpty():
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A staged row per document: rid (unique), id, x (hash of the text), words (hash of its words) and sig (null without words)."""
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("x", pa.int64()), ("words", pa.binary()), ("sig", pa.binary())])

    def rows(batches):
        for rid, i, x, text in in_rows(batches):
            words = words_of(text)
            if words:
                yield rid, i, x, hashlib.md5(b" ".join(words)).digest(), signature(regions(shingle_hashes(words))).tobytes()
            else:
                yield rid, i, x, hashlib.md5(b" " + text.encode("utf-8")).digest(), None

    found = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = found.select(F.monotonically_increasing_id().alias("rid"), "id", F.xxhash64("text").alias("x"), "text")
    return staged(found.mapInArrow(lambda b: out_batches(rows(b), schema), "rid long, id long, x long, words binary, sig binary"), "signatures")


def suggested(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, key) from buckets: members (key, n, node), sigs (node, sig); a bucket of over PART is dealt into parts. A row of
    a key alone tells that pairs of this bucket, or of one of its parts, were not suggested."""
    part = F.pmod(F.xxhash64("sig", "key"), F.ceil(F.col("n") / PART))
    parts = members.hint("merge").join(sigs, "node").withColumn("part", part).groupBy("key", "part").agg(F.collect_list(F.struct("node", "sig")).alias("m")).where(F.size("m") > 1).select("key", "m")

    def rows(batches):
        for key, m in in_rows(batches):
            m = sorted((x["sig"], x["node"]) for x in m)
            for pair in forests(np.stack([np.frombuffer(s, np.uint16) for s, _ in m]), [i for _, i in m]):
                yield (*pair, None) if pair else (None, None, key)

    return parts.mapInArrow(lambda b: out_batches(rows(b), SUGGESTED, count=1 << 16), "a long, b long, key long").distinct()


def salted(members: DataFrame, keys: DataFrame) -> DataFrame:
    """members (key, w, node) joined with keys (key, w, ...) of their buckets of w members, a part of about PART of a bucket at a
    time, so that a large bucket's rows are read by as many tasks as it has parts."""
    parts = F.ceil(F.col("w") / PART).cast("long")
    left = members.withColumn("salt", F.pmod(F.xxhash64("node"), parts))
    right = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("w")
    return left.join(right, ["key", "salt"]).drop("salt")


def crossing(members: DataFrame, cells: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Links (a, b) across components from buckets: members (key, w, band, node), w of them in each; cells (node, sig, cells).

    A bucket's largest component and its other nodes are dealt into parts of about PART, and each pair of parts of which one
    isn't of the largest component is a block, so that every pair across components is met, and no task holds a bucket. In a
    block the pairs that agree on LEAST_AGREED coordinates are checked on their shingles, each pair in the first band only in
    which it agrees; a block returns links that join its components, one less than these at most, and never pairs that fail."""
    held = members.hint("merge").join(roots.withColumnRenamed("root", "r"), "node", "left").withColumn("r", F.coalesce("r", "node"))
    sizes = held.groupBy("key", "r").agg(F.count(F.lit(1)).alias("c"), F.first("w").alias("w"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("c", "r")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.first("w").alias("w")).where("kinds > 1")
    sizes = sizes.select("key", "w", F.col("top.r").alias("main"), F.ceil(F.col("top.c") / PART).alias("p"), F.ceil((F.col("n") - F.col("top.c")) / PART).alias("q"))
    held = salted(held, sizes).withColumn("h", F.xxhash64("node"))
    held = held.withColumn("t", F.when(F.col("r") == F.col("main"), F.pmod("h", "p")).otherwise(F.col("p") + F.pmod("h", "q")).cast("long"))
    first = F.when(F.col("t") < F.col("p"), F.col("p")).otherwise(F.lit(0))
    held = held.hint("merge").join(cells, "node").select("key", "band", "node", "r", "sig", "cells", "t", F.explode(F.sequence(first.cast("long"), (F.col("p") + F.col("q") - 1).cast("long"))).alias("o"))
    blocks = held.groupBy("key", "band", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j")).agg(F.collect_list(F.struct("t", "node", "r", "sig", "cells")).alias("m")).where(F.size("m") > 1)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                _, band, i, j, m = (c[0].as_py() for c in batch.slice(at, 1).columns)
                yield from _across([x for x in m if x["t"] == i], [x for x in m if x["t"] == j], i == j, band, least)

    return blocks.mapInArrow(lambda b: out_batches(rows(b), schema), "a long, b long").distinct()


def _across(one: list, two: list, same: bool, band: int, least: float) -> Iterator[tuple]:
    """crossing() in a block: the pairs of each of `two` with those of `one` (before it, if they are the same)."""
    if not one or not two:
        return
    sigs, roots = np.stack([np.frombuffer(x["sig"], np.uint16) for x in one]), np.array([x["r"] for x in one])
    sets = [np.frombuffer(x["cells"], _U) for x in one]
    sizes = np.array([len(c) for c in sets])
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts, inside, up = np.cumsum(sizes) - sizes, np.zeros(len(known) + 1, bool), {}

    def top(r):
        while r in up:
            r = up[r]
        return r

    for k, x in enumerate(two):
        equal = sigs == np.frombuffer(x["sig"], np.uint16)
        fit = (equal.sum(axis=1) >= LEAST_AGREED) & (roots != x["r"])
        if same:
            fit[k:] = False
        fit &= equal.reshape(len(one), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        if not fit.any():
            continue
        mine = np.frombuffer(x["cells"], _U)
        at = np.searchsorted(known, mine)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == mine)]
        inside[at] = True
        both = np.add.reduceat(inside[ids], starts, dtype=np.int64)
        inside[at] = False
        for h in np.flatnonzero(fit & (both >= least * (sizes + len(mine) - both))):
            if top(int(roots[h])) != top(x["r"]):
                up[top(int(roots[h]))] = top(x["r"])
                yield min(one[h]["node"], x["node"]), max(one[h]["node"], x["node"])


def cells_of(texts: DataFrame) -> DataFrame:
    """(node, cells) of (node, text): the text's regions, sorted."""
    schema = pa.schema([("node", pa.int64()), ("cells", pa.binary())])
    rows = lambda batches: ((n, np.sort(regions(shingle_hashes(words_of(t)))).tobytes()) for n, t in in_rows(batches))
    return texts.mapInArrow(lambda b: out_batches(rows(b), schema), "node long, cells binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a similarity of `least` or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def rows(batches):
        last, mine = None, None
        for a, b, ta, tb in in_rows(batches):
            if last != a:
                last, mine = a, np.sort(regions(shingle_hashes(words_of(ta))))
            if similarity(mine, np.sort(regions(shingle_hashes(words_of(tb))))) >= least:
                yield a, b

    # The least of a group may be in many pairs: its text comes last, by a join whose larger side Spark splits.
    both = pairs.select("a", "b").hint("merge").join(two, "b").hint("merge").join(one, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(lambda b: out_batches(rows(b), schema), "a long, b long")


def near_duplicates(df: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, class_id (the least id of its class), class_size, keep and x (hash of its text).

    keep is true for one row of each class. Documents are in one class if links join them: equal words in equal order, or a
    weighted Jaccard similarity of five-word shingles of `least` or more, checked on the whole texts. A null text is empty;
    texts without words are copies of each other only if equal; texts under five words are one shingle. A null id sorts last in
    its class (class_id is null if all are); repeated rows are copies; an empty table gives none; other columns are not read. A text
    of any length is hashed whole by one task; what a block holds of one is 8 bytes for each of its shingles.

    Copies are folded by partial aggregation before anything else, and then texts of equal signature, each suggested with one of
    them; buckets are met by key with their counts first, and parts of a bucket are bounded, also where buckets are joined by
    key; other joins that a frequent key can skew are plain ones that Spark splits. Where pairs of a bucket weren't
    suggested and it still holds several components, each pair across them that agrees on LEAST_AGREED coordinates is checked
    on its shingles within a block, so the number of rows stays in proportion to the members and the parts of their buckets.
    """
    rows = signatures(df, id_col, text_col)
    nodes = rows.groupBy("words").agg(F.min("rid").alias("node"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(nodes, "nodes")
    firsts = rows.where("sig is not null").hint("merge").join(nodes.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), "id", "x", "sig")
    firsts = staged(firsts, "firsts")
    folds = staged(firsts.groupBy("sig").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("same")), "folds")
    alike = firsts.join(folds.where("same > 1").select("sig", F.col("node").alias("a")), "sig").where("a <> node")
    alike = staged(alike.select("a", F.col("node").alias("b")), "alike")
    bands = folds.select("node", "same", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring("sig", b * 2 * ROWS + 1, F.lit(2 * ROWS)))).alias("band", "bits"))
    bands = bands.select("node", "same", "band", F.xxhash64("band", "bits").alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("w")).where("w > 1")
    buckets = staged(buckets, "counts")
    members = staged(bands.drop("same").hint("merge").join(buckets, "key"), "buckets")
    sigs = firsts.select("node", "sig")
    found = staged(suggested(members.where("n > 1"), sigs), "pairs")
    pairs = found.where("a IS NOT NULL").select("a", "b").union(alike)
    met = members.select("node").union(alike.select("b")).distinct()
    who = firsts.hint("merge").join(met, "node").select("node", "id", "x")
    source = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("text"))
    links = staged(verified(pairs, _texts(source, pairs, who), least), "links")
    roots = components(links)
    left = found.where("a IS NULL").select("key").union(members.where((F.col("n") > PART) | (F.col("w") > F.col("n"))).select("key")).distinct()
    left = staged(left.join(buckets.select("key", "w"), "key"), "keys")
    if not left.isEmpty():
        members = members.select("key", "w", "band", "node")
        members = members.union(members.join(alike.withColumnRenamed("a", "node"), "node").select("key", "w", "band", F.col("b").alias("node")))
        members = staged(salted(members, left), "open")
        nodes_in = members.select("node").distinct()
        cells = staged(cells_of(_texts(source, nodes_in.select(F.col("node").alias("a"), F.col("node").alias("b")), who, few=True)).join(sigs, "node"), "cells")
        more = staged(crossing(members, cells, roots, least), "links")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    named = nodes.hint("merge").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(classes, "root").select("words", "node", "class_id", "class_size", (F.col("node") == F.col("root")).alias("first"))
    named = staged(named, "classes")
    for old in (firsts, folds, alike, buckets, members, links):
        drop_staged(old)
    out = rows.select("rid", "id", "x", "words").hint("merge").join(named, "words")
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("first") & (F.col("rid") == F.col("node"))).alias("keep"), "x")


def _texts(source: DataFrame, pairs: DataFrame, who: DataFrame, few: bool = False) -> DataFrame:
    """(node, text) of the pairs' ends; if these can be few, they are staged, so that Spark knows whether to broadcast them."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ends = who.hint("merge").join(ends, "node")
    keyed = source.withColumn("_x", F.xxhash64("text"))
    ends, keyed = (staged(ends, "ends"), keyed) if few else (ends, keyed.hint("merge"))
    return keyed.join(ends, (F.col("_x") == F.col("x")) & F.col("_id").eqNullSafe(F.col("id"))).select("node", "text")


def without_copies(df: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns, whatever their names, with one row of each class of near-duplicates, that of the row near_duplicates() keeps.

    Rows are found again by id (a null one equals a null one) and text; of rows that share both, the first of a class stays where
    it is kept, whichever of them that is. Null texts are empty ones; an empty table gives none."""
    at, who = df.columns.index(text_col), df.columns.index(id_col)
    rows = positional(df).withColumn("_id", F.col(f"_k{who}").cast("long")).withColumn("_x", F.xxhash64(text_or_empty(f"_k{at}")))
    found = staged(near_duplicates(rows.select(F.col("_id").alias("id"), F.col(f"_k{at}").alias("text")), least, "id", "text"), "classes")
    gone, kept = found.where(~F.col("keep")).select("id", "x"), found.where("keep").select("id", "x")
    match = lambda t: rows["_id"].eqNullSafe(t["id"]) & (rows["_x"] == t["x"])
    if kept.join(gone, kept["id"].eqNullSafe(gone["id"]) & (kept["x"] == gone["x"]), "left_semi").isEmpty():
        out = rows.hint("merge").join(gone, match(gone), "left_anti")
    else:
        out = rows.hint("merge").join(kept, match(kept), "left_semi").dropDuplicates(["_id", "_x"])
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(df.columns)])
