"""Operator 13, SimHash near-duplicates by BK-trees.

Fingerprints within RADIUS bits of each other agree on one of RADIUS + 1 bands of bits, so a shard is what agrees on a band. A shard's
fingerprints make a BK-tree, whose children are keyed by their distance to the parent, and are looked up in it along the edges that
the radius allows. A shard of over PART fingerprints is split again, on bands of the bits that its fingerprints needn't share, until
it fits; when 12 such bits are left no shard can be larger. A shard gives a spanning forest of its links, and components are found
from these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, in_rows, out_batches, staged, text_or_empty
from .neardup import components

BITS, RADIUS = 64, 2
#: Fingerprints in a tree; no fewer than 2**12, which is what 12 free bits can hold.
PART = 4096
_FREE = 12


def fingerprint(text: str, n: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's runs of n words: a bit is set if it is set in over half of the runs' hashes (XXH64); 0 without words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    total, runs = np.zeros(BITS, np.int64), len(words) - n + 1
    for at in range(0, runs, 8192):
        some = words[at : at + 8192 + n - 1]
        size = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(size + 1) - 1
        starts, ends = (ends - size)[: len(some) - n + 1].tolist(), ends[n - 1 :].tolist()
        joined, of = memoryview(b" ".join(some)), xxhash.xxh64_intdigest
        hashes = np.fromiter((of(joined[a:b], seed) for a, b in zip(starts, ends)), "<u8", len(starts))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > runs, bitorder="little").view("<u8")[0])


class Tree:
    """A BK-tree of integers under Hamming distance."""

    def __init__(self):
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            if d not in node[1]:
                node[1][d] = [x, {}]
                return
            node = node[1][d]

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Those within the radius; of a node's edges only those that can lead there are followed."""
        left = [self.root] if self.root else []
        while left:
            value, children = left.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                yield value
            if len(children) <= 2 * radius:
                left += [c for k, c in children.items() if -radius <= k - d <= radius]
            else:
                left += [children[k] for k in range(d - radius, d + radius + 1) if k in children]


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links within the radius that join all that such links join, one fewer than the values at most."""
    tree, up = Tree(), {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x in values:
        for y in tree.within(x, radius):
            a, b = top(x), top(y)
            if a != b:
                up[a] = b
                yield x, y
        tree.add(x)


def bands(mask: int) -> list[int]:
    """mask with one of RADIUS + 1 runs of its zero bits set in each."""
    free, parts = [i for i in range(BITS) if not mask >> i & 1], RADIUS + 1
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(shards: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, value, fp) of each row's narrower shards; masks are those that the rows have."""
    which = F.lit(None).cast("array<bigint>")
    for m in masks:
        which = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(b)).cast("long") for b in bands(m)])).otherwise(which)
    return shards.select("fp", F.explode(which).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def links(prints: DataFrame, part: int = PART) -> DataFrame:
    """(a, b): links of distinct fingerprints fp that join all within RADIUS bits of each other; a shard is bounded by `part`, or by
    2**12 where few bits are free."""
    shards, masks, found = _split(prints.select(F.lit(0).cast("long").alias("mask"), "fp"), [0]), bands(0), []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        key, held = None, []
        for mask, value, fp in in_rows(batches):
            if (mask, value) != key:
                yield from forest(held, RADIUS)
                key, held = (mask, value), []
            held.append(fp & (1 << 64) - 1)
        yield from forest(held, RADIUS)

    signed = lambda batches: ((_signed(a), _signed(b)) for a, b in rows(batches))
    while True:
        shards = staged(shards, "simhash-shards")
        sizes = shards.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        small = F.col("c") <= part
        if BITS - masks[0].bit_count() <= _FREE:
            small = F.lit(True)
        known = staged(shards.hint("merge").join(sizes, ["mask", "value"]).withColumn("small", small), "simhash-sized")
        ready = known.where("small").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").select("mask", "value", "fp")
        found.append(staged(ready.mapInArrow(lambda b: out_batches(signed(b), schema), "a long, b long"), "simhash-links"))
        drop_staged(shards)
        large = known.where("NOT small").select("mask", "fp")
        if large.isEmpty():
            break
        shards, masks = _split(large, masks), [b for m in masks for b in bands(m)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """A row per row of df: id, fingerprint (16 hex digits) and component_id, the least id that links of fingerprints at RADIUS or
    fewer differing bits reach.

    Words are what white space parts, with A-Z in lower case; runs of three count as often as they occur, a shorter text is one run.
    Null and empty texts, and those of white space alone, have fingerprint 0, which is linked like others. A null id is passed over
    by the least id, which is null if all are; repeated ids and rows each give a row; an empty table gives none; texts are taken
    whole, a few thousand runs at a time; other columns are not read. Equal fingerprints are folded before all else, so a group of
    copies of any size is one entry of a tree.
    """
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
    rows = lambda batches: ((i, _signed(fingerprint(t))) for i, t in in_rows(batches))
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    docs = staged(docs.mapInArrow(lambda b: out_batches(rows(b), schema), "id long, fp long"), "simhash-prints")
    prints = staged(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(prints, part)).withColumnRenamed("node", "fp")
    named = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(named.join(least, "root").select("fp", "component_id"), "simhash-named")
    drop_staged(prints)
    return docs.hint("merge").join(named, "fp").select(F.col("id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id")
