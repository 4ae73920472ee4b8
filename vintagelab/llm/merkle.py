"""Operator 11, a Merkle manifest of a dataset by time-forward processing.

Rows are leaves of a tree for each group, and the groups' roots leaves of one more tree. A tree is numbered once: rows are ordered by
range, and counts of (group, range) give each its place. Then its nodes are processed in the order of their labels. A label is the
last place below a node, and its level, so children come before parents: a task takes a run of blocks of RUN**LEVELS nodes in order,
keeps the digests on their way to parents in a priority queue by label, and passes the blocks' digests on; the queue from one
round to the next is Spark's sort on disk. The reversed sweep begins at the root: a block gets the rest of the proof that all its
nodes share as one message ahead of them, and hands to each node that rest with the siblings below it put first.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, in_rows, no_clash, out_batches, staged

#: Nodes under one parent; levels that one round climbs.
RUN, LEVELS = 16, 2
PROOF = "array<struct<at:int,siblings:string>>"
_PROOF = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))


def digest(text: str) -> str:
    """Lower-case hex SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row's values: `-` for a null, else its bytes in UTF-8, a colon and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(leaf: str, proof: Sequence[tuple[int, str]]) -> str:
    """The root that a leaf and its proof give; a level of the proof is the leaf's place in the run and the digests of the others."""
    for at, siblings in proof:
        leaf = digest(siblings[: 64 * at] + leaf + siblings[64 * at :])
    return leaf


def _steps(n: int) -> int:
    """Levels that a round climbs in a tree of n nodes."""
    k = 0
    while n > 1 and k < LEVELS:
        n, k = -(-n // RUN), k + 1
    return k


def _shrunk(n: int) -> int:
    return -(-n // RUN ** _steps(n))


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes (tree, ...) with n, the nodes of their tree, and pos, their place in it from 0 by `order`; rows equal in it all must be
    interchangeable. No tree passes through one task: ranges are counted, and a range's count is added to those before it."""
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("_part", F.shiftright("_at", 33)), f"{name}-ordered")
    w = Window.partitionBy("tree")
    counts = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col("tree").alias("_tree"), F.col("_part").alias("_p"), "_first", F.sum("_n").over(w).alias("n"), F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(counts, rows["tree"].eqNullSafe(counts["_tree"]) & (rows["_part"] == counts["_p"]))
    out = staged(out.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_tree", "_p", "_at", "_part", "_first", "_before"), f"{name}-placed")
    drop_staged(rows)
    return out


def block() -> Column:
    """The place, a round above, of the node over a node at pos in a tree of n."""
    return F.when(F.col("n") == 1, F.col("pos")).when(F.col("n") <= RUN, F.floor(F.col("pos") / RUN)).otherwise(F.floor(F.col("pos") / RUN**LEVELS)).cast("long")


def upwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(tree, n, pos, digest) of the blocks' top nodes from rows (tree, n, pos, digest) in order, whole blocks of them."""
    queue: list[tuple[int, int, int, str]] = []  # (last place below the parent, its level, the child's place, the child's digest)
    tree, nodes, top = None, 0, 0

    def send(level: int, at: int, value: str) -> None:
        up = at // RUN
        heapq.heappush(queue, ((up + 1) * RUN ** (level + 1) - 1, level + 1, at, value))

    def due(before: int | None) -> Iterator[tuple]:
        while queue and (before is None or queue[0][0] < before):
            label, level, at, value = heapq.heappop(queue)
            children = [value]
            while queue and queue[0][:2] == (label, level):
                children.append(heapq.heappop(queue)[3])
            value = digest("".join(children))
            if level == top:
                yield tree, _shrunk(nodes), at // RUN, value
            else:
                send(level, at // RUN, value)

    for t, n, pos, value in rows:
        if t != tree or n != nodes:
            yield from due(None)
            tree, nodes, top = t, n, _steps(n)
        yield from due(pos)
        send(0, pos, value)
    yield from due(None)


def raised(floor: DataFrame, name: str) -> list[DataFrame]:
    """The floors of the trees: nodes (tree, n, pos, digest), then those LEVELS above, until each tree has one."""
    floors, most = [floor], floor.agg(F.max("n")).first()[0] or 0
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())])
    while most > 1:
        rows = floors[-1].where("n > 1").select("tree", "n", "pos", "digest", block().alias("block")).repartition("tree", "block")
        rows = rows.sortWithinPartitions("tree", "pos").select("tree", "n", "pos", "digest")
        floors.append(staged(rows.mapInArrow(lambda b: out_batches(upwards(in_rows(b)), schema), "tree string, n long, pos long, digest string"), f"{name}-floor"))
        most = _shrunk(most)
    return floors


def downwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(row, proof, subroot, root) of each node from rows (tree, block, pos, n, digest, proof, subroot, root, ...), where ahead of a
    block's nodes is a row at -1 with the proof, subroot and root of the node above them."""
    head, held = None, []

    def handed() -> Iterator[tuple]:
        if not held:
            return
        levels = [[r[4] for r in held]]
        for _ in range(_steps(held[0][3])):
            below = levels[-1]
            levels.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
        proofs = [[tuple(x) for x in head[5]]]
        for below in levels[-2::-1]:
            runs = [(below[i : i + RUN], proofs[i // RUN]) for i in range(0, len(below), RUN)]
            proofs = [[(k, "".join(run[:k]) + "".join(run[k + 1 :])), *rest] for run, rest in runs for k in range(len(run))]
        for r, proof in zip(held, proofs, strict=True):
            yield r, proof, head[6] or r[4], head[7]

    for r in rows:
        if r[2] < 0:
            yield from handed()
            head, held = (*r[:5], [(x["at"], x["siblings"]) for x in r[5]], *r[6:]), []
        else:
            held.append(r)
    yield from handed()


def _headed(floor: DataFrame, heads: DataFrame, extra: list[str]) -> DataFrame:
    """A floor's nodes with each block's head before them, in tasks by blocks."""
    nodes = floor.select("tree", block().alias("block"), "pos", "n", "digest", F.lit(None).cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), *extra)
    first = heads.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "proof", "subroot", "root")
    return nodes.unionByName(first, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _ends(floor: DataFrame, ends: DataFrame) -> DataFrame:
    """(tree, pos, proof, subroot, root) of the top nodes that are on this floor; ends has a row for each tree."""
    tops = floor.where("n = 1").select(F.col("tree").alias("_t"), "pos")
    return tops.join(ends, tops["_t"].eqNullSafe(ends["tree"])).select("tree", "pos", "proof", "subroot", "root")


def lowered(floors: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """Heads (tree, pos, proof, subroot, root) for the blocks of the lowest floor; ends (tree, proof, subroot, root) say how the proof
    of each tree's top node goes on."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("proof", _PROOF), ("subroot", pa.string()), ("root", pa.string())])
    rows = lambda batches: ((r[0], r[2], [{"at": a, "siblings": s} for a, s in proof], sub, root) for r, proof, sub, root in downwards(in_rows(batches)))
    heads = _ends(floors[-1], ends)
    for k in range(len(floors) - 1, 0, -1):
        down = _headed(floors[k], heads, []).mapInArrow(lambda b: out_batches(rows(b), schema), f"tree string, pos long, proof {PROOF}, subroot string, root string")
        heads = staged(down, f"{name}-heads").union(_ends(floors[k - 1], ends))
    return heads


def manifest(df: DataFrame, fields: Sequence[str], group_col: str, id_col: str, changed: Column | None = None, proofs: bool = True) -> DataFrame:
    """A row per row of df: id, group, leaf, subroot, root, proof, proof_sha256, folded_root and verified.

    A leaf is the digest of the row's `fields`. In a group leaves ascend by id (nulls first; of equal ids by leaf); while a tree has
    several nodes, each RUN consecutive ones become the digest of their digests in a row; what remains is the group's subroot. The
    subroots, ordered by group (null first, by bytes), give the root in the same way. proof has for each level the leaf's place in
    its run and the others' digests in a row, from the leaf to the root; proof_sha256 is the digest of all these in a row; without
    `proofs` the column isn't returned. folded_root is what the proof makes of the leaf, or of `changed` where that isn't null (a
    digest of the row as somebody else holds it), and verified tells whether that is the root.

    Any column may be null; a null or repeated id and repeated rows are leaves like others; an empty table gives no rows. Texts are
    hashed whole in the scan and never shuffled. A task holds a block of RUN**LEVELS nodes, however large a group is.
    """
    no_clash([id_col, "group"] if id_col != group_col else [id_col], ["leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])
    leaf = leaf_digest([F.col(c) for c in fields])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("tree"), leaf.alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = placed(rows, ["id", "digest", "rid"], "merkle")
    floors = raised(leaves, "merkle")
    tops = floors[0].where("n = 1").select("tree", "digest")
    for floor in floors[1:]:
        tops = tops.union(floor.where("n = 1").select("tree", "digest"))
    roots = placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], "merkle-root")
    above = raised(roots, "merkle-root")
    end = above[-1].where("n = 1").select("tree", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    schema = pa.schema([("tree", pa.string()), ("proof", _PROOF), ("subroot", pa.string()), ("root", pa.string())])
    each = lambda batches: ((r[8], [{"at": a, "siblings": s} for a, s in proof], r[4], root) for r, proof, _, root in downwards(in_rows(batches)))
    ends = _headed(roots, lowered(above, end, "merkle-root"), ["group"]).mapInArrow(lambda b: out_batches(each(b), schema), f"tree string, proof {PROOF}, subroot string, root string")
    ends = staged(ends, "merkle-ends")
    heads = lowered(floors, ends, "merkle")
    names = [("id", "long"), ("group", "string"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), *([("proof", PROOF)] if proofs else []), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), PROOF: _PROOF}
    last = pa.schema([(n, kinds[k]) for n, k in names])

    def finished(batches):
        for r, proof, sub, root in downwards(in_rows(batches)):
            folded = fold(r[9] or r[4], proof)
            shown = ([{"at": a, "siblings": s} for a, s in proof],) if proofs else ()
            yield (r[8], r[0], r[4], sub, root, *shown, digest("".join(s for _, s in proof)), folded, folded == root)

    out = _headed(leaves, heads, ["id", "changed"]).mapInArrow(lambda b: out_batches(finished(b), last), ", ".join(f"`{n}` {k}" for n, k in names))
    drop_staged(rows)
    return out.withColumnRenamed("id", id_col)
