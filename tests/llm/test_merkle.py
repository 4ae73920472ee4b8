"""The Merkle manifest against a manifest built node by node."""

import hashlib
import random
import zlib

import pytest

from vintagelab.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text=None):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], row[4] if text is None else text)))


def climb(level):
    """All levels over a list of digests."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, at):
    """(place, siblings) of each level over the at-th leaf."""
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((at % 16, "".join(run[: at % 16] + run[at % 16 + 1 :])))
        at //= 16
    return out


def brute(rows):
    """A sorted list of the query's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            proof = way(trees[s], i) + way(top, k)
            d = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                d = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            for at, others in proof:
                d = h(others[: 64 * at] + d + others[64 * at :])
            out.append((str(r[0]), leaf(r), trees[s][-1][0], top[-1][0], h("".join(x for _, x in proof)), d, d == top[-1][0]))
    return sorted(out)


def shown(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("sources,n", [(1, 1), (1, 16), (1, 17), (3, 300), (40, 700), (2, 5000)])
def test_query_equals_brute_force(spark, tmp_path, sources, n):
    rng = random.Random(n)
    rows = [(i, f"s{min(rng.randrange(sources), rng.randrange(sources))}", rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Mixed Case é", "lower only"])) for i in range(n)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert shown(queries.op11_merkle_manifest(spark, str(tmp_path))) == brute(rows)


def test_nulls_repeated_rows_long_texts_and_clashing_names(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "A"), (5, "s", "en", 1, "Same"), (6, None, "en", 1, "x"), (-7, "é", "en", 1, "long text " * 100_000), (10, "z" * 3000, "en", 1, "B")]
    rows += [(5, "s", "en", 1, "Same")] * 600 + [(5, "s", "en", 1, "Other")] * 3
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS root", "'b' AS tree", "'c' AS pos", "'d' AS digest", "'e' AS rid", "'f' AS leaf", "'g' AS changed", "'h' AS block")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and shown(out) == brute(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty, ["doc_id", "text"], "source", "doc_id").collect() == []


def test_proofs_lead_to_the_root_and_no_other_leaf_does(spark):
    docs = spark.range(0, 900).selectExpr("id AS doc_id", "concat('s', id % 7) AS source", "concat('text ', id) AS text")
    rows = merkle.manifest(docs, ["doc_id", "text"], "source", "doc_id").collect()
    assert len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 7
    for r in rows:
        proof = [(x.at, x.siblings) for x in r.proof]
        assert merkle.fold(r.leaf, proof) == r.root == r.folded_root and r.verified
        assert merkle.fold(h(r.leaf), proof) != r.root and r.proof_sha256 == h("".join(x for _, x in proof))


def test_a_column_of_the_result_can_not_be_the_id(spark):
    with pytest.raises(ValueError, match="rename"):
        merkle.manifest(spark.createDataFrame([(1, "s")], "root long, source string"), ["root"], "source", "root")


def test_the_queue_of_a_sweep_stays_small(monkeypatch):
    """A sweep over a whole block holds no more than a run of children for each level."""
    sizes, push = [], merkle.heapq.heappush
    monkeypatch.setattr(merkle.heapq, "heappush", lambda q, x: (push(q, x), sizes.append(len(q))))
    out = list(merkle.upwards((None, 256, i, h(str(i))) for i in range(256)))
    assert out == [(None, 1, 0, climb([h(str(i)) for i in range(256)])[-1][0])] and max(sizes) <= 2 * merkle.RUN
