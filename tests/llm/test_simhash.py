"""SimHash components against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from vintagelab.llm import queries, simhash

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


def slow(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hashes) > len(hashes))


def components(prints):
    """The least id that links reach, for (id, fingerprint) rows."""
    values = sorted({p for _, p in prints})
    up = {v: v for v in values}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                up[top(a)] = top(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return {p: least.get(top(p)) for p in values}


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", "cd ", " ", "\t", "\n", " ", "é", "\x1c", "İ", " "]) for _ in range(rng.randint(0, 200)))
        assert simhash.fingerprint(text) == slow(text)
    long = " ".join(f"w{i % 911}" for i in range(20_000))
    assert simhash.fingerprint(long) == slow(long) and simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


def clustered(rng, centres, each):
    out = set()
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(each):
            out.add(x)
            for _ in range(rng.choice([1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def test_trees_follow_only_edges_within_the_radius(monkeypatch):
    rng = random.Random(2)
    values = clustered(rng, 20, 20) + [rng.getrandbits(64) for _ in range(300)]
    tree = simhash.Tree()
    for v in values:
        tree.add(v)

    def nodes(node):
        return 1 + sum(nodes(c) for c in node[1].values())

    for v in values[::7]:
        for radius in (0, 2, 5):
            assert sorted(tree.within(v, radius)) == sorted({x for x in values if (x ^ v).bit_count() <= radius})
    assert nodes(tree.root) == len(set(values))


def test_bands_part_the_free_bits():
    assert [m.bit_count() for m in simhash.bands(0)] == [21, 21, 22] and sum(simhash.bands(0)) == 2**64 - 1
    m = simhash.bands(0)[1]
    assert all(x & m == m for x in simhash.bands(m)) and sum(x ^ m for x in simhash.bands(m)) == 2**64 - 1 - m


@pytest.mark.parametrize("part", [1, 5, 4096])
def test_links_join_what_all_pairs_join(spark, part):
    rng = random.Random(3)
    hot = rng.getrandbits(64)
    values = {*clustered(rng, 30, 12), *(hot ^ x << 20 for x in range(150)), 0, 1, 2**64 - 1, 2**63}
    prints = [(i, v) for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame([(simhash._signed(v),) for _, v in prints], "fp long").repartition(3)
    rows = simhash.links(df, part).collect()
    links = [(r.a % 2**64, r.b % 2**64) for r in rows]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in links)
    want, up = components(prints), {v: v for v in values}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    for a, x in want.items():
        for b, y in want.items():
            assert (top(a) == top(b)) == (x == y)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        rows.append((i * 3 % 80, " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[len(words) // 2 : len(words) // 2 + 1] = [rng.choice(vocabulary)]
            rows.append((1000 + len(rows), "  ".join(words).upper() + "\n"))
    rows += [(None, "nobody"), (None, "nobody"), (None, None), (5, None), (6, ""), (7, "\t"), (9, "one two"), (9, "one two"), (10, "long " * 50_000), (11, "tie a b c d")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS id", "3 AS component_id", "4 AS root", "5 AS fingerprint")
    table.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [(i, slow(t)) for i, t in rows]
    least = components(prints)
    out = queries.op13_simhash(spark, str(tmp_path))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out.collect())
    assert got == sorted((str(i), f"{p:016x}", str(least[p])) for i, p in prints) and len({x[2] for x in got}) < len({x[1] for x in got})


def test_empty_table_and_unknown_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).collect() == []
    alone = simhash.simhash_components(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].component_id is None and np.array([int(alone[0].fingerprint, 16)], np.uint64)[0] == slow("a b c d")
