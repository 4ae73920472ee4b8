import random

import numpy as np

from vintagelab.llm import neardup
from vintagelab.llm.decontaminate import words_of


def cells(text):
    return np.sort(neardup.regions(neardup.shingle_hashes(words_of(text))))


def exact(a, b):
    from collections import Counter

    def bag(t):
        w = words_of(t)
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def texts(rng, n, size=150):
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, size))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_similarity_is_exact_and_shingles_do_not_depend_on_place():
    rng = random.Random(1)
    for t in texts(rng, 30):
        other = t.replace("w1", "w2") + " " + " ".join(rng.choices(t.split(), k=20))
        assert abs(neardup.similarity(cells(t), cells(other)) - exact(t, other)) < 1e-12
    a = neardup.shingle_hashes(words_of("a b c d e f g"))
    assert a[2] == neardup.shingle_hashes(words_of("C d, E f g"))[0] and len(neardup.shingle_hashes(words_of("a b"))) == 1
    long = [b"x%d" % (i % 7) for i in range(20000)]
    h = neardup.shingle_hashes(long)
    assert len(h) == 19996 and len(np.unique(h)) == 7


def test_signatures_agree_as_weighted_jaccard_does():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.8, 0.95):
        agreed = []
        for _ in range(60):
            n = int(rng.integers(1, 400))
            x = rng.integers(1, 1 << 63, n).astype(np.uint64)
            both = x[: max(1, int(2 * share * n / (1 + share)))]
            a, b = np.concatenate((both, rng.integers(1, 1 << 63, n - len(both)).astype(np.uint64))), x
            j = len(both) / (2 * n - len(both))
            agreed.append((neardup.signature(neardup.regions(a)) == neardup.signature(neardup.regions(b))).mean() - j)
        assert abs(np.mean(agreed)) < 0.03
    assert 0.6 < np.mean([(neardup.signature(neardup.regions(np.array([1] * 3 + [k], np.uint64))) == neardup.signature(neardup.regions(np.array([1] * 3 + [k + 100], np.uint64)))).mean() for k in range(2, 60)]) - 0 + 0.1 < 0.8


def brute_classes(rows):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            wa, wb = words_of(a), words_of(b)
            if (wa == wb and (wa or a == b)) or (wa and wb and exact(a, b) >= 0.8):
                up[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(root(i), []).append(r[0])
    return {i: min((m for m in members[root(i)] if m is not None), default=None) for i in range(len(rows))}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(4)
    got = neardup.near_duplicates(df).collect()
    want = brute_classes(rows)
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(rows[i][0]), str(c)) for i, c in want.items())
    assert sum(r.keep for r in got) == len({(r.class_id, r.class_size) if r.class_id is not None else r.x for r in got})
    return df


def test_classes_equal_brute_force(spark):
    rng = random.Random(7)
    t = texts(rng, 120)
    t += ["", None, "", "!!!", "???", "!!!", "tiny text", "Tiny  TEXT!", "one", t[0], t[0], t[3].upper()]
    rows = [(1000 - i, x, "c") for i, x in enumerate(t)] + [(None, "only null id", "c"), (1000, t[0], "c")]
    df = check(spark, rows)
    kept = neardup.without_copies(df)
    assert kept.columns == df.columns and kept.count() == len(set(brute_classes(rows).values()))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 8)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(copy), "c"))
    check(spark, rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i % 10] + [(100, j) for j in range(101, 140)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == (i - 1) // 10 * 10 + 1 for i in range(1, 50)) and all(got[j] == 100 for j in range(100, 140))


def test_every_pair_across_components_of_a_bucket_is_checked(spark, monkeypatch):
    """Where the first suggestions give no link, the few pairs that pass are found among the many that fail the check."""
    monkeypatch.setattr(neardup, "PART", 2)
    monkeypatch.setattr(neardup, "forests", lambda sigs, ids: iter([None]))
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(40):
        copy = list(base)
        for j in rng.sample(range(200), 4):
            copy[j] = f"z{i}_{j}"
        rows.append((i, " ".join(copy), "c"))
        if i % 8 == 0:
            near = list(copy)
            for j in rng.sample(range(200), 3):
                near[j] = f"y{i}_{j}"
            rows.append((100 + i, " ".join(near), "c"))
    assert 30 < len(set(brute_classes(rows).values())) < len(rows)
    check(spark, rows)


def test_texts_of_equal_signature_do_not_fill_a_part(spark, monkeypatch):
    """Orders of segments with the same words between them hold the same shingles, so their signatures are equal."""
    monkeypatch.setattr(neardup, "PART", 8)
    real = neardup.forests

    def bounded(sigs, ids):
        assert len(ids) <= 24
        yield from real(sigs, ids)

    monkeypatch.setattr(neardup, "forests", bounded)
    rng = random.Random(3)
    rows = [(i, "a b c d " + " a b c d ".join(rng.sample([f"s{j}" for j in range(9)], 9)) + " a b c d", "c") for i in range(60)]
    rows += [(100 + i, t, "c") for i, t in enumerate(texts(rng, 10))]
    check(spark, rows)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    t = texts(random.Random(9), 6)
    rows = [(1, t[0]), (1, t[0]), (None, t[0]), (None, t[0]), (2, t[1]), (None, None), (3, ""), (4, None), (2, t[1] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as _x0", "2 as _id", "3 as id", "4 as x", "5 as keep", "6 as _k1", "7 as `a.b`", "8 as node")
    kept = neardup.without_copies(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert len(got) == len({c for c in brute_classes(rows).values()}) and all(list(r)[2:] == [1, 2, 3, 4, 5, 6, 7, 8] for r in got)
    assert neardup.without_copies(df.limit(0)).count() == 0
