"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from vintagelab.llm import queries, spelling

WORDS = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=97, length=5, least=3):
    n = Counter()
    for doc_id, text in rows:
        for w in WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= length:
                n[w] += 1
    v = {w: c for w, c in n.items() if c >= least}
    return chosen(v)


def chosen(v):
    out, form = {}, {}
    for w, c in v.items():
        others = [x for x in v if near(w, x)]
        best = min(others, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= 2 * c else None
        out[w] = [form[w], w, c, len(others), v[form[w]] if form[w] else None]
    for w in v:
        at = w
        while form[at]:
            at = form[at]
        out[w][1] = at
    return {w: tuple(x) for w, x in out.items()}


def shown(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def invented(rng, n):
    """Words of few letters with slips of them, and how often each occurs."""
    out = {}
    for _ in range(n):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 8)))
        out[w] = rng.randint(3, 4000)
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            slip = w[:at] + ("" if kind == 0 else rng.choice("abcÿ")) + w[at + (kind < 2) :]
            if len(slip) >= 5:
                out.setdefault(slip, rng.randint(3, 40))
    return out


def test_pairs_are_all_found_once_however_blocks_are_split(spark):
    v = invented(random.Random(3), 120)
    vocab = spark.createDataFrame(list(v.items()), "word string, n long").repartition(3)
    want = {(a, b) for a in v for b in v if near(a, b)}
    for part in (1, 6, 2048):
        rows = [(r.word, r.near, r.near_n) for r in spelling.near_pairs(vocab, part=part).collect()]
        assert len(rows) == len(want) > 300 and {(a, b) for a, b, _ in rows} == want and all(v[b] == n for _, b, n in rows)


def test_variants_equal_brute_force(spark):
    v = invented(random.Random(4), 90)
    chain = {"chainn": 3, "chain": 6, "chains": 12, "chairs": 24, "chaires": 48, "tieab": 4, "tieac": 8, "tieaa": 8}
    v.update(chain)
    got = shown(spelling.variants(spark.createDataFrame(list(v.items()), "word string, n long")))
    assert got == chosen(v) and got["chainn"][1] == "chaires" and got["tieab"][0] == "tieaa"


def test_query_equals_brute_force_with_nulls_and_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    v = list(invented(rng, 60))
    rows = [(i, " ".join(rng.choice(v) + rng.choice(["", "", ".", "-X", "S"]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    rows += [(None, "nobody knows nobody"), (None, None), (7, None), (8, ""), (9, rows[3][1]), (9, rows[3][1]), (10, "Ünder ünder ÜNDER × ÷ ß" * 4), (11, "word " * 40_000), (12, "x" * 5000 + " " + ("y" * 5000 + " ") * 3), (13, ("y" * 4999 + " ") * 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS near", "4 AS l", "'p' AS p")
    table.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = shown(queries.op12_spelling_variants(spark, str(tmp_path)))
    assert got == brute(rows) and any(x[0] for x in got.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = spelling.spelling_variants(empty)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).collect() == []


def test_tasks_hold_few_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    docs = spark.createDataFrame([(i, "alpha bravo delta hotel india") for i in range(9)], "doc_id long, text string").coalesce(1)
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == dict.fromkeys("alpha bravo delta hotel india".split(), 9)


def test_a_range_over_one_edit_is_passed_over(monkeypatch):
    seen, row = [], spelling._row
    monkeypatch.setattr(spelling, "_row", lambda *a: (seen.append(a), row(*a))[1])
    words = sorted(["aaaa", *(f"zz{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")])
    shared = [0, *(next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(words, words[1:]))]
    assert list(spelling.near(words, shared, 0)) == [] and len(seen) <= 3
