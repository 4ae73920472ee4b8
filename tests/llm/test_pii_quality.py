import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vintagelab.llm import pii, quality, queries


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (r, ok) in enumerate(rules) for m in re.finditer(r, t) if ok(m[0])]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    pieces = ["a@b.c", "x.y%z@ma-il.example.com", "@", "_d@e.f", "é", "😀", " ", "\n", "1.2.3.4", "300.1.1.1", "001.02.3.255", "1.2.3.4.5", "10.0.0.1", "0.00.000.0256", "4785380592391139", "4465 7583-8288 9437", "4465758382889437", "12", "-", "+1 (663) 555-6869", "+44.20", "+123456789012345678", "a", "..", "5", "(", "+"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a" * 50000 + "@b.cc", "1 " * 30000, "+1" + "." * 30000, "1-" * 20000 + "1", "a.b@" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("clash"))
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert [tuple(s) for s in got[i].base] == want, t
        assert (got[i].n_email, got[i].n_phone) == (sum(k == 0 for k, _, _ in want), sum(k == 3 for k, _, _ in want))


def test_context_finds_identifiers_that_no_base_pattern_knows(spark):
    rng = random.Random(6)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(60):
        card = number(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        if i % 3 == 0:
            rows.append(f"the order was paid, cardno: {card} and the rest of the text")
        elif i % 3 == 1:
            rows.append(f"é note cardno: CU-{number(7)}. and the")
        else:
            rows.append(f"in the year {number(5)} the ship sank and the port closed")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for i, t in enumerate(rows):
        found = [(s["rank"], t[s["start"] : s["end"]]) for s in got[i]]
        assert [k for k, _ in found] == ([2], [4], [])[i % 3], (t, found)
        if i % 3 == 1:
            assert re.fullmatch(r"CU-\d{7}", found[0][1])
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[0] == "the order was paid, cardno: [CARD] and the rest of the text" and clean[1] == "é note cardno: [ID]. and the" and clean[2] == rows[2]


def brute_context(texts):
    """The context spans of each text by the method's rules, over dictionaries."""
    base = [sorted(brute(t)) for t in texts]
    lower = lambda w: w.lower()
    seeds, everywhere, stands = {}, {}, []
    for t, spans in zip(texts, base):
        flat = re.sub("[\n\t\r]", " ", t)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer("[^ ]+", flat)]
        for n in (1, 2):
            for k in range(len(words) - n + 1):
                key = tuple(lower(w[2]) for w in words[k : k + n])
                everywhere[key] = everywhere.get(key, 0) + 1
        for kind in range(4):
            mine = [(a, b) for r, a, b in spans if r == kind]
            every = [m.span() for m in re.finditer([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+){3}", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"][kind], t)]
            for a, b in mine:
                low, high = max((y for _, y in every if y <= a), default=0), min((x for x, _ in every if x >= b), default=len(t))
                left, right = flat[low:a], flat[b:high]
                left = left[: len(left) - len(left.rpartition(" ")[2])].split()
                right = right[len(right.partition(" ")[0]) :].split()
                for side, key in (("L", left[-1:]), ("L", left[-2:]), ("R", right[:1]), ("R", right[:2])):
                    if key:
                        seeds.setdefault((side, tuple(map(lower, key))), []).append(lower(t[a:b]))
    seeds = {p: v for p, v in seeds.items() if len(set(v)) >= pii.LEAST_SEEDS and len(v) >= pii.LEAST_SHARE * everywhere.get(p[1], 1 << 60)}
    for d, (t, spans) in enumerate(zip(texts, base)):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer("[^ ]+", re.sub("[\n\t\r]", " ", t))]
        for k, (a, b, w) in enumerate(words):
            a += len(w) - len(re.sub("^[^A-Za-z0-9À-ɏ+@]+", "", w))
            token = re.sub("(?<=[A-Za-z0-9À-ɏ])[^A-Za-z0-9À-ɏ]+$", "", t[a:b])
            span = (a, a + len(token))
            if token and not any(x < span[1] and y > span[0] for _, x, y in spans):
                for side, key in (("L", words[max(0, k - 1) : k]), ("L", words[k - 2 : k] if k > 1 else []), ("R", words[k + 1 : k + 2]), ("R", words[k + 1 : k + 3] if k + 2 < len(words) else [])):
                    p = (side, tuple(lower(x[2]) for x in key))
                    if p in seeds:
                        stands.append((d, span, token, p))
    edges = {p: {x: (1, 1) for x in v} for p, v in seeds.items()}
    for _, _, token, p in stands:
        apt = int(not re.match("^[a-zß-öø-ÿ]*$", token))
        old = edges[p].get(token.lower(), (0, 0))
        edges[p][token.lower()] = (old[0], max(old[1], apt))
    seed, apt = {x for e in edges.values() for x, v in e.items() if v[0]}, {x for e in edges.values() for x, v in e.items() if v[1]}
    score = {x: float(x in seed) for e in edges.values() for x in e}
    for _ in range(pii.ROUNDS):
        rated = {p: sum(score[x] for x in e) / (len(e) + 1) for p, e in edges.items()}
        doubt = dict.fromkeys(score, 1.0)
        for p, e in edges.items():
            for x in e:
                doubt[x] *= 1 - min(rated[p], 0.999)
        score = {x: 1.0 if x in seed else 0.0 if x not in apt else 1 - doubt[x] for x in score}
    out = [set() for _ in texts]
    for d, span, token, p in stands:
        if rated[p] >= pii.CONFIDENCE and not re.match("^[a-zß-öø-ÿ]*$", token):
            out[d].add(span)
    return [sorted(x) for x in out]


def contexts(rng, n):
    """Texts in which odd addresses, handles, names and numbers with spaces stand where base entities stand elsewhere."""
    words = [f"w{k}" for k in range(40)] + ["the", "and", "of", "über", "x" * 60, "y" * 60 + "z"]
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        mail, phone, ip = f"{rng.choice('abc')}.{i}@mail.example.com", f"+1 ({number(3)}) {number(3)}-{number(4)}", f"10.{i % 250}.0.{rng.randint(1, 250)}"
        odd = rng.choice([f"user_{i}", f"Anna{i}", f"a{i}@localhost", "someone", f"AB-{number(2)}"])
        cue = rng.choice([("E-mail:", mail), ("reach me at", mail), ("call the desk on", phone), ("host " + "q" * 50, ip), ("E-mail:", odd), ("host " + "q" * 50, odd), ("at", rng.choice(words)), ("desk", rng.choice(words))])
        lead, rest = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(2)]
        out.append(f"{lead} {cue[0]} {rng.choice(['', '(', '<'])}{cue[1]}{rng.choice(['', ',', ')', '.'])}{rng.choice([' ', chr(10), '  '])}{rest}")
    return out


def test_op5_spans_equal_brute_force(spark, tmp_path, monkeypatch):
    import hashlib

    texts = contexts(random.Random(31), 300)
    want = brute_context(texts)
    assert 20 < sum(map(len, want)) and any(re.search(r"Anna\d", t[a:b]) for t, w in zip(texts, want) for a, b in w)
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1001, ""), (None, texts[0])]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string").write.parquet(f"{tmp_path}/documents.parquet")
    for most in (pii.BROADCAST_PATTERNS, 0):
        monkeypatch.setattr(pii, "BROADCAST_PATTERNS", most)
        got = queries.op5_pii(spark, str(tmp_path)).collect()
        assert len(got) == len(rows)
        for r in got:
            i = 0 if r.doc_id is None else r.doc_id
            base = brute(texts[i] if i < 1000 else "")
            label = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
            more = [] if r.doc_id is None or i >= 1000 else [(4, a, b) for a, b in want[i]]
            assert r.base_sha256 == hashlib.sha256(label(base).encode()).hexdigest()
            if r.doc_id is not None:
                assert r.spans == label([*base, *more]), texts[i]


def test_many_entities_take_time_in_proportion_and_names_do_not_clash(spark):
    import time

    n = 12000
    long = " ".join(f"user{i}@mail{i}.example.com" for i in range(n))
    df = spark.createDataFrame([(1, long), (1, long), (None, None), (2, "")], "doc_id long, text string").selectExpr("doc_id", "text", "1 as _text", "2 as spans", "3 as base", "4 as `a.b`", "5 as _row", "6 as _k0", "7 as n_email")
    began = time.perf_counter()
    got = pii.redacted(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert time.perf_counter() - began < 60 and len(rows) == 4
    assert [r.text for r in rows if r.doc_id == 1] == [" ".join(["[EMAIL]"] * n)] * 2 and all(list(r)[2:] == [1, 2, 3, 4, 5, 6, 7] for r in rows)


def test_redaction_of_overlaps_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "a@b.cc 1.2.3.4 é a@b.cc", None), (None, "", 1), (2, "+4785380592391139 x", 2)], "doc_id long, text string, spans int")
    got = pii.redacted(df)
    assert got.columns == df.columns
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(["None", "[EMAIL] [IP] é [EMAIL]", "", "+[CARD] x"])
    assert pii.redacted(df.limit(0)).count() == 0 and pii.personal_data(df.limit(0)).count() == 0


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(rng, n):
    words = ["the", "and", "of", "tion", "her", "ander", "ing", "est"]
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) + rng.choice(["", "ing", "er"]) for _ in range(rng.randint(3, 80))]
        kind = rng.randrange(3)
        t = " ".join(w).capitalize() + "." if good else " ".join((x.upper() + "!!", x + "###", w[0])[kind] for x in w)
        rows.append((i, t, int(good)))
    return rows


def test_classifier_on_the_held_out_fold(spark):
    rows = corpus(random.Random(8), 1200)
    docs = spark.createDataFrame([(i, t, 1 - y) for i, t, y in rows], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in rows}
    test = [r for r in got if r.held_out]
    assert len(test) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.scored(docs, quality.train(docs, flipped)).collect()} == {r.doc_id: r.score for r in got}
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word " * 30000)], "doc_id long, text string")
    assert quality.scored(odd, model).count() == 4 and {r.score for r in quality.scored(odd, None).collect()} == {0.5}
    assert quality.train(docs, labels.where("quality = 1")) is None and quality.scored(docs.limit(0), model).count() == 0


def test_dual_descent_reaches_the_optimum_of_a_small_problem():
    rows = [np.array([0]), np.array([0]), np.array([1]), np.array([1])]
    scale, y = np.array([1.0, 1.0]), np.array([1.0, 1.0, -1.0, -1.0])
    w, b = quality.dual_descent(rows, scale, y, np.full(4, 10.0), epochs=200)
    assert np.allclose(w, [1, -1], atol=1e-3) and abs(b) < 1e-3


def test_shape_features_do_not_depend_on_words_and_word_features_do():
    shapes = lambda t: [i for i in quality.features(t).tolist() if i < quality.SPACE]
    assert shapes("The cat sat.") == shapes("One dog ran.") and quality.features("The cat sat.").tolist() != quality.features("One dog ran.").tolist()
    assert shapes("a b a") != shapes("a a a") and len(quality.features("")) == 1
    assert len(quality.features("one two one two")) - len(shapes("one two one two")) == 4


def naive_features(text):
    """The indicators as a dictionary of names, by counting alone."""
    words = text.encode().split()
    shapes = []
    for k, w in enumerate(words):
        kinds = ["A" if 65 <= b <= 90 else "9" if 48 <= b <= 57 else "a" if 97 <= b <= 122 or b >= 128 else chr(b) for b in w]
        shapes.append("".join(c for j, c in enumerate(kinds) if j == 0 or kinds[j - 1] != c) + ("=" if k and words[k - 1] == w else ""))
    one, two = set() if words else {"empty"}, set()
    for order in (1, 2, 3):
        grams = [tuple(shapes[j : j + order]) for j in range(len(shapes) - order + 1)]
        for g in grams:
            one |= {g, *((g, s) for s in (0.05, 0.33) if grams.count(g) >= s * len(grams))}
    plain = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    two |= {tuple(plain[j : j + n]) for n in (1, 2) for j in range(len(plain) - n + 1)}
    return one, two


def test_op7_equals_brute_force(spark, tmp_path):
    rows = corpus(random.Random(12), 150) + [(900, None, 0), (901, "", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, y int").drop("y").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op7_quality(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in rows} and all(r.held_out == held(i) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    feats = {i: naive_features(t or "") for i, t, _ in rows}
    train = [(i, y) for i, _, y in rows if not held(i)]
    n = [sum(y == c for _, y in train) for c in (0, 1)]
    count = {}
    for i, y in train:
        for f in (*feats[i][0], *feats[i][1]):
            count.setdefault(f, [0, 0])[y] += 1
    ratio = {f: np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2)) for f, c in count.items() if sum(c) >= quality.LEAST_ROWS}
    at = {f: k for k, f in enumerate(ratio)}
    x = np.zeros((len(rows), len(at)))
    for k, (i, _, _) in enumerate(rows):
        for part, length in zip(feats[i], (1.0, quality.WORD_PART)):
            for f in part & set(at):
                x[k, at[f]] = ratio[f] * length / len(part) ** 0.5
    index = {i: k for k, (i, _, _) in enumerate(rows)}
    z, y = x[[index[i] for i, _ in train]], np.array([2.0 * y - 1 for _, y in train])
    cost = np.array([len(train) / (2 * n[c]) for c in (y > 0).astype(int)])
    gram, alpha = (z @ z.T + 1) * np.outer(y, y), np.zeros(len(y))
    for _ in range(20000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
    margin = x @ (z.T @ (alpha * y)) + (alpha * y).sum()
    ours = np.array([np.log(got[i].score) - np.log1p(-got[i].score) for i, _, _ in rows])
    slope, shift = np.polyfit(margin, ours, 1)
    assert slope > 0 and np.abs(slope * margin + shift - ours).max() < 0.05 * np.ptp(ours)
    assert [got[i].predicted for i, _, _ in rows] == [int(1 / (1 + np.exp(-slope * m - shift)) >= 0.7) for m in margin]


def test_a_repeated_id_counts_once_and_the_sample_is_bounded(spark, monkeypatch):
    rows = corpus(random.Random(3), 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    one = quality.train(docs, labels)
    two = quality.train(docs.union(docs).union(docs), labels.union(labels))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y, prior: seen.append(sum(map(len, rows))))
    monkeypatch.setattr(quality, "SAMPLE_INDICATORS", 2000)
    quality.train(docs, labels)
    assert 1000 < seen[0] < 2600


def test_accepted_with_odd_rows_and_names(spark):
    rows = corpus(random.Random(5), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    odd = docs.union(docs.limit(1)).union(spark.createDataFrame([(None, None), (1, ""), (1, "")], docs.schema)).selectExpr("doc_id", "text", "1 as score", "2 as predicted", "3 as `a.b`")
    kept = quality.accepted(odd, model)
    passed = {(r.doc_id, t.text) for r, t in zip(quality.scored(odd, model).collect(), odd.collect()) if r.predicted}
    assert kept.columns == odd.columns and {(r.doc_id, r.text) for r in kept.collect()} == passed
    assert quality.accepted(odd.limit(0), model).count() == 0 and quality.accepted(odd, None).count() == odd.count()


def test_hidden_seeds_are_found_again_by_their_context(spark):
    """A third of the identifiers are in a form that no base pattern knows; nearly all of them are found, and little else."""
    rng = random.Random(12)
    leads = ["write to", "kontakt unter", "mobile no", "dial", "reach us via"]
    filler = [a + b for a in ("ma", "lo", "ti", "re", "su") for b in ("n", "ra", "sto", "ling", "ved", "por")]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    known = lambda k: f"{rng.choice(filler)}{rng.randrange(900)}@{rng.choice(filler)}.org" if k % 2 else f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    unseen = lambda k: f"{rng.choice(filler).upper()}-{rng.randrange(10**6):06d}" if k % 2 else f"@{rng.choice(filler)}_{rng.randrange(10**4)}"
    rows, hidden = [], {}
    for i in range(1500):
        lead, text = rng.choice(leads), prose(rng.randint(5, 40))
        kind = rng.random()
        if kind < 0.45:
            text += f" {lead} {known(i)} {prose(8)}"
        elif kind < 0.65:
            secret = unseen(i)
            hidden[i] = (len(text) + len(lead) + 2, secret)
            text += f" {lead} {secret} {prose(8)}"
        elif kind < 0.8:
            text += f" {lead} {prose(6)}"  # the words of the context, and nobody's data
        elif kind < 0.9:
            text += f" B{rng.randrange(10**5)} {prose(5)}"  # a token of that form elsewhere
        rows.append((i, text))
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = {(i, s["start"], s["end"]) for i, spans in got.items() for s in spans if s["rank"] == 4}
    want = {(i, at, at + len(x)) for i, (at, x) in hidden.items()}
    recall, precision = len(found & want) / len(want), len(found & want) / max(1, len(found))
    print(f"hidden identifiers {len(want)}: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.95
