"""The pipeline's stages on a small corpus with planted cases, and the registered queries of the subpackage."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    base = tmp_path_factory.mktemp("tables")
    words = [a + b for a in ("ma", "lo", "ti", "re", "su", "ne", "ka") for b in ("n", "ra", "sto", "ling", "ved", "por", "is")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    item = prose(14)
    docs, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        docs.append((i, prose(60) if good else " ".join(w.upper() + "!!" for w in prose(60).split()), "en", "s", 0))
        labels.append((i, int(good), 0))
    good = [d for d in docs if d[0] % 4]
    docs += [(500, good[0][1], "en", "s", 0), (501, good[1][1] + " extra", "en", "s", 0)]
    docs += [(510, prose(60) + " " + item + " " + prose(60), "en", "s", 0), (511, item, "en", "s", 0)]
    docs += [(520, prose(60) + " Mail an@example.com now. " + prose(10), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return f"file://{base}", item


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    base, item = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "packing"]

    kept = stages["quality"](spark, docs, base)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == {i for i in range(400) if i % 4} | {500, 501, 510, 511, 520}

    single = stages["near_duplicates"](spark, kept, base)
    left = {r.doc_id for r in single.collect()}
    assert single.columns == columns and len(left & {1, 500}) == 1 and len(left & {2, 501}) == 1 and left >= ids - {1, 2, 500, 501}

    clean = stages["decontamination"](spark, single, base)
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(got) == left - {511} and item[:-1].lower() not in got[510].text.lower()
    assert all(r.n_chars == len(r.text) for r in got.values())

    safe = stages["pii"](spark, clean, base)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert safe.columns == columns and set(texts) == set(got) and "[EMAIL] now" in texts[520] and sum(texts[i] != got[i].text for i in got) == 1

    packed = stages["packing"](spark, safe, base)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(texts)


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    rows = out.collect()
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and 290 < len({r.doc_id for r in rows}) < 310


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


ODD = [(None, "no id at all", None), (3, None, "x"), (3, None, "x"), (4, "", "x"), (600, None, None), (601, "tie", "x"), (601, "tie", "x"), (602, "word " * 30000, "x"), (603, "mail a0@b.example.com now " * 300, "x")]


def test_stages_take_nulls_repeated_rows_long_texts_and_clashing_names(spark, folder):
    base, item = folder
    odd = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in [*ODD, (604, item, "x"), (605, "x " * 40 + item + " y", "x")]], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 60").union(odd)
    docs = docs.selectExpr("*", *[f"'z' as `{c}`" for c in ("drop", "items", "spans", "base", "n_email", "keep", "class_id", "score", "_text", "_k0", "_row", "_x0", "id", "x", "a.b", "words")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, base)
        if name == "packing":
            assert out.select("doc_id", "start").count() >= docs.count()
            continue
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(list(r)[5:] == ["z"] * 16 for r in rows) and all(r.n_chars == len(r.text) for r in rows if name in ("decontamination", "pii") and r.text is not None)
        if name == "near_duplicates":
            assert sum(r.text in (None, "") for r in rows) == 1 and sum(r.text == "tie" for r in rows) == 1
        if name == "decontamination":
            ids = [r.doc_id for r in rows]
            assert 604 not in ids and ids.count(3) == 3 and next(r for r in rows if r.doc_id == 605).text.replace(".", " ").split() == ["x"] * 40 + ["y"] and sum(r.text is None for r in rows) == 3
        if name == "pii":
            assert len(rows) == docs.count() and next(r for r in rows if r.doc_id == 603).text == "mail [EMAIL] now " * 300


def test_registered_queries_equal_brute_force(spark, tmp_path):
    """op1, op2, op3, op6, op8 and op9 over whole small tables; op4, op5, op7 and op10 have tests of their own."""
    import hashlib
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from vintagelab.llm import queries
    from vintagelab.llm.decontaminate import words_of

    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (12, 30, 4, 0)]
    texts += [texts[0] + " " + items[0], items[1][20:] + " İ! " + items[2], texts[5], None, "", "long " * 9000, texts[7].upper(), "İ.x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (None, items[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pages = [(i, f"u{i}", (t or "") * 20 if i % 3 else "same page " * 200) for i, t in enumerate(texts)] + [(900, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = {name: query(spark, str(tmp_path)).collect() for name, query in queries.queries().items() if name.split("_")[0] in ("op1", "op2", "op3", "op6", "op8", "op9")}

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    at = 0
    for r in sorted(run["op3_token_files"], key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    seen, used = dict.fromkeys(ids, 0), {}
    for r in sorted(run["op1_packing"], key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()} and all([a for a, _ in sorted(u)] == [sum(n for _, n in sorted(u)[:k]) for k in range(len(u))] for u in used.values())
    count = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run["op6_token_counts"]} == {(i, len((t or "").encode()), n, n > 1024) for i, t in rows for n in [len(count.encode(t or "", add_special_tokens=False).ids)]}
    by_payload = {}
    for i, _, h in pages:
        by_payload.setdefault(h or "", []).append(i)
    for r in run["op2_warc"]:
        html = next(h for i, _, h in pages if i == r.page_id) or ""
        top = max(by_payload[html])
        revisit = len(html.encode()) >= 1000 and r.page_id != top
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "revisit" if revisit else "response", top if revisit else None)
    assert len(run["op2_warc"]) == len(pages)
    bench = [(i, words_of(t)) for i, t in [*enumerate(items), (None, items[2])]]
    for r in run["op9_decontamination"]:
        w = words_of(texts[r.doc_id] or "")
        hit, found = set(), set()
        for i, b in bench:
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if b else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
    from test_neardup import brute_classes

    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in run["op8_near_duplicates"]} == {rows[k][0]: c for k, c in want.items()}
    assert {r.doc_id: r.class_size for r in run["op8_near_duplicates"]} == {rows[k][0]: list(want.values()).count(c) for k, c in want.items()}
