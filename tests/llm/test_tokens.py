import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vintagelab.llm import packing, token_files, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b", "x<|endoftext|>y z", "Don't stop.\n\n  Now 12,345 … É́ \xa0 ΑΣ ΣΑΣ", "word " * 5000, "x" * 3000, "tab\tt\x1cu", "same text", "same text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", 0), (9, "same text", "en", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int").repartition(3)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs):
    got = {(r.doc_id, r.n_bytes): r for r in tokens.token_counts(docs, BYTE).collect()}
    assert tokens.token_counts(docs, BYTE).count() == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        n = len(ids_of(BYTE, t))
        assert (got[i, len((t or "").encode())].n_tokens, got[i, len((t or "").encode())].over_limit) == (n, n > 1024)


def test_token_files_round_trip(docs, spark):
    manifest = token_files.write_token_files(docs, WORD)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    want = sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(-1, "no id"), (9, "same text")])
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array(ids_of(WORD, t) + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (None if i < 0 else i, at, len(ids), ids.tobytes())
        at += len(ids)
    some = token_files.read_token_files(manifest, [3, 6]).collect()
    assert sorted(r.doc_id for r in some) == [3, 6]


def test_reader_fetches_only_the_frames_asked_for_and_checks_them(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 100)
    w = token_files.ShardWriter(f"file://{tmp_path}", 2)
    for i in range(50):
        w.add(i, np.arange(i + 1, dtype="<u4"))
    uri, docs, n = w.close()
    assert (docs, n) == (50, 1275)
    r = token_files.ShardReader(uri)
    assert [list(x) for _, x in r.read([7])] == [list(range(8))] and r.fetched == 1
    import zstandard

    raw = open(uri.removeprefix("file://"), "rb").read()
    assert zstandard.ZstdDecompressor().decompressobj().decompress(raw)[:2] == b"\0\0"
    bad = bytearray(raw)
    bad[int(r.starts[3]) + 12] ^= 1
    (tmp_path / "bad.zst").write_bytes(bad)
    with pytest.raises(Exception):
        list(token_files.ShardReader(f"file://{tmp_path}/bad.zst").read())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert tokens.token_counts(none, BYTE).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, WORD)).count() == 0
    assert packing.pack(none, WORD).count() == 0


def test_packing_places_each_id_once_and_pads_little(docs):
    rows = packing.pack(docs, WORD).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.frombuffer(bytes(r.ids), "<u4").tobytes()) and len(r.ids) == 4 * r.length
    for i, t in enumerate(TEXTS):
        if i == 9:
            continue
        want = ids_of(WORD, t) + [1]
        got = sorted(by_doc[i, len(want)], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in got]).tolist() == want
    padding = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(seq) <= 64
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 16 * len(by_seq)


def test_packing_obeys_all_three_limits_without_cuts():
    rng = np.random.default_rng(1)
    rows = [(i, np.arange(n, dtype="<u4"), np.arange(n) >= n - int(n * f / 2)) for i, (n, f) in enumerate(zip(rng.integers(1, 500, 3000), rng.random(3000)))]
    bins = list(packing.pack_ids(iter(rows), (512, 4, 256), False))
    assert sorted(p[0] for b in bins for p in b) == list(range(3000))
    for b in bins:
        assert sum(len(p[2]) for p in b) <= 512 and len(b) <= 4 and sum(packing.bearing(p) for p in b) <= 256
    least = max(sum(len(r[1]) for r in rows) / 512, sum(r[2].sum() for r in rows) / 256, 3000 / 4)
    assert len(bins) <= 1.25 * least


def test_ids_and_counts_equal_the_library_for_letters_beside_marks():
    """Each character from U+0001 to U+2100, and others, beside marks; the dotted capital I among them."""
    import random

    r = random.Random(5)
    marks = ".,!?;:#$%&*|\"()'-_/<=>[]{}~^`@+\\0a1"
    texts = ["İ!", "aİ.b", "Σİ;", "İİ İ\u0307!"]
    for c in [*range(1, 0x2101), 0x3000, 0x3042, 0x4E00, 0xAC00, 0xFB01, 0xFF21, 0x10400, 0x1D400, 0x1F600]:
        ch, m, n = chr(c), r.choice(marks), r.choice(marks)
        texts += [f"a{ch}{m}b {ch}{n} {ch}", f"{ch}{ch}{m} x{m}{ch}Y {m}{ch} Z"]
    pool = [chr(c) for c in [*range(32, 127)] * 3 + [9, 10, 11, 12, 13, 28, 31, 0x85, 0xA0, 0x130, 0x131, 0x149, 0x1E9E, 0x3A3, 0x3C2, 0x2028, 0x301, 0x307, 0xDF, 0x17F, 0x212A] + [*range(0xC0, 0x180)]]
    texts += ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    for path, counts in ((WORD, False), (BYTE, True)):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        enc = tokens.PieceEncoder(path, counts)
        if counts:
            assert enc.encode(texts) == list(map(len, want))
        else:
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_ids(texts)] == want
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want


def test_one_id_in_many_rows_is_dealt_to_several_tasks(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr("cast(7 as long) as doc_id", "'same words here' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(rows, WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.start for r in got] == list(range(0, 4000 * got[0].n_tokens, got[0].n_tokens))


def test_ids_equal_the_library_where_marks_follow_capitals(spark):
    """A ring above y composes with the small letter alone, so composing and lower-casing don't commute."""
    rng = random.Random(23)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    enc = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [*"HJTWYaehjtwyZΑΗΙΥΩΡαυσΣ", "Ϊ", "ΐ", "É", "İ", "ŷ"]
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = ["Y̊", "T̈ H̱", "W̊ord J̌", "J̣̌.", "Ϊ́", *("Y" + m for m in marks)]
    for _ in range(6000):
        texts.append("".join(rng.choice([*letters, rng.choice(marks), rng.choice(marks), " ", "\n", ".", "x9"]) for _ in range(rng.randint(1, 12))))
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode_ids(texts) == want and enc.encode(texts) == want


def test_packing_pads_little_with_short_documents(spark):
    rng = random.Random(29)
    for low, high in ((1, 5), (4, 24), (1, 25)):
        docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(low, high)))) for i in range(5000)], "doc_id long, text string").repartition(3)
        pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("sequence_id").agg({"length": "sum", "doc_id": "count"}).collect()
        used = [r["sum(length)"] for r in pieces]
        padded = [n if n & (n - 1) == 0 else 2048 for n in used]
        assert sum(padded) < 1.02 * sum(used) and max(r["count(doc_id)"] for r in pieces) <= 64
