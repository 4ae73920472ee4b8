import hashlib
import zlib

import pytest

from vintagelab.llm import ogg, queries, warc


def crc_by_bits(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
    return r


def test_ogg_checksum_equals_the_bitwise_one():
    for d in (b"", b"a", b"OggS" + bytes(range(256)) * 3):
        assert ogg.checksum(d) == crc_by_bits(d)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 255 * 255, 576 * 85, 576 * 86, 200_001])
def test_ogg_round_trip(n):
    raw = bytes(i * 7 % 251 for i in range(n))
    media = ogg.encode(ogg.padded(raw), n)
    payload, length, feature = ogg.decode(media)
    assert (payload, length) == (ogg.padded(raw), n) and len(payload) % 576 == 0 and payload
    streams, bad = ogg.demultiplex(media)
    assert not bad and set(streams) == {ogg.SAMPLES, ogg.NOTES}
    s = streams[ogg.SAMPLES]
    ends = ogg.timestamps(s, ogg.RATE, lambda p: len(p) if p[:4] != b"PCM8" else 0)
    assert ends == [0.0, *(576 * k / ogg.RATE for k in range(1, len(payload) // 576 + 1))]


def test_ogg_packets_go_on_over_pages_and_unsound_pages_are_told_of():
    big = bytes(range(256)) * 600
    pages = ogg.paged(5, [b"head", big, b"", b"x" * 255, b"end"], [0, 10, 20, 30, 40])
    s = ogg.demultiplex(b"".join(pages))[0][5]
    assert s.packets == [b"head", big, b"", b"x" * 255, b"end"] and s.ended and s.granules[-1] == 40
    data = bytearray(b"".join(pages))
    data[len(pages[0]) + 400] ^= 1
    streams, bad = ogg.demultiplex(b"junk" + bytes(data))
    assert streams[5].packets[0] == b"head" and streams[5].packets[-1] == b"end" and big not in streams[5].packets
    assert [b[2] for b in bad][:2] == ["no capture pattern", "checksum"] and streams[5].lost


def test_media_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "héllo", "z"), (3, "héllo", "z"), (None, "a" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = ogg.read_media(ogg.add_media(df)).collect()
    assert len(got) == 5 and all(r.payload_bytes % 576 == 0 for r in got)
    same = [r[1:] for r in got if r.doc_id == 3]
    assert same[0] == same[1] and same[0][0] == 6
    assert next(r for r in got if r.doc_id == 1)[1:] == next(r for r in got if r.doc_id == 2)[1:]
    assert ogg.read_media(ogg.add_media(df.limit(0))).count() == 0


def archive(records, compress):
    return [warc.member(r) if compress else r for r in records]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_all_sound_records_and_logs_gaps(compress):
    raw = [warc.record(i, f"http://a/{i}", bytes([i + 40]) * (3000 + i), None, False, "2024-01-01T00:00:00Z") for i in range(6)]
    parts = archive(raw, compress)
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0x5A
    data = b"".join([parts[0], b"garbage bytes", parts[1], bytes(bad), parts[3], parts[4][: len(parts[4]) // 2], parts[5], b"tail"])
    got = list(warc.salvage(_File(data)))
    pages = [g[3][0]["warc-record-id"] for g in got if g[0] == "record"]
    assert pages == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    assert [data[a:b] for k, a, b, _ in got if k == "gap"] == [b"garbage bytes", bytes(bad), parts[4][: len(parts[4]) // 2], b"tail"]
    assert sum(b - a for _, a, b, _ in got) == len(data)


class _File:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_archives_round_trip_with_revisits(spark):
    long, tiny = "<p>é</p>" * 200, "tiny"
    rows = [(1, "u1", long, "a"), (5, "u5", long, "b"), (3, None, long, "c"), (5, "u5", long, "d"), (None, "un", long, "e"), (7, "u", tiny, "f"), (8, "u", tiny, "g"), (9, "u", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    sha = hashlib.sha1(long.encode()).hexdigest()
    by = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    n = len(long.encode())
    assert [b for b in by if b[4] == sha] == [(0, "revisit", 5, n, sha), (1, "revisit", 5, n, sha), (3, "revisit", 5, n, sha), (5, "response", None, n, sha), (5, "response", None, n, sha)]
    assert [b[:4] for b in by if b[4] != sha] == [(7, "response", None, 4), (8, "response", None, 4), (9, "response", None, 0)]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_headers_and_payloads_of_any_length(compress):
    raw = [warc.record(i, "http://a/" + "u" * n, b"p" * m, None, False, "2024-01-01T00:00:00Z") for i, (n, m) in enumerate([(10, 5), (3 << 20, 5), (5, 6 << 20), (70_000, 70_000), (1, 0)])]
    data = b"".join(archive(raw, compress))
    got = list(warc.salvage(_File(data)))
    assert [(g[0], len(g[3][0]["warc-target-uri"]), len(g[3][1].partition(b"\r\n\r\n")[2])) for g in got] == [("record", 19, 5), ("record", 9 + (3 << 20), 5), ("record", 14, 6 << 20), ("record", 70_009, 70_000), ("record", 10, 0)]
    cut = list(warc.salvage(_File(raw[0] + raw[1][:200_000])))
    assert [g[0] for g in cut] == ["record", "gap"]


def test_frequent_payloads_are_dealt_out_and_long_urls_stay(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARES", 3)
    long, other = "x" * 1500, "y" * 1500
    rows = [(i, f"u{i}", long) for i in range(20)] + [(i, f"u{i}", other) for i in range(20, 22)] + [(30, "v" * (2 << 20), "z"), (31, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(df), strict=True).collect()}
    assert got == {i: ("revisit", 19, 1500) if i < 19 else ("response", None, 1500) if i in (19, 21) else ("revisit", 21, 1500) if i == 20 else ("response", None, 1 if i == 30 else 0) for i in [*range(22), 30, 31]}


def test_strict_reading_ends_at_a_gap(spark, tmp_path):
    good = warc.member(warc.record(1, "u", b"p", None, False, "2024-01-01T00:00:00Z"))
    (tmp_path / "a.warc.gz").write_bytes(good + b"junk" + good)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "archive string")
    assert sorted(r.kind for r in warc.read_archives(manifest).collect()) == ["gap", "record", "record"]
    with pytest.raises(Exception, match="hold no sound record"):
        warc.read_archives(manifest, strict=True).collect()


def test_a_false_pattern_near_the_end_hides_no_page():
    media = ogg.encode(ogg.padded(b"abc"), 3)
    last = ogg.page(9, 0, 0, 6, b"\x02", b"hi")
    streams, bad = ogg.demultiplex(media + b"OggS" + b"\0" * 22 + b"\xff" + last)
    assert streams[9].packets == [b"hi"] and [b[2] for b in bad] == ["cut header"]


def pages_by_hand(data):
    """(serial, granule, flags, packets' sizes) of each page, found by the lengths alone."""
    at, out = 0, []
    while at < len(data):
        n = data[at + 26]
        sizes = data[at + 27 : at + 27 + n]
        assert int.from_bytes(data[at + 22 : at + 26], "little") == crc_by_bits(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : at + 27 + n + sum(sizes)])
        out.append((int.from_bytes(data[at + 14 : at + 18], "little"), int.from_bytes(data[at + 6 : at + 14], "little", signed=True), data[at + 5], data[at + 27 + n : at + 27 + n + sum(sizes)]))
        at += 27 + n + sum(sizes)
    return out


def test_op4_equals_brute_force(spark, tmp_path):
    texts = [None, "", "a", "héllo wörld " * 97, "x" * 576, "y" * 577, "long text, 日本 " * 6000, "a"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(None, "null id", "x"), (3, texts[3], "z")], "doc_id long, text string, media string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stored = {(r.doc_id, bytes(r.media)) for r in ogg.add_media(df).collect()}
    media = {i: m for i, m in stored}
    got = queries.op4_ogg(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        raw = ("null id" if r.doc_id is None else texts[r.doc_id] or "").encode()
        full = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        m = media[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        pages = pages_by_hand(m)
        mine = [p for p in pages if p[0] == ogg.SAMPLES]
        assert b"".join(p[3] for p in mine[1:]) == full and mine[-1][1] == len(full) and mine[-1][2] & 4
        signed = [b - 128 for b in full]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(signed, signed[1:]))
        want = f"streams={len({p[0] for p in pages})};pages={len(mine)};packets={len(full) // 576};rate=8000;bits=8;seconds={len(full) / 8000:.6f};mean={sum(signed) / len(full):.4f};power={sum(x * x for x in signed) / len(full):.4f};crossings={crossings}"
        assert r.feature == want


def test_a_file_with_many_gaps_is_read_at_most_twice():
    class Counting(_File):
        read = 0

        def read_at(self, n, at):
            data = super().read_at(n, at)
            Counting.read += len(data)
            return data

    good = [warc.record(i, f"u{i}", b"payload %d" % i, None, False, "2024-01-01T00:00:00Z") for i in range(4)]
    bad = good[0].replace(b"payload 0", b"damaged 0")
    data = good[1] + bad * 10_000 + good[2]
    got = list(warc.salvage(Counting(data)))
    assert [x[0] for x in got] == ["record", "gap", "record"] and got[1][1:3] == (len(good[1]), len(good[1]) + len(bad) * 10_000)
    assert len(data) > 3_000_000 and Counting.read <= 2 * len(data) + (4 << 20)
