"""Operator 2, WARC: an archive writer with revisit records, and a reader that salvages damaged archives.

The reader checks each record (gzip member, version line, block length, block and payload digests). After a failed check it
searches for the next valid gzip member, or the next version line where records aren't compressed, goes on from there, and logs
the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, in_rows, out_batches, staged

#: Bytes of an archive before the next one begins.
ARCHIVE_BYTES = 64 << 20
#: What a value of a Spark row can hold; a larger record can be no row, and is told of as a gap.
LARGEST_RECORD = (1 << 31) - (1 << 20)
#: Payloads with more than this share of all copies are dealt out before the join, so HOT_SHARES bounds how many they are.
HOT_SHARES = 1000
#: Payloads shorter than this are never revisited.
LEAST_REVISIT = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = b"\x1f\x8b\x08"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record: a response with HTTP headers and payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "urn:none")),
        ("WARC-Payload-Digest", sha1_label(payload)),
        ("WARC-Block-Digest", sha1_label(block)),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, end) of the record at a place; ValueError with what is wrong."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError("no version line")
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        raise ValueError("no end of header")
    fields = {}
    for line in data[at:split].decode("utf-8", "replace").split("\r\n")[1:]:
        k, sep, v = line.partition(":")
        if not sep:
            raise ValueError("bad header line")
        fields[k.strip().lower()] = v.strip()
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    end = split + 4 + int(fields["content-length"])
    block = data[split + 4 : end]
    if end + 4 > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("cut block or no end of record")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != sha1_label(block):
        raise ValueError("block digest")
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != sha1_label(block.partition(b"\r\n\r\n")[2]):
        raise ValueError("payload digest")
    return fields, block, end + 4


class Window:
    """Bytes of a file by place, read as they are asked for and forgotten behind `base`."""

    def __init__(self, file, step: int = 1 << 20):
        self.file, self.size, self.step, self.base, self.held = file, file.size(), step, 0, b""

    def upto(self, end: int) -> None:
        end = min(self.size, end)
        have = self.base + len(self.held)
        if end > have:
            self.held += self.file.read_at(max(min(self.step, self.size - have), end - have), have)

    def get(self, at: int, n: int) -> bytes:
        self.upto(at + n)
        return self.held[at - self.base : at - self.base + n]

    def forget(self, at: int) -> None:
        self.held, self.base = self.held[at - self.base :], at

    def find(self, what: bytes, at: int) -> int:
        """The next place of `what` from a place on, or -1; what is passed is forgotten."""
        while at < self.size:
            self.upto(at + self.step)
            k = self.held.find(what, at - self.base)
            if k >= 0:
                return self.base + k
            at = max(at, self.base + len(self.held) - len(what) + 1)
            if self.base + len(self.held) >= self.size:
                return -1
            self.forget(at)
        return -1


def inflate(window: Window, at: int) -> tuple[bytes, int]:
    """(data, end) of the gzip member at a place; ValueError if it is unsound."""
    z, out, total, place = zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof:
            chunk = window.get(place, 64 << 10)
            if not chunk:
                raise ValueError("cut member")
            out.append(z.decompress(chunk))
            place += len(chunk)
            total += len(out[-1])
            if not out[0].startswith(b"WARC/1."[: len(out[0])]):
                raise ValueError("member holds no record")
            if total > LARGEST_RECORD:
                raise ValueError("record larger than a row can be")
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    return b"".join(out), place - len(z.unused_data)


def salvage(file) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (fields, block)) and ("gap", start, end, reason), in order of place.

    Gaps cover every byte that no sound record covers. The next place of each mark is remembered until it is passed, so that a file
    is searched for a mark once, however many gaps it has."""
    window, at, gap, reason = Window(file), 0, -1, ""
    packed = window.get(0, 3) == _MEMBER
    ahead = dict.fromkeys([_MEMBER] if packed else [_MEMBER, b"WARC/1."], -1)
    while at < window.size:
        window.forget(at) if at > window.base else None
        try:
            if window.get(at, 3) == _MEMBER:
                data, end = inflate(window, at)
                fields, block, used = parse(data)
                if used != len(data):
                    raise ValueError("more than a record in a member")
            elif window.get(at, 7) == b"WARC/1.":
                fields, block, used = parse(window.get(at, _length(window, at)))
                end = at + used
            else:
                raise ValueError("neither a member nor a version line")
        except ValueError as e:
            if gap < 0:
                gap, reason = at, str(e)
            base, held = window.base, window.held
            for mark, place in ahead.items():
                if place <= at:
                    if window.base > at + 1:
                        window.base, window.held = base, held
                    k = window.find(mark, at + 1)
                    ahead[mark] = k if k >= 0 else window.size
            at = min(ahead.values())
            if at < window.base:
                window.base, window.held = base, held
            continue
        if gap >= 0:
            yield "gap", gap, at, reason
            gap = -1
        yield "record", at, end, (fields, block)
        at = end
    if gap >= 0:
        yield "gap", gap, window.size, reason


def _length(window: Window, at: int) -> int:
    """Bytes of the uncompressed record at a place, by its header, which may be of any length; ValueError if it can't be there."""
    n = 1 << 14
    while (split := (data := window.get(at, n)).find(b"\r\n\r\n")) < 0:
        if len(data) < n:
            raise ValueError("no end of header")
        n *= 4
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})\s*(?=\r\n)", data[: split + 2])
    if not m:
        raise ValueError("no content length")
    n = split + 8 + int(m[1])
    if at + n > window.size:
        raise ValueError("cut block or no end of record")
    if n > LARGEST_RECORD:
        raise ValueError("record larger than a row can be")
    return n


def write_archives(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", compress: bool = True) -> DataFrame:
    """Writes a record per row; returns the manifest, already written: archive, records, bytes.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, that with the largest id is the response and others revisit it
    (rows that share that id are all responses; where all ids are null, all are). A null payload is empty; null and repeated ids
    and repeated rows each give a record, and so do urls and payloads of any length; an empty table gives an empty manifest; other
    columns are not read. The largest ids are found by partial aggregation; payloads cross the network once, by digest, except
    that those of a frequent digest (HOT_SHARES at most, broadcast) are dealt out evenly. Archives have names of their own for each attempt of a task; the manifest names those that count.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    long = F.length(F.encode("payload", "utf-8")) >= LEAST_REVISIT
    copies = staged(rows.where(long).groupBy("digest").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-copies")
    least = max(HOT_SHARES, (copies.agg(F.sum("n")).first()[0] or 0) // HOT_SHARES)
    hot = copies.where(F.col("n") > least).select("digest", F.col("keeper").alias("hot"), F.lit(True).alias("is_hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("at", F.when(F.col("is_hot"), F.concat(F.lit("hot "), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("digest")))
    rows = rows.join(copies.where(F.col("n") <= least).select(F.col("digest").alias("at"), "keeper"), "at", "left").withColumn("keeper", F.coalesce("hot", "keeper"))
    decided = rows.select("page", "url", "payload", F.when(F.col("keeper") != F.col("page"), F.col("keeper")).when(F.col("page").isNull(), F.col("keeper")).alias("refers_to"))
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        made, n, size = [], 0, 0
        for page_id, url, payload, refers_to in in_rows(batches):
            if out is None:
                name, n, size = f"{uuid.uuid4().hex}.warc" + (".gz" if compress else ""), 0, 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            data = record(page_id, url, payload.encode("utf-8"), refers_to, refers_to is not None, date)
            data = member(data) if compress else data
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= ARCHIVE_BYTES:
                out.close()
                made.append((f"{folder}/{name}", n, size))
                out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", n, size))
        yield from out_batches(iter(made), schema)

    return staged(decided.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, archive_col: str = "archive", strict: bool = False, payloads: bool = True) -> DataFrame:
    """A row per sound record and per quarantined gap of the archives, read in parallel, one task an archive at most; a strict
    reading ends with an error at the first gap. Headers and payloads of any length that a row can hold are read; records whose
    id or target is missing have nulls there; an empty manifest gives no rows; the same archive named twice is read twice.

    Columns: archive, start, end, kind (record or gap), record_type, page_id, url, payload_bytes and payload_digest (bare
    hexadecimal SHA-1) of the full payload, refers_to, payload (null for revisits, and for all without `payloads`) and reason (of
    a gap)."""
    columns = "archive string, start long, end long, kind string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])

    def number(label: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", label or "")
        return int(m[1]) if m else None

    def rows(batches):
        for (uri,) in in_rows(batches):
            fs, path = filesystem(uri)
            with fs.open_input_file(path) as file:
                for kind, start, end, what in salvage(file):
                    if kind == "gap":
                        if strict:
                            raise ValueError(f"{uri}: bytes {start} to {end} hold no sound record: {what}")
                        yield uri, start, end, kind, None, None, None, None, None, None, None, what
                        continue
                    fields, block = what
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                    digest = fields.get("warc-payload-digest", "").partition(":")[2]
                    digest = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower() or None
                    response = fields.get("warc-type") == "response"
                    yield uri, start, end, kind, fields.get("warc-type"), number(fields.get("warc-record-id")), fields.get("warc-target-uri"), int(size[1]) if size else len(payload), hashlib.sha1(payload).hexdigest() if response else digest, number(fields.get("warc-refers-to")), payload if response and payloads else None, None

    spark = manifest.sparkSession
    shards = manifest.select(archive_col).repartition(max(1, spark.sparkContext.defaultParallelism * 4), archive_col)
    return shards.mapInArrow(lambda b: out_batches(rows(b), schema), columns)
