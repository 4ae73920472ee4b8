"""Operator 3, token files: independent zstandard frames, a seek table at the end and a checksum per frame.

A shard holds whole documents in ascending id order:

    frame 0 | frame 1 | ... | skippable frame: directory | skippable frame: seek table

Each frame is a zstandard frame of its own over the ids of some whole documents (little-endian, 2 bytes where the vocabulary
allows, else 4). The seek table is that of the public zstandard seekable format (magic 0x184D2A5E, an entry of compressed size,
decompressed size and the low 32 bits of XXH64 per frame, footer magic 0x8F92EAB1). The directory, in an own skippable frame
that other readers step over, says for each document its frame, offset there and number of ids, so that a reader fetches and
decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, in_rows, out_batches, staged, text_or_empty
from .tokens import balanced, encoder, n_bytes

#: Fixed values of the seekable format.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Bytes of ids in a frame, if no single document has more; bytes of a shard before the next one begins.
FRAME_BYTES, SHARD_BYTES = 512 << 10, 128 << 20
DIRECTORY = np.dtype([("known", "u1"), ("id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("n", "<u8")])


class ShardWriter:
    """Writes one shard; nothing is at its path before close()."""

    def __init__(self, folder: str, width: int):
        import zstandard

        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{uuid.uuid4().hex}.tokens.zst"
        self.uri = f"{folder}/{self.path.rsplit('/', 1)[1]}"
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=1)
        self.dtype = f"<u{width}"
        self.frames, self.docs, self.held, self.held_bytes, self.bytes, self.tokens = [], [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        if self.held and self.held_bytes + len(raw) > FRAME_BYTES:
            self._frame()
        self.docs.append((doc_id is not None, doc_id or 0, len(self.frames), self.held_bytes, len(ids)))
        self.held.append(raw)
        self.held_bytes += len(raw)
        self.tokens += len(ids)

    def _frame(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.bytes += len(packed)
        self.held, self.held_bytes = [], 0

    def close(self) -> tuple[str, int, int]:
        if self.held:
            self._frame()
        directory = struct.pack("<B", int(self.dtype[-1])) + np.array(self.docs, DIRECTORY).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(directory)) + directory)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.uri, len(self.docs), self.tokens


class ShardReader:
    """Reads documents of one shard; only their frames are fetched and decompressed, and each is checked."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.unzip = zstandard.ZstdDecompressor()
        end = self.file.size()
        n, kind, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEK_MAGIC or kind != 0x80:
            raise ValueError(f"{uri}: no seek table with checksums at its end")
        at = end - 9 - 12 * n
        self.frames = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(n, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        magic, size = struct.unpack("<II", self.file.read_at(8, int(self.starts[-1])))
        if magic != SKIPPABLE or int(self.starts[-1]) + 8 + size != at - 8:
            raise ValueError(f"{uri}: no directory before the seek table")
        directory = self.file.read_at(size, int(self.starts[-1]) + 8)
        self.dtype = f"<u{directory[0]}"
        self.docs = np.frombuffer(directory[1:], DIRECTORY)
        self.fetched = 0

    def _frame(self, k: int) -> bytes:
        import xxhash

        size, full, check = map(int, self.frames[k])
        raw = self.unzip.decompress(self.file.read_at(size, int(self.starts[k])), max_output_size=full)
        if len(raw) != full or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        self.fetched += 1
        return raw

    def read(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of the documents asked for, or of all, in the shard's order."""
        docs, last, raw = self.docs, None, b""
        if doc_ids is not None:
            docs = docs[(docs["known"] == 1) & np.isin(docs["id"], np.array(list(doc_ids), np.int64))]
        width = int(self.dtype[-1])
        for known, doc_id, frame, offset, n in docs.tolist():
            if frame != last:
                last, raw = frame, self._frame(frame)
            yield doc_id if known else None, np.frombuffer(raw, self.dtype, n, offset)


def write_token_files(df: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id and writes the ids to shards in ascending id order over all shards.

    Returns the manifest, already written: shard, part, piece, n_docs, n_tokens. Shards have names of their own for each attempt
    of a task, and the manifest, which Spark commits once, names those that count; a lost executor costs its tasks only.
    A null text is empty (its one id is end_id); a null id sorts first and stays null; rows with one id follow each other by a
    hash of the text, and are dealt to several tasks where they are many; a text of any length is one document of one frame; an
    empty table gives an empty manifest; other columns are not read.
    """
    folder = folder or fresh_path(df.sparkSession, "tokens")
    schema = pa.schema([("shard", pa.string()), ("piece", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        enc = encoder(vocabulary)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u4")
        shard, piece, made = None, 0, []
        for held in balanced(in_rows(batches), lambda r: n_bytes(r[1]), 4 << 20):
            for (doc_id, _), ids in zip(held, enc.encode_ids([t for _, t in held]), strict=True):
                shard = shard or ShardWriter(folder, width)
                shard.add(doc_id, np.concatenate((np.frombuffer(ids, "<u4"), end)))
                if shard.bytes >= SHARD_BYTES:
                    made.append((shard.close(), piece))
                    shard, piece = None, piece + 1
        if shard:
            made.append((shard.close(), piece))
        yield from out_batches(((uri, k, d, n) for (uri, d, n), k in made), schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    keys = (F.col("id"), F.xxhash64("text"), F.monotonically_increasing_id())
    ordered = rows.select("id", "text", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).repartitionByRange("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2")
    made = ordered.select("id", "text").mapInArrow(write, "shard string, piece long, n_docs long, n_tokens long").withColumn("part", F.spark_partition_id())
    return staged(made, "token-manifest")


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per document of the manifest's shards (or of those asked for): id, start, n_tokens and ids (little-endian unsigned 32-bit).

    start counts the ids of all documents before it. Shards are read in parallel, one task each at most; a shard whose frame
    fails its checksum ends the job with an error that names it. The running total is over shards, one row each.

    Null and repeated ids come back as they were written, each as a row; documents without ids of their own (null or empty texts)
    have the end id; a document of any length is read whole from its frames; an empty manifest gives no rows.
    """
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        def rows():
            for uri, base in in_rows(batches):
                reader = ShardReader(uri)
                start = dict(zip(range(len(reader.docs)), base + np.cumsum(reader.docs["n"].astype(np.int64)) - reader.docs["n"].astype(np.int64), strict=True))
                wanted = None if doc_ids is None else set(doc_ids)
                order = [k for k, d in enumerate(reader.docs.tolist()) if wanted is None or d[0] and d[1] in wanted]
                for k, (i, ids) in zip(order, reader.read(doc_ids), strict=True):
                    yield i, int(start[k]), len(ids), ids.astype("<u4").tobytes()

        yield from out_batches(rows(), schema)

    spark = manifest.sparkSession
    shards = based.select("shard", "base").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "shard")
    found = shards.mapInArrow(read, "id long, start long, n_tokens long, ids binary")
    return found.withColumnRenamed("id", id_col)
