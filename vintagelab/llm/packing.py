"""Operator 1, packing: vector bin packing by the dot-product heuristic.

A piece of a document is a vector (tokens, 1 segment, loss-bearing tokens) and a sequence a bin with a limit for each. An open
bin takes, of the piece sizes that fit in all three, the one whose weighted dot product with what the bin has left is largest.
Each task packs a bounded pool of pieces at a time and carries open pieces over to the next pool, so nothing is shuffled, no
group grows with the input, and a partition leaves one unfinished bin at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_rows, out_batches, text_or_empty
from .tokens import balanced, encoder, n_bytes

#: Ids in a pool.
POOL_TOKENS = 2_000_000
#: A gap of so many tokens or more is filled by cutting a piece, where cuts are allowed.
LEAST_GAP = 16


class VectorPacker:
    """Packs pieces with sizes (tokens, loss) into bins; limits are (tokens, segments, loss-bearing tokens)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool):
        self.limits = np.array(limits, np.int64)
        self.cut = cut
        self.weights = 1.0 / self.limits.astype(float) ** 2
        self.pool: dict[tuple[int, int], list] = {}
        self.tokens = 0

    def add(self, tokens: int, loss: int, what) -> None:
        if tokens > self.limits[0] or loss > self.limits[2]:
            raise ValueError("a piece is larger than a sequence; cut it first")
        self.pool.setdefault((tokens, loss), []).append(what)
        self.tokens += tokens

    def _take(self, size: tuple[int, int]):
        held = self.pool[size]
        what = held.pop()
        if not held:
            del self.pool[size]
        self.tokens -= size[0]
        return what

    def bins(self, keep: int) -> Iterator[list]:
        """Full bins, until fewer than `keep` ids are in the pool (0: all of it goes)."""
        sizes = list(self.pool)
        index = {s: k for k, s in enumerate(sizes)}
        at = np.array([(t, 1, loss) for t, loss in sizes], np.int64).reshape(-1, 3)
        left = np.array([len(self.pool[s]) for s in sizes], np.int64)
        while self.pool and self.tokens >= max(1, keep):
            room, chosen = self.limits.copy(), []
            while True:
                fits = (left > 0) & (at <= room).all(axis=1)
                if not fits.any():
                    break
                k = int(np.where(fits, at @ (self.weights * room), -1.0).argmax())
                chosen.append(self._take(sizes[k]))
                left[k] -= 1
                room -= at[k]
            if self.cut and room.min() > 0 and room[0] >= LEAST_GAP and left.any():
                k = int(np.where(left > 0, at[:, 0], -1).argmax())
                first, rest = halves(self._take(sizes[k]), int(min(room[0], room[2])))
                left[k] -= 1
                chosen.append(first)
                size = (len(rest[2]), bearing(rest))
                self.add(*size, rest)
                if size in index:
                    left[index[size]] += 1
                else:
                    index[size] = len(sizes)
                    sizes.append(size)
                    at, left = np.append(at, [[size[0], 1, size[1]]], axis=0), np.append(left, 1)
            yield chosen


def bearing(piece) -> int:
    """Loss-bearing tokens: those marked, or without marks all but the first, which nothing in the segment predicts."""
    _, _, ids, loss, _ = piece
    return int(loss.sum()) if loss is not None else max(0, len(ids) - 1)


def halves(piece, n: int) -> tuple:
    """The piece's first n ids as a piece, and the rest; n is smaller than its length."""
    doc_id, start, ids, loss, total = piece
    cut = (loss[:n], loss[n:]) if loss is not None else (None, None)
    return (doc_id, start, ids[:n], cut[0], total), (doc_id, start + n, ids[n:], cut[1], total)


def pack_ids(rows: Iterator[tuple], limits: tuple[int, int, int], cut: bool) -> Iterator[list]:
    """Bins of pieces (id, start, ids, loss, total) from rows (id, ids, loss or None)."""
    packer = VectorPacker(limits, cut)
    for doc_id, ids, loss in rows:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, limits[0])
            piece = (doc_id, at, ids[at : at + n], loss[at : at + n] if loss is not None else None, len(ids))
            while bearing(piece) > limits[2]:
                n = n // 2 or 1
                piece = (doc_id, at, ids[at : at + n], loss[at : at + n] if loss is not None else None, len(ids))
            if not cut and (at or n < len(ids)):
                raise ValueError(f"document {doc_id} doesn't fit in a sequence, and cuts aren't allowed")
            if n == limits[0] and limits[1] >= 1:
                yield [piece]
            else:
                packer.add(n, bearing(piece), piece)
            at += n
        if packer.tokens >= POOL_TOKENS:
            yield from packer.bins(POOL_TOKENS // 2)
    yield from packer.bins(0)


def power_of_two_bins(pieces: list, capacity: int) -> Iterator[list]:
    """A bin that isn't full, cut into bins whose lengths are powers of two, which need no padding."""
    left = sum(len(p[2]) for p in pieces)
    queue = [*pieces]
    while left:
        want = 1 << (min(left, capacity).bit_length() - 1)
        left -= want
        out = []
        while want:
            doc_id, start, ids, loss, total = queue.pop(0)
            if len(ids) > want:
                queue.insert(0, (doc_id, start + want, ids[want:], loss[want:] if loss is not None else None, total))
                ids, loss = ids[:want], loss[:want] if loss is not None else None
            out.append((doc_id, start, ids, loss, total))
            want -= len(ids)
        yield out


def pack(df: DataFrame, vocabulary: str, capacity: int = 2048, segments: int = 64, loss_tokens: int | None = None, end_id: int = 1, cut: bool = True, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None) -> DataFrame:
    """Packs every whole text, encoded and followed by end_id, into sequences within three limits at once.

    Returns a row per piece: id, start and length (its place among the document's ids), doc_tokens, sequence_id, offset (its
    place in the sequence, gapless from 0), loss_tokens and ids (little-endian unsigned 32-bit). loss_from names a column with
    the number of leading ids that bear no loss (a prompt); without it all but a segment's first id do. With cut=False no
    document is cut and one larger than a sequence is an error. Where cuts are allowed, a bin that leaves LEAST_GAP ids or more (the
    last of a partition, or one that the limit on segments or loss-bearing tokens ends) is cut to powers of two, which gives no
    bin a further segment; only smaller gaps are padded.

    A null text is empty and gives its end id; a text of any length is encoded whole and cut to sequences; null or repeated ids
    and repeated rows are packed like others (a sequence never depends on ids); an empty table gives no rows; other columns are
    not read. Sequence ids are the partition's number and a
    running number in it, so a task that runs again gives the same ones.
    """
    limits = (capacity, segments, loss_tokens or capacity)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc, end = encoder(vocabulary), np.array([end_id], "<u4")
        base = TaskContext.get().partitionId() << 36

        def encoded():
            for held in balanced(in_rows(batches), lambda r: n_bytes(r[1]), 4 << 20):
                for (i, _, lead), ids in zip(held, enc.encode_ids([r[1] for r in held]), strict=True):
                    ids = np.concatenate((np.frombuffer(ids, "<u4"), end))
                    yield i, ids, None if lead is None else np.arange(len(ids)) >= lead

        def rows():
            number = 0
            for pieces in pack_ids(encoded(), limits, cut):
                full = sum(len(p[2]) for p in pieces)
                for one in power_of_two_bins(pieces, capacity) if cut and capacity - full >= LEAST_GAP else [pieces]:
                    offset = 0
                    for p in one:
                        yield p[0], p[1], len(p[2]), p[4], base + number, offset, bearing(p), p[2].tobytes()
                        offset += len(p[2])
                    number += 1

        yield from out_batches(rows(), schema)

    lead = F.col(loss_from).cast("long") if loss_from else F.lit(None).cast("long")
    found = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), lead.alias("lead"))
    return found.mapInArrow(run, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary").withColumnRenamed("id", id_col)
