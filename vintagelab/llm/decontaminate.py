"""Operator 9, benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton of all items (of a block of them, if they are many) is built once and sent to the tasks; each document's words stream through it, and the length of the
longest match that ends at each word is tracked. A match of `window` words or more, or of a whole shorter item, hits its words.
Hit spans of `min_span` words or more are removed, and documents with more than `max_coverage` of their words hit are dropped.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import drop_staged, in_rows, no_clash, out_batches, positional, staged, text_or_empty

#: Bytes of items' words in one automaton (some 250 MB as Python objects); a larger benchmark is taken in blocks.
BLOCK_CHARS = 2_000_000
_BLANKS = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
_SEPARATORS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased, in UTF-8."""
    return text.encode("utf-8").translate(_SEPARATORS).split()


class ItemAutomaton:
    """A generalised suffix automaton over the words of items, with the items of each window."""

    def __init__(self, items: list[tuple[object, str]], window: int = 10):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)]) for i, t in items]
        coded = [(i, ids) for i, ids in coded if ids]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.top = [-1] * len(self.len)  # the state of the suffix of `window` words
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[v]
            self.top[v] = self.top[up] if self.len[up] >= window else v if self.len[v] >= window else -1
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for i, ids in coded:
            v = 0
            for n, w in enumerate(ids, 1):
                v = self.next[v][w]
                if n >= window:
                    self.items.setdefault(self.top[v], set()).add(i)
            if len(ids) < window:
                self.short.setdefault(v, []).append((len(ids), i))
        self.least = min((len(ids) for _, ids in coded), default=window)
        self.least = min(self.least, window)
        # The nearest state on the chain of suffixes, itself included, where a short item ends.
        self.ending = [-1] * len(self.len)
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.ending[v] = v if v in self.short else self.ending[self.link[v]] if v else -1

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of state q for strings of p's length plus one."""
        copy = self._new(self.len[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.len[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """(hit spans of word places, end exclusive and not merged; items with an occurring window; longest match)."""
        n = len(words)
        if n < self.least:
            return [], set(), 0
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        edges = np.concatenate(([-1], np.flatnonzero(ids < 0), [n]))
        runs = np.flatnonzero(np.diff(edges) > self.least)
        spans, found, longest = [], set(), 0
        for r in runs:
            begin = int(edges[r]) + 1
            v = length = 0
            for at, w in enumerate(ids[begin : int(edges[r + 1])].tolist(), begin + 1):
                while v and w not in self.next[v]:
                    v = self.link[v]
                    length = self.len[v]
                if w in self.next[v]:
                    v, length = self.next[v][w], length + 1
                longest = max(longest, length)
                if length >= self.window:
                    spans.append((at - self.window, at))
                    found |= self.items[self.top[v]]
                s = self.ending[v]
                while s > 0:
                    for m, i in self.short[s]:
                        if length >= m:
                            spans.append((at - m, at))
                            found.add(i)
                    s = self.ending[self.link[s]]
        return spans, found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _places(text: str) -> list[tuple[int, int]]:
    """Where the words of words_of() are, in bytes."""
    return [m.span() for m in re.finditer(rb"[^ ]+", text.encode("utf-8").translate(_SEPARATORS).translate(_BLANKS))]


def _without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without ranges of its bytes, which may lie in each other."""
    raw, out, last = text.encode("utf-8"), [], 0
    for a, b in sorted(ranges):
        if a > last or not out:
            out.append(raw[last:a])
        last = max(last, b)
    return b"".join([*out, raw[last:]]).decode("utf-8")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = _places(text)
    return _without(text, [(at[a][0], at[b - 1][1]) for a, b in spans])


def cleaned(text: str, words: list[bytes], spans: list[tuple[int, int]], machine: ItemAutomaton, min_span: int) -> str:
    """The text without hit spans of min_span words or more, again until none is left; spans are what machine finds in the words.

    Where words have gone, only a match over the seam is new, so window - 1 words at either side are scanned; the words left are a
    chain. The time grows with the text, however deeply passages are nested."""
    if not any(b - a >= min_span for a, b in spans):
        return text
    n, at, ranges = len(words), _places(text), []
    before, after, hit = [*range(-1, n)], [*range(1, n + 1), n], bytearray(n + 1)  # n stands for the end
    for a, b in spans:
        hit[a:b] = b"\1" * (b - a)
    gone = [(a, b - 1) for a, b in spans if b - a >= min_span]
    while gone:
        seams = []
        for a, b in gone:
            ranges.append((at[a][0], at[b][1]))
            left, right = before[a], after[b]
            if left >= 0:
                after[left] = right
            before[right] = left
            seams.append((left, right))
        runs, seen = set(), set()
        for left, right in seams:
            near = [right] if right < n else []
            for _ in range(machine.window - 2):
                if near and after[near[-1]] < n:
                    near.append(after[near[-1]])
            k = left
            for _ in range(machine.window - 1):
                if k < 0:
                    break
                near.insert(0, k)
                k = before[k]
            if tuple(near[:1] + near[-1:]) in seen:
                continue
            seen.add(tuple(near[:1] + near[-1:]))
            for a, b in machine.scan([words[i] for i in near])[0]:
                for i in near[a:b]:
                    hit[i] = 1
            runs.update(i for i in near if hit[i])
        gone, done = [], set()
        for i in sorted(runs):
            if i in done:
                continue
            a = b = i
            while before[a] >= 0 and hit[before[a]]:
                a = before[a]
            while after[b] < n and hit[after[b]]:
                b = after[b]
            size, k = 1, a
            done.add(a)
            while k != b:
                k = after[k]
                done.add(k)
                size += 1
            if size >= min_span:
                gone.append((a, b))
    return _without(text, ranges)


def item_pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Staged distinct (item, text, size) of the items with words; an item of over a quarter of a block is cut into pieces that
    share window - 1 words, so that each of its windows is in one of them."""
    schema = pa.schema([("item", pa.string()), ("text", pa.string()), ("size", pa.int64())])
    most = max(2 * window, BLOCK_CHARS // 4)

    def rows(batches):
        for item, text in in_rows(batches):
            words = words_of(text)
            if sum(map(len, words)) + len(words) <= most:
                pieces = [words] if words else []
            else:
                ends, at, pieces = np.cumsum([len(w) + 1 for w in words]), 0, []
                while at < len(words):
                    to = min(len(words), max(at + window, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most))))
                    pieces.append(words[at:to])
                    at = to - (window - 1) if to < len(words) else to
            for p in pieces:
                yield item, b" ".join(p).decode("utf-8"), sum(map(len, p)) + len(p)

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text_or_empty(text_col).alias("text")).where("text != ''")
    return staged(items.mapInArrow(lambda b: out_batches(rows(b), schema), "item string, text string, size long").distinct(), "items")


def blocks_of(items: DataFrame) -> tuple[DataFrame, int]:
    """items with a block number, and how many blocks; no block holds more than BLOCK_CHARS bytes of words, which is checked."""
    total, n = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.lit(1)).first()
    while n * BLOCK_CHARS < total or n > 1 and not items.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(n))).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).where((F.col("s") > BLOCK_CHARS) & (F.col("c") > 1)).isEmpty():
        n *= 2
    return items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")), n


def machine_of(items: DataFrame, block: int, window: int):
    """The broadcast automaton of a block's items."""
    return items.sparkSession.sparkContext.broadcast(ItemAutomaton([(r.item, r.text) for r in items.where(F.col("block") == block).toLocalIterator()], window))


#: A min_span that no span has.
KEEP_ALL = 1 << 62
_RESULT = "n_words long, n_hit long, n_items long, items array<string>, longest long, clean_text string, drop boolean"
OWN = ["n_words", "n_hit", "n_items", "items", "longest", "clean_text", "drop"]


def _scanned(kept: DataFrame, benchmark: DataFrame, window: int, min_span: int, max_coverage: float, item_col: str, item_text_col: str) -> DataFrame:
    """contamination() of _k0, _k1, ... and, as the last column, _text."""
    items, n = blocks_of(item_pieces(benchmark, item_col, item_text_col, window))
    if n > 1:
        return _in_blocks(kept, items, n, window, min_span, max_coverage)
    machine = machine_of(items, 0, window)
    kind = StructType([*kept.schema.fields[:-1], *StructType.fromDDL(_RESULT).fields])
    schema = to_arrow_schema(kind)

    def rows(batches):
        for *held, text in in_rows(batches):
            words = words_of(text or "")
            spans, found, longest = machine.value.scan(words)
            spans = merged(spans)
            hit, clean = sum(b - a for a, b in spans), cleaned(text or "", words, spans, machine.value, min_span) if text and min_span < KEEP_ALL else text
            yield (*held, len(words), hit, len(found), sorted(i for i in found if i is not None), longest, clean, hit > max_coverage * len(words))

    return kept.mapInArrow(lambda batches: out_batches(rows(batches), schema), kind)


def _in_blocks(kept: DataFrame, items: DataFrame, n: int, window: int, min_span: int, max_coverage: float) -> DataFrame:
    """_scanned() for a benchmark of n blocks: all documents are read against one automaton at a time, whose hits are written;
    the spans of a document (one row a block at most) are then merged, and those that were cut are read again."""
    kept = staged(kept.withColumn("_rid", F.monotonically_increasing_id()), "documents")
    part = "rid long, spans array<struct<a:long,b:long>>, items array<string>, unnamed boolean, longest long"
    part_schema = to_arrow_schema(StructType.fromDDL(part))
    done = "rid long, n_words long, n_hit long, n_items long, items array<string>, longest long, clean_text string"

    def hits(machine):
        def rows(batches):
            for rid, text in in_rows(batches):
                spans, found, longest = machine.value.scan(words_of(text or ""))
                if spans or longest:
                    yield rid, [{"a": a, "b": b} for a, b in merged(spans)], sorted(i for i in found if i is not None), None in found, longest

        return lambda batches: out_batches(rows(batches), part_schema)

    done_schema = to_arrow_schema(StructType.fromDDL(done))

    def cut(batches):
        def rows():
            for rid, text, spans, items, unnamed, longest in in_rows(batches):
                spans = merged([(s["a"], s["b"]) for s in spans or []])
                long = [(a, b) for a, b in spans if b - a >= min_span]
                items = sorted(set(items or []))
                yield rid, len(words_of(text or "")), sum(b - a for a, b in spans), len(items) + bool(unnamed), items, longest or 0, without(text, long) if long else text

        return out_batches(rows(), done_schema)

    todo, first, texts = kept.select(F.col("_rid").alias("rid"), F.col("_text").alias("text")), None, None
    number = 0
    while number == 0 or not todo.isEmpty():
        written = []
        for k in range(n):
            machine = machine_of(items, k, window)
            written.append(staged(todo.mapInArrow(hits(machine), part), "hits"))
            machine.destroy()
        found = reduce(DataFrame.union, written)
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("rid").agg(flat("spans"), flat("items"), F.max("unnamed").alias("unnamed"), F.max("longest").alias("longest"))
        after = staged(todo.join(found, "rid", "left").select("rid", "text", "spans", "items", "unnamed", "longest").mapInArrow(cut, done), "cut")
        for one in written:
            drop_staged(one)
        first = first or after
        one = after.select("rid", F.struct(F.lit(number).alias("round"), "clean_text").alias("last"))
        texts = texts.union(one) if texts else one
        todo = staged(after.join(todo, "rid").where("clean_text <> text").select("rid", F.col("clean_text").alias("text")), "again")
        number += 1
    last = texts.groupBy("rid").agg(F.max("last").alias("last")).select(F.col("rid").alias("_rid"), F.col("last.clean_text").alias("clean_text"))
    out = kept.join(first.drop("clean_text").withColumnRenamed("rid", "_rid"), "_rid").join(last, "_rid")
    out = out.withColumn("drop", F.col("n_hit") > F.lit(max_coverage) * F.col("n_words"))
    return out.select(*kept.columns[:-2], *OWN)


def contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, min_span: int = 1, max_coverage: float = 1.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, clean: bool = True) -> DataFrame:
    """Every document with what it shares with the benchmark, and its text without that.

    Returns the columns `keep` (by default the id), n_words, n_hit, n_items, items (their ids as strings, sorted), longest (words of
    the longest match), clean_text (hit spans of min_span words or more removed, again until none is left) and drop (more than
    max_coverage of its words are hit). A null text has no words and stays null; null and repeated ids and repeated rows each
    give a row; items without words are left out; items with a null id hit like others, count as one item together and have no
    place in items; an empty benchmark hits nothing; an empty table gives none. A kept column with the name of a result's column
    is an error that says so. Texts of any length are read whole, by one task each.
    A benchmark larger than BLOCK_CHARS is taken a block at a time, each over all documents, with the same result, except that
    `longest` may be smaller where the match crosses a cut of an item of over a quarter of a block. Without `clean` no text is
    cleaned and clean_text isn't returned.
    """
    keep, own = keep or [id_col], [c for c in OWN if clean or c != "clean_text"]
    no_clash(keep, own)
    kept = positional(df.select(*[F.col(c) for c in keep], F.col(text_col))).withColumnRenamed(f"_k{len(keep)}", "_text")
    out = _scanned(kept, benchmark, window, min_span if clean else KEEP_ALL, max_coverage, item_col, item_text_col)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *own)


def decontaminated(df: DataFrame, benchmark: DataFrame, window: int = 10, min_span: int = 1, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """df's columns, whatever their names, without the rows that contamination() drops, and with clean texts in the others.

    Null texts stay null; null and repeated ids and repeated rows are rows like others; texts of any length are cleaned whole; an
    empty table gives none, and an empty benchmark changes nothing."""
    at = df.columns.index(text_col)
    kept = positional(df).withColumn("_text", F.col(f"_k{at}"))
    out = _scanned(kept, benchmark, window, min_span, max_coverage, item_col, item_text_col)
    return out.where(~F.col("drop")).select(*[F.col("clean_text" if i == at else f"_k{i}").alias(c) for i, c in enumerate(df.columns)])
