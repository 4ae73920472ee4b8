"""Operator 12, spelling variants by dynamic programming over sorted lists.

Two words are near if one insertion, deletion or replacement of a code point turns one into the other. Then they share their first
half or their last one, so a block is the words of about equal length that share a half; a block of over PART words is split in
halves again, until it fits or one code point is left, of which no block can hold many. In a block the words' other parts are a
sorted list. A word goes along it with the rows of its edit matrix, three cells wide: rows of the prefix that a word shares with
the one before it are kept, and where all cells of a row are over one edit, the whole range with that prefix is passed over.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, in_rows, out_batches, staged, text_or_empty

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: Words in a block that aren't split again.
PART = 2048
#: Counts that a task holds before it passes them on.
HELD = 200_000
_LAST = "\U0010ffff"


def damaged(run: str, base: int, every: int) -> str:
    """The run without one of its code points, where `every` divides the CRC-32 of what base is the CRC-32 of and the run."""
    h = zlib.crc32(run.encode("utf-8"), base)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, least: int = 3, every: int | None = None) -> DataFrame:
    """(word, n): the distinct runs of letters, A-Z in lower case, of `length` code points and `least` occurrences or more.

    With `every`, planted typing errors: a run loses a code point where `every` divides the CRC-32 of its id, a colon and itself (a
    null id is empty). Null texts have no words; texts are read whole; tasks add up counts before Spark does."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(batches):
        held: dict[str, int] = {}
        for doc_id, text in in_rows(batches):
            base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(LETTERS.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
                word = damaged(run, base, every) if every else run
                if len(word) >= length:
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield from held.items()
                held = {}
        yield from held.items()

    found = df.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    counts = found.mapInArrow(lambda b: out_batches(rows(b), schema), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _row(before: tuple[int, int, int], d: int, c: str, word: str) -> tuple[int, int, int]:
    """The edit matrix's row of a prefix of d code points that ends with c, at the word's first d - 1, d and d + 1."""
    size, (left, mid, right) = len(word), before
    one = two = three = 2
    if d == 1:
        one = 1
    elif d <= size + 1:
        one = left + (c != word[d - 2])
        if mid < one - 1:
            one = mid + 1
    if d <= size:
        two = mid + (c != word[d - 1])
        if right < two - 1:
            two = right + 1
        if one < two - 1:
            two = one + 1
    if d < size:
        three = right + (c != word[d])
        if two < three - 1:
            three = two + 1
    return one, two, three


def near(words: list[str], shared: list[int], k: int) -> Iterator[int]:
    """Places after k in a sorted list of words within one edit of the k-th; shared[j] is the prefix that words j - 1 and j share."""
    word, rows, keep, j = words[k], [(2, 0, 1)], 0, k + 1
    while j < len(words):
        other = words[j]
        del rows[keep + 1 :]
        for d in range(len(rows), len(other) + 1):
            row = _row(rows[-1], d, other[d - 1], word)
            rows.append(row)
            if row[0] > 1 and row[1] > 1 and row[2] > 1:
                after = bisect_left(words, other[:d] + _LAST, j + 1)
                break
        else:
            gap = len(word) - len(other)
            if -1 <= gap <= 1 and rows[-1][gap + 1] <= 1:
                yield j
            after = j + 1
        if after < len(words):
            keep = min(shared[after], len(rows) - 1)
        j = after


def halved(length: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """After a path of splits of words of a length: shared code points at the start and at the end, and for each split at which the
    ends were taken the (place, number) of those at which the words of a pair have to differ, as they'd meet elsewhere else."""
    start, end, differ = 0, 0, []
    for half in path:
        free = length - start - end
        if half == "P":
            start += free // 2
        else:
            differ.append((start, free // 2))
            end += free - free // 2
    return start, end, differ


def _split(blocks: DataFrame) -> DataFrame:
    """Each row (l, path, p, s, word, n) in the two blocks of its block's halves."""
    start, end = F.length("p"), F.length("s")
    half = F.floor((F.col("l") - start - end) / 2).cast("int")
    rest = F.col("l") - start - half
    first = F.struct(F.concat("path", F.lit("P")).alias("path"), F.left(F.col("word"), start + half).alias("p"), F.col("s").alias("s"))
    last = F.struct(F.concat("path", F.lit("S")).alias("path"), F.col("p").alias("p"), F.right(F.col("word"), rest).alias("s"))
    return blocks.select("l", "word", "n", F.inline(F.array(first, last))).select("l", "path", "p", "s", "word", "n")


def near_pairs(vocab: DataFrame, length: int = 5, part: int = PART) -> DataFrame:
    """(word, near, near_n): every pair of near words of a vocabulary (word, n) of words of `length` code points or more, either way
    round, each once. No task holds more than `part` words of a block, or those that differ in the last code points alone."""
    key = ["l", "path", "p", "s"]
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def pairs(key: tuple, held: list[tuple[str, str, int]]) -> Iterator[tuple]:
        size, path = key[0], key[1]
        _, _, differ = halved(size, path)
        words = [w for w, _, _ in held]
        shared = [0, *(next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(words, words[1:]))]
        for k, (_, mine, n) in enumerate(held):
            for j in near(words, shared, k):
                other, m = held[j][1:]
                if min(len(mine), len(other)) == size and all(mine[a : a + h] != other[a : a + h] for a, h in differ):
                    yield mine, other, m
                    yield other, mine, n

    def rows(batches):
        key, held = None, []
        for l, path, p, s, word, n in in_rows(batches):
            if (l, path, p, s) != key:
                if len(held) > 1:
                    yield from pairs(key, held)
                key, held = (l, path, p, s), []
            held.append((word[len(p) : len(word) - len(s)], word, n))
        if len(held) > 1:
            yield from pairs(key, held)

    both = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("l")
    blocks = vocab.select("word", "n", both).where(F.col("l") >= max(2, length)).select("l", F.lit("").alias("path"), F.lit("").alias("p"), F.lit("").alias("s"), "word", "n")
    blocks, out = _split(blocks), None
    while True:
        blocks = staged(blocks, "spelling-blocks")
        sizes = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        small = (F.col("c") <= part) | (F.col("l") - F.length("p") - F.length("s") <= 1)
        known = staged(blocks.hint("merge").join(sizes, key).withColumn("small", small), "spelling-sized")
        drop_staged(blocks)
        free = F.expr("substring(word, length(p) + 1, length(word) - length(p) - length(s))")
        ready = known.where("small").repartition(*key).sortWithinPartitions(*key, free).select(*key, "word", "n")
        found = staged(ready.mapInArrow(lambda b: out_batches(rows(b), schema), "word string, near string, near_n long"), "spelling-pairs")
        out = found if out is None else out.union(found)
        large = known.where("NOT small")
        if large.isEmpty():
            return out
        blocks = _split(large.select(*key, "word", "n"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to; each round doubles the steps taken. Forms must not lead back."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = staged(now.hint("merge").join(nxt, now["root"] == nxt["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots")
        drop_staged(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(vocab: DataFrame, length: int = 5, ratio: int = 2, part: int = PART) -> DataFrame:
    """A row per word of a vocabulary (word, n): form (its near word of largest n, of equals the least by code points, if that n is
    `ratio` times the word's or more), root (where forms lead in the end; the word itself without a form), n, n_near and form_n.

    Words are distinct and not null; an empty vocabulary gives no rows; a word may have any number of code points from `length` on."""
    best = near_pairs(vocab, length, part).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    out = vocab.join(best, "word", "left").select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    out = staged(out, "spelling-forms")
    roots = followed(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, least: int = 3, every: int | None = None) -> DataFrame:
    """variants() of the vocabulary() of df's texts: null and empty texts have no words, texts of any length are read whole, repeated
    rows count as often as they occur, an empty table gives no rows, and other columns are not read."""
    return variants(staged(vocabulary(df, id_col, text_col, length, least, every), "spelling-vocabulary"), length)
