"""Operator 6, token counts, and the encoder that operators 1 and 3 share.

A text is cut at boundaries that no token of the vocabulary crosses: white space for the vocabulary that drops it, the place
before a single space between two non-blank characters for the byte-level one. The library's ids of a whole text are then the
ids of its pieces in a row, so each distinct piece is encoded by the library once and remembered (a bounded memory), and a
text of any length is split safely. A text that holds one of the vocabulary's special strings goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import pairwise
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_rows, out_batches, text_or_empty

#: Pieces remembered by one Python worker, in each of two generations.
MEMORY = 300_000
#: Pieces whose ids encode_ids() remembers.
WORDS = 700_000
#: Pieces longer than this are encoded but not remembered.
LONG_PIECE = 48
#: Bytes of text in one call of the library.
CALL_BYTES = 256 << 10

#: A word of letters with marks after it; no token holds both a letter and one of these marks. The dotted capital I isn't among
#: the letters: its lower case ends with a combining dot, which joins the marks after it.
WORD = re.compile(r"""( ?)([A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ž]{1,40})([.,!?;:#$%&*|"()]*)""")

MARK_AFTER_LETTER = r"""([a-zÀ-ÖØ-öø-ÿĀ-įı-ž])([.,!?;:#$%&*|"()])"""

_encoders: dict[tuple, "PieceEncoder"] = {}


def n_bytes(text: str) -> int:
    """Bytes of the text in UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8"))


def composed(text: str) -> bool:
    """Whether a text is in composed form (NFC) and stays so in lower case; some marks join small letters alone (a ring above y), so
    that the order in which the library composes and lower-cases matters."""
    return text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", text.lower())


class PieceEncoder:
    """Ids (as little-endian 32-bit bytes) or token counts of texts, piece by piece."""

    def __init__(self, path: str, counts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        normalizer = str(self.tokenizer.normalizer)
        self.drops_space = r'Regex("\s+")' in normalizer and "Lowercase" in normalizer
        self.safe = self.drops_space or self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False")
        self.counts = counts
        vocabulary = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.mark[i] = token.endswith("</w>") if self.drops_space else token.startswith("Ġ")
        self.young: dict[str, bytes | int] = {}
        self.old: dict[str, bytes | int] = {}
        self._forget()

    def _ids(self, texts: list[str]) -> Iterator[list[int]]:
        """The library's ids of each text; the calls are balanced by bytes."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < CALL_BYTES or end == at):
                size += n_bytes(texts[end]) + 8
                end += 1
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False))
            at = end

    def _words(self, words: list[str]) -> Iterator[list[int]]:
        """The library's ids of words of letters alone, many in a call: each word's last id (or first) shows in the vocabulary."""
        for at in range(0, len(words), 400):
            some = words[at : at + 400]
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.drops_space else "").join(some)], add_special_tokens=False)[0].ids)
            marks = np.flatnonzero(self.mark[ids])
            if len(marks) != len(some):
                yield from self._ids(some)
                continue
            bounds = [0, *(marks + 1)] if self.drops_space else [*marks, len(ids)]
            yield from (ids[x:y] for x, y in pairwise(bounds))

    def _value(self, ids) -> bytes | int:
        return len(ids) if self.counts else np.asarray(ids, "<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Remembers pieces that are new; a word with marks after it is two pieces, so that the word is encoded once."""
        young, old = self.young, self.old
        split, ask, letters = [], [], {}
        for p in missing:
            if (known := old.get(p)) is not None:
                young[p] = known
            elif self.safe and (m := WORD.fullmatch(p)):
                lead, word, marks = m.groups()
                if bool(lead) == self.drops_space:
                    ask.append(p)
                    continue
                if marks:
                    split.append((p, lead + word, marks))
                    if marks not in young:
                        ask.append(marks)
                if lead + word not in young:
                    if (known := old.get(lead + word)) is not None:
                        young[lead + word] = known
                    else:
                        letters[lead + word] = None
            else:
                ask.append(p)
        young.update(zip(letters, map(self._value, self._words(list(letters)))))
        ask = list(dict.fromkeys(ask))
        young.update(zip(ask, map(self._value, self._ids(ask))))
        for p, word, marks in split:
            young[p] = young[word] + young[marks]

    def pieces(self, text: str) -> list[str]:
        """The text cut where no token crosses; the pieces together have all of its tokens."""
        if not self.safe or any(s in text for s in self.special):
            return [text] if text else []
        if self.drops_space:
            if "Σ" not in text and composed(text):  # the lower case of Σ depends on its place in Python, not in the library
                text = text.lower()
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        cut = text.split(" ")
        if "" in cut or any(x in text for x in ("\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", " ", " ", "　")) or not text.isascii() and re.search(r"[^\S\n ]", text) or re.search("[\x1c-\x1f]", text):
            cut = re.split(r"(?<=\S) (?=\S)", text)
        return [cut[0], *[" " + x for x in cut[1:]]] if cut != [""] else []

    def _values(self, pieces: list[str]) -> list[bytes | int]:
        """The value of each piece; new pieces are learnt together."""
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        values = list(map(self.young.get, pieces))
        at, gaps = -1, []
        try:
            while True:
                gaps.append(at := values.index(None, at + 1))
        except ValueError:
            pass
        if gaps:
            self._learn(missing := list({pieces[i] for i in gaps}))
            for i in gaps:
                values[i] = self.young[pieces[i]]
            for p in missing:
                if len(p) > LONG_PIECE:
                    self.young.pop(p, None)
        return values

    def encode(self, texts: list[str]) -> list[bytes | int]:
        """Ids or counts of each text, as the library gives them for the whole text."""
        cut = [self.pieces(t) for t in texts]
        values, at, out = self._values([p for c in cut for p in c]), 0, []
        for c in cut:
            mine = values[at : at + len(c)]
            at += len(c)
            out.append(sum(mine) if self.counts else b"".join(mine))
        return out

    def encode_ids(self, texts: list[str]) -> list[bytes]:
        """encode() for ids, vectorised: the batch's distinct pieces are looked up once, and their ids gathered by NumPy."""
        if not self.drops_space or self.counts:
            return self.encode(texts)
        special = {i: t for i, t in enumerate(texts) if any(s in t for s in self.special) or not composed(t)}
        low = pc.ascii_lower(pa.array(["" if i in special else t for i, t in enumerate(texts)], pa.large_string()))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(low, MARK_AFTER_LETTER, r"\1 \2"))
        flat = words.flatten().dictionary_encode()
        known = self._rows(flat.dictionary)[flat.indices.to_numpy()]
        n = self.size[known]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.repeat(self.first[known] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[words.offsets.to_numpy()]
        out = [ids[x:y].tobytes() for x, y in pairwise(bounds)]
        for i, t in special.items():
            out[i] = self.encode([t])[0]
        return out

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """For each piece its row in first and size, which say where in pool its ids are; new pieces are added."""
        if len(self.known) > WORDS:
            self._forget()
        rows = pc.index_in(pieces, value_set=self.known)
        if rows.null_count:
            fresh = pieces.filter(rows.is_null())
            plain = pc.utf8_is_alpha(fresh)
            letters, others = fresh.filter(plain), fresh.filter(pc.invert(plain))
            ids, sizes = [self.pool], [self.size]
            for x, n in self._joined(letters.to_pylist()):
                ids.append(x)
                sizes.append(n)
            rest = list(self._ids(others.to_pylist()))
            ids.append(np.array([i for x in rest for i in x], "<u4"))
            sizes.append(np.array([len(x) for x in rest], np.int64))
            self.known = pa.concat_arrays([self.known, letters, others])
            self.size, self.pool = np.concatenate(sizes), np.concatenate(ids)
            self.first = np.cumsum(self.size) - self.size
            rows = pc.index_in(pieces, value_set=self.known)
        return rows.to_numpy()

    def _forget(self) -> None:
        self.known, self.pool = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.first = self.size = np.zeros(0, np.int64)

    def _joined(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many for each word) of words of letters alone, many in one call of the library."""
        for at in range(0, len(words), 400):
            some = words[at : at + 400]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.mark[ids]) + 1
            if len(ends) == len(some):
                yield ids, np.diff(ends, prepend=0)
            else:
                each = list(self._ids(some))
                yield np.array([i for x in each for i in x], "<u4"), np.array([len(x) for x in each])


def encoder(path: str, counts: bool = False) -> PieceEncoder:
    """One encoder per worker and vocabulary."""
    if (path, counts) not in _encoders:
        _encoders[path, counts] = PieceEncoder(path, counts)
    return _encoders[path, counts]


def balanced(rows: Iterator[tuple], size, limit: int = CALL_BYTES) -> Iterator[list[tuple]]:
    """Rows in lists of about `limit` bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text; no shuffle.

    Rows keep their number: a null text counts as empty (0 bytes, 0 tokens), null or repeated ids and repeated rows each give
    a row, an empty table gives none, and columns besides the two are not read. A text of any length is read whole by one task,
    and goes to the library in pieces that no token crosses.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        enc = encoder(vocabulary, counts=True)

        def rows():
            sized = ((i, t, n_bytes(t)) for i, t in in_rows(batches))
            for held in balanced(sized, lambda r: r[2]):
                for (i, _, size), n in zip(held, enc.encode([t for _, t, _ in held]), strict=True):
                    yield i, size, n

        yield from out_batches(rows(), schema)

    found = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
