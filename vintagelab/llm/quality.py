"""Operator 7, quality classifier: naive Bayes support vectors.

A text has n-grams of two kinds: one to three token shapes (runs of small letters, capitals, digits and each mark; a token equal
to the one before it is told apart), which tell how it is written, and one or two words, which tell what it is about. Indicators
(a gram occurs; of shapes also: it makes up a twentieth, or a third, of all) are scaled by the log-count ratio of the classes, a
linear hinge-loss model is fitted to them by dual coordinate descent, and a logistic curve turns margins into scores. The rows of
each kind have a Euclidean length of one, so neither drowns the other in long texts.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_rows, out_batches, positional, release_memory, text_or_empty
from .decontaminate import words_of
from .neardup import shingle_hashes

#: Places for indicators of shapes, and after them for those of words.
SPACE, WORDS = 1 << 18, 1 << 20
#: The model is fitted on so many labelled rows of each class at most, and on so many indicators of them together.
SAMPLE, SAMPLE_INDICATORS = 6000, 8_000_000
#: Rows of the sample in which an indicator must occur to have a weight.
LEAST_ROWS = 5
#: The length of the word part of a row, that of the shape part being one.
WORD_PART = 0.5
#: Shares of all grams of an order from which a gram has a further indicator.
SHARES = (0.05, 0.33)
_SHAPE = bytes(32 if b in b" \t\n\r\x0b\x0c" else 97 if 0x61 <= b <= 0x7A or b >= 0x80 else 65 if 0x41 <= b <= 0x5A else 57 if 0x30 <= b <= 0x39 else b for b in range(256))


def features(text: str) -> np.ndarray:
    """Sorted indices of the text's indicators, those of shapes first; an empty text has one of its own."""
    raw = text.encode("utf-8")
    words = raw.split()
    if not words:
        return np.array([zlib.crc32(b"empty") % SPACE], np.int32)
    shape = np.frombuffer(b" ".join(words).translate(_SHAPE), np.uint8)
    shapes = shape[np.concatenate(([True], shape[1:] != shape[:-1]))].tobytes().split(b" ")
    again = [False, *map(operator.eq, words[1:], words)]
    if True in again:
        shapes = [s + b"=" if a else s for s, a in zip(shapes, again, strict=True)]
    out = set()
    for order, grams in enumerate((Counter(shapes), Counter(zip(shapes, shapes[1:])), Counter(zip(shapes, shapes[1:], shapes[2:])))):
        total = len(shapes) - order
        for gram, n in grams.items():
            key = gram if order == 0 else b" ".join(gram)
            at = zlib.crc32(key, order)
            out.add(at % SPACE)
            for level, share in enumerate(SHARES, 1):
                if n >= share * total:
                    out.add(zlib.crc32(b"%d" % level, at) % SPACE)
    parts, words = [np.array(sorted(out), np.int32)], words_of(text)
    if words:
        hashes = shingle_hashes(words, 1)
        if len(words) > 1:
            hashes = np.concatenate((hashes, shingle_hashes(words, 2)))
        parts.append(np.unique((hashes >> np.uint64(20)) % np.uint64(WORDS)).astype(np.int32) + SPACE)
    return np.concatenate(parts)


def values(x: np.ndarray) -> np.ndarray:
    """The value of each of a row's indicators before scaling: the shape part has length one, the word part WORD_PART."""
    k = int(np.searchsorted(x, SPACE))
    return np.concatenate((np.full(k, max(1, k) ** -0.5), np.full(len(x) - k, WORD_PART * max(1, len(x) - k) ** -0.5)))


@dataclass
class Model:
    """weights already hold the log-count ratios; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x] @ values(x)) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -500, 500))))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-regularised hinge-loss model over rows of indicators times scale, one dual variable at a time."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    given = [(r[scale[r] != 0], (scale[r] * values(r))[scale[r] != 0]) for r in rows]
    square = np.array([1.0 + float(v @ v) for _, v in given])
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            r, s = given[i]
            g = y[i] * (float(w[r] @ s) + bias) - 1.0
            old = alpha[i]
            alpha[i] = min(max(old - g / square[i], 0.0), cost[i])
            if step := (alpha[i] - old) * y[i]:
                w[r] += step * s
                bias += step
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, smooth: float = 1.0, cost: float = 1.0) -> Model | None:
    """The model of rows with labels 0 and 1; prior is the share of label 1 among all labelled rows. None if a class is missing."""
    y = np.where(labels > 0, 1.0, -1.0)
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    if not n1 or not n0:
        return None
    p, q = np.full(SPACE + WORDS, smooth), np.full(SPACE + WORDS, smooth)
    for r, s in zip(rows, y, strict=True):
        (p if s > 0 else q)[r] += 1
    ratio = np.log((p / (n1 + 2 * smooth)) / (q / (n0 + 2 * smooth)))
    ratio[p + q < min(LEAST_ROWS, len(rows)) + 2 * smooth] = 0.0
    weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
    w, bias = dual_descent(rows, ratio, y, cost * weight)
    model = Model(w * ratio, bias, 1.0, 0.0)
    # The curve: logistic regression of the labels on the margin, with rows weighted to the prior, by Newton's method.
    m = np.array([model.margin(r) for r in rows])
    share = np.where(y > 0, prior / n1, (1 - prior) / n0)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        f = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = np.array([(share * (f - target) * m).sum() + 1e-6 * a, (share * (f - target)).sum()])
        v = share * np.maximum(f * (1 - f), 1e-9)
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(max(a, 1e-6)), float(b)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out: crc32 of the id as text, modulo 4, is 2 (a null id is not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fits on the per_class labelled ids of each class with the least hashes, held-out ids left out, as long as their indicators
    are SAMPLE_INDICATORS at most.

    These bounds keep the fit's size fixed whatever the corpus, the lengths of its texts and the repetition of its ids: an id in
    many rows counts once, by its least row of indicators; ids labelled twice count by their largest label, null labels and null
    ids not at all; without labels of both classes (or on empty tables) there is no model. Null texts are empty, and texts of any
    length are read whole. An indicator that fewer than LEAST_ROWS of the sample's rows have is given no weight."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    some = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])
    wanted = documents.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some[0].union(some[1])), "id")
    found = wanted.select("id", "label", "text").mapInArrow(lambda b: out_batches(((i, y, features(t).tobytes()) for i, y, t in in_rows(b)), schema), "id long, label int, x binary")
    once = found.groupBy("id", "label").agg(F.min("x").alias("x"))
    before = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    once = once.withColumn("held", F.coalesce(F.sum(F.length("x")).over(before), F.lit(0))).where(F.col("held") < 2 * SAMPLE_INDICATORS)
    rows = sorted((r.id, r.label, bytes(r.x)) for r in once.collect())
    return fit([np.frombuffer(x, np.int32) for _, _, x in rows], np.array([y for _, y, _ in rows]), counts[1] / (counts[0] + counts[1]))


def scored(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, held_out, score and predicted of every whole text; no shuffle.

    Without a model (no labels of one of the classes) each score is 0.5. A null text is empty and scored as such; null and
    repeated ids and repeated rows each give a row, equal texts equal scores; a score equal to the threshold passes; texts of any
    length are read whole, by one task each; an empty table gives none; other columns are not read."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def rows(batches):
        m = sent.value
        for i, t in in_rows(batches):
            yield i, m.score(features(t)) if m else 0.5

    found = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(lambda b: out_batches(rows(b), schema), "id long, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """df's rows whose texts score `threshold` or more (all of them without a model); nothing is shuffled.

    All columns stay, whatever their names; a null text is scored as an empty one and stays null; repeated rows stay or go
    together; texts of any length are read whole; an empty table stays empty."""
    if model is None:
        return df
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def keep(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                good = [sent.value.score(features(t or "")) >= threshold for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(good, pa.bool_()))
        release_memory()

    rows = positional(df)
    return rows.mapInArrow(keep, rows.schema).toDF(*df.columns)
