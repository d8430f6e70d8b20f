"""Quality classifier: naive Bayes support vectors.

Indicators of byte, word and word-shape n-grams are scaled by their class
log-count ratios, and a linear hinge-loss model is fitted to them by dual
coordinate descent. Fitting takes a bounded sample of the labelled rows, chosen
by hash (``per_class`` documents of each class, one row each); scoring reads every document whole,
in one pass and without a shuffle.

Defined cases: labels other than 0 and 1 are ignored; a document with several
labels counts by the least; if a class has no labelled document there is no
model, margins are null and all texts that aren't blank are accepted. Null and
blank texts have a null margin and are rejected. Repeated rows are scored one
by one; in the sample an id counts once, by the least of its texts. Long texts are read in overlapping pieces. Input columns named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm.textarrays import SLICE_BYTES, U64, flat, mix, pieces, word_hashes, words

FEATURES = 1 << 19


@dataclass(frozen=True)
class QualityModel:
    """Weights of the n-gram features, ratio already multiplied in, and the bias."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    n_positive: int
    n_negative: int


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """8 bits for each word: repeats the one before, capitals, symbols, length."""
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int32)
        np.cumsum(flag, out=total[1:])
        return total[ends] - total[starts]

    n_upper, n_lower = count(upper), count(lower)
    symbols = np.minimum(count(~(upper | lower | digit)), 3)
    size = np.searchsorted([2, 4, 7, 11, 16, 30], ends - starts, "right")
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    return (same * 128 + upper[starts] * 64 + ((n_upper > 1) & (n_lower == 0)) * 32 + symbols * 8 + size).astype(np.int64)


def features(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """Row number and distinct feature ids of every row."""
    stamp = np.zeros(FEATURES, np.int64)
    waiting: tuple[int, np.ndarray] | None = None  # of a long row, until its last piece has come
    for data, off, first, base in pieces(batch, 3, text, SLICE_BYTES):
        starts, ends, word_off = words(data, off)
        hashes = word_hashes(data, starts, ends)
        shape = _shapes(data, starts, ends, hashes) if len(starts) else np.zeros(0, np.int64)
        wide = data.astype(np.int32)
        two = wide[:-1] * 256 + wide[1:]
        three = ((two[:-1].astype(np.int64) * 256 + wide[2:]) * 0x9E3779B1 >> 13 & 0xFFFF) + 0x10000
        shape2 = shape[:-1] * 256 + shape[1:] + 0x20000
        shape3 = (((shape[:-2] * 256 + shape[1:-1]) * 256 + shape[2:]) * 0x85EBCA6B >> 11 & 0xFFFF) + 0x30000
        with np.errstate(over="ignore"):
            one_word = (hashes >> U64(47)).astype(np.int64) + 0x40000
            two_words = (mix(hashes[:-1] * U64(3) + hashes[1:]) >> U64(47)).astype(np.int64) + 0x60000
        for i in range(len(off) - 1):
            a, b, v, w = off[i], off[i + 1], word_off[i], word_off[i + 1]
            known = v + (base > 0)  # a later piece doesn't know what came before its first word
            found = np.concatenate([two[a : max(a, b - 1)], three[a : max(a, b - 2)], shape2[known : max(known, w - 1)], shape3[known : max(known, w - 2)], one_word[v:w], two_words[v : max(v, w - 1)]])
            place = np.arange(len(found))
            stamp[found] = place
            found = found[stamp[found] == place]
            if waiting and waiting[0] == first + i:
                waiting = (first + i, np.union1d(waiting[1], found))
                continue
            if waiting:
                yield waiting
            waiting = (first + i, found)
    if waiting:
        yield waiting


def _descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """L2-loss linear support vectors by dual coordinate descent, on rows of unit length."""
    edge = np.cumsum([0, *map(len, rows)])
    held = np.empty(edge[-1])  # one array, which goes back to the system afterwards, as many small ones don't
    values = [held[a:b] for a, b in zip(edge[:-1], edge[1:])]
    for x, out in zip(rows, values):
        v = ratios[x]
        out[:] = v / max(np.sqrt(v @ v + 1e-12), 1e-6)
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    share = np.where(labels > 0, len(labels) / (2 * (labels > 0).sum()), len(labels) / (2 * (labels < 0).sum()))
    diagonal = 1 / (2 * cost * share)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], labels[i]
            gradient = y * (weights[x] @ v + bias) - 1 + diagonal[i] * alpha[i]
            projected = min(gradient, 0.0) if alpha[i] == 0 else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = max(alpha[i] - gradient / (v @ v + 1 + diagonal[i]), 0.0)
                weights[x] += (new - alpha[i]) * y * v
                bias += (new - alpha[i]) * y
                alpha[i] = new
        if worst < 1e-3:
            break
    return weights, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, *, smoothing: float = 1.0, cost: float = 4.0, blend: float = 0.25, epochs: int = 40) -> QualityModel | None:
    """A model of distinct feature ids by row and labels +1 / -1; None if a class is missing."""
    positive, negative = int((labels > 0).sum()), int((labels < 0).sum())
    if not positive or not negative:
        return None
    p, q = np.full(FEATURES, smoothing), np.full(FEATURES, smoothing)
    for x, y in zip(rows, labels):
        (p if y > 0 else q)[x] += 1
    ratios = np.log(p / (positive + 2 * smoothing)) - np.log(q / (negative + 2 * smoothing))
    weights, bias = _descend(rows, labels, ratios, cost, epochs)
    used = np.abs(weights).sum() / max(np.count_nonzero(weights), 1)
    weights = (1 - blend) * weights + blend * used * np.sign(ratios) * (weights != 0)
    return QualityModel(weights, ratios, float(bias), positive, negative)


def margins(model: QualityModel, batch: pa.RecordBatch, text: str = "text") -> np.ndarray:
    out = np.empty(batch.num_rows)
    for i, x in features(batch, text):
        v = model.ratios[x]
        out[i] = (model.weights[x] @ v) / max(np.sqrt(v @ v + 1e-12), 1e-6) + model.bias
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class, one row each."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64("doc_id")
    parts = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    # 2 * per_class ids at most, so a broadcast is safe at any size of the corpus
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id").where(F.col("text").isNotNull())
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000) -> QualityModel | None:
    """A model of the labelled documents; see the module for the sample and the cases."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype(np.int32).tobytes() for _, x in features(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    found = training_rows(docs, labels, "quality", per_class).mapInArrow(extract, "doc_id bigint, label int, found binary").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    y = np.where(found.column("label").to_numpy() == 1, 1, -1)[order]
    data, off = flat(found.column("found"))
    feature, off = data.view("<i4"), off // 4
    return fit([feature[off[i] : off[i + 1]] for i in order], y)


def _scored(docs: DataFrame, model: QualityModel | None, threshold: float) -> DataFrame:
    """The rows and columns of ``docs`` with margin and accepted."""
    kept = [f for f in docs.schema if f.name not in ("margin", "accepted")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    blank = F.col("text").isNull() | F.col("text").rlike("^[ \\t\\n\\r\\f\\x0B]*$")
    if model is None:
        return docs.withColumns({"margin": F.lit(None).cast("double"), "accepted": ~blank})
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.ratios.astype(np.float32), model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, ratios, bias = shared.value
        one = QualityModel(weights, ratios, bias, 0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margins(one, batch))], [*batch.schema.names, "margin"])

    out = docs.mapInArrow(score, T.StructType([*kept, T.StructField("margin", T.DoubleType())]))
    out = out.withColumn("margin", F.when(~blank, F.col("margin")))
    return out.withColumn("accepted", F.coalesce(F.col("margin") >= threshold, F.lit(False)))


def score(docs: DataFrame, model: QualityModel | None, *, threshold: float = 0.0) -> DataFrame:
    """(doc_id, margin, accepted) of every document."""
    return _scored(docs.select("doc_id", "text"), model, threshold).select("doc_id", "margin", "accepted")


def keep_good(docs: DataFrame, model: QualityModel | None, *, threshold: float = 0.0) -> DataFrame:
    """The accepted documents, with the columns of ``docs``."""
    mine: list[Column] = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*mine).alias("row"), F.col("text"))
    return _scored(marked, model, threshold).where("accepted").select("row.*")
