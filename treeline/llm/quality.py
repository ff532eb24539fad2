"""Operator 8: quality by hashed word n-grams, logistic regression and follow-the-regularised-leader updates.

A word is a run without white space; its shape keeps punctuation and case but not the letters, and tells whether the
word repeats the one before. Runs of one and two
words and of one to three shapes are hashed into a fixed number of slots, and a text's vector holds the share of each
slot among all its n-grams, times a constant. Training takes a bounded number of labelled rows (``max_rows``, those with
the smallest hash of their id), as sparse vectors; scoring is a sparse dot product per text, without a shuffle.

Cases: null and empty texts have no n-grams and get the score of the bias; rows with a null label or without a text
to match don't train; repeated label rows train each; without any labelled row all scores are 0.5; a null id is never
held out. Columns other than the named ones are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.tokens import slices

BITS = 18
SCALE = 12.0
MAX_TRAINING_ROWS = 6000
KEPT_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME_AGAIN = np.uint64(0x5BD1E995)
_STEPS = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _shape(word: bytes) -> bytes:
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word.decode("utf-8", "replace"))
    return re.sub(r"\d+", "0", out).encode()[:24]


class _Words(dict):
    """Word to one integer: checksum of the word, and of its shape in the upper half."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word) | zlib.crc32(_shape(word)) << 32
        return value


_WORDS = _Words()


def ngram_slots(text: str) -> np.ndarray:
    """Slots of all n-grams of a whole text, with repeats."""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, dtype=np.int64)
    both = np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    shape[1:] ^= np.where(word[1:] == word[:-1], _SAME_AGAIN, np.uint64(0))
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        parts = [(word + np.uint64(1)) * _MIX, (shape + np.uint64(2 << 33)) * _MIX]
        for n, base in ((2, word), (2, shape), (3, shape)):
            key = base[: len(base) - n + 1].copy()
            for i in range(1, n):
                key = key * _STEPS[i] + base[i : len(base) - n + 1 + i]
            key ^= key >> np.uint64(29)
            parts.append((key + np.uint64(n + (3 if base is shape else 0))) * _STEPS[0] * _MIX)
    return (np.concatenate(parts) >> shift).astype(np.int64)


class FtrlProximal:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS, passes: int = 4) -> np.ndarray:
    """Weights learnt from at most ``max_rows`` labelled rows that aren't held out; the bias comes last.

    Vectors are made on the executors; the driver holds ``max_rows`` sparse vectors.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    rows = rows.withColumn("order", F.xxhash64("id")).orderBy("order", "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id")  # rows: bounded by max_rows

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [np.unique(ngram_slots(t or ""), return_counts=True) for t in part.column("text").to_pylist()]
            at = [x[0].astype("<u4").tobytes() for x in found]
            share = [(SCALE * x[1] / max(x[1].sum(), 1)).astype("<f4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["order", "label", "at", "share"])

    table = texts.select("order", "label", "text").mapInArrow(vectors, "order bigint, label int, at binary, share binary").toArrow()
    table = table.sort_by([("order", "ascending"), ("label", "ascending"), ("at", "ascending")])
    model = FtrlProximal(1 << BITS)
    truth, ats, shares = (table.column(c).to_pylist() for c in ("label", "at", "share"))
    for _ in range(passes):
        for y, at, share in zip(truth, ats, shares, strict=True):
            model.learn(np.append(np.frombuffer(at, dtype="<u4").astype(np.int64), 1 << BITS), np.append(np.frombuffer(share, dtype="<f4").astype(float), 1.0), y)
    return model.weights()


def score_text(text: str | None, weights: np.ndarray) -> float:
    at = ngram_slots(text or "")
    total = float(weights[at].sum()) * SCALE / max(len(at), 1) + float(weights[-1])
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            scores = np.array([score_text(t, weights) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    frame = docs.select(id_col, text_col)
    kind = frame.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(run, f"{id_col} {kind}, score double, predicted int").select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text scores ``threshold`` or more."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            keep = [score_text(t, weights) >= threshold for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(part.columns, names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
