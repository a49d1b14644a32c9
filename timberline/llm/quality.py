"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

The n-grams are single words and pairs, hashed to ``BUCKETS``; beside the word
itself its shape counts (runs of letters and digits shrunk to one sign; a
repeated word has a shape of its own), so that words never seen before count
too. A text's value is the mean weight of its n-grams, a sparse dot product.

Defined cases: a null or empty text scores the bias alone; with no labelled
rows every score is 0.5; texts of any length are scored whole; repeated rows
are scored each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import id_crc, in_worker, text_of
from timberline.llm.labelled import SAMPLE_ROWS, sample

BUCKETS = 1 << 20
#: Learning rate, its smoothing, and both penalties of follow-the-regularised-leader.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
EPOCHS = 3
#: Words that a task remembers.
REMEMBERED = 200_000
_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


class Words(dict):
    """Word -> hash of the word in the low half, of its shape in the high half."""

    def __missing__(self, word: bytes) -> int:
        shape = word
        for what, sign in _SHAPES:
            shape = what.sub(sign, shape)
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = zlib.crc32(shape) << 32 | zlib.crc32(word)
        return h


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def grams(text: bytes, words: Words) -> np.ndarray:
    """The buckets of all n-grams of a text."""
    h = np.array(list(map(words.__getitem__, text.split())), dtype=np.uint64)
    word, shape = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    shape[1:][h[1:] == h[:-1]] = 1
    turn = np.uint64(0x2545F4914F6CDD1D)
    return np.concatenate([_mix(word, 1), _mix(word[:-1] * turn + word[1:], 2), _mix(shape, 3), _mix(shape[:-1] * turn + shape[1:], 4)])


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    z, n, w = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not len(texts):
        return w[:-1].astype(np.float32), 0.0
    words, rng, rows = Words(), np.random.default_rng(7), []
    for text in texts:
        at, count = np.unique(grams(text, words), return_counts=True)
        rows.append((np.append(at, BUCKETS).astype(np.int32), np.append(20 * count / max(1, count.sum()), 1.0).astype(np.float32)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - labels[i]) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - sigma * wi
            n[at] += g * g
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w[:-1].astype(np.float32), float(w[-1])


def scorer(weights: np.ndarray, bias: float) -> Callable[[Words, list[bytes]], list[float]]:
    used = np.flatnonzero(weights)
    sparse = (used.astype(np.int32), weights[used])  # what is sent to the tasks

    def score(words: Words, texts: list[bytes]) -> list[float]:
        w = getattr(words, "weights", None)
        if w is None:
            w = words.weights = np.zeros(BUCKETS, np.float32)
            w[sparse[0]] = sparse[1]
        out = []
        for text in texts:
            at = grams(text, words)
            value = bias + (20 * float(w[at].sum(dtype=np.float64)) / len(at) if len(at) else 0.0)
            out.append(1 / (1 + float(np.exp(-np.clip(value, -35, 35)))))
        return out

    return score


def scored(docs: DataFrame, score: Callable[[Words, list[bytes]], list[float]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, score of each text; nothing but the text is read for the score."""

    model = f"quality {uuid.uuid4().hex}"  # a worker's words belong to one model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = in_worker(model, Words)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(words, part.column(1).to_pylist()), pa.float64())], ["__id", "score"])

    kind = docs.select(F.col(id).alias("__id")).schema[0].dataType.simpleString()
    return docs.select(F.col(id).alias("__id"), text_of(text).cast("binary").alias("__text")).mapInArrow(run, f"__id {kind}, score double")


def learned(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS):
    return scorer(*train(*sample(docs, labels, label, held_out, id, text, rows)))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 3, fold: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, held_out, score, predicted; rows of the held-out fold teach nothing."""
    held_out = lambda crc: crc % folds == fold
    out = scored(docs, learned(docs, labels, held_out, "quality", id, text, rows), id, text)
    return out.select(F.col("__id").alias(id), held_out(id_crc("__id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5, folds: int = 3, fold: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score at least ``least``, with all their columns; the text passes the tasks once."""
    score = learned(docs, labels, lambda crc: crc % folds == fold, "quality", id, text, rows)
    at = docs.columns.index(text)

    model = f"quality {uuid.uuid4().hex}"  # a worker's words belong to one model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = in_worker(model, Words)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array([x >= least for x in score(words, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
