"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed to ``BUCKETS``
rows of an embedding table; so a misspelling or an unseen form shares vectors
with the words it resembles. A word of over ``CHUNK`` characters is a sequence
of chunks, which stand in the windows like words and overlap so that each of its
n-grams is in one of them. The vectors of a window of words are averaged and
go through a linear softmax. A document's score is that of its most toxic
window, so a few words count in a text of any length. Embeddings and softmax
are trained together by Adam on the log loss, first on whole documents, then
through the window of each document that scores highest.

After training the softmax of two classes needs one number a bucket, the inner
product of its vector with the difference of both class vectors.

Defined cases: a null or empty text scores the bias alone; with no labelled rows
every score is 0.5; whole texts count; repeated rows are scored each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import id_crc, in_worker, text_of
from timberline.llm.labelled import sample

BITS, DIMENSIONS = 17, 8
BUCKETS = 1 << BITS
#: Lengths of character n-grams, words of a window, steps on whole documents and on windows.
SHORT, LONG, WINDOW, WHOLE_STEPS, STEPS = 3, 5, 4, 20, 60
RATE, SCALE, DECAY = 0.05, 8.0, 0.1
REMEMBERED = 400_000
#: Labelled rows that training reads at most.
SAMPLE_ROWS = 6_000
#: Characters of a chunk.
CHUNK = 400
_PRIME = np.uint64(0x100000001B3)
_STRIP = b".,;:!?\"'()[]{}*#$%&|"


def marked(word: bytes) -> str:
    return "<" + word.strip(_STRIP).decode("utf-8", "replace") + ">"


def subwords(words: list[bytes | str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of characters of each word, with marks at both ends, and of each chunk as it is; how many each has. All words at once."""
    marks = [w if isinstance(w, str) else marked(w) for w in words]
    size = np.array([len(m) for m in marks], dtype=np.int64)
    char = np.frombuffer("".join(marks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = (start + size)[word] - np.arange(len(char))  # characters of the word from here on
    power = _PRIME ** (np.arange(int(size.max(initial=1)), dtype=np.uint64))
    whole = np.add.reduceat(char * power[np.arange(len(char)) - start[word]], start) if len(char) else char
    found, of = [_bucket(whole, 1)], [np.arange(len(words))]
    h = char
    for k in range(2, LONG + 1):
        h = h[: len(char) - k + 1] * _PRIME + char[k - 1 :]
        if k >= SHORT:
            at = np.flatnonzero(left[: len(h)] >= k)
            found.append(_bucket(h[at], k))
            of.append(word[at])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order], np.bincount(of, minlength=len(words))


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def in_chunks(words: list[bytes]) -> list[bytes | str]:
    """The words, longer ones as their chunks."""
    out: list[bytes | str] = []
    for w in words:
        if len(w) > CHUNK and len(s := marked(w)) > CHUNK + 2:
            out += [s[i : i + CHUNK] for i in range(0, len(s) - LONG + 1, CHUNK - LONG + 1)]
        else:
            out.append(w)
    return out


def train(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """A number for each bucket, and the bias."""
    if not len(texts) or labels.min() == labels.max():
        rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(texts) else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate)))
    rng, ids = np.random.default_rng(11), {}
    tokens, size = array("i"), array("i")
    for t in texts:
        words = in_chunks(t.lower().split()) or [b""]
        tokens.extend([ids.setdefault(w, len(ids)) for w in words])
        size.append(len(words))
    bucket, many = subwords(list(ids))
    n_words = len(ids)
    del ids
    token, size = (np.frombuffer(x, np.int32) for x in (tokens, size))
    bag = np.repeat(np.arange(n_words, dtype=np.int32), many)
    begin = np.concatenate([[0], np.cumsum(many)[:-1]])
    end = np.cumsum(size)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    ends = np.minimum(np.arange(len(token), dtype=np.int32) + WINDOW, end.astype(np.int32)[doc])  # of the window that begins at each token

    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    classes, bias = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("vectors", vectors), ("classes", classes), ("bias", bias))}
    positive = labels.mean()
    cost = np.where(labels > 0, 0.5 / positive, 0.5 / (1 - positive)) ** 0.5
    cost /= cost.sum()
    for step in range(WHOLE_STEPS + STEPS):
        turn = classes[1] - classes[0]
        word = np.add.reduceat((vectors @ turn)[bucket], begin) / many
        total = np.concatenate([[0.0], np.cumsum(word.astype(np.float32)[token], dtype=np.float64)])
        if step < WHOLE_STEPS:
            first, last = end - size, end
        else:
            value = ((total[ends] - total[:-1]) / (ends - np.arange(len(token), dtype=np.int32))).astype(np.float32)
            best = np.maximum.reduceat(value, end - size)
            hit = np.flatnonzero(value == best[doc])
            _, one = np.unique(doc[hit], return_index=True)
            first = hit[one]
            last = ends[first]
        n = last - first
        logit = SCALE * (total[last] - total[first]) / n + bias[1] - bias[0]
        error = cost * (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - labels)
        del total
        share = (SCALE * error / n).astype(np.float32)
        if step < WHOLE_STEPS:
            by_word = np.bincount(token, share[doc], n_words) / many
        else:
            at = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in zip(first, last)])
            by_word = np.bincount(token[at], np.repeat(share, n), n_words) / many
        by_bucket = np.bincount(bucket, by_word.astype(np.float32)[bag], BUCKETS)
        toward = by_bucket @ vectors
        grads = {"vectors": by_bucket[:, None].astype(np.float32) * turn + DECAY / len(texts) * vectors, "classes": np.stack([-toward, toward]).astype(np.float32), "bias": np.array([-error.sum(), error.sum()], np.float32)}
        for k, v in (("vectors", vectors), ("classes", classes), ("bias", bias)):
            a, b = moments[k]
            a += 0.1 * (grads[k] - a)
            b += 0.01 * (grads[k] ** 2 - b)
            v -= RATE * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-8)
    return (SCALE * (vectors @ (classes[1] - classes[0]))).astype(np.float32), float(bias[1] - bias[0])


class Words(dict):
    """Word -> mean number of its buckets; words are learned many at once."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def learn(self, words: list[bytes | str]) -> None:
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            bucket, many = subwords(some)
            self.update(zip(some, (np.add.reduceat(self.table[bucket].astype(np.float64), np.cumsum(many) - many) / many).tolist()))


def values(texts: list[bytes], words: Words) -> np.ndarray:
    """Each text's highest mean over a window of words; 0 for texts without words."""
    found = [t.lower().split() for t in texts]
    all_words = set().union(*found)
    new = all_words.difference(words)
    if any(len(w) > CHUNK for w in new):  # such a word is never remembered whole
        long = {w for w in new if len(w) > CHUNK}
        found = [f if long.isdisjoint(f) else in_chunks(f) for f in found]
        all_words = set().union(*found)
        new = all_words.difference(words)
    if len(words) + len(new) > REMEMBERED:
        new = all_words  # the memory begins anew
    words.learn(list(new))
    size = np.array([len(f) for f in found])
    v = np.array([x for f in found for x in map(words.__getitem__, f)])
    for w in [w for w in new if len(w) > CHUNK and isinstance(w, bytes)]:
        del words[w]
    out = np.zeros(len(texts))
    if not len(v):
        return out
    total = np.concatenate([[0.0], np.cumsum(v)])
    at = np.arange(len(v))
    ends = np.minimum(at + WINDOW, np.repeat(np.cumsum(size), size))
    some = size > 0
    out[some] = np.maximum.reduceat((total[ends] - total[:-1]) / (ends - at), (np.cumsum(size) - size)[some])
    return out


def value(text: bytes, words: Words) -> float:
    return float(values([text], words)[0])


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, held_out, score, predicted; rows of the held-out fold teach nothing."""
    held_out = lambda crc: crc % folds == fold
    table, bias = train(*sample(docs, labels, "toxic", held_out, id, text, rows))
    model = f"toxicity {uuid.uuid4().hex}"  # a worker's words belong to one model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = in_worker(model, lambda: Words(table))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                logits = bias + values(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))], ["__id", "score"])

    kind = docs.select(F.col(id).alias("__id")).schema[0].dataType.simpleString()
    out = docs.select(F.col(id).alias("__id"), text_of(text).cast("binary").alias("__text")).mapInArrow(run, f"__id {kind}, score double")
    return out.select(F.col("__id").alias(id), held_out(id_crc("__id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
