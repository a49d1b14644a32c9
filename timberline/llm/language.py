"""Language identification by unigrams of pieces, with all segmentations of a word summed.

The pieces are the lower-case letter pieces of a public vocabulary; none is learned.
Each language has a probability for each piece, estimated by expectation and
maximisation over all segmentations of its words. A word's probability in a
language is the sum over all its segmentations, by a forward pass; a text's is the
product of those of its words and of the language's share of the training
documents. The prediction is the likeliest language, the score its probability
among the learned ones.

Training words come from at most ``SAMPLE_ROWS`` texts and about ``SAMPLE_CHARS`` characters
of each language, texts taken by a hash, of the ``LANGUAGES`` languages with the
most training documents; each language is estimated in a task of its own. Shares
are counted over all training documents. Scores read every text whole: its words
are the runs of letters in lower case, and a worker remembers the
words that it has summed.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0, and
so is every text where no document teaches a language; rows with a null language
teach nothing; a letter without a piece has the same small probability in every
language; repeated rows are scored each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import id_crc, in_worker, text_of

LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS = 256, 2_000, 2_000_000
ROUNDS = 5
#: Weight of the mean of all languages against a language's own pieces, and the probability of a letter without a piece.
BACKGROUND, UNKNOWN = 0.01, 1e-7
#: Letters of a piece at most, and of a word that teaches; every word is scored.
PIECE, TAUGHT = 16, 48
#: Words that a worker remembers.
REMEMBERED = 300_000
START, UNDETERMINED = "▁", "und"
_RUN = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of the vocabulary file that are letters in lower case, perhaps after the sign of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if len(p) <= PIECE and p == p.lower() and (p == START or p.removeprefix(START).isalpha())})


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words with their start sign, padded by zeros, and the lengths."""
    sizes = np.array([len(w) + 1 for w in words])
    out = np.zeros((len(words), int(sizes.max())), dtype=np.uint64)
    flat = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


class Pieces:
    """Numbers of the pieces of a vocabulary, found by hashes of code points for many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        hashes = np.zeros(self.n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = np.uint64(0)
                for c in p:
                    h = (h + np.uint64(ord(c))) * _BASE
                hashes[i] = h
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.single = np.sort(np.array([ord(p) for p in pieces if len(p) == 1], dtype=np.uint64))

    def ending(self, codes: np.ndarray, hashes: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the substrings that end with letter ``at``, the longest first, and their pieces; n where there is none, n + 1 for an unknown letter."""
        c = codes[:, at : at + 1]
        with np.errstate(over="ignore"):
            hashes = (np.concatenate([hashes, np.zeros_like(c)], axis=1)[:, -PIECE:] + c) * _BASE
        place = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        ids = np.where(self.hashes[place] == hashes, self.numbers[place], self.n)
        place = np.minimum(np.searchsorted(self.single, c[:, 0]), len(self.single) - 1)
        ids[self.single[place] != c[:, 0], -1] = self.n + 1
        return hashes, ids


def logs(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probabilities (word, language): the forward pass over all segmentations. ``table``: (piece, language), with the rows of no piece and of an unknown letter at its end."""
    out, k = np.zeros((len(words), table.shape[1])), table.shape[1]
    order = np.argsort([-len(w) for w in words], kind="stable")
    step = max(1, 2_000_000 // (PIECE * max(1, k)))
    for lo in range(0, len(words), step):
        some = order[lo : lo + step]
        codes, sizes = _codes([words[i] for i in some.tolist()])
        alpha, hashes, scale = np.ones((len(some), 1, k)), np.zeros((len(some), 0), dtype=np.uint64), np.zeros(len(some))
        for at in range(codes.shape[1]):
            n = int(np.searchsorted(-sizes, -at, side="left"))  # words that have this letter
            codes, alpha, hashes = codes[:n], alpha[:n], hashes[:n]
            hashes, ids = pieces.ending(codes, hashes, at)
            now = np.einsum("wil,wil->wl", alpha, table[ids])
            alpha = np.concatenate([alpha, now[:, None]], axis=1)[:, -PIECE:]
            if at % 8 == 7:
                top = alpha.max(axis=(1, 2))  # of all languages alike
                alpha = alpha / top[:, None, None]
                scale[:n] += np.log(top)
            ends = np.flatnonzero(sizes[:n] == at + 1)
            out[some[ends]] = np.log(np.maximum(alpha[ends, -1], 1e-300)) + scale[ends, None]
    return out


def expected(pieces: Pieces, table: np.ndarray | None, words: list[str], times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all segmentations; without a table, how often it occurs in them."""
    counts = np.zeros(pieces.n + 2)
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    for _, at_words in sorted(by_size.items()):
        for lo in range(0, len(at_words), 20_000):
            some = at_words[lo : lo + 20_000]
            codes, sizes = _codes([words[i] for i in some])
            weight, n, hashes, arcs = times[some].astype(float), int(sizes[0]), np.zeros((len(some), 0), dtype=np.uint64), []
            for at in range(n):
                hashes, ids = pieces.ending(codes, hashes, at)
                arcs.append(ids)
            if table is None:
                for ids in arcs:
                    counts += np.bincount(ids.ravel(), np.repeat(weight, ids.shape[1]), minlength=len(counts))
                continue
            p = [20.0 * table[ids] if ids.shape[1] == 1 else table[ids] * 20.0 ** np.arange(ids.shape[1], 0, -1) for ids in arcs]  # the same factor a letter, against underflow
            ahead = np.zeros((n + 1, len(some)))
            ahead[0] = 1.0
            for at in range(n):
                width = p[at].shape[1]
                ahead[at + 1] = (ahead[at + 1 - width : at + 1].T * p[at]).sum(axis=1)
            behind = np.zeros((n + 1, len(some)))
            behind[n] = weight / np.where(ahead[n] > 0, ahead[n], np.inf)
            for at in range(n - 1, -1, -1):
                width = p[at].shape[1]
                through = p[at] * behind[at + 1][:, None]
                behind[at + 1 - width : at + 1] += through.T
                counts += np.bincount(arcs[at].ravel(), (through * ahead[at + 1 - width : at + 1].T).ravel(), minlength=len(counts))
    counts[pieces.n :] = 0
    return counts


def estimate(pieces: Pieces, words: list[str], times: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Expected counts of the pieces of one language."""
    counts = expected(pieces, None, words, times)
    for _ in range(rounds):
        table = np.append(counts[: pieces.n] / max(counts[: pieces.n].sum(), 1e-9), [0.0, UNKNOWN])
        counts = expected(pieces, table, words, times)
    return counts[: pieces.n]


def probabilities(counts: np.ndarray) -> np.ndarray:
    """(piece, language), with two more rows, from counts (language, piece)."""
    own = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
    mean = (own.mean(axis=0) + 1e-9) / (own.mean(axis=0) + 1e-9).sum()
    p = (1 - BACKGROUND) * own + BACKGROUND * mean
    return np.concatenate([p.T, np.zeros((1, len(p))), np.full((1, len(p)), UNKNOWN)])


def _sampled(docs: DataFrame, held_out, id: str, text: str, lang: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    """lang, text of the sample, and the languages with the number of their training documents."""
    rows = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(~held_out(id_crc("id"))).withColumn("h", F.xxhash64("id", "text"))
    languages = [(r[0], r[1]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    sizes = rows.filter(F.col("lang").isin([x for x, _ in languages])).select("lang", "h", F.char_length("text").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n") > SAMPLE_CHARS // 10, "h", "n")
    first = sizes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_ROWS)  # each task hands on no more a language
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    picked = first.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") == 0) | (F.col("before") + F.col("n") <= SAMPLE_CHARS))
    chosen = docs.sparkSession.createDataFrame(picked.select("lang", "h").distinct().collect(), "lang string, h long")  # at most SAMPLE_ROWS a language
    return rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "text"), languages


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                counts.update((lang, w) for w in _RUN.findall(text.lower()) if len(w) <= TAUGHT)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, held_out, vocab: list[str], id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log shares, and probabilities (piece, language)."""
    sample, languages = _sampled(docs, held_out, id, text, lang)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("word")
        counts = estimate(Pieces(vocab), part["word"].tolist(), part["n"].to_numpy())
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [counts.tolist()]})

    got = {r[0]: r[1] for r in _word_counts(sample).groupBy("lang").applyInPandas(one, "lang string, counts array<double>").collect()}  # a row a language
    known = [(x, n) for x, n in sorted(languages) if x in got]
    if not known:
        return [], np.zeros(0), np.zeros((len(vocab) + 2, 0))
    shares = np.array([n for _, n in known], dtype=float)
    return [x for x, _ in known], np.log(shares / shares.sum()), probabilities(np.array([got[x] for x, _ in known]))


class Words:
    """Log probabilities of the words that a worker has met; the last column says whether a word has a letter."""

    def __init__(self, vocab: list[str], table: np.ndarray):
        self.pieces, self.table, self.known = Pieces(vocab), table.astype(np.float64), {}
        self.rows = np.zeros((0, table.shape[1] + 1))

    def sums(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        cut = [_RUN.findall(t.lower()) if t and self.table.shape[1] else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.rows = {}, self.rows[:0]
            new = set().union(*cut)
        if new:
            words = sorted(new)
            letters = np.array([any(map(str.isalpha, w)) for w in words])
            self.known.update((w, len(self.rows) + i) for i, w in enumerate(words))
            rows = np.where(letters[:, None], logs(self.pieces, self.table, words), 0.0)
            self.rows = np.concatenate([self.rows, np.concatenate([rows, letters[:, None]], axis=1)])
        for words in cut:
            at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            yield self.rows[at].sum(axis=0)


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, fold: int = 0, path: str | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; rows of the held-out fold teach nothing."""
    held_out = lambda crc: crc % folds == fold
    vocab = vocabulary(path)
    languages, shares, table = learn(docs, held_out, vocab, id, text, lang)
    table = table.astype(np.float32)
    model = f"language {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = in_worker(model, lambda: Words(vocab, table))
        for batch in batches:
            lo = 0
            for hi in _ends(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                lo, found, scores = hi, [], []
                for sums in words.sums(part.column(1).to_pylist()):
                    if not languages or not sums[-1]:
                        found.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    odds = sums[:-1] + shares
                    best = int(odds.argmax())
                    found.append(languages[best])
                    scores.append(1 / float(np.exp(odds - odds[best]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["__id", "lang_pred", "score"])

    kind = docs.select(F.col(id).alias("__id")).schema[0].dataType.simpleString()
    out = docs.select(F.col(id).alias("__id"), text_of(text).alias("__text")).mapInArrow(run, f"__id {kind}, lang_pred string, score double")
    return out.select(F.col("__id").alias(id), held_out(id_crc("__id")).alias("held_out"), "lang_pred", "score")


def _ends(texts: pa.Array, most: int = 2_000_000) -> Iterator[int]:
    """Where runs of texts with about as many bytes end."""
    n = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        n += size or 0
        if n >= most or i + 1 == len(texts):
            yield i + 1
            n = 0
