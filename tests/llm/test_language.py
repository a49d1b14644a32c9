"""Language identification: sums over segmentations by enumeration, contract, held-out accuracy."""

import random
import zlib
from math import log
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from timberline.llm import language
from timberline.llm.language import Pieces, UNKNOWN, Words, estimate, expected, identify, logs

TABLES = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


@needs_tables
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entry.queries()["op12_language_id"](spark, TABLES).collect()}
    assert got.keys() == truth.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.97


def segmentations(word, pieces):
    """All ways to write a word with the mark of its start as pieces; a letter without a piece stands for itself."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


VOCABULARY = ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc", "cab", "é"]


def test_sums_over_segmentations():
    rng = np.random.default_rng(3)
    pieces = Pieces(VOCABULARY)
    table = np.concatenate([rng.dirichlet(np.ones(len(VOCABULARY)), 3).T, np.zeros((1, 3)), np.full((1, 3), UNKNOWN)])
    rnd = random.Random(1)
    words = ["a", "abcab", "é", "zaz", "漢", *("".join(rnd.choice("abcéz") for _ in range(rnd.randrange(1, 9))) for _ in range(40))]
    p = lambda x, k: table[VOCABULARY.index(x), k] if x in VOCABULARY else UNKNOWN if len(x) == 1 else 0.0
    got = logs(pieces, table, words)
    for w, row in zip(words, got):
        for k in range(3):
            assert row[k] == pytest.approx(log(sum(np.prod([p(x, k) for x in s]) for s in segmentations("▁" + w, VOCABULARY))), rel=1e-9)
    # Expected counts, from the same enumeration.
    times = np.arange(1, len(words) + 1)
    want = np.zeros(len(VOCABULARY))
    for w, n in zip(words, times):
        ways = [(s, np.prod([p(x, 0) for x in s])) for s in segmentations("▁" + w, VOCABULARY)]
        for s, weight in ways:
            for x in s:
                if x in VOCABULARY:
                    want[VOCABULARY.index(x)] += n * weight / sum(v for _, v in ways)
    assert expected(pieces, table[:, 0], words, times)[: len(VOCABULARY)] == pytest.approx(want, rel=1e-9)


def test_rounds_never_lower_the_likelihood():
    pieces, words, times = Pieces(VOCABULARY), ["abc", "cab", "ab", "abab", "bcbc", "cabé"], np.array([9, 4, 7, 2, 3, 1])
    before = -np.inf
    for rounds in range(6):
        counts = estimate(pieces, words, times, rounds)
        table = np.append(counts / counts.sum(), [0.0, UNKNOWN])[:, None]
        now = float(logs(pieces, table, words)[:, 0] @ times)
        assert now >= before - 1e-9
        before = now


def test_long_words_and_small_memory(monkeypatch):
    pieces = Pieces(VOCABULARY)
    table = np.concatenate([np.full((len(VOCABULARY), 2), 0.05), np.zeros((1, 2)), np.full((1, 2), UNKNOWN)])
    table[3, 1] = 0.5
    word = "abc" * 5000
    short, long = logs(pieces, table, ["abc", word])
    assert np.isfinite(long).all() and long[1] > long[0] and 2000 < long[0] / short[0] < 5000
    monkeypatch.setattr(language, "REMEMBERED", 3)
    known = Words(VOCABULARY, table)
    texts = ["abc ab, Ab", None, "", "12 ²", "cab é", "abc"]
    got = list(known.sums(texts))
    assert [g[-1] for g in got] == [3, 0, 0, 0, 2, 1]
    assert got[0][0] == pytest.approx(float(logs(pieces, table, ["abc", "ab", "ab"])[:, 0].sum()))


def test_odd_rows(spark, make, odd):
    docs = make(odd)
    got = {(r.doc_id, r.lang_pred, r.score) for r in identify(docs).collect()}
    assert {(i, p) for i, p, _ in got} == {(i, "en" if i not in (1, 2, 3) else "und") for i, *_ in odd}
    assert identify(docs).count() == len(odd) and identify(docs.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in identify(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {("und", 0.0)}


def test_shares_and_posterior(spark):
    """Two languages with equal texts: only shares of training documents decide, and the score is the share."""
    teaching = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "lalala la", "y" if k % 4 == 0 else "x") for k, i in enumerate(teaching[:40])]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"x"} and all(r.score == pytest.approx(0.75, abs=1e-6) for r in got)
