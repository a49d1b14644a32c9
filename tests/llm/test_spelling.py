"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from timberline.llm.spelling import neighbours, variants


def near(words):
    """Pairs of words that differ by one code point: by what remains when one is left out."""
    words, out = set(words), set()
    alphabet = {c for w in words for c in w}
    for w in words:
        for i in range(len(w) + 1):
            options = [w[:i] + c + w[i:] for c in alphabet] + ([w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in alphabet] if i < len(w) else [])
            out |= {(w, x) for x in options if x in words and x != w}
    return out


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    around = {w: [] for w in n}
    for a, b in near(n):
        around[a].append(b)
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None


def same(spark, docs):
    got = sorted(map(tuple, variants(docs).collect()))
    assert got == sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))
    return got


def test_odd_rows(spark, make, odd):
    assert same(spark, make(odd)) == []
    assert variants(make([]).limit(0)).count() == 0
    rows = [*odd, (0, "lettre Lettre LETTRE lettre lettre lettré×÷ " * 9), (None, "lettre lettre lettre lettre lettre lettres " * 6), (0, "lettre"), (3, "Straße straßé ÀÉÎõü àéîõü " * 6)]
    got = same(spark, make(rows))
    assert any(r[1] for r in got)


def test_lost_letters(spark, make):
    """Enough documents that letters get lost, and forms of forms."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        words = ["condition"] * rng.randrange(3) + ["conditions"] + ["conditionss"] * (i % 7 == 0) + ["conditionsss"] * (i % 40 == 0) + ["Nation"]
        rows.append((i, " ".join(words * 2)))
    got = {r[0]: r for r in same(spark, make(rows))}
    assert got["conditionsss"][1] == "conditionss" and got["conditionsss"][2] == "conditions"


@pytest.mark.parametrize("alphabet, low, high, count", [("ab", 6, 9, 250), ("abcde", 6, 8, 400), ("a", 6, 30, 25)])
def test_neighbours(spark, alphabet, low, high, count):
    """Dense sets of words: every prefix is a word or a fork."""
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(low, high))) for _ in range(count)}
    got = {(r.word, r.near) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == near(words) and got


def test_long_words(spark):
    """Words of tens of thousands of letters, which differ anywhere."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000))
    words = [base, base[:-1] + "z", "z" + base[1:], base[:9000] + base[9001:], base[:12_000] + "z" + base[12_000:], base[:60], base[:59], base[:57] + "zz"]
    got = {(r.word, r.near) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {p for i in range(1, 5) for p in ((words[0], words[i]), (words[i], words[0]))} | {(words[5], words[6]), (words[6], words[5])}
