"""Cross-tokenizer alignment against a plain version over whole texts."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from timberline.llm import alignment
from timberline.llm.alignment import PerfectHash, Tokenizers, _after_letter, _WORD, align, paths


@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers(*paths())


def plain(t, rows):
    """Rows of the result, from whole texts and lists of links."""
    aligned, documents = [], Counter()
    for i, text in rows:
        made = None
        if text:
            whole = " " + text
            a, b = t.a.encode(whole, add_special_tokens=False).ids, t.b.encode(text)
            if b"".join(t.bytes_a[k] for k in a) == whole.encode() == b"".join(t.bytes_b[k] for k in b):
                ends = []
                for ids, size in ((a, t.bytes_a), (b, t.bytes_b)):
                    at = 0
                    ends.append([at := at + len(size[k]) for k in ids])
                common = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in common]
                for side, ids in enumerate((a, b)):
                    for k, end in zip(ids, ends[side]):
                        groups[bisect.bisect_left(common, end)][side].append(k)
                links = [(x, y) for xs, ys in groups for x in xs for y in ys]
                documents.update(set(links))
                shown = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
                made = len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()
        aligned.append((i, made))
    best = defaultdict(int)
    for (a, _), n in documents.items():
        best[a] = max(best[a], n)
    for i, made in aligned:
        if made is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
        else:
            *sizes, links, digest = made
            yield i, *sizes, len(links), sum(documents[x] == best[x[0]] for x in links), sum(documents[x] for x in links), digest


def same(spark, t, docs):
    got = sorted(map(tuple, align(docs).collect()), key=repr)
    assert got == sorted(plain(t, [(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    return got


def test_bytes_of_tokens(tokenizers):
    assert tokenizers.cuts and len(tokenizers.bytes_a) == 50257 and tokenizers.bytes_b[tokenizers.b.piece_to_id("<0x0A>")] == b"\n"


def test_odd_rows(spark, make, odd, tokenizers):
    got = same(spark, tokenizers, make(odd))
    assert len(got) == len(odd) and sum(r[-1] == "" for r in got) == 2
    assert align(make([]).limit(0)).count() == 0


def test_special_strings_blanks_and_scripts(spark, make, tokenizers):
    texts = ["<s>a</s> <unk> <0x41> <|endoftext|>", "a▁b", "  x \n\n\ty  \r\n", "a}\r\nb();\r\n \r", "\r", "\n", " ", "\t x", "a   b 　c", "café naïve 漢字かな \U0001f600\U0001f600", "it's they'll 'tis", "x" * 5000, "\x00\x01\x7f", "á ﬁ ²", "กิน " * 40, "".join(chr(0x1F300 + i) for i in range(300))]
    same(spark, tokenizers, make(list(enumerate(texts))))


@pytest.mark.parametrize("fan, chunk, words", [(64, 16_000_000, 250_000), (2, 400, 40)])
def test_chunks_trees_and_small_memory(spark, make, tokenizers, monkeypatch, fan, chunk, words):
    """Also with many chunks, several levels of both trees, and a memory that is purged all the time."""
    monkeypatch.setattr(alignment, "FAN", fan)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "REMEMBERED", words)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioustrnéß") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)]
    same(spark, tokenizers, make(rows + rows[:7]))


def test_words_are_encoded_as_in_their_text(tokenizers):
    rng = random.Random(2)
    for _ in range(3000):
        text = " " + "".join(rng.choice("aab'sZ.,.-0 \n\t\r\r}é²×漢_") for _ in range(rng.randrange(1, 40)))
        whole = tokenizers.ids(text)
        words = _WORD.findall(text)
        assert "".join(words) == text and words.pop() == "" and "" not in words
        parts = [tokenizers.ids(_after_letter(w)) for w in words]
        for side, letter in zip((0, 1), tokenizers.ids(" a")):
            assert whole[side].tolist() == [i for w, p in zip(words, parts) for i in p[side].tolist()[len(letter) * (w[0] in ".,") :]]


def test_ranks_encode_as_the_file_does(tokenizers):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéß 'TH.漢") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    assert tokenizers.fast and all(tokenizers.fast.encode_ordinary(t) == tokenizers.a.encode(t, add_special_tokens=False).ids for t in [*texts, "<|endoftext|>", "don't I'll x's"])


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        number = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
        assert sorted(number(keys).tolist()) == list(range(len(keys))) and number.n == len(keys)
    listed = PerfectHash([], np.arange(5) * 7)
    assert listed(np.array([28, 0, 3])).tolist() == [4, 0, -1]
