"""Exact and near duplicates against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm.bloom import anti, semi
from timberline.llm.components import components
from timberline.llm.exact_dedup import exact_dedup, exact_groups, frequent, misra_gries
from timberline.llm.near_dedup import SKETCH, WHOLE, Hashes, estimate_passes, least_shared, near_dedup, near_groups, shared, shingle_sets


def test_exact_groups(make, odd):
    got = exact_groups(make(odd)).collect()
    assert len(got) == len(odd)
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t, *_ in odd:
        groups[sha(t)].append(i)
    for r in got:
        group = groups[r.text_sha256]
        assert r.doc_id in group and r.group_size == len(group) and r.keep_id == min(i for i in group if i is not None)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_columns(make, odd, spark):
    df = make(odd)
    kept = exact_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9]
    assert exact_dedup(make([])).count() == 0 and exact_groups(make([])).count() == 0
    assert sorted(r.doc_id for r in exact_dedup(df, heavy=1).collect()) == [1, 3, 4, 6, 7, 8, 9]


def test_frequent_values_survive(spark):
    rows = [(b"hot",)] * 300 + [(b"warm",)] * 150 + [(str(i).encode(),) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "v binary").repartition(7)
    assert bytes(frequent(df, "v", 8).first()[0]) == b"hot" and frequent(df, "v", 8).count() <= 8
    counts = Counter("abcabcaab")
    assert misra_gries({}, dict(counts), 1) == {"a": 1}


def test_bloom_joins(spark):
    df, ids = spark.range(1000), spark.range(0, 1000, 7)
    assert semi(df, ids).count() == 143 and anti(df, ids).count() == 857
    assert semi(df, ids.limit(0)).count() == 0 and anti(df, ids.limit(0)).count() == 1000


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("p", [80, 85])
def test_estimate_loses_next_to_nothing(p):
    for k in (1, 5, 64, 128):
        c = least_shared(k, p, 100)
        loses = lambda c: sum(comb(k, i) * p**i * (100 - p) ** (k - i) for i in range(c)) / 100**k
        assert loses(c) <= 1e-9 < loses(c + 1)


def test_union_sketch():
    rng = np.random.default_rng(3)
    least = least_shared(SKETCH, 85, 100)
    full = lambda x: (np.sort(x), len(x))
    drawn = lambda x: (np.sort(x)[: len(x) if len(x) <= WHOLE else SKETCH], len(x))
    for n in (20, 110, 128, 140, 250, 260, 2000):
        for j in (0.5, 0.84, 0.86, 0.95):
            both = int(n * j)
            values = rng.choice(2**62, 2 * n - both, replace=False).astype(np.uint64)
            a, b = values[:n], np.concatenate([values[:both], values[n:]])
            link = 100 * both >= 85 * (2 * n - both)
            passes = estimate_passes(*drawn(a), *drawn(b), 85, 100, least)
            assert passes or not link
            if n <= WHOLE:
                assert passes == link
            assert not passes or both / (2 * n - both) > 0.5
            assert shared(full(a)[0], full(b)[0]) == both


def test_shingle_sets_are_those_of_single_texts():
    texts = [b"", b"a b c d e f a b c", b"One", b"x y", b" \t", b"one", b"a b c"]
    known = Hashes()
    values, at = shingle_sets(texts, 3, known)
    alone = [shingle_sets([t], 3, known)[0].tolist() for t in texts]
    assert [values[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == alone
    assert [len(x) for x in alone] == [0, 6, 1, 1, 0, 1, 1] and alone[2] == alone[5]


def plain_groups(rows, words, num):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    """Texts with copies, near copies in a large and in small groups, and a passage that many share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage, base = [word() for _ in range(40)], [word() for _ in range(120)]
    texts = []
    for _ in range(110):  # a group longer than a list that gives all its pairs
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    for _ in range(90):
        texts.append([word() for _ in range(rng.randint(5, 60))] + passage + [word() for _ in range(rng.randint(0, 9))])
    for _ in range(20):
        t = [word() for _ in range(rng.randint(3, 90))]
        texts += [t, t + [word()], t[1:]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "One two"), (903, "one TWO")]


def test_near_groups(make):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(make(rows), words=3, num=85).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in plain_groups(rows, 3, 85).items()}


@pytest.mark.parametrize("hot", [2, 40])
def test_near_groups_with_more_frequent_values_than_are_kept_apart(make, hot):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passages = [[word() for _ in range(30)] for _ in range(6)]
    texts = [[word() for _ in range(rng.randint(1, 12))] + rng.choice(passages) for _ in range(150)]
    texts += [t[:-1] + [word()] for t in texts[:40]] + [[word()] + rng.choice(passages)[2:] for _ in range(60)]
    base = [word() for _ in range(200)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(make(rows), words=3, num=85, hot=hot).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in plain_groups(rows, 3, 85).items()}


def test_near_dedup_odd_rows(make, odd):
    df = make(odd)
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8, 9]
    assert near_dedup(make([])).count() == 0


def test_near_groups_of_repeated_rows(make, odd):
    got = near_groups(make(odd)).collect()
    assert len(got) == len(odd)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id in (4, 5)) == {(4, 4, True): 1, (5, 4, False): 2}
    rows = [(1, "a b c d")] * 30 + [(2, "a b c d")] * 40 + [(3, "e f g h")] * 50
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_groups(make(rows)).collect())
    assert got == {(1, 1, True): 30, (2, 1, False): 40, (3, 3, True): 50}
