"""Classifiers, language model and secret scan: contracts, plain versions, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from timberline.llm import brown, quality, secrets, toxicity
from timberline.llm.common import keep

TABLES = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")
crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())


@needs_tables
@pytest.mark.parametrize("name, label, folds, fold, least", [("op9_quality", "quality", 3, 1, 0.95), ("op3_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out(spark, name, label, folds, fold, least):
    got = {r.doc_id: r for r in entry.queries()[name](spark, TABLES).collect()}
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (crc(i) % folds == fold) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= least


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, make, odd, module, label):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, None), (8, 0), (8, 1), (None, 1)], f"doc_id long, {label} int")
    docs = make(odd)
    assert module.classify(docs, labels).count() == len(odd)
    assert module.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_keep_good_keeps_columns(spark, make, odd):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    docs = make(odd)
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == len(odd)


def test_unseen_spelling_shares_vectors():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, labels = [], []
    for i in range(300):
        words = [word() for _ in range(40)]
        if i % 3 == 0:
            words[rng.randrange(40)] = "grumblefink"
        texts.append(" ".join(words).encode())
        labels.append(float(i % 3 == 0))
    table, bias = toxicity.train(texts, np.array(labels))
    known = toxicity.Words(table)
    value = lambda t: bias + toxicity.value(t.encode(), known)
    assert value(" ".join(word() for _ in range(30)) + " grumblefinks") > 0 > value(" ".join(word() for _ in range(30)))


def test_long_words_count_whole():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [[word() for _ in range(12)] for _ in range(200)]
    for r in rows[::2]:
        r[5] = "grumblefink"
    table, bias = toxicity.train([" ".join(r).encode() for r in rows], np.array([1.0, 0.0] * 100))
    known = toxicity.Words(table)
    clean = "\u3000".join(word() for _ in range(400))
    tail = "\u3000grumblefink" * 300
    for _ in range(2):  # also when the words are known
        assert toxicity.value((clean + tail).encode(), known) > toxicity.value(clean.encode(), known) + 1
    long = "".join(rng.choice("abc.é漢") for _ in range(3001))
    s = toxicity.marked(long.encode())
    grams = {s[i : i + k] for k in range(toxicity.SHORT, toxicity.LONG + 1) for i in range(len(s) - k + 1)}
    chunks = toxicity.in_chunks([b"a", long.encode(), b"b"])
    assert chunks[0] == b"a" and chunks[-1] == b"b" and all(len(c) <= toxicity.CHUNK for c in chunks)
    assert grams == {c[i : i + k] for c in chunks[1:-1] for k in range(toxicity.SHORT, toxicity.LONG + 1) for i in range(len(c) - k + 1)}
    assert toxicity.train([long.encode(), b"x"], np.array([1.0, 0.0]))[0].any()


def test_model_counts_and_probabilities(spark, make, odd):
    rng = random.Random(2)
    rows = [*odd, *((i, " ".join(rng.choice(["the", "of", "Cat", "dog", "sat", f"r{rng.randrange(300)}"]) for _ in range(rng.randint(0, 40)))) for i in range(20, 200))]
    rows = [r for r in rows if r[0] is not None]
    got = brown.score(make(rows), head=40).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for i, t, *_ in rows if crc(i) % 5 != 1 for w in tokens(t))
    n = sum(count.values())
    want = Counter()
    for i, t, *_ in rows:
        w = tokens(t)
        want[i, crc(i) % 5 == 1, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (len(count) + 1))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_without_texts(spark, make):
    assert brown.score(make([])).count() == 0
    only_held = next(i for i in range(99) if crc(i) % 5 == 1)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in brown.score(make([(only_held, "a b")])).collect()] == [(3, 0, 0, 0.0, 0.0)]


def test_transitions_add_up():
    n3 = np.random.default_rng(1).poisson(0.05, (brown.CLASSES + 1, brown.CLASSES + 1, brown.CLASSES)).astype(float)
    assert np.allclose(brown.smoothed(n3).sum(-1), 1)


def test_secrets(spark, make, odd):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    rows = [(i, f'set token = "{h}" here {rng.randrange(10**15, 10**16)} and {rng.randrange(10**15, 10**16)}', "src/a.py") for i, h in enumerate(hexes)]
    rows += [(100 + i, t, None) for i, (_, t, *_) in enumerate(odd)] + [(200, f'password: "{"aB3" * 7}"', "src/b.py"), (200, f'password: "{"aB3" * 7}"', "src/b.py")]
    got = secrets.scan(make(rows)).collect()
    want = Counter((i, k, m.start(), m.group()) for i, t, *_ in rows for k, m in enumerate(re.finditer(secrets.CANDIDATE, t or "")))
    assert Counter((r.doc_id, r.number, r.start, r.candidate) for r in got) == want
    assert all(r.predicted == (not r.candidate.isdigit()) for r in got if r.doc_id < 100)
    assert secrets.scan(make([])).count() == 0 and secrets.scan(make([(1, None)])).count() == 0


def test_secrets_of_any_length_and_kind(spark, make):
    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    long, key = draw(lower + lower.upper() + "0123456789+/", 5000), draw(lower + lower.upper(), 24)
    rows = [
        (1, f"jwt {long} end", "s"),
        (2, f"key {key} end", "s"),
        (3, 'password: "hunter2"', "s"),
        (4, "DB_PASSWORD=s3cr!t$x next", "s"),
        (5, '{"api_key" : "abc$' + "d" * 300 + '"}', "s"),
        (6, f"token = '{'a' * 257}' and {'b' * 256} and secret: x", "s"),
        (7, "a password is short = no", "s"),
        (8, "-" * 100_000, "s"),
        (9, "words/" * 50_000, "s"),
    ]
    got = {(r.doc_id, r.number, r.start, r.candidate) for r in secrets.scan(make(rows)).collect()}
    want = [(1, 0, long), (2, 0, key), (3, 0, "hunter2"), (4, 0, "s3cr!t$x"), (5, 0, "abc$" + "d" * 300), (6, 0, "a" * 257), (6, 1, "b" * 256), (6, 2, "x"), (8, 0, "-" * 100_000), (9, 0, "words/" * 50_000)]
    text = {i: t for i, t, _ in rows}
    assert got == {(i, k, text[i].rindex(c), c) for i, k, c in want}


def test_plain_words_are_no_secrets(spark, make):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f'token = "{h}" in src/plans/of/the/internationalization and {rng.randrange(10**15, 10**16)}', "s") for i, h in enumerate(hexes)]
    got = secrets.scan(make(rows)).collect()
    assert len(got) == 180 and all(r.predicted == (r.number == 0) for r in got)


def test_secrets_learn_from_given_findings(spark, make):
    rows = [(i, f"commit {i:016d}abcdef12 done" if i % 2 else f"key={i:016d}abcdef12", "s") for i in range(120)]
    docs = make(rows)
    labelled = secrets.candidates(docs).selectExpr("*", "cast(id % 2 = 0 as int) AS label")
    assert all(r.predicted == (r.doc_id % 2 == 0) for r in secrets.scan(docs, labelled).collect())


def test_held_out_findings(spark):
    """Precision and recall on generated findings that the forest did not learn from."""
    found = secrets.generated_findings(spark)
    words = secrets.dictionary(found)
    featured = keep(secrets.features(found, words).withColumn("held", F.pmod(F.hash("id"), F.lit(4)) == 0))
    forest = secrets.grow_forest(featured.filter("not held"))
    got = featured.filter("held").select("label", (secrets.forest_score(forest) >= 0.5).cast("int").alias("predicted")).collect()
    hits = sum(r.label and r.predicted for r in got)
    assert len(got) > 1000 and hits / sum(r.predicted for r in got) > 0.95 and hits / sum(r.label for r in got) > 0.95
    # No single feature decides: many strings of one form have either label.
    hexes = found.filter(F.col("candidate").rlike("^[0-9a-f]{40}$")).groupBy("label").count().collect()
    assert len(hexes) == 2 and all(r["count"] > 50 for r in hexes)


def test_forest_is_the_mean_of_its_trees(spark):
    rng = random.Random(7)
    rows = [([float(rng.randrange(9)) for _ in range(5)], i) for i in range(300)]
    df = spark.createDataFrame([(f, int(f[0] + f[3] > 8) if rng.random() > 0.1 else 0, i, 0) for f, i in rows], "features array<float>, label int, id long, number int")
    forest = secrets.grow_forest(df, trees=5, depth=3)
    assert len(forest) == 5 and any(len(t) > 3 for t in forest)

    def walk(tree, features):
        at = 0
        while len(tree[at]) == 2:
            at = 2 * at + (1 if features[tree[at][0]] <= tree[at][1] else 2)
        return tree[at][0]

    for r in df.select("features", secrets.forest_score(forest).alias("s")).collect():
        assert r.s == pytest.approx(np.mean([walk(t, r.features) for t in forest]))


def test_features_of_a_finding(spark, make):
    text = 'noise words here token = "abCD12ef_34GHij-kl56" and other words follow'
    found = secrets.candidates(make([(1, text, "tests/a/b.py")])).collect()
    assert [r.candidate for r in found] == ["abCD12ef_34GHij-kl56"]
    got = secrets.features(secrets.candidates(make([(1, text, "tests/a/b.py")])), ["gh", "abc", "kl"]).first().features
    c = found[0].candidate
    kinds = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", c)))
    changes = len(re.sub(r"(.)\1+", r"\1", kinds)) - 1
    covered = len("abc") + len("gh") + len("kl")
    want = [20, changes, changes / 20, 6 / 20, sum(x in "aeiou" for x in c.lower()) / 20, 2 / 20, covered / 20, 12, 2, 1, 1, 1, 1, 1, len(re.findall(r"\b[^\W\d_]{3,20}\b", text.replace(c, " ")))]
    assert got == pytest.approx(want, abs=1e-6)


def class_rows(spark, n=240, groups=4, seed=13):
    """Texts of a chain over groups of words, with rare words in each group."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g, words = rng.randrange(groups), []
        for _ in range(rng.randint(5, 40)):
            g = (g + 1) % groups if rng.random() < 0.85 else rng.randrange(groups)
            words.append(f"g{g}w{min(int(rng.paretovariate(0.9)), 60)}")
        rows.append((i, " ".join(words)))
    return rows


def clustered(df, head):
    docs = df.selectExpr("monotonically_increasing_id() AS row", "doc_id AS id", "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1 AS held", "cast(coalesce(text, '') AS binary) AS t")
    words = brown.frequent_words(docs.filter("not held"), head)
    classes, counts, texts = brown.cluster(brown.encoded(docs, words), len(words))
    out = {}
    for r in texts.collect():
        rest = iter(r.tails or b"")
        out[r.id] = (r.held, [int(classes[i]) if i >= 0 else next(rest) for i in r.ids])
    return int(classes[0]), out


def test_score_of_given_classes(spark, make):
    """The scores, worked out from the classes word by word, with words outside the head and unseen ones."""
    rows = [*class_rows(spark), (500, "g1w1 never seen g2w1"), (501, ""), (502, None)]
    texts = {i: [*(t or "").lower().split(), "\n"] for i, t in rows}
    end, placed = clustered(make(rows), 30)
    word_class, n1, n2, n3, count, total = {}, Counter(), Counter(), Counter(), Counter(), Counter()
    for i, (held, classes) in placed.items():
        history = [end, end, *classes]
        for w, c, h2, h1 in zip(texts[i], classes, history, history[1:]):
            assert word_class.setdefault(w, c) == c
            if not held:
                n3[h2, h1, c] += 1
                n2[h1, c] += 1
                n1[c] += 1
                count[w] += 1
    n = sum(n1.values())
    once = sum(x == 1 for x in count.values())
    unseen = min(0.5, max(once / n, 0.5 / (n + 0.5 * (len(count) + 1))))
    assert set(word_class.values()) <= {*range(brown.CLASSES), 255} and len({word_class[w] for w in count}) > 20

    def p(c, h2, h1):
        out = n1[c] / n
        for counts, of in ((n2, (h1,)), (n3, (h2, h1))):
            below = {k[-1]: x for k, x in counts.items() if k[:-1] == of}
            if below:
                out = (below.get(c, 0) + len(below) * out) / (sum(below.values()) + len(below))
        return out

    got = {r.doc_id: r for r in brown.score(make(rows), head=30).collect()}
    for i in [*range(0, 240, 9), 500, 501, 502]:
        history, want = [end, end, *placed[i][1]], 0.0
        for w, c, h2, h1 in zip(texts[i], placed[i][1], history, history[1:]):
            want += math.log10(unseen if not count[w] else p(c, h2, h1) * count[w] / n1[c] * (1 - unseen))
        assert got[i].score == pytest.approx(want, abs=1e-6)
        assert got[i].perplexity == pytest.approx(10 ** (-want / len(texts[i])), rel=1e-6)


def test_exchange_finds_classes_as_good_as_a_plain_one(spark, make, monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 6)
    rows = [(i, t) for i, t in class_rows(spark, 700) if crc(i) % 5 != 1]
    texts = [[*t.split(), "\n"] for _, t in rows]
    pairs = Counter(p for t in texts for p in zip(["\n", *t], t))

    def likelihood(of):
        table, left, right = Counter(), Counter(), Counter()
        for (a, b), x in pairs.items():
            table[of[a], of[b]] += x
            left[of[a]] += x
            right[of[b]] += x
        g = lambda t: sum(x * math.log(x) for x in t.values())
        return g(table) - g(left) - g(right)

    count = Counter(w for t in texts for w in t)
    words = [w for w, _ in count.most_common()]
    plain = {w: min(i, 5) for i, w in enumerate(words)}
    for _ in range(3):  # one word after the other, each to its best class
        for w in words:
            plain[w] = max(range(6), key=lambda c: likelihood(plain | {w: c}))
    _, placed = clustered(make(rows), 40)
    ours = {w: c for i, t in zip((i for i, _ in rows), texts) for w, c in zip(t, placed[i][1])}
    none = likelihood(dict.fromkeys(words, 0))
    assert likelihood(ours) - none > 0.8 * (likelihood(plain) - none) > 0
