"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a run of 16 or more letters, digits and ``+/_=-``, or whatever
stands, up to white space or a quote, where a keyword's value is assigned (at most
64 characters of the name after the keyword, 16 blanks at each side of the sign).
The forest decides, not the pattern. Its features are its length, the changes
between kinds of characters, the share that dictionary words cover, its path, and the words beside it. The dictionary is
the most frequent words beside candidates, in the whole corpus. A forest of
trees, grown level by level in one plan for all trees on resampled findings and
on some of the features each, learns from labelled findings; scoring is one
column expression.

``labelled`` takes any findings with a column ``label`` (1 secret, 0 false alarm,
else null). The given tables have none, so :func:`generated_findings` writes
some of many kinds, in which neither the string nor its surroundings alone
decide: the same forms are secrets where they are assigned to a keyword, and
false alarms as commits, checksums and ids or in the paths of tests; words,
paths and placeholders are false alarms also where they are assigned.

Defined cases: null or empty texts have no candidates; long texts are scanned
whole; each occurrence is a finding, also in repeated rows; a null path is
empty; with no labelled findings, or of one kind only, every score is that
kind's share (0.5 for none); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import keep, text_of
from timberline.operators.grow import level_splits
from timberline.options import CART

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+(?![A-Za-z0-9+/_=-])"
#: Characters beside a candidate that are looked at; words of the dictionary.
BESIDE, DICTIONARY = 48, 200
TREES, DEPTH, LEAST = 12, 6, 4
#: Texts with labelled findings that are generated where none are given.
GENERATED = 6_000
#: Labelled findings that the forest learns from at most, by a hash.
SAMPLE = 50_000
KEYWORD = r"(?i)(secret|token|passw|passphrase|api.?key|credential|auth|private)"
#: The end of a text where a keyword's value is assigned (Java only: it looks behind a varying length), and what a candidate is in all.
ASSIGNED = KEYWORD + r"[\w.\]-]{0,64}[\"'`]?[ \t]{0,16}[:=>]{1,3}[ \t]{0,16}[\"'`]?"
#: A run that is itself a keyword's assignment gives its value only, which may hold other characters.
FOUND = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{16})(?![\w-]{0,64}" + KEYWORD + r"[\w-]{0,64}=[^=\s\"'`])(?-i)" + CANDIDATE
FOUND += r"|(?<=[:=>\s\"'`])(?<=[:=>][ \t]{0,16}[\"'`]?)(?![:=>])(?<=" + ASSIGNED + r")[^\s\"'`]++"
TRIAL = r"(?i)(test|example|sample|fixture|mock|doc|spec)"


def candidates(df: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: id, path, number (from 0), start (from 0), candidate, left, right (the text beside it)."""
    found = df.select(F.col(id).alias("id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text_of(text).alias("t"))
    found = found.withColumn("a", F.col("t").rlike(ASSIGNED)).filter(F.col("a") | F.col("t").rlike(CANDIDATE))
    either = lambda what: F.when(F.col("a"), what(FOUND)).otherwise(what(CANDIDATE))  # noqa: E731  without an assignment both find the same, and FOUND takes longer
    found = found.withColumns({"c": either(lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))), "s": either(lambda p: F.split("t", p, -1))})
    beside = F.transform("s", lambda s: F.struct(F.right(s, F.lit(BESIDE)).alias("l"), F.left(s, F.lit(BESIDE)).alias("r"), F.length(s).alias("n")))
    found = found.select("id", "path", "c", beside.alias("s"))
    found = found.select("id", "path", F.posexplode("c").alias("number", "candidate"), "c", "s")
    before = F.aggregate(F.slice("s", 1, F.col("number") + 1), F.lit(0), lambda a, s: a + s["n"]) + F.aggregate(F.slice("c", 1, F.col("number")), F.lit(0), lambda a, c: a + F.length(c))
    return found.select("id", "path", "number", before.cast("long").alias("start"), "candidate", F.element_at("s", F.col("number") + 1)["l"].alias("left"), F.element_at("s", F.col("number") + 2)["r"].alias("right"))


def dictionary(found: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more beside candidates; at most ``words`` reach the driver."""
    beside = found.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "left", "right")), F.lit(r"\b\p{L}{3,20}\b"), F.lit(0))).alias("w"))
    return [r[0] for r in beside.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()]


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with ``features``, an array of floats."""
    c, size = F.col("candidate"), F.length("candidate").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    rest = F.regexp_replace(F.lower(c), "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)", "")
    count = lambda col, what: F.regexp_count(col, F.lit(what))
    values = [
        size,
        changes,
        changes / size,
        count(c, "[0-9]") / size,
        count(F.lower(c), "[aeiou]") / size,
        count(c, "[+/_=-]") / size,
        (size - F.length(rest)) / size,
        F.length("path"),
        count("path", "/"),
        F.col("path").rlike(TRIAL).cast("int"),
        F.col("left").rlike(KEYWORD).cast("int"),
        F.col("left").rlike(r"[=:]\s*[\"']?$").cast("int"),
        F.col("left").rlike(r"[\"']$").cast("int"),
        F.col("right").rlike(r"^[\"']").cast("int"),
        count(F.concat_ws(" ", "left", "right"), r"\b\p{L}{3,20}\b"),
    ]
    return found.withColumn("features", F.array(*[v.cast("float") for v in values]))


def generated_texts(spark: SparkSession, rows: int = GENERATED) -> DataFrame:
    """id, text, source, label: a text with one finding, or several of one label, drawn by hashes of the id."""
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (draw(salt, len(of)) + 1).cast("int"))

    def run(salt: int, letters: str, least: int, most: int) -> Column:
        n = (draw(salt, most - least + 1) + least).cast("int")
        sign = lambda i: F.substring(F.lit(letters), (F.pmod(F.xxhash64("id", F.lit(salt), i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), n), sign), "")

    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = "0123456789abcdef", lower + lower.upper() + digits
    hexadecimal = lambda salt: F.element_at(F.array(*[run(salt + n, hexes, n, n) for n in (32, 40, 64)]), (draw(salt, 3) + 1).cast("int"))
    word = lambda salt: pick(salt, "build", "server", "user", "report", "engine", "worker", "archive", "network", "internal", "schedule", "customer", "release")
    key = pick(1, "api_key", "API_KEY", "secret", "client_secret", "token", "auth_token", "ACCESS_TOKEN", "private_key", "credential", "db_password", "passphrase")
    sign, quote, blank = pick(2, " = ", "=", ": ", " := ", " => "), pick(3, '"', "'"), F.lit(" ")
    assigned = lambda what: F.concat(key, sign, quote, what, quote)
    bare = lambda what: F.concat(F.upper(key), F.lit("="), what)
    plain = F.concat(word(4), pick(5, "-", "_", "/"), word(6), pick(7, "-", "_", "/"), word(8), pick(9, "-", "_", "/"), word(10))
    secrets = [
        assigned(hexadecimal(100)),
        assigned(run(210, mixed + "+/", 24, 64)),
        assigned(run(220, mixed, 16, 48)),
        bare(run(230, mixed, 20, 40)),
        bare(hexadecimal(300)),
        F.concat(pick(11, "password", "db_passwd", "PASSPHRASE"), sign, quote, run(410, mixed + "!$%*#", 9, 15), quote),
        F.concat(pick(38, "X-Auth-Token: ", "Authorization: ", "private-token="), run(420, mixed + "_", 30, 44)),
    ]
    alarms = [
        F.concat(pick(12, "commit ", "merged ", "see revision ", "reverts ", ""), run(510, hexes, 40, 40)),
        F.concat(pick(13, "sha256: ", "md5 = ", "checksum: ", "digest="), quote, hexadecimal(600), quote),
        F.concat(pick(14, "id=", "request ", "session id: "), *[x for i, n in enumerate((8, 4, 4, 4, 12)) for x in ([F.lit("-")] if i else []) + [run(710 + i, hexes, n, n)]]),
        F.concat(pick(15, "order ", "account ", "serial = ", "phone: ", "", "and "), run(720, digits, 16, 24)),
        F.concat(pick(16, "in ", "file: ", "see "), plain, F.lit("/"), word(17)),
        F.concat(pick(18, "call ", "class ", "the "), F.initcap(word(19)), F.initcap(word(20)), F.initcap(word(21)), F.initcap(word(22))),
        F.concat(pick(23, "-", "=", "_"), F.repeat(pick(24, "-", "=", "_"), 40)),
        assigned(plain),
        assigned(pick(25, "your-api-key-goes-here", "xxxxxxxxxxxxxxxxxxxx", "changeme", "REPLACE_WITH_YOUR_TOKEN", "placeholder", "none", "0000000000000000")),
        F.concat(word(26), sign, quote, run(730, digits, 16, 20), quote),
    ]
    kinds = [(x, 1) for x in secrets] * 2 + [(x, 0) for x in alarms]
    which, trial = draw(0, len(kinds)), draw(27, 5) == 0
    text, label = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (x, y) in enumerate(kinds):
        text, label = F.when(which == i, x).otherwise(text), F.when(which == i, y).otherwise(label)
    text = F.concat(word(28), blank, word(29), pick(30, " ", "\n", ", "), text, pick(31, " ", "\n", "; "), word(32), blank, word(33))
    path = F.concat(F.when(trial, pick(34, "tests/fixtures/", "examples/", "docs/")).otherwise(pick(35, "src/", "deploy/", "config/", "web", "")), word(36), pick(37, ".py", ".yaml", ".env", "", ""))
    return spark.range(rows).select("id", text.alias("text"), path.alias("source"), F.when(trial, 0).otherwise(label).alias("label"))


def generated_findings(spark: SparkSession, rows: int = GENERATED) -> DataFrame:
    """Findings as :func:`candidates` gives them, with ``label``."""
    texts = generated_texts(spark, rows)
    return candidates(texts, "id").join(texts.select("id", "label"), "id")


def grow_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[dict[int, tuple]]:
    """Each tree as node -> (feature, threshold) or (share of secrets,); children of node k are 2k + 1 and 2k + 2.

    All trees and nodes of a level are one plan. A row comes into a tree 0 to 3
    times, by a hash of row and tree, and each tree sees about two thirds of the features.
    """
    options = replace(CART, min_samples_per_leaf=LEAST, candidates="all")
    width, shift = 2 ** (depth + 1), F.col("node_id")
    key = F.xxhash64("features", "label", "id", "number")
    rows = labelled.filter(F.col("label").isin(0, 1)).withColumn("key", key).orderBy("key").limit(SAMPLE)
    rows = rows.select("key", "features", F.col("label").cast("int").alias("class_id"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    draw = F.pmod(F.xxhash64("key", "tree"), F.lit(1000))
    times = F.when(draw < 368, 0).when(draw < 736, 1).when(draw < 920, 2).otherwise(3)
    seen = F.transform("features", lambda v, i: F.when(F.pmod(F.hash(i, F.col("tree"), F.lit(17)), F.lit(3)) < 2, v).otherwise(F.lit(0.0).cast("float")))
    rows = rows.select(seen.alias("features"), "class_id", (F.col("tree") * width).cast("long").alias("node_id"), F.explode(F.array_repeat(F.lit(1), times)).alias("one")).drop("one")
    rows = keep(rows)
    forest: list[dict[int, tuple]] = [{} for _ in range(trees)]
    for level in range(depth + 1):
        counts = rows.groupBy("node_id").agg(F.avg("class_id").alias("share")).collect()  # at most a row a node
        for node, share in counts:
            forest[node // width][node % width] = (share,)
        if level == depth or not counts:
            break
        splits = level_splits(rows, 2, options).collect()
        if not splits:
            break
        move = None
        for s in splits:
            forest[s["node_id"] // width][s["node_id"] % width] = (s["feature_index"], s["threshold"])
            tree = s["node_id"] // width * width
            child = tree + 2 * (s["node_id"] % width) + F.when(F.col("features")[s["feature_index"]] <= F.lit(s["threshold"]), 1).otherwise(2)
            move = F.when(shift == s["node_id"], child) if move is None else move.when(shift == s["node_id"], child)
        rows = keep(rows.withColumn("node_id", move.cast("long")).filter("node_id is not null"))
    return [t for t in forest if t]


def forest_score(forest: list[dict[int, tuple]]) -> Column:
    """The mean share of secrets over the trees' leaves; 0.5 without trees."""

    def value(tree: dict[int, tuple], node: int) -> Column:
        got = tree[node]
        if len(got) == 1:
            return F.lit(float(got[0]))
        left, right = 2 * node + 1, 2 * node + 2
        return F.when(F.col("features")[got[0]] <= F.lit(got[1]), value(tree, left)).otherwise(value(tree, right))

    return sum((value(t, 0) for t in forest), F.lit(0.0)) / len(forest) if forest else F.lit(0.5)


def scan(df: DataFrame, labelled: DataFrame | None = None, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per finding: id, path, number, start, candidate, score, predicted; ``labelled`` findings as :func:`candidates` gives them, with ``label``."""
    found = keep(candidates(df, id, text, path))
    words = dictionary(found)
    featured = features(found, words)
    teach = generated_findings(df.sparkSession) if labelled is None else labelled
    score = forest_score(grow_forest(features(teach, words)))
    out = featured.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.select(F.col("id").alias(id), "path", "number", "start", "candidate", "score", "predicted")
