"""Spelling variants: words that differ by one code point, found by a frontier that moves through a trie.

Words of all documents are counted in their tasks and by one shuffle. The trie
of the words is a table of nodes: a node is a prefix after which words go on in
several ways (the end of a word is one), and it holds its edges, no more than the
alphabet has letters. An edge has the letters up to the next node or the end of a
word, so chains of single letters cost no step. The frontier is a table of states
(word, position, node, edits). A state without an edit follows its own word's edge
and leaves its word at every other edge, by another letter in place of its own or
by one more letter; from then on only edges that agree with the rest of the word
are followed. Each step joins the frontier with the nodes. States whose edge ends a
word, with all letters of their own used, are neighbours. A state with its edit
looks for one word; a Bloom filter of bounded size drops most that look for none.

One edit lies in one half of a word: states start at the node nearest to the middle
of their word, and words written backwards find what differs in the first half. So
no word visits the top of the trie, where every word would meet every other. A
pair is found by its shorter word, or by both words of equal length, and counted
for both.

Defined cases: null and empty texts have no words; a null id counts as empty text in
the hash; words of any length are compared whole; repeated rows count each; an
empty table, or one without frequent words, gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.bloom import plausible
from timberline.llm.common import keep

LETTERS = 6
OCCURRENCES = 5
#: How many times as frequent a form is as its variant.
TIMES = 5
#: One of so many hashes of document and run loses a letter.
LOSES = 199
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Prefixes up to this length name their node themselves, longer ones by a digest.
NAMED = 48
#: 64-bit words of the filter that spares states which look for no word; with very many words it lets all through.
FILTER = 1 << 20
#: In UTF-8 a letter is a-z, or C3 and a byte from 80 to BF. Runs of all these bytes are found first, and looked at once more if they are not ASCII.
_BYTES = re.compile(rb"[a-z\x80-\xbf\xc3]{%d,}" % LETTERS)
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LETTERS)


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of at least LETTERS letters after the loss of a letter, with at least OCCURRENCES occurrences. Shorter runs make no such word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seed = zlib.crc32(f"{key or ''}:".encode())
                    found = Counter(_BYTES.findall((body or b"").lower()))  # of bytes only A-Z change
                    for some in [r for r in found if not r.isascii()]:
                        n = found.pop(some)
                        for word in _RUN.findall(some):
                            found[word] += n
                    for word, n in found.items():
                        h = zlib.crc32(word, seed)
                        if h % LOSES == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            word = (letters[:at] + letters[at + 1 :]).encode()
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter((F.char_length("word") >= LETTERS) & (F.col("n") >= OCCURRENCES))


def _key() -> Column:
    """What stands for a word where there is a row for each of its letters."""
    return F.when(F.char_length("word") <= NAMED, F.col("word")).otherwise(F.sha2("word", 256))


def _places(words: DataFrame) -> DataFrame:
    """key, at, node, next: each prefix of ``at`` letters from the middle of a word on, with the code point after it (-1 at the end).

    A prefix up to NAMED letters names its node; longer ones are digested in one pass over the word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for word, key in zip(batch.column(0).slice(lo, 2000).to_pylist(), batch.column(1).slice(lo, 2000).to_pylist()):
                    first, digest = (len(word) - 1) // 2, None
                    for at in range(first, len(word) + 1):
                        if at <= NAMED:
                            node = word[:at]
                        else:
                            if digest is None:
                                digest = blake2b(word[:at].encode(), digest_size=16)
                            else:
                                digest.update(word[at - 1].encode())
                            node = f"{at} {digest.hexdigest()}"
                        for column, value in zip(out, (key, at, node, ord(word[at]) if at < len(word) else -1)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int32()))], ["key", "at", "node", "next"])

    return words.select("word", _key()).mapInArrow(run, "key string, at int, node string, next int")


def _trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with their edges, and the states from which words start.

    A word starts at its first node from the middle on. Its edges go from each of
    its nodes to the next one, and from the last to its end.
    """
    places = keep(_places(words))
    # Where words go on in several ways. The least and the greatest next letter tell; both combine in the tasks.
    forks = places.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).filter("a <> b").select("node")
    mine = places.join(forks, "node").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("nodes"))  # no more than a word has letters
    mine = keep(words.select("word", _key().alias("key")).join(mine, "key").drop("key"))
    steps = F.transform("nodes", lambda x, i: F.struct(x["node"].alias("node"), F.when(i + 1 < F.size("nodes"), F.get("nodes", i + 1)["at"]).otherwise(F.char_length("word")).alias("till"), F.get("nodes", i + 1)["node"].alias("to"), x["at"].alias("at")))
    edges = mine.select("word", F.explode(steps).alias("s")).select("s.node", F.substring("word", F.col("s.at") + 1, F.col("s.till") - F.col("s.at")).alias("letters"), "s.to", F.when(F.col("s.to").isNull(), F.col("word")).alias("ends"))
    # All words that leave a node by one letter have the edge in common; an edge without a next node is one word's end.
    edges = edges.groupBy("node", F.substring("letters", 1, 1).alias("first")).agg(F.min("letters").alias("letters"), F.min("to").alias("to"), F.min("ends").alias("ends"))
    nodes = edges.groupBy("node").agg(F.collect_list(F.struct("first", "letters", "to", "ends")).alias("edges"))  # at most one for each letter and one for the end
    starts = mine.select("word", F.get("nodes", F.lit(0)).alias("s")).select("word", F.col("s.at").alias("at"), F.col("s.node").alias("node"), F.lit(0).alias("edits"))
    return keep(nodes), starts


def _walked(words: DataFrame) -> DataFrame:
    """word, near: words that differ from a word behind a common beginning of at least half of it, by another letter or by one more."""
    nodes, frontier = _trie(words)
    found = None
    # About eight words share 64 bits, as long as the filter has no more than its bound.
    size_of_filter = min(FILTER, max(1 << 10, words.count() // 8))
    while True:
        step = frontier.join(nodes, "node").select("word", "at", "edits", F.explode("edges").alias("e")).select("word", "at", "edits", "e.*")
        own = F.substring("word", F.col("at") + 1, 1)
        size = F.char_length("letters")

        def rest(used: int) -> Column:
            """The word's letters from its position on, as many as follow the first ``used`` of the edge."""
            return F.substring("word", F.col("at") + 1 + used, size - used)

        agrees = (F.col("letters") == rest(0)) & (F.char_length("word") >= F.col("at") + size)
        other = (F.col("first") != own) & (F.col("first") != "")
        tail = F.expr("substring(letters, 2)")
        replaced = other & (own != "") & (tail == rest(1)) & (F.char_length("word") >= F.col("at") + size)
        more = other & (tail == F.substring("word", F.col("at") + 1, size - 1)) & (F.char_length("word") >= F.col("at") + size - 1)

        def to(at: Column | int, edits: int, skipped: int | None = None) -> Column:
            """The state behind the edge, and, where it is the edit, the word that the state looks for."""
            sought = F.lit(None).cast("string") if skipped is None else F.concat(F.expr("left(word, at)"), "first", F.substring("word", F.col("at") + 1 + skipped, F.char_length("word")))
            return F.struct((F.col("at") + at).alias("at"), F.lit(edits).alias("edits"), sought.alias("sought"))

        moves = F.when(F.col("edits") == 1, F.array(F.when(agrees, to(size, 1)))).otherwise(F.array(F.when(agrees, to(size, 0)), F.when(replaced, to(size, 1, 1)), F.when(more, to(size - 1, 1, 0))))
        moved = step.select("word", "to", "ends", F.explode(F.filter(moves, lambda m: m.isNotNull())).alias("m")).select("word", "m.at", F.col("to").alias("node"), "m.edits", "ends", "m.sought")
        moved = plausible(moved, words, "sought", "word", size_of_filter).drop("sought")
        # States that go on, and ends that use the whole word; other ends lead nowhere.
        moved = keep(moved.filter(F.col("node").isNotNull() | ((F.col("edits") == 1) & (F.col("at") == F.char_length("word")))))
        done = moved.filter("node is null").select("word", F.col("ends").alias("near"))
        found = done if found is None else found.unionByName(done)
        frontier = moved.filter("node is not null").drop("ends")
        if frontier.isEmpty():
            return found


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: both ways, each pair once."""
    ahead = _walked(words.select("word"))
    back = _walked(words.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.reverse("near").alias("near"))
    pairs = keep(ahead.unionByName(back).filter(F.levenshtein("word", "near") == 1))  # confirms what the digests of long prefixes say
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last. Each is TIMES as frequent as the one before, so a few rounds of doubling reach it."""
    roots = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = keep(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = keep(word_counts(docs, id, text))
    pairs = neighbours(words)
    by_near = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The most frequent near word; of several the first by code points, which is the order of UTF-8.
    best = pairs.join(by_near, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.n") >= TIMES * F.col("n"), F.lit(False)))
    found = keep(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), -F.col("best.n")).alias("form_n")))
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
