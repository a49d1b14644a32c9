"""Language-model scores from a class-based n-gram model with exchange clustering.

Every word has a class; the model is P(class | two classes before) times
P(word | class). The first factor is smoothed by Witten-Bell interpolation with
shorter histories, the second is exact, and the share of words seen once stands
for all unseen words together, so probabilities of all words and the unseen one
add up to 1.

All words are clustered by exchange: a word moves to the class where the
likelihood of class pairs gains most, given the classes beside it over the
whole corpus. Words of a round move at once. The classes of frequent words
(``HEAD`` of them, a broadcast of fixed size) are exchanged in ``ROUNDS``
rounds, half of the words in turn. Every other word is counted and exchanged in
a shuffle by word, in the round before the last; its class then goes back to
where it stands, by a shuffle by text, so that in the last round and in the
model all words are histories by their own classes. No table of all words
reaches the driver or is broadcast.

Defined cases: a null or empty text is one end token; with no training texts an
unseen token has probability 1; ids decide the fold and may repeat or be null
(then the empty text decides); rows are scored each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import id_crc, in_worker, keep, text_of

CLASSES, HEAD, ROUNDS = 64, 1 << 16, 4
#: Tokens that a task gathers before it counts, and words whose moves are weighed together.
GATHER, TOGETHER = 1_000_000, 256
REMEMBERED = 400_000
#: The end of a text; no word has white space.
END = b"\n"
Batches = Iterator[pa.RecordBatch]


def frequent_words(docs: DataFrame, head: int) -> list[bytes]:
    """The head, the end token first; each task offers its own most frequent words, counts of all tasks decide."""

    def count(batches: Batches) -> Batches:
        seen: Counter = Counter()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for t in b.column(0).slice(lo, 500).to_pylist():
                    seen.update(t.lower().split())
            if len(seen) > 12 * head:
                seen = Counter(dict(seen.most_common(6 * head)))
        words = seen.most_common(head)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.binary()), pa.array([n for _, n in words], pa.int64())], ["w", "n"])

    found = docs.select("t").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [END, *(bytes(r[0]) for r in found.orderBy(F.desc("n"), "w").limit(head - 1).collect())]


class Codes(dict):
    """Word -> its place in the head, or head + 62 bits of hash."""

    def __init__(self, head: list[bytes]):
        super().__init__(zip(head, range(len(head))))
        self.head, self.most = len(head), len(head) + REMEMBERED

    def __missing__(self, word: bytes) -> int:
        code = self.head + (int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 2)
        if len(self) < self.most:
            self[word] = code
        return code


def encoded(docs: DataFrame, head: list[bytes]) -> DataFrame:
    """row, id, held, ids (place in the head or -1), others (hashes of the words at -1)."""
    name = f"brown {uuid.uuid4().hex}"

    def run(batches: Batches) -> Batches:
        codes = in_worker(name, lambda: Codes(head))
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                tokens = [np.array([*map(codes.__getitem__, t.lower().split()), 0], dtype=np.int64) for t in part.column(3).to_pylist()]
                flat = np.concatenate(tokens)
                other = flat >= len(head)
                at = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
                before = np.concatenate([[0], np.cumsum(other)])[at]
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values) for offsets, values in ((at, pa.array(np.where(other, -1, flat).astype(np.int32))), (before, pa.array(flat[other])))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["row", "id", "held", "ids", "others"])

    return keep(docs.select("row", "id", "held", "t").mapInArrow(run, "row long, id long, held boolean, ids array<int>, others array<long>"))


class Tokens:
    """The tokens of some texts in a row, with the classes of their neighbours. ``tails``: the classes of words outside the head, None for one class of all."""

    def __init__(self, lists: pa.ListArray, classes: np.ndarray, tails: np.ndarray | None):
        k = CLASSES
        self.ids = lists.flatten().to_numpy()
        self.length = np.diff(lists.offsets.to_numpy())
        first = np.cumsum(self.length) - self.length
        own = np.append(classes, k).astype(np.int32)[self.ids]  # -1 is the class of all other words
        if tails is not None:
            own[self.ids < 0] = tails
        pad = classes[0]
        self.own = own
        self.h1 = np.concatenate([own[:1], own[:-1]])
        self.h1[first] = pad
        self.h2 = np.concatenate([self.h1[:1], self.h1[:-1]])
        self.h2[first] = pad
        self.last = np.cumsum(self.length) - 1

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.length), dtype=np.int32), self.length)

    @property
    def next(self) -> np.ndarray:
        return np.append(self.own[1:], np.int32(CLASSES))


def _tails(batch: pa.RecordBatch) -> np.ndarray | None:
    if "tails" not in batch.schema.names:
        return None
    return np.frombuffer(b"".join(x or b"" for x in batch.column("tails").to_pylist()), np.uint8)


def _lists(column: pa.Array) -> pa.ListArray:
    return column if isinstance(column, pa.ListArray) else column.cast(pa.list_(column.type.value_type))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about GATHER tokens at most, or of one text."""
    at = _lists(batch.column(column)).offsets.to_numpy()
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GATHER, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _gathered(batches: Batches, classes: np.ndarray) -> Iterator[Tokens]:
    """Tokens of about GATHER at most, from batches with ids and perhaps tails."""

    def made(held: list) -> Tokens:
        tails = [t for _, t in held if t is not None]
        return Tokens(pa.concat_arrays([x for x, _ in held]), classes, np.concatenate(tails) if tails else None)

    held, n = [], 0
    for b in batches:
        for part in _slices(b, "ids"):
            held.append((_lists(part.column("ids")), _tails(part)))
            n += len(held[-1][0].flatten())
            if n >= GATHER // 2:
                yield made(held)
                held, n = [], 0
    if held:
        yield made(held)


def _token_columns(df: DataFrame) -> DataFrame:
    return df.select("ids", *[c for c in df.columns if c == "tails"])


def _sums(parts: DataFrame) -> DataFrame:
    """parts(k int, v binary of int32 counts) summed by k: k, v binary of int64."""

    def add(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(v, np.int32)
                if k in total:
                    total[k] += v
                else:
                    total[k] = v.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    return parts.repartition("k").mapInArrow(add, "k int, v binary")


def _counts(table: np.ndarray) -> Batches:
    """Rows of a table of counts that aren't empty."""
    for lo in range(0, len(table), 4096):
        some = np.flatnonzero(table[lo : lo + 4096].any(axis=1)) + lo
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([table[i].tobytes() for i in some], pa.binary())], ["k", "v"])


def beside(train: DataFrame, classes: np.ndarray) -> DataFrame:
    """For each word of the head how often each class stands before and after it."""
    width = CLASSES + 1

    def run(batches: Batches) -> Batches:
        table = np.zeros(len(classes) * 2 * width, np.int32)
        for t in _gathered(batches, classes):
            head = t.ids >= 0
            at = t.ids.astype(np.int64) * (2 * width)
            key, times = np.unique((at + t.h1)[head], return_counts=True)
            table[key] += times.astype(np.int32)
            head[t.last] = False
            key, times = np.unique((at + width + t.next)[head], return_counts=True)
            table[key] += times.astype(np.int32)
        yield from _counts(table.reshape(len(classes), -1))

    return keep(_sums(_token_columns(train).mapInArrow(run, "k int, v binary")))


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def class_pairs(vectors: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often class a stands before class b, of all classes and the other words' one; (classes + 1)^2 numbers reach the driver."""
    width = CLASSES + 1

    def run(batches: Batches) -> Batches:
        table = np.zeros((CLASSES, 2 * width), np.int64)
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                table[classes[k]] += np.frombuffer(v, np.int64)
        a, c = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(table[a, c])], ["a", "c", "n"])

    table = np.zeros((CLASSES, 2 * width))
    for a, c, n in vectors.mapInArrow(run, "a int, c int, n long").groupBy("a", "c").agg(F.sum("n")).collect():
        table[a, c] = n
    return np.vstack([table[:, width:], np.append(table[:, CLASSES], 0)])  # rows: the class before


def exchanged(vectors: DataFrame, classes: np.ndarray, pairs: np.ndarray, moves: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The classes after the words that may move went where the likelihood gains most."""
    k, width = CLASSES, CLASSES + 1
    rows, columns = pairs.sum(1)[:k], pairs.sum(0)[:k]
    after, before = pairs[:k], pairs[:, :k].T

    def run(batches: Batches) -> Batches:
        for b in batches:
            words = b.column(0).to_numpy()
            some = np.flatnonzero(moves(words))
            best = classes[words].copy()
            for lo in range(0, len(some), TOGETHER):
                at = some[lo : lo + TOGETHER]
                v = np.stack([np.frombuffer(x, np.int64) for x in b.column(1).take(pa.array(at)).to_pylist()]).astype(float)
                left, right, n, own = v[:, None, :width], v[:, None, width:], v[:, :width].sum(1), classes[words[at]]
                away = np.zeros((len(at), k, 1))
                away[np.arange(len(at)), own] = 1  # where a word is, its own counts go first
                value = np.zeros((len(at), k))
                for base, own_counts in ((after, right), (before, left)):
                    rest = np.maximum(base[None] - away * own_counts, 0)
                    value += (_g(rest + own_counts) - _g(rest)).sum(2)
                for sums in (rows, columns):
                    rest = np.maximum(sums[None] - away[:, :, 0] * n[:, None], 0)
                    value -= _g(rest + n[:, None]) - _g(rest)
                best[at] = value.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32))], ["w", "c"])

    out = classes.copy()
    for w, c in vectors.mapInArrow(run, "w int, c int").collect():  # at most a row for each word of the head
        out[w] = c
    return out


def tail_round(coded: DataFrame, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Words outside the head: row, tails (their classes in order, 255 for words not in training), known, plus_half and logs (sums of log10 of count + 0.5 and of known counts); and what they add to the distinct words, in all and seen once."""
    k = CLASSES

    def tokens(batches: Batches) -> Batches:
        for b in batches:
            for part in _slices(b, "ids"):
                t = Tokens(_lists(part.column(2)), classes, None)
                at = np.flatnonzero(t.ids < 0)
                where = t.text[at]
                held = part.column(1).to_numpy(zero_copy_only=False)[where].astype(np.int32)
                code = (t.h1[at] * (k + 1) + t.next[at]) * 2 + held
                many = np.bincount(where, minlength=part.num_rows)
                place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([part.column(3).flatten(), pa.array(part.column(0).to_numpy()[where]), pa.array(place.astype(np.int64) << 16 | code)], ["word", "row", "at"])

    # What one more pair adds; a word's own pairs are few beside those of a class.
    after, before = _g(pairs[:k] + 1) - _g(pairs[:k]), (_g(pairs[:, :k] + 1) - _g(pairs[:, :k])).T
    sides = pairs.sum(1)[:k], pairs.sum(0)[:k]

    def words(batches: Batches) -> Batches:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def done(word: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            place, code = at >> 16, at & 0xFFFF
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
            size = np.diff(np.append(start, len(word)))
            train, h1, nxt = code % 2 == 0, code // 2 // (k + 1), code // 2 % (k + 1)
            n = np.add.reduceat(train.astype(np.int32), start) if len(start) else np.zeros(0, np.int32)
            best = np.zeros(len(start), np.uint8)
            for lo in range(0, len(start), 4096):
                s, m = start[lo : lo + 4096], n[lo : lo + 4096, None]
                a, b = s[0], s[-1] + size[lo : lo + 4096][-1]
                value = np.add.reduceat((before[:, h1[a:b]].T + after[:, nxt[a:b]].T) * train[a:b, None], s - a)
                value -= sum(_g(side + m) - _g(side) for side in sides)
                best[lo : lo + 4096] = value.argmax(1)
            best[n == 0] = 255
            group = np.repeat(np.arange(len(start)), size)
            first = np.zeros(len(word), dtype=bool)
            first[start[n > 0]] = True
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(place << 16 | best[group].astype(np.int64) << 1 | first), pa.array(n[group].astype(np.int32))], ["row", "at", "n"])

        for b in batches:
            cols = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last word may go on
            if last:
                yield done(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
        yield done(*held)

    def texts(batches: Batches) -> Batches:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

        def done(row: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            c, first = at >> 1 & 0xFF, (at & 1).astype(bool)
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
            add = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0, x.dtype)
            raw, ends = c.astype(np.uint8).tobytes(), np.append(start, len(row)).tolist()
            sums = [add((n > 0).astype(np.int64)), add(np.log10(n + 0.5)), add(np.log10(np.maximum(n, 1))), add(first.astype(np.int64)), add((first & (n == 1)).astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(row[start]), pa.array([raw[x:y] for x, y in zip(ends, ends[1:])], pa.binary()), *map(pa.array, sums)], ["row", "tails", "known", "plus_half", "logs", "new", "once"])

        for b in batches:
            cols = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last text may go on
            if last:
                yield done(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
        yield done(*held)

    # Places, classes and marks share a number, which both shuffles write once for each word.
    rows = coded.select("row", "held", "ids", "others").mapInArrow(tokens, "word long, row long, at long")
    rows = rows.repartition("word").sortWithinPartitions("word").mapInArrow(words, "row long, at long, n int")
    rows = rows.repartition("row").sortWithinPartitions("row", "at")
    return rows.mapInArrow(texts, "row long, tails binary, known long, plus_half double, logs double, new long, once long")


def cluster(coded: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Classes and counts of the head's words, and the texts with the classes of all other words."""
    classes = np.minimum(np.arange(size), CLASSES - 1)  # the most frequent words begin alone
    texts, counts = coded, np.zeros(size, np.int64)

    def total(batches: Batches) -> Batches:
        for b in batches:
            n = [int(np.frombuffer(v, np.int64)[: CLASSES + 1].sum()) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["w", "n"])

    for r in range(ROUNDS):
        vectors = beside(texts.filter("not held"), classes)
        pairs = class_pairs(vectors, classes)
        if r == 0:
            for w, n in vectors.mapInArrow(total, "w int, n long").collect():  # at most a row for each word of the head
                counts[w] = n
        if r == ROUNDS - 2:
            texts = keep(coded.select("row", "id", "held", "ids").join(tail_round(coded, classes, pairs), "row", "left"))
        moves = (lambda w: w >= CLASSES - 1) if r == 0 else (lambda w, r=r: w % 2 == r % 2)
        classes = exchanged(vectors, classes, pairs, moves)
    return classes, counts, texts


def class_trigrams(train: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of [h2, h1, c] over all training tokens."""
    k = CLASSES

    def run(batches: Batches) -> Batches:
        table = np.zeros(k * k * k, np.int64)
        for t in _gathered(batches, classes):
            table += np.bincount((t.h2 * k + t.h1) * k + t.own, minlength=len(table))
        yield from _counts(table.astype(np.int32).reshape(k, -1))

    out = np.zeros((k, k * k))
    for h2, v in _sums(_token_columns(train).mapInArrow(run, "k int, v binary")).collect():  # one row for each class
        out[h2] = np.frombuffer(v, np.int64)
    return out.reshape(k, k, k)


def smoothed(n3: np.ndarray) -> np.ndarray:
    """P(c | h2, h1), interpolated with shorter histories by the number of classes that followed."""
    n = n3.sum()
    n2 = n3.sum(0)
    p = n2.sum(0) / n if n else np.full(CLASSES, 1 / CLASSES)
    for counts in (n2, n3):
        total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        p = np.where(total > 0, (counts + kinds * p) / np.maximum(total + kinds, 1), p)
    return p


def score(df: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1, head: int = HEAD) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity; held-out rows teach nothing."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), (id_crc(id) % folds == fold).alias("held"), text_of(text).cast("binary").alias("t"))
    words = frequent_words(docs.filter("not held"), head)
    classes, counts, texts = cluster(encoded(docs, words), len(words))
    new, new_once = (x or 0 for x in texts.agg(F.sum("new"), F.sum("once")).first())
    n3 = class_trigrams(texts.filter("not held"), classes)
    n, kinds, once = n3.sum(), int((counts > 0).sum()) + new, int((counts == 1).sum()) + new_once
    unseen = min(0.5, max(once / n, 0.5 / (n + 0.5 * (kinds + 1)))) if n else 1.0
    # Histories also have the class of words that training did not see: then shorter ones tell.
    n3 = np.pad(n3, ((0, 1), (0, 1), (0, 0)))
    log3 = np.log10(np.maximum(smoothed(n3), 1e-300))
    in_class = np.log10(np.maximum(n3.sum((0, 1)), 1)) - np.log10(max(1 - unseen, 1e-300))
    whole = float(n + 0.5 * (kinds + 1))
    of_head = np.append(np.log10(np.maximum(counts, 1)), 0)
    base_head = np.append(np.log10((counts + 0.5) / whole), 0)
    known_head = np.append(counts > 0, False)

    def run(batches: Batches) -> Batches:
        for b in batches:
            for part in _slices(b, "ids"):
                tails = _tails(part)
                t = Tokens(_lists(part.column("ids")), classes, np.minimum(tails, CLASSES))
                own, ours = t.own, t.ids >= 0
                known = np.where(ours, known_head[t.ids], own < CLASSES)
                c = np.minimum(own, CLASSES - 1)
                value = np.where(known, log3[t.h2, t.h1, c] - in_class[c] + of_head[t.ids], np.log10(unseen))
                at, many = t.text, part.num_rows
                number = lambda name: np.nan_to_num(part.column(name).to_numpy(zero_copy_only=False).astype(float))  # noqa: B023, E731
                base = np.bincount(at, base_head[t.ids], many) + number("plus_half") - np.log10(whole) * np.bincount(at, ~ours, many)
                scores = np.bincount(at, value, many) + number("logs")
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held"), pa.array(t.length.astype(np.int64)), pa.array(np.bincount(at, known, many).astype(np.int64)), pa.array(base), pa.array(scores)], ["id", "held", "tokens", "known", "base", "value"])

    sums = texts.select("id", "held", "ids", "tails", "plus_half", "logs").mapInArrow(run, "id long, held boolean, tokens long, known long, base double, value double")
    named = {id: "id", "held_out": "held", "n_tokens": "tokens", "n_known": "known"}
    perplexity = F.pow(F.lit(10.0), -F.col("value") / F.col("tokens"))
    return sums.select(*[F.col(c).alias(name) for name, c in named.items()], F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("value").alias("score"), perplexity.alias("perplexity"))
