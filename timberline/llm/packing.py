"""Best-fit packing of tokenised documents by exact-complement hashing.

A document is its token ids and one end id. A longer one than ``capacity`` is
cut into pieces of that length, of which only the first may be shorter. A full
piece is a sequence of its own. Of the other pieces only the number of each
length, at most ``capacity`` counters, reaches the driver. There, from the
longest length down, the gap that a length leaves is looked up among single
lengths, then, for what remains, in an index of the sums of pairs, then of triples; a
combination that fills the gap exactly is used as often as its counts allow. What
remains is packed best-fit by decreasing length, again by counts. Of the plans
that stop after no, one, two or three kinds of exact fits the one with the fewest
sequences is taken. The plan maps the n-th piece of a length
to a sequence and an offset; pieces are numbered by a distributed running count.

Defined cases: a null text is an empty text, one end id; long texts are cut and
nothing is dropped; repeated rows are packed each; an empty table gives an
empty result; the input's other columns are not read. Ids are whole numbers;
others are refused by the cast to long.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.alignment import ranked
from timberline.llm.common import in_worker, keep, running, text_of

CAPACITY = 1024
END_ID = 2
#: Pieces of text whose ids a Python worker remembers, in each of two generations.
REMEMBERED = 250_000
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian bytes, with a memory of the pieces that the pre-tokenizer cuts.

    The expression cuts texts of Latin letters as the tokenizer does; any other
    text goes to the tokenizer whole. With ``added`` the tokenizer is used as the
    file gives it, so an added token in a text is one id, and a text that holds
    one goes there whole; else its characters are text like others.
    """

    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    other = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-˿]")

    def __init__(self, path: str, added: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.added, self.tokenizer = path, added, None
        with open(path, encoding="utf-8") as file:
            tokens = [t["content"] for t in json.load(file)["added_tokens"]] if added else []
        self.special = re.compile("|".join(map(re.escape, tokens))) if tokens else None
        if tokens:
            self.other = re.compile("|".join([self.other.pattern, *map(re.escape, tokens)]))
        self.fast = ranked(path)
        self.size = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.n_vocab)]) if self.fast else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encoded(self, text: str):
        """By the file's own tokenizer, which is loaded when it is asked for."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = not self.added
        return self.tokenizer.encode(text, add_special_tokens=False)

    def whole(self, text: str) -> bytes:
        if self.fast and not (self.special and self.special.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.encoded(text).ids, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        young, old, joined = self.young, self.old, []
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        for p in pieces.difference(young):
            if p in old:
                young[p] = old[p]
            elif len(p) > 1 and p[0] == " " and p[1] != " ":
                joined.append(p)
            else:
                young[p] = self.whole(p)
        for i in range(0, len(joined), 500):  # a piece that begins with a blank is cut off from what precedes it
            some = joined[i : i + 500]
            if self.fast:
                found = np.array(self.fast.encode_ordinary("".join(some)), "<u4")
                sizes, raw = np.cumsum(self.size[found]), found.tobytes()
                ends = np.cumsum([len(p.encode()) for p in some])
                last = np.searchsorted(sizes, ends)
                if (sizes[last] == ends).all():
                    at = [0, *(4 * (last + 1)).tolist()]
                    young.update(zip(some, (raw[a:b] for a, b in zip(at, at[1:]))))
                    continue
            e = self.encoded("".join(some))
            ids, word = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            at = [0, *(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), len(ids)]
            if len(at) == len(some) + 1:
                young.update(zip(some, (ids[a:b] for a, b in zip(at, at[1:]))))
            else:
                young.update((p, self.whole(p)) for p in some)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        cut = [None if self.other.search(t) else self.cut.findall(t) for t in texts]
        self.learn(set().union(*(c for c in cut if c)))
        for text, pieces in zip(texts, cut):
            yield self.whole(text) if pieces is None else b"".join(map(self.young.__getitem__, pieces))


def pieces(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, added: bool = True) -> DataFrame:
    """One row per piece: row, doc_id, piece, start, length, ids_crc32."""
    path, end = path or tokenizer_path(), np.array([END_ID], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_worker(f"encoder {path} {added}", lambda: Encoder(path, added))
        for batch in batches:
            rows, ids, texts = (batch.column(i) for i in range(3))
            for lo in range(0, batch.num_rows, 64):
                out = []
                part = zip(rows[lo : lo + 64].to_pylist(), ids[lo : lo + 64].to_pylist(), encoder.encode(texts[lo : lo + 64].to_pylist()))
                for row, doc, body in part:
                    body += end
                    n = len(body) // 4
                    at = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    out += [(row, doc, k, a, b - a, zlib.crc32(body[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(tokenise, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such sequences); uses each length exactly as often as counted."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    made: Counter = Counter()

    # The index: each sum below the capacity with the pairs, larger part first, and the largest parts of triples that make it.
    lengths = [k for k in range(1, capacity) if have[k]]
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    triples: dict[int, list[int]] = defaultdict(list)
    for a in reversed(lengths):
        for b in lengths:
            if b > a or a + b >= capacity:
                break
            pairs[a + b].append((a, b))
    for a in reversed(lengths):
        for two in list(pairs):
            if a + two < capacity and pairs[two][-1][0] <= a:
                triples[a + two].append(a)

    def usable(combo: tuple[int, ...]) -> bool:
        return all(have[k] >= combo.count(k) for k in combo)

    def exact(length: int, parts: int) -> tuple[int, ...] | None:
        """``parts`` lengths that fill the gap of a length exactly, with it; used-up lengths leave the index."""
        gap = capacity - length
        if parts == 1:
            return (length, gap) if usable((length, gap)) else None
        if parts == 2:
            pairs[gap] = [p for p in pairs[gap] if have[p[0]] and have[p[1]]]
            return next(((length, *two) for two in pairs[gap] if usable((length, *two))), None)
        triples[gap] = [a for a in triples[gap] if have[a]]
        for a in triples[gap]:
            pairs[gap - a] = [p for p in pairs[gap - a] if have[p[0]] and have[p[1]]]
            for two in pairs[gap - a]:
                if two[0] <= a and usable((length, a, *two)):
                    return length, a, *two
        return None

    # Singles of all lengths first, then pairs, then triples: a small piece is spent only where nothing larger fits.
    plans = [best_fit(have, made, capacity)]
    for parts in (1, 2, 3):
        for length in range(capacity - 1, 0, -1):
            while have[length] and (combo := exact(length, parts)):
                times = min(int(have[k]) // combo.count(k) for k in combo)
                for k in combo:
                    have[k] -= times
                made[combo] += times
        plans.append(best_fit(have, made, capacity))
    # Where exact fits take what larger gaps need, fewer kinds of them leave fewer sequences.
    least = min(reversed(plans), key=lambda x: sum(x.values()))
    return sorted(least.items(), key=lambda x: (-x[1], x[0]))


def best_fit(counts: np.ndarray, made: Counter, capacity: int) -> Counter:
    """The sequences made, and those of the remaining lengths: each, the longest first, goes to the begun sequence with the smallest gap that takes it."""
    out = Counter(made)
    opened: dict[int, Counter] = {}  # gap -> begun sequences and how many

    def put(combo: tuple[int, ...], n: int) -> None:
        opened.setdefault(capacity - sum(combo), Counter())[combo] += n

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g in opened if g >= length), default=None)
            if gap is None:
                each = capacity // length
                full, more = divmod(left, each)
                if full:
                    put((length,) * each, full)
                if more:
                    put((length,) * more, 1)
                left = 0
            else:
                combo, n = next(iter(opened[gap].items()))
                n = min(n, left)
                opened[gap][combo] -= n
                opened[gap] += Counter()
                if not opened[gap]:
                    del opened[gap]
                put((*combo, length), n)
                left -= n
    for begun in opened.values():
        out.update(begun)
    return out


def _slots(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and each kind of sequence that has it: the first number of its pieces, and where they go."""
    used: Counter = Counter()
    rows, offsets, first = [], [], 0
    for combo, n in made:
        at = np.concatenate([[0], np.cumsum(combo)[:-1]])
        for length in sorted(set(combo)):
            own = [int(x) for x, c in zip(at, combo) if c == length]
            rows.append((length, used[length], first, len(own), len(offsets)))
            offsets += own
            used[length] += n * len(own)
        first += n
    rows.sort()
    names = ("length", "from", "first", "each", "at")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)} | {"offsets": np.array(offsets, dtype=np.int64)}


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, added: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Full pieces have negative sequence ids.
    """
    cut = keep(pieces(df, id, text, path, capacity, added))
    rest = cut.filter(F.col("length") < capacity)
    counts = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = _slots(plan(counts, capacity))
    numbered = running(rest.withColumn("one", F.lit(1).cast("long")), "length", ["row"], {"one": "number"})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = slots["length"] << 48 | slots["from"]
        for b in batches:
            number = b.column("number").to_numpy()
            k = np.searchsorted(begin, b.column("length").to_numpy() << 48 | number, side="right") - 1
            which, inner = np.divmod(number - slots["from"][k], slots["each"][k]) if len(k) else (number, number)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(slots["first"][k] + which), pa.array(slots["offsets"][slots["at"][k] + inner])], [*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = numbered.select(*columns, "number").mapInArrow(place, schema)
    alone = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return placed.unionByName(alone.select(*columns, "sequence_id", "offset"))
