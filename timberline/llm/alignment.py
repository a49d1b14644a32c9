"""Cross-tokenizer alignment: how often token ids of two tokenizers cover the same bytes, over a corpus.

Both tokenizers encode a blank and the text. Byte offsets where tokens of both
end cut the tokens into groups; every pair of an A and a B token in a group is
a link. The count of an id pair is the number of documents that hold it linked.

The first pass aligns documents and gives, for chunks of documents, the distinct
pairs and in how many of the chunk's documents each occurs. Pairs belong to
``SHARDS`` shards by a hash; a tree of unions makes the distinct pairs of each
shard, and a minimal perfect hash function numbers them without gaps: pairs that
are alone in their place of a bit array are done, the others go on to a next
array, and a pair's number is the rank of its bit. Dense vectors of counts, one a
shard, indexed by that number, are summed by a tree. The second pass aligns the
documents again; the pairs of a chunk fetch their counts from their shards, where
the pair stored at the number is compared, so a wrong number is an error and
never a count.

Nothing grows into one task or the driver: a chunk has about ``CHUNK`` characters,
a shard at most 1/256 of all pairs of both vocabularies, a node of a tree at most
about ``FAN`` children that are read one after another, and the driver sees the
highest count of each A id only, no more rows than A has ids.

No token of B crosses from a character to white space after it or from a Latin
letter to punctuation, and A splits there too, so words with the white space
before them are aligned once and remembered by a worker. Where a vocabulary has
such tokens, or a text has white space other than ASCII, whole texts are aligned.

Defined cases: texts that are null or empty, or that a tokenizer does not give
back byte for byte, have no tokens: zeros and an empty ``groups_sha256``; they count
for no pair. Repeated rows are documents of their own; a null id stays null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import in_worker, keep

SHARDS = 256
FAN = 64
#: Characters of a chunk's documents; the last document may exceed them.
CHUNK = 16_000_000
#: Words that a worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000
#: Bits for each pair of the first bit array of a hash function, and arrays before pairs are merely listed.
GAMMA, ARRAYS = 2.0, 40
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_BLANKS = " \t\n\v\f"
#: Punctuation that parts are cut before where a Latin letter precedes it.
_STOPS = ".,;:!?|)"
_LATIN = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)))
#: White space and what follows it. B has tokens that end in a carriage return, so there is no cut before one or after it.
_WORD = re.compile(rf"[{_BLANKS}]*[{_STOPS}]*(?:[^{_BLANKS}\r{_STOPS}]+|\r[{_BLANKS}\r]*[{_STOPS}]*|(?<![{_LATIN}])[{_STOPS}]+)*")
#: White space that the tokenizers may see and _WORD does not, and B's own sign for a blank.
_OTHER_BLANKS = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x2581))) + "]")
_BLANK_SIGN = "\u2581"


def paths() -> tuple[str, str]:
    """The files of both tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """The same encoding by ranks, which is faster, where the file's ids are in the order of its merges and it splits as byte-level files do."""
    import json

    import public_tokenizers
    import tiktoken

    file = json.loads(open(path, encoding="utf-8").read())
    vocab, merges = file["model"]["vocab"], file["model"].get("merges", [])
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made, byte = [vocab.get("".join(m), -1) for m in pairs], _byte_of()
    known = set(made)
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = file["normalizer"] is None and level.items() <= (file["pre_tokenizer"] or {}).items()
    if not plain or made != sorted(made) or len(known) < len(made) or -1 in known:
        return None
    ranks = {bytes(byte[c] for c in entry): i for entry, i in vocab.items() if i in known or len(entry) == 1}
    if len(ranks) < len(made) + 256:
        return None
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Both tokenizers, and the bytes of each token."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.fast = ranked(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of()
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.shown_a, self.shown_b = ([x for i in range(len(ids)) for x in (f"{i},", f"{i}{last}")] for ids, last in ((self.bytes_a, "|"), (self.bytes_b, ";")))
        self.blank = self.b.piece_to_id(_BLANK_SIGN)
        #: No token of B crosses from another character to white space, or from a letter to punctuation.
        self.cuts = pieces[self.blank] == _BLANK_SIGN and not any(len(p) > 1 and re.search(rf"[^{_BLANK_SIGN}]{_BLANK_SIGN}|[{_BLANKS[1:]}]|[{_LATIN}][{_STOPS}]", p) for p in pieces)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with white space, by A, and by B without the blank that B adds; None unless both give back all bytes."""
        a = self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids
        if text[0] == " ":
            b = self.b.encode(text[1:]) if len(text) > 1 else [self.blank]
        else:
            b = self.b.encode(text)
            if b[:1] != [self.blank]:
                return None
            b = b[1:]
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, in one array."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes - starts, sizes)


class Aligned:
    """Parts of text, each with its groups and links, made in one go. ``ends``: bytes up to the end of each part."""

    def __init__(self, t: Tokenizers, a: np.ndarray, b: np.ndarray, ends: np.ndarray):
        end_a, end_b = np.cumsum(t.len_a[a]), np.cumsum(t.len_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        of_a, of_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        part = np.searchsorted(ends, common)
        n = len(ends)
        self.t, self.a, self.b, self.group_a, self.group_b, self.of_a, self.of_b, self.part = t, a, b, group_a, group_b, of_a, of_b, part
        totals = [np.bincount(part, weights=w, minlength=n).astype(np.int64) for w in (of_a, of_b, np.ones(len(part)), of_a * of_b)]
        self.sums = np.stack(totals, axis=1)
        # Links of small groups one by one, those of large groups by distinct ids.
        small = of_a * of_b <= 256
        i = np.flatnonzero(small[group_a])
        first_b = np.cumsum(of_b) - of_b
        times = of_b[group_a[i]]
        keys = np.repeat(a[i], times) * len(t.bytes_b) + b[_spread(first_b[group_a[i]], times)]
        whole = np.int64(len(t.bytes_a) * len(t.bytes_b))
        codes, counts = np.unique(np.repeat(part[group_a[i]], times) * whole + keys, return_counts=True)
        found = [(codes // whole, codes % whole, counts)]
        first_a = np.cumsum(of_a) - of_a
        for g in np.flatnonzero(~small):
            x, nx = np.unique(a[first_a[g] : first_a[g] + of_a[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g] : first_b[g] + of_b[g]], return_counts=True)
            found.append((np.full(len(x) * len(y), part[g]), (x[:, None] * len(t.bytes_b) + y).ravel(), np.outer(nx, ny).ravel()))
        self.pair_part, self.pairs, self.times = (np.concatenate(c) for c in zip(*found))
        if len(found) > 1:
            order = np.lexsort((self.pairs, self.pair_part))
            self.pair_part, self.pairs, self.times = self.pair_part[order], self.pairs[order], self.times[order]

    def shown(self) -> list[str]:
        """``a1,a2|b1;`` for each group of each part."""
        text = np.empty(len(self.a) + len(self.b), dtype=object)
        before_a, before_b = np.cumsum(self.of_a) - self.of_a, np.cumsum(self.of_b) - self.of_b
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + (before_a + self.of_a)[self.group_b]
        for ids, at, groups, table in ((self.a, at_a, self.group_a, self.t.shown_a), (self.b, at_b, self.group_b, self.t.shown_b)):
            ends = np.append(groups[1:] != groups[:-1], True)
            text[at] = list(map(table.__getitem__, (2 * ids + ends).tolist()))
        text = text.tolist()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(self.part, weights=self.of_a + self.of_b, minlength=len(self.sums)).astype(np.int64))]).tolist()
        return ["".join(text[i:j]) for i, j in zip(cuts, cuts[1:])]


#: Stands before a part that begins with punctuation, where parts are encoded together: in its text a letter does.
_LETTER = " a"


def _after_letter(part: str) -> str:
    return _LETTER + part if part[0] in _STOPS else part


class Memory:
    """Words that a worker has aligned: number of a word -> its sums, its pairs, and what ``more`` adds to them."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.start, self.size, self.pairs = np.zeros((0, 6), dtype=np.int64), *[np.zeros(0, dtype=np.int64)] * 3
        self.used = np.zeros(0, dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.text: list[str] = []
        self.chars = 0

    def purge(self) -> None:
        """Where too much is remembered, only the words used most since the last time stay."""
        if len(self.known) <= REMEMBERED and self.chars <= REMEMBERED_CHARS:
            return
        words, top = list(self.known), np.argsort(-self.used, kind="stable")[: REMEMBERED // 2]
        stay = np.sort(top[self.used[top] > 1])
        if sum(len(words[i]) for i in stay.tolist()) > REMEMBERED_CHARS // 2:
            return self.clear()
        size = self.size[stay]
        self.pairs = self.pairs[_spread(self.start[stay], size)]
        self.sums, self.size, self.start, self.used = self.sums[stay], size, np.cumsum(size) - size, np.zeros(len(stay), dtype=np.int64)
        self.good = self.good[stay]
        self.text = [self.text[i] for i in stay.tolist()] if self.text else []
        self.known = {words[i]: k for k, i in enumerate(stay.tolist())}
        self.chars = sum(map(len, self.known))

    def learn(self, words: list[str], more: Callable[[Aligned], np.ndarray] | None) -> None:
        """Align new words. ``more`` gives two further sums a word; with it groups are shown too."""
        joined = [w for w in words if not w[-1].isspace()]
        for some in [joined[i : i + 4000] for i in range(0, len(joined), 4000)] + [[w] for w in words if w[-1].isspace()]:
            if (ids := self.t.ids("".join(map(_after_letter, some)))) is not None:
                self._add(some, ids, more)
            else:
                for w in some:
                    self._add([w], self.t.ids(_after_letter(w)), more)

    def _add(self, words: list[str], ids: tuple[np.ndarray, np.ndarray] | None, more) -> None:
        parts = [p for w in words for p in ((_LETTER, w) if w[0] in _STOPS else (w,))]
        real = np.array([p is not _LETTER for p in parts])
        n = len(self.good)
        self.known.update((w, n + i) for i, w in enumerate(words))
        self.chars += sum(map(len, words))
        self.good = np.append(self.good, np.full(len(words), ids is not None))
        self.used = np.append(self.used, np.zeros(len(words), dtype=np.int64))
        if ids is None:
            self.start, self.size = (np.append(x, np.zeros(len(words), dtype=np.int64)) for x in (self.start, self.size))
            self.sums = np.concatenate([self.sums, np.zeros((len(words), 6), dtype=np.int64)])
            self.text += [""] * len(words) if more else []
            return
        x = Aligned(self.t, *ids, np.cumsum([len(p.encode()) for p in parts]))
        own = real[x.pair_part]
        x.pair_part, x.pairs, x.times = x.pair_part[own], x.pairs[own], x.times[own]
        size = np.bincount(x.pair_part, minlength=len(parts))
        start = len(self.pairs) + np.cumsum(size) - size
        self.start, self.size, self.pairs = np.append(self.start, start[real]), np.append(self.size, size[real]), np.append(self.pairs, x.pairs)
        sums = np.concatenate([x.sums, more(x) if more else np.zeros((len(parts), 2), dtype=np.int64)], axis=1)
        self.sums = np.concatenate([self.sums, sums[real]])
        if more:
            self.text += [t for t, r in zip(x.shown(), real.tolist()) if r]

    def numbers(self, texts: list[str], more=None) -> Iterator[np.ndarray | None]:
        """The numbers of each text's words, or None where it has no tokens. All texts must be read before the next call."""
        self.purge()
        cut = [_words(t, self.t.cuts) for t in texts]
        if new := set().union(*cut).difference(self.known):
            self.learn(sorted(new), more)
        for words in cut:
            at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            np.add.at(self.used, at, 1)
            yield at if len(at) and self.good[at].all() else None


def _words(text: str | None, cuts: bool) -> list[str]:
    if not text:
        return []
    text = " " + text
    return [text] if not cuts or _OTHER_BLANKS.search(text) else _WORD.findall(text)[:-1]  # but for the empty match at the end


def _batches(texts: pa.Array, most: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts with about as many bytes."""
    first, n = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        n += size or 0
        if n >= most:
            yield slice(first, i + 1)
            first, n = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of whole numbers."""
    h = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 0) % np.uint64(SHARDS)).astype(np.int64)


class PerfectHash:
    """Numbers the distinct keys it was made from 0 to n-1; others get any number, or -1."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.rank, n = [], 0
        for b in bits:
            self.rank.append(np.cumsum(b) - b + n)
            n += int(b.sum())
        self.n = n + len(rest)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        bits, salt = [], 1
        while len(keys) and salt <= ARRAYS:
            size = max(8, int(GAMMA * len(keys)))
            at = (_mixed(keys, salt) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            keys = keys[~alone[at]]
            salt += 1
        return cls(bits, np.sort(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for i, (b, rank) in enumerate(zip(self.bits, self.rank)):
            at = (_mixed(keys[open_], i + 1) % np.uint64(len(b))).astype(np.int64)
            hit = b[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.n - len(self.rest) + at[hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.bits), len(self.rest), *map(len, self.bits)], dtype="<i8")
        return head.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.bits) + self.rest.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        arrays, rest = np.frombuffer(raw, "<i8", 2)
        sizes, at, bits = np.frombuffer(raw, "<i8", arrays, 16), 16 + 8 * int(arrays), []
        for size in sizes.tolist():
            step = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, step, at), count=size).astype(bool))
            at += step
        return cls(bits, np.frombuffer(raw, "<i8", int(rest), at))


PASS = "chunk long, id {id}, text string, shard int, keys binary, counts binary"
NODE = "shard int, sub int, hash binary, keys binary, counts binary"


def _kind(t: Tokenizers) -> str:
    return "<u4" if len(t.bytes_a) * len(t.bytes_b) < 1 << 32 else "<u8"


def _first_pass(docs: DataFrame, id: str, text: str, files: tuple[str, str]) -> DataFrame:
    """PASS: the documents with their chunk, and for each chunk and shard its pairs with the number of its documents that have them."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    name = f"alignment {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: Memory = in_worker(name, lambda: Memory(Tokenizers(*files)))
        chunk, chars, found = TaskContext.get().partitionId() << 32, 0, []

        def closed() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)
            shard = shard_of(keys)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            some = [(s, order[i:j]) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            columns = [[chunk] * len(some), [None] * len(some), [None] * len(some), [s for s, _ in some], [keys[x].astype(_kind(memory.t)).tobytes() for _, x in some], [counts[x].astype("<i4").tobytes() for _, x in some]]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], names)

        names, types = ["chunk", "id", "text", "shard", "keys", "counts"], None
        for batch in batches:
            types = [pa.field("chunk", pa.int64()), batch.schema.field(0), batch.schema.field(1), pa.field("shard", pa.int32()), pa.field("keys", pa.binary()), pa.field("counts", pa.binary())]
            for part in _batches(batch.column(1)):
                texts = batch.column(1).slice(part.start, part.stop - part.start).to_pylist()
                for at in memory.numbers(texts):
                    if at is not None:
                        at = np.unique(at)
                        found.append(np.unique(memory.pairs[_spread(memory.start[at], memory.size[at])]))
                n = part.stop - part.start
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), batch.column(0).slice(part.start, n), batch.column(1).slice(part.start, n), *none], names)
                chars += sum(len(t or "") for t in texts)
                if chars >= CHUNK:
                    yield from closed()
                    chunk, chars, found = chunk + 1, 0, []
        if found:
            yield from closed()

    return rows.mapInArrow(run, PASS.format(id=kind))


def _folded(rows: DataFrame, fold: Callable, schema: str, columns: list[str]) -> DataFrame:
    """The rows of each (shard, sub), hash functions first, folded one after another by ``fold(key) -> object with add(row) and rows()``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, types = None, None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], columns)

        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["shard"], row["sub"])
                if key != at:
                    if at is not None and (found := state.rows()):
                        yield out(found)
                    at, state = key, fold(key)
                more = state.add(row)
                if more:
                    yield out(more)
        if at is not None and (found := state.rows()):
            yield out(found)

    order = ["shard", "sub", F.col("hash").isNull()]
    dealt = rows.repartition("shard", "sub").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


class _Union:
    """Distinct keys; the last level makes the hash function and puts the keys in its order."""

    def __init__(self, key: tuple[int, int], kind: str, last: bool):
        self.key, self.kind, self.last, self.all = key, kind, last, np.zeros(0, dtype=np.int64)

    def add(self, row: dict) -> None:
        self.all = np.union1d(self.all, np.frombuffer(row["keys"], self.kind).astype(np.int64))

    def rows(self) -> list[tuple]:
        if not self.last:
            return [(*self.key, None, self.all.astype(self.kind).tobytes(), None)]
        number = PerfectHash.of(self.all)
        placed = np.zeros(len(self.all), dtype=np.int64)
        placed[number(self.all)] = self.all
        return [(*self.key, number.to_bytes(), placed.astype(self.kind).tobytes(), None)]


class _Vector:
    """Counts by the number of their pair: the hash function comes first, then the pairs of chunks or the vectors of the level below."""

    def __init__(self, key: tuple[int, int], kind: str):
        self.key, self.kind, self.sum = key, kind, None

    def add(self, row: dict) -> None:
        if row["hash"] is not None:
            self.raw, self.kept = row["hash"], row["keys"]
            self.number, self.placed = PerfectHash.from_bytes(self.raw), np.frombuffer(self.kept, self.kind).astype(np.int64)
            self.sum = np.zeros(len(self.placed), dtype=np.int64)
        elif row["keys"] is None:
            self.sum = self.sum + np.frombuffer(row["counts"], "<i8")
        else:
            self.sum[_numbered(self, row["keys"])] += np.frombuffer(row["counts"], "<i4")

    def rows(self) -> list[tuple]:
        return [(*self.key, None, None, self.sum.astype("<i8").tobytes())]


def _numbered(of, raw: bytes) -> np.ndarray:
    """The numbers of keys, each compared with the key stored there."""
    keys = np.frombuffer(raw, of.kind).astype(np.int64)
    at = of.number(keys)
    if (at < 0).any() or (of.placed[at] != keys).any():
        raise ValueError("A pair is not among the distinct pairs.")
    return at


class _Lookup:
    """The pairs of chunks with their counts, and whether a count is the highest of its A id."""

    def __init__(self, kind: str, n_b: int, best: np.ndarray):
        self.kind, self.n_b, self.best = kind, n_b, best

    def add(self, row: dict) -> list[tuple] | None:
        if row["hash"] is not None:
            self.number, self.placed = PerfectHash.from_bytes(row["hash"]), np.frombuffer(row["keys"], self.kind).astype(np.int64)
            self.count = np.frombuffer(row["counts"], "<i8")
            self.top = self.count == self.best[self.placed // self.n_b]
            return None
        at = _numbered(self, row["keys"])
        return [(row["chunk"], row["keys"], self.count[at].astype("<i8").tobytes(), np.packbits(self.top[at]).tobytes())]

    def rows(self) -> None:
        return None


def _second_pass(rows: DataFrame, kind: str, files: tuple[str, str]) -> DataFrame:
    """Documents of each chunk, after the chunk's counts: id, COLUMNS, groups_sha256."""
    name = f"alignment {uuid.uuid4().hex}"
    id_kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: Memory = in_worker(name, lambda: Memory(Tokenizers(*files)))
        chunk, parts, table = None, [], None

        def more(x: Aligned) -> np.ndarray:
            """Links of the highest count of their A id, and the sum of counts, of each part."""
            keys, counts, best = table
            at = np.searchsorted(keys, x.pairs)
            if len(at) and (not len(keys) or (keys[np.minimum(at, len(keys) - 1)] != x.pairs).any()):
                raise ValueError("A pair of the second pass is not among those of the first.")
            out = np.zeros((len(x.sums), 2), dtype=np.int64)
            np.add.at(out[:, 0], x.pair_part, x.times * best[at])
            np.add.at(out[:, 1], x.pair_part, x.times * counts[at])
            return out

        for batch in batches:
            chunks, keys = batch.column("chunk").to_pylist(), batch.column("keys").to_pylist()
            counts, tops = batch.column("counts").to_pylist(), batch.column("tops").to_pylist()
            i = 0
            while i < len(chunks):
                if chunks[i] != chunk:
                    chunk, parts, table = chunks[i], [], None
                if keys[i] is not None:
                    k = np.frombuffer(keys[i], kind).astype(np.int64)
                    parts.append((k, np.frombuffer(counts[i], "<i8"), np.unpackbits(np.frombuffer(tops[i], np.uint8), count=len(k)).astype(np.int64)))
                    i += 1
                    continue
                if table is None:
                    every = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * 3
                    order = np.argsort(every[0])
                    table, parts = [c[order] for c in every], []
                j = i
                while j < len(chunks) and chunks[j] == chunk:
                    j += 1
                texts = batch.column("text").slice(i, j - i)
                for part in _batches(texts):
                    sums, digests = [], []
                    for at in memory.numbers(texts.slice(part.start, part.stop - part.start).to_pylist(), more):
                        if at is None:
                            sums.append(np.zeros(6, dtype=np.int64))
                            digests.append("")
                        else:
                            sums.append(memory.sums[at].sum(axis=0))
                            shown = "".join(map(memory.text.__getitem__, at.tolist()))
                            digests.append(hashlib.sha256(shown[:-1].encode()).hexdigest())
                    ids = batch.column("id").slice(i + part.start, part.stop - part.start)
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in np.stack(sums, axis=1)], pa.array(digests)], ["id", *COLUMNS, "groups_sha256"])
                i = j

    return rows.mapInArrow(run, f"id {id_kind}, {', '.join(f'{c} long' for c in COLUMNS)}, groups_sha256 string")


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    files = files or paths()
    t = Tokenizers(*files)
    kind, n_a, n_b = _kind(t), len(t.bytes_a), len(t.bytes_b)
    del t
    spark, null = docs.sparkSession, lambda c: F.lit(None).cast(c)
    done = keep(_first_pass(docs, id, text, files))
    chunks = done.filter("keys is null").agg(F.count_distinct("chunk")).first()[0]
    subs = max(1, -(-chunks // FAN))

    def sub_of(chunk: str) -> Column:
        return F.pmod(F.xxhash64(chunk), F.lit(subs)).cast("int")

    def levels(rows: DataFrame, fold: Callable[[bool], Callable], first: Callable[[DataFrame], DataFrame]) -> DataFrame:
        left = subs
        while True:
            rows = keep(_folded(first(rows), fold(left == 1), NODE, NODE.replace(" int", "").replace(" binary", "").split(", ")))
            if left == 1:
                return rows
            rows, left = rows.withColumn("sub", F.floor(F.col("sub") / FAN).cast("int")), -(-left // FAN)

    pairs = done.filter("keys is not null").select("shard", sub_of("chunk").alias("sub"), null("binary").alias("hash"), "keys", "counts", "chunk")
    nodes = pairs.drop("chunk")
    hashes = levels(nodes.withColumn("counts", null("binary")), lambda last: lambda key: _Union(key, kind, last), lambda rows: rows)

    def with_hashes(rows: DataFrame) -> DataFrame:
        """A copy of its shard's hash function for each group of rows; groups have about FAN rows."""
        return rows.unionByName(hashes.drop("sub").join(rows.select("shard", "sub").distinct(), "shard").select(*rows.columns))

    vectors = levels(nodes, lambda last: lambda key: _Vector(key, kind), with_hashes)
    counted = keep(hashes.drop("counts").join(vectors.select("shard", "counts"), "shard"))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(n_a, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                np.maximum.at(best, np.frombuffer(row["keys"], kind).astype(np.int64) // n_b, np.frombuffer(row["counts"], "<i8"))
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], ["a", "n"])

    best = np.zeros(n_a, dtype=np.int64)
    for a, n in counted.select("keys", "counts").mapInArrow(highest, "a long, n long").groupBy("a").agg(F.max("n")).collect():  # at most a row for each id of A
        best[a] = n
    asked = pairs.drop("counts").withColumn("counts", null("binary"))
    tables = counted.drop("sub").join(asked.select("shard", "sub").distinct(), "shard").withColumn("chunk", null("long")).select(*asked.columns)
    found = _folded(asked.unionByName(tables), lambda key: _Lookup(kind, n_b, best), "chunk long, keys binary, counts binary, tops binary", ["chunk", "keys", "counts", "tops"])
    texts = done.filter("keys is null").select("chunk", "id", "text", *[null("binary").alias(c) for c in ("keys", "counts", "tops")])
    found = found.select("chunk", null(done.schema["id"].dataType).alias("id"), null("string").alias("text"), "keys", "counts", "tops")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.unionByName(found).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("keys").isNull())
    return _second_pass(dealt, kind, files).withColumnRenamed("id", id)
