"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A line is a paragraph. A section ends with a blank line or a paragraph whose
digest says so, and a leaf, about ``LEAF`` bytes, where the last ``SEEN`` bytes
say so or after ``LEAF_MOST`` bytes; so an insertion moves no boundary beyond
the next one. One rule holds for texts of any length, with or without spaces.
The digest of a paragraph is that of its leaves' digests, and so up to the
root. A fingerprint is text: the root, then the sections with their digests
and, for each of their paragraphs, the labels of its leaves. Equal texts have
equal roots and fingerprints; comparing downwards from differing digests
locates edits.

Likeness is 2 * common / (a + b) over the leaves' labels as multisets; 1 for
equal roots. Equal sections count whole, and only leaves below differing ones
are compared. A text of a few characters has one or two leaves, so its likeness
is coarse.

Defined cases: a null text is an empty text with a fingerprint of its own; long
texts are read whole, a group of lines at a time; null ids stand first in the
order of ids, and rows with the same id in the order of a hash of their text;
the only row of a table is its own next; an empty table gives an empty result;
other columns are not read. Ids are whole numbers; others are refused by the
cast to long.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_of

#: Mean and most bytes of a leaf, bytes that decide about its end, mean paragraphs of a section.
LEAF, LEAF_MOST, SEEN, SECTION = 12, 64, 4, 8
LABEL = 3  # bytes of a leaf's digest that its label has
#: Bytes of lines that are cut at once, if no line is longer.
TOGETHER = 1 << 20
_TURN, _ONE, _TWO, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xFF51AFD7ED558CCD))
_POWERS = tuple(m ** np.arange(LEAF_MOST, dtype=np.uint64) for m in (_ONE, _TWO))


def _mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaves(lines: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digests, two numbers each, of the leaves of lines that all end with a line feed, and where each line's leaves begin (one more at the end)."""
    own = np.frombuffer(lines, np.uint8)
    end = own == 10
    x = own.astype(np.uint64) + np.uint64(1)
    ends = end.copy()
    if len(x) > SEEN:
        h, fresh_line = x[: len(x) - SEEN + 1], end[: len(x) - SEEN + 1].copy()
        for k in range(1, SEEN):
            h = h * _TURN + x[k : len(x) - SEEN + 1 + k]
            if k < SEEN - 1:
                fresh_line |= end[k : len(x) - SEEN + 1 + k]
        ends[SEEN - 1 :] |= (_mix(h) % np.uint64(LEAF) == 0) & ~fresh_line
        ends[:-1] &= ~end[1:] | end[:-1]  # no leaf of a line feed alone, but that of an empty line
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    parts = -(-(stop - start) // LEAF_MOST)
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + LEAF_MOST * nth
        stop = np.append(start[1:], len(x))
    place = np.arange(len(x)) - np.repeat(start, stop - start)
    digests = np.stack([_mix(np.add.reduceat(x * p[place], start)) for p in _POWERS], axis=1)
    line_starts = np.concatenate([[0], np.flatnonzero(end) + 1])
    return digests, np.searchsorted(start, line_starts)


@dataclass
class Tree:
    """Root, sections as (digest, paragraphs' labels), and the fingerprint."""

    root: bytes
    sections: list[tuple[bytes, list[bytes]]]
    mark: str


def tree(text: bytes) -> Tree:
    sections, digests, labels = [], [], []
    lines = text.split(b"\n")
    at = 0
    while at < len(lines):
        upto, size = at, 0
        while upto < len(lines) and (upto == at or size + len(lines[upto]) < TOGETHER):
            size += len(lines[upto]) + 1
            upto += 1
        leaves, begin = _leaves(b"\n".join(lines[at:upto]) + b"\n")
        raw, short = leaves.tobytes(), np.ascontiguousarray(leaves[:, :1]).view(np.uint8)[:, :LABEL].tobytes()
        for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            digests.append(_hash(raw[16 * a : 16 * b]))
            labels.append(short[LABEL * a : LABEL * b])
            if not lines[at + i] or digests[-1][0] % SECTION == 0 or at + i + 1 == len(lines):
                sections.append((_hash(b"".join(digests)), labels))
                digests, labels = [], []
        at = upto
    root = _hash(b"".join(d for d, _ in sections))
    encode = lambda x: base64.urlsafe_b64encode(x).decode()
    mark = root.hex() + "".join(f"/{d[:6].hex()}:{','.join(map(encode, x))}" for d, x in sections)
    return Tree(root, sections, mark)


def likeness(a: Tree, b: Tree) -> float:
    """Of two fingerprints' trees."""
    if a.root == b.root:
        return 1.0
    same = Counter(d for d, _ in a.sections) & Counter(d for d, _ in b.sections)
    common, rest = 0, []
    for t in (a, b):
        left, below = Counter(same), []
        for d, labels in t.sections:
            if left[d]:
                left[d] -= 1
                common += sum(map(len, labels))
            else:
                below += labels
        raw = np.frombuffer(b"".join(below), np.uint8).reshape(-1, LABEL).astype(np.int32)
        rest.append(np.unique(raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16, return_counts=True))
    _, i, j = np.intersect1d(rest[0][0], rest[1][0], assume_unique=True, return_indices=True)
    both = common // LABEL + 2 * int(np.minimum(rest[0][1][i], rest[1][1][j]).sum())
    return both / sum(sum(len(x) for _, labels in t.sections for x in labels) // LABEL for t in (a, b))


def fingerprint(text: str | None) -> str:
    return tree((text or "").encode()).mark


def leaves_of(mark: str) -> Counter:
    """The labels of a fingerprint's leaves."""
    found: Counter = Counter()
    for section in mark.split("/")[1:]:
        for labels in section.split(":")[1].split(","):
            raw = base64.urlsafe_b64decode(labels)
            found.update(raw[i : i + LABEL] for i in range(0, len(raw), LABEL))
    return found


def edited_paragraphs(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of ``a`` whose branch has no equal in ``b``; nothing below an equal root or section is read."""
    if a.split("/", 1)[0] == b.split("/", 1)[0]:
        return []
    theirs = [x.split(":") for x in b.split("/")[1:]]
    same, lines = {d for d, _ in theirs}, {p for _, x in theirs for p in x.split(",")}
    out, at = [], 0
    for section in a.split("/")[1:]:
        digest, labels = section.split(":")
        parts = labels.split(",")
        if digest not in same:
            out += [at + i for i, p in enumerate(parts) if p not in lines]
        at += len(parts)
    return out


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, fingerprint."""

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return df.select(F.col(id), mark(text_of(text)).alias("fingerprint"))


def with_next(df: DataFrame, id: str, text: str) -> DataFrame:
    """id, t: the rows dealt by ranges of the id and sorted, each range followed by the first row of the next (``peek`` 1).

    Only the ranges' bounds and first keys reach the driver, as many as there are ranges.
    """
    spark = df.sparkSession
    keyed = df.select(F.col(id).cast("long").alias("id"), text_of(text).alias("t")).withColumn("h", F.xxhash64("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    bounds = np.unique(keyed.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)) or []).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        none = ids.isna()
        return pd.Series(np.where(none, 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right")).astype(np.int32))

    keyed = keyed.withColumn("bucket", bucket("id"))
    firsts = sorted(keyed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "h")).alias("x")).select("bucket", "x.id", "x.h").collect())
    before = {(r[1], r[2]): firsts[k - 1][0] for k, r in enumerate(firsts)}

    @F.pandas_udf("int")
    def earlier(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([before.get((None if pd.isna(i) else int(i), x), -1) for i, x in zip(ids, h)], dtype=np.int32)

    # Only first rows are asked about, by their hash.
    first = F.col("h").isin([r[2] for r in firsts]) if len(firsts) <= 1000 else F.lit(True)
    keyed = keyed.withColumn("__before", F.when(first, earlier("id", "h")).otherwise(-1))
    places = F.array(F.struct(F.col("bucket"), F.lit(0).alias("peek")), F.struct(F.col("__before").alias("bucket"), F.lit(1).alias("peek")))
    dealt = keyed.select("id", "t", "h", F.explode(places).alias("p")).select("p.bucket", "p.peek", "id", "h", "t").filter("bucket >= 0")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", "id", "h")


def against_edit(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    In the edited text the last quarter of the characters gave way to as many of the next document's first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part, out = batch.slice(lo, 100).to_pydict(), []
                for place, peek, key, text in zip(part["bucket"], part["peek"], part["id"], part["t"]):
                    if last is not None and last[0] != place:
                        last = None
                    if peek and last is None:
                        continue
                    own = (place, key, text, tree(text.encode()))
                    if last is not None:
                        _, k, t, first = last
                        change = len(t) // 4
                        edited = (t[: len(t) - change] + text[:change]).encode()
                        second = tree(edited)
                        out.append((k, len(t), hashlib.sha256(edited).hexdigest(), first.mark, second.mark, likeness(first, second), likeness(first, own[3])))
                    last = None if peek else own
                names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, id, text).select("bucket", "peek", "id", "t").mapInArrow(run, schema).withColumnRenamed("id", id)
