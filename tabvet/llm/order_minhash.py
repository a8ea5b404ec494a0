"""Document fingerprints: Order MinHash.

A text's k-mers (``k`` code points) are numbered by occurrence, so repeats count.
Each of ``m`` hash functions selects the ``l`` smallest numbered k-mers; their text
order is kept and the tuple of k-mers in that order is hashed to one coordinate.
Equal coordinates of two texts need the same k-mers in the same order, which
makes the share of equal coordinates follow the edit distance and not only the
common content.

Texts shorter than ``k`` are one k-mer, filled up with a mark that no text has. A
text with fewer than ``l`` k-mers keeps all of them. The empty text has a
fingerprint of its own, all coordinates equal to ``EMPTY``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import shuffle_partitions, slice_bounds, slice_of, tidy

K, L, M = 8, 2, 64
EMPTY = 0xFFFFFFFF
_FILL = 0x110000
#: Elements of one block of hash values, so that it stays in the cache.
_BLOCK = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed values)."""
    x = x ^ (x >> np.uint64(33))
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= np.uint64(c)
        x ^= x >> np.uint64(33)
    return x


class OrderMinHash:
    def __init__(self, k: int = K, l: int = L, m: int = M, seed: int = 42):  # noqa: E741
        rng = np.random.default_rng(seed)
        self.k, self.l, self.m = k, l, m
        self.base = np.uint64(rng.integers(1 << 62, 1 << 63) | 1)
        self.numbering, self.joining = (np.uint64(x | 1) for x in rng.integers(1 << 62, 1 << 63, 2))
        self.xor = rng.integers(0, 1 << 32, m, dtype=np.uint64).astype(np.uint32)
        self.times = rng.integers(0, 1 << 32, m, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def kmers(self, text: str) -> np.ndarray:
        """A 64-bit hash of each k-mer, in text order."""
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if 0 < len(h) < self.k:
            h = np.concatenate([h, np.full(self.k - len(h), _FILL, np.uint64)])
        n, width, power, done, total = max(0, len(h) - self.k + 1), 1, self.base, 0, None
        while n and done < self.k:  # pieces of 1, 2, 4, ... code points make up k
            if self.k & width:
                piece = h[done:done + n]
                total = piece if total is None else total * power + piece
                done += width
            if done < self.k:
                h, width, power = h[:-width] * power + h[width:], 2 * width, np.uint64(pow(int(power), 2, 1 << 64))
        return mix64(total) if n else np.zeros(0, np.uint64)

    def numbered(self, kmers: np.ndarray) -> np.ndarray:
        """A 32-bit value of each k-mer with the number of its occurrence."""
        place, bits = np.arange(len(kmers), dtype=np.uint64), np.uint64(len(kmers).bit_length())
        ranked = np.sort(kmers >> bits << bits | place)  # the hash's upper bits, then the place: one plain sort
        order, ranked = (ranked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), ranked >> bits
        opens = np.ones(len(kmers), bool)
        opens[1:] = ranked[1:] != ranked[:-1]
        number = np.empty(len(kmers), np.uint64)
        number[order] = place - np.maximum.accumulate(np.where(opens, place, np.uint64(0)))
        return (mix64(kmers + number * self.numbering) >> np.uint64(32)).astype(np.uint32)

    def coordinates(self, text: str) -> np.ndarray:
        kmers = self.kmers(text)
        n = len(kmers)
        if not n:
            return np.full(self.m, EMPTY, np.uint32)
        values, keep = self.numbered(kmers), min(self.l, n)
        chosen = np.empty((self.m, keep), np.int64)
        step, rows = max(1, _BLOCK // n), np.arange(self.m)
        for a in range(0, self.m, step):
            z = min(self.m, a + step)
            h = (values ^ self.xor[a:z, None]) * self.times[a:z, None]
            for i in range(keep):  # equal values: the first in the text
                chosen[a:z, i] = least = h.argmin(axis=1)
                h[rows[:z - a], least] = EMPTY
        chosen.sort(axis=1)
        out = np.arange(1, self.m + 1, dtype=np.uint64)
        for i in range(keep):
            out = mix64(out * self.joining + kmers[chosen[:, i]])
        return np.minimum(out >> np.uint64(32), EMPTY - 1).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def to_hex(coordinates: np.ndarray) -> str:
    return coordinates.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, make: OrderMinHash | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row, map only; null text: empty."""
    make = make or OrderMinHash()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([to_hex(make.coordinates(x)) for x in texts])],
                names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, n_chars bigint, fingerprint string")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, guest, slice) dealt into slices of ascending doc_id, sorted, and the number of slices.

    The last row of a slice is a guest: the row that opens the next slice (after the
    last slice: the first row of all), so each row meets its successor in one shuffle
    of the texts. Slices open at doc_ids that occur. Null doc_ids come first, equal
    ones by text.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = slice_bounds(rows, "doc_id", shuffle_partitions(docs.sparkSession))
    n = len(bounds) + 1
    ends = rows.agg(F.min("doc_id").alias("low"), F.count_if(F.isnull("doc_id")).alias("nulls")).first()
    first = F.col("doc_id").isNull() if ends.nulls else F.col("doc_id") == F.lit(ends.low)
    opens = rows.where(first | F.col("doc_id").isin(bounds) if bounds else first)
    own = rows.withColumns({"guest": F.lit(False), "slice": slice_of("doc_id", bounds)})
    guests = opens.withColumns({"guest": F.lit(True), "slice": F.pmod(slice_of("doc_id", bounds) + F.lit(n - 1), F.lit(n))})
    return own.unionByName(guests).repartitionById(n, "slice").sortWithinPartitions("slice", "guest", "doc_id", "text"), n


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_report(docs: DataFrame, make: OrderMinHash | None = None,
                edit: Callable[[str, str], str] = edited) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and the likeness to the edited text and to the next row.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null text: empty. One row is its own successor. Empty table: no rows.
    """
    make = make or OrderMinHash()
    rows, _ = with_next(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = None, None
        for b in batches:
            out = []
            for key, text, guest, part in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held is None or part != opened:
                    held, opened = (key, text, make.coordinates(text)), part
                    if guest:
                        held = None  # a slice without rows of its own
                    continue
                if held[0] is _DONE:
                    continue
                mine = (key, text, make.coordinates(text))
                changed = edit(held[1], text)
                of_changed = make.coordinates(changed)
                out.append((held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), to_hex(held[2]), to_hex(of_changed),
                            likeness(held[2], of_changed), likeness(held[2], mine[2])))
                held = (_DONE, "", None) if guest else mine
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _REPORT, strict=True)]
                                             if out else [pa.array([], f.type) for f in _REPORT], schema=_REPORT)

    return rows.mapInArrow(tidy(run), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")


_DONE = object()
_REPORT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
