"""Repeated windows of a corpus: what substring operators share.

A window is ``length`` consecutive tokens (bytes or words) of one document. It is
repeated if the same token sequence also starts anywhere else. Every window has an
anchor, the leftmost of its smallest ``gram``-token hashes, chosen by content alone,
so equal windows have equal anchors at equal places. Consecutive windows with one
anchor are a *run*; its *stretch* is the text from its first window's start to its
last window's end. That leaves about two anchors per ``length - gram`` tokens:

1. ``runs_of`` gives each document's runs: place, the anchor's gram hash (``key``) and the
   stretch's hash. The operators find out which keys occur more than once.
2. ``repeated`` extends the matching runs both ways. Runs with equal stretches match in
   full, all their windows are repeated, and one of them stands for all from here on
   (so ten thousand copies cost as much as two). Where the stretches of one key differ,
   one of each is fetched from the texts, and windows that occur in two of them are
   repeated. Nothing pairs the members of a group with one another.
3. ``covered`` brings the repeated windows to the documents as spans of tokens.

Equality is judged on 64-bit hashes of whole sequences together with the 64-bit anchor
hash. A row is known by its doc_id and a hash of its id and text, so null and repeated
ids work; identical rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder, tidy
from tabvet.llm.order_minhash import mix64

#: Tokens handled at once: short documents together, long ones in overlapping pieces.
CHUNK = 1 << 18
#: Different stretches of one key that a single task compares: some megabytes.
TOGETHER = 4096

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = int(_RNG.integers(1 << 61, 1 << 62)) * 2 + 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _POWERS[base] = have
    return have[:n]


class Hashes:
    """Hashes of any stretch of a token array, from running sums of its polynomial."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(_B, len(values)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        shift = _powers(_B_INVERSE, len(self.sums))[start]
        return mix64((self.sums[end] - self.sums[start]) * shift + (end - start).astype(np.uint64))


def byte_tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, starts


def _values(tokens: np.ndarray) -> np.ndarray:
    """A 64-bit value per token: words are hashes already."""
    return _BYTE[tokens] if tokens.dtype == np.uint8 else tokens


def word_tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word ``[^\\x20\\x09-\\x0D]+``, and where the documents' words start. Cut at white space into
    pieces, so that long texts need no more memory than their words."""
    out, first, at = [], [], 0
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = starts[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + CHUNK)))
        a, z = begin[at], end[to - 1]
        out.append(Hashes(_BYTE[data[a:z]]).of(begin[at:to] - a, end[at:to] - a))
        at = to
    first = np.searchsorted(begin, starts)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), first


Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _smallest(packed: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        packed, size = np.minimum(packed[:-size], packed[size:]), 2 * size
    rest = width - size
    return np.minimum(packed[:-rest], packed[rest:]) if rest else packed


def _runs(values: np.ndarray, doc_end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, key and stretch hash of each run in a token array.

    ``doc_end``: for each token where its document ends in the array.
    """
    n = len(values) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    hashes, grams = Hashes(values), np.arange(len(values) - gram + 1)
    h = hashes.of(grams, grams + gram)
    bits = np.uint64(len(h).bit_length())
    anchor = (_smallest(h >> bits << bits | grams.astype(np.uint64), length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1)))
    window = np.arange(n)
    window = window[window + length <= doc_end[:n]]
    if not len(window):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    anchor = anchor.astype(np.int64)[window]
    opens = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    first, last = window[opens], window[np.concatenate([opens[1:] - 1, [len(window) - 1]])]
    return first, last - first + 1, h[anchor[opens]], hashes.of(first, last + length)


def _pieces(first: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(document from, to, token from, to): whole documents together up to CHUNK tokens; long documents in pieces
    that overlap by a window less one token."""
    doc, docs = 0, len(first) - 1
    while doc < docs:
        to = max(doc + 1, int(np.searchsorted(first, first[doc] + CHUNK, side="right")) - 1)
        for a in range(int(first[doc]), int(first[to]), CHUNK) if to == doc + 1 else [int(first[doc])]:
            yield doc, to, a, min(int(first[to]), a + CHUNK + length - 1) if to == doc + 1 else int(first[to])
        doc = to


def text_rows(docs: DataFrame) -> DataFrame:
    """doc (id, null as 0), row (hash of id and text), doc_id, text (null as empty)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc"),
                       F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("row"),
                       F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and where its values start (and the last ends)."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    starts = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    if data is None:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0]:starts[-1]], starts - starts[0]


RUN = "doc bigint, row bigint, first int, windows int, key bigint, stretch bigint"


def runs_of(docs: DataFrame, tokens: Tokens, length: int, gram: int) -> DataFrame:
    """The runs of every document with at least one window; map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = (b.column(i).to_numpy() for i in (0, 1))
            for part in _parts(b.column(2)):
                found, starts = tokens(part[0], part[1])
                for d, to, a, z in _pieces(starts, length):
                    ends = np.repeat(starts[d + 1:to + 1], np.diff(np.clip(starts[d:to + 1], a, z))) - a
                    first, windows, key, stretch = _runs(_values(found[a:z]), np.minimum(ends, z - a), length, gram)
                    of = np.searchsorted(starts, first + a, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[part[2] + of]), pa.array(row[part[2] + of]), pa.array((first + a - starts[of]).astype(np.int32)),
                         pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(stretch.view(np.int64))],
                        names=["doc", "row", "first", "windows", "key", "stretch"])

    return text_rows(docs).select("doc", "row", "text").mapInArrow(tidy(run), RUN)


def _parts(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A text column in parts of about ``most`` bytes: bytes, starts, number of the first text."""
    data, starts = text_bytes(column)
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="right")) - 1)
        yield data[starts[at]:starts[to]], starts[at:to + 1] - starts[at], at
        at = to


def _stretches(docs: DataFrame, runs: DataFrame, tokens: Tokens, length: int) -> DataFrame:
    """The tokens of the given runs' stretches, fetched in one pass over the texts: key, alone, many, doc, row, first, tokens."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "alone", "many", "doc", "row", "first", "tokens"]
        for b in batches:
            flat, of = b.column(3).flatten(), np.asarray(b.column(3).offsets)
            first, windows = (flat.field(i).to_numpy() for i in (0, 1))
            for i in range(b.num_rows):
                found, _ = tokens(*text_bytes(b.column(2).slice(i, 1)))
                at = slice(of[i] - of[0], of[i + 1] - of[0])
                n = at.stop - at.start
                cut = [found[f:f + w + length - 1].tobytes() for f, w in zip(first[at].tolist(), windows[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(flat.field(k).slice(at.start, n) for k in (2, 3, 4)), pa.array(np.full(n, b.column(0)[i].as_py())),
                     pa.array(np.full(n, b.column(1)[i].as_py())), pa.array(first[at]), pa.array(cut, pa.binary())], names=names)

    by_doc = runs.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "windows", "key", "alone", "many")).alias("runs"))
    texts = text_rows(docs).select("doc", "row", "text").join(by_doc, ["doc", "row"])
    return texts.mapInArrow(tidy(fetch), "key bigint, alone boolean, many boolean, doc bigint, row bigint, first int, tokens binary")


def _window_hashes(rows: pa.Table | pa.RecordBatch, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the row and place of every window of the rows' stretches."""
    flat, starts = text_bytes(rows.column("tokens").combine_chunks() if isinstance(rows, pa.Table) else rows.column("tokens"))
    starts, n = starts // width, np.diff(starts) // width - length + 1
    hashes = Hashes(_values(np.frombuffer(flat.tobytes(), np.uint8 if width == 1 else np.uint64)))
    of = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[of] + within
    return hashes.of(at, at + length), of, rows.column("first").to_numpy()[of] + within


_SPANS = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _compared(length: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by key: the windows of stretches that stand alone which also stand in another stretch of the key."""

    def judge(rows: pa.Table) -> pa.RecordBatch:
        hashed, of, place = _window_hashes(rows, length, width)
        key = rows.column("key").to_numpy().view(np.uint64)[of]
        _, number, times = np.unique(mix64(key * np.uint64(_B) + hashed), return_inverse=True, return_counts=True)
        keep = np.flatnonzero((times[number] > 1) & rows.column("alone").to_numpy()[of])
        of, place = of[keep], place[keep]
        opens = np.flatnonzero(np.concatenate([[len(of) > 0], (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)]))
        closes = np.concatenate([opens[1:] - 1, [len(of) - 1]]) if len(of) else opens
        at = of[opens]
        return pa.RecordBatch.from_arrays([pa.array(rows.column("doc").to_numpy()[at]), pa.array(rows.column("row").to_numpy()[at]),
                                           pa.array(place[opens].astype(np.int32)), pa.array(place[closes].astype(np.int32))],
                                          schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = pa.Table.from_batches([b])
            now = now if held is None else pa.concat_tables([held, now])
            key = now.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield judge(now.slice(0, last).combine_chunks())
            held = now.slice(last)
        if held is not None and held.num_rows:
            yield judge(held.combine_chunks())

    return run


def repeated(docs: DataFrame, matching: DataFrame, tokens: Tokens, length: int, together: int = TOGETHER) -> DataFrame:
    """Repeated windows (doc, row, first, last) of the ``matching`` runs, whose keys occur more than once.

    Up to ``together`` different stretches of a key are compared in one task; those of a
    key with more are compared as rows, one per window, which spreads them over all tasks.
    """
    width = 8 if tokens is word_tokens else 1
    same = ["key", "stretch", "windows"]
    kinds = in_shared_folder(matching.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc", "row", "first")).alias("at")),
                             "stretches")
    copied = (matching.join(kinds.where("n > 1").select(*same), same, "left_semi")
              .select("doc", "row", "first", (F.col("first") + F.col("windows") - 1).alias("last")))
    mixed = in_shared_folder(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
                             .where("kinds > 1 AND least = 1").select("key", (F.col("kinds") > together).alias("many")), "mixed")
    apart = kinds.join(mixed, "key").select("at.*", "windows", "key", (F.col("n") == 1).alias("alone"), "many")
    stretches = in_shared_folder(_stretches(docs, apart, tokens, length), "apart")

    few = (stretches.where("NOT many").select("key", "alone", "doc", "row", "first", "tokens")
           .repartition("key").sortWithinPartitions("key").mapInArrow(_compared(length, width), "doc bigint, row bigint, first int, last int"))

    def by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashed, of, place = _window_hashes(b, length, width)
            columns = [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)[of] for n in ("key", "alone", "doc", "row")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(place.astype(np.int32)), pa.array(hashed.view(np.int64))],
                                             names=["key", "alone", "doc", "row", "first", "hash"])

    rows = stretches.where("many").mapInArrow(tidy(by_window), "key bigint, alone boolean, doc bigint, row bigint, first int, hash bigint")
    again = in_shared_folder(rows.groupBy("key", "hash").agg(F.count("*").alias("n"), F.max("alone").alias("any"))
                             .where("n > 1 AND any").select("key", "hash"), "again")
    most = (rows.where("alone").join(again, ["key", "hash"], "left_semi").select("doc", "row", "first", F.col("first").alias("last")))
    return copied.unionByName(few).unionByName(most)


def covered(docs: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """doc_id, text, spans (flat start, end pairs of covered tokens, merged; null without any) of every row."""
    spans = windows.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("windows"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, of, out = b.column(2).flatten(), np.asarray(b.column(2).offsets), []
            first, last = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            for i in range(b.num_rows):
                a, z = of[i] - of[0], of[i + 1] - of[0]
                start, end = first[a:z], np.maximum.accumulate(last[a:z]) + length
                opens = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                closes = np.concatenate([opens[1:] - 1, [z - a - 1]])
                out.append(np.stack([start[opens], end[closes]], axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc", "row", "spans"])

    merged = spans.mapInArrow(merge, "doc bigint, row bigint, spans array<bigint>")
    return text_rows(docs).join(merged, ["doc", "row"], "left").select("doc_id", "text", "spans")
