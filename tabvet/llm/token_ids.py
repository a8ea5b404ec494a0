"""Token ids in a byte-aligned binary format.

Ids of a block of documents are replaced by their frequency rank in the block
(0: most frequent, ties by id) and written in one to four bytes each. The
lengths stand apart in control bytes, four two-bit codes to a byte. A block is

    magic "TIDS1", six little-endian uint64 counts (documents, ids, distinct ids, data bytes, control bytes, 0),
    the distinct ids by rank (uint32), the documents' ids per document (uint64) and keys (int64) with a
    null mask (one byte each), the control bytes, the data bytes.

The decoder looks each control byte up in a 256 x 4 table of lengths; running sums
of them are the places of all values, which numpy gathers at once.

In Spark the documents are dealt into slices of ascending doc_id (a slice is a
range of ids of about equal size; one shuffle of the texts), each task encodes
its slice in order and cuts blocks of bounded size, and the blocks are rows
(``slice``, ``block``, counts, ``data``) of a Parquet table in the shared folder.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder, shuffle_partitions, slice_bounds, slice_of, tidy

MAGIC = b"TIDS1\0\0\0"
BLOCK_IDS = 1_000_000
#: Distinct pieces of words an encoder keeps the ids of; it starts anew beyond.
CACHE_WORDS = 200_000
#: Characters of texts that are split into words at once; a longer text is split alone.
CHUNK_CHARS = 1 << 19

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode_block(ids: np.ndarray, counts: np.ndarray, keys: list[int | None]) -> bytes:
    """``ids``: of all documents in order; ``counts``: how many each document has."""
    freq = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(freq)
    by_rank = used[np.argsort(-freq[used], kind="stable")].astype(np.uint32)
    rank = np.zeros(len(freq), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    values = rank[ids]
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    kept = np.arange(4, dtype=np.uint8) < length[:, None]
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[kept]
    head = struct.pack("<6Q", len(counts), len(ids), len(by_rank), len(data), len(control), 0)
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([0 if k is None else k for k in keys], "<i8")
    return b"".join([MAGIC, head, by_rank.astype("<u4").tobytes(), np.asarray(counts, "<u8").tobytes(), key.tobytes(),
                     null.tobytes(), control.tobytes(), data.tobytes()])


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Ids, ids per document, document keys."""
    if bytes(block[:8]) != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, distinct, data_bytes, control_bytes, _ = struct.unpack_from("<6Q", block, 8)
    at = 56
    by_rank = np.frombuffer(block, "<u4", distinct, at)
    counts = np.frombuffer(block, "<u8", docs, at := at + 4 * distinct).astype(np.int64)
    key = np.frombuffer(block, "<i8", docs, at := at + 8 * docs)
    null = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs)
    control = np.frombuffer(block, np.uint8, control_bytes, at := at + docs)
    data = np.frombuffer(block, np.uint8, data_bytes, at + control_bytes)
    length = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(length, dtype=np.int64)
    if data_bytes != (ends[-1] if n else 0):
        raise ValueError("the control bytes do not add up to the data")
    start = ends - length
    values = data[start].astype(np.uint32)
    for i in (1, 2, 3):
        longer = np.flatnonzero(length > i)
        values[longer] |= data[start[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return by_rank[values] if n else np.zeros(0, np.uint32), counts, [None if z else int(k) for k, z in zip(key, null, strict=True)]


# Fixed value: how such a tokenizer splits a text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# What isn't Latin script with single code points, or doesn't lower-case letter by letter.
_UNUSUAL = re.compile("[ªºİ\u0250-\U0010ffff]")
# ASCII punctuation but the apostrophe, which the tokenizer's pattern joins to what follows.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Lower-case letters and punctuation: neither the normaliser nor the splitter changes a run of them.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower() and not _UNUSUAL.match(c))
_RUN = re.compile(f"[{_LETTERS}]+|[{re.escape(_PUNCTUATION)}]+").fullmatch
# White space for str.split and Arrow, not for the tokenizer.
_NO_SPACE = re.compile("[\x1c-\x1f]").search
_ID = attrgetter("id")


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of byte-level BPE: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _check(spec: dict) -> None:
    """ValueError unless the tokenizer encodes a text word by word as WordEncoder does."""
    normal = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    first, second = (*split, {}, {})[:2]
    if normal != [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] or len(split) != 2 or (second.get("type"), second.get("add_prefix_space"), second.get("use_regex")) != (
            "ByteLevel", False, False) or (first.get("type"), first.get("behavior"), first.get("invert"), (first.get("pattern") or {}).get("Regex")) != (
            "Split", "Removed", True, _SPLIT) or spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or spec["post_processor"]:
        raise ValueError("the tokenizer does not encode texts word by word, lower-cased and without white space")
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
        raise ValueError("added tokens that reach beyond a word")


class _Numbers(dict):
    """Numbers of pieces in order of appearance; new ones stand in ``waiting`` until they are encoded."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``flat[s:s + n]`` for every start and length, joined."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1])] if len(ends) else flat[:0]


class WordEncoder:
    """Ids of whole texts for a lower-casing tokenizer that splits at white space and drops it (ValueError for any other).

    Such a tokenizer encodes a text as its words one after another, so each
    distinct word of about ``chunk_chars`` of texts is looked up once, and each distinct
    piece is given to the library once. A word of plain letters and closing
    punctuation is two pieces that go straight to the library's model (the
    normaliser and the splitter leave them as they are, but for the case);
    any other goes through the library's full ``encode``.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, chunk_chars: int = CHUNK_CHARS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            _check(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cache_words, self.chunk_chars = self.tokenizer.model, cache_words, chunk_chars
        self.alphabet = _byte_alphabet()
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offset, self.length, self.known = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), 0
        self.none = self.numbers[""]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        ids, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= self.chunk_chars):
                chars += len(texts[to])
                to += 1
            for all_parts, part in zip((ids, counts), self._chunk(texts[at:to]), strict=True):
                all_parts.append(part)
            at = to
        return np.concatenate(ids), np.concatenate(counts)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > self.cache_words:
            self.clear()
        apart = [i for i, t in enumerate(texts) if _NO_SPACE(t)]
        # Lower-casing early is the same only where it goes letter by letter.
        low = [t.lower() if t.isascii() or not _UNUSUAL.search(t) else t for t in texts]
        for i in apart:
            low[i] = ""
        split = pc.utf8_split_whitespace(pa.array(low, pa.string()))
        words = split.flatten().dictionary_encode()
        pieces = self._pieces(words.dictionary)
        if self.numbers.waiting:
            self._learn()
        length = self.length[pieces]
        flat = _gather(self.flat, self.offset[pieces].ravel(), length.ravel())
        length = length.sum(axis=1)
        at = words.indices.to_numpy()
        start, length = (np.cumsum(length) - length)[at], length[at]
        ids = _gather(flat, start, length)
        ends = np.concatenate([[0], np.cumsum(length)])[split.offsets.to_numpy()]
        if not apart:
            return ids, np.diff(ends)
        each = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in apart:
            each[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _pieces(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of the two pieces of each word; of one that is not plain, of the word and of the empty piece."""
        stem = pc.utf8_rtrim(words, characters=_PUNCTUATION)
        plain = pc.match_substring_regex(stem, f"\\A[{_LETTERS}]+\\z")
        out = np.full((len(words), 2), self.none)
        out[:, 0] = np.fromiter(map(self.numbers.__getitem__, pc.if_else(plain, stem, words).to_numpy(zero_copy_only=False)), np.int64, len(words))
        closing = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy()
        closed = np.flatnonzero(plain.to_numpy(zero_copy_only=False) & (closing > 0))
        tails = (w[-n:] for w, n in zip(words.take(pa.array(closed)).to_numpy(zero_copy_only=False), closing[closed].tolist(), strict=True))
        out[closed, 1] = np.fromiter(map(self.numbers.__getitem__, tails), np.int64, len(closed))
        return out

    def _learn(self) -> None:
        ids, tokenize = [], self.model.tokenize
        for piece in self.numbers.waiting:
            if not _RUN(piece):
                ids.append(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            else:
                ids.append(list(map(_ID, tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)))))
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total, pieces = int(n.sum()), self.known + len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        if pieces > len(self.offset):
            grow = np.zeros(max(len(self.offset), len(ids)), np.int64)
            self.offset, self.length = np.concatenate([self.offset, grow]), np.concatenate([self.length, grow])
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.offset[self.known:pieces], self.length[self.known:pieces] = self.used + np.cumsum(n) - n, n
        self.used, self.known, self.numbers.waiting = self.used + total, pieces, []


@lru_cache(maxsize=1)
def kept_encoder(path: str, cache_words: int = CACHE_WORDS, chunk_chars: int = CHUNK_CHARS) -> WordEncoder:
    """One encoder for all tasks of a Python worker, which find the tokenizer and the pieces of the tasks before."""
    return WordEncoder(path, cache_words, chunk_chars)


def write_token_ids(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS,
                    encoder: Callable[[str], WordEncoder] = WordEncoder) -> DataFrame:
    """Encode ``text`` of every row, append ``end_id``, write blocks in ascending doc_id order; the written table.

    Null text: the end id alone. Null doc_ids come first, equal ones by text. An
    empty table gives no blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = slice_bounds(rows, "doc_id", shuffle_partitions(spark))
    dealt = (rows.withColumn("slice", slice_of("doc_id", bounds)).repartitionById(len(bounds) + 1, "slice")
             .sortWithinPartitions("slice", "doc_id", "text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer_path), np.array([end_id], np.uint32)
        parts, counts, keys, held, block, at = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = encode_block(np.concatenate(parts).astype(np.int64), np.array(counts), keys)
            values = ([at], [block], [len(counts)], [held], [data])
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["slice", "block", "docs", "ids", "data"])

        for b in batches:
            at = b.column(2)[0].as_py() if b.num_rows else at
            ids, lengths = words.encode_all(b.column(1).to_pylist())
            for key, n, to in zip(b.column(0).to_pylist(), lengths.tolist(), np.cumsum(lengths).tolist(), strict=True):
                parts += [ids[to - n:to], end]
                counts.append(n + 1)
                keys.append(key)
                held += n + 1
                if held >= block_ids:
                    yield flush()
                    parts, counts, keys, held, block = [], [], [], 0, block + 1
        if counts:
            yield flush()

    return in_shared_folder(dealt.mapInArrow(tidy(encode), "slice int, block int, docs bigint, ids bigint, data binary"), "token-ids")


def read_token_ids(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the written blocks: doc_id, start, n_tokens, ids_crc32 and, ``with_ids``, ids.

    ``start`` counts the ids of all documents before it: sums over the blocks (one
    small row per block), then inside the block.
    """
    rows = blocks.select("slice", "block", "ids").collect()  # counts only, one row per block of millions of ids
    starts, total = {}, 0
    for r in sorted(rows):
        starts[r.slice, r.block] = total
        total += r.ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                            *[("ids", pa.list_(pa.int32()))] * with_ids])
        for b in batches:
            for at, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, counts, keys = decode_block(data.as_buffer())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                         ] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts[at, block] + ends - counts), pa.array(counts), pa.array(crc, pa.int64()),
                     *lists], schema=schema)

    return blocks.select("slice", "block", "data").mapInArrow(tidy(decode), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
