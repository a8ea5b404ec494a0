"""Byte-pair encoding of whole texts by a trie of their words, and decoding.

The split pattern cuts a text into words; a word's ids depend on the word alone.
The distinct words of a batch that aren't known yet are inserted into a trie over
their bytes, whose branches stand in depth-first order. One depth-first pass gives
every node its state: the last token of the encoding of the prefix that the node
spells. The encoding before that token is the state of the ancestor where the
token begins, so a prefix shared by many words is encoded once, and a word's ids
are read backwards along its path.

Which token is the last one: a sequence of tokens is an encoding exactly if each two
neighbours are the encoding of their joined bytes, so of the tokens that end at a
node exactly one follows the state at its beginning. Two tokens stay apart if no
piece at the right edge of the first merges with one at the left edge of the
second while both exist. A merge never comes before those that made its parts, so
a piece exists from its own merge to the one that takes it up.

Every task holds the tables of the vocabulary, the trie of one Arrow batch and a
bounded number of known words; no shuffle, nothing in the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import small_batches, strings, tidy

# The letters, numbers and white space below U+0250, and over them the split pattern of byte-level BPE (the
# letters first, which changes nothing: no two alternatives before the white space begin alike).
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_PIECES = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
#: Known words a task keeps; beyond, only those of its last batch stay.
KNOWN_WORDS = 500_000
#: Pairs of tokens a task remembers; beyond, it starts anew.
KNOWN_PAIRS = 1_000_000
# Beyond these letters the library splits the text itself.
_UNUSUAL = re.compile("[ɐ-\U0010ffff]")
_NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merges, and which two tokens may stand side by side.

    Raises ValueError for a tokenizer file that does not work this way.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("the tokenizer changes or splits texts in another way")
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("the tokenizer's model is not plain byte-pair encoding")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in what stands beside them")
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

        self.bytes_of = {i: raw(t) for t, i in model["vocab"].items()} | {i: raw(t) for t, i in self.special.items()}
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        if any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("a byte has no token")
        self.rank, self.parts = {}, {}
        born = {self.id_of[bytes([b])]: -1 for b in range(256)}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, both = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            if both in born or max(born.get(a, _NEVER), born.get(b, _NEVER)) >= r:
                raise ValueError("merges out of order")
            self.rank[a, b], self.parts[both], born[both] = r, (a, b), r
        self.born = born
        self.right_edge, self.left_edge = cache(lambda t: self._edge(t, 1)), cache(lambda t: self._edge(t, 0))
        self.whole = cache(self._whole)
        # longer tokens that an encoding can hold, and by their last three bytes the lengths of those that can end there, long ones first
        self.usable = {t: i for t, i in self.id_of.items() if i in self.parts and self.whole(i)}
        ends: dict[bytes, set[int]] = {}
        for t in self.usable:
            if len(t) > 2:
                ends.setdefault(t[-3:], {2}).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.one = [self.id_of[bytes([b])] for b in range(256)]
        self.size = {i: len(t) for t, i in self.id_of.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token and the rank of the merge that takes each up; first the token itself."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = self.born[token], self.parts[token][side]

    def apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge before rank ``until`` joins a piece of ``a`` with one of ``b``.

        Of merges of one rank the left one comes first: that inside ``a`` before the one across, that before the one inside ``b``.
        """
        for x, x_ends in self.right_edge(a):
            for y, y_ends in self.left_edge(b):
                r = self.rank.get((x, y))
                if r is not None and r < min(x_ends, until) and r <= y_ends:
                    return False
        return True

    def _whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as the token."""
        if token not in self.parts:
            return token in self.born
        a, b = self.parts[token]
        return self.whole(a) and self.whole(b) and self.apart(a, b, self.born[token])


class Trie:
    """A path-compressed trie of words over bytes, its branches in depth-first order.

    A branch is (depth where it leaves the branches before, the word whose bytes from there on it spells).
    """

    def __init__(self, words: Iterable[bytes]):
        self.branches = []
        before = b""
        for word in sorted(words):  # in this order a word's branch follows the subtree that it leaves
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            self.branches.append((shared, word))
            before = word


class Encoder:
    """Ids of texts; keeps what it learned about words and pairs of tokens, within bounds."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.vocabulary, self.known_words = Vocabulary(path), known_words
        self.split_by_library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def words(self, text: str) -> list[str]:
        """The text's pieces in order; special tokens stand for themselves."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.split_by_library(text)]
        return _PIECES(text)

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words by one depth-first pass over their trie."""
        v, pairs, known = self.vocabulary, self.pairs, self.known
        id_of, lengths, size, one = v.usable, v.lengths, v.size, v.one
        two = [2]
        last = [0]  # by depth: the states on the way to the node
        for shared, word in Trie(w.encode() for w in words).branches:
            del last[shared + 1:]
            for d in range(shared + 1, len(word) + 1):
                for n in lengths.get(word[d - 3:d], two) if d > 2 else two:
                    if n > d:
                        continue
                    token = id_of.get(word[d - n:d])
                    if token is None:
                        continue
                    if n < d:
                        key = last[d - n] << 32 | token
                        fits = pairs.get(key)
                        if fits is None:
                            fits = pairs[key] = v.apart(last[d - n], token)
                        if not fits:
                            continue
                    last.append(token)
                    break
                else:  # no longer token ends here: the byte alone
                    last.append(one[word[d - 1]])
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            known[word.decode()] = tuple(reversed(ids))
        if len(pairs) > KNOWN_PAIRS:
            pairs.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        split = [self.words(t) for t in texts]
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > self.known_words:
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        for content, i in self.vocabulary.special.items():
            self.known[content] = (i,)
        self.learn(w for w in distinct if w not in self.known)
        parts = [[*map(self.known.__getitem__, words)] for words in split]
        counts = np.array([sum(map(len, p)) for p in parts], np.int64)
        return np.fromiter(chain.from_iterable(chain.from_iterable(parts)), np.int32, int(counts.sum())), counts


@cache
def _encoder(path: str) -> Encoder:
    """One encoder per worker process: its tables take a second to build, and its known words serve the next task."""
    return Encoder(path)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of every row's whole ``text``, without special tokens around it.

    Null and empty texts have no ids. Null and equal doc_ids are kept as they are,
    one row per row of ``docs``; other columns, also one named ``ids``, are ignored.
    The string of a special token in a text is that token. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for b in batches:
            ids, counts = encoder.encode([t.decode() for t in strings(b, "text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), _lists(ids, counts)], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, ids array<int>")


def _texts(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of a string column from the bytes of all rows and where each begins; what is no UTF-8 is replaced."""
    heads = raw[bounds[:-1][bounds[:-1] < bounds[1:]]]
    data = raw.tobytes()
    try:
        data.decode()
        whole = not ((heads & 0xC0) == 0x80).any()  # no character goes on from one row to the next
    except UnicodeDecodeError:
        whole = False
    if whole:
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ``ids`` and ``decoded`` (string) of rows of ids; special tokens are kept, unknown ids give nothing.

    Null or no ids: empty text. Bytes that are no UTF-8 become U+FFFD. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _encoder(tokenizer_path).vocabulary.bytes_of
        most = max(known) + 1
        pieces = [known.get(i, b"") for i in range(most + 1)]  # the last one stands for unknown ids
        size = np.array([len(x) for x in pieces], np.int32)
        start, table = (np.cumsum(size) - size).astype(np.int32), np.frombuffer(b"".join(pieces), np.uint8)
        for b in batches:
            col = b.column("ids")
            ids = col.flatten().fill_null(-1).to_numpy()
            ids = np.where((ids < 0) | (ids > most), most, ids)
            tokens = np.r_[0, np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy())]
            n = size[ids]
            ends = np.r_[0, np.cumsum(n, dtype=np.int64)]
            place = np.repeat(start[ids] - ends[:-1], n)
            place += np.arange(len(place))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), col, _texts(table[place], ends[tokens])], names=["doc_id", "ids", "decoded"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, ids array<int>, decoded string")
