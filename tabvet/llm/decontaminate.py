"""Benchmark decontamination with a distributed positional inverted index.

Index: documents are cut into shards of about ``shard_words`` words. Each shard
keeps one posting list per term, the ascending positions of the term in the
shard's word stream (one position is left free between documents, so no phrase
crosses them), plus the document keys and starts. Only terms that some test item
uses are posted. The lists are rows (shard, term, data) of a Parquet table.

Search: a phrase starts from its rarest term's list in the shard, each position
less the term's offset in the phrase, and is intersected with the next rarest
term's list in the same way until it is empty or complete. What is left are the
exact phrase starts. ``proximity`` relaxes this to terms in order within a span.

Phrases and terms go to the tasks in blocks of ``BLOCK_PHRASES``, so broadcasts are
bounded whatever the size of the benchmark. Shards are grouped by their own id,
and no list of all documents of a term, passage or item ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.llm.common import in_shared_folder, strings, tidy

WINDOW_WORDS = 13
SHARD_WORDS = 200_000
BLOCK_PHRASES = 200_000

# ASCII upper case to lower case, other ASCII that isn't a letter or digit to a space; bytes from 0x80 on stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
_KEYS, _STARTS = -1, -2


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_phrases(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Distinct phrases of the items' windows: terms (array of binary), item_ids (of all items that have it).

    An item of fewer words than a window, but not none, is one phrase. Items without
    words have none. A null item_id marks words but isn't listed.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, phrases = [], []
            for item, text in zip(b.column("item_id").to_pylist(), strings(b, "text"), strict=True):
                w = words(text)
                own = {tuple(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                ids += [item] * len(own)
                phrases += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(phrases, pa.list_(pa.binary()))],
                                             names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(cut, "item_id bigint, terms array<binary>")
    return rows.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def build_index(docs: DataFrame, terms: list[bytes], shard_words: int = SHARD_WORDS) -> DataFrame:
    """Posting lists of ``terms`` over the whole texts: the written table (shard, term, data).

    ``term`` is the term's place in the list; -1 and -2 hold the shard's document keys
    (the rows' doc_id, null mask last) and their starts with the end of the last.
    """
    numbers = {t: i for i, t in enumerate(terms)}
    narrow = np.uint16 if len(terms) < 65535 else np.uint32  # a radix sort where it fits
    absent = np.iinfo(narrow).max

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        keys, starts, ids = [], [0], []
        get = numbers.get

        def flush() -> pa.RecordBatch:
            stream = np.array(ids, narrow)
            order = np.argsort(stream, kind="stable")
            sorted_ids = stream[order]
            order = order[:np.searchsorted(sorted_ids, absent)].astype("<i4")
            found, first = np.unique(sorted_ids[:len(order)], return_index=True)
            lists = [order[a:z].tobytes() for a, z in zip(first, [*first[1:], len(order)][:len(first)], strict=True)]
            key = np.array([0 if k is None else k for k in keys], "<i8").tobytes() + bytes(k is None for k in keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard] * (len(found) + 2), pa.int64()), pa.array([_KEYS, _STARTS, *found.tolist()], pa.int32()),
                 pa.array([key, np.array(starts, "<i8").tobytes(), *lists], pa.binary())], names=["shard", "term", "data"])

        for b in batches:
            for key, text in zip(b.column("doc_id").to_pylist(), strings(b, "text"), strict=True):
                ids += [get(w, absent) for w in words(text)]
                ids.append(absent)
                keys.append(key)
                starts.append(len(ids))
                if len(ids) >= shard_words:
                    yield flush()
                    shard, keys, starts, ids = shard + 1, [], [0], []
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return in_shared_folder(rows.mapInArrow(tidy(post), "shard bigint, term int, data binary"), "postings")


def _shard(group: pa.Table) -> tuple[dict[int, np.ndarray], list[int | None], np.ndarray]:
    lists = dict(zip(group.column("term").to_pylist(), group.column("data").to_pylist(), strict=True))
    starts = np.frombuffer(lists.pop(_STARTS), "<i8")
    raw, n = lists.pop(_KEYS), len(starts) - 1
    keys = [None if null else int(k) for k, null in zip(np.frombuffer(raw, "<i8", n), raw[8 * n:], strict=True)]
    return {t: np.frombuffer(d, "<i4") for t, d in lists.items()}, keys, starts


def phrase_starts(lists: dict[int, np.ndarray], phrase: list[int]) -> np.ndarray:
    """Positions where the phrase stands: offset-adjusted lists intersected from the rarest term on."""
    if not all(t in lists for t in phrase):
        return np.zeros(0, np.int64)
    by_rarity = sorted(range(len(phrase)), key=lambda i: len(lists[phrase[i]]))
    at = lists[phrase[by_rarity[0]]].astype(np.int64) - by_rarity[0]
    for i in by_rarity[1:]:
        if not len(at):
            break
        other = lists[phrase[i]]
        place = np.searchsorted(other, at + i)
        at = at[(place < len(other)) & (other[np.minimum(place, len(other) - 1)] == at + i)]
    return at


def proximity_spans(lists: dict[int, np.ndarray], phrase: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the shortest spans from each first term that hold the terms in order with at
    most ``slop`` words between them in all."""
    if not all(t in lists for t in phrase):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = lists[phrase[0]].astype(np.int64)
    last = first
    for t in phrase[1:]:
        place = np.searchsorted(lists[t], last, side="right")
        fits = place < len(lists[t])
        first, last = first[fits], lists[t][place[fits]].astype(np.int64)
    near = last + 1 - first <= len(phrase) + slop
    return first[near], last[near] + 1


def search(index: DataFrame, phrases: list[tuple[list[int], list[int]]], slop: int | None = None) -> DataFrame:
    """One row per document: shard, place (in the shard), doc_id, n_words, runs (flat start, end pairs of hit words),
    item_ids (sorted). ``phrases``: term numbers and item ids. ``slop``: proximity instead of exact phrases."""

    def find(group: pa.Table) -> pa.Table:
        lists, keys, starts = _shard(group)
        n, hit = int(starts[-1]), np.zeros(int(starts[-1]) + 1, np.int32)
        owners: list[set[int]] = [set() for _ in keys]
        for terms, items in phrases:
            if slop is None:
                at = phrase_starts(lists, terms)
                end = at + len(terms)
            else:
                at, end = proximity_spans(lists, terms, slop)
            doc = np.searchsorted(starts, at, side="right") - 1
            if slop is not None:
                inside = end < starts[doc + 1]  # the free position between documents belongs to none
                at, end, doc = at[inside], end[inside], doc[inside]
            if len(at):
                np.add.at(hit, at, 1)
                np.add.at(hit, end, -1)
                for d in np.unique(doc).tolist():
                    owners[d].update(items)
        edges = np.diff(np.concatenate([[0], (np.cumsum(hit[:n]) > 0).astype(np.int8), [0]]))
        runs = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)
        of = np.searchsorted(starts, runs[:, 0], side="right") - 1
        runs = runs - starts[of][:, None]
        cut = np.searchsorted(of, np.arange(len(keys) + 1))
        shard = group.column("shard")[0].as_py()
        return pa.table({
            "shard": pa.array([shard] * len(keys), pa.int64()), "place": pa.array(range(len(keys)), pa.int32()),
            "doc_id": pa.array(keys, pa.int64()), "n_words": pa.array(np.diff(starts) - 1),
            "runs": pa.ListArray.from_arrays(pa.array(2 * cut, pa.int32()), pa.array(runs.reshape(-1), pa.int64())),
            "item_ids": pa.array([sorted(x) for x in owners], pa.list_(pa.int64()))})

    schema = "shard bigint, place int, doc_id bigint, n_words bigint, runs array<bigint>, item_ids array<bigint>"
    return index.groupBy("shard").applyInArrow(find, schema)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _merge_runs(runs: pd.Series) -> pd.Series:
    def merge(flat):
        pairs, out = np.array(flat, np.int64).reshape(-1, 2), []
        for a, z in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
            if out and a <= out[-1]:
                out[-1] = max(out[-1], z)
            else:
                out += [a, z]
        return out

    return runs.map(merge)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS,
                  block_phrases: int = BLOCK_PHRASES, slop: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, runs, item_ids.

    ``runs`` are the hit words, start and end in words. Null text has no words. With
    no item that has words, nothing is hit. Repeated rows are judged each on their own.
    """
    phrases = in_shared_folder(item_phrases(items, window), "phrases")
    blocks = max(1, -(-phrases.count() // block_phrases))
    found = None
    for k in range(blocks):
        block = phrases.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == k).collect()  # about block_phrases rows
        terms = sorted({t for r in block for t in map(bytes, r.terms)})
        number = {t: i for i, t in enumerate(terms)}
        listed = [([number[bytes(t)] for t in r.terms], list(r.item_ids)) for r in block]
        part = search(build_index(docs, terms, shard_words), listed, slop)
        found = part if found is None else found.union(part)
    if blocks > 1:  # the shards are cut alike for every block, so (shard, place) names a row of docs
        found = found.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            _merge_runs(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    # Folding start, end, start, end, ... by "next less sum so far" leaves the summed lengths.
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda total, x: x - total)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "runs", "item_ids")


def judged(found: DataFrame) -> DataFrame:
    """The contract's digest columns: contaminated where the hit words are at least a twentieth of the words."""
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
