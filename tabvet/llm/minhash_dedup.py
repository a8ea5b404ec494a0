"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Two permutations of the universe of 2^32 shingle values make all coordinates: the first
scatters the shingles, the second is applied circularly shifted, by k places for
coordinate k, and the minimum is taken. ``rows`` consecutive coordinates hash to a band
key; with 50 bands of 5 a pair at Jaccard 0.75 shares no band once in 770,000 times.

Documents with equal sets are folded into one set first. In each bucket all sets are
compared with its smallest (a star, never all pairs), and the links become components.
In almost all buckets every set is then in one component and nothing is left to find. In
the others the sets of different components are compared inside tasks, block by block, and
only links leave them. Every link is confirmed on the full sets (64-bit hashes of the
shingles).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder, tidy
from tabvet.llm.components import components
from tabvet.llm.order_minhash import mix64
from tabvet.llm.repeats import CHUNK, Hashes, text_bytes, word_tokens

SHINGLE_WORDS, PERCENT, BANDS, ROWS = 5, 75, 50, 5
#: Document ids that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets of one bucket that are compared with one another in one task.
BLOCK_SETS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Multipliers of two published 32-bit mixers (MurmurHash3's finaliser; "lowbias32"), each a permutation of 2^32 values.
_SCATTER, _SHIFTED = (16, 0x85EBCA6B, 13, 0xC2B2AE35, 16), (16, 0x7FEB352D, 15, 0x846CA68B, 16)


def _permute(x: np.ndarray, by: tuple[int, ...], scratch: np.ndarray) -> np.ndarray:
    """In place."""
    for shift, times in zip(by[::2], [*by[1::2], None], strict=True):
        np.right_shift(x, np.uint32(shift), out=scratch)
        np.bitwise_xor(x, scratch, out=x)
        if times:
            np.multiply(x, np.uint32(times), out=x)
    return x


def signatures(shingles: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each non-empty set; ``starts``: where the sets start in the 64-bit ``shingles``."""
    scratch, shifted = np.empty(len(shingles), np.uint32), np.empty(len(shingles), np.uint32)
    scattered = _permute((shingles >> np.uint64(32)).astype(np.uint32), _SCATTER, scratch)
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        np.subtract(scattered, np.uint32(k), out=shifted)
        out[:, k] = np.minimum.reduceat(_permute(shifted, _SHIFTED, scratch), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for i in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, i:bands * rows:rows].astype(np.uint64))
    return keys


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``words``-word shingles; fewer words are one shingle, none give an empty set."""
    tokens, first = word_tokens(_LOWER[data], starts)
    hashes, out = Hashes(tokens), []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        at = np.arange(a, max(z - words + 1, min(a + 1, z)))
        out.append(np.unique(hashes.of(at, np.minimum(at + words, z))))
    return out


def _set_parts(column: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    data, starts = text_bytes(column)
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK, side="right")) - 1)
        yield shingle_sets(data[starts[at]:starts[to]], starts[at:to + 1] - starts[at], words)
        at = to


def signed(docs: DataFrame, words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits that know the set), bands (keys; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in _set_parts(b.column(1), words):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                a, z, keys = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((0, bands), np.uint64)
                if len(full):
                    shingles, starts = np.concatenate([sets[i] for i in full]), np.cumsum(n[full]) - n[full]
                    a[full], z[full] = np.add.reduceat(shingles, starts), np.add.reduceat(mix64(shingles), starts)
                    keys = band_keys(signatures(shingles, starts, bands * rows), bands, rows)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(n)), pa.array(n), pa.array(a.view(np.int64)), pa.array(z.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])
                at += len(n)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """node, shingles (array) of the documents whose id is in ``nodes`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in _set_parts(b.column(1), words):
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                                 names=["node", "shingles"])
                at += len(sets)

    ids = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ids, "node", "left_semi").mapInArrow(tidy(run), "node bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` per cent of their union in common."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _links_between(shingles: np.ndarray, sizes: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the linked pairs of different components among the sets of one block, from a blockwise co-occurrence product."""
    m = len(sizes)
    _, number, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    column = (np.cumsum(times > 1) - 1)[number][shared]
    of, common, width = np.repeat(np.arange(m), sizes)[shared], np.zeros((m, m), np.float32), max(64, (1 << 22) // m)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, (low, low + width))
        has = np.zeros((m, min(width, int(column[-1]) + 1 - low)), np.float32)
        has[of[a:z], column[a:z] - low] = 1
        common += has @ has.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    return np.nonzero(np.triu(linked & (component[:, None] != component[None, :]), 1))


def _linked_across(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between different components of a bucket: members (band, size, node, component).

    A bucket of more than ``block`` sets is cut into blocks, and each two blocks meet in a task
    of their own. Sets are compared inside the task; only links come out.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = members.select("band", "node", "component", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    keyed = spread.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node", "component")

    def judge(rows: pa.Table) -> pa.RecordBatch:
        key, node, component = (rows.column(n).to_numpy() for n in ("key", "node", "component"))
        lists = rows.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets)
        ends, cut = ends - ends[0], np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, j = _links_between(flat[ends[low]:ends[high]], np.diff(ends[low:high + 1]), component[low:high], percent)
            a.append(node[low + i])
            b.append(node[low + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            key = now.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield judge(now.slice(0, last).combine_chunks())
            held = now.slice(last)
        if held is not None and held.num_rows:
            yield judge(held.combine_chunks())

    return (keyed.join(sets, "node").repartition("key").sortWithinPartitions("key").select("key", "node", "component", "shingles")
            .mapInArrow(tidy(run), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    block: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is its own) of every row.

    Null text and texts without words: empty sets, alone. A null doc_id takes no part: component_id null, kept.
    Rows with equal doc_ids count as one document in links; equal rows get equal results.
    """
    rows_ = in_shared_folder(signed(docs, words, bands, rows), "signed")
    identity = ["n_shingles", "set_a", "set_b"]
    whole = rows_.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = in_shared_folder(whole.groupBy(*identity).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "sets")

    members = sets.select("node", F.explode("bands").alias("band"))
    buckets = in_shared_folder(members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = in_shared_folder(members.join(buckets, "band").select("band", "hub", "size", "node"), "members")
    pairs = in_shared_folder(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    texts = in_shared_folder(full_sets(docs, members.select("node").distinct(), words), "shingles")
    links = in_shared_folder(verified(pairs, texts, percent), "verified")
    component = in_shared_folder(components(links), "components")

    # A bucket of two is done with its one pair; in the others, sets of different components may still be linked.
    placed = members.where("size > 2").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = (placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("size"),
                                        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
             .where("low <> high"))
    # Buckets of the same sets, made by other bands, are compared once.
    open_ = in_shared_folder(open_.groupBy("who", "size").agg(F.min("band").alias("band")).select("band"), "open")
    rest = placed.join(open_, "band", "left_semi").select("band", "size", "node", "component")
    more = in_shared_folder(_linked_across(rest, texts, percent, block), "more")
    if not more.isEmpty():
        component = in_shared_folder(components(links.unionByName(more)), "components")

    of_set = sets.select(*identity, "node").join(component, "node", "left").select(*identity, F.coalesce("component", "node").alias("component_id"))
    empty = F.col("n_shingles") == 0
    return (rows_.select("doc_id", *identity).join(in_shared_folder(of_set, "set-components"), identity, "left")
            .select("doc_id", "n_shingles", F.when(empty | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))))
