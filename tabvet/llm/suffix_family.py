"""Suffix-array dedup with a logarithmic index family, on bytes.

The corpus comes in batches. A batch's array holds the distinct 64-bit hashes of the first
``gram`` bytes of its anchor suffixes (chosen by content, about two in ``length - gram``
bytes), sorted by hash: no positions of suffixes, no text order. A new batch is
intersected with every level of the index for equal beginnings, then becomes a
level of size one; while two levels have equal sizes they are merged into one of twice
the size. Each entry is therefore rewritten about log2(batches) times, and there are never
more than log2(batches) + 1 levels to scan. Levels keep one entry per beginning, so a
passage in a third of all documents is one entry.

So the family only prefilters keys, as one count per key would. The matches are found in
``repeats`` by grouping hashes of whole ``length``-byte windows: a byte goes if a
``length``-byte string that covers it also starts anywhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm import repeats
from tabvet.llm.common import in_shared_folder, shuffle_partitions

LENGTH, GRAM, BATCHES = 400, 100, 4


class SuffixFamily:
    """Levels of sorted suffix arrays, cut into ``buckets`` by key: rows (bucket, size, keys), size in batches."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: DataFrame | None = None

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Take in a batch (``key`` per suffix); the keys it has in common with a level, or twice itself."""
        buckets = self.buckets

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def flush() -> Iterator[pa.RecordBatch]:
                keys, times = np.unique(np.concatenate(held), return_counts=True)
                for size, part in ((0, keys), (FOUND, keys[times > 1])):
                    of = (part % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(of, kind="stable")
                    cut = np.searchsorted(of[order], np.arange(buckets + 1))
                    full = np.flatnonzero(np.diff(cut))
                    yield _level_rows(full.tolist(), [size] * len(full), [part[order[cut[k]:cut[k + 1]]] for k in full])

            for b in batches:
                held.append(b.column(0).to_numpy().view(np.uint64))
                if sum(map(len, held)) >= 1 << 20:
                    yield from flush()
                    held = []
            if held:
                yield from flush()

        def merge_scan(group: pa.Table) -> pa.Table:
            parts: dict[int, list[np.ndarray]] = {}
            for size, keys in zip(group.column("size").to_pylist(), group.column("keys").to_pylist(), strict=True):
                parts.setdefault(size, []).append(np.frombuffer(keys, np.uint64))
            array, times = np.unique(np.concatenate(parts.pop(0, [np.zeros(0, np.uint64)])), return_counts=True)
            found = [array[times > 1], *parts.pop(FOUND, [])]
            found += [np.intersect1d(array, level[0], assume_unique=True) for level in parts.values()]
            size, out = 1, {k: v[0] for k, v in parts.items()}
            while size in out:
                array, size = np.union1d(array, out.pop(size)), 2 * size
            out = {FOUND: np.unique(np.concatenate(found)), size: array} | out
            return pa.Table.from_batches([_level_rows([group.column("bucket")[0].as_py()] * len(out), list(out), list(out.values()))])

        schema = "bucket int, size int, keys binary"
        rows = suffixes.select("key").mapInArrow(arrays, schema)
        rows = rows if self.levels is None else rows.unionByName(self.levels)
        state = in_shared_folder(rows.groupBy("bucket").applyInArrow(merge_scan, schema), "suffix-levels")
        self.levels = state.where(F.col("size") > 0)

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for keys in b.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64))], names=["key"])

        return state.where(F.col("size") == FOUND).select("keys").mapInArrow(listed, "key bigint")


#: In place of a level's size: keys found more than once.
FOUND = -1


def _level_rows(bucket: list[int], size: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(size, pa.int32()),
                                       pa.array([k.tobytes() for k in keys], pa.binary())], names=["bucket", "size", "keys"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, text, spans of repeated bytes (flat start, end pairs) of every row. Null text: empty, no spans."""
    spark = docs.sparkSession
    runs = in_shared_folder(repeats.runs_of(docs, repeats.byte_tokens, length, min(gram, length))
                            .withColumn("batch", F.pmod("row", F.lit(batches)).cast("int")), "byte-runs", partition_by="batch")
    family, found = SuffixFamily(spark, 4 * shuffle_partitions(spark)), None
    for k in range(batches):
        keys = family.add(runs.where(F.col("batch") == k))
        found = keys if found is None else found.unionByName(keys)
    matching = in_shared_folder(runs.drop("batch").join(found, "key", "left_semi"), "byte-matches")
    return repeats.covered(docs, repeats.repeated(docs, matching, repeats.byte_tokens, length), length)


def without_repeats(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay, joined)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for b in batches:
            n, removed, kept, count = [], [], [], []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, stay, at = text.encode(), [], 0
                pairs = np.array(runs or [], np.int64).reshape(-1, 2).tolist()
                for start, end in pairs:
                    stay.append(raw[at:start])
                    at = end
                kept.append(b"".join([*stay, raw[at:]]))
                n.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                count.append(len(pairs))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], names=names)

    return spans.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
