"""Substring dedup by seed and extend, on words.

Seeds are winnowed: of every ``window - gram + 1`` consecutive word grams the one with the
smallest hash. Seeds that occur once are dropped. No match is extended word by word: the
hashes of whole ``window``-word windows around the other seeds (the stretch that a seed rules)
are grouped in ``repeats``, and windows that stand elsewhere too are kept as repeats. Overlapping repeats of a document make one
maximal span. See ``repeats`` for how copies are folded and why no group is paired up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm import repeats
from tabvet.llm.common import in_shared_folder

WINDOW, GRAM = 35, 8


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text, spans of repeated words (flat start, end pairs) of every row. Null text: empty, no spans."""
    runs = in_shared_folder(repeats.runs_of(docs, repeats.word_tokens, window, min(gram, window)), "word-runs")
    seeds = in_shared_folder(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "seeds")
    matching = in_shared_folder(runs.join(seeds, "key", "left_semi"), "word-matches")
    return repeats.covered(docs, repeats.repeated(docs, matching, repeats.word_tokens, window), window)


def without_repeats(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = text.encode().split()  # bytes split at the same six characters
                stay, at = [], 0
                for start, end in np.array(runs or [], np.int64).reshape(-1, 2).tolist():
                    stay += w[at:start]
                    at = end
                stay += w[at:]
                n.append(len(w))
                removed.append(len(w) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept])],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return spans.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
