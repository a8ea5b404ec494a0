"""Runs of words that repeat with a period, found in the enhanced suffix array of each document.

The suffix array (by prefix doubling, all documents of a batch at once), its inverse
ISA and the LCP array of a document are flat arrays; the LCP intervals come off a
stack in one scan, no tree is built. In an interval of depth d, suffixes of two
different children share exactly d words. Hence, for the suffixes i of all children
but the largest, ISA[i + d] or ISA[i - d] inside the interval and outside the child
of i says that a square of period d starts at i, or at i - d, which no longer
continues: a branching square. Rotating it to the left while the words agree gives
the maximal run that ends with it. A square whose period is a multiple of that of a
known run with the same end is part of that run.

Only runs of at least ``least`` words and ``powers`` (2 or more) periods are kept. The suffixes at such a
run's first two periods share its length less one period, so a document without a
repeated stretch of that many words, and an interval without such a pair inside, is
passed over: no run is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import small_batches, strings, tidy

LEAST, POWERS = 6, 4
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Numbers(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def least_shared(period: int, least: int = LEAST, powers: int = POWERS) -> int:
    """How many words the suffixes at the first two periods of a kept run share at least."""
    return max(least, powers * period) - period


def repeating(ids: np.ndarray, doc: np.ndarray, words: int) -> np.ndarray:
    """Numbers of the documents in which some ``words`` consecutive words stand twice (judged on 64-bit hashes: none is missed)."""
    n = len(ids) - words + 1
    if n < 2:
        return np.zeros(0, doc.dtype)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams = (grams + ids[k:n + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[words - 1:])
    grams = (grams[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(grams, kind="stable")
    return np.unique(doc[inside][order[1:]][grams[order[1:]] == grams[order[:-1]]])


def suffix_arrays(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and inverse of all documents one after another; ``doc`` ascends and no comparison leaves a document.

    Prefix doubling: ranks by the first h words, refined by the rank h words on, for suffixes that still tie.
    """
    n = len(ids)
    ends = np.searchsorted(doc, doc, "right")  # where each one's document ends
    order = np.lexsort((ids, doc))
    opens = np.r_[True, (ids[order[1:]] != ids[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    sizes = np.diff(np.r_[np.flatnonzero(opens), n])
    tied = order[np.repeat(sizes > 1, sizes)]
    h = 1
    while len(tied):
        after = np.where(tied + h < ends[tied], rank[np.minimum(tied + h, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = rank[tied]
        at = np.arange(len(tied))
        old = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
        opens = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = group + np.maximum.accumulate(np.where(opens, at, 0)) - old
        sizes = np.diff(np.r_[np.flatnonzero(opens), len(tied)])
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, rank


def lcp_array(s: list[int], sa: list[int], isa: list[int]) -> list[int]:
    """lcp[k]: words that the suffixes sa[k - 1] and sa[k] share; lcp[0] = 0."""
    n, shared = len(s), 0
    lcp = [0] * n
    for i in range(n):
        k = isa[i]
        if not k:
            shared = 0
            continue
        j = sa[k - 1]
        most = n - max(i, j)
        while shared < most and s[i + shared] == s[j + shared]:
            shared += 1
        lcp[k] = shared
        if shared:
            shared -= 1
    return lcp


def branching_squares(sa: list[int], isa: list[int], lcp: list[int], least: int = LEAST, powers: int = POWERS) -> set[tuple[int, int]]:
    """(period, start) of the squares that don't go on to the right, of periods that a kept run can have."""
    n, found = len(sa), set()
    stack = [[0, 0, [], 0]]  # depth, first place, where its further children begin, deepest lcp inside
    for k in range(1, n + 1):
        depth, first, deepest = lcp[k] if k < n else -1, k - 1, 0
        while stack and depth < stack[-1][0]:
            d, first, cuts, deepest_here = stack.pop()
            deepest = max(deepest, deepest_here)
            if d and deepest >= least_shared(d, least, powers):
                bounds = [first, *cuts, k]
                widest = max(range(len(bounds) - 1), key=lambda c: bounds[c + 1] - bounds[c])
                for c in range(len(bounds) - 1):
                    if c != widest:
                        low, high = bounds[c], bounds[c + 1]
                        for i in sa[low:high]:
                            if i + d < n and first <= (p := isa[i + d]) < k and not low <= p < high:
                                found.add((d, i))
                            if i >= d and first <= (p := isa[i - d]) < k and not low <= p < high:
                                found.add((d, i - d))
        if not stack or depth < 0:
            break
        if depth == stack[-1][0]:
            stack[-1][2].append(k)
            stack[-1][3] = max(stack[-1][3], deepest, depth)
        else:
            stack.append([depth, first, [k], max(deepest, depth)])
    return found


def runs_of(s: list[int], squares: set[tuple[int, int]], least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the kept runs by start, then period: squares rotated to the left and merged by their ends."""
    by_end: dict[int, list[tuple[int, int]]] = {}
    out = []
    for d, i in sorted(squares):
        end = i + 2 * d
        start = end - powers * d
        if start < 0 or any(d % q == 0 and first <= i for q, first in by_end.get(end, ())):
            continue
        if s[start:end - d] != s[start + d:end]:
            continue
        while start and s[start - 1] == s[start - 1 + d]:
            start -= 1
        by_end.setdefault(end, []).append((d, start))
        if end - start >= least:
            out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_in(documents: list[list[bytes]], least: int = LEAST, powers: int = POWERS) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of the documents that have some, by the document's place in the list."""
    if powers < 2 or least < 2:
        raise ValueError("a run has two periods at least")
    numbers = _Numbers()
    counts = np.array([len(w) for w in documents], np.int64)
    ids = np.fromiter((numbers[x] for w in documents for x in w), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(documents)), counts)
    shortest = min(least_shared(q, least, powers) for q in range(1, least + 1))
    some = repeating(ids, doc, shortest)
    inside = np.isin(doc, some)
    ids, doc = ids[inside], doc[inside]
    if not len(ids):
        return {}
    sa, isa = suffix_arrays(ids, doc)
    out = {}
    for d in some.tolist():
        low, high = np.searchsorted(doc, [d, d + 1]).tolist()
        s = ids[low:high].tolist()
        own, inverse = (sa[low:high] - low).tolist(), (isa[low:high] - low).tolist()
        found = runs_of(s, branching_squares(own, inverse, lcp_array(s, own, inverse), least, powers), least, powers)
        if found:
            out[d] = found
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()] if runs else words


def periodic_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period in words, by start, then period) and ``collapsed`` of every row's whole ``text``.

    Words are what stands between ASCII white space. A run has a smallest period q,
    at least ``least`` words and ``powers`` times q, and no neighbouring word
    continues it. ``collapsed`` joins, by one space, the words that no run contains
    after its first q. Null and empty texts: no words, no runs, empty. Null and
    equal doc_ids are kept as they are, one row per row; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        for b in batches:
            documents = [t.split() for t in strings(b, "text")]
            found = runs_in(documents, least, powers)
            lists = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(k, ())] for k in range(len(documents))]
            rest = [b" ".join(collapsed(w, found.get(k, []))).decode() for k, w in enumerate(documents)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(w) for w in documents], pa.int64()), pa.array(lists, kind), pa.array(rest, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id bigint, n_words bigint, runs {RUN}, collapsed string")


def with_period(docs: DataFrame) -> DataFrame:
    """doc_id and ``text``, the text of one document in ten made periodic from some word on.

    h = crc32 of doc_id in decimal, g = floor(h / 10); where h is a multiple of 10, word i >= a of the n words becomes
    word a + (i - a) mod p with a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)). Null doc_ids and texts stay.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("_w", words).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.expr("(_n - _a) div (3 + _g % 8)")).cast("int"))
    again = F.expr("slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast((_n - _a + _p - 1) div _p as int))), 1, _n - _a)")
    changed = F.array_join(F.concat(F.expr("slice(_w, 1, _a)"), again), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
