"""Whitening of embeddings by their leading principal components, found by Chebyshev-filtered subspace iteration.

The vectors are fixed-point integers, so their number and their sums are exact. They are
written once as blocks of a Parquet table in the shared folder. The covariance V is
never formed: each step needs V Q for a block Q of k + guard vectors, one pass over
the table in which every task centres its vectors, adds up Xc' (Xc Q) and gives one
d x b matrix; sums of these matrices are taken by some tasks, then by the driver, in
the order of the partitions. On the driver stand matrices of d rows and b columns.

One round applies a Chebyshev polynomial of V by its three-term recurrence, which
stays small on the unwanted part of the spectrum, from a lower bound (of a few Lanczos
steps) to the smallest Ritz value of the block, and grows fast above it. Then come QR, one more pass and Rayleigh-Ritz. The
rounds end when the residuals |V q - e q| of all wanted vectors are at most ``tolerance`` times
the largest eigenvalue. Where some rounds don't get there (many eigenvalues nearly
equal at the end of the block) the block gets more vectors; with d of them it spans
everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder, small_batches, tidy

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, GUARD, DEGREE = 32, 16, 12
TOLERANCE = 1e-13
#: Largest growth of the polynomial over the wanted part, as an exponent of e.
RANGE = 18.0
#: Lanczos steps for the lower end of the spectrum.
STEPS = 10
#: Rounds before the block grows.
PATIENCE = 8
#: Eigenvalues below this share of the largest are rounding noise.
NOISE = 1e-11
#: Vectors of a block of the written table.
BLOCK_ROWS = 2048
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def fixed_point(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The usable vectors as rows (``vec_id``, ``x``: array<bigint>) and their dimension.

    Dropped: null vectors, those with null or non-finite entries, empty ones and, where lengths differ, all but the commonest length (of ties the longest).
    """
    entries = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    good = table.select(F.col(key).cast("bigint").alias("vec_id"), entries.alias("v")).where(F.col("v").isNotNull() & finite & (F.size("v") > 0))
    top = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top.d if top else 0
    x = F.transform("v", lambda e: F.floor(F.lit(float(SCALE)) * e) + F.lit(SHIFT))
    return good.where(F.size("v") == d).select("vec_id", x.alias("x")), d


def write_blocks(rows: DataFrame, d: int) -> DataFrame:
    """A written table of blocks: ``keys`` and the matrix ``x`` (int64, row by row). Nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            for at in range(0, len(x), BLOCK_ROWS):
                keys = b.column("vec_id")[at:at + BLOCK_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([x[at:at + BLOCK_ROWS].astype("<i8").tobytes()], pa.binary())],
                    names=["keys", "x"])

    return in_shared_folder(rows.mapInArrow(tidy(pack), "keys array<bigint>, x binary"), "whitening")


def _matrix(value: pa.BinaryScalar, d: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<i8").reshape(-1, d)


def summed(blocks: DataFrame, d: int, kind: str, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum of ``of(x)`` over the blocks, in the order of the partitions; None without blocks.

    Tasks give one array each, about the square root of their number adds them up, the driver adds those.
    """

    def add(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total, first = None, 0
        for part, x in parts:
            total, first = (x, part) if total is None else (total + x, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield from add((part, np.ascontiguousarray(of(_matrix(v, d)), kind).ravel()) for b in batches for v in b.column("x"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add((p, np.frombuffer(v.as_buffer(), kind)) for b in batches for p, v in zip(b.column("part").to_pylist(), b.column("total"), strict=True))

    schema = "part int, total binary"
    parts = blocks.select("x").mapInArrow(here, schema)
    fan = max(1, round(blocks.rdd.getNumPartitions() ** 0.5))
    rows = parts.repartition(fan, "part").sortWithinPartitions("part").mapInArrow(together, schema).collect()
    total = None
    for r in sorted(rows, key=lambda r: r.part):
        x = np.frombuffer(r.total, kind)
        total = x if total is None else total + x
    return total


def leading_eigenvectors(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, degree: int = DEGREE,
                         tolerance: float = TOLERANCE, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric non-negative V given by ``times(Q) = V Q``."""
    rng = np.random.default_rng(seed)
    k, size = min(k, d), min(d, k + guard)
    low = _lowest(times, rng.standard_normal(d), STEPS) if size < d else 0.0
    while True:
        q = np.eye(d) if size == d else np.linalg.qr(rng.standard_normal((d, size)))[0]
        for _ in range(PATIENCE):
            vq = times(q)
            small = q.T @ vq
            e, w = np.linalg.eigh((small + small.T) / 2)
            e, w = e[::-1], w[:, ::-1]
            q, vq = q @ w, vq @ w
            good = np.linalg.norm(vq - q * e, axis=0) <= tolerance * e[0]
            if size == d or good[:k].all():
                return e[:k], q[:, :k]
            done = int(np.argmin(good))  # the vectors up to here stay as they are
            q[:, done:] = _filtered(times, q[:, done:], vq[:, done:], q[:, :done], low, e[done], e[k - 1], max(e[-1], low + NOISE * e[0]), degree)
            q = np.linalg.qr(q)[0]
        size = min(d, 2 * size)


def _lowest(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> float:
    """A value at or somewhat below the smallest eigenvalue: the smallest of a Lanczos run less its residual, not below 0."""
    q, diagonal, beside = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        r = times(q[-1][:, None])[:, 0]
        diagonal.append(float(q[-1] @ r))
        for _ in range(2):
            basis = np.array(q)
            r = r - basis.T @ (basis @ r)
        beside.append(float(np.linalg.norm(r)))
        if beside[-1] <= NOISE * max(diagonal):
            break
        q.append(r / beside[-1])
    e, w = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, float(e[0] - beside[-1] * abs(w[-1, 0])))


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, done: np.ndarray, low: float, top: float, wanted: float,
              cut: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V for [low, cut], scaled to 1 at ``top``, applied to q (vq = V q is known), orthogonal to ``done``.

    Its degree is at most ``degree``, and so low that it grows between ``wanted`` and ``top`` by no more than RANGE: beyond, the smaller wanted parts would be lost in rounding.
    """
    half, middle = (cut - low) / 2, (cut + low) / 2
    spread = float(np.diff(np.arccosh(np.maximum((np.array([wanted, top]) - middle) / half, 1)))[0])
    degree = max(2, int(min(degree, RANGE / max(spread, 1e-9))))

    def beside(x: np.ndarray) -> np.ndarray:
        return x - done @ (done.T @ x)

    sigma = first = half / (top - middle)
    before, now = q, beside(vq - middle * q) * (sigma / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - sigma)
        before, now = now, beside((times(now) - middle * now) * (2 * following / half) - sigma * following * before)
        sigma = following
    return now / np.linalg.norm(now, axis=0)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, guard: int = GUARD) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    See ``fixed_point`` for what is usable; x are its integers, n their number, S their sums.
    deviation: sum of (n x - S)^2, exact; whitened: x - S/n along the component over the root of its eigenvalue e;
    explained: e over the trace; identity_error: largest absolute entry of whitened's covariance minus the identity.
    Components without variance (e at most 1e-11 of the largest) can't be whitened and are left out, so a
    table without usable vectors or with equal ones only gives no rows. A component's largest entry is
    positive. Null and equal keys stay as they are; other columns are ignored. A deviation
    beyond a long raises OverflowError.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows, d = fixed_point(table, key, vector)
    if not d:
        return spark.createDataFrame([], OUT)
    blocks = write_blocks(rows, d)
    moments = summed(blocks, d, "<i8", lambda x: np.append(x.sum(axis=0), len(x)))
    n, sums = int(moments[-1]), moments[:-1]
    whole, rest = sums // n, (sums % n) / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest

    def times(q: np.ndarray) -> np.ndarray:
        return summed(blocks, d, "<f8", lambda x: (c := centred(x)).T @ (c @ q)).reshape(q.shape) / n

    trace = float(summed(blocks, d, "<f8", lambda x: (centred(x) ** 2).sum(axis=0)).sum()) / n
    if not trace:
        return spark.createDataFrame([], OUT)
    e, vectors = leading_eigenvectors(times, d, components, guard)
    kept = int((e > NOISE * e[0]).sum())
    e, vectors = e[:kept], vectors[:, :kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    onto = vectors * (signs / np.sqrt(e))
    second = summed(blocks, d, "<f8", lambda x: np.vstack([(y := centred(x) @ onto).T @ y, y.sum(axis=0)])).reshape(kept + 1, kept) / n
    error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(kept)).max())
    explained = e / trace
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, value in zip(b.column("keys"), b.column("x"), strict=True):
                x = _matrix(value, d)
                far = _deviations(x, n, sums)
                at = np.repeat(np.arange(len(x)), kept)
                yield pa.RecordBatch.from_arrays(
                    [keys.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)),
                     pa.array(far[at]), pa.array((centred(x) @ onto).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))],
                    schema=schema)

    return blocks.mapInArrow(tidy(project), OUT)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum of (n x - S)^2 per row, in integers as long as they need."""
    reach = max(n * max(abs(int(x.max())), abs(int(x.min()))), int(np.abs(sums).max())) if len(x) else 0
    apart = x * n - sums if reach < 1 << 61 else x.astype(object) * n - sums.astype(object)
    most = max(abs(int(apart.max())), abs(int(apart.min()))) if len(x) else 0
    if x.shape[1] * most * most < 1 << 63:
        return (apart * apart).sum(axis=1).astype(np.int64)
    out = (apart.astype(object) ** 2).sum(axis=1)
    if max(out) >= 1 << 63:
        raise OverflowError("a deviation does not fit a long")
    return out.astype(np.int64)
