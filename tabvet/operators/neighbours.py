"""Exact nearest neighbours between two whole tables.

Rows are points: ``x`` (array<double>, NaN for a missing number) and ``c`` (array<bigint>,
codes of categories). A ``Space`` says how far two points are apart and, for
a box of points, how far a point is from anything inside at least.

A k-d tree over a bounded sample of the reference cuts the space into cells of some thousand rows; the sample
decides how fast the search is, not what it finds. The rows of a cell, equal ones once with their number, are a block (a large
cell: several). Then, in two rounds:

1. Every probe is compared with a block of its own cell. Its k-th
   nearest there bounds how far it has to look. Where no other block's box can hold something within that bound, it is done.
2. Every other probe visits the blocks that can, and its lists are merged.

A block consists of leaves of ``LEAF`` rows, each with its box. A probe is compared with the leaf that
lies nearest first, then with those leaves alone that can hold something within its bound.

Probes and reference rows travel as packs (a pack is one row of many points). A task sees one block at a time and
the packs that meet it one after the other; a block that very many meet goes to several tasks. On the driver stand the tree
and one box per block, some ``MOST_CELLS`` of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.session import written

#: Reference rows of a cell on average, cells at most, sampled rows per cell, probes compared at a time, reference rows of a leaf.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS, PACK, LEAF = 2048, 1 << 16, 8, 512, 32
# Rows that a task holds before it cuts them into packs, rows that meet a block in one task, blocks of a region.
_HELD, _SHARE, _NEAR = 1 << 18, 1 << 17, 64
# Pairs of a probe and a leaf that are compared at a time.
_PAIRS = 512
# Lower bounds and distances are rounded differently.
_SLACK = 1e-9

NEAREST = "array<struct<d: double, m: bigint, s: double>>"


@dataclass
class Boxes:
    """Per cell: least and greatest number per column, whether some are missing, some not; least and greatest code per category column."""

    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray
    present: np.ndarray
    code_low: np.ndarray
    code_high: np.ndarray

    def of(self, which: np.ndarray) -> Boxes:
        return Boxes(*[getattr(self, f.name)[which] for f in fields(self)])


Columns = list[np.ndarray]


class Space:
    """Distances between points, arrays of (points, numbers) and (points, codes). ``weights``: what one unit of each number counts."""

    weights: np.ndarray

    def index(self, x: np.ndarray) -> np.ndarray:
        """The coordinates that boxes are made of; by default the numbers themselves."""
        return x

    def apart(self, x: Columns, c: Columns, y: Columns, e: Columns) -> np.ndarray:
        """Distances, element by element, of points given by columns whose shapes fit together."""
        raise NotImplementedError

    def distances(self, x: np.ndarray, c: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
        """All of the first points from all of the second."""
        out = self.apart([v[:, None] for v in x.T], [v[:, None] for v in c.T], [v[None] for v in y.T], [v[None] for v in e.T])
        return np.broadcast_to(out, (len(x), len(y)))

    def reach(self, at: np.ndarray, c: np.ndarray, boxes: Boxes) -> np.ndarray:
        """Lower bounds of the distances of points, by their index coordinates, from anything in each box."""
        raise NotImplementedError

    def bounds(self, x: np.ndarray, c: np.ndarray, boxes: Boxes) -> np.ndarray:
        return self.reach(self.index(x), c, boxes)


def _gap(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each value is from each interval."""
    out = low[None, :] - v[:, None]
    np.maximum(out, v[:, None] - high[None, :], out=out)
    return np.maximum(out, 0.0, out=out)


def _plus(total: np.ndarray | float, part: np.ndarray) -> np.ndarray:
    """Their sum, in the memory of the first where it is an array."""
    if isinstance(total, float) or total.shape != np.broadcast_shapes(total.shape, part.shape):
        return total + part
    total += part
    return total


def _foreign(c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (c[:, None] < low[None, :]) | (c[:, None] > high[None, :])


@dataclass
class MeanDifference(Space):
    """Mean over all columns of |a - b| / scale (both missing 0, one missing 1) and of 0 or 1 for categories."""

    scales: np.ndarray
    columns: int
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.weights = 1.0 / self.scales

    def apart(self, x, c, y, e):
        out = 0.0
        for a, b, scale in zip(x, y, self.scales, strict=True):
            part = a - b
            np.abs(part, out=part)
            part /= scale
            na, nb = np.isnan(a), np.isnan(b)
            if na.any() or nb.any():
                part = np.where(na & nb, 0.0, np.where(na | nb, 1.0, part))
            part /= self.columns
            out = _plus(out, part)
        for a, b in zip(c, e, strict=True):
            out = _plus(out, np.where(a != b, 1.0 / self.columns, 0.0))
        return out

    def reach(self, x, c, boxes):
        out = np.zeros((len(x), len(boxes.low)))
        for j, scale in enumerate(self.scales):
            v = x[:, j]
            if not (boxes.missing[:, j].any() or np.isnan(v).any()):
                out += _gap(v, boxes.low[:, j], boxes.high[:, j]) / (scale * self.columns)
                continue
            part = np.where(boxes.present[:, j], _gap(v, boxes.low[:, j], boxes.high[:, j]) / scale, np.inf)
            part = np.where(boxes.missing[:, j], np.minimum(part, 1.0), part)
            part = np.where(np.isnan(v)[:, None], np.where(boxes.missing[:, j], 0.0, 1.0)[None, :], part)
            out += part / self.columns
        for j in range(c.shape[1]):
            out += _foreign(c[:, j], boxes.code_low[:, j], boxes.code_high[:, j]) / self.columns
        return out


@dataclass
class Gower(Space):
    """Mean over the columns that both points have of |a - b| / span and of 0 or 1 for categories; ``nothing`` without such a column."""

    spans: np.ndarray
    nothing: float = 1e9
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.weights = 1.0 / self.spans

    def apart(self, x, c, y, e):
        total, parts = 0.0, float(len(c))
        for a, b, span in zip(x, y, self.spans, strict=True):
            part = a - b
            np.abs(part, out=part)
            part /= span
            if np.isnan(a).any() or np.isnan(b).any():
                both = ~np.isnan(part)
                part[~both] = 0.0
                parts = parts + both
            else:
                parts = parts + 1.0
            total = _plus(total, part)
        for a, b in zip(c, e, strict=True):
            total = _plus(total, (a != b).astype(float))
        return np.where(parts > 0, total / np.maximum(parts, 1.0), self.nothing)

    def reach(self, x, c, boxes):
        # a column that may count or not adds nothing to the sum and one to the number of columns
        total, parts = np.zeros((len(x), len(boxes.low))), np.full((len(x), len(boxes.low)), float(c.shape[1]))
        for j, span in enumerate(self.spans):
            v = x[:, j]
            counts = ~np.isnan(v)[:, None] & boxes.present[None, :, j]
            gap = np.nan_to_num(_gap(v, boxes.low[:, j], boxes.high[:, j]) / span)
            total += np.where(counts & ~boxes.missing[None, :, j], gap, 0.0)
            parts += counts
        for j in range(c.shape[1]):
            total += _foreign(c[:, j], boxes.code_low[:, j], boxes.code_high[:, j])
        return np.where(parts > 0, total / np.maximum(parts, 1.0), 0.0)


@dataclass
class Euclidean(Space):
    """Euclidean distance of points without missing numbers.

    ``segments``: lists of columns, such as consecutive steps of a series. Boxes are then made of the
    segments' means, times the root of their lengths: these lie no farther apart than the points.
    """

    dimensions: int
    segments: list[list[int]] | None = None
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.weights = np.ones(len(self.segments) if self.segments else self.dimensions)

    def index(self, x):
        return x if self.segments is None else np.stack([x[:, s].mean(axis=1) * len(s) ** 0.5 for s in self.segments], axis=1)

    def apart(self, x, c, y, e):
        out = 0.0
        for a, b in zip(x, y, strict=True):
            part = a - b
            part *= part
            out = _plus(out, part)
        return np.sqrt(out)

    def reach(self, at, c, boxes):
        return np.sqrt(sum(_gap(at[:, j], boxes.low[:, j], boxes.high[:, j]) ** 2 for j in range(at.shape[1])))


@dataclass
class SquaredMixed(Space):
    """Squared Euclidean distance of the numbers, and 2 for each category that differs, as one-hot columns have it."""

    numbers: int
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.weights = np.ones(self.numbers)

    def apart(self, x, c, y, e):
        out = 0.0
        for a, b in zip(x, y, strict=True):
            part = a - b
            part *= part
            out = _plus(out, part)
        for a, b in zip(c, e, strict=True):
            out = _plus(out, np.where(a != b, 2.0, 0.0))
        return out

    def reach(self, x, c, boxes):
        out = np.zeros((len(x), len(boxes.low)))
        for j in range(self.numbers):
            out += _gap(x[:, j], boxes.low[:, j], boxes.high[:, j]) ** 2
        for j in range(c.shape[1]):
            out += 2.0 * _foreign(c[:, j], boxes.code_low[:, j], boxes.code_high[:, j])
        return out


@dataclass
class Tree:
    """A k-d tree: per node the column that it splits (numbers first, then codes; -1 in a leaf), the value that goes left at most, children, leaf number."""

    column: np.ndarray
    number: np.ndarray
    code: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def cells(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.column[at] >= 0)).size:
            node = at[inner]
            col = self.column[node]
            right = np.zeros(len(inner), bool)
            number = col < x.shape[1]
            right[number] = x[inner[number], col[number]] > self.number[node[number]]  # missing: left
            code = ~number
            right[code] = c[inner[code], col[code] - x.shape[1]] > self.code[node[code]]
            at[inner] = np.where(right, self.right[node], self.left[node])
        return self.leaf[at]

    def in_order(self) -> np.ndarray:
        """The leaves, those that lie close to each other near together."""
        out, open_ = [], [0]
        while open_:
            node = open_.pop()
            if self.column[node] < 0:
                out.append(self.leaf[node])
            else:
                open_ += [self.right[node], self.left[node]]
        return np.array(out, np.int64)


def build_tree(x: np.ndarray, c: np.ndarray, weights: np.ndarray, leaves: int) -> Tree:
    """Splits the largest sets of sampled points at a middle value of the column in which two of them differ most on average."""
    import heapq

    nodes = [[-1, 0.0, 0, 0, 0]]
    heap = [(-len(x), 0, np.arange(len(x)))]
    n_leaves = 1
    while heap and n_leaves < leaves:
        _, node, rows = heapq.heappop(heap)
        if len(rows) < 2:
            break
        spread = []
        for j in range(x.shape[1]):
            v = x[rows, j]
            v = v[~np.isnan(v)]
            spread.append(float(v.std()) * weights[j] + (1.0 if 0 < len(v) < len(rows) else 0.0) * 1e-9 if len(v) else 0.0)
        spread += [_mixed(c[rows, j]) for j in range(c.shape[1])]
        j = int(np.argmax(spread))
        if spread[j] <= 0:
            continue  # equal points: stays a leaf
        number = j < x.shape[1]
        v = np.nan_to_num(x[rows, j], nan=-np.inf) if number else c[rows, j - x.shape[1]]
        cut = np.sort(v)[(len(v) - 1) // 2]
        if cut == v.max():
            below = v[v < cut]
            if not len(below):
                continue
            cut = below.max()
        goes_right = v > cut
        left, right = len(nodes), len(nodes) + 1
        nodes[node] = [j, float(cut) if number else 0.0, 0 if number else int(cut), left, right]
        for child, part in ((left, rows[~goes_right]), (right, rows[goes_right])):
            nodes.append([-1, 0.0, 0, 0, 0])
            heapq.heappush(heap, (-len(part), child, part))
        n_leaves += 1
    column = np.array([n[0] for n in nodes])
    leaf = np.where(column < 0, np.cumsum(column < 0) - 1, -1)
    return Tree(column, np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes], np.int64),
                np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes]), leaf)


def _points(b: pa.RecordBatch, numbers: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, numbers)
    return x, b.column("c").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, codes)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(a).ravel(), kind))


_PACK = "block int, n int, b binary"
_BLOCK = "block int, n int, b binary, box binary"
_FOUND = "home bigint, block int, n int, b binary, lists binary"

Lists = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: What becomes of probes x, c, m, s and their lists (probe, distance, rows, sum), in order of probe and distance.
Fold = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Lists], pa.RecordBatch]


def _as_rows(x: np.ndarray, c: np.ndarray, m: np.ndarray, s: np.ndarray, found: Lists) -> pa.RecordBatch:
    p, d, n, t = found
    ends = pa.array(np.searchsorted(p, np.arange(len(x) + 1)), pa.int32())
    near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(n, pa.int64()), pa.array(t, pa.float64())], ["d", "m", "s"]))
    return pa.RecordBatch.from_arrays([_lists(x, pa.float64()), _lists(c, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.float64()), near], names=["x", "c", "m", "s", "nearest"])


class Search:
    """One reference table, cut into cells; ``nearest`` answers for probe tables."""

    def __init__(self, reference: DataFrame, space: Space, numbers: int, codes: int, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS):
        self.space, self.numbers, self.codes = space, numbers, codes
        self.spark = reference.sparkSession
        self.n = reference.count()
        if not self.n:
            return
        rows = reference.select("x", "c", "m", "s")
        cells = max(1, min(most_cells, self.n // cell_rows))
        every = max(1, self.n // (SAMPLE_ROWS * cells))
        points = rows.select("x", "c")
        sample = points.where(F.pmod(F.xxhash64("x", "c"), F.lit(every)) == 0).distinct().toArrow()
        sample = sample if sample.num_rows else points.limit(1).toArrow()
        x, c = (np.asarray(sample.column(n).combine_chunks().flatten()).reshape(sample.num_rows, width) for n, width in (("x", numbers), ("c", codes)))
        x, c = x.astype(float), c.astype(np.int64)
        order = np.lexsort((*c.T, *x.T)) if numbers + codes else np.arange(len(x))
        at = space.index(x)[order]
        self.tree = build_tree(at, c[order], space.weights, cells)
        # a cell that the sample shows to be large is several blocks
        sizes = np.bincount(self.tree.cells(at, c[order]), minlength=int(self.tree.leaf.max()) + 1) * every
        by_place = self.tree.in_order()
        parts = np.maximum(1, -(-sizes // (8 * cell_rows)))
        self.parts, self.first = parts, np.zeros(len(parts), np.int64)
        self.first[by_place[1:]] = np.cumsum(parts[by_place])[:-1]
        packs = rows.mapInArrow(self._cutter(True), _PACK)
        self.blocks = written(packs.repartition("block").sortWithinPartitions("block").mapInArrow(_gathered(space, numbers, codes), _BLOCK))
        self._measure()

    def _cutter(self, reference: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Packs of the rows of each block, equal rows among some thousand as one. Probes go to the first block of their cell."""
        tree, space, numbers, codes, parts, first = self.tree, self.space, self.numbers, self.codes, self.parts, self.first

        def flushed(held: list[tuple]) -> pa.RecordBatch:
            x, c, m, s = (np.concatenate(v) for v in zip(*held, strict=True))
            cell = tree.cells(space.index(x), c)
            h = _hashes(x, c)
            block = first[cell] + ((h % parts[cell].astype(np.uint64)).astype(np.int64) if reference else 0)
            x, c, m, s, block = _once(x, c, m, s, block, h)
            ends = list(_stretches(block, len(block)))
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.int32()), pa.array([z - a for _, a, z in ends], pa.int32()),
                                               pa.array([_blob(x[a:z], c[a:z], m[a:z], s[a:z]) for _, a, z in ends], pa.binary())], names=["block", "n", "b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                if b.num_rows:
                    held.append((*_points(b, numbers, codes), b.column("m").to_numpy(), b.column("s").to_numpy()))
                    n += b.num_rows
                if n >= _HELD:
                    yield flushed(held)
                    held, n = [], 0
            if n:
                yield flushed(held)

        return run

    def _measure(self) -> None:
        """The box of each block, and of ``_NEAR`` blocks together, which lie close to each other."""
        found = self.blocks.select("block", "box").toArrow().sort_by("block")
        self.cell_ids = found.column("block").to_numpy().astype(np.int64)
        d, k = len(self.space.weights), self.codes
        raw = np.frombuffer(b"".join(found.column("box").to_pylist()), np.int64).reshape(len(found), 4 * d + 2 * k)
        low, high, missing, present = (raw[:, i * d:(i + 1) * d] for i in range(4))
        self.boxes = Boxes(low.view(float), high.view(float), missing > 0, present > 0, raw[:, 4 * d:4 * d + k].copy(), raw[:, 4 * d + k:].copy())
        ends = np.arange(0, len(raw), _NEAR)
        b = self.boxes
        self.regions = Boxes(np.fmin.reduceat(b.low, ends), np.fmax.reduceat(b.high, ends), np.logical_or.reduceat(b.missing, ends), np.logical_or.reduceat(b.present, ends),
                             np.minimum.reduceat(b.code_low, ends), np.maximum.reduceat(b.code_high, ends))

    def _met(self, packs: DataFrame, step: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``step`` for every block with the packs that meet it; a block that very many rows meet comes to several tasks."""
        shape = self.blocks.select(F.lit(-1).cast("bigint").alias("home"), "block", "n", "b")
        shares = packs.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(_SHARE)).cast("int").alias("shares"))
        here = shape.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        visitors = packs.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("home", F.substring("b", 1, 64)), F.col("shares")).cast("int"))
        both = here.select("block", "share", "home", "n", "b").unionByName(visitors.select("block", "share", "home", "n", "b"))
        return both.repartition("block", "share").sortWithinPartitions("block", "share", "home").mapInArrow(_streamed(self.space, self.numbers, self.codes, step), schema)

    def nearest(self, probe: DataFrame, k: int = 1, within: float = float("inf"), one_is_enough: bool = False, fold: Fold = _as_rows,
                schema: str = f"x array<double>, c array<bigint>, m bigint, s double, nearest {NEAREST}") -> DataFrame:
        """x, c, m, s of every probe (equal ones often once; ``m``: how many, ``s``: sum of theirs) and ``nearest``: distances up to that of the k-th nearest row, falling no farther than ``within``.

        Each distance comes with the number m and the sum s of the reference rows
        there; all rows that tie with the k-th are in. ``one_is_enough``: a probe that
        finds a row below ``within`` in its own block looks no further, so its list may lack nearer ones.
        ``fold``, ``schema``: makes other rows of many probes and their lists.
        """
        space, numbers, codes = self.space, self.numbers, self.codes
        rows = probe.select("x", "c", "m", "s")
        if not self.n:
            def alone(batches):
                for b in batches:
                    if b.num_rows:
                        yield fold(*_points(b, numbers, codes), b.column("m").to_numpy(), b.column("s").to_numpy(), _NOTHING)

            return rows.mapInArrow(alone, schema)
        enough = within if one_is_enough else None
        packs = written(rows.mapInArrow(self._cutter(False), _PACK).withColumn("home", F.lit(0).cast("bigint")))
        boxes, regions, ids = self.boxes, self.regions, self.cell_ids

        def first(own: int, block: Block, met: Iterator[tuple[int, int, pa.Buffer]], number: Iterator[int]) -> Iterator[pa.RecordBatch]:
            for x, c, m, s in _gathered_probes(met, numbers, codes):
                order = _by_leaves(space.index(x), c, space.weights, PACK // 2)
                done, out = [], []
                for low in range(0, len(x), PACK):
                    part = order[low:low + PACK]
                    px, pc, pm, ps = x[part], c[part], m[part], s[part]
                    found = block.nearest(px, pc, np.full(len(px), within), k, enough)
                    have = np.bincount(found[0], found[2], len(px))
                    far = np.full(len(px), -np.inf)
                    np.maximum.at(far, found[0], found[1])
                    u = np.where(have >= k, np.minimum(far, within), within)
                    looks = np.ones(len(px), bool)
                    if enough is not None:
                        looks[found[0][found[1] < enough]] = False
                    who = np.flatnonzero(looks)
                    near, reached = _within_reach(space, px[who], pc[who], u[who], boxes, regions, ids, own) if len(who) else ([], None)
                    looks[:] = False
                    if len(near):
                        looks[who] = reached.any(axis=1)
                    done.append((px[~looks], pc[~looks], pm[~looks], ps[~looks], _chosen(found, ~looks)))
                    if looks.any():
                        home, opened = next(number), np.flatnonzero(looks)
                        out.append((home, -1, len(opened), _blob(px[opened], pc[opened], pm[opened], ps[opened]), _blob(*_chosen(found, looks))))
                        at = np.cumsum(looks) - 1
                        for i, target in enumerate(near):
                            w = who[reached[:, i]]
                            out.append((home, int(ids[target]), len(w), _blob(px[w], pc[w], at[w], u[w]), b""))
                size = np.cumsum([0, *[len(v[0]) for v in done]])
                lists = [(f[0] + z, *f[1:]) for (*_, f), z in zip(done, size, strict=False)]
                if size[-1]:
                    out.append((-1, -1, int(size[-1]), _blob(*[np.concatenate(v) for v in list(zip(*done, strict=True))[:4]]), _blob(*[np.concatenate(v) for v in zip(*lists, strict=True)])))
                yield _batch(out)

        def second(own: int, block: Block, met: Iterator[tuple[int, int, pa.Buffer]], number: Iterator[int]) -> Iterator[pa.RecordBatch]:
            out = []
            for home, n, b in met:
                x, c, at, u = _unblob(b, n, numbers, codes)
                p, d, m, t = block.nearest(x, c, u, k, enough)
                if len(p):
                    out.append((home, own, 0, b"", _blob(at[p], d, m, t)))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], None
            for home, rows in _by_key(batches, "home", ("n", "b", "lists")):
                if home == -1:
                    for n, b, lists in rows:
                        yield fold(*_unblob(b, n, numbers, codes), _unlist(lists))
                    continue
                rows = list(rows)
                n, b = next((n, b) for n, b, _ in rows if n)
                together = [np.concatenate(v) for v in zip(*[_unlist(lists) for *_, lists in rows], strict=True)]
                yield fold(*_unblob(b, n, numbers, codes), _listed(*together, k))

        one = written(self._met(packs, first, _FOUND))
        visits = one.where("block >= 0").select("home", "block", "n", "b")
        opened = one.where("block < 0 AND home >= 0").unionByName(self._met(visits, second, _FOUND))
        sorted_ = opened.repartition("home").sortWithinPartitions("home")
        return one.where("home < 0").mapInArrow(merged, schema).unionByName(sorted_.mapInArrow(merged, schema))


_NOTHING = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0))


def _hashes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for v in (*(x + 0.0).T, *c.T):  # -0.0 and 0.0 are one number
        out = (out ^ np.ascontiguousarray(v).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _once(x: np.ndarray, c: np.ndarray, m: np.ndarray, s: np.ndarray, block: np.ndarray, h: np.ndarray) -> tuple:
    """The rows by block; equal ones, which are next to each other unless hashes collide, as one row."""
    order = np.lexsort((h, block))
    x, c, m, s, block, h = (v[order] for v in (x, c, m, s, block, h))
    same = (block[1:] == block[:-1]) & (h[1:] == h[:-1])
    for v in (*(x + 0.0).T, *c.T):
        v = np.ascontiguousarray(v).view(np.int64)
        same &= v[1:] == v[:-1]
    new = np.flatnonzero(np.r_[True, ~same])
    return x[new], c[new], np.add.reduceat(m, new), np.add.reduceat(s, new), block[new]


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of 8 bytes a value, column by column, so that equal columns take no room in compressed files."""
    return b"".join(np.ascontiguousarray(a.T).tobytes() for a in arrays)


def _unblob(b: pa.Buffer, n: int, numbers: int, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, c, whole numbers, numbers."""
    v = np.frombuffer(b, np.int64).reshape(numbers + codes + 2, n)
    return v[:numbers].view(float).T, v[numbers:numbers + codes].T, v[-2], v[-1].view(float)


def _unlist(b: pa.Buffer) -> Lists:
    v = np.frombuffer(b, np.int64).reshape(4, -1)
    return v[0], v[1].view(float), v[2], v[3].view(float)


def _chosen(found: Lists, which: np.ndarray) -> Lists:
    """The lists of some probes, numbered anew."""
    mine = which[found[0]]
    return ((np.cumsum(which) - 1)[found[0][mine]], *[v[mine] for v in found[1:]])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["home", "block", "n", "b", "lists"])


def _by_key(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(key, its rows) of sorted batches, one row at a time."""
    def rows():
        for b in batches:
            keys = b.column(key).to_pylist()
            columns = [b.column(n) for n in names]
            values = [c.to_pylist() if c.type != pa.binary() else [v.as_buffer() for v in c] for c in columns]
            yield from zip(keys, *values, strict=True)

    for k, mine in itertools.groupby(rows(), lambda r: r[0]):
        yield k, (r[1:] for r in mine)


def _gathered(space: Space, numbers: int, codes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All packs of a block as one, in the order of its leaves, with its box."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_key(batches, "block", ("n", "b")):
            x, c, m, s = (np.concatenate(v) for v in zip(*[_unblob(b, n, numbers, codes) for n, b in rows], strict=True))
            x, c, m, s, _ = _once(x, c, m, s, np.zeros(len(x), np.int64), _hashes(x, c))
            at = space.index(x)
            order = _by_leaves(at, c, space.weights)
            box = _leaf_boxes(at[None], c[None])
            raw = np.concatenate([v[0].astype(float).view(np.int64) for v in (box.low, box.high)] + [v[0].astype(np.int64) for v in (box.missing, box.present, box.code_low, box.code_high)])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([_blob(x[order], c[order], m[order], s[order])], pa.binary()),
                                              pa.array([raw.tobytes()], pa.binary())], names=["block", "n", "b", "box"])

    return run


def _gathered_probes(met: Iterator[tuple[int, int, pa.Buffer]], numbers: int, codes: int) -> Iterator[tuple]:
    """Probes of a block, many at a time, equal ones once."""
    held, size = [], 0
    for _, n, b in met:
        held.append(_unblob(b, n, numbers, codes))
        size += n
        if size >= _HELD // 16:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    x, c, m, s = (np.concatenate(v) for v in zip(*held, strict=True))
    return _once(x, c, m, s, np.zeros(len(x), np.int64), _hashes(x, c))[:4]


def _streamed(space: Space, numbers: int, codes: int, step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)
        for (own, _), rows in itertools.groupby(_flat(batches), lambda r: r[:2]):
            block = None
            for _, _, home, n, b in rows:  # the block comes first
                y, e, m, s = _unblob(b, n, numbers, codes)
                block = Block(space, y, e, m, s)
                break
            yield from step(own, block, ((home, n, b) for _, _, home, n, b in rows), number)

    def _flat(batches):
        for b in batches:
            yield from zip(*[b.column(n).to_pylist() for n in ("block", "share", "home", "n")], [v.as_buffer() for v in b.column("b")], strict=True)

    return run


def _within_reach(space: Space, x: np.ndarray, c: np.ndarray, u: np.ndarray, boxes: Boxes, regions: Boxes, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the blocks that can hold something within the bound of one of the points, and which of the points each."""
    limit = u * (1 + _SLACK) + 1e-15
    most = limit.max()
    wide = np.flatnonzero(_from_all(space, x, c, regions) <= most)
    places = (wide[:, None] * _NEAR + np.arange(_NEAR)).ravel()
    places = places[places < len(ids)]
    places = places[ids[places] != own]
    places = places[_from_all(space, x, c, boxes.of(places)) <= most]
    reached = space.bounds(x, c, boxes.of(places)) <= limit[:, None]
    some = reached.any(axis=0)
    return places[some], reached[:, some]


def _stretches(cell: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(cell, from, to) of consecutive rows of one cell, at most ``most`` each."""
    cuts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for low in range(a, z, most):
            yield int(cell[a]), low, min(z, low + most)


def _from_all(space: Space, x: np.ndarray, c: np.ndarray, boxes: Boxes) -> np.ndarray:
    """Lower bounds of the distances of any of these points from anything in each box: the middle of the points' box from boxes wider by half of it."""
    at = space.index(x)
    missing = np.isnan(at).any(axis=0)
    low, high = (np.where(missing, 0.0, v) for v in (at.min(axis=0), at.max(axis=0)))
    apart = ((boxes.code_low > c.max(axis=0)) | (boxes.code_high < c.min(axis=0))).astype(np.int64)  # 1: none of the points' codes, which stand as 0
    # a column that one of the points lacks bounds nothing
    wider = Boxes(np.where(missing, -np.inf, boxes.low - (high - low) / 2), np.where(missing, np.inf, boxes.high + (high - low) / 2),
                  boxes.missing, boxes.present | missing, apart, apart)
    return space.reach(((low + high) / 2)[None], np.zeros((1, c.shape[1]), np.int64), wider)[0]


def _mixed(codes: np.ndarray) -> float:
    """How likely two of them differ."""
    if (codes == codes[0]).all():
        return 0.0
    share = np.unique(codes, return_counts=True)[1] / len(codes)
    return float(1 - (share ** 2).sum())


def _by_leaves(at: np.ndarray, c: np.ndarray, weights: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of the points in which each ``leaf`` consecutive ones lie close together."""
    out, open_ = [], [np.arange(len(at))]
    while open_:
        rows = open_.pop()
        leaves = -(-len(rows) // leaf)
        if leaves < 2:
            out.append(rows)
            continue
        v = at[rows]
        known = ~np.isnan(v)
        n = known.sum(axis=0)
        mean = np.where(known, v, 0.0).sum(axis=0) / np.maximum(n, 1)
        spread = np.sqrt((np.where(known, v - mean, 0.0) ** 2).sum(axis=0) / np.maximum(n, 1)) * weights + np.where((0 < n) & (n < len(rows)), 1e-9, 0.0)
        j = int(np.argmax([*spread, *[_mixed(e) for e in c[rows].T]]))
        by = rows[np.argsort(v[:, j] if j < at.shape[1] else c[rows, j - at.shape[1]], kind="stable")]
        half = leaves // 2 * leaf
        open_ += [by[half:], by[:half]]  # the last leaf alone may be short
    return np.concatenate(out)


def _leaf_boxes(at: np.ndarray, c: np.ndarray) -> Boxes:
    """The boxes of points shaped (leaves, LEAF, columns)."""
    gone = np.isnan(at)
    low, high = np.where(gone, np.inf, at).min(axis=1), np.where(gone, -np.inf, at).max(axis=1)
    present = ~gone.all(axis=1)
    return Boxes(np.where(present, low, np.nan), np.where(present, high, np.nan), gone.any(axis=1), present, c.min(axis=1), c.max(axis=1))


def _listed(p: np.ndarray, d: np.ndarray, m: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(probe, distance, rows, sum), probe by probe in order of distance, as far as k rows."""
    order = np.lexsort((d, p))
    p, d, m, s = p[order], d[order], m[order], s[order]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])][:len(p)])
    if not len(new):
        return p, d, m, s
    p, d, m, s = p[new], d[new], np.add.reduceat(m, new), np.add.reduceat(s, new)
    before = np.cumsum(m) - m
    first = np.r_[True, p[1:] != p[:-1]]
    before -= before[np.flatnonzero(first)][np.cumsum(first) - 1]
    keep = before < k
    return p[keep], d[keep], m[keep], s[keep]


class Block:
    """Reference rows in the order of their leaves, ready for comparison."""

    def __init__(self, space: Space, y: np.ndarray, e: np.ndarray, m: np.ndarray, s: np.ndarray):
        self.space, self.leaves = space, -(-len(m) // LEAF)
        shape = (self.leaves, LEAF)
        filled = np.minimum(np.arange(self.leaves * LEAF), len(m) - 1)  # the last row fills the last leaf, and counts once
        y, e = y[filled], e[filled]
        self.m, self.s = np.where(np.arange(len(filled)) < len(m), m[filled], 0).reshape(shape), s[filled].reshape(shape)
        self.short = len(filled) > len(m)
        self.numbers = [np.ascontiguousarray(v).reshape(shape) for v in y.T]
        # a code that all rows have is compared once a probe
        self.codes = [v[:1].reshape(1, 1) if (v == v[0]).all() else np.ascontiguousarray(v).reshape(shape) for v in e.T]
        at = space.index(y)
        self.boxes = _leaf_boxes(at.reshape(*shape, at.shape[1]), e.reshape(*shape, e.shape[1]))

    def compared(self, xs: Columns, cs: Columns, u: np.ndarray, k: int, probes: np.ndarray, which: np.ndarray) -> Lists:
        """(probe, distance, rows, sum) of the rows of a leaf for each of the pairs (probe, leaf), no farther than ``u``, which falls to what they bound."""
        found = [_NOTHING]
        for low in range(0, len(probes), _PAIRS):
            p, leaf = probes[low:low + _PAIRS], which[low:low + _PAIRS]
            d = self.space.apart([v[p, None] for v in xs], [v[p, None] for v in cs], [v[leaf] for v in self.numbers], [v if v.size == 1 else v[leaf] for v in self.codes])
            d = np.broadcast_to(d, (len(p), LEAF))
            m = self.m[leaf]
            if self.short:  # copies of the last row fill the last leaf
                d = np.where(m > 0, d, np.inf)
            # a leaf's k nearest rows, and those that tie with the last, are enough of it
            kth = d.min(axis=1) if k == 1 else np.partition(d, k - 1, axis=1)[:, k - 1] if k <= LEAF else np.full(len(p), np.inf)
            if self.many and k > 1:  # or one row that counts for k
                kth = np.minimum(kth, np.where(m >= k, d, np.inf).min(axis=1))
            np.minimum.at(u, p, kth)
            fits = d <= u[p, None]
            if self.short:
                fits &= m > 0
            pair, row = np.nonzero(fits)
            found.append((p[pair], d[pair, row], m[pair, row], self.s[leaf[pair], row]))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))

    def nearest(self, x: np.ndarray, c: np.ndarray, u: np.ndarray, k: int, enough: float | None = None) -> Lists:
        """(probe, distance, rows, sum) of the nearest rows, as far as k rows, no farther than ``u``."""
        xs, cs = [np.ascontiguousarray(v) for v in x.T], [np.ascontiguousarray(v) for v in c.T]
        u = u.copy()
        self.many = bool((self.m >= k).any())
        bounds = self.space.bounds(x, c, self.boxes)
        every, found = np.arange(len(x)), []
        for _ in range(min(2, self.leaves)):  # the two leaves that lie nearest, then all others within the bound that these give
            best = bounds.argmin(axis=1)
            probes = np.flatnonzero(bounds[every, best] <= u * (1 + _SLACK) + 1e-15)
            found.append(self.compared(xs, cs, u, k, probes, best[probes]))
            bounds[every, best] = np.inf
            if enough is not None:
                bounds[found[-1][0][found[-1][1] < enough]] = np.inf
        found.append(self.compared(xs, cs, u, k, *np.nonzero((bounds <= (u * (1 + _SLACK) + 1e-15)[:, None]) & (bounds < np.inf))))
        p, d, m, s = (np.concatenate(v) for v in zip(*found, strict=True))
        near = d <= u[p]
        return _listed(p[near], d[near], m[near], s[near], k)


def as_points(df: DataFrame, numerical: list[str], categorical: list[str], s: Column | None = None) -> DataFrame:
    """Rows as points: x (NaN where null), c (64-bit hashes of the levels; null is the level 'None'), m = 1, s."""
    x = [F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in numerical]
    c = [F.xxhash64(F.coalesce(F.col(n).cast("string"), F.lit("None"))) for n in categorical]
    return df.select(F.array(*x).cast("array<double>").alias("x"), F.array(*c).cast("array<bigint>").alias("c"), F.lit(1).cast("bigint").alias("m"),
                     (s if s is not None else F.lit(0.0)).cast("double").alias("s"))
