"""The neighbour search and what rests on it against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.operators import models, neighbours, privacy, sequences
from tabvet.operators.splits import two_way_split


def brute(space, x, c, y, e, m, s, k, within):
    """Per probe the list (d, rows, sum) as far as k rows."""
    out = []
    d = space.distances(x, c, y, e)
    for row in d:
        listed, seen = [], 0
        for v in np.unique(row):
            if seen >= k or v > within:
                break
            at = row == v
            listed.append((v, int(m[at].sum()), float(s[at].sum())))
            seen += listed[-1][1]
        out.append(listed)
    return out


def points(rng, n, d, k, missing):
    x = np.round(rng.normal(size=(n, d)) * 2) / 2
    if missing:
        x[rng.random((n, d)) < 0.1] = np.nan
    return x, rng.integers(0, 3, (n, k))


@pytest.mark.parametrize(("kind", "k", "within"), [("mean", 1, math.inf), ("mean", 5, 0.3), ("gower", 1, 0.3), ("gower", 5, math.inf),
                                                   ("euclid", 5, math.inf), ("series", 1, math.inf), ("squared", 5, math.inf)])
def test_search(spark, kind, k, within):
    rng = np.random.default_rng(k)
    d, codes = 6, 0 if kind in ("euclid", "series") else 2
    missing = kind in ("mean", "gower")
    x, c = points(rng, 300, d, codes, missing)
    y, e = points(rng, 700, d, codes, missing)
    y[:250], e[:250] = y[0], e[0]  # a third of the rows are one point
    y[250:300], e[250:300] = x[:50], c[:50]
    space = {"mean": lambda: neighbours.MeanDifference(np.linspace(0.5, 2, d), d + codes), "gower": lambda: neighbours.Gower(np.linspace(0.5, 6, d)),
             "euclid": lambda: neighbours.Euclidean(d), "series": lambda: neighbours.Euclidean(d, [[0, 1, 2], [3, 4], [5]]),
             "squared": lambda: neighbours.SquaredMixed(d)}[kind]()

    def frame(a, b):
        rows = [(u.tolist(), v.tolist(), 1, float(i % 2)) for i, (u, v) in enumerate(zip(a, b, strict=True))]
        return spark.createDataFrame(rows, "x array<double>, c array<bigint>, m bigint, s double").repartition(3)

    search = neighbours.Search(frame(y, e), space, d, codes, cell_rows=20)
    assert len(search.cell_ids) > 10
    got = search.nearest(frame(x, c), k=k, within=within).collect()
    assert sum(r.m for r in got) == len(x)
    px = np.array([r.x for r in got], float).reshape(len(got), d)
    pc = np.array([r.c for r in got], np.int64).reshape(len(got), codes)
    want = brute(space, px, pc, y, e, np.ones(len(y), int), np.arange(len(y)) % 2.0, k, within)
    for r, w in zip(got, want, strict=True):
        assert [(n.d, n.m, n.s) for n in r.nearest] == [(pytest.approx(a), b, pytest.approx(z)) for a, b, z in w]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "x array<double>, c array<bigint>, m bigint, s double")
    one = spark.createDataFrame([([1.0], [2], 1, 0.0)], none.schema)
    assert neighbours.Search(none, neighbours.Euclidean(1), 1, 1).nearest(one).first().nearest == []
    assert neighbours.Search(one, neighbours.Euclidean(1), 1, 1).nearest(none).collect() == []


def mixed_table(spark, rng, n, numbers, levels):
    rows = [(*[rng.choice([None, *range(20)]) if rng.random() < 0.05 else round(rng.gauss(0, 3), 1) for _ in range(numbers)],
             *[rng.choice([None, "a", "b", "c"]) for _ in range(levels)]) for _ in range(n)]
    rows = [tuple(float(v) if isinstance(v, int) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, ", ".join([f"n{i} double" for i in range(numbers)] + [f"t{i} string" for i in range(levels)])), rows


@pytest.mark.parametrize(("numbers", "levels"), [(2, 2), (15, 10), (0, 3), (3, 0)])
def test_near_match_rate_over_all_rows(spark, numbers, levels):
    """Up to 25 columns; one point makes up a third of the real rows."""
    rng = random.Random(numbers)
    real, a = mixed_table(spark, rng, 300, numbers, levels)
    a = a + [a[0]] * 150
    syn, b = mixed_table(spark, rng, 200, numbers, levels)
    near = [tuple(v + 0.01 if isinstance(v, float) and rng.random() < 0.5 else v for v in r) for r in a[:80]]
    b = b + near
    real, syn = spark.createDataFrame(a, real.schema), spark.createDataFrame(b, syn.schema)
    kinds = ([f"n{i}" for i in range(numbers)], [f"t{i}" for i in range(levels)])
    spans = [(lambda v: (max(v) - min(v)) or 1.0)([r[i] for r in a if r[i] is not None]) for i in range(numbers)]

    def distance(p, q):
        parts = [abs(p[i] - q[i]) / spans[i] for i in range(numbers) if p[i] is not None and q[i] is not None]
        parts += [float((p[i] or "None") != (q[i] or "None")) for i in range(numbers, numbers + levels)]
        return sum(parts) / len(parts) if parts else 1e9

    want = sum(min(distance(p, q) for q in a) < 0.05 for p in b)
    got = privacy.near_match_rate(real, syn, kinds, sample_syn=None, sample_real=None).first()
    assert (got.close_rows, got.probed_rows) == (want, len(b)) and want >= 40


def brute_auc(members, others):
    wins = sum((a > b) + 0.5 * (a == b) for a in members for b in others)
    return wins / (len(members) * len(others))


def test_distance_privacy_over_all_rows(spark):
    rng = random.Random(3)
    frames, rows = zip(*[mixed_table(spark, rng, n, 3, 2) for n in (150, 120, 90)], strict=True)
    got = privacy.distance_privacy_all(*frames, numerical=["n0", "n1", "n2"]).first()
    train, holdout, syn = rows
    scale = [np.std([r[i] for r in train if r[i] is not None]) for i in range(3)]

    def distance(p, q):
        parts = [(0.0 if p[i] is None and q[i] is None else 1.0 if p[i] is None or q[i] is None else abs(p[i] - q[i]) / scale[i]) for i in range(3)]
        return sum([*parts, *[float(p[i] != q[i]) for i in (3, 4)]]) / 5

    to = lambda ps, qs: [min(distance(p, q) for q in qs) for p in ps]
    assert got.median_distance_to_train == pytest.approx(np.median(to(syn, train)), abs=1e-6)
    assert got.median_distance_to_holdout == pytest.approx(np.median(to(syn, holdout)), abs=1e-6)
    assert got.distance_attack_auc == pytest.approx(brute_auc([-d for d in to(train, syn)], [-d for d in to(holdout, syn)]), abs=1e-6)
    assert (got.train_rows, got.holdout_rows) == (150, 120)


def test_sequence_distance_privacy_over_all_windows(spark):
    rng = np.random.default_rng(1)
    sets = [rng.normal(size=(n, 12, 2)).cumsum(axis=1) for n in (60, 40, 50)]
    sets[2][:20] = sets[0][:20]

    def frame(a):
        return spark.createDataFrame([(f"w{i}", w.tolist()) for i, w in enumerate(a)], "window_id string, values array<array<double>>")

    got = sequences.sequence_distance_privacy_all(*map(frame, sets)).first()
    train, holdout, syn = (a.reshape(len(a), -1) for a in sets)
    train, holdout, syn = (a / sets[0].reshape(60, -1).std(axis=0) for a in (train, holdout, syn))
    to = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min(axis=1) / math.sqrt(24)
    assert got.exact_training_match_rate == 0.4 and got.near_training_match_rate == pytest.approx((to(syn, train) < 0.01).mean())
    assert got.median_distance_to_train == pytest.approx(np.median(to(syn, train)), abs=1e-6)
    assert got.median_distance_to_holdout == pytest.approx(np.median(to(syn, holdout)), abs=1e-6)
    assert got.distance_attack_auc == pytest.approx(brute_auc(-to(train, syn), -to(holdout, syn)), abs=1e-6)


def test_knn_discriminator_is_exact(spark):
    rng = random.Random(7)
    real, _ = mixed_table(spark, rng, 160, 2, 1)
    syn, _ = mixed_table(spark, rng, 90, 2, 1)
    syn = syn.withColumn("n0", F.col("n0") + 1.5)
    cols = ["n0", "n1", "t0"]
    out = models.knn_discriminator(real, syn, kinds=(["n0", "n1"], ["t0"]), seed=5).first()
    both = real.select(*cols).withColumn("_label", F.lit(0.0)).unionByName(syn.select(*cols).withColumn("_label", F.lit(1.0)))
    split = two_way_split(both, "_label", test=0.5, seed=5).collect()
    train, test = ([r for r in split if r.split == side] for side in ("train", "test"))
    # medians as Spark's Imputer gives them
    med = [sorted(v)[(len(v) - 1) // 2] for v in ([r[c] for r in train if r[c] is not None] for c in ("n0", "n1"))]
    mode = max(sorted({r.t0 for r in train if r.t0}), key=lambda t: sum(r.t0 == t for r in train))
    x = {s: np.array([[r[c] if r[c] is not None else m for c, m in zip(("n0", "n1"), med, strict=True)] for r in rows]) for s, rows in (("train", train), ("test", test))}
    mean, std = x["train"].mean(axis=0), x["train"].std(axis=0, ddof=1)
    hot = {s: [r.t0 or mode for r in rows] for s, rows in (("train", train), ("test", test))}
    scores = []
    for p, t in zip((x["test"] - mean) / std, hot["test"], strict=True):
        d = np.round(((((x["train"] - mean) / std) - p) ** 2).sum(axis=1) + 2.0 * np.array([t != u for u in hot["train"]]), 9)
        kth = np.sort(d)[4]
        y = np.array([r._label for r in train])
        n = (d < kth).sum()
        scores.append(round((y[d < kth].sum() + (5 - n) * y[d == kth].mean()) / 5, 9))
    want = brute_auc([s for s, r in zip(scores, test, strict=True) if r._label], [s for s, r in zip(scores, test, strict=True) if not r._label])
    assert out.status == "computed" and out.auc == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("kind", ["mean", "gower", "squared", "series"])
@pytest.mark.parametrize("k", [1, 5])
def test_block_compares_few_leaves(kind, k):
    """A block's nearest rows are those of brute force, found without comparing every probe with every row."""
    rng = np.random.default_rng(k)
    d, codes = 3, 0 if kind == "series" else 1
    x, c = points(rng, 200, d, codes, kind in ("mean", "gower"))
    y, e = points(rng, 1000, d, codes, kind in ("mean", "gower"))
    x, y = x + rng.normal(size=x.shape), y + rng.normal(size=y.shape)
    space = {"mean": lambda: neighbours.MeanDifference(np.ones(d), d + codes), "gower": lambda: neighbours.Gower(np.full(d, 6.0)),
             "squared": lambda: neighbours.SquaredMixed(d), "series": lambda: neighbours.Euclidean(d, [[0, 1], [2]])}[kind]()
    m, s = rng.integers(1, 3, len(y)), rng.random(len(y))
    pairs, apart = [0], space.apart
    space.apart = lambda *a: (lambda out: (pairs.__setitem__(0, pairs[0] + out.size), out)[1])(apart(*a))
    order = neighbours._by_leaves(space.index(y), e, space.weights)
    assert sorted(order) == list(range(len(y)))
    p, dist, n, t = neighbours.Block(space, y[order], e[order], m[order], s[order]).nearest(x, c, np.full(len(x), np.inf), k)
    assert pairs[0] < len(x) * len(y) * 0.7
    for i, want in enumerate(brute(space, x, c, y, e, m, s, k, math.inf)):
        assert [(a, b, z) for a, b, z in zip(dist[p == i], n[p == i], t[p == i], strict=True)] == [(pytest.approx(a), b, pytest.approx(z)) for a, b, z in want]


@pytest.mark.parametrize("kind", ["mean", "gower", "squared", "series"])
def test_cells_out_of_reach_of_a_pack(kind):
    """No point of a pack has a lower bound below that of the pack."""
    rng = np.random.default_rng(2)
    d, codes = 4, 0 if kind == "series" else 2
    space = {"mean": lambda: neighbours.MeanDifference(np.ones(d), d + codes), "gower": lambda: neighbours.Gower(np.full(d, 6.0)),
             "squared": lambda: neighbours.SquaredMixed(d), "series": lambda: neighbours.Euclidean(d, [[0, 1], [2, 3]])}[kind]()
    y, e = points(rng, 640, d, codes, kind in ("mean", "gower"))
    at = space.index(y)
    order = neighbours._by_leaves(at, e, space.weights)
    boxes = neighbours._leaf_boxes(at[order].reshape(20, 32, -1), e[order].reshape(20, 32, -1))
    for missing in (False, kind in ("mean", "gower")):
        x, c = points(rng, 6, d, codes, missing)
        x, c = x + 2, c + 1
        pack, each = neighbours._from_all(space, x, c, boxes), space.bounds(x, c, boxes)
        assert (pack <= each.min(axis=0) + 1e-9).all() and pack.max() > 0


def grid_points(spark, n, step):
    """n different points with one code of three."""
    i = F.col("id")
    x = F.array((i * 37 % 1009).cast("double") / 100, (i * step % 4001).cast("double") / 400, i.cast("double") / n)
    return spark.range(n).select(x.alias("x"), F.array((i % 3).cast("bigint")).alias("c"), F.lit(1).cast("bigint").alias("m"), F.lit(0.0).alias("s"))


def test_search_writes_little_and_collects_no_rows(spark, monkeypatch):
    """The driver gets samples and boxes as columns; a point takes few bytes in the shared folder."""
    import os
    from urllib.parse import urlparse

    from pyspark.sql.classic.dataframe import DataFrame

    from tabvet.session import checkpoint_dir

    collected, collect = [0], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (collected.__setitem__(0, max(collected[0], len(rows))), rows)[1])(collect(self)))
    root = urlparse(checkpoint_dir(spark)).path
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files)
    before, n = size(), 20_000
    search = neighbours.Search(grid_points(spark, n, 53), neighbours.Gower(np.array([10.0, 10.0, 1.0])), 3, 1, cell_rows=200)
    found = search.nearest(grid_points(spark, n, 59), within=0.05, one_is_enough=True)
    assert found.count() == n
    assert size() - before < 100 * n and collected[0] < 50


def test_block_lists_few_rows(monkeypatch):
    """The five nearest rows of a block are found without sorting the whole nearest leaf of each probe."""
    rng = np.random.default_rng(4)
    y, x = rng.normal(size=(2048, 3)), rng.normal(size=(500, 3))
    e, c = np.zeros((2048, 1), np.int64), np.zeros((500, 1), np.int64)
    space = neighbours.SquaredMixed(3)
    order = neighbours._by_leaves(y, e, space.weights)
    listed, lists = [0], neighbours._listed
    monkeypatch.setattr(neighbours, "_listed", lambda p, *a: (listed.__setitem__(0, listed[0] + len(p)), lists(p, *a))[1])
    block = neighbours.Block(space, y[order], e[order], np.ones(2048, np.int64), np.zeros(2048))
    p, d, _, _ = block.nearest(x, c, np.full(500, np.inf), 5)
    want = np.sort(((x[:, None] - y[None]) ** 2).sum(axis=2), axis=1)[:, :5]
    np.testing.assert_allclose(d.reshape(500, 5), want)
    assert listed[0] < 12 * 500
