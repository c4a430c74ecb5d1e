"""Boosted trees against a plain version that holds all rows in one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.operators import boosting as bo

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("features", VectorUDT())]
)


def make(n, width, seed=0, share=0.4):
    rnd = np.random.default_rng(seed)
    x = np.where(rnd.random((n, width)) < share, rnd.integers(1, 12, (n, width)) / 4, 0.0)
    signal = x[:, 0] - 2 * (x[:, 1] > 1) + (x[:, 2] == 0) * x[:, 3] + rnd.normal(0, 0.5, n)
    return x, (signal > np.median(signal)).astype(int)


def table(spark, x, y):
    rows = []
    for i, (v, label) in enumerate(zip(x, y)):
        at = np.flatnonzero(v)
        vector = Vectors.dense(v) if i % 5 == 0 else SparseVector(len(v), at.tolist(), v[at].tolist())
        rows.append((i, int(label), vector))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def plain(bins, y, row, taken, set_, rounds):
    """Trees as nested tuples, by trying every split of every node."""
    margin, trees = np.zeros(len(y)), []
    for number in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g = np.rint((p - y) * bo.UNIT).astype(np.int64)
        h = np.rint(p * (1 - p) * bo.UNIT).astype(np.int64)
        features = bo.drawn_features(bins.shape[1], number, set_.features, set_.seed)
        drawn = taken & bo.drawn_rows(row, number, set_.rows, set_.seed)

        def worth(a, b):
            return (a / bo.UNIT) ** 2 / (b / bo.UNIT + set_.ridge)

        def leaf(rows):
            return -set_.rate * (g[rows].sum() / bo.UNIT) / (h[rows].sum() / bo.UNIT + set_.ridge)

        def grow(rows, depth):
            options = []
            for f in features if depth else ():
                own = bins[rows, f]
                for b in np.unique(own[own >= 0]):
                    for absent_left in (True, False):
                        left = np.where(own < 0, absent_left, own <= b)
                        a, c = rows[left], rows[~left]
                        if h[a].sum() >= set_.least_curvature * bo.UNIT and h[c].sum() >= set_.least_curvature * bo.UNIT:
                            gain = 0.5 * (
                                worth(g[a].sum(), h[a].sum()) + worth(g[c].sum(), h[c].sum()) - worth(g[rows].sum(), h[rows].sum())
                            )
                            if gain > 1e-12:
                                options.append((-gain, f, b, not absent_left, a, c))
            if not options:
                return leaf(rows)
            _, f, b, right, a, c = min(options, key=lambda o: o[:4])
            return (int(f), int(b), not right, grow(a, depth - 1), grow(c, depth - 1))

        tree = grow(np.flatnonzero(drawn), set_.depth)
        trees.append(tree)

        def value(tree, v):
            while isinstance(tree, tuple):
                f, b, absent_left, left, right = tree
                tree = left if (absent_left if v[f] < 0 else v[f] <= b) else right
            return tree

        margin = margin + np.array([value(tree, v) for v in bins])
    return trees, margin


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return (
        int(tree.feature[node]), int(tree.bin[node]), bool(tree.absent_left[node]),
        nested(tree, 2 * node + 1), nested(tree, 2 * node + 2),
    )


def matrix(growth_rows, width):
    rows = sorted(growth_rows, key=lambda r: r.row)
    bins = np.full((len(rows), width), -1)
    for i, r in enumerate(rows):
        bins[i, r.places] = r.bins
    return rows, bins


@pytest.mark.parametrize("few", [0, 150, 1000])
def test_equals_plain_version(spark, monkeypatch, few):
    """Level by level, in part, and within tasks altogether."""
    x, y = make(1000, 12)
    monkeypatch.setattr(bo, "TASK_CELLS", few * 12)
    set_ = bo.Settings(rounds=7, depth=3, bins=6, refresh=3)
    df = table(spark, x, y)
    growth, edges = bo._grown(df, "features", "label", F.lit(-1), 1, set_)
    assert growth.few >= few and (few or not growth.few)
    growth.refresh()
    rows, bins = matrix(growth.table.collect(), growth.width)
    label, row = np.array([r.label for r in rows]), np.array([r.row for r in rows])
    trees, margin = plain(bins, label, row, np.ones(len(rows), bool), set_, set_.rounds)
    assert [nested(t) for t in growth.trees[0]] == trees
    assert any(isinstance(t, tuple) and isinstance(t[3], tuple) for t in trees)
    assert np.allclose([r.margins[0] for r in rows], margin, atol=1e-12)
    # The fitted model scores vectors as the table's margins say.
    model = bo.BoostedTrees(growth.trees[0], edges, set_.depth)
    again = bo.BoostedTrees.from_rows(model.to_rows())
    want = sorted(margin)
    for m in (model, again):
        assert np.allclose(sorted(r.m for r in df.select(m.margin("features").alias("m")).collect()), want, atol=1e-12)


def test_folds_grow_side_by_side(spark):
    """Each of the models equals one grown alone on the rows of the other folds."""
    x, y = make(400, 6, seed=2)
    set_ = bo.Settings(rounds=3, depth=2, bins=4)
    df = table(spark, x, y)
    fold = F.pmod(F.xxhash64("id"), F.lit(3))
    growth, _ = bo._grown(df, "features", "label", fold, 3, set_)
    rows, bins = matrix(growth.table.collect(), growth.width)
    label, row, folds = (np.array([r[c] for r in rows]) for c in ("label", "row", "fold"))
    for i in range(3):
        trees, _ = plain(bins, label, row, folds != i, set_, set_.rounds)
        assert [nested(t) for t in growth.trees[i]] == trees
    out = bo.cross_margins(df, "id", 3, set_).collect()
    assert len(out) == 400 and {r.fold for r in out} == {0, 1, 2}


def test_learns_and_bounds(spark):
    x, y = make(800, 10, seed=5)
    model = bo.fit(table(spark, x, y), bo.Settings(rounds=25, depth=3))
    test_x, test_y = make(400, 10, seed=6)
    scored = model.score(table(spark, test_x, test_y)).collect()
    assert np.mean([r.prediction == r.label for r in scored]) > 0.8
    assert all(0 < r.score < 1 for r in scored)


@pytest.mark.parametrize("labels", [[1, 1, 1], []])
def test_one_class_and_no_rows(spark, labels):
    rows = [(i, v, Vectors.sparse(4, {})) for i, v in enumerate(labels)]
    model = bo.fit(spark.createDataFrame(rows, SCHEMA), bo.Settings(rounds=2, depth=2))
    scored = model.score(spark.createDataFrame([(9, 0, Vectors.dense([1.0, 0.0, 0.0, 2.0]))], SCHEMA)).first()
    assert scored.score > 0.5 if labels else scored.score == 0.5


def test_rows_that_surely_fit():
    assert bo.surely_fit([(3, 10)], 40) == 10
    assert bo.surely_fit([(1, 100), (9, 2)], 30) == 2 + 5  # the largest first
    assert bo.surely_fit([(99, 1)], 50) == 0
    # Two rows with many values among many short ones do not send all rows level by level.
    assert bo.surely_fit([(2000, 2), (160, 16_000)], bo.TASK_CELLS) == 16_002


def test_a_tree_within_a_task_sums_the_smaller_child_only(monkeypatch):
    """The larger child has what is left, and trees are those of whole sums."""
    random = np.random.default_rng(5)
    rows, width, set_ = 600, 12, bo.Settings(least_curvature=0.5)
    given = random.random((rows, width)) < 0.4
    bins = random.integers(0, 6, (rows, width))
    label = (bins[:, 0] * given[:, 0] + random.random(rows) * 2 > 2).astype(float)
    g, h = bo.gradients(random.normal(0, 0.3, rows), label)
    table = pa.table({
        "model": pa.array([2] * rows, pa.int32()), "node": pa.array([0] * rows, pa.int32()),
        "places": pa.array([np.flatnonzero(r).tolist() for r in given], pa.list_(pa.int32())),
        "bins": pa.array([b[r].tolist() for b, r in zip(bins, given)], pa.list_(pa.int16())), "g": g, "h": h,
    })
    takes, seen, best = np.arange(width) != 3, [], bo._best
    monkeypatch.setattr(bo, "_best", lambda sums, s: (seen.append(sums), best(sums, s))[1])
    summed, merged = [], bo._merged
    monkeypatch.setattr(bo, "_merged", lambda c: (summed.append(c.shape[1]), merged(c))[1])
    grown = {r["node"]: r for r in bo._subtree(table, width, takes, set_).to_pylist()}
    cells = (given[:, takes].sum() + rows)
    assert summed[0] == cells and summed[1] < 0.6 * cells
    # Every sum that a split was chosen from, again from the rows of its node.
    dense, node = np.where(given, bins, -1), np.zeros(rows, int)
    for level in seen:
        for at in np.unique(level[1]):
            inside = node == at
            for feature in np.flatnonzero(takes):
                for b in range(6):
                    cell = inside & (dense[:, feature] == b)
                    told = level[4:, (level[1] == at) & (level[2] == feature) & (level[3] == b)]
                    assert told.sum(axis=1).tolist() == [g[cell].sum(), h[cell].sum(), cell.sum()]
        for at in np.unique(node):
            r = grown[at]
            if r["feature"] >= 0:
                inside, asked = node == at, dense[:, r["feature"]]
                right = np.where(asked < 0, not r["absent_left"], asked > r["bin"])
                node[inside] = 2 * at + 1 + right[inside]
    assert len(seen) > 2


@pytest.mark.parametrize("few", [0, 150, 1000])
def test_rows_that_one_task_may_not_hold(spark, monkeypatch, few):
    """Without a task that holds all rows, trees grow in jobs and are the same."""
    whole = bo.Growth.grow_whole
    monkeypatch.setattr(bo.Growth, "grow_whole", lambda self: pytest.fail("a task held all rows"))
    monkeypatch.setattr(bo, "WHOLE_CELLS", 0)
    test_equals_plain_version(spark, monkeypatch, few)
    monkeypatch.setattr(bo.Growth, "grow_whole", whole)


def test_jobs_do_not_grow_with_rounds(spark):
    """All trees of a model are one job: before, each took one or more."""
    x, y = make(300, 6, seed=3)
    df, tracker = table(spark, x, y).cache(), spark.sparkContext.statusTracker()
    df.count()
    jobs = {}
    for rounds in (2, 40):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "")
        growth, _ = bo._grown(df, "features", "label", F.pmod(F.xxhash64("id"), F.lit(2)), 2, bo.Settings(rounds=rounds, depth=2))
        jobs[rounds] = len(tracker.getJobIdsForGroup(f"rounds {rounds}"))
        assert [len(trees) for trees in growth.trees] == [rounds] * 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[40] == jobs[2] < 20


def test_sums_of_all_paths_are_equal(monkeypatch):
    """Sums by row, by feature and over all features, in pieces of any size; bins without curvature keep their rows."""
    random = np.random.default_rng(8)
    given, bins = random.random((200, 9)) < 0.5, random.integers(0, 5, (200, 9))
    rows = pa.record_batch({
        "row": pa.array(random.integers(-(2**62), 2**62, 200)), "label": random.integers(0, 2, 200).astype(float),
        "fold": pa.array(random.integers(0, 3, 200), pa.int32()),
        "places": pa.array([np.flatnonzero(r).tolist() for r in given], pa.list_(pa.int32())),
        "bins": pa.array([b[r].tolist() for b, r in zip(bins, given)], pa.list_(pa.int16())),
    })
    for room in (1, 50, 1 << 16):
        monkeypatch.setattr(bo, "CELLS_AT_A_TIME", room)
        monkeypatch.setattr(bo, "CODES_AT_A_TIME", room)
        held = bo._Whole(iter([rows.slice(0, 90), rows.slice(90)]), 1, (200, int(given.sum())), 9, 5, bo.Settings())
        kept = np.flatnonzero(rows.column("fold").to_numpy() != 1)
        assert held.n == len(kept) and held.row.tolist() == rows.column("row").to_numpy()[kept].tolist()
        weights = [random.integers(-50, 50, held.n) / 4, np.ones(held.n)]
        features = np.array([0, 2, 3, 7])
        for some in (np.arange(3), np.arange(0, held.n, 9), np.arange(held.n // 3), np.arange(held.n)):
            want = np.zeros((2, 4, 5))
            for i in some:
                for at, feature in enumerate(features):
                    if given[kept[i], feature]:
                        want[:, at, bins[kept[i], feature]] += weights[0][i], 1
            assert (held.sums_of(some, features, weights) == want).all()
        want = held.sums_of(np.arange(held.n), np.arange(9), weights)
        assert (held.by_feature(features, weights) == want[:, features]).all()
    # A row that is surely told has no curvature, and its bin still has a row.
    held.fresh[:] = np.where(held.label > 0, 99.0, -99.0)
    tree, nodes = held.tree(0)
    assert nodes == [0] and tree.feature[0] == -1


def test_bins_of_values():
    """The edges below a value, as a search in the edges of its feature finds them."""
    edges = {0: np.array([0.5]), 2: np.array([-1.0, 0.25, 0.5, 2.0]), 3: np.arange(32.0)}
    random = np.random.default_rng(3)
    places, values = random.choice([0, 1, 2, 3], 500), random.choice([-2.0, -1, 0.25, 0.3, 0.5, 2, 3, 30.5, 31, 99, np.inf], 500)
    want = [int(np.searchsorted(edges[p], v)) if p in edges else 0 for p, v in zip(places, values)]
    assert bo._found(places, values, bo._edge_table(edges)).tolist() == want
    assert bo._edge_table({}).shape == (1, 1)
