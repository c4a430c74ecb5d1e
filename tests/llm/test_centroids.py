"""Centroid clustering against plain brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from compare import connect, differences

from broadsheet.llm import centroids, queries


def plain(vectors, k, rounds, seed, scale):
    """(cluster, distance) by looking at every centroid, in Python's integers."""
    points = [tuple(math.floor(scale * float(x)) for x in v) for _, v in vectors]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), p) for (i, _), p in zip(vectors, points) if i is not None]
    middle = [p for _, p in sorted(named)[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(middle))

    for _ in range(rounds):
        own = [nearest(p)[1] for p in points]
        for c in range(len(middle)):
            inside = [p for p, o in zip(points, own) if o == c]
            if inside:
                middle[c] = tuple(sum(column) // len(inside) for column in zip(*inside))
    return [(nearest(p)[1], nearest(p)[0]) for p in points], middle


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, point int, distance int")


def test_equals_sql(spark, small):
    assert differences(spark, connect(small), "op11", queries.op11_centroids, queries.OP11_SQL, small) is None


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equals_brute_force_with_ties(spark, k):
    rnd = np.random.default_rng(k)
    # Few values and many copies: distances tie, clusters stay empty.
    vectors = [(i, rnd.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    vectors += [(1000 + i, [1.0, -1.0, 0.0, 0.5]) for i in range(200)] + [(7, [0.25] * 4), (7, [0.5] * 4), (None, [1.5] * 4)]
    df = table(spark, [(i, v, "c", 1, 2) for i, v in vectors]).repartition(5)
    rows = centroids.cluster(df, k=k, rounds=4, components=4, scale=8).collect()
    want, middle = plain(vectors, k, 4, 3, 8)
    known = [(-1 if i is None else i, c, d) for (i, _), (c, d) in zip(vectors, want)]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in rows) == sorted(known)
    sums = {c: sum(d for o, d in want if o == c) for c, _ in want}
    for r in rows:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_orchard_looks_at_few():
    rnd = np.random.default_rng(1)
    middle = rnd.integers(-1000, 1000, (60, 2))
    points = middle[rnd.integers(0, 60, 4000)] + rnd.integers(-20, 20, (4000, 2))
    best, far, looked = centroids.Orchard(middle).nearest(points)
    gaps = ((points[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (best == gaps.argmin(axis=1)).all() and (far == gaps.min(axis=1)).all()
    assert looked < 0.5 * gaps.size


def test_odd_vectors_take_no_part(spark):
    odd = [None, [], [1.0], [1.0, None], [1.0, float("nan")], [float("inf"), 0.0], [1e30, 0.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, "c", 1, 2) for i, v in enumerate([*odd, [1.0, 2.0], [0.0, 0.0]])]
    found = centroids.cluster(table(spark, rows), k=8, components=2).collect()
    assert sorted((r.vec_id, r.distance) for r in found) == [(8, 0), (9, 0)]
    assert centroids.cluster(table(spark, rows[:8]), components=2).collect() == []
    assert centroids.cluster(table(spark, []), components=2).collect() == []
    unnamed = [(None, [1.0, 2.0], "c", 1, 2)]
    assert centroids.cluster(table(spark, unnamed), components=2).collect() == []
