"""Centroid clustering with Orchard's search (operator 11).

Vectors become integers, floor(scale * x), so that every distance, mean and tie is exact and
the result does not depend on how rows are dealt. Each round finds the nearest centroid of
every vector and replaces each centroid by the floored mean of its vectors.

The search is Orchard's: every centroid has a list of the others by distance. A vector starts
at one centroid and reads that one's list; as soon as it meets a closer centroid it goes over
to the list of that one. A mark on each centroid seen spares a second look. By the triangle
inequality no centroid farther from the current one than twice the vector's own distance can
be closer; the search stops strictly beyond, so that ties are still met. All vectors of an
Arrow batch take their steps together.

A task gives one row per centroid, its sums and its count; these are added by component, so
neither a task nor the driver holds more than the centroids.

Vectors that are null, have another number of components than asked for, hold nulls, NaN or
infinities, or components so large that squared distances leave 64 bits (2**16 at 64 components
and a scale of 1024) take no part. Rows with a null id are clustered and counted but start no
centroid. Rows that repeat an id are vectors of their own; where the hashes of the first
centroids tie, the smaller vector comes first. With fewer vectors than centroids there are as
many centroids as vectors. Sums beyond 64 bits are null. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import stored

RESULT = (
    "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
)


def integer_vectors(
    df: DataFrame, components: int, scale: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, point): the vectors that take part, as integers."""
    most = math.isqrt(2**58 // components)  # four times a squared distance stays below 2**63
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    fits = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(most)))
    rows = rows.where((F.size("vec") == components) & fits)
    return rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("int")).alias("point"))


def points_of(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


class Orchard:
    """Centroids with their neighbours by distance."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.centroids = centroids
        self.lists = np.zeros((k, k), np.int32)
        # The last entry of a list lies beyond every distance and ends the search.
        self.gaps = np.full((k, k), np.iinfo(np.int64).max)
        total = np.zeros(k, np.float64)
        for i in range(k):
            gap = ((centroids - centroids[i]) ** 2).sum(axis=1)
            total[i] = gap.sum(dtype=np.float64)
            others = np.delete(np.arange(k), i)
            order = others[np.argsort(gap[others], kind="stable")]
            self.lists[i, : k - 1], self.gaps[i, : k - 1] = order, gap[order]
        self.start = int(total.argmin())

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each point, the smaller number of equal ones; the squared
        distance; and how many distances were computed."""
        n = len(points)
        best = np.full(n, self.start, np.int32)
        far = ((points - self.centroids[self.start]) ** 2).sum(axis=1)
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[:, self.start] = True
        place = np.zeros(n, np.int32)
        active, looked = np.arange(n), n
        while len(active):
            active = active[self.gaps[best[active], place[active]] <= 4 * far[active]]
            other = self.lists[best[active], place[active]]
            place[active] += 1
            fresh = ~seen[active, other]
            rows, other = active[fresh], other[fresh]
            seen[rows, other] = True
            gap = ((points[rows] - self.centroids[other]) ** 2).sum(axis=1)
            looked += len(rows)
            closer = (gap < far[rows]) | ((gap == far[rows]) & (other < best[rows]))
            rows = rows[closer]
            best[rows], far[rows], place[rows] = other[closer], gap[closer], 0
        return best, far, looked


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of '<seed>:<id>', in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    named = points.where("vec_id is not null").select(digest.alias("digest"), "point")
    rows = named.orderBy("digest", "point").limit(k).collect()
    return np.array([r.point for r in rows], np.int64)


def next_centroids(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored mean of the vectors nearest to each centroid; one without any stays."""
    orchard, components = Orchard(centroids), centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One more component counts the vectors.
        total = np.zeros((len(orchard.centroids), components + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                own = points_of(batch.column("point"), components)
                best, _, _ = orchard.nearest(own)
                order = np.argsort(best, kind="stable")
                held, first = np.unique(best[order], return_index=True)
                total[held, :components] += np.add.reduceat(own[order], first, axis=0)
                total[:, components] += np.bincount(best, minlength=len(total))
        held = np.flatnonzero(total[:, components])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(total[held].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "sums"],
        )

    parts = points.select("point").mapInArrow(sums, "cluster int, sums array<bigint>")
    spread = parts.select("cluster", F.posexplode("sums").alias("place", "part"))
    rows = spread.groupBy("cluster", "place").agg(F.sum("part").alias("total")).collect()
    total = {(r.cluster, r.place): r.total for r in rows}
    moved = centroids.copy()
    for cluster in range(len(centroids)):
        count = total.get((cluster, components), 0)
        if count:
            moved[cluster] = [total[cluster, place] // count for place in range(components)]
    return moved


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    orchard, components = Orchard(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, far, _ = orchard.nearest(points_of(batch.column("point"), components))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(best), pa.array(far)], names=["vec_id", "cluster", "distance"]
                )

    return points.select("vec_id", "point").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    components: int = 64,
    scale: int = 1024,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    `k` centroids and their lists, k * k entries, go to every task: some thousands at most.
    """
    spark = df.sparkSession
    points = stored(integer_vectors(df, components, scale, key, vector), "points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        moved = next_centroids(points, centroids)
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved
    found = stored(assign(points, centroids), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    totals = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(exact).collect()}
    whole = sum(totals.values())

    def fitting(n: int) -> int | None:
        return n if n < 2**63 else None

    about = [
        (i, fitting(totals.get(i, 0)), fitting(whole), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    each = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per centroid.
    return found.join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
