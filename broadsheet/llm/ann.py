"""Nearest neighbours with a hierarchical k-means tree (operator 7).

The tree is fitted by k-means of k-means on a sample of at most `sample_rows` vectors, taken by
hash of their id. Every row is indexed in the leaf that it reaches by going down to the nearest
centre. A query walks the tree best bin first: a priority queue holds the branches not yet
opened by the distance of their centres, and leaves are visited in the order in which they
leave the queue. How many are visited is widened until calibration queries, whose exact
neighbours are found by brute force in blocks, reach the wanted recall. A query whose leaves
hold fewer rows than it wants goes on to the next ones.

Nearness is the inner product. Vectors get one more component that makes their lengths equal,
so that the largest product is the smallest distance in the tree; scores come from the vectors
as they are, in double precision.

A task holds a bin of neighbouring leaves, or a part of a leaf that is larger than a bin: its
rows are dealt by hash, so a vector that is a third of all rows does not make one task large. A
query goes to the bins that hold a leaf it visits. A bin that very many queries ask for is held
several times, each time for some of them.

Vectors are compared with those of their own number of components. Each number that many rows
have gets a tree of its own; vectors of rarer ones are searched as a single leaf each.

Vectors that are null, zero, or hold nulls, NaN or infinities take no part, and neither do rows
with a null id. Rows that repeat an id are rows of their own, never neighbours of that id; as a
query an id counts once for each length of its vectors, and its results are ranked together.
Equal scores are ordered by id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.session import stored

SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 200
PART_ROWS = 20_000  # rows that a task holds
ASKED_ROWS = 50_000  # queries that a task holds
LEAF_CELLS = 2_000_000  # components of all vectors of one length that are searched as a single leaf
QUERY_BLOCK = 256
RESULT = "query_id bigint, vec_id bigint, score double"


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part; vec is an array of doubles."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and vec is not null").where(~odd & F.exists("vec", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as the rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


class Tree:
    """Centres of each inner node; children that are leaves carry their number."""

    def __init__(self, centres: list[np.ndarray], children: list[list[int]], length: float):
        self.centres, self.children, self.length = centres, children, length
        self.leaves = sum(c < 0 for node in children for c in node)

    @classmethod
    def fit(cls, vectors: np.ndarray, length: float, leaves: int, depth: int = 2, rounds: int = 8) -> Tree:
        """Two levels, each node split into about the root of `leaves` children."""
        points = with_length(vectors, length)
        tree = cls([], [], length)
        branch = max(2, math.ceil(leaves ** (1 / depth)))
        random = np.random.default_rng(7)

        def grow(own: np.ndarray, levels: int) -> int:
            node = len(tree.centres)
            centres, nearest = kmeans(own, branch, rounds, random)
            tree.centres.append(centres)
            tree.children.append([])
            for i in range(len(centres)):
                inside = own[nearest == i]
                if levels > 1 and len(inside) > branch:
                    tree.children[node].append(grow(inside, levels - 1))
                else:
                    tree.leaves += 1
                    tree.children[node].append(-tree.leaves)
            return node

        grow(points, depth)
        return tree

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The branch (child of the root) and the leaf of each vector."""
        points = with_length(vectors, self.length)
        branch = distances(points, self.centres[0]).argmin(axis=1)
        leaf = np.zeros(len(points), np.int64)

        def down(node: int, rows: np.ndarray) -> None:
            nearest = distances(points[rows], self.centres[node]).argmin(axis=1)
            for i, child in enumerate(self.children[node]):
                inside = rows[nearest == i]
                if child < 0:
                    leaf[inside] = -child - 1
                elif len(inside):
                    down(child, inside)

        down(0, np.arange(len(points)))
        return branch, leaf

    def visits(
        self, query: np.ndarray, count: int, least: int = 0, sizes: dict[int, int] | None = None
    ) -> list[tuple[int, int]]:
        """(branch, leaf) of the first `count` leaves, best bin first, and of more until they hold
        `least` rows, where `sizes` has the rows by leaf."""
        norm = math.sqrt(float(query @ query))
        point = np.append(query * (self.length / norm if norm else 1.0), 0.0)
        queue: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        out: list[tuple[int, int]] = []
        held = 0
        while queue and (len(out) < count or held < least):
            _, node, branch = heapq.heappop(queue)
            if node < 0:
                out.append((branch, -node - 1))
                held += (sizes or {}).get(-node - 1, 0)
                continue
            far = distances(point[None, :], self.centres[node])[0].tolist()
            for i, child in enumerate(self.children[node]):
                heapq.heappush(queue, (far[i], child, i if node == 0 else branch))
        return out


def with_length(vectors: np.ndarray, length: float) -> np.ndarray:
    """One more component, so that all rows have the same length."""
    rest = np.maximum(length * length - np.einsum("ij,ij->i", vectors, vectors), 0.0)
    return np.column_stack([vectors, np.sqrt(rest)])


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to the squared length of each point."""
    return np.einsum("ij,ij->i", centres, centres) - 2.0 * (points @ centres.T)


def kmeans(points: np.ndarray, k: int, rounds: int, random) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[random.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        nearest = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres, distances(points, centres).argmin(axis=1)


def best(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rough: np.ndarray, rows: np.ndarray, k: int):
    """The k largest products among `rows`, with their ids, equal ones by id.

    `rough` holds the products of one large multiplication, whose rounding depends on a
    row's place; those that may be among the k largest are summed anew, alike for all.
    """
    if len(rows) > k:
        own = rough[rows]
        edge = np.partition(own, len(own) - k)[len(own) - k]
        rows = rows[own >= edge - 1e-9 * (1.0 + abs(edge))]
    exact = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][order], exact[order]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _results(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(ids) for _, ids, _ in rows]
    return pa.RecordBatch.from_pydict(
        {
            "query_id": pa.array(np.repeat([q for q, _, _ in rows], sizes), pa.int64()),
            "vec_id": pa.array(np.concatenate([ids for _, ids, _ in rows]), pa.int64()),
            "score": pa.array(np.concatenate([scores for _, _, scores in rows]), pa.float64()),
        }
    )


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): exact neighbours of a few queries, in blocks of rows."""
    ids = [q for q, _ in queries]
    vectors = np.array([v for _, v in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, keys = matrix(batch.column("vec")), batch.column("vec_id").to_numpy()
            rough = vectors @ points.T
            found = []
            for i, query in enumerate(ids):
                other = np.flatnonzero(keys != query)
                found.append((query, *best(vectors[i], points, keys, rough[i], other, k)))
            yield _results(found)

    return _ranked(rows.mapInArrow(run, RESULT), k)


def build_tree(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, leaves: int | None = None) -> Tree:
    """A tree for the rows; by default with as many leaves as the root of their number."""
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)).alias("norm")
    ).first()
    spread = 1 << 20
    # Twice the share is drawn and the first by hash are taken: never more than the bound.
    share = min(spread, math.ceil(2 * spread * sample_rows / size.n))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(spread)) < share)
    picked = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").collect()
    wanted = leaves or min(math.isqrt(size.n), len(picked) // 16)
    sample = np.array([r.vec for r in picked], np.float64)
    return Tree.fit(sample, math.sqrt(size.norm), max(1, wanted))


def index(rows: DataFrame, tree: Tree) -> DataFrame:
    """(branch, leaf, vec_id, vec) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                branch, leaf = tree.place(matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(branch, pa.int64()), pa.array(leaf, pa.int64()), *batch.columns],
                    names=["branch", "leaf", "vec_id", "vec"],
                )

    return rows.select("vec_id", "vec").mapInArrow(
        run, "branch bigint, leaf bigint, vec_id bigint, vec array<double>"
    )


def calibrated_visits(
    indexed: DataFrame, tree: Tree, queries: DataFrame, k: int, recall: float, count: int = CALIBRATION_QUERIES
) -> int:
    """The fewest leaf visits with which `count` queries find the wanted part of their neighbours."""
    picked = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(count).collect()
    exact = brute_force(indexed.select("vec_id", "vec"), [(r.vec_id, r.vec) for r in picked], k)
    leaves = indexed.select("vec_id", "leaf").distinct()
    # At most count * k rows, one for each neighbour.
    wanted = exact.join(leaves, "vec_id").select("query_id", "leaf").collect()
    order = {
        r.vec_id: {leaf: i for i, (_, leaf) in enumerate(tree.visits(np.array(r.vec), tree.leaves))} for r in picked
    }
    needed = sorted(order[r.query_id][r.leaf] + 1 for r in wanted)
    visits = 1
    while needed and sum(n <= visits for n in needed) < recall * len(needed):
        visits += 1
    return visits


def bins_of(leaf_sizes: dict[int, int], part_rows: int) -> dict[int, tuple[int, int]]:
    """Each leaf's first bin and how many bins its rows are dealt into: neighbouring leaves share
    a bin while they have at most `part_rows` rows together."""
    out: dict[int, tuple[int, int]] = {}
    number, held = 0, 0
    for leaf, n in sorted(leaf_sizes.items()):
        if held and held + n > part_rows:
            number, held = number + 1, 0
        parts = max(1, -(-n // part_rows))
        out[leaf] = (number, parts)
        held += n
        if parts > 1:
            number, held = number + parts, 0
    return out


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.95,
    key: str = "vec_id",
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    part_rows: int = PART_ROWS,
    leaves: int | None = None,
    asked_rows: int = ASKED_ROWS,
    leaf_cells: int = LEAF_CELLS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where `is_query` (a
    condition on vec_id) holds. `recall` is what the calibration queries must reach."""
    spark = df.sparkSession
    rows = stored(valid_vectors(df, key, vector), "vectors")
    lengths = rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # One row for each length with at least `leaf_cells` components in all.
    large = [r.size for r in lengths.where(F.col("size") * F.col("n") > leaf_cells).collect()]
    found = None
    for size in dict.fromkeys([most.size, *large]):
        own = rows.where(F.size("vec") == size)
        result = _search_length(own, is_query, k, recall, sample_rows, part_rows, leaves, asked_rows)
        found = result if found is None else found.unionByName(result)
    rest = rows.where(~F.size("vec").isin(most.size, *large))
    if not rest.isEmpty():
        found = found.unionByName(_single_leaves(rest, is_query, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _asked(rows: DataFrame, is_query: Column, *by: Column) -> DataFrame:
    """One row for each id that is a query, with the number of rows of that id."""
    return rows.where(is_query).groupBy("vec_id", *by).agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("own"))


_NONE = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _single_leaves(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Results of vectors that few others share their length with: a leaf for each length, small by `leaf_cells`."""
    rows = rows.withColumn("size", F.size("vec"))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _NONE
        asked, held = asked.combine_chunks(), held.combine_chunks()
        vectors, points = matrix(asked.column("vec").chunk(0)), matrix(held.column("vec").chunk(0))
        ids = held.column("vec_id").to_numpy()
        found = []
        for query, vec in zip(asked.column("vec_id").to_pylist(), vectors):
            found.append((query, *best(vec, points, ids, points @ vec, np.flatnonzero(ids != query), k)))
        return pa.Table.from_batches([_results(found)])

    queries = _asked(rows, is_query, F.col("size"))
    return queries.groupBy("size").cogroup(rows.groupBy("size")).applyInArrow(score, RESULT)


def _search_length(
    rows: DataFrame, is_query: Column, k: int, recall: float, sample_rows: int, part_rows: int, leaves: int | None, asked_rows: int
) -> DataFrame:
    """(query_id, vec_id, score) of vectors with equally many components, up to k for each bin and query."""
    queries = _asked(rows, is_query)
    tree = build_tree(rows, sample_rows, leaves)
    indexed = stored(index(rows, tree), "vector-index")
    visits = calibrated_visits(indexed, tree, queries, k, recall)
    # One row per leaf of the tree, whose number is bounded by the sample.
    leaf_sizes = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    bins = bins_of(leaf_sizes, part_rows)

    def of_leaf(which: int) -> Column:
        values = [bins.get(leaf, (0, 1))[which] for leaf in range(tree.leaves)]
        return F.element_at(F.expr(f"array({', '.join(map(str, values))})"), F.col("leaf").cast("int") + 1)

    part = F.pmod(F.xxhash64("vec_id"), of_leaf(1))
    dealt = indexed.select("leaf", "vec_id", "vec", (of_leaf(0) + part).cast("long").alias("bin"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"bin": [], "query_id": [], "leaves": [], "vec": []}
            for query, vec, own in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vec", "own"))):
                by: dict[int, list[int]] = {}
                # Rows of the query's own id may be among those held, and do not count.
                for _, leaf in tree.visits(np.array(vec), visits, k + own, leaf_sizes):
                    first, parts = bins.get(leaf, (0, 0))
                    for number in range(first, first + parts):
                        by.setdefault(number, []).append(leaf)
                for number, found in by.items():
                    for name, value in zip(out, (number, query, found, vec)):
                        out[name].append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    schema = "bin bigint, query_id bigint, leaves array<bigint>, vec array<double>"
    routed = stored(queries.mapInArrow(route, schema), "routed")
    # Bins that more queries ask for than one task holds.
    blocks = F.ceil(F.col("asked") / asked_rows).cast("long")
    busy = routed.groupBy("bin").agg(F.count(F.lit(1)).alias("asked")).where(F.col("asked") > asked_rows)
    busy = busy.select("bin", blocks.alias("blocks"))
    count = F.coalesce("blocks", F.lit(1).cast("long"))
    asking = routed.join(busy, "bin", "left").withColumn("block", F.pmod(F.xxhash64("query_id"), count)).drop("blocks")
    holding = dealt.join(busy, "bin", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            asked, held = asked.combine_chunks(), held.sort_by("leaf").combine_chunks()
            vectors, points = matrix(asked.column("vec").chunk(0)), matrix(held.column("vec").chunk(0))
            ids, leaf = held.column("vec_id").to_numpy(), held.column("leaf").to_numpy()
            numbers, starts = np.unique(leaf, return_index=True)
            ends = np.append(starts[1:], len(leaf))
            spans = {n: (a, b) for n, a, b in zip(numbers.tolist(), starts.tolist(), ends.tolist())}
            wanted = asked.column("leaves").to_pylist()
            for i, query in enumerate(asked.column("query_id").to_pylist()):
                if i % QUERY_BLOCK == 0:
                    rough = vectors[i : i + QUERY_BLOCK] @ points.T
                visited = [np.arange(*spans[n]) for n in wanted[i] if n in spans]
                if visited:
                    near = np.concatenate(visited)
                    near = near[ids[near] != query]
                    found.append((query, *best(vectors[i], points, ids, rough[i % QUERY_BLOCK], near, k)))
        return pa.Table.from_batches([_results(found)]) if found else _NONE

    both = asking.groupBy("bin", "block").cogroup(holding.drop("blocks").groupBy("bin", "block"))
    return both.applyInArrow(score, RESULT)
