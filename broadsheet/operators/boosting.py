"""Boosted trees by second-order steps on binned sparse features.

Each feature's present values are cut into bins at their quantiles; a value that is absent,
or zero, goes to the side of a split that gains more. A tree is grown level by level. For a
level every task sums gradients and curvatures of its rows by node, feature and bin; one
shuffle by feature adds the sums of all tasks, and the best split of each node is picked from
them. Sums are integers, so they do not depend on the order of rows, and neither do the trees.

The sums of a level are bounded by nodes, features and bins, not by rows. A node with so few
rows that one task can surely hold them is not grown level by level: its rows go to one task, which
grows everything below it, all such nodes of a tree in one job. The splits are the same. Rows keep the
margin of the trees so far in a table that is written anew every few trees.

A tree takes at least one job that way, and what a job costs besides its work is most of the time of
many rounds over few rows. If one task can hold all rows, packed by row and by feature, it grows all trees
of a model, and there is one job a model. The trees are the same.

Several models grow side by side: a row takes no part in the model of its own fold, and all
models share one binned table and one pass per level, or have a task each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import discard, stored

ROWS_AT_A_TIME = 1024  # rows that a task holds as a matrix of bins
PARTS = 16  # groups of features whose splits are looked for side by side
UNIT = 1 << 30  # sums of gradients are kept in these parts of one
COMPACT_AT = 2_000_000  # sums a task holds before it adds equal ones
TASK_CELLS = 4_000_000  # present values, and rows with them, that one task may hold
WHOLE_CELLS = 50_000_000  # numbers of 8 bytes that a task may hold which grows all trees of a model
EXACT_ROWS = 1 << 22  # rows whose sums are whole in floating point
CELLS_AT_A_TIME = 1 << 16  # of these present values, those summed at a time
CODES_AT_A_TIME = 1 << 20  # sorted at a time
FEATURES_AT_A_TIME = 256  # whose splits are compared at a time
BINS = 1 << 15  # bins are short integers
SUMS = "part int, sums binary"
SPLITS = (
    "model int, node int, feature int, bin int, absent_left boolean, gain double, "
    "gl bigint, hl bigint, nl bigint, g bigint, h bigint, n bigint"
)
LOOSE = "model int, node int, places array<int>, bins array<smallint>, g bigint, h bigint"
GROWN = "model int, node int, feature int, bin int, absent_left boolean, value double"
WHOLE = "tree int, node int, feature int, bin int, absent_left boolean, value double"


@dataclass
class Settings:
    rounds: int = 300
    rate: float = 0.1
    depth: int = 6
    rows: float = 0.8
    features: float = 0.8
    ridge: float = 1.0
    least_curvature: float = 1.0
    bins: int = 32
    refresh: int = 25
    seed: int = 42

    def may_split(self, h: int) -> bool:
        """Whether a node's curvature is enough for two children."""
        return h >= 2 * self.least_curvature * UNIT


@dataclass
class Tree:
    """Nodes as a heap: the children of i are 2i + 1 and 2i + 2; a leaf has feature -1."""

    size: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    absent_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        self.feature = np.full(self.size, -1, np.int64)
        self.bin = np.zeros(self.size, np.int64)
        self.absent_left = np.zeros(self.size, bool)
        self.value = np.zeros(self.size)


def nodes_of(trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row (first axis) in each tree (second); bins below 0 are absent."""
    feature = np.array([t.feature for t in trees])
    edge = np.array([t.bin for t in trees])
    absent_left = np.array([t.absent_left for t in trees])
    tree = np.arange(len(trees))[None, :]
    rows = np.arange(len(bins))[:, None]
    at = np.zeros((len(bins), len(trees)), np.int64)
    for _ in range(depth):
        asked = feature[tree, at]
        found = bins[rows, np.maximum(asked, 0)]
        right = np.where(found < 0, ~absent_left[tree, at], found > edge[tree, at])
        at = np.where(asked < 0, at, 2 * at + 1 + right)
    return at


def margins_of(trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    """The sum of the trees' values for each row, added in the order of the trees."""
    total = np.zeros(len(bins))
    if trees:
        at = nodes_of(trees, bins, depth)
        for i, tree in enumerate(trees):
            total += tree.value[at[:, i]]
    return total


def drawn_rows(row: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Whether each row takes part in a tree: a hash of both below the share."""
    mixed = row.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) % 2**64)
    for shift in (30, 27):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return mixed < np.uint64(min(int(share * 2**64), 2**64 - 1))


def drawn_features(count: int, tree: int, share: float, seed: int) -> np.ndarray:
    random = np.random.default_rng([seed, tree])
    return np.sort(random.permutation(count)[: max(1, round(share * count))])


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss, as whole numbers of 1 / UNIT."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - label) * UNIT).astype(np.int64), np.rint(p * (1.0 - p) * UNIT).astype(np.int64)


def present(features: str) -> tuple[Column, Column]:
    """Places and values of what is not zero in a vector column."""
    raw = F.unwrap_udt(features)
    places = F.when(raw["type"] == 0, raw["indices"]).otherwise(F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    both = F.filter(F.arrays_zip(places.alias("i"), raw["values"].alias("v")), lambda x: x["v"] != 0)
    return F.transform(both, lambda x: x["i"]), F.transform(both, lambda x: x["v"])


def edges_of(rows: DataFrame, bins: int) -> dict[int, np.ndarray]:
    """The upper edges of each feature's bins: its quantiles, or all its values if they are fewer."""
    cells = rows.select(F.explode(F.arrays_zip("places", "values")).alias("x")).select("x.places", "x.values")
    shares = [(i + 1) / bins for i in range(bins)]
    cut = F.percentile_approx("values", shares, 10_000).alias("edges")
    # One row per feature.
    return {r.places: np.unique(r.edges) for r in cells.groupBy("places").agg(cut).collect()}


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of each element of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _found(places: np.ndarray, values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many edges of its feature are below each value; `table` has a row of edges for each feature."""
    at = np.zeros(len(places), np.int64)
    first, values = places.astype(np.int64) * table.shape[1], np.where(np.isnan(values), np.inf, values)
    step = table.shape[1] // 2
    while step:
        at += step * (table.ravel()[first + at + step - 1] < values)
        step //= 2
    return at


def _edge_table(edges: dict[int, np.ndarray]) -> np.ndarray:
    """The edges of a feature as a row, which ends in infinite ones up to a power of two."""
    most = max((len(own) for own in edges.values()), default=0)
    table = np.full((max(edges, default=0) + 1, 1 << most.bit_length()), np.inf)
    for feature, own in edges.items():
        table[feature, : len(own)] = np.where(np.isnan(own), np.inf, own)
    return table


def binned(rows: DataFrame, edges: dict[int, np.ndarray], models: int) -> DataFrame:
    """(row, label, fold, margins, places, bins): the rows as bins, with a margin of 0 for each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _edge_table(edges)
        for batch in batches:
            sizes = np.diff(batch.column("places").offsets.to_numpy())
            found = _found(_lists(batch.column("places"))[1], _lists(batch.column("values"))[1], table)
            bins = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(found.astype(np.int16)))
            zero = pa.array([[0.0] * models] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "label", "fold")), zero, batch.column("places"), bins],
                names=["row", "label", "fold", "margins", "places", "bins"],
            )

    return rows.mapInArrow(run, "row bigint, label double, fold int, margins array<double>, places array<int>, bins array<smallint>")


class _Batch:
    """Some rows of the binned table as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.row = batch.column("row").to_numpy()
        self.label = batch.column("label").to_numpy()
        self.fold = batch.column("fold").to_numpy()
        self.margins = _lists(batch.column("margins"))[1].reshape(batch.num_rows, -1)
        self.of, self.places = _lists(batch.column("places"))
        self.cell_bins = _lists(batch.column("bins"))[1]
        self.bins = np.full((batch.num_rows, width), -1, np.int16)
        self.bins[self.of, self.places] = self.cell_bins


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, _Batch]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_A_TIME):
            part = batch.slice(first, ROWS_AT_A_TIME)
            yield part, _Batch(part, width)


def _keys(owner, feature, bin_, width: int) -> np.ndarray:
    """Node, feature and bin as one number, whose order is that of the three. Feature -1 stands for the whole row."""
    return (owner * (width + 1) + feature + 1) * BINS + bin_


def _keyed(keys: np.ndarray, width: int, size: int) -> np.ndarray:
    """Model, node, feature and bin of each key; `size` is the number of nodes that a model may have."""
    owner, feature = np.divmod(keys // BINS, width + 1)
    return np.stack([owner // size, owner % size, feature - 1, keys % BINS])


def _cells(of, places, bins, owner, own, takes, g, h, width: int) -> np.ndarray:
    """Sums of single rows: key, gradient, curvature, rows."""
    inside = np.flatnonzero(own)
    cells = np.flatnonzero(own[of] & takes[places])
    of = of[cells]
    keys = np.r_[_keys(owner[of], places[cells].astype(np.int64), bins[cells], width), _keys(owner[inside], -1, 0, width)]
    return np.stack([keys, np.r_[g[of], g[inside]], np.r_[h[of], h[inside]], np.ones(len(keys), np.int64)])


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """Sums with equal keys made one, in the order of the keys."""
    every = np.concatenate(parts, axis=1)
    return _merged(every[:, np.argsort(every[0])])


def _merged(every: np.ndarray) -> np.ndarray:
    """The same for sums that are in order."""
    if not every.shape[1]:
        return every
    first = np.flatnonzero(np.r_[True, np.diff(every[0]) != 0])
    return np.concatenate([every[:1, first], np.add.reduceat(every[1:], first, axis=1)])


def surely_fit(sizes: list[tuple[int, int]], room: int) -> int:
    """The most rows of which any choice fits: a row takes its size and one more; `sizes` has (size, rows)."""
    fit = 0
    for size, rows in sorted(sizes, reverse=True):
        now = min(rows, room // (size + 1))
        fit, room = fit + now, room - now * (size + 1)
        if now < rows:
            break
    return fit


class Growth:
    """Models that grow side by side over one binned table."""

    def __init__(self, table: DataFrame, width: int, models: int, settings: Settings):
        self.table, self.width, self.models, self.settings = table, width, models, settings
        self.trees: list[list[Tree]] = [[] for _ in range(models)]
        self.kept = 0  # trees whose values the table's margins hold
        # One row for each fold and number of present values, of which there are `width` at most.
        most = F.max(F.array_max("bins")).alias("most")
        sizes = table.groupBy("fold", F.size("places").alias("size")).agg(F.count(F.lit(1)).alias("n"), most).collect()
        self.rows = sum(r.n for r in sizes)
        self.few = surely_fit([(r["size"], r.n) for r in sizes], TASK_CELLS)
        self.stride = 1 + max((r.most for r in sizes if r.most is not None), default=0)
        # Rows and present values of each model.
        own = [[r for r in sizes if r.fold != model] for model in range(models)]
        self.sizes = [(sum(r.n for r in rs), sum(r["size"] * r.n for r in rs)) for rs in own]

    def fits_whole(self) -> bool:
        """Whether one task can hold the rows of a model: 8 bytes a present value, some numbers a row, and some sums."""
        return all(
            rows < EXACT_ROWS and cells + 16 * (rows + self.width * self.stride) <= WHOLE_CELLS for rows, cells in self.sizes
        )

    def grow_whole(self) -> None:
        """All trees, those of a model in one task."""
        width, stride, set_ = self.width, self.stride, self.settings

        def trees_of(model: int) -> list[Tree]:
            sizes = self.sizes[model]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield from _Whole(batches, model, sizes, width, stride, set_).grown()

            trees = [Tree(2 ** (set_.depth + 1) - 1) for _ in range(set_.rounds)]
            # One row for each node of a tree.
            for r in self.table.coalesce(1).mapInArrow(run, WHOLE).collect():
                tree = trees[r.tree]
                tree.feature[r.node], tree.bin[r.node], tree.absent_left[r.node] = r.feature, r.bin, r.absent_left
                tree.value[r.node] = r.value
            return trees

        with ThreadPool(self.models) as pool:
            self.trees = pool.map(inheritable_thread_target(self.table.sparkSession)(trees_of), range(self.models))

    def refresh(self) -> None:
        """Write the table anew with the margins of all trees, and delete the old one."""
        table = stored(self.with_margins(), "boosted-rows")
        discard(self.table)
        self.table, self.kept = table, len(self.trees[0])

    def with_margins(self) -> DataFrame:
        width, depth, fresh = self.width, self.settings.depth, [t[self.kept :] for t in self.trees]
        some = self.settings.refresh

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw, rows in _batches(batches, width):
                margins = rows.margins
                for first in range(0, len(fresh[0]), some):
                    margins = margins + np.column_stack([margins_of(t[first : first + some], rows.bins, depth) for t in fresh])
                place = raw.schema.get_field_index("margins")
                yield raw.set_column(place, "margins", pa.array(margins.tolist(), pa.list_(pa.float64())))

        return self.table.mapInArrow(run, self.table.schema)

    def held_out(self) -> DataFrame:
        """(fold, label, margin) of each row, by the model that its fold took no part in."""
        width, depth, fresh = self.width, self.settings.depth, [t[self.kept :] for t in self.trees]
        some = self.settings.refresh

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _batches(batches, width):
                margin = rows.margins[np.arange(len(rows.fold)), rows.fold]
                for model in np.unique(rows.fold).tolist():
                    own = np.flatnonzero(rows.fold == model)
                    for first in range(0, len(fresh[model]), some):
                        margin[own] += margins_of(fresh[model][first : first + some], rows.bins[own], depth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.fold), pa.array(rows.label.astype(np.int32)), pa.array(margin)], names=["fold", "label", "margin"]
                )

        return self.table.mapInArrow(run, "fold int, label int, margin double")

    def grow(self) -> None:
        """One more tree for each model."""
        set_ = self.settings
        number = len(self.trees[0])
        if number - self.kept >= set_.refresh:
            self.refresh()
        takes = np.zeros(self.width, bool)
        takes[drawn_features(self.width, number, set_.features, set_.seed)] = True
        trees = [Tree(2 ** (set_.depth + 1) - 1) for _ in range(self.models)]
        small: set[tuple[int, int]] = set()
        large: set[tuple[int, int]] = set()
        for model in range(self.models):
            (small if self.rows <= self.few else large).add((model, 0))
        for _ in range(set_.depth):
            if not large:
                break
            splits = self.best_splits(trees, large, takes, number)
            large = set()
            for (model, node), s in splits.items():
                tree = trees[model]
                if s["feature"] < 0:
                    tree.value[node] = self.leaf(s["g"], s["h"])
                    continue
                tree.feature[node], tree.bin[node], tree.absent_left[node] = s["feature"], s["bin"], s["absent_left"]
                for child, g, h, n in (
                    (2 * node + 1, s["gl"], s["hl"], s["nl"]),
                    (2 * node + 2, s["g"] - s["gl"], s["h"] - s["hl"], s["n"] - s["nl"]),
                ):
                    tree.value[child] = self.leaf(g, h)
                    if 2 * child + 1 < tree.size and set_.may_split(h):
                        (small if n <= self.few else large).add((model, child))
        if small:
            self.finish(trees, small, takes, number)
        for model, tree in enumerate(trees):
            self.trees[model].append(tree)

    def leaf(self, g: int, h: int) -> float:
        return _leaf(g, h, self.settings)

    def _open_rows(self, trees: list[Tree], nodes: set[tuple[int, int]], number: int):
        """A function from a batch of rows to (model, node of each row, whether it takes part, g, h)
        for each model; the rows that take part are drawn for the tree and are in one of the nodes."""
        set_, fresh = self.settings, [t[self.kept :] for t in self.trees]
        wanted = np.zeros((self.models, trees[0].size), bool)
        for model, node in nodes:
            wanted[model, node] = True

        def run(rows: _Batch):
            drawn = drawn_rows(rows.row, number, set_.rows, set_.seed)
            for model in np.flatnonzero(wanted.any(axis=1)).tolist():
                margin = rows.margins[:, model] + margins_of(fresh[model], rows.bins, set_.depth)
                g, h = gradients(margin, rows.label)
                node = nodes_of([trees[model]], rows.bins, set_.depth)[:, 0]
                yield model, node, drawn & (rows.fold != model) & wanted[model, node], g, h

        return run

    def best_splits(
        self, trees: list[Tree], nodes: set[tuple[int, int]], takes: np.ndarray, number: int
    ) -> dict[tuple[int, int], dict]:
        """The best split of each open node, with feature -1 where none gains."""
        set_, width, open_rows = self.settings, self.width, self._open_rows(trees, nodes, number)

        size = 2 ** (set_.depth + 1)

        def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            done = _added(held)
            feature = done[0] // BINS % (width + 1) - 1
            # Every group of features needs the sums of whole nodes.
            parts = [np.flatnonzero((feature < 0) | (feature % PARTS == part)) for part in range(PARTS)]
            packed = pa.array([np.ascontiguousarray(done[:, part]).tobytes() for part in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), packed], names=["part", "sums"])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for _, rows in _batches(batches, width):
                for model, node, own, g, h in open_rows(rows):
                    held.append(_cells(rows.of, rows.places, rows.cell_bins, model * size + node, own, takes, g, h, width))
                if sum(part.shape[1] for part in held) > COMPACT_AT:
                    held = [_added(held)]
                    if held[0].shape[1] > COMPACT_AT // 2:
                        yield from dealt(held)
                        held = []
            if held:
                yield from dealt(held)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for part, packed in zip(batch.column("part").to_pylist(), batch.column("sums")):
                    own = held.setdefault(part, [])
                    own.append(np.frombuffer(packed.as_buffer(), np.int64).reshape(4, -1))
                    # Those added last are added up once they are as many as the first.
                    if len(own) > 2 and sum(p.shape[1] for p in own[1:]) > max(own[0].shape[1], COMPACT_AT // PARTS):
                        held[part] = [_added(own)]
            for own in held.values():
                done = _added(own)
                yield from _best(np.concatenate([_keyed(done[0], width, size), done[1:]]), set_).to_batches()

        # The sums travel packed: a task sends a few rows for each group of features.
        added = self.table.mapInArrow(sums, SUMS).repartition(PARTS, "part")
        # At most PARTS rows for each open node.
        found = added.mapInArrow(best, SPLITS).collect()
        out: dict[tuple[int, int], dict] = {}
        for r in found:
            old, key = out.get((r.model, r.node)), (-r.gain, r.feature, r.bin, not r.absent_left)
            if old is None or (r.feature >= 0 and (old["feature"] < 0 or key < old["key"])):
                out[r.model, r.node] = r.asDict() | {"key": key}
        return out

    def finish(self, trees: list[Tree], nodes: set[tuple[int, int]], takes: np.ndarray, number: int) -> None:
        """Grow all that is below some small nodes, each in one task."""
        set_, width, open_rows = self.settings, self.width, self._open_rows(trees, nodes, number)

        def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw, rows in _batches(batches, width):
                for model, node, own, g, h in open_rows(rows):
                    inside = pa.array(np.flatnonzero(own))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(inside), model), pa.int32()),
                            pa.array(node[own]).cast(pa.int32()),
                            raw.column("places").take(inside),
                            raw.column("bins").take(inside),
                            pa.array(g[own]),
                            pa.array(h[own]),
                        ],
                        names=["model", "node", "places", "bins", "g", "h"],
                    )

        def below(rows: pa.Table) -> pa.Table:
            return _subtree(rows.combine_chunks(), width, takes, set_)

        rows = self.table.mapInArrow(loose, LOOSE)
        # One row for each node of a tree.
        for r in rows.groupBy("model", "node").applyInArrow(below, GROWN).collect():
            tree = trees[r.model]
            tree.feature[r.node], tree.bin[r.node], tree.absent_left[r.node] = r.feature, r.bin, r.absent_left
            tree.value[r.node] = r.value


def _leaf(g: int, h: int, set_: Settings) -> float:
    return -set_.rate * (int(g) / UNIT) / (int(h) / UNIT + set_.ridge)


def _subtree(rows: pa.Table, width: int, takes: np.ndarray, set_: Settings) -> pa.Table:
    """All nodes from one on, grown level by level within a task."""
    model, top = rows.column("model")[0].as_py(), rows.column("node")[0].as_py()
    of, places = _lists(rows.column("places").chunk(0))
    cell_bins = _lists(rows.column("bins").chunk(0))[1]
    g, h = rows.column("g").to_numpy(), rows.column("h").to_numpy()
    # In order of feature and bin once; what is chosen of them keeps that order.
    cells = _cells(of, places, cell_bins, np.zeros(len(g), np.int64), np.ones(len(g), bool), takes, g, h, width)
    of = np.r_[of[takes[places]], np.arange(len(g))]
    order = np.argsort(cells[0], kind="stable")
    cells, of = cells[:, order], of[order]
    tree = Tree(2 ** (set_.depth + 1) - 1)
    tree.value[top] = _leaf(g.sum(), h.sum(), set_)
    node = np.full(len(g), top, np.int64)
    nodes, sums = [top], {top: _merged(cells)} if 2 * top + 1 < tree.size else {}
    while sums:
        keyed = [_keyed(_keys(model * 2 ** (set_.depth + 1) + at, -1, sums[at][0], width), width, 2 ** (set_.depth + 1)) for at in sorted(sums)]
        found = _best(np.concatenate([np.concatenate(keyed, axis=1), np.concatenate([sums[at][1:] for at in sorted(sums)], axis=1)]), set_)
        pairs = []  # parent, child with fewer rows and its sibling, where one of the two may be split
        for s in found.to_pylist():
            at = s["node"]
            if s["feature"] < 0:
                continue
            tree.feature[at], tree.bin[at], tree.absent_left[at] = s["feature"], s["bin"], s["absent_left"]
            asked = np.full(len(g), -1, np.int64)
            there = slice(*np.searchsorted(cells[0], [_keys(0, s["feature"], 0, width), _keys(0, s["feature"] + 1, 0, width)]))
            asked[of[there]] = cells[0, there] % BINS
            inside = np.flatnonzero(node == at)
            asked = asked[inside]
            node[inside] = 2 * at + 1 + np.where(asked < 0, not s["absent_left"], asked > s["bin"])
            tree.value[2 * at + 1] = _leaf(s["gl"], s["hl"], set_)
            tree.value[2 * at + 2] = _leaf(s["g"] - s["gl"], s["h"] - s["hl"], set_)
            nodes += [2 * at + 1, 2 * at + 2]
            halves = s["hl"], s["h"] - s["hl"]
            may = {2 * at + 1 + i for i in range(2) if set_.may_split(halves[i])}
            if may and 2 * (2 * at + 1) + 1 < tree.size:
                left_is_less = 2 * s["nl"] <= s["n"]
                pairs.append((at, 2 * at + 2 - left_is_less, 2 * at + 1 + left_is_less, may))
        # Only the smaller of two children is summed; the sums of the other are what is left of the parent's.
        chosen = np.zeros(tree.size, bool)
        chosen[[less for _, less, _, _ in pairs]] = True
        inside = np.flatnonzero(chosen[node][of])
        owner = node[of[inside]].astype(np.int16)
        order = np.argsort(owner, kind="stable")
        inside, owner = inside[order], owner[order]
        below = {}
        for at, less, more, may in pairs:
            own = _merged(cells[:, inside[slice(*np.searchsorted(owner, [less, less + 1]))]])
            if less in may:
                below[less] = own
            if more in may:
                rest = sums[at].copy()
                rest[1:, np.searchsorted(rest[0], own[0])] -= own[1:]
                below[more] = rest[:, rest[3] > 0]
        sums = below
    at = np.array(nodes)
    return pa.table(
        {
            "model": pa.array(np.full(len(at), model), pa.int32()),
            "node": pa.array(at, pa.int32()),
            "feature": pa.array(tree.feature[at], pa.int32()),
            "bin": pa.array(tree.bin[at], pa.int32()),
            "absent_left": pa.array(tree.absent_left[at]),
            "value": pa.array(tree.value[at]),
        }
    )


class _Whole:
    """All rows of one model in a task, and its trees.

    `codes` has the feature and bin of each present value by row; `rows` has the rows of each code. Sums are
    whole numbers of 1 / UNIT, as floats, which are exact for so few rows; those of a node are a matrix by feature and bin.
    """

    def __init__(
        self, batches: Iterator[pa.RecordBatch], model: int, sizes: tuple[int, int], width: int, stride: int, set_: Settings
    ):
        self.width, self.stride, self.set_ = width, stride, set_
        of_rows, n, cells = [], 0, 0
        self.codes, self.begins = np.empty(sizes[1], np.int32), np.zeros(sizes[0] + 1, np.int64)
        for batch in batches:
            # The rows of the model's own fold are no use.
            part = batch.filter(pa.array(batch.column("fold").to_numpy() != model))
            if part.num_rows:
                of, places = _lists(part.column("places"))
                codes = places.astype(np.int32) * np.int32(stride) + _lists(part.column("bins"))[1]
                self.codes[cells : cells + len(codes)] = codes
                self.begins[n + 1 : n + 1 + part.num_rows] = cells + np.cumsum(np.bincount(of, minlength=part.num_rows))
                n, cells = n + part.num_rows, cells + len(codes)
                of_rows.append((part.column("row").to_numpy(), part.column("label").to_numpy()))
        self.n, self.codes, self.begins = n, self.codes[:cells], self.begins[: n + 1]
        self.row, self.label = (np.concatenate(x) for x in zip(*of_rows)) if of_rows else (np.zeros(0, np.int64), np.zeros(0))
        self.from_, self.rows = self._by_code()
        self.there = np.flatnonzero(np.diff(self.from_))  # codes that a row has
        self.place = np.full(width * stride, -1, np.int32)
        self.base, self.fresh = np.zeros(n), np.zeros(n)

    def _by_code(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each code begin, and the rows in the order of codes; sorted by groups of codes."""
        counts = np.zeros(self.width * self.stride, np.int64)
        for first in range(0, len(self.codes), CODES_AT_A_TIME):
            counts += np.bincount(self.codes[first : first + CODES_AT_A_TIME], minlength=len(counts))
        begins, rows = np.r_[0, np.cumsum(counts)], np.empty(len(self.codes), np.int32)
        most, low = max(CODES_AT_A_TIME, len(rows) // 16), 0
        while low < len(counts):
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + most, "right")) - 1)
            own = np.flatnonzero((self.codes >= low) & (self.codes < high))
            keys = self.codes[own].astype(np.int64) << 32
            keys |= np.searchsorted(self.begins, own, "right") - 1
            keys.sort()
            rows[begins[low] : begins[high]] = keys & 0xFFFFFFFF
            low = high
        return begins, rows

    def grown(self) -> Iterator[pa.RecordBatch]:
        """The nodes of each tree."""
        for number in range(self.set_.rounds if self.n else 0):
            # Margins are added as those of a table that is written anew every few trees.
            if number and number % self.set_.refresh == 0:
                self.base, self.fresh = self.base + self.fresh, np.zeros(self.n)
            tree, nodes = self.tree(number)
            at = np.array(nodes, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), number), pa.int32()),
                    pa.array(at, pa.int32()),
                    pa.array(tree.feature[at], pa.int32()),
                    pa.array(tree.bin[at], pa.int32()),
                    pa.array(tree.absent_left[at]),
                    pa.array(tree.value[at]),
                ],
                names=["tree", "node", "feature", "bin", "absent_left", "value"],
            )

    def tree(self, number: int) -> tuple[Tree, list[int]]:
        """A tree and its nodes."""
        set_, stride = self.set_, self.stride
        tree, nodes = Tree(2 ** (set_.depth + 1) - 1), []
        g, h = gradients(self.base + self.fresh, self.label)
        drawn = drawn_rows(self.row, number, set_.rows, set_.seed)
        if not drawn.any():
            return tree, nodes
        weights = [np.where(drawn, g, 0) / UNIT, np.where(drawn, h, 0) / UNIT]
        if (h[drawn] == 0).any():
            weights.append(drawn.astype(float))  # else a bin has rows where its curvature is not 0
        total = [int(g[drawn].sum()), int(h[drawn].sum())]
        tree.value[0] = _leaf(*total, set_)
        features = drawn_features(self.width, number, set_.features, set_.seed)
        # Node, its rows, features that may split it, their sums, its sums.
        todo = [(0, np.arange(self.n, dtype=np.int32), features, None, total)] if tree.size > 1 else []
        ends = [] if todo else [(0, np.arange(self.n))]
        right = np.zeros(self.n, bool)
        while todo:
            at, rows, features, sums, total = todo.pop()
            if sums is None:
                sums = self.by_feature(features, weights)
            # A side of a split has all its present values or all of what is left of them: with less curvature
            # in all than a child must have, a feature splits neither this node nor those below.
            enough = sums[1].sum(axis=1) >= set_.least_curvature
            if enough.sum() < 0.9 * len(enough):
                features, sums = features[enough], sums[:, enough]
            found = self.split(features, sums, total)
            if found is None:
                ends.append((at, rows))
                continue
            feature, bin_, absent_left, left = found
            tree.feature[at], tree.bin[at], tree.absent_left[at] = feature, bin_, absent_left
            first, edge, last = feature * stride, feature * stride + bin_ + 1, (feature + 1) * stride
            odd = self.rows[self.from_[edge] : self.from_[last]] if absent_left else self.rows[self.from_[first] : self.from_[edge]]
            right[odd] = True
            other = right[rows]
            right[odd] = False
            halves = [(2 * at + 1, rows[other != absent_left], left), (2 * at + 2, rows[other == absent_left], [total[0] - left[0], total[1] - left[1]])]
            for child, _, both in halves:
                tree.value[child] = _leaf(*both, set_)
            may = [2 * child + 1 < tree.size and set_.may_split(both[1]) for child, _, both in halves]
            if any(may):
                # Only the smaller of two children is summed; the sums of the other are what is left of the parent's.
                own = [own[drawn[own]] for _, own, _ in halves]
                less = int(len(own[1]) < len(own[0]))
                below = self.sums_of(own[less], features, weights)
                below = [sums - below, below] if less else [below, sums - below]
            for i, (child, own, both) in enumerate(halves):
                if may[i]:
                    todo.append((child, own, features, below[i], both))
                else:
                    ends.append((child, own))
            nodes += [2 * at + 1, 2 * at + 2]
        for at, rows in ends:
            self.fresh[rows] += tree.value[at]
        return tree, [0, *nodes]

    def split(self, features: np.ndarray, sums: np.ndarray, total: list[int]) -> tuple[int, int, bool, list[int]] | None:
        """Feature, bin, side of absent values and sums of the left side of the best split, if one gains."""
        set_, (tg, th), best = self.set_, (x / UNIT for x in total), None
        whole = tg * tg / (th + set_.ridge) if th + set_.ridge else 0.0
        for first in range(0, len(features), FEATURES_AT_A_TIME):
            part = sums[:, first : first + FEATURES_AT_A_TIME]
            upto, some = np.cumsum(part[:2], axis=2), part[-1] > 0
            for absent_left in (True, False):
                # The side without the absent values, and the other one.
                g, h = upto[:, :, -1:] - upto if absent_left else upto
                fits = np.flatnonzero(some & (h >= set_.least_curvature) & (th - h >= set_.least_curvature))
                g, h = g.take(fits), h.take(fits)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = 0.5 * (g**2 / (h + set_.ridge) + (tg - g) ** 2 / (th - h + set_.ridge) - whole)
                gain = np.where(gain > 1e-12, gain, 0.0)
                at = int(gain.argmax()) if len(gain) else 0  # the first of equal ones
                if not len(gain) or not gain[at]:
                    continue
                i, bin_ = divmod(int(fits[at]), self.stride)
                key = (-gain[at], first + i, bin_, not absent_left)
                if best is None or key < best[0]:
                    side = [int(g[at] * UNIT), int(h[at] * UNIT)]
                    best = key, [total[0] - side[0], total[1] - side[1]] if absent_left else side
        if best is None:
            return None
        (_, i, bin_, absent_right), left = best
        return int(features[i]), bin_, not absent_right, left

    def sums_of(self, rows: np.ndarray, features: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        """Sums over some rows, from their present values or from those of the features, whichever is less work."""
        sizes, codes = self.begins[rows + 1] - self.begins[rows], features * self.stride
        if 2 * sizes.sum() > (self.from_[codes + self.stride] - self.from_[codes]).sum():
            only = np.zeros(self.n, bool)
            only[rows] = True
            return self.by_feature(features, [np.where(only, w, 0.0) for w in weights])
        if sizes.sum() > self.width * self.stride // 2:
            # So many that sums of all features cost less than to look where those of the wanted ones go.
            sums = np.zeros((len(weights), self.width * self.stride))
            for own, size in _pieces(rows, sizes, 4 * CELLS_AT_A_TIME):
                at = self.codes.take(_spans(self.begins.take(own), size)).astype(np.intp)
                for into, w in zip(sums, weights):
                    into += np.bincount(at, np.repeat(w.take(own), size), len(into))
            return sums.reshape(len(weights), self.width, self.stride)[:, features]
        place, held = self.place.reshape(self.width, self.stride), []
        count = len(features) * self.stride
        place[features] = np.arange(count, dtype=np.int32).reshape(len(features), self.stride)
        for own, size in _pieces(rows, sizes, CELLS_AT_A_TIME):
            at = self.place.take(self.codes.take(_spans(self.begins.take(own), size)))
            inside = np.flatnonzero(at >= 0)
            held.append((at.take(inside), *(np.repeat(w.take(own), size).take(inside) for w in weights)))
        place[features] = -1
        at, *each = (np.concatenate(x) for x in zip(*held)) if held else [np.zeros(0, np.int32)] * (1 + len(weights))
        return np.stack([np.bincount(at, own, count) for own in each]).reshape(len(weights), len(features), self.stride)

    def by_feature(self, features: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        """Sums over all rows, from the rows of each feature and bin."""
        wanted = np.zeros(self.width, bool)
        wanted[features] = True
        codes = self.there
        # Passing over a few features that are not wanted is less work than picking the others.
        if 2 * len(features) < self.width:
            codes = codes[wanted.take(codes // self.stride)]
        sums = np.zeros((len(weights), self.width * self.stride))
        sizes = self.from_[codes + 1] - self.from_[codes]
        for own, size in _pieces(codes, sizes, CELLS_AT_A_TIME):
            first, last = self.from_[own[0]], self.from_[own[-1] + 1]
            together = last - first == size.sum()
            at = (self.rows[first:last] if together else self.rows.take(_spans(self.from_.take(own), size))).astype(np.intp)
            starts = np.cumsum(size) - size
            for into, w in zip(sums, weights):
                into[own] = np.add.reduceat(w.take(at), starts)
        return sums.reshape(len(weights), self.width, self.stride)[:, features]


def _pieces(items: np.ndarray, sizes: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items and their sizes, so many at a time as have room, but one at least."""
    ends, low = np.cumsum(sizes), 0
    while low < len(items):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + room, "right")))
        yield items[low:high], sizes[low:high]
        low = high


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans, each of some size from a first one on."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _best(sums: np.ndarray, set_: Settings) -> pa.Table:
    """The best split of each node among some features, from sums in the order of their keys."""
    model, node, feature, bin_, g, h, n = sums
    size = 2 ** (set_.depth + 1)
    owner = model * size + node
    whole = feature < 0
    owners, totals = owner[whole], np.stack([g, h, n])[:, whole]
    at = np.searchsorted(owners, owner[~whole])
    feature_, bins, cells = feature[~whole], bin_[~whole], np.stack([g, h, n])[:, ~whole]
    starts = np.r_[True, (np.diff(at) != 0) | (np.diff(feature_) != 0)][: len(at)]
    first, group = np.flatnonzero(starts), np.cumsum(starts) - 1
    summed = np.cumsum(cells, axis=1)
    upto = summed - (summed - cells)[:, first][:, group]
    ends = np.r_[first[1:], len(at)][: len(first)] - 1
    absent = totals[:, at] - upto[:, ends][:, group]
    left = np.concatenate([upto, upto + absent], axis=1)
    absent_left = np.r_[np.zeros(len(at), bool), np.ones(len(at), bool)]
    at, feature_, bins = np.tile(at, 2), np.tile(feature_, 2), np.tile(bins, 2)
    right = totals[:, at] - left

    def worth(sums: np.ndarray) -> np.ndarray:
        return (sums[0] / UNIT) ** 2 / (sums[1] / UNIT + set_.ridge)

    gain = 0.5 * (worth(left) + worth(right) - worth(totals)[at])
    least = set_.least_curvature * UNIT
    fits = np.flatnonzero((left[1] >= least) & (right[1] >= least) & (gain > 1e-12))
    most = np.zeros(len(owners))
    np.maximum.at(most, at[fits], gain[fits])
    fits = fits[gain[fits] == most[at[fits]]]
    ranked = fits[np.lexsort((~absent_left[fits], bins[fits], feature_[fits], at[fits]))]
    top = ranked[np.r_[True, np.diff(at[ranked]) != 0][: len(ranked)]]
    none = np.setdiff1d(np.arange(len(owners)), at[top])
    who, blank = np.r_[at[top], none], np.zeros(len(none), np.int64)
    return pa.table(
        {
            "model": pa.array(owners[who] // size, pa.int32()),
            "node": pa.array(owners[who] % size, pa.int32()),
            "feature": pa.array(np.r_[feature_[top], blank - 1], pa.int32()),
            "bin": pa.array(np.r_[bins[top], blank], pa.int32()),
            "absent_left": pa.array(np.r_[absent_left[top], blank > 0]),
            "gain": pa.array(np.r_[gain[top], blank.astype(float)]),
            **{name: pa.array(np.r_[left[i, top], blank]) for i, name in enumerate(("gl", "hl", "nl"))},
            **{name: pa.array(totals[i, who]) for i, name in enumerate(("g", "h", "n"))},
        }
    )


class BoostedTrees:
    """A fitted model: trees whose splits are values of features."""

    def __init__(self, trees: list[Tree], edges: dict[int, np.ndarray], depth: int):
        self.trees, self.depth = trees, depth
        self.used = sorted({int(f) for t in trees for f in t.feature if f >= 0})
        self.edges = {f: edges[f] for f in self.used}

    def margin(self, features: str) -> Column:
        """The sum of the trees' values for a vector column."""
        used, edges, trees, depth = {f: i for i, f in enumerate(self.used)}, self.edges, self.trees, self.depth
        # The trees ask for the place of a feature among those used.
        own = []
        for t in trees:
            copy = Tree(t.size)
            copy.feature = np.array([used.get(int(f), -1) for f in t.feature])
            copy.bin, copy.absent_left, copy.value = t.bin, t.absent_left, t.value
            own.append(copy)

        @F.pandas_udf("double")
        def run(places, values):
            import pandas as pd

            out = []
            for first in range(0, len(places), ROWS_AT_A_TIME):
                part = slice(first, first + ROWS_AT_A_TIME)
                bins = np.full((len(places[part]), max(1, len(used))), -1, np.int16)
                for i, (ps, vs) in enumerate(zip(places[part], values[part])):
                    for p, v in zip(ps, vs):
                        if p in used:
                            # Beyond the last edge everything is to the right.
                            bins[i, used[p]] = np.searchsorted(edges[p], v)
                out.append(margins_of(own, bins, depth))
            return pd.Series(np.concatenate(out) if out else np.zeros(0))

        return run(*present(features))

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """The rows with `score`, the probability of label 1, and `prediction`; the vector goes."""
        scored = df.withColumn("score", 1 / (1 + F.exp(-self.margin(features))))
        return scored.withColumn("prediction", (F.col("score") > 0.5).cast("double")).drop(features)

    def to_rows(self) -> list[tuple]:
        return [
            (i, n, int(t.feature[n]), float(self.edges[int(t.feature[n])][t.bin[n]]) if t.feature[n] >= 0 else None, bool(t.absent_left[n]), float(t.value[n]))
            for i, t in enumerate(self.trees)
            for n in range(t.size)
        ]

    ROWS = "tree int, node int, feature int, edge double, absent_left boolean, value double"

    @classmethod
    def from_rows(cls, rows: list[tuple]) -> BoostedTrees:
        size = max(r[1] for r in rows) + 1
        trees = [Tree(size) for _ in range(max(r[0] for r in rows) + 1)]
        edges: dict[int, np.ndarray] = {}
        for f in {r[2] for r in rows if r[2] >= 0}:
            edges[f] = np.unique([r[3] for r in rows if r[2] == f])
        for i, n, f, edge, absent_left, value in rows:
            t = trees[i]
            t.feature[n], t.absent_left[n], t.value[n] = f, absent_left, value
            t.bin[n] = np.searchsorted(edges[f], edge) if f >= 0 else 0
        return cls(trees, edges, size.bit_length() - 1)


def _grown(df: DataFrame, features: str, label: str, fold: Column, models: int, settings: Settings):
    places, values = present(features)
    # Equal rows are told apart by nothing, and are drawn together.
    number = F.xxhash64(*[c for c in df.columns if c != features], places, values)
    rows = df.select(
        number.alias("row"), F.col(label).cast("double").alias("label"), fold.cast("int").alias("fold"), places.alias("places"), values.alias("values")
    )
    rows = stored(rows, "boosted-values")
    edges = edges_of(rows, settings.bins)
    width = max(edges, default=0) + 1
    growth = Growth(stored(binned(rows, edges, models), "boosted-rows"), width, models, settings)
    discard(rows)
    if growth.fits_whole():
        growth.grow_whole()
    else:
        for _ in range(settings.rounds):
            growth.grow()
    return growth, edges


def fit(df: DataFrame, settings: Settings | None = None, features: str = "features", label: str = "label") -> BoostedTrees:
    """Boosted trees for a label of 0 or 1; the other columns only tell equal vectors apart."""
    settings = settings or Settings()
    growth, edges = _grown(df, features, label, F.lit(-1), 1, settings)
    discard(growth.table)
    return BoostedTrees(growth.trees[0], edges, settings.depth)


def cross_margins(
    df: DataFrame, key: str, folds: int = 5, settings: Settings | None = None, features: str = "features", label: str = "label"
) -> DataFrame:
    """(fold, label, margin) of every row, by the model that its fold took no part in.

    Rows go to folds by the hash of their key; all models grow in one pass per level.
    """
    settings = settings or Settings()
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    growth, _ = _grown(df, features, label, fold, folds, settings)
    margins = stored(growth.held_out(), "boosted-margins")
    discard(growth.table)
    return margins
