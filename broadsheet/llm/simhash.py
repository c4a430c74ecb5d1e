"""SimHash near-duplicates found with vantage-point trees (operator 3).

The fingerprint of a text has a bit for each of 64 places, set if it is set in more than
half of the hashes of the text's word shingles. Fingerprints that differ in at most two bits
are linked; the components of these links are the groups.

The distinct fingerprints are partitioned by Hamming distance from a vantage point. The
distance is taken in several segments of the bits; the tuple of these distances is the
shard. By the triangle inequality two fingerprints within two bits differ by at most two in
the sum over the segments, so each fingerprint is also sent as a query to the shards whose
boundary it is that near to, in one of the two directions only, as links go both ways. A shard
with more rows than a task should hold is divided again by the distance from one of its own
fingerprints, until all are small enough or cannot be divided.

In a task each shard is a vantage-point tree: its fingerprints are halved by distance from
one of them, and a batch of queries goes down only those branches that the triangle bound
leaves open. A shard gives back a spanning forest of its links rather than all pairs.

Null text counts as empty; texts without words have fingerprint zero and are linked like any
other. Null keys have no component of their own: they take that of their group, or null.
Rows that repeat a key or text, and other columns, change nothing. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import slices, text_rows
from broadsheet.llm.components import components
from broadsheet.session import stored

RADIUS = 2
VANTAGE = 0x5555555555555555  # any point will do: hashes favour none
SHARD_ROWS = 100_000  # what a task should hold at a time
LEAF = 64


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; fewer words are one shingle."""
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """The SimHash of a word sequence, zero without words."""
    return majority(shingle_hashes(words, width, seed)) if words else 0


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, row: str | None = None
) -> DataFrame:
    """(doc_id, row, fp): the fingerprint of every whole text, as a signed long."""
    number = F.col(row).cast("long") if row else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            # Lower-casing and splitting bytes touch ASCII letters and white space alone.
            made = np.array([fingerprint(t.lower().split(), width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(made.view(np.int64))],
                names=["doc_id", "row", "fp"],
            )

    rows = text_rows(docs, key, text, number.alias("row"))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, fp bigint")


def segments_for(rows: int) -> int:
    """How many segments of bits keep an even shard at a few hundred fingerprints."""
    return min(8, max(4, 2 + (rows // 2_000_000).bit_length()))


def offsets(segments: int) -> np.ndarray:
    """Differences of distance tuples that two points within the radius can have, one of each
    pair of opposites, without the zero."""
    steps = product(range(-RADIUS, RADIUS + 1), repeat=segments)
    near = [s for s in steps if 0 < sum(map(abs, s)) <= RADIUS]
    return np.array([s for s in near if next(x for x in s if x) > 0], np.int64)


def _shards(distinct: DataFrame, segments: int) -> DataFrame:
    """(shard, home, fp): each fingerprint in its own shard, and as a query in near ones."""
    edges = [64 * i // segments for i in range(segments + 1)]
    masks = np.array([(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])], np.uint64)
    sizes = np.array([b - a for a, b in zip(edges, edges[1:])], np.int64)
    moves = offsets(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 20_000):
                fps = batch.column("fp").slice(first, 20_000).to_numpy().view(np.uint64)
                apart = np.bitwise_count((fps ^ np.uint64(VANTAGE))[:, None] & masks).astype(np.int64)
                reach = apart[:, None, :] + moves
                real = ((reach >= 0) & (reach <= sizes)).all(axis=2)
                who, which = np.nonzero(real)
                tuples = np.concatenate([apart, reach[who, which]])
                code = np.zeros(len(tuples), np.int64)
                for i in range(segments):
                    code = code * (int(sizes[i]) + 1) + tuples[:, i]
                out = np.concatenate([fps, fps[who]]).view(np.int64)
                home = np.arange(len(out)) < len(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), pa.array(home), pa.array(out)], names=["shard", "home", "fp"]
                )

    return distinct.mapInArrow(run, "shard bigint, home boolean, fp bigint")


def _divide(dealt: DataFrame, most: int) -> DataFrame:
    """Shards of more than `most` rows are divided by distance from one of their fingerprints,
    and again; one that a division has left with nine tenths of its rows is given up."""
    dealt = dealt.withColumn("was", F.lit(None).cast("bigint"))  # rows of the shard that it was cut from
    while True:
        sizes = dealt.groupBy("shard").agg(
            F.count(F.lit(1)).alias("n"),
            F.first("was").alias("was"),
            F.min_by("fp", F.when(F.col("home"), F.xxhash64("fp"))).alias("vantage"),
        )
        shrinks = F.col("was").isNull() | (F.col("n") < 0.9 * F.col("was"))
        heavy = stored(sizes.where((F.col("n") > most) & F.col("vantage").isNotNull() & shrinks).drop("was"), "heavy")
        if heavy.isEmpty():
            return dealt.drop("was")
        joined = dealt.join(heavy, "shard", "left")
        apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        # A query looks into every shell that its ball of the radius touches.
        shells = F.when(F.col("home"), F.array(apart)).otherwise(F.sequence(apart - RADIUS, apart + RADIUS))
        kept = F.when(F.col("vantage").isNull(), F.array(F.lit(-RADIUS - 1))).otherwise(shells)
        divided = joined.withColumn("shell", F.explode(kept))
        # Homes are also queries of the shells beyond their own.
        beyond = joined.where("home and vantage is not null").select(
            "shard",
            "vantage",
            "n",
            "was",
            F.lit(False).alias("home"),
            "fp",
            F.explode(F.sequence(apart + 1, apart + RADIUS)).alias("shell"),
        )
        every = divided.select("shard", "vantage", "n", "was", "home", "fp", "shell").unionByName(beyond)
        code = F.when(F.col("vantage").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", "vantage", "shell"))
        dealt = stored(every.select(code.alias("shard"), "home", "fp", F.coalesce("n", "was").alias("was")), "shards")


class Forest:
    """Links kept only where they join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def search(points: np.ndarray, queries: np.ndarray, forest: Forest) -> None:
    """Link every query with every point within the radius, down a vantage-point tree."""
    todo = [(points, queries)]
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) <= LEAF or len(queries) <= 8:
            rows = max(1, (1 << 20) // len(points))
            for i in range(0, len(queries), rows):
                part = queries[i : i + rows]
                near = np.bitwise_count(part[:, None] ^ points) <= RADIUS
                for q, p in np.argwhere(near).tolist():
                    forest.join(int(part[q]), int(points[p]))
            continue
        vantage = points[len(points) // 2]
        far = np.bitwise_count(points ^ vantage)
        cut = np.partition(far, len(far) // 2)[len(far) // 2]
        inside = far < cut
        if not inside.any() or inside.all():
            inside = far <= cut
        if inside.all():  # all but the vantage point at one distance
            inside = far == 0
        edge_in, edge_out = int(far[inside].max()), int(far[~inside].min())
        apart = np.bitwise_count(queries ^ vantage).astype(np.int64)
        # |d(q, v) - d(p, v)| <= d(q, p): a branch whose distances are further off is pruned.
        todo.append((points[inside], queries[apart - RADIUS <= edge_in]))
        todo.append((points[~inside], queries[apart + RADIUS >= edge_out]))


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard of a partition that is sorted by `shard`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        codes = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            if held and b > a and held[0].column("shard")[0].as_py() != codes[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, segments: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links of a spanning forest of each shard of distinct fingerprints `fp`."""
    segments = segments or segments_for(distinct.count())
    dealt = _divide(stored(_shards(distinct, segments), "shards"), shard_rows)

    def linked(shard: pa.Table) -> pa.RecordBatch:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        forest = Forest()
        search(fps[shard.column("home").to_numpy()], fps, forest)
        made = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(linked, whole_shards(batches))

    ordered = dealt.repartition("shard").sortWithinPartitions("shard")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    row: str | None = None,
    segments: int | None = None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(doc_id, row, fp, component_id, first_row): component_id is the smallest doc_id of the
    group, first_row the `row` of that document, null keys last."""
    rows = stored(fingerprints(docs, key, text, width, row), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    least = stored(rows.groupBy("fp").agg(F.min(place).alias("first")), "distinct")
    return _named(rows, least, links(least.select("fp"), segments, shard_rows))


def _named(rows: DataFrame, least: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows with the first document of the component that their fingerprint is in."""
    linked = components(linked)
    rooted = least.join(linked, least.fp == linked.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    tops = rooted.groupBy("root").agg(F.min("first").alias("top"))
    named = rooted.join(tops, "root").select(
        "fp", F.col("top")["doc_id"].alias("component_id"), F.col("top")["row"].alias("first_row")
    )
    return rows.join(named, "fp").select("doc_id", "row", "fp", "component_id", "first_row")
