"""Exact dedup against a minimal perfect hash of historical digests (operator 5).

Texts are equal when they are the same after lower-casing A-Z; of equal ones the largest key
stays. The history is an index made once and kept as a table: its distinct digests are dealt
to shards by hash, and each shard is a minimal perfect hash, one displacement per bucket of
keys, whose slots hold the full digest and the locator of the winner. A new digest is looked
up in one slot of its shard and compared byte by byte; members join the group they were
found in, all others are grouped by themselves. Where a shard has more new digests than a task
should hold, they are dealt into parts, and each part gets the shard's index row.

Texts are read once, for their digests. Copies are counted before every shuffle, so a text
that is a third of all rows is one row per task; the one join by digest is a plain sort-merge
join, in which Spark splits such a key.

Null text counts as empty, and all empty texts are equal. A null key is below all others.
Rows that repeat key and text are one document: in `deduplicate` all are marked alike, with
`row` given one of them stays. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import text_rows
from broadsheet.session import stored

KEYS_PER_SHARD = 20_000  # on average: what one task holds of the index
KEYS_PER_BUCKET = 3
MAX_TRIES = 1 << 22
_WORD = (1 << 64) - 1

INDEX_DDL = (
    "shard long, displacements binary, digests binary, "
    "doc_ids array<bigint>, rows array<bigint>, copies array<bigint>"
)
FOUND_DDL = (
    "digest binary, doc_id bigint, row bigint, copies bigint, "
    "old_doc_id bigint, old_row bigint, old_copies bigint"
)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, row, digest): SHA-256 of each text in UTF-8 with A-Z lower-cased."""
    number = F.col(row).cast("long") if row else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Lower-casing bytes changes A-Z alone.
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = [hashlib.sha256(t.lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(made, pa.binary())],
                names=["doc_id", "row", "digest"],
            )

    rows = text_rows(docs, key, text, number.alias("row"))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, digest binary")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest (doc_id, row) and the number of rows."""
    last = F.max(F.struct("doc_id", "row")).alias("last")
    groups = rows.groupBy("digest").agg(last, F.count(F.lit(1)).alias("copies"))
    return groups.select("digest", "last.doc_id", "last.row", "copies")


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: each has a slot of its own.

    The digest's first word plus the displacement times its second gives the slot, its third
    word the bucket. A
    bucket gets the first displacement that puts all its keys on free slots, large buckets
    first; a bucket of one key is pointed at any free slot, as a negative number.
    """

    def __init__(self, displacements: np.ndarray, size: int):
        self.displacements, self.size = displacements, size

    @staticmethod
    def words(data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<u8").reshape(-1, 4)

    @classmethod
    def build(cls, data: bytes) -> PerfectHash:
        words = cls.words(data)
        n = len(words)
        buckets = n // KEYS_PER_BUCKET + 1
        of = (words[:, 2] % np.uint64(buckets)).astype(np.int64)
        sizes = np.bincount(of, minlength=buckets)
        members = np.split(np.argsort(of, kind="stable"), np.cumsum(sizes)[:-1])
        base, step = words[:, 0].tolist(), words[:, 1].tolist()
        displacements = np.zeros(buckets, np.int64)
        taken = bytearray(n)
        order = np.argsort(-sizes, kind="stable")
        for bucket in order[sizes[order] > 1].tolist():
            keys = members[bucket].tolist()
            for d in range(MAX_TRIES):
                slots = {((base[k] + d * step[k] & _WORD) >> 32) % n for k in keys}
                if len(slots) == len(keys) and not any(taken[s] for s in slots):
                    break
            else:
                raise ValueError("no displacement found: are the digests distinct?")
            displacements[bucket] = d
            for s in slots:
                taken[s] = 1
        free = (s for s in range(n) if not taken[s])
        for bucket in order[sizes[order] == 1].tolist():
            displacements[bucket] = -next(free) - 1
        return cls(displacements, n)

    def slots(self, data: bytes) -> np.ndarray:
        """The one slot in which each digest may be; any slot for a digest not in the set."""
        words = self.words(data)
        n = self.size
        d = self.displacements[(words[:, 2] % np.uint64(len(self.displacements))).astype(np.int64)]
        turned = words[:, 0] + np.maximum(d, 0).astype(np.uint64) * words[:, 1]
        spun = ((turned >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        return np.where(d < 0, -d - 1, spun)


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def write_index(groups: DataFrame, path: str, keys_per_shard: int = KEYS_PER_SHARD) -> int:
    """The index of historical groups as a table at `path`; returns the number of shards."""
    shards = max(1, -(-groups.count() // keys_per_shard))

    def build(table: pa.Table) -> pa.Table:
        data = b"".join(table.column("digest").to_pylist())
        made = PerfectHash.build(data)
        place = np.argsort(made.slots(data))
        sorted_table = table.take(pa.array(place))
        row = {
            "shard": table.column("shard")[:1].to_pylist(),
            "displacements": [made.displacements.astype("<i8").tobytes()],
            "digests": [b"".join(sorted_table.column("digest").to_pylist())],
            "doc_ids": [sorted_table.column("doc_id").to_pylist()],
            "rows": [sorted_table.column("row").to_pylist()],
            "copies": [sorted_table.column("copies").to_pylist()],
        }
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(row.items(), _INDEX_TYPES)})

    sharded = groups.withColumn("shard", _shard(shards))
    sharded.groupBy("shard").applyInArrow(build, INDEX_DDL).write.parquet(path)
    return shards


_LIST = pa.list_(pa.int64())
_INDEX_TYPES = [pa.int64(), pa.binary(), pa.binary(), _LIST, _LIST, _LIST]


def _dealt(groups: DataFrame, shards: int, part_keys: int) -> tuple[DataFrame, int]:
    """The groups with `shard` and `part`, and how many parts of about `part_keys` a shard has."""
    parts = max(1, -(-groups.count() // (shards * part_keys)))
    part = F.pmod(F.xxhash64("digest", F.lit("part")), F.lit(parts)).cast("int")
    return groups.withColumns({"shard": _shard(shards), "part": part}), parts


def lookup(groups: DataFrame, path: str, shards: int, part_keys: int = KEYS_PER_SHARD) -> DataFrame:
    """The groups with what the index holds for their digest, null where it holds nothing."""
    index = groups.sparkSession.read.schema(INDEX_DDL).parquet(path)
    sharded, parts = _dealt(groups, shards, part_keys)
    # In all, the repeated rows hold at most about as many digests as the groups.
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def find(new: pa.Table, held: pa.Table) -> pa.Table:
        wanted = new.column("digest").to_pylist()
        places = [None] * len(wanted)
        if held.num_rows and wanted:
            row = held.to_pylist()[0]
            size = len(row["digests"]) // 32
            table = PerfectHash(np.frombuffer(row["displacements"], "<i8"), size)
            for i, slot in enumerate(table.slots(b"".join(wanted)).tolist()):
                if row["digests"][32 * slot : 32 * slot + 32] == wanted[i]:
                    places[i] = slot
        found = {
            f"old_{out}": pa.array([None if p is None else row[name][p] for p in places], pa.int64())
            for name, out in (("doc_ids", "doc_id"), ("rows", "row"), ("copies", "copies"))
        }
        kept = {c: new.column(c) for c in ("digest", "doc_id", "row", "copies")}
        return pa.table(kept | found)

    both = sharded.groupBy("shard", "part").cogroup(index.groupBy("shard", "part"))
    return both.applyInArrow(find, FOUND_DDL)


def groups_with_history(history: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of all digests of two tables of (doc_id, row, digest).

    The history is indexed at `path`; the fresh rows are looked up in it.
    """
    old = stored(grouped(history), "history")
    new = stored(grouped(fresh), "fresh")
    found = stored(lookup(new, path, write_index(old, path)), "found")
    new_last, old_last = F.struct("doc_id", "row"), F.struct("old_doc_id", "old_row")
    newer = F.col("old_copies").isNull() | (new_last >= old_last)
    members_and_new = found.select(
        "digest",
        F.when(newer, F.col("doc_id")).otherwise(F.col("old_doc_id")).alias("keep_id"),
        F.when(newer, F.col("row")).otherwise(F.col("old_row")).alias("keep_row"),
        (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("group_size"),
    )
    met = found.where("old_copies is not null").select("digest")
    only_old = old.join(met, "digest", "left_anti").select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size")
    )
    return members_and_new.unionByName(only_old)


def deduplicate(
    docs: DataFrame, index_path: str, key: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """(doc_id, row, digest, keep_id, keep_row, group_size, kept), one row per document.

    The lower half of the key range is the history, the rest is checked against it.
    """
    rows = stored(digests(docs, key, text, row), "digests")
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    middle = 0 if ends.a is None else ends.a + (ends.b - ends.a) // 2
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    groups = groups_with_history(rows.where(early), rows.where(~early), index_path)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return rows.join(groups, "digest").withColumn("kept", kept)
