"""Token ids of whole documents in bit-packed files (operator 1).

A file is one shard: a run of documents in ascending key order. Its records are blocks, each
holding whole documents and about `block_ids` ids in the fewest bits the vocabulary allows.
A record has the place of its first id within the shard, the keys and lengths of its
documents (the offsets into the block) and the packed bytes. Spark's Parquet writer is the
container, so that a task that is lost or run twice leaves no broken or doubled shard, and
files can live in any store that Spark writes to.

Null text counts as empty, and gives the end id alone. A null key sorts first. Rows that
repeat a key are ordered by text and kept. Other columns are ignored. An empty table gives
files without records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import slices, text_rows
from broadsheet.llm.vocabulary import laid_out, library_chunks

BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("first_id", pa.int64()),
        ("n_ids", pa.int64()),
        ("bits", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("data", pa.binary()),
    ]
)
BLOCK_DDL = (
    "shard int, block int, first_id bigint, n_ids bigint, bits int, "
    "doc_ids array<bigint>, lengths array<bigint>, data binary"
)
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}  # ids of whole bytes are laid out as they are in memory


def bits_for(size: int) -> int:
    """The fewest bits that tell `size` ids apart."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids at `bits` bits each, lowest bit first. Eight ids fill exactly `bits` bytes."""
    rows = -(-len(ids) // 8)
    if bits in WHOLE:
        whole = np.zeros(8 * rows, WHOLE[bits])
        whole[: len(ids)] = ids
        return whole.tobytes()
    lanes = np.zeros((rows, 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, bits + 8), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        shifted = np.ascontiguousarray(lanes[:, lane] << np.uint64(shift)).view(np.uint8)
        out[:, byte : byte + 8] |= shifted.reshape(rows, 8)
    return out[:, :bits].tobytes()


def unpack_bits(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """`count` ids from place `first` on, reading only the bytes that hold them."""
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], count, first * bits // 8).astype(np.uint32)
    start, end = first // 8, -(-(first + count) // 8)
    rows = end - start
    packed = np.zeros((rows, bits + 8), np.uint8)
    packed[:, :bits] = np.frombuffer(data, np.uint8, rows * bits, start * bits).reshape(rows, bits)
    ids = np.empty((rows, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        window = np.ascontiguousarray(packed[:, byte : byte + 8]).view(np.uint64)[:, 0]
        ids[:, lane] = (window >> np.uint64(shift)) & mask
    return ids.reshape(-1)[first - 8 * start :][:count]


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    block_ids: int = 1 << 16,
) -> None:
    """Encode every text, append `end_id`, and write the ids in ascending key order."""
    rows = text_rows(docs, key, text)
    # Range partitions are the shards: their numbers ascend with the keys.
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_chunks(tokenizer)
        bits = bits_for(max(chunks.vocabulary.size, end_id + 1))
        shard, number, placed = TaskContext.get().partitionId(), 0, 0
        keys: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def record() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [shard, number, placed, len(ids), bits, keys, [len(p) for p in parts], pack_bits(ids, bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK.types)], schema=BLOCK)

        for batch in slices(batches):
            ids, ends = laid_out(*chunks.of(batch.column("text")))
            begin = 0
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                keys.append(doc)
                parts.append(np.append(ids[begin:end], np.uint32(end_id)).astype(np.uint32))
                held += end - begin + 1
                begin = end
                if held >= block_ids:
                    yield record()
                    number, placed, held = number + 1, placed + held, 0
                    keys, parts = [], []
        if keys:
            yield record()

    ordered.mapInArrow(blocks, BLOCK_DDL).write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the number of ids in all blocks before each."""
    blocks = spark.read.schema(BLOCK_DDL).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row per shard, that is per partition of the writing job.
    placed = blocks.join(F.broadcast(bases), "shard")
    return placed.withColumn("start", F.col("base") + F.col("first_id"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files; ids are little-endian
    unsigned 32-bit integers, start counts the ids of all documents before it."""
    columns = ["start", "bits", "doc_ids", "lengths", "data"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, bits, keys, lengths, data = (batch.column(c)[i].as_py() for c in columns)
                ids = unpack_bits(data, bits, 0, sum(lengths)).astype("<u4").tobytes()
                ends = np.cumsum([0, *lengths])
                blobs = [ids[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(keys, pa.int64()),
                        "start": pa.array(start + ends[:-1], pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids": pa.array(blobs, pa.binary()),
                    }
                )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    return _placed(spark, path).select(*columns).mapInArrow(documents, schema)


def read_span(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """(start, ids): the ids from place `start` on, in the order of `start`, `count` of them.

    Random access: only blocks that overlap are unpacked, and of these only the wanted bytes.
    """
    end = start + count
    wanted = _placed(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = max(0, start - row["start"])
                n = min(end - row["start"], row["n_ids"]) - first
                ids = unpack_bits(row["data"], row["bits"], first, n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "start": pa.array([row["start"] + first], pa.int64()),
                        "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary()),
                    }
                )

    return wanted.select("start", "n_ids", "bits", "data").mapInArrow(cut, "start bigint, ids binary")
