"""Packing documents into sequences at a target mixture of sources (operator 4).

Each source is a queue of its documents' ids. Rounds of deficit round-robin serve the queues
in turn: a queue's deficit grows by its share of a sequence, counted in grains of a few
ids, whole grains are served and the rest is carried into the next round. What a queue has been
served after r rounds is therefore floor(r * share), up to its length, so every place in the
result can be computed where a document lies: the deficit needs no task that sees all rounds
before it, and it carries over sequences and partitions alike. When a queue runs dry, the
rounds get shorter and the others keep their proportions.

The rounds laid end to end are cut every `length` ids. What is left over at the end is cut
into sequences whose sizes are powers of two, so no id is padding.

Texts are encoded once, into a table in the shared folder; all that follows is arithmetic on
lengths, until ids are cut at the computed places. Running totals are taken in about the
square root of all rows, and of all rounds, as buckets, so no task orders a whole queue.

Null text counts as empty and gives the end id alone. A null source is a queue of its own.
Null keys and rows that repeat a key are packed like others, one document per row. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import slices, text_rows
from broadsheet.llm.vocabulary import laid_out, library_chunks
from broadsheet.session import stored

GRAIN = 128

_COLUMNS = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, source: str | None) -> DataFrame:
    """(row, doc_id, queue, n, ids) as a table; ids take two bytes where the vocabulary allows."""
    queue = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")) if source else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_chunks(tokenizer)
        kind = _id_type(chunks.vocabulary.size, end_id)
        for batch in slices(batches):
            ids, ends = laid_out(*chunks.of(batch.column("text")))
            sizes = np.diff(ends, prepend=0) + 1
            ended = np.insert(ids.astype(kind), ends, end_id)  # behind each document's last id
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("queue"), pa.array(sizes, pa.int64()), _blobs(ended, sizes)],
                names=["doc_id", "queue", "n", "ids"],
            )

    rows = text_rows(docs, key, text, queue.alias("queue"))
    made = rows.mapInArrow(run, "doc_id bigint, queue string, n bigint, ids binary")
    # Written once, so the row numbers stay what they are.
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _id_type(size: int, end_id: int) -> str:
    return "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"


def _blobs(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of so many ids, laid end to end, as binary values."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes * ids.itemsize, out=ends[1:])
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), buffers).cast(pa.binary())


def _queued(lengths: DataFrame, shares: Column, grains: int) -> DataFrame:
    """Each row with `at`, its place in its queue, the queue's length `total` and `quantum`."""
    buckets = max(1, math.isqrt(lengths.count()))
    dealt = lengths.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
    sums = dealt.groupBy("queue", "bucket").agg(F.sum("n").alias("n"))
    queue = Window.partitionBy("queue")
    sums = sums.select(
        "queue",
        "bucket",
        (F.sum("n").over(queue.orderBy("bucket")) - F.col("n")).alias("base"),
        F.sum("n").over(queue).alias("total"),
    ).withColumn("quantum", shares * grains)
    inside = Window.partitionBy("queue", "bucket").orderBy("doc_id", "row")
    placed = dealt.withColumn("upto", F.sum("n").over(inside)).join(sums, ["queue", "bucket"])
    return placed.withColumn("at", F.col("base") + F.col("upto") - F.col("n")).drop("bucket", "base", "upto")


def _served(rounds: Column, grain: int) -> Column:
    """Ids of a queue that are served after so many rounds."""
    return F.least(F.col("total"), F.floor(rounds * F.col("quantum")) * grain)


def _round_of(number: Column) -> Column:
    """The round that serves a grain of a queue: the first whose product is beyond its number."""
    quantum = F.col("quantum")
    guess = F.greatest(F.lit(1), F.ceil((number + 1) / quantum).cast("long"))
    # The quotient may be rounded to the next whole number on either side.
    early = F.when(F.floor((guess - 1) * quantum) > number, guess - 1)
    return early.when(F.floor(guess * quantum) > number, guess).otherwise(guess + 1)


def _rounds(first: Column, last: Column, low: Column, high: Column) -> Column:
    """The rounds from `first` to `last` that serve the grains from `low` to `high`, no empty ones:
    a queue with less than a grain a round skips most rounds, so its grains are unfolded."""
    sparse = F.array_distinct(F.transform(F.sequence(low, high), _round_of))
    return F.when(F.col("quantum") < 1, sparse).otherwise(F.sequence(first, last))


def _runs(queues: DataFrame, grain: int) -> DataFrame:
    """(queue, round, served, base): where in the result each queue's part of a round starts."""
    queues = queues.withColumn("grains", F.ceil(F.col("total") / grain).cast("long"))
    queues = queues.withColumn("last", _round_of(F.col("grains") - 1))
    step = max(1, math.isqrt(queues.agg(F.max("last")).first()[0] or 0))

    def block_of(number: Column) -> Column:
        return F.floor((number - 1) / step)

    every = F.sequence(F.lit(0).cast("long"), block_of(F.col("last")))
    few = F.array_distinct(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("grains") - 1), lambda g: block_of(_round_of(g)))
    )
    block = F.when(F.col("grains") <= block_of(F.col("last")), few).otherwise(every)
    blocks = queues.withColumn("block", F.explode(block))
    blocks = blocks.repartition("block")  # each task then unfolds its own rounds
    first, end = F.col("block") * step + 1, F.least(F.col("last"), (F.col("block") + 1) * step)
    low = F.floor((first - 1) * F.col("quantum"))
    high = F.least(F.col("grains"), F.floor(end * F.col("quantum"))) - 1
    blocks = blocks.withColumn("low", low).withColumn("high", high).where("low <= high")
    rounds = blocks.withColumn("round", F.explode(_rounds(first, end, F.col("low"), F.col("high"))))
    served = rounds.select(
        "queue",
        "block",
        "round",
        _served(F.col("round") - 1, grain).alias("served"),
        (_served(F.col("round"), grain) - _served(F.col("round") - 1, grain)).alias("size"),
    ).where("size > 0")
    sums = served.groupBy("block").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.orderBy("block")) - F.col("size")
    sums = sums.select("block", before.alias("block_base"))
    inside = Window.partitionBy("block").orderBy("round", "queue")
    upto = served.withColumn("upto", F.sum("size").over(inside))
    base = F.col("block_base") + F.col("upto") - F.col("size")
    return upto.join(sums, "block").select("queue", "round", "served", base.alias("base"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 4096,
    mixture: Mapping[str, float] | None = None,
    grain: int = GRAIN,
    key: str = "doc_id",
    text: str = "text",
    source: str | None = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    `mixture` gives target weights by source; without it, and for sources it leaves out, the
    weight is the source's share of all ids. ids are little-endian unsigned 32-bit integers.
    """
    if length % grain or any(w <= 0 for w in (mixture or {}).values()):
        raise ValueError("length must be a multiple of grain, and weights above zero")
    store = encoded(docs, tokenizer, end_id, key, text, source)
    sums = store.agg(F.sum("n").alias("n")).first()
    total = sums.n or 0
    natural = F.col("total") / F.lit(max(total, 1))
    weight = natural
    for name, value in (mixture or {}).items():
        weight = F.when(F.col("queue") == f"={name}", F.lit(float(value))).otherwise(weight)
    queued = stored(_queued(store.select("row", "doc_id", "queue", "n"), weight, length // grain), "queued")
    queues = queued.groupBy("queue").agg(F.first("total").alias("total"), F.first("quantum").alias("quantum"))
    if mixture:
        norm = queues.agg(F.sum("quantum") / (length // grain)).first()[0] or 1.0
        queued = queued.withColumn("quantum", F.col("quantum") / norm)
        queues = queues.withColumn("quantum", F.col("quantum") / norm)
    runs = _runs(queues, grain)

    low, high = F.floor(F.col("at") / grain), F.floor((F.col("at") + F.col("n") - 1) / grain)
    parts = (
        queued.withColumn("round", F.explode(_rounds(_round_of(low), _round_of(high), low, high)))
        .withColumn("a", F.greatest(F.col("at"), _served(F.col("round") - 1, grain)))
        .withColumn("b", F.least(F.col("at") + F.col("n"), _served(F.col("round"), grain)))
        .where("a < b")
        # Unfolded rounds look small to the planner, but grow with the data.
        .join(runs.hint("merge"), ["queue", "round"])
        .withColumn("place", F.col("base") + F.col("a") - F.col("served"))
        .withColumn("end", F.col("place") + F.col("b") - F.col("a"))
    )

    # Sequences: full ones, then one for each power of two in what is left.
    full = total // length
    edges = [full * length]
    for power in reversed(range((total % length).bit_length())):
        if total % length >> power & 1:
            edges.append(edges[-1] + (1 << power))
    tail = F.array(*[F.lit(e).cast("long") for e in edges])

    def sequence_of(place: Column) -> Column:
        beyond = full + F.size(F.filter(tail, lambda e: e <= place)) - 1
        return F.when(place < edges[0], F.floor(place / length)).otherwise(beyond).cast("long")

    def begin(sequence: Column) -> Column:
        return F.when(sequence <= full, sequence * length).otherwise(F.get(tail, (sequence - full).cast("int")))

    sequence = F.col("sequence_id")
    pieces = (
        parts.withColumn("sequence_id", F.explode(F.sequence(sequence_of(F.col("place")), sequence_of(F.col("end") - 1))))
        .withColumn("from", F.greatest(F.col("place"), begin(sequence)))
        .withColumn("to", F.least(F.col("end"), begin(sequence + 1)))
        .select(
            "row",
            F.struct(
                (F.col("a") - F.col("at") + F.col("from") - F.col("place")).alias("start"),
                (F.col("to") - F.col("from")).alias("length"),
                "sequence_id",
                (F.col("from") - begin(sequence)).alias("offset"),
            ).alias("piece"),
        )
        .groupBy("row")
        .agg(F.collect_list("piece").alias("pieces"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _id_type(library_chunks(tokenizer).vocabulary.size, end_id)
        for batch in slices(batches, "ids"):
            found = batch.column("pieces")
            counts = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            places = found.flatten()
            piece = {name: places.field(name).to_numpy(zero_copy_only=False) for name in ("start", "length", "sequence_id", "offset")}
            order = np.lexsort((piece["start"], row))
            piece = {name: values[order] for name, values in piece.items()}
            # In this order the pieces of a batch are all its ids, end to end.
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind).astype("<u4")
            whole = {name: batch.column(name).take(pa.array(row)) for name in ("doc_id", "n")}
            columns = [whole["doc_id"], piece["start"], piece["length"], whole["n"], piece["sequence_id"], piece["offset"]]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), _blobs(ids, piece["length"])],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return store.select("row", "doc_id", "n", "ids").join(pieces, "row").drop("row").mapInArrow(cut, _COLUMNS)


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids): the sequences themselves, padded to `length` unless their
    size is a power of two. A sequence is at most `length` ids, so a row is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(ordered.alias("parts"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    pad = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({length} - n_ids as int))"))
    whole = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    ids = F.when(whole, joined).otherwise(F.concat(joined, pad))
    return rows.select("sequence_id", "n_ids", ids.alias("ids"))
