"""Lookups in tables, within the row or by a join, broadcast only after a check of their size."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 200_000
MAX_ROWS_IN_ROW = 20_000
FILTER_BITS = 1 << 22


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether the table has at most max_rows rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def groups_are_few(df: DataFrame, by: list[str], max_groups: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether one-row-per-group results over these columns are small enough to broadcast."""
    return not by or is_small(df.select(*by).distinct(), max_groups)


def hint(side: DataFrame, small: bool) -> DataFrame:
    """A broadcast hint for a side known to be small; otherwise AQE chooses and splits skew."""
    return F.broadcast(side) if small else side


def lookup(tokens: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join tokens with a table that has one row per `on`.

    Spark broadcasts the table if its bytes, known once it is made, are below
    spark.sql.autoBroadcastJoinThreshold. Otherwise it sorts and merges, and splits the
    partition of a word that holds a large part of all tokens.
    """
    return tokens.join(table, on, how)


def in_row(table: DataFrame, on: str, max_rows: int = MAX_ROWS_IN_ROW) -> Callable[[Column], Column] | None:
    """A function from a word to its row of the table, null where there is none.

    It is an expression without a join, so words need not leave their row. The table, one row per
    `on`, becomes one literal: an array of buckets by the CRC-32 of the word, of which an
    expression reads one. None if the table has more than `max_rows` rows; then it must be joined.
    """
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    slots = max(1, 2 * len(rows))
    buckets: list[list[dict]] = [[] for _ in range(slots)]
    for row in rows:
        if row[on] is not None:
            buckets[zlib.crc32(row[on].encode()) % slots].append(row.asDict())
    # Parsed once, while the plan is optimized.
    literal = F.from_json(F.lit(json.dumps(buckets)), T.ArrayType(T.ArrayType(table.schema)))

    def find(word: Column) -> Column:
        bucket = F.get(literal, F.pmod(F.crc32(word), F.lit(slots)).cast("int"))
        return F.get(F.filter(bucket, lambda row: row[on] == word), 0)

    return find


def may_hold(table: DataFrame, on: str, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test, within the row, that is true of every word of the table and of few others.

    One bit for each hash of a word, `bits` in all whatever the size of the table: half a MB. A
    table of many more words than bits lets all pass, and the join that follows decides.
    """
    slot = F.pmod(F.xxhash64(on), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    set_bits = table.where(F.col(on).isNotNull()).select(slot.alias("_slot"))
    places = set_bits.groupBy(F.expr("_slot div 64").cast("int").alias("place")).agg(F.bit_or(bit).alias("bits"))
    held = [0] * -(-bits // 64)
    for row in places.collect():  # a number for each 64 bits
        held[row.place] = row.bits
    literal = F.from_json(F.lit(json.dumps(held)), T.ArrayType(T.LongType()))

    def test(word: Column) -> Column:
        slot = F.pmod(F.xxhash64(word), F.lit(bits))
        found = F.get(literal, F.floor(slot / 64).cast("int"))
        # A null word has a hash as well.
        return word.isNotNull() & (F.getbit(found, (slot % 64).cast("int")) == 1)

    return test
