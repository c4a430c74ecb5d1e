"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_BYTES = 6 << 20  # of text that a Python worker holds as words at a time


def text_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column | str
) -> DataFrame:
    """(doc_id, text, ...): the key as a long, and the text with null as ''. Other columns go."""
    keyed = F.col(key).cast("long").alias("doc_id")
    return docs.select(keyed, F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about `limit` bytes, or one row if longer."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size or 0
        if first < batch.num_rows:
            yield batch.slice(first)


# Ends of words as blanks, A-Z in lower case, all other bytes as they are.
_WORD_BYTES = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def ascii_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of everything beyond ASCII; only A-Z get lower case."""
    return text.translate(_WORD_BYTES).split()


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, by hash of their key."""
    n = rows.count()
    spread = 1 << 20
    share = min(spread, math.ceil(2 * spread * most / max(n, 1)))
    drawn = rows.where(F.pmod(F.xxhash64(key), F.lit(spread)) < share)
    return drawn.orderBy(F.xxhash64(key), key).limit(most)
