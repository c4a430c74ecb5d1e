"""Token counts without token ids (operator 2).

The symbols of a word stand in a linked list and its adjacent pairs in a heap by merge rank.
The pair of lowest rank is popped, the leftmost first, and merged; its two new neighbour
pairs go into the heap. The count is the number of symbols minus the number of merges, so no
identifier is ever looked up.

Null text counts as empty: 0 bytes, 0 tokens. Rows are counted where they lie, without a
shuffle; repeated rows and keys, null keys and other columns change nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import slices, text_rows
from broadsheet.llm.vocabulary import Chunks, Vocabulary, loaded


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank any more."""
    n = len(symbols)
    if n == 1:
        return 1
    find = ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := find((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    at = list(symbols)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if at[i] else n
        # An entry is stale if either symbol has been merged since it was pushed.
        if j >= n or find((at[i], at[j])) != rank:
            continue
        at[i] += at[j]
        at[j] = ""
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := find((at[i], at[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := find((at[h], at[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


def counted_chunks(path: str) -> Chunks:
    """Chunks with their numbers of tokens."""

    def make() -> Chunks:
        vocabulary = Vocabulary(path)
        ranks, added = vocabulary.ranks, vocabulary.added
        # Short forms of a word share nothing, so only whole words are remembered.
        known: dict[str, int] = {}

        def encode(spellings: list[str]) -> list[int]:
            if len(known) > 400_000:
                known.clear()
            counts = []
            for text in spellings:
                total = 0
                for word in vocabulary.words(text):
                    if word not in known:
                        known[word] = (
                            1 if word in added else merged_length(vocabulary.symbols(word), ranks)
                        )
                    total += known[word]
                counts.append(total)
            return counts

        return Chunks(vocabulary, encode)

    return loaded(("counts", path), make)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the library counts without added ends."""
    rows = text_rows(docs, key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = counted_chunks(tokenizer)
        for batch in slices(batches):
            items, places, ends = chunks.of(batch.column("text"))
            upto = np.concatenate([[0], np.array(items, np.int64)[places].cumsum()])[ends]
            totals = np.diff(upto, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
