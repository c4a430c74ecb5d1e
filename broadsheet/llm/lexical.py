"""Ranked lexical search by NRA: sequential reads only (operator 12).

The wanted terms of a block of items go to all tasks. One pass counts every document's terms and
keeps, of the wanted ones, how often each occurs; the numbers of documents and terms are sums
over that table. A task then takes its documents in shards, turns counts into impacts and sorts
each term's list by impact. For an item it reads the lists from their tops, some entries of
each at a time, and keeps for every document met a lower bound, what it has been found to
score, and an upper bound, which adds where the lists stand that it was not met in. Documents
whose upper bound is below the k-th best lower bound go. It stops when no document not yet met
can come in, and of those left all bounds are closed: membership, ties and scores are then
final. No list is looked up by document. The best of all shards are ranked once more; Spark cuts
them to k per item in each task before the shuffle.

Nothing is shuffled by term or document, so a term in every document costs no more than
others. A shard holds at most SHARD_POSTINGS entries, and one document's if they are more. Items
are taken in blocks by hash, one pass over the documents for each block.

Scores are integers: weight * ((10**9 * tf) div (1000 * tf + 8 * m)) summed over an item's
terms, where weight is floor(1000 * ln((2N + 2) / (2df + 1))) and m is 25 + (75 n N) div L.

Null and empty texts have no terms: such documents do not count in N, such items have no
results. Terms that occur nowhere score nothing. Documents that repeat a key are ranked each by
itself, equal scores by key, a null key last. Items that repeat a key or have none are each
ranked by themselves. Other columns are ignored. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import ascii_words, slices, text_rows
from broadsheet.session import stored

SHARD_POSTINGS = 1_000_000
ITEM_BYTES = 8 << 20  # of text in a block of items
FIRST_READ = 64  # entries of each list in the first round; later rounds read twice as many
RESULT = "item bigint, doc_id bigint, score bigint"
_NO_KEY = np.iinfo(np.int64).max


def numbered_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, item_key, item_text): rows of the items with a number of their own."""
    rows = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_key"), F.col(text).alias("item_text")
    )
    return stored(rows, "items")


def item_blocks(items: DataFrame) -> Iterator[dict[int, Counter[bytes]]]:
    """The terms of the items with any, in blocks of some ITEM_BYTES of text."""
    size = items.agg(F.sum(F.octet_length("item_text")).alias("n")).first().n or 0
    blocks = -(-size // ITEM_BYTES)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else items
        counted = {r.item: Counter(ascii_words((r.item_text or "").encode())) for r in part.collect()}
        yield {item: terms for item, terms in counted.items() if terms}


def term_counts(docs: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a document, and its counts of the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, terms, counts = [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                words = ascii_words(raw)
                found = Counter(map(numbers.get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(list(found.keys()))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return text_rows(docs, key, text).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """25 + (75 n N) div L; in Python's integers where the product leaves 64 bits."""
    if len(n) and 75 * int(n.max()) * documents >= 2**63:
        return np.array([25 + 75 * int(v) * documents // total for v in n], np.int64)
    return 25 + 75 * n * documents // total


class Shard:
    """The impact-sorted lists of some documents."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        kept = impacts > 0
        places, terms, impacts = places[kept], terms[kept], impacts[kept]
        order = np.lexsort((-impacts, terms))
        self.keys, self.places, self.impacts = keys, places[order], impacts[order]
        held, first = np.unique(terms[order], return_index=True)
        last = np.append(first[1:], len(order))
        self.lists = {t: (a, b) for t, a, b in zip(held.tolist(), first.tolist(), last.tolist())}

    def best(self, wanted: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best for terms with their multiplicities, best first."""
        lists = [(*self.lists[t], times) for t, times in wanted if t in self.lists]
        times = np.array([q for _, _, q in lists], np.int64)
        at = [a for a, _, _ in lists]
        lower = np.zeros(len(self.keys), np.int64)
        seen = np.zeros((len(self.keys), len(lists)), bool)
        alive = np.zeros(len(self.keys), bool)
        out = np.zeros(len(self.keys), bool)
        size, newcomers = FIRST_READ, True
        while True:
            for i, (_, end, q) in enumerate(lists):
                stop = min(at[i] + size, end)
                rows, gains = self.places[at[i] : stop], self.impacts[at[i] : stop]
                open_ = ~out[rows] if newcomers else alive[rows]
                rows, gains = rows[open_], gains[open_]
                lower[rows] += gains * q
                seen[rows, i] = True
                alive[rows] = True
                at[i] = stop
            size *= 2
            heads = times * [self.impacts[a] if a < end else 0 for a, (_, end, _) in zip(at, lists)]
            met = np.flatnonzero(alive)
            low = lower[met]
            edge = np.partition(low, len(met) - k)[len(met) - k] if len(met) >= k else 0
            # Where bounds end at 0 there are no more lists to read.
            high = low + (~seen[met]) @ heads
            lost = high < edge
            alive[met[lost]], out[met[lost]] = False, True
            rest = heads.sum()
            newcomers = rest > 0 and rest >= edge
            if not newcomers and (high == low)[~lost].all():
                break
        left = np.flatnonzero(alive)
        first = np.lexsort((self.keys[left], -lower[left]))[:k]
        return left[first], lower[left][first]


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0."""
    spark = docs.sparkSession
    rows = numbered_items(items, item_key, item_text)
    names = rows.select("item", F.col("item_key").alias("item_id"))
    ranked = None
    for block in item_blocks(rows):
        found = _search_block(docs, block, k, key, text, shard_postings) if block else None
        if found is not None:
            ranked = found if ranked is None else ranked.unionByName(found)
    if ranked is None:
        ranked = spark.createDataFrame([], "rank int, " + RESULT)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _search_block(
    docs: DataFrame, block: dict[int, Counter[bytes]], k: int, key: str, text: str, shard_postings: int
) -> DataFrame | None:
    numbers = {t: i for i, t in enumerate(sorted({t for terms in block.values() for t in terms}))}
    counted = stored(term_counts(docs, numbers, key, text), "term-counts")
    whole = counted.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = whole.documents, whole.total
    if not documents:
        return None
    # One row per wanted term of the block.
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(numbers), np.int64)
    for r in held:
        weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
    wanted = {item: sorted((numbers[t], times) for t, times in terms.items()) for item, terms in block.items()}

    def shard_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        given = table.column("doc_id").chunk(0)
        keys = given.fill_null(_NO_KEY).to_numpy()
        counts = np.diff(table.column("terms").chunk(0).offsets.to_numpy())
        places = np.repeat(np.arange(len(keys)), counts)
        terms = table.column("terms").chunk(0).flatten().to_numpy()
        tf = table.column("counts").chunk(0).flatten().to_numpy()
        norm = length_norm(table.column("n").to_numpy(), documents, total)
        impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[places]))
        shard = Shard(keys, places, terms, impacts)
        items, rows, scores = [], [], []
        for item, asked in wanted.items():
            best, score = shard.best(asked, k)
            items.append(np.full(len(best), item))
            rows.append(best)
            scores.append(score)
        columns = [pa.array(np.concatenate(items)), given.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))]
        return pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            first = 0
            for i, held in enumerate(pc.list_value_length(batch.column("terms")).to_pylist()):
                if size and size + held > shard_postings:
                    yield shard_of([*waiting, batch.slice(first, i - first)])
                    waiting, size, first = [], 0, i
                size += held
            waiting.append(batch.slice(first))
        if size:
            yield shard_of(waiting)

    found = counted.where(F.size("terms") > 0).mapInArrow(run, RESULT)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
