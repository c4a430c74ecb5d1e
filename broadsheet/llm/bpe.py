"""BPE encoding and decoding with an index of pair occurrences (operator 8).

The new words of a batch of documents are merged together. Their symbols stand in one long
list, and an index maps each adjacent pair to all its places. The ranks that occur are
taken in ascending order; all places of a pair are merged, and only the lists of the pairs
beside them are updated. In a vocabulary that BPE has made, a pair with a merged symbol
ranks after the merge that made the symbol, which is checked when it is loaded; so one
ascending sweep gives what merging each word by itself gives.

Null text counts as empty: no ids, and '' decoded. Repeated rows and keys, null keys and
other columns change nothing.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadsheet.llm.common import slices, text_rows
from broadsheet.llm.vocabulary import Chunks, Vocabulary, byte_letters, laid_out, loaded


class PairIndex:
    """Merges of a vocabulary by id: rank and result of each pair."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        made = {}
        for rank, ((a, b), order) in enumerate(sorted(vocabulary.ranks.items(), key=lambda m: m[1])):
            if rank != order or max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made:
                raise ValueError("the merges are not in the order in which BPE makes them")
            made[a + b] = rank
            self.rank[ids[a], ids[b]] = rank
            self.result.append(ids[a + b])
        self.pair = list(self.rank)

    def merge(self, words: list[list[int]]) -> list[array]:
        """The ids of each word, from the ids of its symbols."""
        # A 0 stands between words: ids are held one higher.
        at = array("q", [0])
        starts = []
        for word in words:
            starts.append(len(at))
            at.extend([i + 1 for i in word])
            at.append(0)
        n = len(at)
        after = array("q", range(1, n + 1))
        before = array("q", range(-1, n - 1))
        rank_of = self.rank.get
        places: dict[int, list[int]] = {}
        for i in range(1, n - 1):
            a, b = at[i], at[i + 1]
            if a and b:
                rank = rank_of((a - 1, b - 1))
                if rank is not None:
                    places.setdefault(rank, []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right = self.pair[rank]
            left, right, new = left + 1, right + 1, self.result[rank] + 1
            spots = places.pop(rank)
            spots.sort()
            for i in spots:
                # A place is stale if an earlier merge has taken one of its symbols.
                if at[i] != left:
                    continue
                j = after[i]
                if at[j] != right:
                    continue
                k, h = after[j], before[i]
                at[i], at[j] = new, -1
                after[i] = k
                before[k] = i
                for first, x, y in ((i, new, at[k]), (h, at[h], new)):
                    if x and y:
                        r = rank_of((x - 1, y - 1))
                        if r is not None:
                            if r not in places:
                                places[r] = []
                                heapq.heappush(active, r)
                            places[r].append(first)
        out = []
        for i in starts:
            ids = array("I")
            while at[i]:
                ids.append(at[i] - 1)
                i = after[i]
            out.append(ids)
        return out


def indexed_chunks(path: str) -> Chunks:
    """Chunks encoded by pair occurrence, as bytes of little-endian unsigned 32-bit ids."""

    def make() -> Chunks:
        vocabulary = Vocabulary(path)
        index = PairIndex(vocabulary)
        vocabulary.ranks = {}  # the index has them
        ids, added = vocabulary.ids, vocabulary.added

        def encode(spellings: list[str]) -> list[bytes]:
            cut = [vocabulary.words(text) for text in spellings]
            new = list({w for words in cut for w in words}.difference(added))
            merged = index.merge([[ids[s] for s in vocabulary.symbols(w)] for w in new])
            known = {w: i.tobytes() for w, i in zip(new, merged)}
            known.update((w, array("I", [i]).tobytes()) for w, i in added.items())
            return [b"".join([known[w] for w in words]) for words in cut]

        return Chunks(vocabulary, encode)

    return loaded(("pairs", path), make)


class Decoder:
    """Text from any ids: the library's decode without skipping special tokens."""

    def __init__(self, vocabulary: Vocabulary):
        names = {i: t for t, i in {**vocabulary.ids, **vocabulary.added}.items()}
        self.names = [names.get(i) for i in range(vocabulary.size)]
        self.plain = vocabulary.joins_plain
        if not self.plain:
            byte = {c: b for b, c in enumerate(byte_letters())}
            self.bytes = [
                bytes(byte[c] for c in t) if t is not None and all(c in byte for c in t) else (t or "").encode()
                for t in self.names
            ]

    def __call__(self, ids) -> str:
        if self.plain:
            names = self.names
            return " ".join([names[i] for i in ids if names[i] is not None])
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


def encoded_batches(batches: Iterator[pa.RecordBatch], chunks: Chunks) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids) of batches of (doc_id, text)."""
    for batch in slices(batches):
        ids, ends = laid_out(*chunks.of(batch.column("text")))
        data, stops = ids.astype("<u4").tobytes(), [0, *ends.tolist()]
        blobs = [data[4 * a : 4 * b] for a, b in zip(stops, stops[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(stops), pa.int64()), pa.array(blobs, pa.binary())],
            names=["doc_id", "n_tokens", "ids"],
        )


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_batches(batches, indexed_chunks(tokenizer))

    return text_rows(docs, key, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows of `encoded` with the text of their ids. Null ids give null."""
    columns = [c for c in encoded.columns if c != name]
    picked = encoded.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = loaded(("decoder", tokenizer), lambda: Decoder(Vocabulary(tokenizer)))
        for batch in slices(batches, ids):
            blobs = batch.column(ids).to_pylist()
            texts = [None if b is None else decoder(memoryview(b).cast("I")) for b in blobs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(run, f"{schema}, `{name}` string")


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): `encode` and `decode` in one pass, with one vocabulary a
    worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = indexed_chunks(tokenizer)
        decoder = loaded(("decoder", tokenizer), lambda: Decoder(chunks.vocabulary))
        for batch in encoded_batches(batches, chunks):
            texts = [decoder(memoryview(b).cast("I")) for b in batch.column("ids").to_pylist()]
            names = ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return text_rows(docs, key, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
