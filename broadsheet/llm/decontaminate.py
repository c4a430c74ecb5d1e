"""Benchmark decontamination with a generalised suffix automaton (operator 13).

All word sequences that occur in the items are the paths of one automaton, built on the driver
from a block of items of bounded size. A document's words are streamed through it; after each word the state and
the length of the longest run of item words that ends there are known. A word no item has, or
one that ends no longer run, lets the length fall along the suffix links.

A window is `window` consecutive words of an item; an item of fewer words is one window. Where
the longest match is at least as long as a window that ends at its state, the window occurs:
its words are hit and its items are noted. Spans are the runs of hit words. `clean` removes
the spans longer than a limit, and the whole text of a document that is hit beyond a share.

Documents are never shuffled: the automaton goes to the tasks. With items of more than BLOCK_WORDS
words there is a pass for each block, and the spans of a document are merged afterwards.

Words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case. Null
and empty texts have no words and no hits. Documents that repeat a key are found each by
itself. Items without words have no windows; items that repeat an id count as one, those with a
null id hit words but are not among the ids. Other columns are ignored, and kept by `clean`. An
empty table of items hits nothing; an empty table of documents gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import ascii_words, slices
from broadsheet.session import stored

BLOCK_WORDS = 100_000  # words of the items in one automaton
BLOCK_BYTES = 1 << 20  # of item text from which there are several blocks
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOUND = "row bigint, doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Automaton:
    """The suffix automaton of several word sequences.

    State 0 is the empty sequence. `lengths` has a state's longest sequence, `links` the state
    of its longest suffix that is in another state, `steps` the state reached by a word.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items]
        self.lengths, self.links, self.following = [0], [-1], [{}]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self._mark(coded)
        width = len(self.words)
        self.steps = {state * width + code: to for state, out in enumerate(self.following) for code, to in out.items()}
        del self.following

    def _add(self, length: int, link: int, out: dict[int, int]) -> int:
        self.lengths.append(length)
        self.links.append(link)
        self.following.append(out)
        return len(self.lengths) - 1

    def _split(self, at: int, code: int, held: int) -> int:
        """A state for the sequences of `held` that are one longer than those of `at`."""
        copy = self._add(self.lengths[at] + 1, self.links[held], dict(self.following[held]))
        self.links[held] = copy
        while at >= 0 and self.following[at].get(code) == held:
            self.following[at][code] = copy
            at = self.links[at]
        return copy

    def _extend(self, last: int, code: int) -> int:
        held = self.following[last].get(code)
        if held is not None:  # an earlier item has the sequence
            return held if self.lengths[held] == self.lengths[last] + 1 else self._split(last, code, held)
        new = self._add(self.lengths[last] + 1, 0, {})
        at = last
        while at >= 0 and code not in self.following[at]:
            self.following[at][code] = new
            at = self.links[at]
        if at >= 0:
            held = self.following[at][code]
            self.links[new] = held if self.lengths[held] == self.lengths[at] + 1 else self._split(at, code, held)
        return new

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        """`owners`: the items of the window that ends in a state, by the state whose sequences
        are as long as the window. `ends`: the nearest such state on the way to the start, and
        `least` the length of the shortest window there."""
        self.owners: dict[int, set[str | None]] = {}
        for name, codes in coded:
            size = min(self.window, len(codes))
            at = 0
            for i, code in enumerate(codes):
                at = self.following[at][code]
                if i + 1 >= size > 0:
                    state = at
                    while self.lengths[self.links[state]] >= size:
                        state = self.links[state]
                    self.owners.setdefault(state, set()).add(name)
        states = len(self.lengths)
        self.ends, self.least = [0] * states, [1 << 60] * states
        for state in np.argsort(self.lengths, kind="stable").tolist()[1:]:
            link = self.links[state]
            above = self.ends[link]
            self.ends[state], self.least[state] = above, self.least[link]
            if state in self.owners:
                self.ends[state] = state
                self.least[state] = min(self.least[link], self.size_of(state))

    def size_of(self, state: int) -> int:
        """Words of the window that ends in a state with owners."""
        return min(self.window, self.lengths[state])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """The spans (first word, word after the last) of the words hit, and the items."""
        codes = list(map(self.words.get, words))
        steps, links, lengths, least = self.steps, self.links, self.lengths, self.least
        width = len(self.words)
        spans: list[tuple[int, int]] = []
        noted: set[int] = set()
        state = length = 0
        for i, code in enumerate(codes):
            if code is None:
                state = length = 0
                continue
            to = steps.get(state * width + code)
            if to is None:
                while state and to is None:
                    state = links[state]
                    to = steps.get(state * width + code)
                length = lengths[state]  # at the start every known word has a step
            state = to
            length += 1
            if length >= least[state]:
                end = self.ends[state]
                longest = 0
                while end:
                    size = self.size_of(end)
                    if size <= length:
                        longest = max(longest, size)
                        noted.add(end)
                    end = self.ends[links[end]]
                first = i + 1 - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return spans, set().union(*(self.owners[s] for s in noted))


def automata(items: DataFrame, window: int, key: str, text: str) -> Iterator[Automaton]:
    """An automaton for each block of the items."""
    rows = stored(
        items.select(F.monotonically_increasing_id().alias("item"), F.col(key).cast("string").alias("id"), F.col(text).alias("words")),
        "items",
    )
    size = rows.agg(F.sum(F.octet_length("words")).alias("n")).first().n or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else rows
        held, words = [], 0
        for r in part.orderBy("item").toLocalIterator():
            own = ascii_words((r.words or "").encode())
            if held and words + len(own) > BLOCK_WORDS:
                yield Automaton(held, window)
                held, words = [], 0
            held.append((r.id, own))
            words += len(own)
        if words:
            yield Automaton(held, window)


def _scanned(docs: DataFrame, automaton: Automaton | None, all_rows: bool) -> DataFrame:
    """The spans of (row, doc_id, text); with all_rows also those of documents without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, sizes, spans, items = [], [], [], []
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = ascii_words(raw)
                found, names = automaton.scan(words) if automaton else ([], set())
                if found or all_rows:
                    kept.append(i)
                    sizes.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted(n for n in names if n is not None))
            rows = batch.select(["row", "doc_id"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, FOUND)


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        joined = F.concat(head, F.array(wider))
        return F.when(last["end"] >= span["start"], joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), none, step)


def find(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    row: str | None = None,
) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of every document: the spans of words that are in
    an item's window, and the ids of the items, in the order of strings. `row` names a column
    that tells rows apart; without it rows are numbered."""
    own = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    rows = docs.select(
        own.alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    blocks = automata(items, window, item_key, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _scanned(rows, first, True)
    if row is None:  # numbers must hold for several passes
        rows = stored(rows, "numbered")
    parts = [stored(_scanned(rows, first, True), "spans"), stored(_scanned(rows, second, False), "spans")]
    parts += [stored(_scanned(rows, more, False), "spans") for more in blocks]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # At most one row per document and block.
    together = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return together


def words_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean(
    docs: DataFrame,
    found: DataFrame,
    row: str,
    text: str = "text",
    max_words: int = 9,
    max_share: float = 0.5,
) -> DataFrame:
    """The documents without their spans of more than `max_words` words; a document of whose
    words more than `max_share` are hit gets an empty text. Texts without such spans stay as
    they are, null ones too. `row` is the column that `find` was given."""
    long = F.filter("spans", lambda s: s["end"] - s["start"] > max_words)
    gone = F.col("n_words") * max_share < words_hit()
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    marks = found.where(gone | (F.size(long) > 0)).select(
        F.col("row").alias(mark + "row"), long.alias(mark + "cut"), gone.alias(mark + "gone")
    )
    marked = docs.join(marks, F.col(row) == F.col(mark + "row"), "left").drop(mark + "row")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            texts = batch.column(place).to_pylist()
            gone, cuts = batch.column(mark + "gone").to_pylist(), batch.column(mark + "cut").to_pylist()
            texts = ["" if g else without(t, c) if c else t for t, g, c in zip(texts, gone, cuts)]
            columns = [pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[: len(schema)], names=schema.names)

    return marked.mapInArrow(run, schema)


def without(text: str, spans: list[dict[str, int]]) -> str:
    """The text less the words of the spans and what lies between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for span in spans:
        out.append(raw[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()
