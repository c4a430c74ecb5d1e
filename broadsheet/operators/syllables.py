"""Syllables by hyphenation with patterns, Liang's method.

A pattern is letters with digits between them: "hy3ph" rates the gap before the "p" by 3. "."
stands for the start or the end of a word. Of all patterns that occur in a word, the highest
digit of each gap holds, and an odd one allows a hyphen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.lookup import in_row, lookup

MAX_PATTERNS = 200_000  # pattern files of all languages are far smaller
KEPT_WORDS = 500_000  # different words a task remembers beyond those of its last batch
_END = ""  # the key of a pattern's ratings in its last node; letters are never empty


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) from a pattern file, one to a line; lines that are no pattern, headers with capitals among them, are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("pattern"))
    return lines.where(F.col("pattern").rlike(r"[0-9]") & ~F.col("pattern").rlike(r"[\sA-Z%\\=/]"))


class Trie:
    """All patterns as one tree of letters."""

    def __init__(self, patterns: list[str]):
        self.root: dict = {}
        for pattern in patterns:
            letters = re.sub(r"[0-9]", "", pattern)
            # The digit before each letter and one after the last.
            digits = re.findall(r"([0-9]?)(?:[^0-9]|$)", pattern)[: len(letters) + 1]
            ratings = [int(d or 0) for d in digits]
            node = self.root
            for letter in letters:
                node = node.setdefault(letter, {})
            held = node.get(_END)
            node[_END] = [*map(max, held, ratings)] if held else ratings

    def hyphens(self, word: str, left: int = 2, right: int = 2) -> int:
        """Places for a hyphen with at least `left` letters before it and `right` after it."""
        marked = f".{word}."
        ratings = [0] * (len(marked) + 1)
        for first in range(len(marked)):
            node = self.root
            for letter in marked[first:]:
                node = node.get(letter)
                if node is None:
                    break
                for i, rating in enumerate(node.get(_END, ())):
                    if rating > ratings[first + i]:
                        ratings[first + i] = rating
        return sum(rating % 2 for rating in ratings[left + 1 : len(word) - right + 2])


def spoken_words(text: Column) -> Column:
    """The words of a text in lower case, without anything but letters, marks and digits."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_\s]+", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def _listed(patterns: DataFrame) -> list[str]:
    rows = patterns.select("pattern").where("pattern is not null").distinct().limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    return [r.pattern for r in rows]


def hyphenated(words: DataFrame, patterns: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """(word, syllables) of each different word: one more than its places for a hyphen."""
    listed = _listed(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(listed)
        for batch in batches:
            counts = [1 + trie.hyphens(w, left, right) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(counts, pa.int32())], names=["word", "syllables"])

    different = words.select("word").where("word is not null").distinct()
    return different.mapInArrow(run, "word string, syllables int")


def with_hyphenation(
    df: DataFrame, text: str, patterns: DataFrame, left: int = 2, right: int = 2, name: str = "syllables"
) -> DataFrame:
    """The rows with the sum of syllables over the words of each text, 0 for null or empty texts, as
    `with_syllables` gives it with the table of `hyphenated`.

    Nothing is shuffled: a task hyphenates the different words of its texts and remembers at most
    `KEPT_WORDS` of them.
    """
    listed = _listed(patterns)

    @F.arrow_udf("long")
    def total(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, known = Trie(listed), {}
        for lists in batches:
            coded = lists.flatten().dictionary_encode()
            different = coded.dictionary.to_pylist()
            if len(known) > KEPT_WORDS:
                known.clear()
            for word in different:
                if word not in known:
                    known[word] = 1 + trie.hyphens(word, left, right)
            each = np.array([known[w] for w in different], np.int64)[coded.indices.to_numpy()]
            upto = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            yield pa.array(np.diff(upto[ends], prepend=0), pa.int64())

    return df.withColumn(name, total(spoken_words(F.col(text))))


def with_syllables(df: DataFrame, key: str, text: str, syllables: DataFrame, name: str = "syllables") -> DataFrame:
    """The rows with the sum of syllables over the words of each text, 0 for null or empty texts.

    `syllables` has one row (word, syllables) per word. A small table is looked up within the row.
    A large one is joined by word: each word travels once per text with its number of
    occurrences; `key` must identify a row.
    """
    zero = F.lit(0).cast("long")
    words = spoken_words(F.col(text))
    found = in_row(syllables.select("word", "syllables"), "word")
    if found:
        total = F.aggregate(words, zero, lambda n, w: n + F.coalesce(found(w)["syllables"], F.lit(0)))
        return df.withColumn(name, F.coalesce(total, zero))
    counted = df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup(counted, syllables.select("word", "syllables"), "word", how="inner")
    sums = joined.groupBy(key).agg(F.sum(F.col("n") * F.col("syllables")).alias(name))
    return df.join(sums, key, "left").withColumn(name, F.coalesce(name, zero))
