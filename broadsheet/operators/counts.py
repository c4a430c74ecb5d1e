"""Word and n-gram counts.

Words are counted with a partial sum in each task before the shuffle, so a word that
makes up a third of the corpus arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.session import discard, stored

MANY = 1000  # rows that each task may send to the last step of a top k


def count_items(df: DataFrame, items: Column, name: str = "word", by: list[str] | None = None) -> DataFrame:
    """(by..., name, n): how often each element of an array column occurs."""
    exploded = df.select(*(by or []), F.explode(items).alias(name))
    return exploded.groupBy(*(by or []), name).agg(F.count(F.lit(1)).alias("n"))


def most_common(counts: DataFrame, k: int, name: str = "word") -> DataFrame:
    """The k rows with the highest n, equal counts by name.

    The last step takes up to k rows from each task into one. For a large k, rows below the
    count that the k-th row has are left out before.
    """
    if k > MANY:
        counts = counts.where(F.col("n") >= _count_of_last(counts, k))
    return counts.orderBy(F.desc("n"), name).limit(k)


def heavy_hitters(df: DataFrame, items: Column, k: int, name: str = "word", buckets: int = 1 << 20) -> DataFrame:
    """The k most frequent elements of an array column, as `most_common` of all counts gives them,
    without a shuffle of all different elements.

    Elements are first counted by hash bucket, so a task sends `buckets` short rows at most. No element
    occurs more often than its bucket. Elements of the fullest buckets are counted exactly; the
    k-th of them sets a floor, and only buckets that reach it may hold others, which are then
    counted as well. Where counts are so even that every bucket reaches the floor, this is the
    exact count of all, two passes later.
    """
    number = F.pmod(F.xxhash64(name), F.lit(buckets))
    spread = df.select(F.explode(items).alias(name)).withColumn("_bucket", number)
    sizes = stored(spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")

    def counted(some: DataFrame) -> DataFrame:
        # At most `buckets` rows of one number.
        kept = spread.join(F.broadcast(some.select("_bucket")), "_bucket", "left_semi")
        return stored(kept.groupBy(name).agg(F.count(F.lit(1)).alias("n")), "hitters")

    fullest = stored(most_common(sizes, 4 * k, "_bucket"), "fullest")
    first = counted(fullest)
    floor = most_common(first, k, name).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("found")).first()
    reached = sizes.where(F.col("n") >= (floor.n if floor.found == k else 0)).join(fullest.select("_bucket"), "_bucket", "left_anti")
    return most_common(first.unionByName(counted(reached)), k, name)


def frequent(
    df: DataFrame, items: Column, least: int, name: str = "word", by: list[str] | None = None, buckets: int = 1 << 20
) -> DataFrame:
    """(by..., name, n) of the elements of an array column that may occur `least` times in all; none
    that does is left out, others may be among them.

    Counted by hash bucket first, as in `heavy_hitters`: only elements whose bucket holds as many
    are counted one by one, so rare ones, which are most, are not shuffled.
    """
    number = F.pmod(F.xxhash64(name), F.lit(buckets))
    spread = df.select(*(by or []), F.explode(items).alias(name))
    one = F.count(F.lit(1)).alias("n")
    full = stored(spread.groupBy(number.alias("_bucket")).agg(one).where(F.col("n") >= least).select("_bucket"), "buckets")
    # At most `buckets` rows of one number.
    kept = spread.withColumn("_bucket", number).join(F.broadcast(full), "_bucket", "left_semi")
    found = stored(kept.groupBy(*(by or []), name).agg(one), "frequent")
    discard(full)
    return found


def count_of_last(counts: DataFrame, k: int) -> int:
    """The n of the k-th row, 0 when there are fewer."""
    return counts.sparkSession.range(1).select(_count_of_last(counts, k).alias("n")).first().n


def _count_of_last(counts: DataFrame, k: int) -> Column:
    """The n of the k-th row, 0 when there are fewer."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    from_top = F.sum("rows").over(Window.orderBy(F.desc("n")))  # one row per different n
    reached = sizes.withColumn("upto", from_top).where(F.col("upto") >= k)
    return F.coalesce(reached.agg(F.max("n")).scalar(), F.lit(0))


def basic_words(df: DataFrame) -> DataFrame:
    """Basic cleaned title and text of each article as one array of words."""
    both = F.concat_ws(" ", "text", "title")
    kept = tx.words(tx.clean(both), min_length=3)
    return df.withColumn("words", kept)


def word_freq(df: DataFrame, k: int = 20) -> DataFrame:
    """Top k words of title and text together, basic cleaning."""
    return most_common(count_items(basic_words(df), F.col("words")), k)


def vocabulary_size(df: DataFrame) -> DataFrame:
    """Number of different words and of all words."""
    counts = count_items(basic_words(df), F.col("words"))
    return counts.agg(F.count(F.lit(1)).alias("unique_words"), F.sum("n").alias("total_words"))


def top_ngrams(df: DataFrame, words: Column, n: int, k: int = 15) -> DataFrame:
    """Top k n-grams of a word-array column, none across rows."""
    return most_common(count_items(df, tx.ngrams(words, n), "gram"), k, "gram")


def top_k(counts: DataFrame, key: str, k: int, name: str = "word") -> DataFrame:
    """The k most frequent names of each class with their rank.

    Spark keeps only k rows per class and task before the shuffle, since the filter is on
    row_number().
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), name))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def class_words(df: DataFrame, k: int = 100, label: str = "label") -> DataFrame:
    """Word weights of each class: counts over the most frequent word's count."""
    kept = tx.words(tx.clean(F.col("text")), min_length=3)
    top = top_k(count_items(df, kept, by=[label]), label, k)
    highest = F.max("n").over(Window.partitionBy(label))  # k rows per class
    return top.withColumn("weight", F.col("n") / highest)


def reduction(df: DataFrame, before: str, after: str, by: list[str] | None = None) -> DataFrame:
    """Characters before and after a cleaning step, and percent removed, for all rows or groups."""
    sums = df.groupBy(*(by or [])).agg(
        F.sum(F.length(before)).alias("chars_before"), F.sum(F.length(after)).alias("chars_after")
    )
    removed = F.col("chars_before") - F.col("chars_after")
    return sums.withColumn("percent_removed", F.try_divide(removed * 100.0, F.col("chars_before")))
