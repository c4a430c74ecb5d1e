"""TF-IDF weights and word ids as relational queries."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators.counts import count_items, most_common
from broadsheet.operators.lookup import lookup
from broadsheet.session import stored

OOV_ID = 1
SEQUENCE_LENGTH = 256


def default_stopwords() -> list[str]:
    """Spark's English list, for the vectorizer."""
    return StopWordsRemover.loadDefaultStopWords("english")


def vector_words(text: Column, stopwords: list[str] | None = None) -> Column:
    """Words of two characters or more without stop words."""
    drop = default_stopwords() if stopwords is None else stopwords
    found = F.split(tx.normalize(text), " ")
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*drop, ""))


def _term_counts(df: DataFrame, key: str, text: str, stopwords: list[str] | None) -> DataFrame:
    """(key, term, tf) of one- and two-word terms, counted within the row of the text.

    The terms are sorted and the lengths of their runs taken, so no text is shuffled.
    """
    listed = df.select(key, vector_words(F.col(text), stopwords).alias("words"))
    terms = F.concat("words", tx.ngrams(F.col("words"), 2))
    ordered = listed.select(key, F.sort_array(terms).alias("terms"))
    before = F.concat(F.array(F.lit(None).cast("string")), "terms")
    starts = F.filter(
        F.transform(F.arrays_zip(F.col("terms").alias("t"), before.alias("b")), lambda x, i: F.when(
            x["t"].isNotNull() & ~x["t"].eqNullSafe(x["b"]), F.struct(i.alias("at"), x["t"].alias("term"))
        )),
        lambda x: x.isNotNull(),
    )
    runs = ordered.select(key, F.size("terms").alias("n"), starts.alias("runs"))
    ends = F.concat(F.slice("runs.at", 2, F.size("runs")), F.array("n"))
    pairs = F.arrays_zip(F.col("runs").alias("run"), ends.alias("end"))
    found = runs.select(key, F.explode(pairs).alias("x")).where("x.run is not null")  # no terms
    tf = F.col("x.end") - F.col("x.run.at")
    return found.select(key, F.col("x.run.term").alias("term"), tf.cast("long").alias("tf"))


def tfidf(
    df: DataFrame, key: str, text: str, max_features: int = 8000, stopwords: list[str] | None = None
) -> DataFrame:
    """(key, term, weight): smooth idf, L2 norm, over the max_features most frequent terms.

    `key` must identify a row. Terms are counted within each text; the sums over the corpus
    start in each task, and only the weights that are kept are shuffled, for the norm. The
    vocabulary is limited by its parameter, so its broadcast is too.
    """
    counted = _term_counts(df, key, text, stopwords)
    one = F.count(F.lit(1))
    totals = stored(counted.groupBy("term").agg(F.sum("tf").alias("n"), one.alias("df")), "terms")
    vocabulary = most_common(totals, max_features, "term")
    docs = df.agg(one).scalar()
    idf = F.log((docs + 1) / (F.col("df") + 1)) + 1
    raw = counted.join(F.broadcast(vocabulary.select("term", idf.alias("idf"))), "term")
    weight = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(weight * weight).over(Window.partitionBy(key)))
    return raw.select(key, "term", (weight / norm).alias("weight"))


def word_ids(df: DataFrame, text: str, num_words: int = 10_000) -> DataFrame:
    """(word, id): ids from 2 by falling frequency, all below num_words."""
    found = F.split(tx.normalize(F.col(text)), " ")
    counts = count_items(df, F.filter(found, lambda w: w != ""))
    top = most_common(counts, max(num_words - OOV_ID - 1, 0))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))  # num_words rows at most
    return top.select("word", (rank + OOV_ID).alias("id"))


def encode(
    df: DataFrame, key: str, text: str, ids: DataFrame, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """(key, ids): word ids in order, cut and filled with 0 at the end to `length`.

    Unknown words get the out-of-vocabulary id, so only the first `length` words of a text
    can matter and only they are looked up. `ids` is read more than once: store it first.
    """
    found = F.filter(F.split(tx.normalize(F.col(text)), " "), lambda w: w != "")
    first = df.select(key, F.posexplode_outer(F.slice(found, 1, length)).alias("pos", "word"))
    joined = lookup(first, ids.select("word", F.col("id").alias("_id")), "word")
    coded = F.when(
        F.col("word").isNotNull(), F.struct("pos", F.coalesce("_id", F.lit(OOV_ID)).alias("code"))
    )
    listed = joined.groupBy(key).agg(F.array_sort(F.collect_list(coded)).alias("coded"))
    codes = F.col("coded.code")
    padding = F.array_repeat(F.lit(0), F.lit(length) - F.size(codes))
    return listed.select(key, F.concat(codes, padding).alias("ids"))
