"""The registry of queries, the views they start from, and pieces of SQL for the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.words import FUSED, KEYWORDS, STOPWORDS
from broadsheet.operators.features import labelled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Keywords that occur in the test data, as the default ones do not.
DATA_KEYWORDS = ["the", "tion", "eaux", "ung", "ción", "and of", "is"]


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


# ---- views --------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the start of their first line as title."""
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return table(spark, folder, "documents").select("doc_id", title.alias("title"), "text", "lang", "source")


def labelled_articles(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return labelled(articles(spark, folder), labels)


def labelled_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Label and lengths; the texts are measured before the join, so they are not shuffled."""
    lengths = articles(spark, folder).select(
        "doc_id", F.length("title").alias("title_length"), F.length("text").alias("text_length")
    )
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return labelled(lengths, labels)


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(model, label, score) from order lines, with many equal scores."""
    mixed = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29) % 1000
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("m"), "l_linenumber").alias("model"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (mixed / 1000).alias("score"),
    )


def rounded(*cols: str, places: int = 6) -> list[Column]:
    return [F.round(c, places).alias(c) for c in cols]


# ---- SQL ----------------------------------------------------------------------------

ARTICLES = (
    "(SELECT doc_id, left(split_part(text, chr(10), 1), 80) AS title, text, lang, source FROM documents)"
)
LABELLED = f"(SELECT a.*, l.quality AS label FROM {ARTICLES} a JOIN labels l USING (doc_id))"
SCORED = """(SELECT 'm' || l_linenumber AS model, (l_returnflag = 'R')::INT AS label,
  ((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 29) % 1000) / 1000 AS score FROM lineitem)"""

WS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"  # Unicode white space inside a class
ASCII_WS = r"[ \t\n\v\f\r]"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def sql_count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))::INT"


def sql_clean(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^a-z \t\n\v\f\r]+', '', 'g')"


def sql_words(cleaned: str, min_length: int = 1, stopwords: list[str] = STOPWORDS) -> str:
    for a, b in FUSED:
        cleaned = rf"regexp_replace({cleaned}, '\b({a})({b})\b', '\1 \2', 'g')"
    return (
        f"list_filter(string_split_regex({cleaned}, '{ASCII_WS}+'), lambda w: w <> '' AND "
        f"length(w) >= {min_length} AND NOT list_contains({sql_list(stopwords)}, w))"
    )


def sql_join(items: str) -> str:
    return f"coalesce(array_to_string({items}, ' '), '')"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'))"


def sql_strip_urls(c: str) -> str:
    return f"regexp_replace({c}, '(?:http|www)[^{WS}]+', '', 'g')"


def sql_strip_emails(c: str) -> str:
    return f"regexp_replace({c}, '[^{WS}]+@[^{WS}]+', '', 'g')"


def sql_advanced(c: str) -> str:
    return sql_words(sql_clean(sql_squeeze(sql_strip_emails(sql_strip_urls(f"lower({c})")))), 3)


def sql_normalize(c: str) -> str:
    bare = rf"regexp_replace(lower(coalesce({c}, '')), 'https?://[^{WS}]+|www\.[^{WS}]+', '', 'g')"
    return rf"trim(regexp_replace({bare}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_special(c: str) -> str:
    return rf"coalesce(length(regexp_replace({c}, '[\p{{L}}\p{{N}}{WS}]+', '', 'g')), 0)::INT"


def sql_keywords(text: str, title: str, keywords: list[str] = KEYWORDS) -> str:
    parts = [
        f"coalesce(contains(lower({c}), '{k}')::INT, 0)" for c in (text, title) for k in keywords
    ]
    return " + ".join(parts)


def sql_ngrams(words: str, n: int) -> str:
    return (
        f"list_transform(range(1, len({words}) - {n} + 2), "
        f"lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"
    )
