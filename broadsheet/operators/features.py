"""The feature row of an article, and row-level cleaning of the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.words import KEYWORDS, STOPWORDS


def feature_columns(
    title: str = "title",
    text: str = "text",
    keywords: list[str] = KEYWORDS,
    stopwords: list[str] = STOPWORDS,
) -> dict[str, Column]:
    t, x = F.col(title), F.col(text)
    return {
        "title_length": F.length(t),
        "text_length": F.length(x),
        "title_word_count": tx.word_count(t),
        "text_word_count": tx.word_count(x),
        "title_text_length_ratio": tx.length_ratio(t, x),
        "title_text_wordcount_ratio": tx.word_ratio(t, x),
        "title_exclamation_count": tx.bang_count(t),
        "text_exclamation_count": tx.bang_count(x),
        "title_question_count": tx.question_count(t),
        "text_question_count": tx.question_count(x),
        "title_caps_ratio": tx.caps_ratio(t),
        "text_digit_count": tx.digit_count(x),
        "text_specialchar_count": tx.special_char_count(x),
        "contains_url": tx.contains_url(x),
        "fake_keywords_count": tx.keyword_score(x, t, keywords),
        "title_clean": tx.remove_stopwords(tx.clean(t), stopwords),
        "text_clean": tx.remove_stopwords(tx.clean(x), stopwords),
    }


def with_features(df: DataFrame, **options) -> DataFrame:
    """The 17 feature columns next to the given ones, in one projection."""
    return df.withColumns(feature_columns(**options))


def with_notebook_features(df: DataFrame, keywords: list[str] = KEYWORDS) -> DataFrame:
    """The variant that counts words by runs of white space, any capitals, and loose URLs."""
    t, x = F.col("title"), F.col("text")
    title_words, text_words = tx.word_count(t, ws=True), tx.word_count(x, ws=True)
    return df.withColumns(
        {
            "title_length": F.length(t),
            "text_length": F.length(x),
            "title_word_count": title_words,
            "text_word_count": text_words,
            "title_text_length_ratio": tx.length_ratio(t, x),
            "title_text_word_ratio": tx.ratio(title_words, text_words),
            "title_exclamation_count": tx.bang_count(t),
            "title_question_count": tx.question_count(t),
            "text_exclamation_count": tx.bang_count(x),
            "text_question_count": tx.question_count(x),
            "title_caps_ratio": tx.caps_ratio(t, uni=True),
            "text_digit_count": F.regexp_count(x, F.lit(r"\p{Nd}")),
            "text_special_char_count": tx.special_char_count(x),
            "contains_url": tx.contains_url(x, loose=True),
            "fake_keywords_count": tx.keyword_score(x, t, keywords),
        }
    )


def expand(df: DataFrame, col: str) -> DataFrame:
    """The fields of a struct column as columns."""
    return df.select(f"{col}.*")


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text has something besides white space."""
    return df.where(tx.has_more_than_space(F.col(col)))


def clean_label(df: DataFrame, col: str = "label") -> DataFrame:
    """Labels that read as the numbers 0 or 1, as integers; other rows go."""
    number = F.col(col).try_cast("double")
    return df.where(number.isin(0.0, 1.0)).withColumn(col, number.cast("int"))


def by_label(df: DataFrame, value: int, col: str = "label") -> DataFrame:
    return df.where(F.col(col) == value)


def drop_thin(df: DataFrame, n: int = 100, col: str = "text") -> DataFrame:
    """Rows with a text of more than n characters; works on streams as well."""
    return df.where(F.length(col) > n)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that have a label, with it."""
    return docs.join(labels, key)


def replicate(df: DataFrame, copies: int = 3, number: str | None = None) -> DataFrame:
    """Bag union of the table with itself, from a single scan; `number` keeps the copy's number."""
    numbers = F.sequence(F.lit(1), F.lit(copies))
    numbered = df.withColumn(number or "_copy", F.explode(numbers))
    return numbered if number else numbered.drop("_copy")


def training_text(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Joined and repaired text with a clean label, ready for the classifiers."""
    joined = tx.join_text(F.col(title), F.col(text))
    repaired = tx.repair_mojibake(joined)
    # A plain letter or mark stays one, so hardly a text is repaired for this test.
    kept = df.where(joined.rlike("[!-~]") | tx.has_more_than_space(repaired))
    return clean_label(kept.withColumn("title_text", repaired), "label")
