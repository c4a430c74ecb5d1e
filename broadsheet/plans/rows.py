"""Queries that work row by row: features, cleaning, filters, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators import features as ft
from broadsheet.operators import order
from broadsheet.operators import profile as pf
from broadsheet.plans.base import (
    ARTICLES,
    DATA_KEYWORDS,
    LABELLED,
    WS,
    articles,
    labelled_articles,
    query,
    sql_advanced,
    sql_clean,
    sql_count,
    sql_join,
    sql_keywords,
    sql_normalize,
    sql_special,
    sql_squeeze,
    sql_strip_emails,
    sql_strip_urls,
    sql_words,
    table,
)

_FEATURE_SQL = f"""
SELECT doc_id,
  length(title)::INT AS title_length, length(text)::INT AS text_length,
  len(string_split(title, ' '))::INT AS title_word_count,
  len(string_split(text, ' '))::INT AS text_word_count,
  round(length(title) / (length(text) + 1), 6) AS title_text_length_ratio,
  round(len(string_split(title, ' ')) / (len(string_split(text, ' ')) + 1), 6) AS title_text_wordcount_ratio,
  {sql_count("title", "!")} AS title_exclamation_count,
  {sql_count("text", "!")} AS text_exclamation_count,
  {sql_count("title", "[?]")} AS title_question_count,
  {sql_count("text", "[?]")} AS text_question_count,
  round({sql_count("title", "[A-Z]")} / (length(title) + 1), 6) AS title_caps_ratio,
  {sql_count("text", "[0-9]")} AS text_digit_count,
  {sql_special("text")} AS text_specialchar_count,
  CASE WHEN regexp_matches(text, 'https?://') THEN 1 ELSE 0 END AS contains_url,
  {sql_keywords("text", "title")} AS fake_keywords_count,
  {sql_join(sql_words(sql_clean("title")))} AS title_clean,
  {sql_join(sql_words(sql_clean("text")))} AS text_clean
FROM {ARTICLES}
"""


@query(_FEATURE_SQL)
def features(spark, folder):
    df = ft.with_features(articles(spark, folder)).drop("title", "text", "lang", "source")
    ratios = ["title_text_length_ratio", "title_text_wordcount_ratio", "title_caps_ratio"]
    return df.withColumns({c: F.round(c, 6) for c in ratios})


def _loose_count(c: str) -> str:
    return sql_count(c, f"[^{WS}]+")


@query(f"""
SELECT doc_id,
  length(title)::INT AS title_length, length(text)::INT AS text_length,
  {_loose_count("title")} AS title_word_count, {_loose_count("text")} AS text_word_count,
  round(length(title) / (length(text) + 1), 6) AS title_text_length_ratio,
  round({_loose_count("title")} / ({_loose_count("text")} + 1), 6) AS title_text_word_ratio,
  {sql_count("title", "!")} AS title_exclamation_count,
  {sql_count("title", "[?]")} AS title_question_count,
  {sql_count("text", "!")} AS text_exclamation_count,
  {sql_count("text", "[?]")} AS text_question_count,
  round({sql_count("title", chr(92) + "p{Lu}")} / (length(title) + 1), 6) AS title_caps_ratio,
  {sql_count("text", chr(92) + "p{Nd}")} AS text_digit_count,
  {sql_special("text")} AS text_special_char_count,
  CASE WHEN regexp_matches(text, '(?i)http|www|[.]com|[.]org|[.]net') THEN 1 ELSE 0 END AS contains_url,
  {sql_keywords("text", "title", DATA_KEYWORDS)} AS fake_keywords_count
FROM {ARTICLES}
""")
def notebook_features(spark, folder):
    df = ft.with_notebook_features(articles(spark, folder), DATA_KEYWORDS)
    ratios = ["title_text_length_ratio", "title_text_word_ratio", "title_caps_ratio"]
    return df.drop("title", "text", "lang", "source").withColumns({c: F.round(c, 6) for c in ratios})


# ---- rows and columns -----------------------------------------------------------------

_PROPS = "k INT"


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def expand_fields(spark, folder):
    parsed = table(spark, folder, "events").select(
        F.struct("event_id", F.from_json("props", _PROPS).alias("props")).alias("data")
    )
    return ft.expand(parsed, "data").select("event_id", "props.k")


@query("""
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL
""")
def drop_null(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    joined = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    return ft.drop_null(joined, ["quality", "toxic"])


_AFTER_LINE = "regexp_replace(text, '^[^\\n]*', '')"


@query(f"SELECT doc_id, length({_AFTER_LINE})::INT AS size FROM documents WHERE {sql_squeeze(_AFTER_LINE)} <> ''")
def drop_blank(spark, folder):
    # What follows the first line: blank for every text of one line.
    rest = F.regexp_replace("text", r"\A[^\n]*", "")
    df = table(spark, folder, "documents").select("doc_id", rest.alias("rest"))
    return ft.drop_blank(df, "rest").select("doc_id", F.length("rest").alias("size"))


@query("""
SELECT event_id, label::INT AS label FROM (
  SELECT event_id, try_cast(CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN ' 0 '
    WHEN 'error' THEN 'x' WHEN 'signup' THEN '1.0' ELSE '2' END AS DOUBLE) AS label FROM events)
WHERE label IN (0, 1)
""")
def clean_label(spark, folder):
    kind = F.col("event_type")
    dirty = (
        F.when(kind == "click", "1").when(kind == "view", " 0 ").when(kind == "error", "x")
        .when(kind == "signup", "1.0").otherwise("2")
    )
    df = table(spark, folder, "events").select("event_id", dirty.alias("label"))
    return ft.clean_label(df)


@query("SELECT doc_id, quality AS label FROM labels WHERE quality = 0")
def by_label(spark, folder):
    df = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return ft.by_label(df, 0)


@query("SELECT doc_id, length(text)::INT AS size FROM documents WHERE length(text) > 100")
def drop_thin(spark, folder):
    return ft.drop_thin(table(spark, folder, "documents")).select("doc_id", F.length("text").alias("size"))


@query(f"SELECT doc_id, coalesce(title, '') || ' ' || coalesce(text, '') AS title_text FROM {ARTICLES}")
def join_text(spark, folder):
    return articles(spark, folder).select(
        "doc_id", tx.join_text(F.col("title"), F.col("text")).alias("title_text")
    )


@query("SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 5000")
def sample_n(spark, folder):
    return order.sample_n(table(spark, folder, "events").select("event_id"), "event_id", 5000)


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey
LIMIT (SELECT floor(count(*) * 0.0625)::BIGINT FROM orders)
""")
def head_fraction(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return order.head_fraction(df, "o_orderkey", 0.0625)


@query("""
SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id)
  <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test
FROM (SELECT doc_id, quality AS label FROM labels)
""")
def stratified_split(spark, folder):
    df = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    train, test = order.stratified_split(df, "doc_id", "label")
    return train.withColumn("is_test", F.lit(False)).union(test.withColumn("is_test", F.lit(True)))


@query("""
WITH t AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT count(*) AS n FROM t)
SELECT "column", missing, round(missing / n * 100, 6) AS percent FROM (
  SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS missing FROM t
  UNION ALL SELECT 'lang', count(*) - count(lang) FROM t
  UNION ALL SELECT 'quality', count(*) - count(quality) FROM t
  UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM t), n
""")
def missing_profile(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    joined = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    return pf.missing_profile(joined).withColumn("percent", F.round("percent", 6))


@query("""
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text
FROM documents ORDER BY doc_id LIMIT 20
""")
def preview(spark, folder):
    return pf.preview(table(spark, folder, "documents").select("doc_id", "text").orderBy("doc_id"), 20)


@query("""
SELECT doc_id, copy FROM documents, (VALUES (1), (2), (3)) c(copy)
""")
def replicate(spark, folder):
    return ft.replicate(table(spark, folder, "documents").select("doc_id"), 3, "copy")


@query(f"SELECT doc_id, title, label, length(text)::INT AS size FROM {LABELLED}")
def labelled(spark, folder):
    return labelled_articles(spark, folder).select("doc_id", "title", "label", F.length("text").alias("size"))


# ---- single functions over whole texts --------------------------------------------------


def _column(name: str, build, sql: str, source: str = "documents", key: str = "doc_id", places: int | None = None):
    """Register one column function over a whole table."""
    value = f"round({sql}, {places})" if places else sql

    def run(spark, folder):
        df = articles(spark, folder) if source == ARTICLES else table(spark, folder, source)
        column = build()
        return df.select(key, (F.round(column, places) if places else column).alias(name))

    query(f"SELECT {key}, {value} AS {name} FROM {source}", name=name)(run)


def _c(name):
    return F.col(name)


# Commas as question marks, since the data has none.
_ASKED = "replace(text, ',', '?')"

_column("char_length", lambda: F.length("text"), "length(text)::INT")
_column("word_count_space", lambda: tx.word_count(_c("text")), "len(string_split(text, ' '))::INT")
_column("word_count_runs", lambda: tx.word_count(_c("text"), ws=True), _loose_count("text"))
_column("length_ratio", lambda: tx.length_ratio(_c("title"), _c("text")),
        "length(title) / (length(text) + 1)", ARTICLES, places=6)
_column("word_ratio", lambda: tx.word_ratio(_c("title"), _c("text")),
        "len(string_split(title, ' ')) / (len(string_split(text, ' ')) + 1)", ARTICLES, places=6)
_column("bang_count", lambda: tx.bang_count(_c("text")), sql_count("text", "!"))
_column("question_count", lambda: tx.question_count(F.translate("text", ",", "?")), sql_count(_ASKED, "[?]"))
_column("caps_ratio", lambda: tx.caps_ratio(_c("text")),
        f"{sql_count('text', '[A-Z]')} / (length(text) + 1)", places=6)
_column("caps_ratio_unicode", lambda: tx.caps_ratio(_c("text"), uni=True),
        rf"len(regexp_extract_all(text, '\p{{Lu}}')) / (length(text) + 1)", places=6)
_column("digit_count", lambda: tx.digit_count(_c("html")), sql_count("html", "[0-9]"), "pages", "page_id")
_column("special_char_count", lambda: tx.special_char_count(_c("text")), sql_special("text"))
_column("url_flag", lambda: tx.contains_url(_c("url")),
        "CASE WHEN regexp_matches(url, 'https?://') THEN 1 ELSE 0 END", "pages", "page_id")
_column("url_flag_loose", lambda: tx.contains_url(_c("text"), loose=True),
        "CASE WHEN regexp_matches(text, '(?i)http|www|[.]com|[.]org|[.]net') THEN 1 ELSE 0 END")
_column("keyword_score", lambda: tx.keyword_score(_c("text"), _c("title"), DATA_KEYWORDS),
        sql_keywords("text", "title", DATA_KEYWORDS), ARTICLES)
_column("cleaned", lambda: tx.clean(_c("text")), sql_clean("text"))
_column("without_stopwords", lambda: tx.remove_stopwords(tx.clean(_c("text"))),
        sql_join(sql_words(sql_clean("text"))))
_column("cleaned_basic", lambda: tx.clean_basic(_c("text")), sql_join(sql_words(sql_clean("text"), 3)))
_column("urls_stripped", lambda: tx.strip_urls(F.concat(F.lit("see "), "url", F.lit(" now "), "html")),
        sql_strip_urls("('see ' || url || ' now ' || html)"), "pages", "page_id")
_column("emails_stripped", lambda: tx.strip_emails(_c("text")), sql_strip_emails("text"))
_column("squeezed", lambda: tx.squeeze(_c("text")), sql_squeeze("text"))
_column("advanced_words", lambda: F.array_join(tx.advanced_words(_c("text")), " "),
        sql_join(sql_advanced("text")))
_column("normalized", lambda: tx.normalize(_c("text")), sql_normalize("text"))
_column("clipped", lambda: tx.clip(_c("text")), "left(text, 5000) || '...'")
_column("mojibake_repaired",
        lambda: tx.repair_mojibake(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")),
        "replace(replace(text, chr(160), ' '), chr(8203), ' ')")
_column("sigmoid", lambda: tx.sigmoid(F.col("value") / 10 - 3), "1 / (1 + exp(-(value / 10 - 3)))",
        "events", "event_id", places=6)
_column("real_or_fake", lambda: tx.real_or_fake(F.col("value") / 100),
        "CASE WHEN value / 100 >= 0.5 THEN 'real' ELSE 'fake' END", "events", "event_id")
_column("uncertainty_band", lambda: tx.uncertainty_band(F.col("value") / 100, 0.40, 0.125),
        "CASE WHEN value / 100 BETWEEN 0.275 AND 0.525 THEN 'UNCERTAIN' "
        "WHEN value / 100 > 0.525 THEN 'REAL' ELSE 'FAKE' END", "events", "event_id")
_column("sentiment_bucket", lambda: tx.sentiment_bucket(F.col("value") / 50 - 1),
        "CASE WHEN value / 50 - 1 > 0.1 THEN 'Positive' WHEN value / 50 - 1 < -0.1 THEN 'Negative' "
        "ELSE 'Neutral' END", "events", "event_id")
_column("reading_level_of", lambda: tx.reading_level(F.col("value")),
        "CASE WHEN value >= 90 THEN 'Very Easy (5th grade)' WHEN value >= 80 THEN 'Easy (6th grade)' "
        "WHEN value >= 70 THEN 'Fairly Easy (7th grade)' WHEN value >= 60 THEN 'Standard (8th-9th grade)' "
        "WHEN value >= 50 THEN 'Fairly Difficult (10th-12th grade)' "
        "WHEN value >= 30 THEN 'Difficult (college level)' ELSE 'Very Difficult (graduate level)' END",
        "events", "event_id")


@query("""
SELECT doc_id, source, text, title FROM (
  SELECT doc_id, source, text, left(split_part(text, chr(10), 1), 80) AS title FROM documents)
""")
def json_round_trip(spark, folder):
    fields = "source STRING, text STRING, title STRING"
    message = F.to_json(F.struct("source", "text", "title"))
    parsed = articles(spark, folder).select("doc_id", F.from_json(message, fields).alias("data"))
    return parsed.select("doc_id", "data.*")


@query(f"""
SELECT * FROM (SELECT doc_id, 1 - label AS label,
  replace(replace(title || ' ' || text, chr(160), ' '), chr(8203), ' ') AS title_text FROM {LABELLED})
WHERE {sql_squeeze("title_text")} <> ''
""")
def training_text(spark, folder):
    df = labelled_articles(spark, folder).withColumn("label", (1 - F.col("label")).cast("string"))
    return ft.training_text(df).select("doc_id", "label", "title_text")


