"""Word, n-gram, lemma, sentiment and TF-IDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.words import STOPWORDS
from broadsheet.operators import counts, vectors
from broadsheet.operators import sentiment as st
from broadsheet.operators.features import labelled
from broadsheet.plans.base import (
    ARTICLES,
    LABELLED,
    articles,
    labelled_articles,
    query,
    rounded,
    sql_advanced,
    sql_clean,
    sql_join,
    sql_list,
    sql_ngrams,
    sql_normalize,
    sql_words,
    table,
)
from broadsheet.session import stored

_BOTH = "concat_ws(' ', text, title)"
_BASIC = f"(SELECT unnest({sql_words(sql_clean(_BOTH), 3)}) AS word FROM {ARTICLES})"


@query(f"SELECT word, count(*) AS n FROM {_BASIC} GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def word_frequency(spark, folder):
    return counts.word_freq(articles(spark, folder), 20)


@query(f"SELECT count(DISTINCT word) AS unique_words, count(*) AS total_words FROM {_BASIC}")
def vocabulary_size(spark, folder):
    return counts.vocabulary_size(articles(spark, folder))


@query(f"SELECT word, count(*) AS n FROM {_BASIC} GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def cloud_words(spark, folder):
    return counts.word_freq(articles(spark, folder), 100)


@query(f"""
WITH w AS (SELECT label, unnest({sql_words(sql_clean("text"), 3)}) AS word FROM {LABELLED}),
c AS (SELECT label, word, count(*) AS n FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM c)
SELECT label, word, n, rank, round(n / max(n) OVER (PARTITION BY label), 6) AS weight FROM r WHERE rank <= 100
""")
def class_words(spark, folder):
    out = counts.class_words(labelled_articles(spark, folder), 100)
    return out.withColumn("weight", F.round("weight", 6))


@query(f"""
WITH w AS (SELECT lang, unnest({sql_words(sql_clean("text"), 3)}) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10
""")
def top_words_per_class(spark, folder):
    kept = tx.words(tx.clean(F.col("text")), min_length=3)
    per_lang = counts.count_items(table(spark, folder, "documents"), kept, by=["lang"])
    return counts.top_k(per_lang, "lang", 10)


def _top_grams(name: str, n: int, k: int, bounded: bool = False) -> None:
    def run(spark, folder):
        words = F.concat(tx.advanced_words(F.col("text")), tx.advanced_words(F.col("title")))
        df = articles(spark, folder).select(words.alias("words"))
        if bounded:
            return counts.heavy_hitters(df, tx.ngrams(F.col("words"), n), k, "gram")
        return counts.top_ngrams(df, F.col("words"), n, k)

    words = f"list_concat({sql_advanced('text')}, {sql_advanced('title')})"
    query(
        f"""WITH w AS (SELECT {words} AS words FROM {ARTICLES}),
        g AS (SELECT unnest({sql_ngrams("words", n)}) AS gram FROM w)
        SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT {k}""",
        name=name,
    )(run)


_top_grams("top_unigrams", 1, 20)
_top_grams("top_bigrams", 2, 15)
_top_grams("top_trigrams", 3, 10)
# The same without a shuffle of all different n-grams.
_top_grams("heavy_bigrams", 2, 15, bounded=True)
_top_grams("heavy_trigrams", 3, 10, bounded=True)


@query(f"""
WITH w AS (SELECT conv_id, turn, {sql_words(sql_clean("text"))} AS words FROM conversations)
SELECT conv_id, turn, array_to_string({sql_ngrams("words", 3)}, '|') AS grams FROM w
""")
def ngram_lists(spark, folder):
    words = tx.words(tx.clean(F.col("text")))
    df = table(spark, folder, "conversations").select("conv_id", "turn", words.alias("words"))
    return df.select("conv_id", "turn", F.array_join(tx.ngrams(F.col("words"), 3), "|").alias("grams"))


@query(f"""
WITH t AS (SELECT text, {sql_join(sql_words(sql_clean("text"), 3))} AS done FROM documents)
SELECT sum(length(text))::BIGINT AS chars_before, sum(length(done))::BIGINT AS chars_after,
  round((sum(length(text)) - sum(length(done))) * 100.0 / sum(length(text)), 6) AS percent_removed FROM t
""")
def cleaning_reduction(spark, folder):
    df = table(spark, folder, "documents").select("text", tx.clean_basic(F.col("text")).alias("done"))
    return counts.reduction(df, "text", "done").withColumn("percent_removed", F.round("percent_removed", 6))


_ADVANCED = {c: sql_join(sql_advanced(c)) for c in ("title", "text")}


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS part, sum(length({c}))::BIGINT AS chars_before, sum(length(done))::BIGINT AS chars_after,
    round((sum(length({c})) - sum(length(done))) * 100.0 / sum(length({c})), 6) AS percent_removed
    FROM (SELECT {c}, {done} AS done FROM {ARTICLES})"""
    for c, done in _ADVANCED.items()
))
def advanced_reduction(spark, folder):
    """What advanced cleaning takes from titles and texts."""
    df = articles(spark, folder)
    parts = F.array(F.struct(F.lit("title").alias("part"), F.col("title").alias("t")), F.struct(F.lit("text").alias("part"), F.col("text").alias("t")))
    rows = df.select(F.inline(parts)).withColumn("done", F.array_join(tx.advanced_words(F.col("t")), " "))
    return counts.reduction(rows, "t", "done", by=["part"]).withColumn("percent_removed", F.round("percent_removed", 6))


# ---- lemmas and sentiment: tables made from the words of other tables ---------------------

_LEMMAS = f"""(SELECT DISTINCT word, left(word, length(word) - 1) AS lemma FROM (
  SELECT unnest({sql_words(sql_clean("text"), 3)}) AS word FROM {{}}) WHERE word LIKE '%s')"""


def _lemmas(spark, folder, source):
    words = tx.words(tx.clean(F.col("text")), min_length=3)
    found = table(spark, folder, source).select(F.explode(words).alias("word")).distinct()
    return found.where(F.col("word").endswith("s")).withColumn(
        "lemma", F.expr("substring(word, 1, length(word) - 1)")
    )


def _lemma_sql(source: str) -> str:
    return f"""
    WITH l AS {_LEMMAS.format(source)},
    t AS (SELECT doc_id, {sql_advanced("text")} AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM t),
    j AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS text_processed
      FROM w LEFT JOIN l USING (word) GROUP BY 1)
    SELECT doc_id, coalesce(text_processed, '') AS text_processed FROM t LEFT JOIN j USING (doc_id)"""


@query(_lemma_sql("benchmark"))
def lemmatized(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    return st.advanced_text(df, "doc_id", "text", _lemmas(spark, folder, "benchmark")).drop("text")


@query(_lemma_sql("conversations"))
def lemmatized_by_join(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    lemmas = stored(_lemmas(spark, folder, "conversations"), "lemmas")
    # Each word twice and once without a lemma: the smallest lemma counts.
    more = lemmas.select("word", F.concat("lemma", F.lit("z"))).union(lemmas.select("word", F.lit(None)))
    return st.advanced_text(df, "doc_id", "text", lemmas.union(more)).drop("text")


_FOUND = r"unnest(regexp_extract_all(lower({}), '[\p{{L}}'']+'))"
_LEXICON = f"""lexicon AS (SELECT DISTINCT word, (length(word) % 5 - 2) / 2.0 AS polarity,
  (length(word) % 4) / 4.0 AS subjectivity FROM (SELECT {_FOUND.format("text")} AS word FROM benchmark))"""


def _lexicon(spark, folder):
    """A polarity for each word of `benchmark`, made up from its length."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}']+"), F.lit(0))
    words = table(spark, folder, "benchmark").select(F.explode(found).alias("word")).distinct()
    size = F.length("word")
    return words.select(
        "word", ((size % 5 - 2) / 2.0).alias("polarity"), ((size % 4) / 4.0).alias("subjectivity")
    )


def _scores_sql(source: str, keys: str) -> str:
    return f"""{_LEXICON}, d AS (SELECT * FROM {source}),
    w AS (SELECT {keys}, {_FOUND.format("text")} AS word FROM d),
    a AS (SELECT {keys}, avg(polarity) AS p, avg(subjectivity) AS s FROM w JOIN lexicon USING (word) GROUP BY ALL),
    scores AS (SELECT d.*, coalesce(p, 0) AS sentiment, coalesce(s, 0) AS subjectivity
      FROM d LEFT JOIN a USING ({keys}))"""


def _labelled_scores(spark, folder):
    # Scored before the join, so that no text is shuffled.
    docs = table(spark, folder, "documents")
    scores = st.sentiment(docs, ["doc_id"], "text", _lexicon(spark, folder))
    return labelled(scores, table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")))


@query(f"""WITH {_scores_sql("documents", "doc_id")}
SELECT doc_id, round(sentiment, 6) AS sentiment, round(subjectivity, 6) AS subjectivity FROM scores""")
def sentiment(spark, folder):
    df = st.sentiment(table(spark, folder, "documents"), ["doc_id"], "text", _lexicon(spark, folder))
    return df.select("doc_id", *rounded("sentiment", "subjectivity"))


@query(f"""WITH {_scores_sql(LABELLED, "doc_id, label")}
SELECT label, round(avg(sentiment), 6) AS mean_sentiment, round(stddev_samp(sentiment), 6) AS std_sentiment,
  round(avg(subjectivity), 6) AS mean_subjectivity, round(stddev_samp(subjectivity), 6) AS std_subjectivity
FROM scores GROUP BY label""")
def sentiment_by_label(spark, folder):
    df = _labelled_scores(spark, folder)
    out = st.sentiment_stats(df, ["sentiment", "subjectivity"], by="label")
    return out.select("label", *rounded(*[c for c in out.columns if c != "label"]))


_BOTH = ["title_sentiment", "title_subjectivity", "text_sentiment", "text_subjectivity"]
_PARTS = f"""(SELECT doc_id, 'title' AS part, title AS text FROM {ARTICLES}
  UNION ALL SELECT doc_id, 'text', text FROM {ARTICLES})"""
_BOTH_SQL = f"""{_scores_sql(_PARTS, "doc_id, part")},
both_scores AS (SELECT doc_id, {", ".join(f"max({c}) FILTER (part = '{p}') AS {p}_{c}"
  for p in ("title", "text") for c in ("sentiment", "subjectivity"))} FROM scores GROUP BY doc_id)"""


def _both_scores(spark, folder):
    return st.title_and_text(articles(spark, folder), ["doc_id"], _lexicon(spark, folder))


@query(f"WITH {_BOTH_SQL} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in _BOTH)} FROM both_scores")
def title_text_sentiment(spark, folder):
    return _both_scores(spark, folder).select("doc_id", *rounded(*_BOTH))


@query(f"""WITH {_BOTH_SQL} SELECT label, {", ".join(
  f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in _BOTH)}
FROM both_scores JOIN (SELECT doc_id, quality AS label FROM labels) USING (doc_id) GROUP BY label""")
def title_text_sentiment_by_label(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    out = st.sentiment_stats(labelled(_both_scores(spark, folder), labels), _BOTH, by="label")
    return out.select("label", *rounded(*[c for c in out.columns if c != "label"]))


@query(f"""WITH {_scores_sql(LABELLED, "doc_id, label")}
SELECT label, CASE WHEN sentiment > 0.1 THEN 'Positive' WHEN sentiment < -0.1 THEN 'Negative' ELSE 'Neutral' END
  AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY label), 6) AS percent
FROM scores GROUP BY 1, 2""")
def sentiment_categories(spark, folder):
    df = _labelled_scores(spark, folder)
    out = st.category_shares(df.withColumn("category", tx.sentiment_bucket(F.col("sentiment"))), "label")
    return out.withColumn("percent", F.round("percent", 6))


# ---- TF-IDF and word ids ------------------------------------------------------------------

_TERMS = f"""t AS (SELECT doc_id, list_filter(string_split({sql_normalize("text")}, ' '),
  lambda w: length(w) > 1 AND NOT list_contains({sql_list(STOPWORDS)}, w)) AS words FROM documents),
g AS (SELECT doc_id, unnest(list_concat(words, {sql_ngrams("words", 2)})) AS term FROM t)"""


@query(f"""WITH {_TERMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 8000),
r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
  FROM tf JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 5) AS weight FROM r""")
def tfidf(spark, folder):
    out = vectors.tfidf(table(spark, folder, "documents"), "doc_id", "text", 8000, STOPWORDS)
    return out.withColumn("weight", F.round("weight", 5))


_IDS = f"""ids AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 1 AS id FROM (
  SELECT unnest(string_split({sql_normalize("text")}, ' ')) AS word FROM documents)
  WHERE word <> '' GROUP BY word QUALIFY id < 10000)"""


@query(f"WITH {_IDS} SELECT word, id::INT AS id FROM ids")
def word_ids(spark, folder):
    return vectors.word_ids(table(spark, folder, "documents"), "text")


@query(f"""WITH {_IDS}, t AS (SELECT doc_id, list_filter(string_split({sql_normalize("text")}, ' '),
  lambda w: w <> '')[1:256] AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM t),
e AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS codes FROM w LEFT JOIN ids USING (word) GROUP BY 1)
SELECT doc_id, array_to_string(list_resize(coalesce(codes, []), 256, 0), ' ') AS ids
FROM t LEFT JOIN e USING (doc_id)""")
def encoded(spark, folder):
    df = table(spark, folder, "documents")
    ids = stored(vectors.word_ids(df, "text"), "ids")
    out = vectors.encode(df, "doc_id", "text", ids)
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
