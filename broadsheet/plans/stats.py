"""Profiles, statistics and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators import curves
from broadsheet.operators import profile as pf
from broadsheet.operators import sentiment
from broadsheet.plans.base import (
    LABELLED,
    SCORED,
    labelled_articles,
    labelled_lengths,
    query,
    rounded,
    scored_rows,
    sql_count,
    table,
)


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, folder):
    return pf.row_count(table(spark, folder, "lineitem"))


@query(f"""
SELECT label, round(avg(length(title)), 6) AS mean_title_length,
  round(avg(length(text)), 6) AS mean_text_length FROM {LABELLED} GROUP BY label
""")
def mean_by_label(spark, folder):
    df = labelled_lengths(spark, folder)
    means = pf.mean_by(df, "label", ["title_length", "text_length"])
    return means.select("label", *rounded("mean_title_length", "mean_text_length"))


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS metric, count({column}) AS count, round(avg({column}), 4) AS mean,
      round(stddev_samp({column}), 4) AS std, min({column}) AS min,
      round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS q50,
      round(quantile_cont({column}, 0.75), 6) AS q75, max({column}) AS max FROM lineitem"""


@query(" UNION ALL ".join(_describe_sql(c) for c in _LINE_COLUMNS))
def describe(spark, folder):
    out = pf.describe(table(spark, folder, "lineitem"), _LINE_COLUMNS)
    return out.select(
        "metric", "count", *rounded("mean", "std", places=4), "min", *rounded("q25", "q50", "q75"), "max"
    )


# Missing values in two forms: the tax of every seventh line is NaN, the discount null.
_GAPS = """(SELECT l_quantity, CASE WHEN l_linenumber <> 7 THEN l_tax END AS l_tax,
  CASE WHEN l_linenumber <> 6 THEN l_discount END AS l_discount FROM lineitem)"""


def _with_gaps(spark, folder):
    line = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_quantity",
        F.when(line != 7, F.col("l_tax")).otherwise(float("nan")).alias("l_tax"),
        F.when(line != 6, F.col("l_discount")).alias("l_discount"),
    )


@query(" UNION ALL ".join(_describe_sql(c).replace("FROM lineitem", f"FROM {_GAPS}") for c in ("l_tax", "l_discount")))
def describe_with_gaps(spark, folder):
    out = pf.describe(_with_gaps(spark, folder), ["l_tax", "l_discount"])
    return out.select(
        "metric", "count", *rounded("mean", "std", places=4), "min", *rounded("q25", "q50", "q75"), "max"
    )


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, "
    f"round((count(*) - count({c})) / count(*) * 100, 6) AS percent FROM {_GAPS}"
    for c in ("l_quantity", "l_tax", "l_discount")
))
def missing_with_gaps(spark, folder):
    return pf.missing_profile(_with_gaps(spark, folder)).withColumn("percent", F.round("percent", 6))


@query(f"""
WITH t AS (SELECT l_tax AS v FROM {_GAPS} WHERE l_tax IS NOT NULL),
r AS (SELECT min(v) AS low, (max(v) - min(v)) / 5 AS width FROM t),
b AS (SELECT least(floor((v - low) / width), 4)::INT AS bin, count(*) AS n FROM t, r GROUP BY 1)
SELECT bin, n FROM b
""")
def histogram_with_gaps(spark, folder):
    return pf.histogram(_with_gaps(spark, folder), "l_tax", 5).where("n > 0").select("bin", "n")


@query("""
SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders) * 100, 6) AS percent
FROM orders GROUP BY 1
""")
def value_counts(spark, folder):
    counts = pf.value_counts(table(spark, folder, "orders"), "o_orderpriority")
    return counts.withColumn("percent", F.round("percent", 6))


@query(f"""
WITH c AS (SELECT label, count(*) AS n FROM {LABELLED} GROUP BY label)
SELECT max(n) AS majority, min(n) AS minority, round(max(n) / min(n), 6) AS ratio,
  max(n) / min(n) > 1.5 AS imbalanced FROM c
""")
def class_imbalance(spark, folder):
    counts = pf.value_counts(labelled_articles(spark, folder), "label")
    return pf.imbalance(counts).withColumn("ratio", F.round("ratio", 6))


def _corr_sql(cols: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM {source}"
        for a in cols
        for b in cols
    )


_LENGTHS = f"(SELECT label, length(title) AS title_length, length(text) AS text_length FROM {LABELLED})"


@query(_corr_sql(["text_length", "title_length", "label"], _LENGTHS))
def correlation(spark, folder):
    df = labelled_lengths(spark, folder)
    return pf.corr(df, ["text_length", "title_length", "label"]).withColumn("corr", F.round("corr", 6))


@query("""
WITH r AS (SELECT min(length(text)) AS low, (max(length(text)) - min(length(text))) / 50 AS width FROM documents),
b AS (SELECT least(floor((length(text) - low) / width), 49)::INT AS bin, count(*) AS n FROM documents, r GROUP BY 1)
SELECT g.bin::INT AS bin, round(low + g.bin * width, 6) AS low, round(low + (g.bin + 1) * width, 6) AS high,
  coalesce(n, 0) AS n FROM range(50) g(bin) CROSS JOIN r LEFT JOIN b ON b.bin = g.bin
""")
def histogram(spark, folder):
    df = table(spark, folder, "documents").select(F.length("text").alias("size"))
    return pf.histogram(df, "size", 50).select("bin", *rounded("low", "high"), "n")


@query("""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25,
  quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.75) AS q75
  FROM lineitem GROUP BY 1),
v AS (SELECT q.*, l_extendedprice AS v,
  l_extendedprice BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5 AS inside
  FROM lineitem JOIN q USING (l_returnflag))
SELECT l_returnflag, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
  min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers FROM v GROUP BY l_returnflag, q25, q50, q75
""")
def box_stats(spark, folder):
    out = pf.box_stats(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


@query(f"""
WITH t AS (SELECT label, length(text) AS size FROM {LABELLED}),
q AS (SELECT label, quantile_cont(size, 0.25) AS q25, quantile_cont(size, 0.5) AS q50,
  quantile_cont(size, 0.75) AS q75 FROM t GROUP BY 1),
v AS (SELECT q.*, size::DOUBLE AS v,
  size BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5 AS inside FROM t JOIN q USING (label))
SELECT label, q25, q50, q75, min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers FROM v GROUP BY label, q25, q50, q75
""")
def box_stats_by_label(spark, folder):
    return pf.box_stats(labelled_lengths(spark, folder), "text_length", "label")


_BUCKET = """CASE WHEN value / 50 - 1 > 0.1 THEN 'Positive'
  WHEN value / 50 - 1 < -0.1 THEN 'Negative' ELSE 'Neutral' END"""


@query(f"""
WITH t AS (SELECT event_type, {_BUCKET} AS category FROM events),
c AS (SELECT event_type, count(*) FILTER (category = 'Negative') AS n_Negative,
  count(*) FILTER (category = 'Neutral') AS n_Neutral,
  count(*) FILTER (category = 'Positive') AS n_Positive, count(*) AS total FROM t GROUP BY 1)
SELECT event_type, n_Negative, n_Neutral, n_Positive, round(n_Negative * 100.0 / total, 6) AS pct_Negative,
  round(n_Neutral * 100.0 / total, 6) AS pct_Neutral, round(n_Positive * 100.0 / total, 6) AS pct_Positive FROM c
""")
def crosstab(spark, folder):
    df = table(spark, folder, "events").withColumn(
        "category", tx.sentiment_bucket(F.col("value") / 50 - 1)
    )
    names = ["Negative", "Neutral", "Positive"]
    out = pf.crosstab(df, "event_type", "category", names)
    return out.withColumns({f"pct_{n}": F.round(f"pct_{n}", 6) for n in names})


# ---- evaluation of scored rows ------------------------------------------------------------

_CURVE = f"""c AS (SELECT score AS threshold, sum(label) AS tp, sum(1 - label) AS fp FROM {SCORED} GROUP BY 1),
u AS (SELECT threshold, sum(tp) OVER w AS utp, sum(fp) OVER w AS ufp, sum(tp) OVER () AS p,
  sum(fp) OVER () AS n, tp, fp FROM c WINDOW w AS (ORDER BY threshold DESC))"""


@query(f"WITH {_CURVE} SELECT threshold, round(ufp / n, 6) AS fpr, round(utp / p, 6) AS tpr FROM u "
       "UNION ALL SELECT 'inf'::DOUBLE, 0, 0")
def roc_curve(spark, folder):
    return curves.roc_curve(scored_rows(spark, folder)).select("threshold", *rounded("fpr", "tpr"))


@query(f"WITH {_CURVE} SELECT round(sum(fp * (2 * utp - tp)) / (2.0 * max(n) * max(p)), 6) AS auc FROM u")
def roc_auc(spark, folder):
    return curves.auc(scored_rows(spark, folder)).select(*rounded("auc"))


@query(f"""WITH {_CURVE}
SELECT threshold, round(utp / (utp + ufp), 6) AS precision, round(utp / p, 6) AS recall FROM u
UNION ALL SELECT NULL, 1, 0""")
def precision_recall(spark, folder):
    out = curves.precision_recall_curve(scored_rows(spark, folder))
    return out.select("threshold", *rounded("precision", "recall"))


_CELLS = """cells AS (SELECT count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp,
  count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 0 AND p = 0) AS tn FROM t)"""
_DECIDED = f"t AS (SELECT label, (score >= 0.5)::INT AS p FROM {SCORED})"


@query(f"""WITH {_DECIDED}, {_CELLS}
SELECT 1 AS class, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM cells
UNION ALL SELECT 0, round(tn / (tn + fn), 6), round(tn / (tn + fp), 6), round(2 * tn / (2 * tn + fp + fn), 6),
  tn + fp, round((tp + tn) / (tp + tn + fp + fn), 6) FROM cells""")
def classification_report(spark, folder):
    df = scored_rows(spark, folder).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    out = curves.classification_report(df)
    return out.select("class", *rounded("precision", "recall", "f1"), "support", *rounded("accuracy"))


@query(f"""WITH {_DECIDED}
SELECT label, p AS prediction, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY 1, 2""")
def confusion_matrix(spark, folder):
    df = scored_rows(spark, folder).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return curves.confusion_matrix(df).withColumn("share", F.round("share", 6))


@query(f"""WITH s AS (SELECT * FROM {SCORED}),
c AS (SELECT model, score, sum(label) AS tp, sum(1 - label) AS fp FROM s GROUP BY 1, 2),
u AS (SELECT model, tp, fp, sum(tp) OVER (PARTITION BY model ORDER BY score DESC) AS utp FROM c),
a AS (SELECT model, sum(fp * (2 * utp - tp)) / (2.0 * sum(fp) * sum(tp)) AS auc FROM u GROUP BY 1),
k AS (SELECT model, count(*) FILTER (label = 1 AND score >= 0.5) AS tp,
  count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
  count(*) FILTER (label = 0 AND score < 0.5) AS tn FROM s GROUP BY 1)
SELECT model, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(auc, 6) AS auc
FROM k JOIN a USING (model)""")
def model_comparison(spark, folder):
    out = curves.compare_models(scored_rows(spark, folder))
    return out.select("model", *rounded("accuracy", "precision", "recall", "f1", "auc"))


# ---- readability --------------------------------------------------------------------------

_READ = f"""(SELECT doc_id, {sql_count("text", r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]+")} AS w,
  greatest({sql_count("text", "[.!?]+")}, 1) AS s, {sql_count("lower(text)", "[aeiouy]+")} AS y,
  greatest({sql_count("text", "[.!?]")}, 1) AS marks FROM documents)"""
_EASE = "CASE WHEN w > 0 THEN 206.835 - 1.015 * (w / s) - 84.6 * (y / w) ELSE 0 END"
_GRADE = "CASE WHEN w > 0 THEN 0.39 * (w / s) + 11.8 * (y / w) - 15.59 ELSE 0 END"


@query(f"""
SELECT doc_id, round({_EASE}, 6) AS readability_score, round(w / s, 6) AS avg_sentence_length,
  y AS syllable_count, round({_GRADE}, 6) AS flesch_kincaid_grade, s AS sentence_count FROM {_READ}
""")
def readability(spark, folder):
    df = sentiment.with_complexity(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    doubles = ["readability_score", "avg_sentence_length", "flesch_kincaid_grade"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query(f"""
SELECT doc_id, 50.0::DOUBLE AS readability_score, round(w / marks, 6) AS avg_sentence_length,
  (w * 1.5)::DOUBLE AS syllable_count, 8.0::DOUBLE AS flesch_kincaid_grade, marks AS sentence_count FROM {_READ}
""")
def readability_fallback(spark, folder):
    df = sentiment.with_fallback_complexity(table(spark, folder, "documents").select("doc_id", "text"))
    return df.drop("text").withColumn("avg_sentence_length", F.round("avg_sentence_length", 6))


@query(f"""
WITH m AS (SELECT avg({_EASE}) AS mean_score FROM {_READ})
SELECT round(mean_score, 6) AS mean_score, CASE WHEN mean_score >= 90 THEN 'Very Easy (5th grade)'
  WHEN mean_score >= 80 THEN 'Easy (6th grade)' WHEN mean_score >= 70 THEN 'Fairly Easy (7th grade)'
  WHEN mean_score >= 60 THEN 'Standard (8th-9th grade)'
  WHEN mean_score >= 50 THEN 'Fairly Difficult (10th-12th grade)'
  WHEN mean_score >= 30 THEN 'Difficult (college level)' ELSE 'Very Difficult (graduate level)' END AS level FROM m
""")
def reading_level(spark, folder):
    df = sentiment.with_complexity(table(spark, folder, "documents").select("text"))
    return sentiment.reading_level(df).withColumn("mean_score", F.round("mean_score", 6))


_METRICS = [
    "readability_score", "avg_sentence_length", "syllable_count", "flesch_kincaid_grade", "sentence_count",
]


@query(_corr_sql(_METRICS, f"""(SELECT {_EASE} AS readability_score, w / s AS avg_sentence_length,
  y AS syllable_count, {_GRADE} AS flesch_kincaid_grade, s AS sentence_count FROM {_READ})"""))
def readability_correlation(spark, folder):
    df = sentiment.with_complexity(table(spark, folder, "documents").select("text"))
    return pf.corr(df, _METRICS).withColumn("corr", F.round("corr", 6))
