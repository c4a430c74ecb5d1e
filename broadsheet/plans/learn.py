"""Classifier queries over the labelled articles. Models have no SQL to check them against."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from broadsheet.functions.words import STOPWORDS
from broadsheet.operators import curves, features, models, order
from broadsheet.plans.base import (
    LABELLED,
    labelled_articles,
    query,
    rounded,
    sql_list,
    sql_ngrams,
    sql_normalize,
    table,
)
from broadsheet.session import shared_dir, stored


def _rows(spark, folder):
    rows = features.training_text(labelled_articles(spark, folder))
    return stored(rows.select("doc_id", "title_text", "label"), "training")


def _split(spark, folder):
    return order.stratified_split(_rows(spark, folder), "doc_id", "label")


_WORDS = f"""list_filter(string_split({sql_normalize("title_text")}, ' '),
  lambda w: length(w) > 1 AND NOT list_contains({sql_list(STOPWORDS)}, w))"""


@query(f"""
WITH a AS (SELECT doc_id, label, replace(replace(title || ' ' || text, chr(160), ' '), chr(8203), ' ') AS title_text
  FROM {LABELLED}),
t AS (SELECT doc_id, {_WORDS} AS words, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id)
  <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM a),
g AS (SELECT doc_id, is_test, unnest(list_concat(words, {sql_ngrams("words", 2)})) AS term FROM t),
v AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM g WHERE NOT is_test GROUP BY 1
  ORDER BY total DESC, term LIMIT 8000),
w AS (SELECT doc_id, term, count(*) * (ln((1 + (SELECT count(*) FROM t WHERE NOT is_test)) / (1 + max(df))) + 1) AS w
  FROM g JOIN v USING (term) WHERE is_test GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 6) AS weights FROM w GROUP BY 1)
SELECT doc_id, coalesce(terms, 0) AS terms, coalesce(weights, 0) AS weights
FROM t LEFT JOIN n USING (doc_id) WHERE is_test
""")
def vectorized(spark, folder):
    train, test = _split(spark, folder)
    out = models.fit_tfidf(train, stopwords=STOPWORDS).transform(test)
    weights = F.filter(vector_to_array("features"), lambda w: w != 0)
    total = F.aggregate(weights, F.lit(0.0), lambda t, w: t + w)
    return out.select("doc_id", F.size(weights).alias("terms"), F.round(total, 6).alias("weights"))


@query()
def logistic_scores(spark, folder):
    train, test = _split(spark, folder)
    scored = models.score(models.fit_classifier(train, "lr"), test)
    return scored.select("doc_id", "label", "prediction", *rounded("score"))


@query()
def boosted_scores(spark, folder):
    train, test = _split(spark, folder)
    scored = models.score(models.fit_classifier(train, "gbt"), test)
    return scored.select("doc_id", "label", "prediction", *rounded("score"))


@query()
def fitted_comparison(spark, folder):
    """The fitted classifiers side by side on one test set."""
    train, test = _split(spark, folder)
    scored = [
        models.score(models.fit_classifier(train, kind), test).select(F.lit(kind).alias("model"), "label", "score")
        for kind in ("lr", "gbt")
    ]
    return curves.compare_models(stored(scored[0].unionByName(scored[1]), "compared"))


@query()
def cross_validation(spark, folder):
    return models.cross_validate(_rows(spark, folder), "doc_id", kind="lr", parallelism=5)


@query()
def cross_validation_summary(spark, folder):
    return models.cv_summary(models.cross_validate(_rows(spark, folder), "doc_id", kind="lr", parallelism=5))


@query()
def boosted_cross_validation(spark, folder):
    """Five boosted models that grow side by side."""
    return models.cross_validate(_rows(spark, folder), "doc_id", kind="gbt")


@query()
def saved_model_scores(spark, folder):
    """A model saved and loaded again, applied to short texts it has not seen."""
    train, _ = _split(spark, folder)
    path = shared_dir(spark, "model")
    models.save(models.fit_classifier(train, "lr"), path)
    fresh = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("title_text"))
    return models.score(models.load(path), fresh).select("item_id", "prediction", *rounded("score"))


@query()
def classifier_report(spark, folder):
    train, test = _split(spark, folder)
    return curves.classification_report(models.score(models.fit_classifier(train, "lr"), test))
