"""Classifiers: scores in range, save and load, the same weights as the relational query."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from broadsheet.operators import models, vectors

GOOD = ["council approves new budget", "minister opens rail bridge", "court upholds tax ruling", "bank reports steady growth"]
BAD = ["shocking secret they hide", "miracle cure leaked online", "aliens exposed by insider", "you wont believe this trick"]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(f"{t} {i}", y) for i in range(10) for y, group in ((1, GOOD), (0, BAD)) for t in group]
    data = [(i, t, y) for i, (t, y) in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, title_text string, label int").coalesce(2).cache()


def test_vectors_equal_the_relational_weights(rows):
    model = models.fit_tfidf(rows, max_features=1000)
    out = model.transform(rows).select("doc_id", F.explode(vector_to_array("features")).alias("w"))
    ml = {}
    for r in out.where("w != 0").collect():
        ml.setdefault(r.doc_id, []).append(round(r.w, 9))
    sql = {}
    for r in vectors.tfidf(rows, "doc_id", "title_text", 1000).collect():
        sql.setdefault(r.doc_id, []).append(round(r.weight, 9))
    assert {k: sorted(v) for k, v in ml.items()} == {k: sorted(v) for k, v in sql.items()}


def test_scores_and_saving(spark, rows, tmp_path):
    model = models.fit_classifier(rows, "lr")
    scored = {r.doc_id: r for r in models.score(model, rows).collect()}
    assert all(0 <= r.score <= 1 for r in scored.values())
    assert all(r.prediction == r.label for r in scored.values())
    models.save(model, str(tmp_path / "model"))
    again = models.score(models.load(str(tmp_path / "model")), rows)
    assert all(r.score == pytest.approx(scored[r.doc_id].score, abs=1e-12) for r in again.collect())


def test_boosted_trees(rows):
    scored = models.score(models.fit_classifier(rows, "gbt", rounds=3), rows).collect()
    assert sum(r.prediction == r.label for r in scored) > len(scored) * 0.7


def test_boosted_trees_are_saved(rows, tmp_path):
    model = models.fit_classifier(rows, "gbt", rounds=4)
    scored = {r.doc_id: r.score for r in models.score(model, rows).collect()}
    models.save(model, str(tmp_path / "boosted"))
    again = models.score(models.load(str(tmp_path / "boosted")), rows).collect()
    assert {r.doc_id: r.score for r in again} == scored and len(set(scored.values())) > 2


def test_vocabularies_of_all_folds_are_those_of_each(spark):
    """One count for all folds, most pairs left out by their bucket, gives what counting every term gives."""
    from collections import Counter

    texts = [(i % 3, [f"w{(i * j) % 11}" for j in range(1, 9)]) for i in range(60)] + [(0, []), (1, ["w1"])]
    words = spark.createDataFrame(texts, "fold int, _words array<string>")

    def wanted(kept, k):
        n = Counter(t for _, w in kept for t in [*w, *map(" ".join, zip(w, w[1:]))])
        return [t for t, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))][:k]

    for k in (5, 15, 500):  # 15 and 500 are more than there are words
        assert models._vocabularies(words, k, 3) == [wanted([t for t in texts if t[0] != i], k) for i in range(3)]
        assert models._vocabularies(words, k)[0] == wanted(texts, k)


def test_folds_take_the_words_from_the_texts_once(spark, rows):
    from broadsheet.session import recorded

    with recorded() as paths:
        models.cross_validate(rows, "doc_id", folds=2, max_iter=5)
    assert sum("/words-" in p for p in paths) == 1


def test_boosted_folds(rows):
    got = models.cross_validate(rows, "doc_id", folds=3, kind="gbt", rounds=5).collect()
    assert {r.fold for r in got} == {0, 1, 2} and all(r.accuracy > 0.6 and r.auc > 0.6 for r in got)


def test_cross_validation(rows):
    folds = models.cross_validate(rows, "doc_id", folds=2, max_iter=20, parallelism=2)
    got = folds.collect()
    assert {r.fold for r in got} == {0, 1} and all(r.accuracy > 0.8 for r in got)
    summary = models.cv_summary(folds).first()
    assert summary.mean_accuracy == pytest.approx(sum(r.accuracy for r in got) / 2)


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a a b c"), (2, None), (3, "c zz a " + "b " * 300)], "id int, t string")
    ids = vectors.word_ids(df.where("id < 3"), "t", num_words=4)
    assert {r.word: r.id for r in ids.collect()} == {"a": 2, "b": 3}
    coded = {r.id: r.ids for r in vectors.encode(df, "id", "t", ids, length=6).collect()}
    assert coded == {1: [2, 2, 3, 1, 0, 0], 2: [0] * 6, 3: [1, 1, 2, 3, 3, 3]}


def test_lemmas_follow_one_rule(spark):
    """Order and repeats of words are kept; the smallest of several lemmas counts, null none."""
    from broadsheet.operators.sentiment import advanced_text, lemmatize

    df = spark.createDataFrame([(1, ["cats", "ran", "cats"]), (2, []), (3, None), (4, ["x"])], "id int, w array<string>")
    lemmas = spark.createDataFrame([("cats", "kitty"), ("cats", "cat"), ("ran", None)], "word string, lemma string")
    want = {1: ["cat", "ran", "cat"], 2: [], 3: None, 4: ["x"]}
    assert {r.id: r.w for r in lemmatize(df, "id", "w", lemmas).collect()} == want
    assert lemmatize(df, "id", "w", lemmas.limit(0)).count() == 4
    texts = spark.createDataFrame([(1, "The CATS ran, at http://x.y!"), (2, None)], "id int, text string")
    out = advanced_text(texts, "id", "text", lemmas)
    assert {r.id: r.text_processed for r in out.collect()} == {1: "cat ran", 2: ""}


def test_sentiment_without_hits_is_zero(spark):
    from broadsheet.operators.sentiment import sentiment

    lexicon = spark.createDataFrame([("good", 0.7, 0.6), ("bad", -0.7, 0.7)], "word string, polarity double, subjectivity double")
    df = spark.createDataFrame([(1, "Good good, BAD"), (2, "plain"), (3, None), (4, "")], "id int, text string")
    got = {r.id: (round(r.sentiment, 6), round(r.subjectivity, 6)) for r in sentiment(df, ["id"], "text", lexicon).collect()}
    assert got == {1: (0.233333, 0.633333), 2: (0, 0), 3: (0, 0), 4: (0, 0)}


def test_readability(spark):
    from broadsheet.operators.sentiment import with_complexity, with_fallback_complexity

    df = spark.createDataFrame([(1, "The cat sat. It ran away!"), (2, ""), (3, None), (4, "...")], "id int, text string")
    got = {r.id: r for r in with_complexity(df).collect()}
    assert got[1].sentence_count == 2 and got[1].syllable_count == 7 and got[1].avg_sentence_length == 3.0
    assert got[1].readability_score == pytest.approx(206.835 - 1.015 * 3 - 84.6 * 7 / 6)
    assert got[1].flesch_kincaid_grade == pytest.approx(0.39 * 3 + 11.8 * 7 / 6 - 15.59)
    for i in (2, 3):
        assert [got[i][c] for c in ("readability_score", "avg_sentence_length", "syllable_count", "sentence_count")] == [0, 0, 0, 0]
    rough = {r.id: r for r in with_fallback_complexity(df).collect()}
    assert (rough[1].syllable_count, rough[1].sentence_count, rough[4].sentence_count) == (9.0, 2, 3)
