"""Order statistics against numpy, with one value or group holding a third of the rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import curves, order
from broadsheet.operators import profile as pf
from broadsheet.operators.lookup import lookup


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 60_000
    v = rng.lognormal(3, 2, n)
    v[: n // 3] = 7.0
    g = np.where(np.arange(n) % 10 < 8, "big", "small")
    rows = list(zip(range(n), g.tolist(), v.tolist()))
    return rows, spark.createDataFrame(rows, "id long, g string, v double").repartition(8).cache()


def test_exact_quantiles_use_brackets(skewed):
    rows, df = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.prob): r.value for r in order.exact_quantiles(df, ["v"], probs, ["g"]).collect()}
    for g in ("big", "small"):
        values = [v for _, h, v in rows if h == g]
        assert len(values) > order.SMALL_GROUP
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_hash_order_gives_exact_numbers(skewed):
    rows, df = skewed

    def by_hash(ids):
        return sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))

    ids = [i for i, _, _ in rows]
    assert {r.id for r in order.sample_n(df, "id", 777).collect()} == set(by_hash(ids)[:777])
    assert order.head_fraction(df, "id", 0.3).count() == int(len(rows) * 0.3)
    assert order.head_fraction(df, "id", 0.0).count() == 0
    assert order.sample_n(df, "id", 10**9).count() == len(rows)
    train, test = order.stratified_split(df, "id", "g")
    want = {i for g in ("big", "small") for i in by_hash([i for i, h, _ in rows if h == g])[: 48_000 // 5 if g == "big" else 12_000 // 5]}
    assert {r.id for r in test.collect()} == want
    assert train.count() == len(rows) - len(want)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(skewed, by):
    rows, df = skewed
    one = df.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    out = order.running_totals(one, "v", ["n"], by, pieces=16)
    got = {(*[r[b] for b in by], r.v): (r.upto_n, r.total_n) for r in out.collect()}
    for g in ("big", "small"):
        values = np.sort(np.array([v for _, h, v in rows if not by or h == g]))
        key = (g,) if by else ()
        for v in np.unique(values)[:: 997].tolist() + [7.0]:
            assert got[(*key, v)] == (int((values >= v).sum()), len(values))


def _auc(labels, scores):
    """Share of positive-negative pairs in the right order, ties half."""
    order_ = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order_] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_areas(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(5)
    score = np.round(rng.random(4000), 2)
    label = (rng.random(4000) < score).astype(int)
    df = spark.createDataFrame(list(zip(label.tolist(), score.tolist())), "label int, score double")
    area = curves.auc(df).first().auc
    assert area == pytest.approx(_auc(label, score), abs=1e-12)
    usual = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert area == pytest.approx(usual, abs=1e-3)
    points = curves.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    assert all(a.tpr <= b.tpr for a, b in zip(points, points[1:]))
    perfect = spark.createDataFrame([(0, 0.1), (1, 0.9)], "label int, score double")
    assert curves.auc(perfect).first().auc == 1.0
    one_class = spark.createDataFrame([(1, 0.1), (1, 0.9)], "label int, score double")
    assert curves.auc(one_class).first().auc is None
    report = curves.classification_report(one_class.withColumn("prediction", F.lit(1)))
    assert {r["class"]: r.support for r in report.collect()} == {0: 0, 1: 2}


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    bins = pf.histogram(df, "v", 4).orderBy("bin").collect()
    assert [b.n for b in bins] == [0, 0, 2, 0] and bins[0].low == 4.5 and bins[3].high == 5.5
    assert pf.histogram(df.where("v is null"), "v", 4).count() == 0


def test_lookup_is_the_same_with_and_without_broadcast(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"w{i % 50}") for i in range(3000)]
    tokens = spark.createDataFrame(rows, "id int, word string")
    table = spark.createDataFrame([("hot", 1.0), *((f"w{i}", float(i)) for i in range(40))], "word string, p double")
    known = {"hot": 1.0} | {f"w{i}": float(i) for i in range(40)}
    want = sorted((i, w, known.get(w)) for i, w in rows)
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        found = lookup(tokens, table, "word").select("id", "word", "p").collect()
        assert sorted(tuple(r) for r in found) == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_large_top_k(spark, monkeypatch):
    from broadsheet.operators import counts

    monkeypatch.setattr(counts, "MANY", 3)
    rows = [(f"w{i:03d}", 100 - i // 4) for i in range(200)]
    df = spark.createDataFrame(rows, "word string, n long").repartition(8)
    for k in (0, 3, 4, 6, 8, 199, 200, 500):
        got = [r.word for r in counts.most_common(df, k).collect()]
        assert got == [w for w, _ in rows[:k]]
