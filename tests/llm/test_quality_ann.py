"""Quality scores by held-out accuracy, neighbours by recall against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from llm import edge
from pyspark.sql import functions as F

from broadsheet.llm import ann, quality, queries


def test_held_out_accuracy(spark):
    """Fitted on every other label, judged on the rest."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = [(r.quality, r.quality_score >= queries.MIN_QUALITY) for r in rest.collect()]
    good, bad = [a for q, a in rows if q], [a for q, a in rows if not q]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_views_teach_each_other(spark):
    """Few labels, many unlabelled documents: what one view is sure of, the other learns."""
    rows, marks = [], []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(f"word{(i * 7 + k) % 50}" for k in range(40)) if good else "BUY!! NOW!! " * 20
        rows.append((i, text, "en", f"{'news' if good else 'spam'}", 200 + i % 9))
        if i < 60:
            marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    for r in quality.score(docs, model).collect():
        assert (r.quality_score >= 0.5) == (r.doc_id % 3 > 0)
        assert 0 <= r.content_score <= 1 and 0 <= r.metadata_score <= 1


def test_all_unlabelled_documents_teach(spark, monkeypatch):
    """A fit on lessons counts every unlabelled document, and no labelled one beyond the sample."""
    rows = [(i, "plain words of text " * 9 if i % 3 else "BUY!! NOW!! " * 20, "en", "news" if i % 3 else "spam", 200) for i in range(16_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.where("doc_id < 1500").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    fitted, fit = [], quality._fit

    def counted(rows, features, label, *more):
        fitted.append(rows.where(F.col(label).isNotNull()).count())
        return fit(rows, features, label, *more)

    monkeypatch.setattr(quality, "_fit", counted)
    assert quality.fit(docs, labels, labelled=600, rounds=1) is not None
    assert max(fitted[:2]) <= 600 and min(fitted[2:4]) >= 14_500
    assert max(fitted[2:4]) <= 14_500 + 600


def test_quality_edges(spark):
    docs = edge.documents(spark).withColumn("quality_score", F.lit("old"))
    labels = docs.select("doc_id", F.col("label").alias("quality")).where("doc_id > 20")
    some = quality.fit(docs, labels)
    for model in (some, None):
        rows = quality.score(docs, model).collect()
        assert len(rows) == len(edge.texts())
        assert set(rows[0].asDict()) == set(docs.columns) | set(quality.SCORES)
        blank = [r for r in rows if not (r.text or "").strip()]
        assert blank and all(r.quality_score == r.content_score == r.metadata_score == 0 for r in blank)
    assert all(r.quality_score == 1 for r in rows if (r.text or "").strip())
    plain = docs.drop("lang", "source", "n_chars")
    assert quality.score(plain, some).count() == len(rows)


def test_quality_without_labels(spark):
    docs = edge.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(40, 1), (41, 1), (None, 0), (42, None)], "doc_id long, quality int")
    clash = spark.createDataFrame([(40, 1), (40, 0)], "doc_id long, quality int")
    assert quality.fit(docs, none) is None and quality.fit(docs, one) is None and quality.fit(docs, clash) is None
    assert quality.fit(edge.empty(spark), one) is None
    assert quality.score(edge.empty(spark), None).count() == 0


def test_quality_query(spark, small):
    rows = queries.op6_quality(spark, small).collect()
    assert len(rows) == 200 and all(r.accepted == (r.quality_score >= 0.5) for r in rows)


def recall_of(rows, ids, vectors, k=20):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -scores[others]))][:k]
        own = sorted(got[int(ids[i])])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        place = {int(v): s for v, s in zip(ids, scores)}
        assert all(abs(place[v] - s) < 1e-12 for _, v, s in own)
        found += len({v for _, v, _ in own} & set(ids[best].tolist()))
        total += len(best)
    return found / total


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in table])
    vectors = np.array([r.embedding for r in table], np.float64)
    assert recall_of(queries.op7_ann(spark, folder).collect(), ids, vectors) >= 0.9


@pytest.mark.parametrize("part_rows, asked_rows", [(50, 10), (50, 1000), (100_000, 10)])
def test_copies_of_one_vector(spark, part_rows, asked_rows):
    """A third of all rows is one vector: ties go to the smaller id, parts stay small."""
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(900, 8))  # of any length
    vectors[::3] = vectors[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(frame, F.col("vec_id") % 20 == 0, recall=1.0, part_rows=part_rows, asked_rows=asked_rows, sample_rows=500)
    assert recall_of(found.collect(), np.arange(900), vectors) >= 0.97


def test_outliers_get_all_their_neighbours(spark):
    """Beside one large cluster, whose queries need one leaf, a few rows lie far off."""
    rnd = np.random.default_rng(6)
    vectors = np.ones((2000, 8)) + rnd.normal(size=(2000, 8)) * 1e-3
    odd = np.arange(0, 2000, 200)
    vectors[odd] = rnd.normal(size=(10, 8)) * 3 - 2
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(0, vectors[0].tolist())] * 30
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(frame, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert len(found) == 100 and all(r["count"] == 20 for r in found)


def test_vectors_that_take_no_part(spark):
    good = [(i, [1.0, float(i)], 1) for i in range(30)]
    odd = [
        (40, None, 1), (41, [0.0, 0.0], 1), (42, [1.0, None], 1), (43, [float("nan"), 1.0], 1), (44, [1.0, float("inf")], 1),
        (45, [1.0], 1), (46, [], 1), (None, [1.0, 1.0], 1), (60, [float("-inf"), 1.0], 1), (20, [1.0, 20.0], 1),
    ]
    frame = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, score int")
    rows = ann.search(frame, F.col("vec_id") % 20 == 0, k=3, recall=1.0).collect()
    assert {r.query_id for r in rows} == {0, 20}
    assert {r.vec_id for r in rows} <= set(range(30))
    assert not [r for r in rows if r.vec_id == r.query_id]
    # The repeated id is a row of its own, but no neighbour of itself.
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 20] == [29, 28, 27]
    few = ann.search(frame.where("vec_id < 3"), F.col("vec_id") % 20 == 0, k=20, recall=1.0).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 1), (2, 2)]
    assert ann.search(frame.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_several_lengths(spark):
    """Each is compared with those of its own length, with a tree or as a leaf."""
    rnd = np.random.default_rng(8)
    kinds = {4: np.arange(0, 600), 3: np.arange(600, 1000), 2: np.arange(1000, 1030), 7: np.array([1040]), 5: np.array([1060, 1061])}
    vectors = {int(i): rnd.normal(size=n) for n, own in kinds.items() for i in own}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    found = ann.search(frame, F.col("vec_id") % 20 == 0, k=5, recall=1.0, leaf_cells=1000, part_rows=100, asked_rows=7)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.rank))
    hits = total = 0
    for own in kinds.values():
        for q in own[own % 20 == 0].tolist():
            others = [i for i in own.tolist() if i != q]
            want = sorted(others, key=lambda i: (-(vectors[i] * vectors[q]).sum(), i))[:5]
            assert [rank for _, rank in got.get(q, [])] == list(range(1, len(want) + 1))
            hits += len({i for i, _ in got.get(q, [])} & set(want))
            total += len(want)
            assert len(own) > 100 or [i for i, _ in got.get(q, [])] == want
    assert hits >= 0.97 * total


def test_bins_of_leaves():
    bins = ann.bins_of({0: 5, 1: 4, 2: 3, 4: 25, 5: 1, 6: 10}, 10)
    assert bins == {0: (0, 1), 1: (0, 1), 2: (1, 1), 4: (2, 3), 5: (5, 1), 6: (6, 1)}


def test_leaves_are_visited_best_first():
    rnd = np.random.default_rng(4)
    vectors = rnd.normal(size=(500, 6))
    length = float(np.sqrt((vectors**2).sum(axis=1).max()))
    tree = ann.Tree.fit(vectors, length, 25)
    order = tree.visits(vectors[3], tree.leaves)
    assert sorted(leaf for _, leaf in order) == list(range(tree.leaves))
    assert tree.visits(vectors[3], 4) == order[:4]
    branch, leaf = tree.place(vectors)
    assert len(set(zip(branch.tolist(), leaf.tolist()))) <= tree.leaves
