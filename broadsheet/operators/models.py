"""TF-IDF classifiers: fit, score, cross-validate."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import boosting
from broadsheet.operators.counts import count_items, count_of_last, frequent, most_common
from broadsheet.operators.curves import auc, classification_report
from broadsheet.session import discard, path_exists, stored

# With the tokenizer's pattern, the same normalization as functions.text.normalize, as text: a saved
# model keeps it.
_NORMALIZE = r"""
SELECT *, CASE WHEN contains(lower(coalesce({col}, '')), 'http') OR contains(lower(coalesce({col}, '')), 'www.')
    THEN regexp_replace(lower(coalesce({col}, '')),
      'https?://[^\\p{{IsWhite_Space}}\\x1c-\\x1f]+|www\\.[^\\p{{IsWhite_Space}}\\x1c-\\x1f]+', '')
    ELSE lower(coalesce({col}, '')) END AS _norm FROM __THIS__
"""


# Of the stages of a TF-IDF model, the first that starts from the words, and the one that drops columns.
_FROM_WORDS, _TIDY = 3, 8


def _text_stages(text: str, stopwords: list[str] | None) -> list:
    normalize = SQLTransformer(statement=_NORMALIZE.format(col=text))
    tokenize = RegexTokenizer(
        inputCol="_norm", outputCol="_all", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2, toLowercase=False
    )
    stop = StopWordsRemover(inputCol="_all", outputCol="_words")
    if stopwords is not None:
        stop.setStopWords(stopwords)
    return [normalize, tokenize, stop]


def _listed(df: DataFrame, text: str, stopwords: list[str] | None, *keep: str) -> DataFrame:
    """The columns to keep and the words of each text as a table of its own: a fit passes over the
    words several times, and taking them from the text is most of the work of a pass."""
    for stage in _text_stages(text, stopwords):
        df = stage.transform(df)
    return stored(df.select(*keep, "_words"), "words")


def _vocabularies(words: DataFrame, k: int, folds: int | None = None) -> list[list[str]]:
    """The k most frequent words and pairs of words, equal counts by term; with `folds`, those of the
    rows outside each fold, all counted in the same passes.

    If there are k words, a pair must be as frequent as the k-th of them, and few pairs are.
    """
    by = [] if folds is None else ["fold"]

    def outside(counts: DataFrame, fold: int | None) -> DataFrame:
        if fold is None:
            return counts
        return counts.where(F.col("fold") != fold).groupBy("term").agg(F.sum("n").alias("n"))

    parts = [None] if folds is None else list(range(folds))
    singles = stored(count_items(words, F.col("_words"), "term", by), "singles")
    least = min(count_of_last(outside(singles, i), k) for i in parts)
    # Without k words the bound is 0, and all pairs are counted.
    pairs = frequent(NGram(n=2, inputCol="_words", outputCol="_pairs").transform(words), F.col("_pairs"), least, "term", by)
    # Equal counts are ordered by term, so a vocabulary is the same every time.
    both = singles.unionByName(pairs)
    tops = [most_common(outside(both, i), k, "term").collect() for i in parts]  # k rows at most
    discard(singles, pairs)
    return [[row["term"] for row in top] for top in tops]


def _fit_tfidf(
    words: DataFrame, vocabulary: list[str], text: str, stopwords: list[str] | None, *keep: str
) -> tuple[PipelineModel, DataFrame | None]:
    """The model and, with columns to keep, a table of these and the counts `_tf` of each text."""
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    join = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_tf")
    counted = counter.transform(join.transform(pairs.transform(words))).select(*keep, "_tf")
    if keep:
        counted = stored(counted, "counted")
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted).idf
    # Spark's idf lacks the + 1 of the smooth form.
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol="_tf", outputCol="_weighted"
    )
    norm = Normalizer(inputCol="_weighted", outputCol="features", p=2.0)
    tidy = SQLTransformer(
        statement="SELECT * EXCEPT (_norm, _all, _words, _pairs, _terms, _tf, _weighted) FROM __THIS__"
    )
    model = PipelineModel([*_text_stages(text, stopwords), pairs, join, counter, scale, norm, tidy])
    return model, counted if keep else None


def fit_tfidf(
    train: DataFrame,
    text: str = "title_text",
    max_features: int = 8000,
    stopwords: list[str] | None = None,
) -> PipelineModel:
    """1-2-gram TF-IDF with smooth idf and L2 norm, as column `features`."""
    words = _listed(train, text, stopwords)
    model, _ = _fit_tfidf(words, _vocabularies(words, max_features)[0], text, stopwords)
    discard(words)
    return model


def logistic_regression(rows: int, c: float = 3.0, max_iter: int = 300) -> LogisticRegression:
    """Ridge logistic regression whose strength is given as C, as a weight of the summed loss."""
    return LogisticRegression(
        maxIter=max_iter, tol=1e-4, regParam=1.0 / (c * max(rows, 1)), standardization=False
    )


class BoostedPipeline:
    """TF-IDF vectors and boosted trees as one model."""

    def __init__(self, vectors: PipelineModel, trees: boosting.BoostedTrees):
        self.vectors, self.trees = vectors, trees

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.score(self.vectors.transform(df))

    def save(self, spark: SparkSession, path: str) -> None:
        self.vectors.write().overwrite().save(f"{path}/vectors")
        rows = spark.createDataFrame(self.trees.to_rows(), boosting.BoostedTrees.ROWS)
        rows.write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedPipeline:
        rows = spark.read.parquet(f"{path}/trees").collect()  # the nodes of the model
        return cls(PipelineModel.load(f"{path}/vectors"), boosting.BoostedTrees.from_rows([tuple(r) for r in rows]))


def fit_classifier(
    train: DataFrame,
    kind: str = "lr",
    text: str = "title_text",
    max_features: int = 8000,
    stopwords: list[str] | None = None,
    **options,
) -> PipelineModel | BoostedPipeline:
    """TF-IDF and a classifier ("lr" or "gbt") as one model, ready to be saved."""
    # The number tells rows with equal vectors apart.
    numbered = train.withColumn("number", F.xxhash64(*train.columns))
    words = _listed(numbered, text, stopwords, "label", "number")
    fitted = _fit_words(words, _vocabularies(words, max_features)[0], kind, text, stopwords, **options)
    discard(words)
    return fitted


def _fit_words(
    words: DataFrame, vocabulary: list[str], kind: str, text: str, stopwords: list[str] | None, **options
) -> PipelineModel | BoostedPipeline:
    """`fit_classifier` from a table (label, number, _words)."""
    vectors, counted = _fit_tfidf(words, vocabulary, text, stopwords, "label", "number")
    scale, norm = vectors.stages[_TIDY - 2 : _TIDY]
    rows = norm.transform(scale.transform(counted)).select("label", "features", "number")
    if kind == "lr":
        # It keeps the vectors it passes over many times; lost ones are made from the counts.
        fitted = PipelineModel([*vectors.stages, logistic_regression(counted.count(), **options).fit(rows)])
    else:
        rows = stored(rows, "vectors")
        fitted = BoostedPipeline(vectors, boosting.fit(rows, boosting.Settings(**options)))
        discard(rows)
    discard(counted)
    return fitted


def score(model: PipelineModel | BoostedPipeline, df: DataFrame) -> DataFrame:
    """The rows with `score`, the probability of label 1; works on streams as well."""
    scored = model.transform(df)
    if isinstance(model, BoostedPipeline):
        return scored
    p = vector_to_array("probability")[1]
    return scored.withColumn("score", p).drop("features", "rawPrediction", "probability")


def cross_validate(
    df: DataFrame,
    key: str,
    folds: int = 5,
    kind: str = "lr",
    max_features: int = 10_000,
    parallelism: int = 1,
    **options,
) -> DataFrame:
    """(fold, accuracy, f1, auc), everything fitted anew on the other folds.

    Rows go to folds by the hash of their key. `parallelism` fits run at a time, each with
    its own cached rows. Boosted trees ("gbt") share the vocabulary of all rows and grow for all
    folds in one pass over the rows.
    """
    if kind == "gbt":
        return _cross_validate_boosted(df, key, folds, max_features, boosting.Settings(**options))
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    marked = df.withColumn("fold", fold.cast("int")).withColumn("number", F.xxhash64(key))
    # The words of a text are the same in every fold.
    words = _listed(marked, "title_text", None, "fold", "label", "number")
    vocabularies = _vocabularies(words, max_features, folds)

    def scored_fold(i: int) -> DataFrame:
        others = words.where(F.col("fold") != i)
        model = _fit_words(others, vocabularies[i], kind, "title_text", None, **options)
        rest = PipelineModel([*model.stages[_FROM_WORDS:_TIDY], *model.stages[_TIDY + 1 :]])
        return score(rest, words.where(F.col("fold") == i)).select("fold", "label", "score")

    with ThreadPool(min(parallelism, folds)) as pool:
        scored = pool.map(inheritable_thread_target(df.sparkSession)(scored_fold), range(folds))
    # Scored once: the report and the area each pass over the rows again.
    every = stored(reduce(DataFrame.unionByName, scored), "folds")
    discard(words)
    return _fold_metrics(every)


def _cross_validate_boosted(
    df: DataFrame, key: str, folds: int, max_features: int, settings: boosting.Settings
) -> DataFrame:
    # The vectors are made from the words that the vocabulary was counted in.
    words = _listed(df, "title_text", None, key, "label")
    vectors, counted = _fit_tfidf(words, _vocabularies(words, max_features)[0], "title_text", None, key, "label")
    discard(words)
    scale, norm = vectors.stages[_TIDY - 2 : _TIDY]
    rows = stored(norm.transform(scale.transform(counted)).select(key, "label", "features"), "vectors")
    discard(counted)
    told = boosting.cross_margins(rows, key, folds, settings)
    discard(rows)
    return _fold_metrics(told.select("fold", "label", (1 / (1 + F.exp(-F.col("margin")))).alias("score")))


def _fold_metrics(every: DataFrame) -> DataFrame:
    """(fold, accuracy, f1, auc) of the scores of each fold."""
    decided = every.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    report = classification_report(decided, by=["fold"]).where("class = 1")
    return report.join(auc(every, by=["fold"]), "fold").select("fold", "accuracy", "f1", "auc")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    return folds.agg(
        *[
            agg
            for m in ("accuracy", "f1", "auc")
            for agg in (F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}"))
        ]
    )


def save(model: PipelineModel | BoostedPipeline, path: str) -> None:
    if isinstance(model, BoostedPipeline):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | BoostedPipeline:
    spark = SparkSession.active()
    return BoostedPipeline.load(spark, path) if path_exists(spark, f"{path}/trees") else PipelineModel.load(path)
