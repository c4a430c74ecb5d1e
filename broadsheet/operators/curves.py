"""Evaluation of scored rows (label 0/1, score): curves, areas, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.order import running_totals


def _by_threshold(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Counts of positives and negatives per score, with running totals from the top."""
    y = F.col(label).cast("long")
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(y).alias("tp"), F.sum(1 - y).alias("fp")
    )
    return running_totals(counts, "threshold", ["tp", "fp"], by)


def roc_curve(
    df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None
) -> DataFrame:
    """(by..., threshold, fpr, tpr) for every different score, and (0, 0) above all scores."""
    by = by or []
    points = _by_threshold(df, label, score, by).select(
        *by,
        "threshold",
        F.try_divide(F.col("upto_fp"), F.col("total_fp")).alias("fpr"),
        F.try_divide(F.col("upto_tp"), F.col("total_tp")).alias("tpr"),
    )
    start = [F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")]
    return points.unionByName(_one_per_group(df, by).select(*by, *start))


def _one_per_group(df: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group; without groups one row if there is any."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 0")


def auc(
    df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None
) -> DataFrame:
    """Area under the ROC curve; rows of equal score form one trapezoid."""
    by = by or []
    points = _by_threshold(df, label, score, by)
    # Twice the trapezoid, so that the sum stays in whole numbers.
    strip = F.col("fp") * (2 * F.col("upto_tp") - F.col("tp"))
    area = F.sum(strip.cast("decimal(38,0)")).cast("double")
    box = F.max("total_fp").cast("double") * F.max("total_tp") * 2
    return points.groupBy(*by).agg(F.try_divide(area, box).alias("auc"))


def precision_recall_curve(
    df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None
) -> DataFrame:
    """(by..., threshold, precision, recall) for every different score; the curve ends at
    precision 1 and recall 0 without a threshold."""
    by = by or []
    points = _by_threshold(df, label, score, by).select(
        *by,
        "threshold",
        (F.col("upto_tp") / (F.col("upto_tp") + F.col("upto_fp"))).alias("precision"),
        F.try_divide(F.col("upto_tp"), F.col("total_tp")).alias("recall"),
    )
    end = [F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")]
    return points.unionByName(_one_per_group(df, by).select(*by, *end))


def _cells(label: str, prediction: str):
    y, p = F.col(label), F.col(prediction)
    return {
        "tp": F.count_if((y == 1) & (p == 1)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "fn": F.count_if((y == 1) & (p == 0)),
        "tn": F.count_if((y == 0) & (p == 0)),
    }


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """One row per class: precision, recall, F1, support, and the accuracy of all rows."""
    by = by or []
    cells = df.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(label, prediction).items()])
    real = [F.lit(1).alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed")]
    fake = [F.lit(0).alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")]
    accuracy = F.try_divide(
        F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    )
    rows = cells.select(
        *by, accuracy.alias("accuracy"), F.inline(F.array(F.struct(*fake), F.struct(*real)))
    )
    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")

    def share(part, whole):  # 0 where nothing was predicted or present
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return rows.select(
        *by,
        "class",
        share(hit, hit + wrong).alias("precision"),
        share(hit, hit + missed).alias("recall"),
        share(2 * hit, 2 * hit + wrong + missed).alias("f1"),
        (hit + missed).alias("support"),
        "accuracy",
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(label, prediction, share of all rows), all four cells."""
    cells = df.agg(*[c.alias(n) for n, c in _cells(label, prediction).items()])
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    places = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    entries = [
        F.struct(
            F.lit(y).alias("label"),
            F.lit(p).alias("prediction"),
            F.try_divide(F.col(n), total).alias("share"),
        )
        for y, p, n in places
    ]
    return cells.select(F.inline(F.array(*entries)))


def compare_models(df: DataFrame, model: str = "model", threshold: float = 0.5) -> DataFrame:
    """(model, accuracy, precision, recall, f1, auc) over rows (model, label, score)."""
    decided = df.withColumn("prediction", (F.col("score") >= threshold).cast("int"))
    report = classification_report(decided, by=[model]).where("class = 1")
    areas = auc(df, by=[model])
    return report.join(areas, model).select(
        model, "accuracy", "precision", "recall", "f1", "auc"
    )
