"""Profiles of a table: missing values, summaries, histograms, box plots, crosstabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.lookup import groups_are_few, hint
from broadsheet.operators.order import exact_quantiles, number, unpivot


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing, percent) by falling number of missing values, from one pass.

    NaN is missing as null is.
    """

    def missing(name: str, kind: str):
        null = F.col(name).isNull()
        return null | F.isnan(name) if kind in ("float", "double") else null

    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(c, t)).alias(c) for c, t in df.dtypes]
    )
    long = counts.unpivot(["rows"], df.columns, "column", "missing")
    percent = F.col("missing") / F.col("rows") * 100
    return long.select("column", "missing", percent.alias("percent")).orderBy(
        F.desc("missing"), "column"
    )


def preview(df: DataFrame, n: int = 5, size: int = 200) -> DataFrame:
    """The first n rows with text columns cut to size."""
    from broadsheet.functions.text import preview as cut

    cols = [cut(F.col(c), size).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return df.limit(n).select(*cols)


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return df.dtypes


def mean_by(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(metric, count, mean, std, min, q25, q50, q75, max), one row per column."""
    basic = (
        unpivot(df, cols)
        .groupBy("metric")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    points = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    quartiles = points.groupBy("metric").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
            for p, name in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
        ]
    )
    joined = basic.join(F.broadcast(quartiles), "metric", "left")  # one row per column
    return joined.select("metric", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, n, percent) for each value, null left out."""
    present = df.where(F.col(col).isNotNull())
    counts = present.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.col("n") / total * 100)


def imbalance(counts: DataFrame, limit: float = 1.5) -> DataFrame:
    """Largest over smallest class, flagged when it passes the limit."""
    sizes = counts.agg(F.max("n").alias("majority"), F.min("n").alias("minority"))
    ratio = F.col("majority") / F.col("minority")
    return sizes.withColumn("ratio", ratio).withColumn("imbalanced", F.col("ratio") > limit)


def corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair of the columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    numbers = df.select(*[number(c).alias(c) for c in cols])
    row = numbers.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    a, b = F.split_part("pair", F.lit("|"), F.lit(1)), F.split_part("pair", F.lit("|"), F.lit(2))
    both = F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))
    return long.select(F.inline(F.array_distinct(both)), "corr")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins; the last one includes its upper end.

    The edges need one pass for the range; empty bins are kept with n = 0. Without any
    value there are no bins.
    """
    values = df.select(number(col).alias("v")).where("v is not null")
    flat = F.min("v") == F.max("v")
    low = F.when(flat, F.min("v") - 0.5).otherwise(F.min("v"))
    high = F.when(flat, F.max("v") + 0.5).otherwise(F.max("v"))
    span = values.agg(low.alias("low"), ((high - low) / bins).alias("width"))
    edges = span.where("width is not null").select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", "width"
    )
    edge = span.select(F.struct("low", "width")).scalar()
    spot = F.floor((F.col("v") - edge["low"]) / edge["width"]).cast("int")
    counts = (
        values.select(F.least(spot, F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return edges.join(F.broadcast(counts), "bin", "left").select(  # at most `bins` rows
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and number of outliers per group."""
    points = exact_quantiles(df, [col], [0.25, 0.5, 0.75], [by])
    box = points.groupBy(by).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
            for p, name in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
        ]
    )
    reach = (F.col("q75") - F.col("q25")) * 1.5
    v = F.col("v")
    inside = v.between(F.col("q25") - reach, F.col("q75") + reach)
    values = df.select(by, number(col).alias("v")).where("v is not null")
    return (
        values.join(hint(box, groups_are_few(df, [by])), by)
        .groupBy(by, "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Counts of b's values per value of a, and the same as percent of the row."""
    counts = df.groupBy(a).agg(
        *[F.count_if(F.col(b) == v).alias(f"n_{v}") for v in values],
        F.count_if(F.col(b).isin(*values)).alias("_all"),
    )
    shares = [
        F.try_divide(F.col(f"n_{v}") * 100.0, F.col("_all")).alias(f"pct_{v}") for v in values
    ]
    return counts.select(a, *[f"n_{v}" for v in values], *shares)
