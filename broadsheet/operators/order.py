"""Exact order statistics without a global sort in one task.

A window over a whole table, or over one of two labels, puts everything into one task.
The operators here first find out, from counts and quantile sketches, which small part
of the data decides the answer, and order only that part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.operators.lookup import groups_are_few, hint
from broadsheet.session import stored

SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 0.001  # ten times the rank error of the sketch
SMALL_GROUP = 10_000  # below this size all values are kept instead of a bracket


def hash_of(key: str | Column) -> Column:
    """Repeatable random order of rows: the hash of their key."""
    return F.md5((F.col(key) if isinstance(key, str) else key).cast("string"))


def _position(key: str) -> Column:
    return F.struct(hash_of(key).alias("hash"), F.col(key).alias("key"))


def hash_cut(
    df: DataFrame, key: str, wanted: Callable[[Column], Column], by: Sequence[str] = ()
) -> DataFrame:
    """For each group the position of its last row among the `wanted(n)` first by hash.

    Rows are counted by the first four hex digits of the hash (65,536 buckets); only the
    bucket in which the count is reached is ordered.
    """
    by = list(by)
    keyed = df.select(*by, _position(key).alias("cut")).withColumn(
        "bucket", F.substring("cut.hash", 1, 4)
    )
    sizes = keyed.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("n").over(group.orderBy("bucket"))
    edges = (
        sizes.select(*by, "bucket", "n", upto.alias("upto"), F.sum("n").over(group).alias("total"))
        .withColumn("wanted", wanted(F.col("total")).cast("long"))
        .where("upto - n < wanted and wanted <= upto")
        .select(*by, "bucket", F.expr("wanted - (upto - n)").alias("nth"))
    )
    small = groups_are_few(df, by)
    inside = keyed.join(hint(edges, small), [*by, "bucket"])
    rank = F.row_number().over(group.orderBy("cut"))
    return inside.withColumn("rank", rank).where("rank = nth").select(*by, "cut")


def mark_first(
    df: DataFrame,
    key: str,
    wanted: Callable[[Column], Column],
    by: Sequence[str] = (),
    name: str = "is_first",
) -> DataFrame:
    """All rows, with a flag for the `wanted(n)` first of each group by hash of a unique key.

    The rows themselves are not shuffled: each is compared with the cut of its group.
    """
    cut = hash_cut(df, key, wanted, by)
    if by:
        marked = df.join(hint(cut, groups_are_few(df, list(by))), list(by), "left")
        return marked.withColumn(
            name, F.coalesce(_position(key) <= F.col("cut"), F.lit(False))
        ).drop("cut")
    return df.withColumn(name, F.coalesce(_position(key) <= cut.scalar(), F.lit(False)))


def sample_n(df: DataFrame, key: str, n: int = 5000) -> DataFrame:
    """min(n, rows) rows in hash order of a unique key: random, but the same every time."""
    marked = mark_first(df, key, lambda rows: F.least(rows, F.lit(n)))
    return marked.where("is_first").drop("is_first")


def head_fraction(df: DataFrame, key: str, scale: float) -> DataFrame:
    """Exactly int(rows * scale) rows, chosen by hash of a unique key."""
    marked = mark_first(df, key, lambda rows: F.floor(rows * F.lit(float(scale))))
    return marked.where("is_first").drop("is_first")


def stratified_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, the test share taken from each label on its own.

    The marked rows are stored, so the cut is found once for both.
    """
    marked = mark_first(df, key, lambda rows: F.round(rows * F.lit(test_size)), [label], "is_test")
    marked = stored(marked, "split")
    return marked.where("not is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def number(col: str) -> Column:
    """A column as doubles; NaN counts as missing."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def unpivot(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, value) rows with the given columns as doubles, NaN as null."""
    picked = df.select(*by, *[number(c).alias(c) for c in cols])
    return picked.unpivot(list(by), list(cols), "metric", "value")


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., metric, prob, value): quantiles with linear interpolation, nulls left out.

    A sketch gives a bracket around each quantile. A second pass counts the values below
    the bracket and, per distinct value, those within it; so one task sees at most a few
    thousandths of the distinct values of a group, and copies of a value are one row.
    """
    keys = [*by, "metric"]
    long = unpivot(df, cols, by).where("value is not null")
    low_probs = [max(0.0, p - SKETCH_MARGIN) for p in probs]
    high_probs = [min(1.0, p + SKETCH_MARGIN) for p in probs]
    sketch = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", low_probs + high_probs, SKETCH_ACCURACY).alias("edge"),
    )
    slots = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.col("edge")[i].alias("low"),
            F.col("edge")[len(probs) + i].alias("high"),
        )
        for i, p in enumerate(probs)
    ]
    large = F.col("n") > SMALL_GROUP
    brackets = sketch.select(*keys, "n", F.inline(F.array(*slots))).select(
        *keys,
        "n",
        "prob",
        F.when(large, F.col("low")).alias("low"),
        F.when(large, F.col("high")).alias("high"),
    )
    small = groups_are_few(df, list(by))
    counts = (
        long.join(hint(brackets, small), keys)
        .where("high is null or value <= high")
        .withColumn("v", F.expr("if(low is null or value >= low, value, null)"))
        .groupBy(*keys, "prob", "n", "v")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    quantile = Window.partitionBy(*keys, "prob")
    ranked = counts.withColumn("upto", F.sum("copies").over(quantile.orderBy("v")))
    place = F.col("prob") * (F.col("n") - 1)
    k = F.floor(place)

    def value_at(rank: Column) -> Column:
        here = (F.col("upto") - F.col("copies") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(here, F.col("v")))

    found = ranked.groupBy(*keys, "prob", "n").agg(
        value_at(k).alias("a"), value_at(F.least(k + 1, F.col("n") - 1)).alias("b")
    )
    outside = F.col("a").isNull() | F.col("b").isNull()
    value = F.when(outside, F.raise_error(F.lit("quantile lies outside its bracket"))).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * (place - k)
    )
    return found.select(*keys, "prob", value.alias("value"))


def running_totals(
    df: DataFrame,
    order: str,
    cols: Sequence[str],
    by: Sequence[str] = (),
    pieces: int = 256,
) -> DataFrame:
    """Running sums over descending `order`, as upto_<col>, with group sums as total_<col>.

    `df` must hold one row per group and order value. The order values are cut into equal
    pieces by a sketch; a piece starts from the summed pieces above it, and only rows of
    one piece are ordered together.
    """
    by = list(by)
    steps = [i / pieces for i in range(1, pieces)]
    edges = df.groupBy(*by).agg(
        F.percentile_approx(order, steps, SKETCH_ACCURACY).alias("edges"),
        *[F.sum(c).alias(f"total_{c}") for c in cols],
    )
    if by:
        placed = df.join(hint(edges, groups_are_few(df, by)), by)
    else:
        one = edges.select(F.struct("edges", *[f"total_{c}" for c in cols])).scalar()
        placed = df.withColumn("_one", one).select("*", "_one.*").drop("_one")
    below = F.filter("edges", lambda e: e < F.col(order))
    # coalesce() so that no test for null is derived and pushed below the aggregation.
    placed = placed.withColumn("piece", F.coalesce(F.size(below), F.lit(0))).drop("edges")
    group = Window.partitionBy(*(by or [F.lit(0)]))
    above = group.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*by, "piece")
        .agg(*[F.sum(c).alias(f"sum_{c}") for c in cols])
        .select(*by, "piece", *[F.sum(f"sum_{c}").over(above).alias(f"start_{c}") for c in cols])
    )
    inside = Window.partitionBy(*by, "piece").orderBy(F.desc(order))
    small = groups_are_few(df, by, 1000)
    return (
        placed.join(hint(starts, small), [*by, "piece"])
        .withColumns(
            {
                f"upto_{c}": F.coalesce(F.col(f"start_{c}"), F.lit(0)) + F.sum(c).over(inside)
                for c in cols
            }
        )
        .drop("piece", *[f"start_{c}" for c in cols])
    )
