"""Heavy hitters are those that exact counts give, however counts are spread."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import counts

TABLES = {
    "skewed": [[f"w{i}"] * (3000 // (i + 1)) for i in range(200)],
    "even": [[f"w{i:03}" for i in range(300)] for _ in range(3)],
    "few": [["a", "b", "a"], []],
    "empty": [],
}


@pytest.mark.parametrize("buckets", [1, 16, 1 << 20])
@pytest.mark.parametrize("name", list(TABLES))
def test_equal_to_exact_counts(spark, name, buckets):
    df = spark.createDataFrame([(w,) for w in TABLES[name]], "words array<string>").repartition(4)
    want = counts.most_common(counts.count_items(df, F.col("words")), 7)
    found = counts.heavy_hitters(df, F.col("words"), 7, buckets=buckets)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()]
