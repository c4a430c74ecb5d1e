"""The pipeline: each stage's decisions against brute force, and edge cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from llm import edge
from llm.test_dedup import plain_groups
from llm.test_pii import base_spans
from tokenizers import Tokenizer

import corpus_pipeline as cp
from broadsheet.llm.vocabulary import default_path
from broadsheet.session import stored


@pytest.fixture(scope="module")
def steps(spark, small):
    """What went into each stage and what came out of the last."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], small), "stage"))
    return [{"columns": df.columns, "rows": df.collect()} for df in out]


def test_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "PII", "packing"]
    assert cp.ORACLE_SQL is None
    for step in steps[1:5]:
        assert step["columns"] == steps[0]["columns"]


def test_quality_keeps_clean_documents(spark, small, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1]["rows"]}
    good = [d for d, q in labels.items() if q]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert len(kept) < len(steps[0]["rows"])


def test_exact_copies_go(steps):
    groups: dict[bytes, list[int]] = {}
    for r in steps[1]["rows"]:
        groups.setdefault(hashlib.sha256((r.text or "").encode().lower()).digest(), []).append(r.doc_id)
    assert sorted(r.doc_id for r in steps[2]["rows"]) == sorted(map(max, groups.values()))


def test_near_copies_go(steps):
    """Of each group of fingerprints within two bits, by brute force, the smallest key stays."""
    _, groups = plain_groups([(r.doc_id, r.text) for r in steps[2]["rows"]], cp.SHINGLE_WORDS)
    assert sorted(r.doc_id for r in steps[3]["rows"]) == sorted(set(groups.values()))


def test_near_copies_of_long_texts_go(spark, small):
    """Long texts of which one word is changed."""
    rnd = random.Random(6)
    texts = [" ".join(str(rnd.randint(0, 10**6)) for _ in range(3000)) for _ in range(4)]
    rows = [(10 * i + j, text + " x" * j) for i, text in enumerate(texts) for j in range(3)]
    _, groups = plain_groups(rows, cp.SHINGLE_WORDS)
    assert len(set(groups.values())) < len(rows)
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"), "long")
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, small).collect()) == sorted(set(groups.values()))


def test_personal_data_is_masked(steps):
    before = {r.doc_id: r for r in steps[3]["rows"]}
    assert sorted(before) == sorted(r.doc_id for r in steps[4]["rows"])
    for r in steps[4]["rows"]:
        assert not base_spans(r.text)
        assert r.n_chars == len(r.text)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
        if not base_spans(before[r.doc_id].text) and "[" not in r.text:
            assert r.text == before[r.doc_id].text


def test_everything_kept_is_packed(steps):
    tokenizer = Tokenizer.from_file(default_path(cp.TOKENIZER))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[4]["rows"])
    assert sum(r.length for r in steps[5]["rows"]) == want
    assert {r.doc_id for r in steps[5]["rows"]} == {r.doc_id for r in steps[4]["rows"]}


def test_stages_bear_odd_rows_and_columns(spark, small):
    docs = stored(edge.documents(spark).withColumnRenamed("row", "_row"), "odd")
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, small), "odd")
        if name == "exact dedup":
            texts = [(r.text or "").encode().lower() for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if name != "packing":
            assert "_row" in docs.columns and docs.count() > 0
    assert docs.count() > 0


def test_odd_rows_one_stage_at_a_time(spark, small):
    """Stages also take what the first would have rejected."""
    docs = stored(edge.documents(spark), "odd")
    n = len(edge.texts())
    assert cp.drop_copies(spark, docs, small).count() == len({(t or "").encode().lower() for _, t in edge.texts()})
    near = cp.drop_near_copies(spark, docs, small)
    assert 0 < near.count() < n
    assert sum(not (r.text or "").strip() for r in near.collect()) == 1
    assert cp.mask_personal_data(spark, docs, small).count() == n


def test_empty_table(spark, small):
    docs = edge.empty(spark)
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, small), "empty")
        assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry_points

    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_points.queries()
