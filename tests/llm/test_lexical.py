"""Ranked search against plain scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, differences
from llm import edge

from broadsheet.llm import lexical, queries


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, k):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    counted = [(key, c) for key, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        wanted, scored = Counter(terms(text)), []
        for key, c in counted:
            m = 100 - 75 + 75 * c.total() * n_docs // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, q in wanted.items()
                if c[t]
            )
            if score > 0:
                scored.append((-score, 1 << 62 if key is None else key))
        out += [(item, i + 1, None if key == 1 << 62 else key, -s) for i, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_sql(spark, small):
    assert differences(spark, connect(small), "op12", queries.op12_lexical_search, queries.OP12_SQL, small) is None


@pytest.mark.parametrize("postings", [1, 60, 10**6])
def test_edges_and_shards(spark, postings):
    docs = edge.documents(spark)
    items = [(1, "alpha beta the of ALPHA"), (2, "émile ÀÉ 中文 🙂"), (3, None), (4, "..."), (5, "nowhere"), (6, "same row"),
             (6, "very long"), (None, "no key"), (7, "don't a_b 12 12 12")]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, item int, rank int, score int")
    found = lexical.search(docs, table, k=10, shard_postings=postings)
    assert ranked(found) == plain(edge.texts(), items, 10)


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 40)
    items = [(i, t) for i, t in enumerate(["alpha", "beta the", "of of", "12 n", "Ω", "two words", "one", "very", "tail1 émile"])]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(lexical.search(edge.documents(spark), table, k=3)) == plain(edge.texts(), items, 3)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.search(edge.empty(spark), items).collect() == []
    assert lexical.search(edge.documents(spark), items.limit(0)).collect() == []


def test_bounds_close_on_skewed_lists():
    """Long lists of small impacts beside short ones of large impacts, many equal scores."""
    rnd = random.Random(5)
    for _ in range(30):
        n, words = rnd.randint(1, 400), rnd.randint(1, 12)
        entries = [(d, t, rnd.choice([0, 1, 1, 2, 3, 50 * (t % 3)])) for d in range(n) for t in range(words) if rnd.random() < 0.9 / (t + 1)]
        places, held, impacts = (np.array([e[i] for e in entries], np.int64) for i in range(3))
        keys = np.array(rnd.sample(range(1000), n))
        wanted = [(t, rnd.randint(1, 3)) for t in rnd.sample(range(words), rnd.randint(1, words))]
        rows, scores = lexical.Shard(keys, places, held, impacts).best(wanted, 10)
        total = Counter()
        for d, t, impact in entries:
            total[d] += dict(wanted).get(t, 0) * impact
        want = sorted(((-s, keys[d]) for d, s in total.items() if s > 0))[:10]
        assert [(-s, keys[r]) for r, s in zip(rows, scores)] == want


def test_reading_stops_early():
    """One document far ahead in every list: the rest of long lists is not read."""
    n = 50_000
    places = np.concatenate([np.arange(n), np.arange(n)])
    terms_ = np.repeat([0, 1], n)
    impacts = np.concatenate([np.arange(1, n + 1), np.arange(1, n + 1)])
    shard = lexical.Shard(np.arange(n), places, terms_, impacts)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                reads.append(at.stop - at.start)
            return np.ndarray.__getitem__(self, at)

    shard.impacts = shard.impacts.view(Counted)
    rows, _ = shard.best([(0, 1), (1, 1)], 10)
    assert rows.tolist() == list(range(n - 1, n - 11, -1))
    assert sum(reads) < n / 10


def test_long_texts_and_large_corpora():
    n = np.array([10**12, 3], np.int64)
    assert lexical.length_norm(n, 10**9, 10**13).tolist() == [25 + 75 * 10**12 * 10**9 // 10**13, 25]
