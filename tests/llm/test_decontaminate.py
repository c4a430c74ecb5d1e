"""Benchmark decontamination against plain comparison of windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from compare import connect, differences
from llm import edge

from broadsheet.llm import decontaminate, queries


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, window):
    windows: dict[tuple, set] = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                held = windows.get(tuple(own[i : i + size]))
                if held:
                    hit |= set(range(i, i + size))
                    found |= held
        out.append((key, len(own), len(hit), ",".join(sorted(str(f) for f in found if f is not None))))
    return sorted(out, key=str)


def found_rows(df):
    rows = df.select("doc_id", "n_words", decontaminate.words_hit().alias("n_hit"), "items").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in rows), key=str)


ITEMS = [
    (1, "alpha Beta don't"), (2, None), (3, ""), (4, "very long very long very long very long very long very long"),
    (11, "two words"), (11, "same row"), (None, "other text"), (5, "ONE"), (6, "long marks"), (7, "n, the of the of"),
]


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_equals_sql(spark, small):
    assert differences(spark, connect(small), "op13", queries.op13_decontamination, queries.OP13_SQL, small) is None


@pytest.mark.parametrize("window", [1, 3, 10])
def test_edges(spark, window):
    found = decontaminate.find(edge.documents(spark), item_table(spark, ITEMS), window=window)
    assert found_rows(found) == plain(edge.texts(), ITEMS, window)


def test_several_automata(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 12)
    found = decontaminate.find(edge.documents(spark), item_table(spark, ITEMS), window=4, row="row")
    assert found_rows(found) == plain(edge.texts(), ITEMS, 4)


def test_empty_tables(spark):
    items = item_table(spark, ITEMS)
    assert decontaminate.find(edge.empty(spark), items).collect() == []
    rows = decontaminate.find(edge.documents(spark), items.limit(0)).collect()
    assert len(rows) == len(edge.texts()) and not any(r.spans or r["items"] for r in rows)


def test_automaton_on_random_words():
    """Few different words, so that sequences overlap in every way."""
    rnd = random.Random(3)
    for _ in range(300):
        kinds = rnd.randint(1, 4)
        items = [(i, " ".join(rnd.choice("abcd"[:kinds]) for _ in range(rnd.randint(0, 12)))) for i in range(rnd.randint(1, 6))]
        docs = [(i, " ".join(rnd.choice("abcde"[: kinds + 1]) for _ in range(rnd.randint(0, 60)))) for i in range(5)]
        window = rnd.randint(1, 6)
        automaton = decontaminate.Automaton([(str(i), [w.encode() for w in words(t)]) for i, t in items], window)
        got = []
        for key, text in docs:
            spans, names = automaton.scan([w.encode() for w in words(text)])
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
            got.append((key, len(words(text)), sum(b - a for a, b in spans), ",".join(sorted(names))))
        assert sorted(got, key=str) == plain(docs, items, window)
        assert len(automaton.lengths) <= 2 * sum(len(words(t)) for _, t in items) + 1


def test_clean_removes_long_spans_and_whole_texts(spark):
    docs = spark.createDataFrame(
        [(1, "before, One two-three four! after it", 5, "x"), (2, "one two three four", 6, "x"), (3, None, 7, "x"),
         (4, "one two stays, as a short span does", 8, "x"), (5, "", 9, "x")],
        "doc_id long, text string, row long, _cut string",
    )
    items = item_table(spark, [(1, "one two three four"), (2, "one two")])
    found = decontaminate.find(docs, items, window=10, row="row")
    cleaned = decontaminate.clean(docs, found, "row", max_words=2, max_share=0.8)
    assert cleaned.columns == docs.columns
    rows = {r.doc_id: r.text for r in cleaned.collect()}
    assert rows == {1: "before, ! after it", 2: "", 3: None, 4: "one two stays, as a short span does", 5: ""}


def test_digest_of_no_items(spark, small):
    row = queries.op13_decontamination(spark, small).where("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and not row.contaminated
