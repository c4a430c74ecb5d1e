"""Sentiment with modifiers, lemmas by rule and syllables by patterns."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import lookup
from broadsheet.operators import sentiment as st
from broadsheet.operators import syllables as sy

LEXICON = [
    ("good", 0.7, 0.6, 1.0, False), ("bad", -0.7, 0.66, 1.0, False), ("very", 0.2, 0.3, 1.3, True),
    ("really", 0.2, 0.2, 1.0, True), ("slightly", -0.1, 0.2, 0.5, True), ("zero", 0.5, 0.5, 0.0, True),
]
# Scores worked out by hand.
SCORES = {
    "good": (0.7, 0.6),
    "not good": (-0.35, 0.6),
    "very bad": (-0.91, 0.858),
    "not very good": (0.7 / 1.3 * -0.5, 0.6 / 1.3),
    "very very good": (0.91, 0.78),
    "slightly bad": (-0.35, 0.33),
    "not a good": (-0.35, 0.6),
    "not the good": (0.7, 0.6),
    "isn't good": (-0.35, 0.6),
    "really not good": (-0.35, 0.6),
    "very is good": (0.91, 0.78),
    "very much good": ((0.2 + 0.7) / 2, (0.3 + 0.6) / 2),
    "good! bad": ((0.875 - 0.7) / 2, (0.6 + 0.66) / 2),
    "good good good! good! good!!": ((0.7 + 0.7 + 0.875 + 0.875 + 1.0) / 5, 0.6),
    "zero good": (0.7, 0.6),
    "nothing here": (0.0, 0.0),
    "": (0.0, 0.0),
    None: (0.0, 0.0),
}


@pytest.mark.parametrize("most", [20_000, 3])
def test_negation_and_intensity(spark, monkeypatch, most):
    """Looked up within the row, and joined."""
    monkeypatch.setattr(st, "in_row", lambda table, on: lookup.in_row(table, on, most))
    lexicon = spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double, intensity double, modifier boolean")
    df = spark.createDataFrame(list(enumerate(SCORES)), "id int, text string").repartition(3)
    found = {r.id: (r.sentiment, r.subjectivity) for r in st.modified_sentiment(df, "id", "text", lexicon).collect()}
    for i, (text, want) in enumerate(SCORES.items()):
        assert found[i] == pytest.approx(want), text


def test_small_lexicon_shuffles_nothing(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double, intensity double, modifier boolean")
    df = spark.createDataFrame([(1, "good")], "id int, text string")
    plan = st.modified_sentiment(df, "id", "text", lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "from_json" not in plan and "Python" not in plan


def test_in_row_finds_every_word(spark):
    words = [f"w{i}" for i in range(3000)] + ["", "é", "中", 'quo"te']
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "k string, v int")
    find = lookup.in_row(table, "k")
    asked = spark.createDataFrame([(w,) for w in [*words, "none", None]], "w string")
    got = {r.w: r.v for r in asked.select("w", find(F.col("w"))["v"].alias("v")).collect()}
    assert got == {w: i for i, w in enumerate(words)} | {"none": None, None: None}
    assert lookup.in_row(table, "k", 100) is None
    none = lookup.in_row(table.limit(0), "k")
    assert asked.where(none(F.col("w")).isNotNull()).count() == 0


def test_rules_and_exceptions(spark):
    nouns = ["dog", "bus", "wolf", "box", "quiz", "church", "dish", "man", "city", "us", "glass", "glasses", "goose", "die", "dice"]
    words = ["dogs", "buses", "wolves", "boxes", "churches", "dishes", "men", "cities", "us", "glasses", "geese", "dice", "cats", "dog", None]
    odd = [("geese", "goose"), ("geese", "geesa"), ("dice", "die"), ("dogs", None)]
    found = st.rule_lemmas(
        spark.createDataFrame([(w,) for w in words + words], "word string"),
        spark.createDataFrame([(w,) for w in nouns], "word string"),
        spark.createDataFrame(odd, "word string, lemma string"),
    )
    assert {r.word: r.lemma for r in found.collect()} == {
        "dogs": "dog", "buses": "bus", "wolves": "wolf", "boxes": "box", "churches": "church", "dishes": "dish",
        "men": "man", "cities": "city", "geese": "goose", "dice": "die", "glasses": "glass",
    }


def test_given_lemmas_come_first(spark):
    words = spark.createDataFrame([("dogs",), ("cats",)], "word string")
    nouns = spark.createDataFrame([("dog",), ("cat",)], "word string")
    given = spark.createDataFrame([("dogs", "hound")], "word string, lemma string")
    assert {r.word: r.lemma for r in st.rule_lemmas(words, nouns, given=given).collect()} == {"dogs": "hound", "cats": "cat"}


@pytest.mark.parametrize("most", [20_000, 1])
def test_lemmas_in_row_and_joined(spark, monkeypatch, most):
    monkeypatch.setattr(st, "in_row", lambda table, on: lookup.in_row(table, on, most))
    rows = [(1, ["dogs", None, "x", "dogs"], "t"), (2, [], "t"), (3, None, "t"), (4, ["cats"], "t")]
    df = spark.createDataFrame(rows, "id int, w array<string>, text string")
    lemmas = spark.createDataFrame([("dogs", "dog"), ("cats", "cat")], "word string, lemma string")
    out = st.lemmatize(df, "id", "w", lemmas)
    assert out.columns == df.columns
    assert {r.id: r.w for r in out.collect()} == {1: ["dog", None, "x", "dog"], 2: [], 3: None, 4: ["cat"]}


def test_only_words_with_lemmas_travel(spark, monkeypatch):
    monkeypatch.setattr(st, "in_row", lambda table, on: None)
    rows = [(1, ["dogs", "a", "cats", "cats"]), (None, ["a", "dogs", None]), (3, ["a", "b"]), (4, [None])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    lemmas = spark.createDataFrame([("dogs", "dog"), ("cats", "cat"), ("a", None)], "word string, lemma string")
    out = st.lemmatize(df, "id", "w", lemmas)
    wanted = {1: ["dog", "a", "cat", "cat"], None: ["a", "dog", None], 3: ["a", "b"], 4: [None]}
    assert {r.id: r.w for r in out.collect()} == wanted
    table = spark.createDataFrame([(f"w{i}",) for i in range(500)] + [(None,)], "k string")
    test = lookup.may_hold(table, "k")
    told = spark.range(2000).select(F.concat(F.lit("w"), "id").alias("k")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    passed = {r.k for r in told.where(test(F.col("k"))).collect()}
    assert {f"w{i}" for i in range(500)} <= passed and len(passed) < 510 and None not in passed


def test_text_stays_behind_when_lemmas_are_many(spark, monkeypatch):
    monkeypatch.setattr(st, "in_row", lambda table, on: None)
    df = spark.createDataFrame([(1, "Dogs and cats")], "id int, text string")
    lemmas = spark.createDataFrame([("dogs", "dog")], "word string, lemma string")
    out = st.advanced_text(df, "id", "text", lemmas).drop("text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Join" in line or "Exchange" in line:
            assert "text#" not in line
    assert out.first().text_processed == "dog cats"


PATTERNS = [".a1", "1b", "b2c", "a1b3c2d", "d1e.", "3é", "4e", "ab4", "0x1y"]


def plain_hyphens(patterns, word, left=2, right=2):
    marked, best = f".{word}.", {}
    for pattern in patterns:
        letters = re.sub("[0-9]", "", pattern)
        rated, at = {}, 0
        for c in pattern:
            if c.isdigit():
                rated[at] = int(c)
            else:
                at += 1
        for start in range(len(marked) - len(letters) + 1):
            if marked[start : start + len(letters)] == letters:
                for gap, rating in rated.items():
                    best[start + gap] = max(best.get(start + gap, 0), rating)
    # The gap before the letter i of the word is gap i + 1 of the marked one.
    return sum(best.get(i + 1, 0) % 2 for i in range(left, len(word) - right + 1))


def test_trie_equals_plain_patterns():
    rnd = random.Random(4)
    for _ in range(400):
        patterns = rnd.sample(PATTERNS, rnd.randint(0, len(PATTERNS)))
        word = "".join(rnd.choice("abcdeéxy") for _ in range(rnd.randint(0, 9)))
        assert sy.Trie(patterns).hyphens(word) == plain_hyphens(patterns, word)


def test_published_example():
    """The worked example of the method's thesis."""
    patterns = ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"]
    trie = sy.Trie(patterns)
    assert trie.hyphens("hyphenation") == 2  # hy-phen-ation
    assert trie.hyphens("hyphen") == 1 and trie.hyphens("hy") == trie.hyphens("") == 0


@pytest.mark.parametrize("most", [20_000, 1])
def test_syllables_of_texts(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(sy, "in_row", lambda table, on: lookup.in_row(table, on, most))
    path = tmp_path / "patterns.txt"
    path.write_text("UTF-8\n% note\nhy3ph\nhe2n\nhena4\nhen5at\n1na\nn2at\n1tio\n2io\no2n\n", encoding="utf-8")
    patterns = sy.read_patterns(spark, str(path))
    assert patterns.count() == 9
    rows = [(1, "Hyphenation, hyphen!"), (2, ""), (3, None), (4, "... --"), (5, "hyphenation hyphenation x")]
    df = spark.createDataFrame(rows, "id int, text string")
    counts = sy.hyphenated(df.select(F.explode(sy.spoken_words(F.col("text"))).alias("word")), patterns)
    assert counts.count() == 3
    trie = sy.Trie([r.pattern for r in patterns.collect()])
    one, two = 1 + trie.hyphens("hyphenation"), 1 + trie.hyphens("hyphen")
    out = sy.with_syllables(df, "id", "text", counts)
    assert {r.id: r.syllables for r in out.collect()} == {1: one + two, 2: 0, 3: 0, 4: 0, 5: 2 * one + 1}
    ease = st.with_complexity(out, syllables="syllables").where("id = 1").first()
    assert ease.syllable_count == one + two and ease.readability_score == pytest.approx(206.835 - 1.015 * 2 - 84.6 * (one + two) / 2)


def test_hyphenation_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sy, "KEPT_WORDS", 1)
    texts = ["Tables and tables, table!", None, "", "...", "cable ünïcode tables 12", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    patterns = spark.createDataFrame([("1b2l",), (".ta2b",), ("n1d",), (None,), ("1c",)], "pattern string")
    out = sy.with_hyphenation(df, "text", patterns)
    words = df.select(F.explode(sy.spoken_words(F.col("text"))).alias("word"))
    joined = sy.with_syllables(df, "id", "text", sy.hyphenated(words, patterns))
    got = {r.id: r.syllables for r in out.collect()}
    assert got == {r.id: r.syllables for r in joined.collect()} and got[1] == got[2] == got[3] == 0 and got[4] > 4
    plan = sy.with_hyphenation(spark.range(3).selectExpr("'ab' AS text"), "text", patterns)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
