"""Column functions on literal rows, and against plain Python rules on random strings."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.words import KEYWORDS, STOPWORDS
from broadsheet.operators.features import clean_label, drop_blank, with_features

ROWS = [
    (0, None, None),
    (1, "", ""),
    (2, "   ", " \t\n "),
    (3, "BREAKING news!", "Urgent!! Is this LEAKED? See http://a.b/c and https://x.org"),
    (4, "viral viral", "shocking exclusive exposed viral"),
    (5, "Éa Ü x", "naïve café – “quoted” 😀 ½ ²"),
    (6, "the  cat", "don't stop the the cat cat cannot gonna wanna"),
    (7, "www.Site.COM", "write to me@x.com or @me or a@ or a@b@c www.z.net HTTP://Q"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, title string, text string").cache()


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_null_rules(rows):
    out = with_features(rows).orderBy("id").first()
    nulls = {c for c in out.asDict() if out[c] is None}
    assert out["text_specialchar_count"] == 0 and out["contains_url"] == 0
    assert out["fake_keywords_count"] == 0 and out["text_clean"] == "" and out["title_clean"] == ""
    assert {"title_length", "text_word_count", "title_caps_ratio", "text_digit_count"} <= nulls


def test_types(rows):
    types = dict(with_features(rows).dtypes)
    ints = [c for c in types if c.endswith(("_length", "_count")) or c == "contains_url"]
    assert len(ints) == 12 and all(types[c] == "int" for c in ints)
    assert all(types[c] == "double" for c in types if c.endswith("_ratio"))


def test_counts(rows):
    assert values(rows, tx.word_count(F.col("title"))) == [None, 1, 4, 2, 2, 2, 3, 1]
    assert values(rows, tx.word_count(F.col("title"), ws=True)) == [None, 0, 0, 2, 2, 3, 2, 1]
    assert values(rows, tx.keyword_score(F.col("text"), F.col("title")))[3:5] == [3, 5]
    assert values(rows, tx.contains_url(F.col("text"))) == [0, 0, 0, 1, 0, 0, 0, 0]
    assert values(rows, tx.contains_url(F.col("text"), loose=True)) == [0, 0, 0, 1, 0, 0, 0, 1]
    assert values(rows, tx.question_count(F.col("text")))[3] == 1


def test_stopwords_keep_repeats_and_fuse(rows):
    done = values(rows, tx.remove_stopwords(tx.clean(F.col("text"))))
    assert done[6] == "dont stop cat cat gon na wan na"
    assert done[0] == "" and done[2] == ""


def test_emails_and_urls(rows):
    assert values(rows, tx.strip_emails(F.col("text")))[7] == "write to  or @me or a@ or  www.z.net HTTP://Q"
    assert values(rows, tx.strip_urls(F.lower("text")))[7] == "write to me@x.com or @me or a@ or a@b@c  "


def test_ngrams_of_short_lists(spark):
    df = spark.createDataFrame([(0, []), (1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c", "a", "b"])], "id int, w array<string>")
    for n in (1, 2, 3):
        got = values(df, tx.ngrams(F.col("w"), n))
        want = [[" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for _, w in sorted(df.collect())]
        assert got == want


def test_mojibake(spark):
    pairs = [
        ("caf\u00c3\u00a9 na\u00c3\u00afve", "caf\u00e9 na\u00efve"),
        ("plain", "plain"),
        ("caf\u00e9", "caf\u00e9"),
        ("\u65e5\u672c", "\u65e5\u672c"),
        ("a\u00a0b\u200bc", "a b c"),
        ("\u00e2\x80\x99s", "\u2019s"),
        ("\u00c3", "\u00c3"),
        # A line separator at the end lies outside Latin-1 as well.
        ("abc\u2028", "abc\u2028"),
        ("\u00c3\u00a9\u2029", "\u00c3\u00a9\u2029"),
        ("\u00c3\u00a9\n", "\u00e9\n"),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "id int, t string")
    assert values(df, tx.repair_mojibake(F.col("t"))) == [w for _, w in pairs]


def test_bands(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.1, 0.31, 0.5, 0.51, 0.9])], "id int, p double")
    assert values(df, tx.uncertainty_band(F.col("p"))) == ["FAKE", "UNCERTAIN", "UNCERTAIN", "REAL", "REAL"]
    scores = spark.createDataFrame([(i, s) for i, s in enumerate([0.1, 0.11, -0.1, -0.2])], "id int, s double")
    assert values(scores, tx.sentiment_bucket(F.col("s"))) == ["Neutral", "Positive", "Neutral", "Negative"]


def test_dirty_labels_and_blank_text(spark):
    df = spark.createDataFrame([("0",), ("1",), ("2",), ("x",), (None,), (" 1.0 ",)], "label string")
    assert sorted(r.label for r in clean_label(df).collect()) == [0, 1, 1]
    blank = spark.createDataFrame([("a",), ("",), (None,), ("  \t",)], "t string")
    assert drop_blank(blank, "t").count() == 1


ALPHABET = list("abcdeXYZ 019!?.@\t\n'-_") + ["é", "Ü", "ß", " ", " ", "½", "漢", "😀", "́", "\x1c", "http", "www", " the ", " and "]


@pytest.fixture(scope="module")
def strings(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").cache()
    return texts, df


def in_class(c, classes):
    """Whether a character's Unicode category starts with one of the letters."""
    return unicodedata.category(c)[0] in classes


def cut_address(token, marks):
    """A token up to the first mark that something follows."""
    places = [token.find(m) for m in marks if -1 < token.find(m) < len(token) - len(m)]
    return token[: min(places)] if places else token


def test_against_character_loops(strings):
    texts, df = strings
    t = F.col("t")

    def only_words(s):
        tokens = [cut_address(w, ["http://", "https://", "www."]) for w in s.lower().split()]
        spaced = ["".join(c if c == "_" or in_class(c, "LN") else " " for c in w) for w in tokens]
        return " ".join(" ".join(spaced).split())

    def long_words(s):
        kept = []
        for token in s.lower().split():
            token = cut_address(token, ["http", "www"])
            if "@" in token[1:-1]:
                continue
            word = "".join(c for c in token if "a" <= c <= "z")
            if len(word) > 2 and word not in STOPWORDS:
                kept.append(word)
        return " ".join(kept)

    cases = [
        (tx.special_char_count(t), lambda s: len([c for c in s if not in_class(c, "LNZ") and c not in "\t\n\x1c"])),
        (tx.word_count(t), lambda s: 1 + s.count(" ")),
        (tx.word_count(t, ws=True), lambda s: len(s.split())),
        (tx.caps_ratio(t), lambda s: len([c for c in s if "A" <= c <= "Z"]) / (1 + len(s))),
        (tx.caps_ratio(t, uni=True), lambda s: len([c for c in s if unicodedata.category(c) == "Lu"]) / (1 + len(s))),
        (tx.squeeze(t), lambda s: " ".join(s.split())),
        (tx.normalize(t), only_words),
        (F.array_join(tx.advanced_words(t), " "), long_words),
        (tx.clip(t, 10), lambda s: s[:10] + "..."),
        (tx.preview(t, 10), lambda s: s[:10] + "..." if len(s) > 10 else s),
    ]
    for column, rule in cases:
        assert values(df, column) == [rule(s) for s in texts]


def test_keywords_count_in_title_and_text(spark):
    a, b = KEYWORDS[0], KEYWORDS[1]
    rows = [(0, "nothing", "at all", 0), (1, a, "x", 1), (2, f"{a.upper()} {a}", f"so {b}", 2), (3, a, a, 2), (4, None, b, 1)]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, title string, text string")
    assert values(df, tx.keyword_score(F.col("text"), F.col("title"))) == [r[3] for r in rows]


def test_special_chars_of_every_plane(spark):
    """Each assigned character of three planes, by its category in Python's Unicode tables.

    Characters that only the newer of the two tables knows are left out: Python has those of
    blocks Java may not know, so letters and digits are compared up to Unicode 13.
    """
    chars = [chr(i) for i in range(1, 0x2FFFF) if not 0xD800 <= i <= 0xDFFF]
    known = [c for c in chars if unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Co")]
    moved = "\u180e\u200b"  # spaces of the old table
    known = [c for c in known if c not in moved and c not in "\x85"]
    df = spark.createDataFrame(list(enumerate(known)), "id int, t string")
    got = values(df, tx.special_char_count(F.col("t")))
    white = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
    assert got == [int(not in_class(c, "LNZ") and c not in white) for c in known]


def test_patterns_are_not_searched_in_texts_without_their_marks(spark):
    texts = ["a b", "http", "http://x.y z", "httpwww. q", "www", "www. a", "www.a b", "@", "a@ b", " @b", "x a@b c", "é\u00a0a@b\x1fc", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {
        "urls": (tx.strip_urls, rf"(?:http|www)[^{tx.SPACE}]+"),
        "emails": (tx.strip_emails, rf"(?<![^{tx.SPACE}])[^{tx.SPACE}]+@[^{tx.SPACE}]+"),
    }
    for strip, pattern in plain.values():
        found = rows.select(strip(F.col("t")).alias("got"), F.regexp_replace("t", pattern, "").alias("want")).collect()
        assert [r.got for r in found] == [r.want for r in found]
        assert "contains(" in str(strip(F.col("t")))
    bare = F.regexp_replace(F.coalesce("t", F.lit("")), rf"https?://[^{tx.SPACE}]+|www\.[^{tx.SPACE}]+", "")
    want = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}_]+", " "))
    found = rows.select(tx.normalize(F.col("t")).alias("got"), want.alias("want")).collect()
    assert [r.got for r in found] == [r.want for r in found]


def test_blank_training_texts_are_left_out(spark):
    from broadsheet.operators.features import training_text

    rows = [(1, "", " \u00a0\u200b\t"), (2, None, "\u00e9"), (3, "a", None), (4, "", "\u00c2\u00a0"), (5, "\u00c3\u00a9", "b\u00c2\u00a0c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id int, title string, text string, label int")
    assert {r.id: r.title_text for r in training_text(df).collect()} == {2: " \u00e9", 3: "a ", 5: "\u00e9 b c"}
