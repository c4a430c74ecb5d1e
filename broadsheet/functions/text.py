"""Text features and cleaning steps, all as built-in column expressions.

Every function takes and returns a Column, so a whole feature row is one projection
without Python workers and without a shuffle.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.words import FUSED, KEYWORDS, STOPWORDS

# Unicode white space as Python's str.split() and str.isspace() see it.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"


# ---- lengths and counts -----------------------------------------------------------


def word_count(c: Column, ws: bool = False) -> Column:
    """Pieces of a single-space split, empty ones included; ws=True counts runs of non-space."""
    if ws:
        return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))
    return F.array_size(F.split(c, " "))


def ratio(part: Column, whole: Column) -> Column:
    """part / (whole + 1) as a double."""
    return part / (whole + F.lit(1))


def length_ratio(title: Column, text: Column) -> Column:
    return ratio(F.length(title), F.length(text))


def word_ratio(title: Column, text: Column) -> Column:
    return ratio(word_count(title), word_count(text))


def bang_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("!"))


def question_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\?"))


def caps_ratio(c: Column, uni: bool = False) -> Column:
    """Share of A-Z, or with uni=True of all Unicode upper-case letters."""
    return ratio(F.regexp_count(c, F.lit(r"\p{IsUppercase}" if uni else "[A-Z]")), F.length(c))


def digit_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[0-9]"))


def special_char_count(c: Column) -> Column:
    """Characters that are neither letters, numbers nor white space; null counts as 0."""
    rest = F.regexp_replace(c, rf"[\p{{L}}\p{{N}}{SPACE}]+", "")
    return F.coalesce(F.length(rest), F.lit(0))


def contains_url(c: Column, loose: bool = False) -> Column:
    """1 when a http(s) address occurs; loose=True also takes www and common endings."""
    pattern = r"(?i)http|www|\.com|\.org|\.net" if loose else r"https?://"
    return F.when(c.rlike(pattern), 1).otherwise(0)


def keyword_score(text: Column, title: Column, keywords: list[str] = KEYWORDS) -> Column:
    """One point for each keyword in the text and one for each in the title."""

    def hits(c: Column) -> list[Column]:
        lowered = F.lower(c)
        return [F.coalesce(lowered.contains(k).cast("int"), F.lit(0)) for k in keywords]

    total = F.lit(0)
    for hit in hits(text) + hits(title):
        total = total + hit
    return total


# ---- cleaning ---------------------------------------------------------------------


def clean(c: Column) -> Column:
    """Lower case with everything but a-z and ASCII white space deleted."""
    # No A-Z is left after lower(), and one small class with + is several times faster
    # than the same class spelled with both cases.
    return F.regexp_replace(F.lower(c), r"[^a-z\s]+", "")


def _fused_pattern() -> str:
    by_letter = groupby(FUSED, key=lambda pair: pair[0][0])
    heads = [
        f"{letter}(?:" + "|".join(f"{a[1:]}(?={b}\\b)" for a, b in pairs) + ")"
        for letter, pairs in by_letter
    ]
    letters = "".join(sorted({a[0] for a, _ in FUSED}))
    # The letter is looked at first: it fails sooner than the test for a word's start.
    return rf"[\t-\r]|(?=[{letters}])\b({'|'.join(heads)})"


def split_fused(c: Column) -> Column:
    """Put a space inside words such as "cannot", and plain spaces for all white space."""
    return F.regexp_replace(c, _fused_pattern(), "$1 ")


def words(c: Column, stopwords: list[str] = STOPWORDS, min_length: int = 1) -> Column:
    """Array of the words of an already cleaned text, stop words left out."""
    # isin() over literals becomes a hash-set test, unlike array_contains().
    drop = [""] + list(stopwords)
    parts = F.split(split_fused(c), " ")
    if min_length > 1:
        return F.filter(parts, lambda w: (F.length(w) >= min_length) & ~w.isin(drop))
    return F.filter(parts, lambda w: ~w.isin(drop))


def remove_stopwords(c: Column, stopwords: list[str] = STOPWORDS, min_length: int = 1) -> Column:
    """Kept words joined by one space; null gives an empty string."""
    return F.coalesce(F.array_join(words(c, stopwords, min_length), " "), F.lit(""))


def clean_basic(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Cleaned text whose words are no stop words and have more than two letters."""
    return remove_stopwords(clean(c), stopwords, min_length=3)


def _where_found(c: Column, marks: list[str], changed: Column) -> Column:
    """`changed` for texts that hold one of the marks, without which a pattern cannot match: most texts
    hold none, and a search for a plain string is far cheaper than one for a pattern."""
    found = F.contains(c, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found | F.contains(c, F.lit(mark))
    return F.when(found, changed).otherwise(c)


def strip_urls(c: Column) -> Column:
    return _where_found(c, ["http", "www"], F.regexp_replace(c, rf"(?:http|www)[^{SPACE}]+", ""))


def strip_emails(c: Column) -> Column:
    # The match always covers a whole run of non-space, so it may only begin at one.
    return _where_found(c, ["@"], F.regexp_replace(c, rf"(?<![^{SPACE}])[^{SPACE}]+@[^{SPACE}]+", ""))


def squeeze(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def has_more_than_space(c: Column) -> Column:
    """Whether anything is left of the text by `squeeze`; the search ends at the first such character."""
    return c.rlike(f"[^{SPACE}]")


def advanced_words(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Words of three letters or more after URL, e-mail and symbol removal, no stop words."""
    bare = squeeze(strip_emails(strip_urls(F.lower(c))))
    return words(clean(bare), stopwords, min_length=3)


def normalize(c: Column) -> Column:
    """Text for TF-IDF: lower case, no URLs, every non-word character a space, squeezed."""
    lowered = F.lower(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(lowered, rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", "")
    no_urls = _where_found(lowered, ["http", "www."], bare)
    return F.trim(F.regexp_replace(no_urls, r"[^\p{L}\p{N}_]+", " "))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; odd spaces become plain ones."""
    raw = F.try_validate_utf8(F.encode(c, "ISO-8859-1"))
    fixed = F.when(~c.rlike(r"[^\x00-\xFF]"), raw)
    again = F.coalesce(fixed, c)
    return _where_found(again, ["\u00a0", "\u200b"], F.translate(again, "\u00a0\u200b", "  "))


def join_text(title: Column, text: Column) -> Column:
    """Title and text with one space between; null counts as empty."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def clip(c: Column, size: int = 5000) -> Column:
    """First characters, always followed by three dots."""
    return F.concat(F.substring(c, 1, size), F.lit("..."))


def preview(c: Column, size: int = 200) -> Column:
    """First characters, followed by three dots when something was cut."""
    return F.when(F.length(c) > size, clip(c, size)).otherwise(c)


def ngrams(tokens: Column, n: int) -> Column:
    """Array of n neighbouring words joined by a space; empty when there are too few.

    Pass a plain column: the array is used n times.
    """
    grams = tokens
    for shift in range(1, n):
        later = F.slice(tokens, shift + 1, F.greatest(F.size(tokens), F.lit(0)))
        grams = F.zip_with(grams, later, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(grams, 1, F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0)))


# ---- scores and bands -------------------------------------------------------------


def sentiment_bucket(score: Column) -> Column:
    return (
        F.when(score > 0.1, "Positive").when(score < -0.1, "Negative").otherwise("Neutral")
    )


def sentence_count(c: Column) -> Column:
    """Runs of closing marks, at least one."""
    return F.greatest(F.regexp_count(c, F.lit("[.!?]+")), F.lit(1))


def syllable_count(c: Column) -> Column:
    """Runs of vowels."""
    return F.regexp_count(F.lower(c), F.lit("[aeiouy]+"))


def reading_ease(words_: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch reading ease."""
    return 206.835 - 1.015 * (words_ / sentences) - 84.6 * (syllables / words_)


def grade_level(words_: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch-Kincaid grade."""
    return 0.39 * (words_ / sentences) + 11.8 * (syllables / words_) - 15.59


# Lowest mean reading ease of each band.
READING_LEVELS = [
    (90, "Very Easy (5th grade)"),
    (80, "Easy (6th grade)"),
    (70, "Fairly Easy (7th grade)"),
    (60, "Standard (8th-9th grade)"),
    (50, "Fairly Difficult (10th-12th grade)"),
    (30, "Difficult (college level)"),
]


def reading_level(mean_ease: Column) -> Column:
    band = F
    for floor, name in READING_LEVELS:
        band = band.when(mean_ease >= floor, name)
    return band.otherwise("Very Difficult (graduate level)")


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def real_or_fake(p_real: Column) -> Column:
    return F.when(p_real >= 0.5, "real").otherwise("fake")


def uncertainty_band(p_real: Column, threshold: float = 0.40, margin: float = 0.10) -> Column:
    """UNCERTAIN within the margin around the threshold, REAL above, FAKE below."""
    return (
        F.when(p_real.between(threshold - margin, threshold + margin), "UNCERTAIN")
        .when(p_real > threshold + margin, "REAL")
        .otherwise("FAKE")
    )
