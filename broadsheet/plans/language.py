"""Sentiment with modifiers, lemmas by rule and hyphenated syllables.

The lexicon, the dictionary and the patterns are made from the words of other tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators import sentiment as st
from broadsheet.operators import syllables as sy
from broadsheet.plans.base import query, rounded, sql_advanced, sql_clean, sql_list, sql_words, table
from broadsheet.session import stored

# ---- sentiment with negation and intensity ------------------------------------------------

# Negations that occur in the test data, as few of the default ones do.
DATA_NEGATIONS = [*st.NEGATIONS, "de", "to", "das", "les", "it"]
_TOKENS = r"regexp_extract_all(regexp_replace(lower(text), 'n''t\b', ' n''t', 'g'), '[\p{L}'']+|!')"
_LEXICON = f"""lexicon AS (SELECT DISTINCT word, (length(word) % 5 - 2) / 2.0 AS polarity,
  (length(word) % 4) / 4.0 AS subjectivity, 0.5 + (length(word) % 3) / 2.0 AS intensity, length(word) % 2 = 0 AS modifier
  FROM (SELECT unnest({_TOKENS}) AS word FROM benchmark) WHERE word <> '!' AND length(word) % 7 <> 1)"""


def _lexicon(spark, folder):
    found = table(spark, folder, "benchmark").select(F.explode(st.sentiment_words(F.col("text"))).alias("word")).distinct()
    size = F.length("word")
    return found.where((F.col("word") != "!") & (size % 7 != 1)).select(
        "word",
        ((size % 5 - 2) / 2.0).alias("polarity"),
        ((size % 4) / 4.0).alias("subjectivity"),
        (0.5 + (size % 3) / 2.0).alias("intensity"),
        (size % 2 == 0).alias("modifier"),
    )


def _clip(x: str) -> str:
    return f"greatest(-1.0, least(1.0, {x}))"


# Input and state are one struct, since the elements of a list have one type.
_STATE = """{{'word': {word}, 'known': {known}, 'polarity': {polarity}, 'subjectivity': {subjectivity},
  'intensity': {intensity}, 'modifies': {modifies}, 'sum_p': {sum_p}, 'sum_s': {sum_s}, 'scores': {scores}, 'p': {p}, 's': {s},
  'force': {force}, 'negated': {negated}, 'modifier': {modifier}, 'negation': {negation}}}"""
_NO_INPUT = {
    "word": "''", "known": "FALSE", "polarity": "0::DOUBLE", "subjectivity": "0::DOUBLE", "intensity": "1::DOUBLE",
    "modifies": "FALSE",
}
_NO_STATE = {
    "sum_p": "0::DOUBLE", "sum_s": "0::DOUBLE", "scores": "0", "p": "0::DOUBLE", "s": "0::DOUBLE",
    "force": "1::DOUBLE", "negated": "FALSE", "modifier": "FALSE", "negation": "FALSE",
}
_NEGATES = f"list_contains({sql_list(DATA_NEGATIONS)}, x.word)"
_CLOSED = "(CASE WHEN a.negated THEN a.p * -0.5 ELSE a.p END)"
_SCORED = {
    "sum_p": f"a.sum_p + CASE WHEN a.modifier THEN 0 ELSE {_CLOSED} END",
    "sum_s": "a.sum_s + CASE WHEN a.modifier THEN 0 ELSE a.s END",
    "scores": "a.scores + CASE WHEN a.modifier THEN 0 ELSE 1 END",
    "p": _clip("x.polarity * CASE WHEN a.modifier THEN a.force ELSE 1 END"),
    "s": _clip("x.subjectivity * CASE WHEN a.modifier THEN a.force ELSE 1 END"),
    "force": "CASE WHEN a.negation THEN 1 / x.intensity ELSE x.intensity END",
    "negated": "(a.modifier AND a.negated) OR a.negation",
    "modifier": "x.modifies",
    "negation": _NEGATES,
}
_PENDING = f"({_NEGATES} OR (a.negation AND length(trim(x.word, '''')) <= 1))"
_OTHER = {
    "sum_p": "a.sum_p", "sum_s": "a.sum_s", "scores": "a.scores",
    "p": f"CASE WHEN x.word = '!' THEN {_clip('a.p * 1.25')} ELSE a.p END",
    "s": "a.s", "force": "a.force",
    "negated": f"a.negated OR ({_PENDING} AND a.modifier)",
    "modifier": f"a.modifier AND ({_PENDING} OR length(x.word) <= 2)",
    "negation": f"{_PENDING} AND NOT a.modifier",
}
_GIVEN = {
    "word": "word", "known": "polarity IS NOT NULL", "polarity": "coalesce(polarity, 0)::DOUBLE",
    "subjectivity": "coalesce(subjectivity, 0)::DOUBLE", "intensity": "coalesce(intensity, 1)::DOUBLE",
    "modifies": "coalesce(modifier, FALSE)",
}
_FOLD = f"""list_reduce(list_prepend({_STATE.format(**_NO_INPUT, **_NO_STATE)}, words),
  lambda a, x: CASE WHEN x.known THEN {_STATE.format(**_NO_INPUT, **_SCORED)} ELSE {_STATE.format(**_NO_INPUT, **_OTHER)} END)"""


@query(f"""WITH {_LEXICON},
t AS (SELECT doc_id, {_TOKENS} AS found FROM documents),
w AS (SELECT doc_id, unnest(found) AS word, unnest(range(len(found))) AS place FROM t),
g AS (SELECT doc_id, list({_STATE.format(**_GIVEN, **_NO_STATE)} ORDER BY place) AS words
  FROM w LEFT JOIN lexicon USING (word) GROUP BY 1),
r AS (SELECT doc_id, {_FOLD} AS a FROM g)
SELECT doc_id, round(coalesce((a.sum_p + {_CLOSED}) / nullif(a.scores, 0), 0), 6) AS sentiment,
  round(coalesce((a.sum_s + a.s) / nullif(a.scores, 0), 0), 6) AS subjectivity FROM documents LEFT JOIN r USING (doc_id)""")
def modified_sentiment(spark, folder):
    docs = table(spark, folder, "documents")
    out = st.modified_sentiment(docs, "doc_id", "text", _lexicon(spark, folder), DATA_NEGATIONS)
    return out.select("doc_id", *rounded("sentiment", "subjectivity"))


# ---- lemmas by rule -----------------------------------------------------------------------

_CLEAN = sql_words(sql_clean("text"), 3)
_CASES = ", ".join(
    f"CASE WHEN word LIKE '%{end}' THEN left(word, length(word) - {len(end)}) || '{new}' END" for end, new in st.NOUN_ENDINGS
)


def _clean_words(spark, folder, name):
    words = tx.words(tx.clean(F.col("text")), min_length=3)
    return table(spark, folder, name).select(F.explode(words).alias("word")).distinct()


@query(f"""
WITH b AS (SELECT DISTINCT unnest({_CLEAN}) AS word FROM benchmark),
dictionary AS (SELECT word FROM b UNION SELECT left(word, length(word) - 1) FROM b WHERE word LIKE '%s'
  UNION SELECT left(word, length(word) - 2) FROM b WHERE word LIKE '%en'),
exceptions AS (SELECT word, [left(word, length(word) - 2)] AS lemmas FROM b WHERE word LIKE '%en'),
t AS (SELECT doc_id, {sql_advanced("text")} AS words FROM documents),
w AS (SELECT DISTINCT unnest(words) AS word FROM t),
c AS (SELECT word, CASE WHEN lemmas IS NULL THEN [word, {_CASES}] ELSE list_concat([word], lemmas) END AS forms
  FROM w LEFT JOIN exceptions USING (word)),
f AS (SELECT word, unnest(forms) AS lemma, unnest(range(len(forms))) AS place FROM c),
l AS (SELECT word, arg_min(lemma, length(lemma) * 100 + place) AS lemma FROM f
  WHERE lemma IN (SELECT word FROM dictionary) GROUP BY 1),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM t),
j AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY place) AS text_processed
  FROM p LEFT JOIN l USING (word) GROUP BY 1)
SELECT doc_id, coalesce(text_processed, '') AS text_processed FROM t LEFT JOIN j USING (doc_id)
""")
def lemmatized_by_rule(spark, folder):
    """Advanced cleaning with lemmas from rules, a dictionary and exceptions."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known = stored(_clean_words(spark, folder, "benchmark"), "dictionary")
    cut = {n: F.expr(f"substring(word, 1, length(word) - {n})") for n in (1, 2)}
    odd = known.where(F.col("word").endswith("en")).withColumn("lemma", cut[2])
    dictionary = known.union(known.where(F.col("word").endswith("s")).select(cut[1])).union(odd.select("lemma"))
    words = docs.select(F.explode(tx.advanced_words(F.col("text"))).alias("word"))
    lemmas = stored(st.rule_lemmas(words, dictionary, odd), "lemmas")
    return st.advanced_text(docs, "doc_id", "text", lemmas).drop("text")


# ---- syllables ----------------------------------------------------------------------------

_SPOKEN = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]+', '', 'g'), '\s+'), lambda w: w <> '')"


def _patterns(spark, folder):
    """A rated gap after the second letter of each word of `benchmark`, and one at its start."""
    words = table(spark, folder, "benchmark").select(F.explode(sy.spoken_words(F.col("text"))).alias("word")).distinct()
    words = words.where((F.length("word") > 3) & ~F.col("word").rlike("[0-9]"))
    inner = F.concat(F.substring("word", 2, 1), F.length("word") % 4, F.substring("word", 3, 2))
    first = F.concat(F.lit("."), F.substring("word", 1, 2), F.length("word") % 3)
    return words.select(F.explode(F.array(inner, first)).alias("pattern")).distinct()


@query(rf"""
WITH b AS (SELECT DISTINCT word FROM (SELECT unnest({_SPOKEN}) AS word FROM benchmark)
  WHERE length(word) > 3 AND NOT regexp_matches(word, '[0-9]')),
p AS (SELECT substring(word, 2, 3) AS letters, 1 AS gap, length(word) % 4 AS rating FROM b
  UNION SELECT '.' || left(word, 2), 3, length(word) % 3 FROM b),
t AS (SELECT doc_id, text, {_SPOKEN} AS words FROM documents),
w AS (SELECT DISTINCT unnest(words) AS word FROM t),
s AS (SELECT word, '.' || word || '.' AS marked, unnest(range(length(word))) AS start FROM w),
g AS (SELECT word, start + gap AS place, max(rating) AS rating FROM s JOIN p ON substring(marked, start + 1, 3) = letters
  GROUP BY ALL),
h AS (SELECT word, count(*) AS hyphens FROM g WHERE rating % 2 = 1 AND place BETWEEN 3 AND length(word) - 1 GROUP BY 1),
x AS (SELECT doc_id, sum(1 + coalesce(hyphens, 0)) AS syllables
  FROM (SELECT doc_id, unnest(words) AS word FROM t) LEFT JOIN h USING (word) GROUP BY 1),
c AS (SELECT doc_id, coalesce(syllables, 0)::BIGINT AS syllable_count,
  len(regexp_extract_all(text, '[^\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+')) AS n, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS sentences
  FROM t LEFT JOIN x USING (doc_id))
SELECT doc_id, CASE WHEN n > 0 THEN syllable_count ELSE 0 END AS syllable_count,
  round(CASE WHEN n > 0 THEN 206.835 - 1.015 * (n / sentences) - 84.6 * (syllable_count / n) ELSE 0 END, 6) AS readability_score,
  round(CASE WHEN n > 0 THEN 0.39 * (n / sentences) + 11.8 * (syllable_count / n) - 15.59 ELSE 0 END, 6) AS flesch_kincaid_grade
FROM c
""")
def hyphenated_readability(spark, folder):
    """Readability from hyphenated syllables; each task hyphenates a word once."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = sy.with_hyphenation(docs, "text", _patterns(spark, folder))
    out = st.with_complexity(counted, "text", syllables="syllables")
    scores = rounded("readability_score", "flesch_kincaid_grade")
    return out.select("doc_id", F.col("syllable_count").cast("long").alias("syllable_count"), *scores)
