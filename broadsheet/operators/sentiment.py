"""Lemmas, sentiment and readability of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators.lookup import in_row, lookup, may_hold
from broadsheet.session import stored


def lemmatize(df: DataFrame, key: str, words: str, lemmas: DataFrame) -> DataFrame:
    """The word array with every word replaced by its lemma, order kept.

    `lemmas` has rows (word, lemma). A word with several lemmas has the smallest one, a word
    with none keeps its form. Lemmas that are few are looked up within the row. With many, only
    words that may have one travel, with the key and their place, and what is found is put into the
    array, which travels once by the key; `key` must identify a row.
    """
    one = lemmas.where("lemma is not null").groupBy("word").agg(F.min("lemma").alias("lemma"))
    found = in_row(one, "word")
    if found:
        return df.withColumn(words, F.transform(words, lambda w: F.coalesce(found(w)["lemma"], w)))
    known = stored(one, "lemmas")
    test = may_hold(known, "word")
    placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    spread = df.select(F.col(key).alias("_key"), F.inline(F.filter(placed, lambda x: test(x["word"]))))
    joined = lookup(spread, known, "word", how="inner")
    again = joined.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_found"))
    put = F.when(F.col("_found").isNull(), F.col(words)).otherwise(_put_in(F.col(words), F.col("_found")))
    order = [put.alias(c) if c == words else F.col(c) for c in df.columns]
    return df.join(again, F.col(key).eqNullSafe(F.col("_key")), "left").select(*order)


def _put_in(words: Column, found: Column) -> Column:
    """The words with those at the places of `found` (pos, lemma), in order, replaced."""

    def from_here(x: Column, i: Column) -> Column:
        following = F.coalesce(F.get(found, i + 1)["pos"], F.size(words))
        return F.concat(F.array(x["lemma"]), F.slice(words, x["pos"] + 2, following - x["pos"] - 1))

    return F.concat(F.slice(words, F.lit(1), F.get(found, F.lit(0))["pos"]), F.flatten(F.transform(found, from_here)))


# Endings of English plural nouns and what stands in their place, in the order of
# the published rules of detachment.
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
    ("men", "man"), ("ies", "y"),
]


def lemma_candidates(word: Column, endings: list[tuple[str, str]] = NOUN_ENDINGS) -> Column:
    """The word itself and what is left of it by each ending that fits."""
    cut = [
        F.when(word.endswith(end), F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(new)))
        for end, new in endings
    ]
    return F.array_compact(F.array(word, *cut))


def rule_lemmas(
    words: DataFrame,
    dictionary: DataFrame,
    exceptions: DataFrame | None = None,
    endings: list[tuple[str, str]] = NOUN_ENDINGS,
    given: DataFrame | None = None,
) -> DataFrame:
    """(word, lemma) of the words whose lemma is another word.

    A word's candidates are itself, then its lemmas in `exceptions` (word, lemma), or, if it has
    none there, what the endings leave. Those in `dictionary` (word) count, the shortest
    wins, and of equally short ones the first; exceptions come in the order of strings. Words of `given` (word, lemma) keep that
    lemma. Each different word is judged once; words without a lemma are left out.
    """
    different = words.select("word").where("word is not null").distinct()
    if given is not None:
        different = different.join(given.select("word"), "word", "left_anti")
    ruled = lemma_candidates(F.col("word"), endings)
    if exceptions is not None:
        listed = exceptions.where("lemma is not null").groupBy("word").agg(F.sort_array(F.collect_set("lemma")).alias("_listed"))
        different = different.join(listed, "word", "left")
        ruled = F.when(F.col("_listed").isNotNull(), F.concat(F.array("word"), F.col("_listed"))).otherwise(ruled)
    candidates = different.select("word", F.posexplode(ruled).alias("place", "lemma"))
    known = dictionary.select(F.col("word").alias("lemma")).distinct()
    best = F.min_by("lemma", F.struct(F.length("lemma"), F.col("place"))).alias("lemma")
    found = candidates.join(known, "lemma").groupBy("word").agg(best).where("lemma <> word")
    return found if given is None else found.unionByName(given.select("word", "lemma"))


def advanced_text(df: DataFrame, key: str, col: str, lemmas: DataFrame) -> DataFrame:
    """Advanced preprocessing of a text column, as <col>_processed; null gives ''."""
    name = f"{col}_processed"
    listed = df.withColumn(name, tx.advanced_words(F.col(col)))
    joined = F.coalesce(F.array_join(name, " "), F.lit(""))
    return lemmatize(listed, key, name, lemmas).withColumn(name, joined)


def sentiment(
    df: DataFrame, key: list[str], text: str, lexicon: DataFrame, prefix: str = ""
) -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words in each text, 0 without any.

    `lexicon` has one row (word, polarity, subjectivity) per word. The key columns must
    identify a row; only they travel with the words, never the text.
    """
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}']+"), F.lit(0))
    tokens = df.select(*key, F.explode_outer(found).alias("word"))
    scored = lookup(tokens, lexicon.select("word", "polarity", "subjectivity"), "word")
    return scored.groupBy(*key).agg(
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias(f"{prefix}sentiment"),
        F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias(f"{prefix}subjectivity"),
    )


# Words that turn the sentiment of a following word around.
NEGATIONS = ["no", "not", "n't", "never"]


def sentiment_words(text: Column) -> Column:
    """Words in lower case, exclamation marks, and "n't" as a word of its own."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"n't\b", " n't"), F.lit(r"[\p{L}']+|!"), F.lit(0))


def sentiment_fold(words: Column, negations: list[str] = NEGATIONS) -> Column:
    """(polarity, subjectivity): means over the scored words of an array of (word, entry).

    The array is passed over once. A word with an entry takes its polarity and subjectivity, times the
    intensity of a modifier right before it, the two becoming one score. A negation before a
    score makes it -0.5 times itself, and the intensity of a modifier between them the
    reciprocal: "not very good" is less bad than "not good". Words of one letter may stand
    between a negation and its word, words of two between a modifier and its word. An
    exclamation mark makes the score before it a quarter larger. Scores stay within -1 and 1.
    """

    def clip(c: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))

    def closed(s: Column) -> Column:
        return F.when(s["negated"], s["p"] * -0.5).otherwise(s["p"])

    start = F.struct(
        F.lit(0.0).alias("sum_p"), F.lit(0.0).alias("sum_s"), F.lit(0).alias("scores"),
        # The score that may still change, and the intensity it gives to a next word.
        F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), F.lit(1.0).alias("force"), F.lit(False).alias("negated"),
        F.lit(False).alias("modifier"), F.lit(False).alias("negation"),
    )

    def step(state: Column, x: Column) -> Column:
        word, entry = x["word"], x["entry"]
        negates = word.isin(negations)
        joins = state["modifier"]
        polarity, subjectivity = F.coalesce(entry["polarity"], F.lit(0.0)), F.coalesce(entry["subjectivity"], F.lit(0.0))
        intensity = F.when(entry["intensity"] != 0, entry["intensity"]).otherwise(1.0)
        scored = F.struct(
            (state["sum_p"] + F.when(joins, 0.0).otherwise(closed(state))).alias("sum_p"),
            (state["sum_s"] + F.when(joins, 0.0).otherwise(state["s"])).alias("sum_s"),
            (state["scores"] + F.when(joins, 0).otherwise(1)).alias("scores"),
            clip(F.when(joins, polarity * state["force"]).otherwise(polarity)).alias("p"),
            clip(F.when(joins, subjectivity * state["force"]).otherwise(subjectivity)).alias("s"),
            F.when(state["negation"], 1.0 / intensity).otherwise(intensity).alias("force"),
            ((joins & state["negated"]) | state["negation"]).alias("negated"),
            F.coalesce(entry["modifier"], F.lit(False)).alias("modifier"),
            negates.alias("negation"),
        )
        short = F.length(F.regexp_replace(word, "^'+|'+$", "")) <= 1
        negation = negates | (state["negation"] & short)
        # "really not good": the negation goes to the score that the modifier has begun.
        merged = negation & state["modifier"]
        other = F.struct(
            state["sum_p"].alias("sum_p"),
            state["sum_s"].alias("sum_s"),
            state["scores"].alias("scores"),
            F.when(word == "!", clip(state["p"] * 1.25)).otherwise(state["p"]).alias("p"),
            state["s"].alias("s"),
            state["force"].alias("force"),
            (state["negated"] | merged).alias("negated"),
            (state["modifier"] & (merged | (F.length(word) <= 2))).alias("modifier"),
            (negation & ~merged).alias("negation"),
        )
        return F.when(entry.isNotNull(), scored).otherwise(other)

    def finish(s: Column) -> Column:
        n = F.when(s["scores"] > 0, s["scores"])
        return F.struct(
            F.coalesce((s["sum_p"] + closed(s)) / n, F.lit(0.0)).alias("polarity"),
            F.coalesce((s["sum_s"] + s["s"]) / n, F.lit(0.0)).alias("subjectivity"),
        )

    return F.aggregate(words, start, step, finish)


def modified_sentiment(
    df: DataFrame, key: str, text: str, lexicon: DataFrame, negations: list[str] = NEGATIONS
) -> DataFrame:
    """(key, sentiment, subjectivity): scores with negation and intensity, 0 without any word.

    `lexicon` has one row (word, polarity, subjectivity, intensity, modifier) per word. A small
    one is looked up within the row, so nothing is shuffled; with a large one the words travel
    with the key, which must identify a row, and are put in order again. The text stays behind.
    """
    columns = ["word", "polarity", "subjectivity", "intensity", "modifier"]
    lexicon = lexicon.select(*columns)
    words = df.select(key, sentiment_words(F.col(text)).alias("words"))
    found = in_row(lexicon, "word")
    if found:
        told = words.select(key, F.transform("words", lambda w: F.struct(w.alias("word"), found(w).alias("entry"))).alias("words"))
    else:
        entry = F.when(F.col("_known"), F.struct(*columns[1:])).alias("entry")
        spread = words.select(key, F.posexplode_outer("words").alias("place", "word"))
        joined = lookup(spread, lexicon.withColumn("_known", F.lit(True)), "word")
        told = joined.groupBy(key).agg(
            F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "word", entry)))).alias("words")
        )
    scores = told.select(key, sentiment_fold(F.col("words"), negations).alias("score"))
    return scores.select(
        key,
        F.coalesce("score.polarity", F.lit(0.0)).alias("sentiment"),
        F.coalesce("score.subjectivity", F.lit(0.0)).alias("subjectivity"),
    )


def title_and_text(df: DataFrame, key: list[str], lexicon: DataFrame) -> DataFrame:
    """(key..., title_sentiment, title_subjectivity, text_sentiment, text_subjectivity).

    Title and text are scored as two rows of one pass.
    """
    parts = [F.struct(F.lit(c).alias("part"), F.col(c).alias("words")) for c in ("title", "text")]
    rows = df.select(*key, F.inline(F.array(*parts)))
    scored = sentiment(rows, [*key, "part"], "words", lexicon)

    def of(part: str, score: str):
        return F.max(F.when(F.col("part") == part, F.col(score))).alias(f"{part}_{score}")

    return scored.groupBy(*key).agg(
        *[of(p, s) for p in ("title", "text") for s in ("sentiment", "subjectivity")]
    )


def sentiment_stats(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Mean and sample standard deviation of score columns, over all rows or per group."""
    aggs = [
        agg
        for c in cols
        for agg in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))
    ]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def with_complexity(df: DataFrame, text: str = "text", syllables: str | None = None) -> DataFrame:
    """Readability metrics; a null or empty text gives zeros.

    `syllables` names a column with their number, as `syllables.with_syllables` gives it; without
    it runs of vowels are counted.
    """
    c = F.col(text)
    # Counted in a projection of their own, else every metric would count again.
    counted = df.withColumns(
        {
            "_words": tx.word_count(c, ws=True),
            "_sentences": tx.sentence_count(c),
            "_syllables": F.col(syllables) if syllables else tx.syllable_count(c),
        }
    )
    counts = F.col("_words"), F.col("_sentences"), F.col("_syllables")
    n, sentences, syllables = counts
    has_words, has_text, zero = n > 0, F.length(c) > 0, F.lit(0.0)
    metrics = {
        "readability_score": F.when(has_words, tx.reading_ease(*counts)).otherwise(zero),
        "avg_sentence_length": F.when(has_words, n / sentences).otherwise(zero),
        "syllable_count": F.when(has_words, syllables).otherwise(0),
        "flesch_kincaid_grade": F.when(has_words, tx.grade_level(*counts)).otherwise(zero),
        "sentence_count": F.when(has_text, sentences).otherwise(0),
    }
    return counted.withColumns(metrics).drop("_words", "_sentences", "_syllables")


def with_fallback_complexity(df: DataFrame, text: str = "text") -> DataFrame:
    """Rough metrics: every closing mark ends a sentence, 1.5 syllables a word, fixed scores."""
    c = F.col(text)
    n = tx.word_count(c, ws=True)
    sentences = F.greatest(F.regexp_count(c, F.lit("[.!?]")), F.lit(1))
    return df.withColumns(
        {
            "readability_score": F.lit(50.0),
            "avg_sentence_length": n / sentences,
            "syllable_count": n * F.lit(1.5),
            "flesch_kincaid_grade": F.lit(8.0),
            "sentence_count": sentences,
        }
    )


def reading_level(df: DataFrame, score: str = "readability_score") -> DataFrame:
    """Mean reading ease and the name of its band."""
    mean = df.agg(F.avg(score).alias("mean_score"))
    return mean.withColumn("level", tx.reading_level(F.col("mean_score")))


def category_shares(df: DataFrame, by: str, category: str = "category") -> DataFrame:
    """(by, category, n, percent of the group)."""
    counts = df.groupBy(by, category).agg(F.count(F.lit(1)).alias("n"))
    # One row per group and category: the window is over a handful of rows.
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("percent", F.col("n") * 100.0 / total)
