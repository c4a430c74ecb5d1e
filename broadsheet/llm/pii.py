"""Personal data by weak supervision, in DataFrame operations alone (operator 10).

Patterns propose candidate spans: the base ones of each kind, and wider ones (numbers that
look like telephone numbers without a plus, addresses spelled with [at]). Labelers vote on
every candidate: its pattern, a checksum or the form of its parts, a gazetteer of issuers,
prefixes and domains, the words before it, and the characters that touch it. Expectation
maximisation estimates from the votes alone how reliable each labeler is, for each kind, and
how likely each pattern of votes is; base spans that pass their test count as true there, and
those that fail it as false. These probabilities train the final classifier, a
logistic regression over the votes and the form of a span. Base spans that pass always stay;
the classifier adds wider ones that do not overlap them.

Patterns are written so that every text is scanned in linear time: runs are taken whole,
without giving characters back, and a match starts only where a run does or where the last
match ended. That finds what the plain pattern finds, leftmost and without overlap.

A text is scanned where it lies; only spans are shuffled, by document. Estimation works on
the distinct patterns of votes, at most 4 kinds x 3 ** 5 rows.

Null text counts as empty. Documents without spans have zero counts and empty lists. Null
keys, and rows that repeat a key or text, are documents of their own. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.session import stored

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "[A-Za-z0-9._%+-]"
# What each kind looks like; the part after | in `email` and `phone` is tried apart.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
# A text without this cannot hold a match.
NEEDS = {"email": "@", "phone": "+"}

# Fixed lists of the labelers.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b\W*$",
    "ip": r"(?i)\b(?:ip|host|server|address|client|from|login|logged)\b\W*$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|account)\b\W*(?:number|no)?\W*$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp)\b\W*$",
}
OTHER_CUES = r"(?i)\b(?:version|release|build|isbn|issn|order|invoice|ticket|section|chapter|token|key|hash|id|sku|model)\b\W*$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4[4-9]))"
COUNTRIES = r"^(?:1[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PRIVATE = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
TLDS = r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|it|nl|[a-z]{2})$"

VOTES = ["pattern", "form", "gazetteer", "context", "edges"]
FEATURES = [*VOTES, "size", "digits", "gaps", "wide"]
ROUNDS = 8
_CONTEXT = 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    """The test of a base match."""
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = F.length(_digits(match))
    if kind == "card":
        return digits.between(14, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, doc_id, kind, wide, begin, stop, match, before, after), and for each document one
    row with a null kind. Places count code points, the end is exclusive. `row` names a column
    that tells rows apart; without it they are numbered."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(
        number.alias("row"),
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    patterns = [(k, False, p) for k, p in BASE.items()] + [(k, True, p) for k, p in WIDER.items()]
    some_digit = F.col("text").rlike("[0-9]")

    def scanned(kind: str, wide: bool, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        may = F.contains("text", F.lit(NEEDS[kind])) if not wide and kind in NEEDS else some_digit
        if wide and kind == "email":
            may = F.col("text").rlike(r"[\[(](?:at|AT)[\])]")
        return F.when(may, found)

    names = [f"m{i}" for i in range(len(patterns))]
    rows = rows.select("row", "doc_id", "text", *[scanned(*p).alias(n) for p, n in zip(patterns, names)])

    def listed(i: int, kind: str, wide: bool, pattern: str) -> Column:
        # The text between matches gives their places and what stands around them.
        gaps = F.transform(
            F.split("text", pattern, -1),
            lambda g: F.struct(
                F.length(g).alias("size"),
                F.substring(g, -_CONTEXT, _CONTEXT).alias("end"),
                F.substring(g, 1, 1).alias("start"),
            ),
        )
        # Each match with the gap before and after it, as one element of the list.
        n = F.size(names[i])
        each = F.arrays_zip(
            F.col(names[i]).alias("match"), F.slice(gaps, 1, n).alias("left"), F.slice(gaps, 2, n).alias("right")
        )
        return F.when(n > 0, F.struct(F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), each.alias("found")))

    parts = F.array(*[listed(i, *p) for i, p in enumerate(patterns)])
    some = F.filter(parts, lambda p: p.isNotNull())
    per_kind = rows.select("row", "doc_id", F.explode_outer(some).alias("part"))
    spans = per_kind.select(
        "row", "doc_id", "part.kind", "part.wide", F.posexplode_outer("part.found").alias("place", "hit")
    )
    spans = spans.select(
        "row",
        "doc_id",
        "kind",
        "wide",
        "place",
        F.col("hit")["match"].alias("match"),
        F.col("hit")["left"]["size"].alias("skip"),
        F.col("hit")["left"]["end"].alias("before"),
        F.col("hit")["right"]["start"].alias("after"),
    )
    upto = Window.partitionBy("row", "kind", "wide").orderBy("place")
    stop = F.sum(F.col("skip") + F.length("match")).over(upto)
    return spans.withColumn("stop", stop).withColumn("begin", F.col("stop") - F.length("match")).drop("skip", "place")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))


def with_votes(spans: DataFrame) -> DataFrame:
    """Candidates with `base` (kept whatever the votes), `told` (1 for base spans, -1 for those
    that fail their test, else 0) and a vote of -1, 0 or 1 per labeler."""
    kind, match = F.col("kind"), F.col("match")

    def by_kind(choice) -> Column:
        return reduce(lambda c, k: F.when(kind == k, choice(k)).otherwise(c), KINDS, F.lit(None))

    passes = by_kind(lambda k: _passes(k, match))
    digits = _digits(match)
    forms = {
        "email": _vote(match.rlike(r"\.[A-Za-z]{2,24}$"), match.rlike(r"\.\.|[-.]@|^[.-]|\.[0-9]+$")),
        "ip": _vote(F.col("base"), match.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(F.call_function("luhn_check", digits) & F.length(digits).between(14, 19), F.lit(True)),
        "phone": _vote(F.length(digits).between(10, 13), (F.length(digits) > 15) | match.rlike(r"[.-]{2}|\s{2}|([0-9])\1{6}")),
    }
    lists = {
        "email": _vote(match.rlike(TLDS), F.lit(False)),
        "ip": _vote(F.lit(False), match.rlike(PRIVATE)),
        "card": _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": _vote(F.col("base") & digits.rlike(COUNTRIES), F.col("base") & ~digits.rlike(COUNTRIES)),
    }
    touching = F.substring("before", -1, 1).rlike(r"[\p{L}\p{N}_]") | F.col("after").rlike(r"[\p{L}\p{N}_]")
    return (
        spans.withColumn("base", F.coalesce(passes & ~F.col("wide"), F.lit(False)))
        .withColumn("told", _vote(F.col("base"), ~F.col("base") & ~F.col("wide")))
        .withColumn("pattern", F.col("told"))
        .withColumn("form", by_kind(lambda k: forms[k]))
        .withColumn("gazetteer", by_kind(lambda k: lists[k]))
        .withColumn("context", _vote(by_kind(lambda k: F.col("before").rlike(CUES[k])), F.col("before").rlike(OTHER_CUES)))
        .withColumn("edges", _vote(F.lit(True), touching))
        .withColumn("size", F.least(F.length("match"), F.lit(40)) / 40)
        .withColumn("digits", F.round(F.length(digits) / F.length("match"), 1))
        .withColumn("gaps", F.least(F.regexp_count("match", F.lit("[ .()-]")), F.lit(6)) / 6)
    )


def reliabilities(voted: DataFrame, rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
    """By expectation maximisation over the votes, for each kind: the share of true candidates
    and, for each labeler, how many of its votes are 1 and -1 on true and on false ones.

    The driver keeps these few numbers; each round is an aggregate over vote patterns.
    """
    patterns = stored(
        voted.where("kind is not null").groupBy("kind", "told", *VOTES).agg(F.count(F.lit(1)).cast("double").alias("n")),
        "votes",
    )
    # It starts from the majority: labelers are right more often than not.
    start = {"share": 0.5} | {
        f"{v}_{t}_{x}": 0.75 if (t == 1) == (x == 1) else 0.25 for v in VOTES for t in (0, 1) for x in (1, -1)
    }
    model = {k: dict(start) for k in KINDS}
    for _ in range(rounds):
        p = probability(model)
        weighed = patterns.withColumn("p", p)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("true")]
        for v in VOTES:
            for x in (1, -1):
                here = F.when(F.col(v) == x, F.col("n")).otherwise(0.0)
                sums += [F.sum(here * F.col("p")).alias(f"{v}_1_{x}"), F.sum(here * (1 - F.col("p"))).alias(f"{v}_0_{x}")]
        for row in weighed.groupBy("kind").agg(*sums).collect():  # a row per kind
            found = row.asDict()
            kind, n, true = (found.pop(name) for name in ("kind", "n", "true"))
            # A few made-up votes keep every probability away from 0 and 1.
            model[kind] = {"share": (true + 1) / (n + 2)}
            for v in VOTES:
                for t in (0, 1):
                    cast = found[f"{v}_{t}_1"] + found[f"{v}_{t}_-1"]
                    for x in (1, -1):
                        name = f"{v}_{t}_{x}"
                        model[kind][name] = (found[name] + 2 * start[name]) / (cast + 2)
    return model


def probability(model: dict[str, dict[str, float]]) -> Column:
    """How likely a candidate is true: sure where it is told, else given its votes."""

    def odds(m: dict[str, float]) -> Column:
        total = F.lit(math.log(m["share"] / (1 - m["share"])))
        for v in VOTES:
            yes, no = (math.log(m[f"{v}_1_{x}"] / m[f"{v}_0_{x}"]) for x in (1, -1))
            # Who does not vote says nothing.
            total = total + F.when(F.col(v) == 1, yes).when(F.col(v) == -1, no).otherwise(0.0)
        return total

    logit = reduce(lambda c, k: F.when(F.col("kind") == k, odds(model[k])).otherwise(c), KINDS, F.lit(0.0))
    told = F.col("told")
    return F.when(told == 1, 1.0).when(told == -1, 0.0).otherwise(1 / (1 + F.exp(-logit)))


def span_classifier(voted: DataFrame, model: dict[str, dict[str, float]]) -> Column:
    """The score of a logistic regression trained on the estimated probabilities.

    Every distinct set of features is one pair of rows, true and false, weighed by how many
    candidates it has and how likely they are true.
    """
    flags = {"wide": F.col("wide").cast("double")} | {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS}
    known = voted.where("kind is not null")
    plain = [f for f in FEATURES if f != "wide"]
    cells = known.select(*[F.col(f).cast("double").alias(f) for f in plain], *[c.alias(n) for n, c in flags.items()], probability(model).alias("p"))
    names = [*plain, *flags]
    cells = cells.groupBy(*names).agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    sides = F.inline(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight"))))
    rows = stored(cells.select(*names, sides).where("weight > 0"), "cells")
    if rows.isEmpty():
        return F.lit(0.0)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(vectors)
    logit = F.lit(float(fitted.intercept))
    values = {f: F.col(f).cast("double") for f in plain} | flags
    for name, weight in zip(names, fitted.coefficients.toArray().tolist()):
        logit = logit + F.coalesce(values[name], F.lit(0.0)) * weight
    return 1 / (1 + F.exp(-logit))


def find(
    docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """(row, doc_id, spans): for each document its spans (begin, rank, kind, stop, base), sorted."""
    voted = stored(with_votes(candidates(docs, key, text, row)), "candidates")
    score = span_classifier(voted, reliabilities(voted))
    scored = voted.withColumn("score", F.when(F.col("kind").isNotNull(), score))
    # Additions must not overlap a base span: of those before, the furthest end counts.
    by_place = Window.partitionBy("row").orderBy("begin", F.desc("base"))
    until = F.max(F.when(F.col("base"), F.col("stop"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("begin"))).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(until, F.lit(0)) <= F.col("begin")) & F.coalesce(following >= F.col("stop"), F.lit(True))
    taken = F.col("base") | (free & F.col("wide") & (F.col("score") >= threshold))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("begin", rank.alias("rank"), "kind", "stop", "base")
    marked = scored.withColumn("taken", F.coalesce(taken, F.lit(False)))
    found = F.sort_array(F.collect_list(F.when(F.col("taken"), span)))
    return marked.groupBy("row", "doc_id").agg(found.alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the hash of their list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans: Column) -> Column:
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string")))
        return F.array_join(each, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, row: str, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets.

    `found` has one row (row, spans) for each document, where `row` is a column of `docs`.
    Spans that overlap are replaced as one, by the kind of the first.
    """
    some = found.where(F.size("spans") > 0).select(F.col("row").alias("_of"), "spans")
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<begin:bigint, kind:string, stop:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] > s["begin"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["begin"].alias("begin"),
                        F.element_at(done, -1)["kind"].alias("kind"),
                        F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["stop"].alias("stop"))))),
    )
    some = some.select("_of", merged.alias("_spans"))
    begins, stops = F.col("_spans.begin"), F.col("_spans.stop")

    def gap(s: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(stops, i - 1)).cast("int")
        return F.concat(F.substr(F.col(text), start + 1, s["begin"].cast("int") - start), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    last = F.substr(F.col(text), F.element_at(stops, -1).cast("int") + 1)
    clean = F.concat(F.array_join(F.transform("_spans", gap), ""), last)
    joined = docs.join(some, docs[row] == some["_of"], "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNotNull(), clean).otherwise(F.col(text))).drop("_of", "_spans")
