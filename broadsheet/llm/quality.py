"""Quality scores by co-training of two views (operator 6).

One classifier sees what a text says: shares of kinds of characters, word lengths, repeats.
The other sees the page's metadata: language, source, size and layout in lines. Both start
from the labelled documents. In each round every classifier labels those unlabelled ones of
which it is sure, for the other one to learn from. At the end each view is calibrated on
labelled documents that were held out, and the scores of a document are combined as odds.

The labelled documents are a sample of bounded size, taken by hash of the key. The unlabelled
ones are all others: their features are made once, where the texts lie, and each round scores
all of them and fits on all that are sure. Every document is scored from its whole text, where
it lies, without a shuffle.

Null text counts as empty; a text without words scores 0 in all three columns and is
rejected. Null language or source is a value of its own, a null number of characters is
counted from the text. Rows that repeat a key, null keys and other columns are kept as they
are; columns named like the scores are replaced. Without labels of both kinds every text
with words scores 1. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import sampled, slices
from broadsheet.session import stored

LABELLED = 6_000
ROUNDS = 3
SURE = 0.98
SCORES = ["content_score", "metadata_score", "quality_score"]

_MARKS = b"!#$%&*|"
_LANGS, _SOURCES = 8, 16
N_CONTENT = 7 + len(_MARKS) + 8
N_METADATA = 7 + _LANGS + _SOURCES


def content_features(text: bytes) -> list[float]:
    """What the text says, as shares between 0 and 1 and a few logarithms."""
    size = max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum()
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    distinct = len(set(words))
    marked = sum(w[-1] in b".,;:!?#$%&*|" for w in words)
    shouted = sum(w.isupper() for w in words)
    return [
        seen[65:91].sum() / max(1, letters),
        letters / size,
        seen[48:58].sum() / size,
        (seen[9:14].sum() + seen[32]) / size,
        seen[128:].sum() / size,
        (seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()) / size,
        seen[:9].sum() / size,
        *[seen[m] / n for m in _MARKS],
        float(lengths.mean()) / 20 if words else 0.0,
        float(lengths.std()) / 20 if words else 0.0,
        float(lengths.max()) / 100 if words else 0.0,
        again / n,
        distinct / n,
        distinct / math.sqrt(n) / 20,
        marked / n,
        shouted / n,
    ]


def metadata_features(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is known beside the words: language, source, size and lines."""
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    known = n_chars if n_chars is not None else len(text.decode("utf-8", "replace"))
    out = [
        math.log1p(max(0, known)) / 10,
        math.log1p(len(lines)) / 10,
        math.log1p(float(sizes.mean())) / 10,
        math.log1p(float(sizes.max())) / 10,
        float((sizes < 20).mean()),
        1 - len(set(lines)) / len(lines),
        len(text) / max(1, known) - 1,
    ]
    for value, slots in ((lang, _LANGS), (source, _SOURCES)):
        hot = [0.0] * slots
        hot[zlib.crc32(b"\0" if value is None else value.encode()) % slots] = 1.0
        out += hot
    return out


@dataclass
class Model:
    """Weights and intercept of each view, its calibration, and the log odds of a good document."""

    content: tuple[list[float], float]
    metadata: tuple[list[float], float]
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """One column for each view and one for both; views count as independent."""
        odds = []
        for rows, (weights, start), (slope, shift) in zip((content, metadata), (self.content, self.metadata), self.scales):
            odds.append(slope * (rows @ np.array(weights) + start) + shift)
        both = np.clip([*odds, odds[0] + odds[1] - self.prior], -500, 500)
        return 1 / (1 + np.exp(-both))


def _inputs(docs: DataFrame, text: str, lang: str, source: str, n_chars: str) -> list[Column]:
    have = set(docs.columns)
    return [
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        (F.col(lang) if lang in have else F.lit(None)).cast("string").alias("_lang"),
        (F.col(source) if source in have else F.lit(None)).cast("string").alias("_source"),
        (F.col(n_chars) if n_chars in have else F.lit(None)).cast("long").alias("_n_chars"),
    ]


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    texts = batch.column("_text").cast(pa.binary()).to_pylist()
    beside = zip(*(batch.column(c).to_pylist() for c in ("_lang", "_source", "_n_chars")))
    content = np.array([content_features(t) for t in texts], np.float64)
    metadata = np.array([metadata_features(t, *b) for t, b in zip(texts, beside)], np.float64)
    return content, metadata, texts


def _fit(rows: DataFrame, features: str, label: str, ridge: float = 1e-3) -> tuple[list[float], float] | None:
    """A logistic regression, or None if only one label occurs."""
    known = rows.where(F.col(label).isNotNull())
    if known.select(label).distinct().count() < 2:
        return None
    vectors = known.select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features"))
    fitted = LogisticRegression(regParam=ridge, maxIter=60).fit(vectors)
    return fitted.coefficients.toArray().tolist(), float(fitted.intercept)


def _logit(features: str, model: tuple[list[float], float]) -> Column:
    weights = F.array(*[F.lit(w) for w in model[0]])
    pairs = F.zip_with(features, weights, lambda x, w: x * w)
    return F.aggregate(pairs, F.lit(model[1]), lambda total, x: total + x)


def _sure(logit: Column, sure: float) -> Column:
    edge = math.log(sure / (1 - sure))
    return F.when(logit > edge, F.lit(1)).when(logit < -edge, F.lit(0))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    n_chars: str = "n_chars",
    labelled: int = LABELLED,
    rounds: int = ROUNDS,
    sure: float = SURE,
) -> Model | None:
    """Co-train the two classifiers; None if the labels are not of both kinds.

    Rows of `labels` whose label is null or that repeat a key with another label do not count.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    marks = marks.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    marks = marks.where("low = high").select("_key", F.col("low").cast("int").alias("_label"))
    inputs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *_inputs(docs, text, lang, source, n_chars))
    some = stored(sampled(marks, "_key", labelled), "labelled")
    drawn = some.select("_key", F.lit(True).alias("drawn"))
    told = marks.join(F.broadcast(drawn), "_key", "left").select(
        F.col("_key").alias("key"), F.col("_label").alias("label"), F.coalesce("drawn", F.lit(False)).alias("drawn")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            content, metadata, _ = _features(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(list(content)), pa.array(list(metadata))],
                names=["key", "content", "metadata"],
            )

    kind = inputs.schema["_key"].dataType.simpleString()
    made = inputs.mapInArrow(run, f"key {kind}, content array<double>, metadata array<double>")
    # Features are shuffled, not texts. A label that was not drawn does not count as unlabelled.
    made = made.join(told, "key", "left").where("drawn is null or drawn").drop("drawn")
    held = F.col("label").isNotNull() & (F.pmod(F.xxhash64("key", F.lit("held")), F.lit(4)) == 0)
    rows = stored(made.withColumn("held", held), "views")
    learnt = F.when(~F.col("held"), F.col("label"))
    free = F.col("label").isNull()
    lessons = {"content": learnt, "metadata": learnt}
    models = None
    for turn in range(rounds + 1):
        pair = [_fit(rows.withColumn("lesson", lessons[v]), v, "lesson") for v in ("content", "metadata")]
        if None in pair:
            return None
        models = pair
        if turn < rounds:
            # Earlier lessons stay, so they need not be stored: the models give them again.
            lessons = {
                "metadata": F.coalesce(lessons["metadata"], F.when(free, _sure(_logit("content", models[0]), sure))),
                "content": F.coalesce(lessons["content"], F.when(free, _sure(_logit("metadata", models[1]), sure))),
            }
    proof = rows.where("held")
    odds = [F.array(_logit(v, m)) for v, m in zip(("content", "metadata"), models)]
    proof = stored(proof.select("label", odds[0].alias("content"), odds[1].alias("metadata")), "proof")
    scales = [_fit(proof, v, "label") for v in ("content", "metadata")]
    if None in scales:
        return None
    share = proof.agg(F.avg("label")).first()[0]
    return Model(
        models[0],
        models[1],
        tuple((slope[0], shift) for slope, shift in scales),
        math.log(share / (1 - share)),
    )


def score(
    docs: DataFrame,
    model: Model | None,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    n_chars: str = "n_chars",
) -> DataFrame:
    """All rows and columns of `docs` with content_score, metadata_score and quality_score."""
    kept = [c for c in docs.columns if c not in SCORES]
    rows = docs.select(*kept, *_inputs(docs, text, lang, source, n_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            content, metadata, texts = _features(batch)
            made = model.scores(content, metadata) if model else np.ones((3, len(texts)))
            made = np.where([bool(t.split()) for t in texts], made, 0.0)
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(row) for row in made]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *SCORES])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return rows.mapInArrow(run, f"{schema}, " + ", ".join(f"{s} double" for s in SCORES))
