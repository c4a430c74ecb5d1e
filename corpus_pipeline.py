"""A corpus made ready for training: judged, deduplicated, cleared of personal data, packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again
as the next stage's docs. All but the last keep the columns of documents.

A stage's own tables are deleted when the next stage starts, since its result has then been
written, and those that only lead to a list of dropped rows as soon as that list is stored. A table that
the given docs still read stays.

Rows are followed by a number given when a stage's input is stored, so null keys, rows that
repeat a key and extra columns are kept apart. Null text counts as empty; what happens to
empty texts is said at each stage. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, packing, pii, quality, simhash
from broadsheet.llm.vocabulary import default_path
from broadsheet.session import collect_garbage, discard_path, recorded, shared_dir, stored

MIN_QUALITY = 0.5
SHINGLE_WORDS = 3  # of a fingerprint; two bits apart is near
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SEQUENCE = 4096


_SPENT: list[tuple[str, str]] = []  # application and path of what earlier stages have stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _frees_spent_tables(stage: Stage) -> Stage:
    """Before the stage, delete what earlier ones have stored and its input does not read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        folders = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
        kept = [(a, p) for a, p in _SPENT if a != application or any(p.split(":", 1)[-1] in f for f in folders)]
        for a, path in _SPENT:
            if (a, path) not in kept:
                discard_path(spark, path)
        collect_garbage(spark)
        with recorded() as paths:
            result = stage(spark, docs, sf_dir)
        _SPENT[:] = [*kept, *((application, p) for p in paths)]
        return result

    return run


def _dropped(spark: SparkSession, judged: Callable[[], DataFrame], row: str) -> DataFrame:
    """The numbers of dropped rows as a table; the tables that led to them are deleted."""
    with recorded() as paths:
        dropped = stored(judged().select(F.col("row").alias(row)), "dropped")
    for path in paths:
        if path != dropped.stored_at:
            discard_path(spark, path)
    collect_garbage(spark)
    return dropped


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, which writing them fixes, and its column's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


@_frees_spent_tables
def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers accept; texts without words are rejected."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.where(F.col("quality_score") >= MIN_QUALITY).select(*docs.columns)


@_frees_spent_tables
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id; of rows equal in both, one."""
    rows, row = _numbered(docs)
    dropped = _dropped(
        spark, lambda: exact_dedup.deduplicate(rows, shared_dir(spark, "digest-index"), row=row).where(~F.col("kept")), row
    )
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


@_frees_spent_tables
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest doc_id; all texts without
    words are one group."""
    rows, row = _numbered(docs)
    dropped = _dropped(
        spark,
        lambda: simhash.near_duplicates(rows, width=SHINGLE_WORDS, row=row).where(F.col("row") != F.col("first_row")),
        row,
    )
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


@_frees_spent_tables
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars, where there is one, follows."""
    rows, row = _numbered(docs)
    found = pii.find(rows, row=row)
    masked = pii.redact(rows, found, row)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return masked.select(*docs.columns)


@_frees_spent_tables
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of ids that hold the sources in their proportions, one row per piece."""
    pieces = packing.pack(docs, default_path(TOKENIZER), END_ID, SEQUENCE)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", judge),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", mask_personal_data),
    ("packing", pack),
]

# Classifiers, fingerprints and tokenizers are beyond SQL: tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
