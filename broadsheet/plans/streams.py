"""Stream queries: the tables arrive as files, and results are read back from a sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators import features, models
from broadsheet.plans.base import ARTICLES, labelled_articles, query, sql_clean, sql_join, sql_words, table
from broadsheet.session import shared_dir, stored
from broadsheet.sources import articles as files
from broadsheet.sources.quoted_csv import read_quoted_csv
from broadsheet.sources.kafka import LABELLED, VERIFY
from broadsheet.streaming import messages as ms


def _stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    # A stream's path must be a folder or a pattern; this one fits a file as well as a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _messages(docs):
    """Documents as JSON messages; those in German arrive cut short."""
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    message = F.to_json(
        F.struct(F.col("doc_id").cast("string").alias("source"), "text", title.alias("title"))
    )
    cut = F.expr("substring(message, 1, length(message) - 1)")
    broken = docs.withColumn("message", message)
    return broken.select(F.when(F.col("lang") == "de", cut).otherwise(F.col("message")).alias("value"))


def _drained(spark, df, by=None):
    """Run a stream over all there is into files, and read them."""
    base = shared_dir(spark, "stream")
    ms.run_available(ms.write_files(df, f"{base}/out", f"{base}/checkpoint", by))
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query(f"""
SELECT doc_id::VARCHAR AS source, {sql_join(sql_words(sql_clean("text")))} AS text,
  {sql_join(sql_words(sql_clean("title")))} AS title FROM {ARTICLES} WHERE lang <> 'de'
""")
def cleaned_stream(spark, folder):
    out = _drained(spark, ms.clean_messages(_messages(_stream(spark, folder, "documents"))))
    return ms.good(ms.parse(out))


@query("SELECT (lang = 'de') AS malformed, count(*) AS n FROM documents GROUP BY 1")
def malformed_messages(spark, folder):
    parsed = ms.parse(_messages(_stream(spark, folder, "documents")))
    out = _drained(spark, ms.bad(parsed).select(F.lit(True).alias("malformed")).unionByName(
        ms.good(parsed).select(F.lit(False).alias("malformed"))))
    return out.groupBy("malformed").agg(F.count(F.lit(1)).alias("n"))


_ODD = """(SELECT *, CASE lang WHEN 'de' THEN 'cut' WHEN 'fr' THEN 'empty' WHEN 'es' THEN 'null' END AS odd FROM documents)"""


@query(f"""SELECT CASE WHEN odd IS NULL THEN 'processed-data' ELSE 'malformed-data' END AS topic,
  coalesce(odd IN ('empty', 'null'), false) AS blank, count(*) AS n FROM {_ODD} GROUP BY 1, 2""")
def unreadable_messages(spark, folder):
    """Messages cut short, empty ones and ones without a value, each routed to its topic."""
    lang = F.col("lang")
    docs = _stream(spark, folder, "documents")
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("source"), "text", F.lit("t").alias("title")))
    value = F.when(lang == "fr", "").when(lang == "es", F.lit(None)).when(lang == "de", F.lit('{"source": "x')).otherwise(whole)
    out = _drained(spark, ms.clean_and_route(docs.select(value.alias("value"))), by="topic")
    return out.groupBy("topic", (F.col("value") == "").alias("blank")).agg(F.count(F.lit(1)).alias("n"))


@query()
def scored_stream(spark, folder):
    train = features.training_text(labelled_articles(spark, folder)).select("title_text", "label")
    model = models.fit_classifier(stored(train, "training"), "lr")
    routed = ms.score_and_route(_messages(_stream(spark, folder, "documents")), model, "title_text")
    return _drained(spark, routed, by="topic")


@query("""
SELECT event_id, CASE WHEN greatest(p, 1 - p) < 0.8 THEN 'verify-data' ELSE 'labelled-data' END AS topic,
  CASE WHEN p >= 0.5 THEN 'real' ELSE 'fake' END AS label FROM (SELECT event_id, (value % 1) AS p FROM events)
""")
def routed_stream(spark, folder):
    scored = _stream(spark, folder, "events").select("event_id", (F.col("value") % 1).alias("score"))
    routed = ms.with_topic(ms.with_label(scored)).select("event_id", "label", "topic")
    return _drained(spark, routed, by="topic")


@query("""
SELECT event_id, CASE WHEN greatest(p, 1 - p) < 0.8 THEN 'verify-data' ELSE 'labelled-data' END AS topic,
  CASE WHEN p >= 0.5 THEN 'real' ELSE 'fake' END AS label FROM (SELECT event_id, (value % 1) AS p FROM events)
""")
def two_sinks_stream(spark, folder):
    """Routed in batches, each topic to a sink of its own."""
    scored = _stream(spark, folder, "events").select("event_id", (F.col("value") % 1).alias("score"))
    routed = ms.with_topic(ms.with_label(scored)).select("event_id", "label", "topic")
    base = shared_dir(spark, "sinks")
    sinks = {t: f"{base}/{t}" for t in (LABELLED, VERIFY)}
    ms.run_available(ms.write_sinks(routed, sinks, f"{base}/checkpoint"))
    parts = [ms.read_sink(spark, path).withColumn("topic", F.lit(t)) for t, path in sinks.items()]
    return parts[0].unionByName(parts[1]).select("event_id", "topic", "label")


@query("SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def first_seen_stream(spark, folder):
    bare = F.regexp_replace("url", r"[?#].*$", "").alias("url")
    return _drained(spark, ms.first_seen(_stream(spark, folder, "pages").select(bare)))


@query(f"SELECT doc_id::VARCHAR AS title, text, 'de' = lang AS german FROM {ARTICLES}")
def csv_articles(spark, folder):
    """Written as CSV with newlines and quotes in the text, and read back."""
    return _german(files.read_csv(spark, _articles_as_csv(spark, folder), multi_line=True))


@query(f"SELECT doc_id::VARCHAR AS title, text, 'de' = lang AS german FROM {ARTICLES}")
def csv_in_parallel(spark, folder):
    """The same, each file read by many tasks."""
    return _german(read_quoted_csv(spark, _articles_as_csv(spark, folder), files.ARTICLE))


def _articles_as_csv(spark, folder) -> str:
    path = shared_dir(spark, "csv")
    docs = table(spark, folder, "documents")
    out = docs.select(
        F.col("doc_id").cast("string").alias("title"), "text", (F.col("lang") == "de").cast("int").alias("label")
    )
    files.write_csv(out, path)
    return path


def _german(rows):
    back = features.clean_label(rows)
    return back.select("title", "text", (F.col("label") == 1).alias("german"))
