"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import (
    ann,
    bpe,
    centroids,
    decontaminate,
    exact_dedup,
    html_text,
    lexical,
    packing,
    pii,
    quality,
    simhash,
    token_counts,
    token_files,
)
from broadsheet.llm.vocabulary import default_path
from broadsheet.session import shared_dir

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
MAX_TOKENS = 512
MIN_QUALITY = 0.5


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark, folder):
    path = shared_dir(spark, "tokens")
    token_files.write_token_files(_table(spark, folder, "documents"), path, default_path(BYTE_BPE), end_id=0)
    docs = token_files.read_documents(spark, path)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_token_counts(spark, folder):
    counts = token_counts.token_counts(_table(spark, folder, "documents"), default_path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_simhash(spark, folder):
    rows = simhash.near_duplicates(_table(spark, folder, "documents"), width=3)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_packing(spark, folder):
    pieces = packing.pack(_table(spark, folder, "documents"), default_path(WORD_BPE), end_id=2, length=4096)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_exact_dedup(spark, folder):
    rows = exact_dedup.deduplicate(_table(spark, folder, "documents"), shared_dir(spark, "digest-index"))
    return rows.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op6_quality(spark, folder):
    docs = _table(spark, folder, "documents")
    model = quality.fit(docs, _table(spark, folder, "labels"))
    rows = quality.score(docs, model).select("doc_id", *quality.SCORES)
    return rows.withColumn("accepted", F.col("quality_score") >= MIN_QUALITY)


def op7_ann(spark, folder):
    return ann.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, recall=0.95)


def op8_bpe(spark, folder):
    rows = bpe.round_trip(_table(spark, folder, "documents"), default_path(WORD_BPE))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_html(spark, folder):
    pages = _table(spark, folder, "pages")
    rows = html_text.extract(pages, html_text.fit(pages))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op10_pii(spark, folder):
    return pii.summary(pii.find(_table(spark, folder, "documents")))


def op11_centroids(spark, folder):
    return centroids.cluster(_table(spark, folder, "embeddings"), k=8, rounds=10, seed=3, components=64, scale=1024)


_CENTROIDS_AT = """c{r} AS MATERIALIZED (
  WITH x AS (SELECT cluster, unnest(p) AS v, unnest(range(64)) AS i FROM a{r}),
  m AS (SELECT cluster, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x GROUP BY ALL),
  f AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m GROUP BY 1)
  SELECT cluster, coalesce(f.c, o.c) AS c FROM c{q} o LEFT JOIN f USING (cluster))"""
_NEAREST_AT = """a{r} AS MATERIALIZED (
  WITH d AS (SELECT row, vec_id, p, cluster, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT
    AS distance FROM v, c{q})
  SELECT row, vec_id, p, cluster, distance FROM d
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""
OP11_SQL = (
    """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
  list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
h AS (SELECT p, sha256('3:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, p AS c FROM h ORDER BY h LIMIT 8),
"""
    + ",\n".join(f"{_NEAREST_AT.format(r=r, q=r - 1)},\n{_CENTROIDS_AT.format(r=r, q=r - 1)}" for r in range(1, 11))
    + ",\n"
    + _NEAREST_AT.format(r="", q=10)
    + """
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c10 USING (cluster)"""
)

# Lower case for A-Z only, then runs of ASCII letters and digits and of all beyond ASCII.
_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


def op12_lexical_search(spark, folder):
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


OP12_SQL = f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM df, whole),
norm AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM size, whole),
q AS (SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_decontamination(spark, folder):
    found = decontaminate.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), window=10)
    hit = decontaminate.words_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP13_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS gram
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM s)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
x AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m),
h AS (SELECT doc_id, k, g.m, item_id FROM (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS gram FROM x) y
  JOIN g ON g.m = y.m AND g.gram = y.gram),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def pipeline(spark, folder):
    import corpus_pipeline  # it imports the operators itself

    return corpus_pipeline.run(spark, folder)


def queries():
    ops = (
        op1_token_files,
        op2_token_counts,
        op3_simhash,
        op4_packing,
        op5_exact_dedup,
        op6_quality,
        op7_ann,
        op8_bpe,
        op9_html,
        op10_pii,
        op11_centroids,
        op12_lexical_search,
        op13_decontamination,
    )
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": OP5_SQL,
        "op11_centroids": OP11_SQL,
        "op12_lexical_search": OP12_SQL,
        "op13_decontamination": OP13_SQL,
    }
