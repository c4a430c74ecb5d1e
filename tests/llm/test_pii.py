"""Personal data: base spans against plain patterns, the estimation, and masking."""

from __future__ import annotations

import hashlib
import random
import re

from llm import edge
from pyspark.sql import functions as F

from broadsheet.llm import pii, queries

# The patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [
        (m.start(), i, m.end())
        for i, kind in enumerate(pii.KINDS)
        for m in re.finditer(PLAIN[kind], text or "")
        if passes(kind, m[0])
    ]
    return sorted(found)


def listed(spans):
    return ",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in spans)


def check(rows, texts):
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert not spans or set(listed(spans).split(",")) <= set(r.spans.split(","))


FRAGMENTS = [
    "a@b.c", "a.b%x@y-z.com.org", "@", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.04", " ", "-", "5", "+", "é", "🙂",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+1  ", "743-555-3824 ", "(743) 555-3824",
    "bob [at] mail [dot] com", "x@y", "x@y.z@w.v", " call ", ".", " token ", "4111111111111111", "\n",
]


def test_base_spans_of_mixed_fragments(spark):
    rnd = random.Random(5)
    texts = {i: "".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 9))) for i in range(1500)}
    texts |= {
        9000: None, 9001: "", 9002: "a" * 2000, 9003: "1." * 2000, 9004: "a@" + "b." * 2000 + "c", 9005: "1 " * 2000,
        9006: "+1 " + " " * 2000, 9007: "@" * 2000,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pii.summary(pii.find(docs)).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_long_texts_take_linear_time(spark):
    long = ["a" * 400_000, "1." * 200_000, "a@" + "b." * 100_000, "1 " * 100_000, "+1" * 100_000, "[at]" * 50_000, "(743) " * 50_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert pii.candidates(docs).agg(F.max("stop")).first()[0] <= 400_000


def test_wider_spans_are_added_beside_base_ones(spark):
    texts = {i: f"call {200 + i % 700}-555-{1000 + i} or +1 (743) 555-{1000 + i} now" for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pii.summary(pii.find(docs)).collect():
        assert r.n_phone == 1
        assert r.spans == "phone:5:17," + listed(base_spans(texts[r.doc_id]))


def test_unlikely_numbers_are_left(spark):
    texts = {i: f"order 4111 1111 1111 {1000 + i} of build 300.1.2.{i}" for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pii.summary(pii.find(docs)).collect():
        assert r.spans == listed(base_spans(texts[r.doc_id]))


def test_estimation_tells_good_labelers_from_bad(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(4000):
        true = rnd.random() < 0.7
        right = {"pattern": 0.95, "form": 0.9, "gazetteer": 0.8, "context": 0.6, "edges": 0.5}
        votes = [(1 if true else -1) * (1 if rnd.random() < right[v] else -1) for v in pii.VOTES]
        rows.append(("card", 0, true, *votes))
    voted = spark.createDataFrame(rows, "kind string, told int, true boolean, " + ", ".join(f"{v} int" for v in pii.VOTES))
    model = pii.reliabilities(voted, rounds=20)["card"]
    assert abs(model["share"] - 0.7) < 0.04
    assert abs(model["pattern_1_1"] - 0.95) < 0.04 and abs(model["edges_1_1"] - 0.5) < 0.08
    guess = voted.withColumn("p", pii.probability({k: model for k in pii.KINDS}))
    assert guess.agg(F.avg(((F.col("p") > 0.5) == F.col("true")).cast("int"))).first()[0] > 0.95


def test_edges_and_query(spark, small):
    rows = pii.summary(pii.find(edge.documents(spark), row="row")).collect()
    assert len(rows) == len(edge.texts())
    (found,) = [r for r in rows if r.doc_id == 302]
    assert (found.n_email, found.n_card, found.n_phone, found.n_ip) == (1, 1, 1, 0)
    assert pii.summary(pii.find(edge.empty(spark))).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op10_pii(spark, small).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_masking(spark):
    texts = ["no data", None, "é🙂 a@b.co x", "a@b.co+1 (743) 555-3824", "1.2.3.4 and a@b.co.", "x 4111 1111 1111 1111"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "row long, text string, spans string")
    found = pii.find(docs, key="row", row="row")
    out = {r.row: (r.text, r.spans) for r in pii.redact(docs, found, "row").collect()}
    assert out == {
        0: ("no data", "kept"), 1: (None, "kept"), 2: ("é🙂 [EMAIL] x", "kept"), 3: ("[EMAIL][PHONE]", "kept"),
        4: ("[IP] and [EMAIL].", "kept"), 5: ("x [CARD]", "kept"),
    }


def test_overlapping_spans_are_masked_as_one(spark):
    docs = spark.createDataFrame([(1, "abcdefgh")], "row long, text string")
    found = spark.createDataFrame(
        [(1, [(1, 1, "email", 4, True), (3, 2, "ip", 6, True)])],
        "row long, spans array<struct<begin:long, rank:long, kind:string, stop:long, base:boolean>>",
    )
    assert pii.redact(docs, found, "row").first().text == "a[EMAIL]gh"


def test_no_python_runs(spark):
    plan = pii.with_votes(pii.candidates(edge.documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
