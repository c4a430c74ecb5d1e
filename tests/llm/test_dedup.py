"""Exact and near dedup against plain brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from compare import connect, differences
from llm import edge

from broadsheet.llm import exact_dedup, queries, simhash
from broadsheet.llm.components import components
from broadsheet.session import shared_dir


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_equals_sql(spark, small):
    found = differences(spark, connect(small), "op5", queries.op5_exact_dedup, queries.OP5_SQL, small)
    assert found is None


def test_exact_dedup_edges(spark):
    docs = edge.documents(spark)
    rows = exact_dedup.deduplicate(docs, shared_dir(spark, "index")).collect()
    groups: dict[str, list] = {}
    for key, text in edge.texts():
        groups.setdefault(hashlib.sha256(lowered(text).encode()).hexdigest(), []).append(key)
    assert len(rows) == len(edge.texts())
    for r in rows:
        keys = groups[bytes(r.digest).hex()]
        keep = max((k for k in keys if k is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(keys), r.doc_id == keep)


def test_one_of_repeated_rows_stays(spark):
    docs = edge.documents(spark)
    rows = exact_dedup.deduplicate(docs, shared_dir(spark, "index"), row="row").collect()
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({bytes(r.digest) for r in rows}) == len({bytes(r.digest) for r in kept})


def test_history_is_looked_up(spark):
    """Members join the group found in the index, the others group by themselves."""
    history = spark.createDataFrame([(i, f"t{i % 700}") for i in range(1000)], "doc_id long, text string")
    fresh = spark.createDataFrame([(2000 + i, f"t{650 + i % 100}") for i in range(300)], "doc_id long, text string")
    path = shared_dir(spark, "index")
    old = exact_dedup.grouped(exact_dedup.digests(history))
    shards = exact_dedup.write_index(old, path, keys_per_shard=50)
    assert shards == 14
    found = exact_dedup.lookup(exact_dedup.grouped(exact_dedup.digests(fresh)), path, shards).collect()
    by = {hashlib.sha256(f"t{i}".encode()).digest(): i for i in range(750)}
    assert len(found) == 100
    for r in found:
        i = by[bytes(r.digest)]
        assert r.copies == 3
        if i < 700:
            assert (r.old_doc_id, r.old_copies) == ((i + 700, 2) if i < 300 else (i, 1))
        else:
            assert r.old_doc_id is None and r.old_copies is None


def test_many_fresh_digests_beside_a_small_history(spark):
    """One far smaller key leaves one historical digest: the fresh ones are dealt into parts."""
    docs = spark.createDataFrame([(i + 10**9 if i else 0, f"t{i % 900}") for i in range(1000)], "doc_id long, text string")
    rows = exact_dedup.digests(docs)
    path = shared_dir(spark, "index")
    shards = exact_dedup.write_index(exact_dedup.grouped(rows.where("doc_id = 0")), path)
    fresh = exact_dedup.grouped(rows.where("doc_id > 0"))
    dealt, parts = exact_dedup._dealt(fresh, shards, 50)
    assert (shards, parts) == (1, 18)
    assert dealt.groupBy("shard", "part").count().agg({"count": "max"}).first()[0] < 100
    found = exact_dedup.lookup(fresh, path, shards, 50).collect()
    assert len(found) == len({bytes(r.digest) for r in found}) == 900
    assert [(r.doc_id, r.copies, r.old_doc_id) for r in found if r.old_copies] == [(900 + 10**9, 1, 0)]
    judged = exact_dedup.deduplicate(docs, shared_dir(spark, "index")).collect()
    assert len(judged) == 1000 and sum(r.kept for r in judged) == 900


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 3000])
def test_perfect_hash_has_a_slot_for_each(n):
    data = b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n))
    slots = exact_dedup.PerfectHash.build(data).slots(data)
    assert sorted(slots.tolist()) == list(range(n))


def test_perfect_hash_refuses_repeats():
    with pytest.raises(ValueError):
        old, exact_dedup.MAX_TRIES = exact_dedup.MAX_TRIES, 100
        try:
            exact_dedup.PerfectHash.build(hashlib.sha256(b"x").digest() * 2)
        finally:
            exact_dedup.MAX_TRIES = old


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, near):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in near:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def plain_groups(keyed, width=3):
    fps = {k: plain_fingerprint(t, width) for k, t in keyed}
    keys = sorted(fps)
    near = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (fps[a] ^ fps[b]).bit_count() <= 2]
    return fps, plain_components(keys, near)


def test_simhash_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    fps, groups = plain_groups(docs)
    rows = queries.op3_simhash(spark, small).collect()
    assert len(rows) == len(docs)
    assert all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", groups[r.doc_id]) for r in rows)


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(edge.documents(spark), row="row").collect()
    keyed = list(enumerate(t for _, t in edge.texts()))
    keys = [k for k, _ in edge.texts()]
    fps, groups = plain_groups(keyed)
    assert sorted(r.row for r in rows) == list(range(len(keyed)))
    for r in rows:
        assert r.doc_id == keys[r.row] and r.fp % (1 << 64) == fps[r.row]
        own = [i for i in groups if groups[i] == groups[r.row]]
        assert r.component_id == min((keys[i] for i in own if keys[i] is not None), default=None)
        assert r.first_row == min(own, key=lambda i: (keys[i] is None, keys[i] or 0, i))


@pytest.mark.parametrize("segments, shard_rows", [(4, 100_000), (4, 40), (6, 60), (8, 100_000)])
def test_links_of_clustered_fingerprints(spark, segments, shard_rows):
    rnd = random.Random(segments)
    fps = {rnd.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for centre in list(fps)[:6]:
        for _ in range(60):
            x = centre
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(frame, segments, shard_rows).collect()
    assert all((a ^ b).bit_count() <= 2 for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in found))
    want = plain_components(signed, [(a, b) for a in signed for b in signed if a > b and ((a ^ b) % (1 << 64)).bit_count() <= 2])
    assert plain_components(signed, [(r.a, r.b) for r in found]) == want


def test_shards_that_do_not_shrink_do_not_stop_the_others(spark):
    """One shard holds copies of one neighbourhood, the other can be divided."""
    rnd = random.Random(2)
    close = [(1, True, 1 << b) for b in range(62)]
    far = [(2, True, rnd.getrandbits(63)) for _ in range(400)]
    dealt = spark.createDataFrame(close + far, "shard long, home boolean, fp long")
    divided = simhash._divide(dealt, 50)
    sizes = {r.shard: r["count"] for r in divided.where("home").groupBy("shard").count().collect()}
    assert sum(sizes.values()) == len(close) + len(far)  # every fingerprint has one home
    assert max(sizes.values()) <= 62 and len(sizes) > 5


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(1000, 1001 + i) for i in range(200)] + [(7, 7), (5000, 4999)]
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {k: v for k, v in plain_components({x for p in pairs for x in p}, pairs).items() if k != v}
    assert {r.node: r.root for r in rows} == want


def test_empty_tables(spark):
    docs = edge.empty(spark)
    assert exact_dedup.deduplicate(docs, shared_dir(spark, "index")).count() == 0
    assert simhash.near_duplicates(docs).count() == 0


def test_hot_text_is_one_row_per_task_before_the_shuffle(spark):
    rows = exact_dedup.digests(edge.documents(spark))
    plan = exact_dedup.grouped(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
