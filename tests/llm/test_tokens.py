"""Token files, counts, encoding and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm import edge
from tokenizers import Tokenizer

from broadsheet.llm import bpe, packing, queries, token_counts, token_files
from broadsheet.llm.vocabulary import Vocabulary, Words, default_path, laid_out, library_chunks

BYTE, WORD = (default_path(n) for n in (queries.BYTE_BPE, queries.WORD_BPE))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_library_ids(library, path):
    rnd = random.Random(1)
    letters = "ab'sZé \n\t,.1²İ́<|>\x02　中ß\x85\x1c"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += [t or "" for _, t in edge.texts()] + ["a <|endoftext|> b<|startoftext|>c  ", "it's I'LL don't."]
    ids, ends = laid_out(*library_chunks(path).of(pa.array(texts)))
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == ids_of(library[path], text), text[:80]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_word_is_merged_once_whatever_stands_around_it(library, path):
    words = Words(Vocabulary(path))
    merge, merged = words._of_letters, []
    words._of_letters = lambda letters: merged.extend(letters) or merge(letters)
    texts = ["alpha Alpha, alpha. alpha; émile\nalpha?! émile: alpha", "alpha,\nalpha. alpha!!", "\nalpha", "alpha\n"]
    ids, ends = laid_out(*words.of(pa.array(texts)))
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == ids_of(library[path], text)
    # Vocabularies with blanks in words have one form after a blank and one without.
    assert sorted(w.strip("\u0120") for w in merged).count("alpha") <= (1 if path == WORD else 3)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_full_table_of_words_forgets(library, path):
    words, rnd = Words(Vocabulary(path), limit=40), random.Random(4)
    for _ in range(30):
        texts = [" ".join(rnd.choice(["the", "of,", "né", "a-b", "\n", "x" * rnd.randint(1, 30), f"{rnd.random()}"]) for _ in range(12)) for _ in range(5)]
        ids, ends = laid_out(*words.of(pa.array(texts)))
        for text, a, b in zip(texts, [0, *ends], ends):
            assert ids[a:b].tolist() == ids_of(library[path], text)
        assert len(words.known) == len(words.runs.sizes) == len(words.batches) <= 140
    assert "the" in words.known


def test_ids_of_whole_bytes_are_packed_lowest_bit_first():
    ids = np.random.default_rng(5).integers(0, 50_257, 1003).astype(np.uint32)
    bits = sum(int(x) << (16 * i) for i, x in enumerate(ids))
    assert token_files.pack_bits(ids, 16) == bits.to_bytes(16 * 126, "little")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_own_merging_gives_the_library_ids(library, path):
    vocabulary = Vocabulary(path)
    index = bpe.PairIndex(vocabulary)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeintrsé") for _ in range(rnd.randint(1, 14))) for _ in range(500)] + ["a" * 500]
    for word, found in zip(words, index.merge([[vocabulary.ids[s] for s in vocabulary.symbols(vocabulary.in_letters(w))] for w in words])):
        want = ids_of(library[path], word)
        assert found.tolist() == want
        assert token_counts.merged_length(vocabulary.symbols(vocabulary.in_letters(word)), vocabulary.ranks) == len(want)


@pytest.mark.parametrize("size", [2, 3, 100, 256, 257, 50257, 70_000, 1 << 31])
def test_bits_round_trip(size):
    bits = token_files.bits_for(size)
    ids = np.random.default_rng(size).integers(0, size, 1003).astype(np.uint32)
    data = token_files.pack_bits(ids, bits)
    assert len(data) == 126 * bits
    for first, count in ((0, 1003), (5, 17), (1002, 1), (8, 8), (3, 0)):
        assert (token_files.unpack_bits(data, bits, first, count) == ids[first : first + count]).all()


def test_token_files(spark, tmp_path, library):
    docs = edge.documents(spark)
    token_files.write_token_files(docs, str(tmp_path / "t"), BYTE, end_id=0, block_ids=500)
    rows = sorted(token_files.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    wanted = sorted(((d is not None, d or 0, t or "") for d, t in edge.texts()))
    at, stream = 0, []
    for row, (known, key, text) in zip(rows, wanted, strict=True):
        ids = [*ids_of(library[BYTE], text), 0]
        assert (row.doc_id, row.start, row.n_tokens) == (key if known else None, at, len(ids))
        assert bytes(row.ids) == np.array(ids, "<u4").tobytes()
        at += len(ids)
        stream += ids
    for first, count in ((0, 10), (490, 30), (at - 3, 50), (12_345, 2_000)):
        span = token_files.read_span(spark, str(tmp_path / "t"), first, count).orderBy("start").collect()
        assert np.frombuffer(b"".join(bytes(s.ids) for s in span), "<u4").tolist() == stream[first : first + count]


def test_counts_and_encoding(spark, library):
    docs = edge.documents(spark)
    counts = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, BYTE).collect())
    assert counts == Counter((d, len((t or "").encode()), len(ids_of(library[BYTE], t))) for d, t in edge.texts())
    rows = bpe.decode(bpe.encode(docs, WORD), WORD).collect()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in rows)
    want = Counter()
    for d, t in edge.texts():
        ids = ids_of(library[WORD], t)
        want[d, len(ids), np.array(ids, "<u4").tobytes(), library[WORD].decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_byte_decoder(library):
    decoder = bpe.Decoder(Vocabulary(BYTE))
    rnd = random.Random(3)
    for _ in range(200):
        ids = [rnd.randrange(50_257) for _ in range(rnd.randint(0, 12))]
        assert decoder(ids) == library[BYTE].decode(ids, skip_special_tokens=False)


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, None, "x")], "k int, ids binary, decoded string")
    assert bpe.decode(rows, WORD).select("k", "decoded").collect() == [(1, None)]


def check_pieces(rows, documents, length):
    """Every document whole, sequences without gaps; returns the sequences."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(documents)
    for key, pieces in by.items():
        ids, at = documents[key], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert bytes(p.ids) == np.array(ids[at : at + p.length], "<u4").tobytes() and p.length > 0
            at += p.length
        assert at == len(ids)
    for number in range(len(sequences)):
        at = 0
        for p in sorted(sequences[number], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or at & (at - 1) == 0
    return sequences


def test_packing_follows_the_mixture(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = {r.doc_id: [*ids_of(library[WORD], r.text), 2] for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    mixture = {f"src{i}": 3.0 if i == 0 else 1.0 for i in range(20)}
    for wanted in (None, mixture):
        rows = packing.pack(docs, WORD, 2, 4096, wanted).collect()
        sequences = check_pieces(rows, ids, 4096)
        totals = Counter()
        for key, own in ids.items():
            totals[source[key]] += len(own)
        weights = wanted or totals
        served = Counter()
        # While no queue is dry, each is within a grain of its share, the deficit carried on.
        last = min(3, len(sequences)) if wanted else len(sequences) - 8
        for number in range(last):
            for p in sequences[number]:
                served[source[p.doc_id]] += p.length
            done = 4096 * (number + 1)
            for name, weight in weights.items():
                share = done * weight / sum(weights.values())
                assert abs(served[name] - share) <= 4 * packing.GRAIN + 4096 * weight / sum(weights.values())


def test_packing_edges(spark, library):
    keyed = [(i, t) for i, (_, t) in enumerate(edge.texts())]
    docs = spark.createDataFrame([(i, t, None if i % 3 else "s", 1, "x", 2) for i, t in keyed], "doc_id bigint, text string, source string, row int, ids string, n int")
    ids = {i: [*ids_of(library[WORD], t), 2] for i, t in keyed}
    rows = packing.pack(docs, WORD, 2, 512, grain=64)
    sequences = check_pieces(rows.collect(), ids, 512)
    padded = {r.sequence_id: (r.n_ids, len(r.ids)) for r in packing.sequences(rows, 512, 7).collect()}
    assert set(padded) == set(sequences)
    assert all(size == 4 * n for n, size in padded.values())
    assert packing.pack(edge.documents(spark), WORD, 2).groupBy().sum("length").first()[0] == sum(map(len, ids.values()))


def test_padding_to_full_length(spark):
    rows = spark.createDataFrame([(0, 3, 0, bytearray(range(12)))], "sequence_id long, length long, offset long, ids binary")
    (row,) = packing.sequences(rows, 8, pad_id=258).collect()
    assert bytes(row.ids) == bytes(range(12)) + b"\x02\x01\0\0" * 5


def test_wrong_parameters(spark):
    with pytest.raises(ValueError):
        packing.pack(edge.empty(spark), WORD, 2, 100, grain=64)
    with pytest.raises(ValueError):
        packing.pack(edge.empty(spark), WORD, 2, mixture={"a": 0.0})


def test_empty_tables(spark, tmp_path):
    docs = edge.empty(spark)
    token_files.write_token_files(docs, str(tmp_path / "t"), BYTE)
    assert token_files.read_documents(spark, str(tmp_path / "t")).count() == 0
    assert token_counts.token_counts(docs, BYTE).count() == 0
    assert bpe.decode(bpe.encode(docs, WORD), WORD).count() == 0
    assert packing.pack(docs, WORD, 2).count() == 0


def test_queries(spark, small, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    files = {r.doc_id: r for r in queries.op1_token_files(spark, small).collect()}
    counts = {r.doc_id: r for r in queries.op2_token_counts(spark, small).collect()}
    coded = {r.doc_id: r for r in queries.op8_bpe(spark, small).collect()}
    pieces = queries.op4_packing(spark, small).collect()
    assert len(files) == len(counts) == len(coded) == len({p.doc_id for p in pieces}) == len(docs)
    at = 0
    for key, text in docs:
        ids = ids_of(library[BYTE], text)
        assert (files[key].start, files[key].n_tokens, files[key].ids_crc32) == (at, len(ids) + 1, crc([*ids, 0]))
        assert (counts[key].n_bytes, counts[key].n_tokens, counts[key].over_limit) == (len(text.encode()), len(ids), len(ids) > 512)
        at += len(ids) + 1
        words = ids_of(library[WORD], text)
        decoded = library[WORD].decode(words, skip_special_tokens=False)
        assert (coded[key].n_tokens, coded[key].ids_sha256) == (len(words), sha(words))
        assert coded[key].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        for p in (p for p in pieces if p.doc_id == key):
            assert p.ids_crc32 == crc([*words, 2][p.start : p.start + p.length])


def test_nothing_is_shuffled_for_counts(spark):
    plan = token_counts.token_counts(edge.documents(spark).coalesce(2), BYTE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the fixture's own repartition


def test_packing_of_many_sources_and_one_key(spark, library):
    """Rows of one key, nearly each with a source of its own beside a hot one: whole, and no empty rounds."""
    texts = [f"word{i} of text " * (1 + i % 7) for i in range(3000)]
    rows = [(7, t, "hot" if i % 3 == 0 else f"s{i}", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, number int")
    pieces = packing.pack(docs, WORD, 2, 4096).collect()
    want = Counter(n for t in texts for n in [len(ids_of(library[WORD], t)) + 1])
    assert sum(p.length for p in pieces) == sum(n * c for n, c in want.items())
    assert Counter(p.doc_tokens for p in pieces if p.start == 0) == want
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        assert sum(n for _, n in own) <= 4096


@pytest.mark.parametrize("quantum", [1 - 2**-53, 0.1, 1 / 3, 1e-3, 1.0, 2.7, 31.9])
def test_rounds_that_serve_grains(spark, quantum):
    """The unfolded rounds are those whose running total grows, and no others."""
    total, grain = 700 * 4 - 1, 4
    queues = spark.createDataFrame([("q", total, quantum)], "queue string, total long, quantum double")
    found = [(r.round, r.served, r.base) for r in packing._runs(queues, grain).orderBy("round").collect()]
    served, want, number = 0, [], 0
    while served < total:
        number += 1
        now = min(total, int(np.floor(number * quantum)) * grain)
        if now > served:
            want.append((number, served, served))
        served = now
    assert found == want
