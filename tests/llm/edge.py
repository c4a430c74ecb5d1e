"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, fp string, digest string, kind string, spans string, n bigint, ids string, queue string, shard int, label int"
WORDS = ["alpha", "Beta", "don't", "émile", "ÀÉ", "x.", "12", "n,", "the", "of", "Ω", "中文", "🙂", "a_b", "<|endoftext|>"]


def texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(11)
    rows: list[tuple[int | None, str | None]] = [
        (i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 60)))) for i in range(40, 80)
    ]
    copies = [(100 + i, rows[0][1]) for i in range(25)]
    near = [(200 + i, rows[5][1] + f" tail{i}") for i in range(3)]
    odd = [
        (1, None), (2, ""), (3, ""), (4, "   "), (5, "\n\n \t"), (6, "one"), (7, "ONE"), (8, "two words"),
        (9, "  a  b\n\nc d\r\n e "), (10, "lone ́ marks é İ ΑΣ"), (11, "very long " * 30_000),
        (12, "z" * 20_000), (13, "\x02a \x02b"), (None, "no key"), (None, None), (300, "same row"), (300, "same row"),
        (301, "same key"), (301, "other text"), (302, "mail a@b.co, +1 (743) 555-3824 and 4111 1111 1111 1111"),
        (303, "<b>not & html</b>"),
    ]
    return rows + copies + near + odd


def documents(spark):
    """The texts with columns whose names the operators use themselves."""
    rows = [
        (d, t, None if i % 7 == 0 else ["en", "de"][i % 2], None if i % 5 == 0 else "hot" if i % 3 else f"s{i % 4}",
         None if i % 6 == 0 else len(t or ""), i, "f", "d", "k", "s", 5, "i", "q", 1, i % 2)
        for i, (d, t) in enumerate(texts())
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
