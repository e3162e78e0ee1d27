"""Small tables with every awkward row, shared by the tests of the corpus operators."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, hash long, "
    "body string, class string, start long, path long, words long, score double, taken int"
)
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))


def odd_rows() -> list[tuple]:
    """Nulls in all columns, empty, blank and very long texts, copies, repeated rows, null ids."""
    prose = "the quick brown fox jumps over the lazy dog while the cat sleeps\n" * 3
    texts = [
        (0, None), (1, ""), (2, " \t\n\x0b"), (3, "word"), (4, LONG), (5, LONG), (6, prose),
        (6, prose), (7, prose.replace(" ", "  ")), (8, "<|endoftext|> ünï — 漢字 🙂"), (9, ""),
        (None, "text without an id"), (None, None), (10, "a\r\nb\x00c"), (2**60, "a large id"),
    ]
    rows = []
    for i, (doc_id, text) in enumerate(texts):
        extra = ("x", i, None, "class", 1, 2, 3, 0.5, 1) if i % 2 else (None,) * 9
        rows.append((doc_id, text, None if i % 3 else "en", None if i % 4 else "s", None, *extra))
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def prose(seed: int, words: int, vocabulary: int = 5000) -> list[str]:
    pick = random.Random(seed)
    return [f"v{pick.randrange(vocabulary)}" for _ in range(words)]


def dicts(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]
