"""Small tables with all that may go wrong in one."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", shard string, position int, gone string, cuts string, tie string, row string, host string, path string, z string, _text string, i int, t int"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))


def nasty(spark: SparkSession) -> DataFrame:
    """Nulls in each column, empty and blank texts, a very long one, repeated rows, one id with two texts, columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
        (3, None, "en", "a", None), (4, "", None, "b", 0), (None, "some words of a row without an id", "de", None, 33), (5, " \t\n ", "de", "b", 4), (6, LONG, "en", "a", len(LONG)), (7, LONG + " end", "en", "a", len(LONG) + 4),
        (8, "one text", None, None, 8), (8, "another text", None, None, 12), (9, "é ü ▁ 日本語 \U0001f600", "ja", "c", 12), (None, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, *["x", 1, *["y"] * 8, 1, 2]) for r in rows], SCHEMA + EXTRA)


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def prose(n: int, words: int, seed: int = 3, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(known) for _ in range(r.randint(1, words))) for _ in range(n)]


def table(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
