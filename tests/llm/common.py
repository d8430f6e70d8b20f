"""Fixtures of documents, built by a small generator of invented words."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(texts: list, sources: list | None = None) -> list[tuple]:
    return [(i, t, "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark: SparkSession, texts: list, sources: list | None = None) -> DataFrame:
    return spark.createDataFrame(rows(texts, sources), DOCS)


def empty(spark: SparkSession, schema: str = DOCS) -> DataFrame:
    return spark.createDataFrame([], schema)


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


#: Texts of every awkward kind.
AWKWARD = [None, "", "   \n\t ", "one", "é", " 　", "a" * 200_000, "x y " * 30_000, "same words here", "same words here", "日本 語 " * 50, "\n\n\n"]
