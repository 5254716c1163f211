"""Small documents for the tests."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, shard string, size string, bucket string, rank string"
SYLLABLES = ("an", "be", "cor", "du", "el", "fi", "gra", "hos", "in", "jul", "ka", "lo")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def frame(spark, texts, ids=None, langs=None, sources=None):
    """Documents with more columns, whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, (langs or {}).get(n, "en") if not isinstance(langs, list) else langs[n],
         sources[n] if sources else f"src{n % 3}", None, "x", "y", "z", None, "r")
        for n, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, a very long one, ties and repeated rows, ids missing."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t ", long, long, "AB cd", "ab CD", "x", None, prose(rng, 40), "ünï çé", "ab CD"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, None, 8, 6]
    sources = ["a", None, "a", "a", "b", "a", "a", None, "c", "a", "é", "a"]
    return frame(spark, texts, ids, sources=sources)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])
