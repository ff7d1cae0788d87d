from __future__ import annotations

import random

import public_tokenizers
import pytest

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, _key string, _id string, kept string, size long"


def prose(seed: int, words: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text, source) as a table with further columns whose names the operators use inside."""
    def make(rows):
        full = [(i, t, s, "x", "y", "z", 1) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, copies, repeated rows and ids."""
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60), "a"), (2, prose(2, 60), "b"), (2, prose(2, 60), "b"), (3, None, "a"), (4, "", None), (None, prose(3, 40), "a"),
        (None, prose(2, 60), None), (5, " \n\t ", "a"), (6, long, "b"), (7, long + " tail", "b"), (8, prose(4, 4), "a"),
        (8, prose(5, 30), "a"), (9, "\U0001f600 ünï " * 30, "c"), (10, "one", None)]
