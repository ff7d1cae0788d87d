"""From raw documents to packed training windows: five stages, each stored as Parquet before the next.

All stages take nulls in any column, empty and very long texts, ties, repeated
rows and ids, an empty table (empty result), and further columns of any name,
which pass through unchanged up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postlens.llm import exact_dedup, mixing, near_dedup, packing, quality
from postlens.llm.common import Query, release, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged one by one; a null text has no words and goes, a null source is a host of its own."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (a null is the empty text), the document with the largest id; null ids lose, and of rows equal in both one stays."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one document: that with the least id, a null id last, then with the least digest of its text."""
    return near_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one text a source is cut. Ties are broken by size, texts without words go."""
    return mixing.repeat_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that the mix repeats has pieces for each repetition, told apart by sequence and offset."""
    return packing.piece_table(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The tokenizer is not expressible in SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        # A stored stage replaces the one it was made from.
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = Query(run, ORACLE_SQL)
