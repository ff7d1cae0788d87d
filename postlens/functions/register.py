"""The text functions under SQL names, for use in ``spark.sql``."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import text as tx

#: Texts that a Python task holds as objects at a time.
SLICE = tx.SLICE

SQL_FUNCTIONS = {
    "squash_ws": (r"(t STRING) RETURNS STRING RETURN "
                  r"trim(regexp_replace(t, r'[\s\x1c-\x1f\x85\p{Z}]+', ' '))"),
    "strip_tags": r"(t STRING) RETURNS STRING RETURN regexp_replace(t, r'<[^>]+>', '')",
    "split_sentences": (r"(t STRING) RETURNS TABLE (sent_idx INT, sentence STRING) RETURN "
                  r"SELECT pos, col FROM posexplode(filter(transform(split(t, r'[.?!…\n]+'), "
                  r"s -> regexp_replace(s, r'^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$', '')), s -> s <> ''))"),
}


@F.arrow_udf(T.StringType())
def _unescape_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whole texts, for a caller in SQL; ``text.html_unescape`` sends references only."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield pa.array([None if t is None else html.unescape(t) for t in batch.slice(at, SLICE).to_pylist()], pa.string())


def register(spark: SparkSession) -> None:
    """Register ``html_unescape``, ``nfc`` and the pure SQL functions for this session."""
    spark.udf.register("html_unescape", _unescape_text)
    spark.udf.register("nfc", tx._compose)
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
