"""Exact deduplication by a 128-bit content hash with a byte comparison inside groups.

Plan: one scan hashes every text; the narrow rows (id, hash, row number) are
stored. Only hashes that occur more than once matter further: their texts are
compared by a map-side combined ``min``/``max``, so a group of any size never
meets in one task. A hash whose texts differ (a collision) is grouped by the
text itself. The verdict goes back to the narrow rows by a join whose hot keys
AQE can split, because both sides are stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Query, keep_once, null_safe, stage, table, unused, whole, without


def _verdicts(rows: DataFrame, key: str, keep: str) -> DataFrame:
    """``rows`` (id, row, ``key``, …) with keep_id, group_size and kept."""
    pick = F.max if keep == "largest" else F.min
    # Null ids lose against any other id; the row number only breaks ties of equal ids.
    order = F.struct(F.col("_id").isNotNull() if keep == "largest" else F.col("_id").isNull(), "_id", "_row")
    groups = rows.groupBy(key).agg(pick(order).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = stage(groups.select(key, F.col("_best._id").alias("_keep"), F.col("_best._row").alias("_keep_row"), "_n"), "copies")
    alone = F.col("_n").isNull()
    return rows.join(groups, key, "left").select(
        "_id", F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"), "_sha")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                hash_of=F.md5) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is the empty text. Of
    equal texts the row with the ``smallest`` (or ``largest``) id is kept. A null
    id is kept only when its whole group has none. Rows that repeat both id and
    text count one by one and exactly one of them is kept. An empty table gives
    an empty result. Other columns are ignored, whatever their names.

    ``hash_of`` makes the content hash; collisions never merge different texts.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = whole(F.col(text_col))
    hashed = stage(docs.select(
        F.col(id_col).alias("_id"), hash_of(text.cast("binary")).alias("_key"), F.sha2(text.cast("binary"), 256).alias("_sha"),
        F.monotonically_increasing_id().alias("_row")), "hashes")
    repeated = stage(hashed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "repeated")
    texts = docs.select(hash_of(text.cast("binary")).alias("_key"), text.alias("_text")).join(repeated, "_key", "left_semi")
    collided = stage(texts.groupBy("_key").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
                     .where("_low <> _high").select("_key"), "collided")
    if collided.isEmpty():
        found = _verdicts(hashed, "_key", keep)
    else:
        clean = hashed.join(collided, "_key", "left_anti")
        mixed = stage(docs.select(F.col(id_col).alias("_id"), hash_of(text.cast("binary")).alias("_key"), text.alias("_text"),
                                  F.sha2(text.cast("binary"), 256).alias("_sha")).join(collided, "_key", "left_semi")
                      .withColumn("_row", F.monotonically_increasing_id()), "mixed")
        found = _verdicts(clean, "_key", keep).unionByName(_verdicts(mixed, "_text", keep))
    return found.withColumnRenamed("_id", id_col).withColumnRenamed("_sha", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows that ``mark_copies`` drops, all columns unchanged."""
    text, name = whole(F.col(text_col)), unused(docs, "_record")
    marks = mark_copies(docs, id_col, text_col, keep)

    def record(digest):
        return F.struct(null_safe(F.col(id_col)).alias("id"), digest.alias("text")).alias(name)

    gone = stage(marks.where(~F.col("kept")).select(
        record(F.col("text_sha256")), F.col("keep_id").eqNullSafe(F.col(id_col)).alias("_again")), "dropped")
    keyed = docs.select("*", record(F.sha2(text.cast("binary"), 256)))
    kept = without(keyed, gone.where("not _again").select(name), name)
    # Dropped rows that repeat id and text of the kept one: one of those rows stays, whichever.
    return keep_once(kept, stage(gone.where("_again").select(name).distinct(), "again"), name).drop(name)


def _run(spark, folder):
    return mark_copies(table(spark, folder, "documents"), keep="largest")


QUERIES = {
    "op2_exact_dedup": Query(_run, """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""),
}
