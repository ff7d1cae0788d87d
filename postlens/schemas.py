"""Declared schemas (nothing is inferred at read time)."""

from pyspark.sql import types as T

POST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("fav_count", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("page", T.IntegerType()),
])

LABELLED = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("RDuygu", T.StringType()),
    T.StructField("Rkategori", T.StringType()),
])

PREDICTED = T.StructType(LABELLED.fields + [
    T.StructField("Tduygu", T.IntegerType()),
    T.StructField("Tkategori", T.StringType()),
    T.StructField("topic", T.StringType()),
])

# One scored sentence of a post, in reading order inside an array column.
SCORED = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))

# A post inside a page payload: every field name the sources are known to use.
PAYLOAD_ENTRY = T.StructType([
    T.StructField(name, T.StringType())
    for name in (
        "id", "entryId", "body", "entry", "content", "text", "author", "owner",
        "nick", "created_at", "date", "tarih", "created", "fav_count", "favCount",
    )
])
