"""Post dumps, page payloads and labelled tables: reading, flattening, writing."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens import fixed_values as fixed
from postlens import schemas
from postlens.functions import text as tx
from postlens.functions import values as val
from postlens.operators.filters import min_length
from postlens.operators.rows import unnest
from postlens.session import materialize
from postlens.sources import splits

TEXT_MAP = T.MapType(T.StringType(), T.StringType())


class Posts(NamedTuple):
    entries: DataFrame
    metadata: DataFrame
    rejects: DataFrame


def read_posts(spark: SparkSession, path: str, schema: T.StructType = schemas.POST, shape: str = "auto") -> Posts:
    """Read post dumps: ``{…, "entries": […]}``, bare arrays, or JSON Lines, mixed as they may be in a folder.

    The shape is found for each file by parsing. If the first line that is not
    blank is a JSON value of its own, the file is read by lines, splits and
    scales freely, and each line is a post or a compact dump; an array counts
    only when it is the file's single line. Else the file should be one JSON
    value; it is read by byte ranges too (see ``splits``), and if it is none its
    lines count. ``shape`` (``lines`` or ``document``) skips that look; a file of
    one line that does not fit in a row (2 GB) needs ``document``.

    Fields are read as text and cast, so one that does not fit is null and the
    post stays. Keys outside ``schema`` are kept in the map ``other``.
    ``metadata`` holds (path, key, value) for the keys beside ``entries``,
    ``rejects`` (path, value) the lines and files that are no posts.
    """
    if shape not in ("auto", "lines", "document"):
        raise ValueError(f"unknown shape: {shape}")
    values, elements = _by_line(spark, path), None
    if shape == "document":
        values, elements = _by_range(spark, path)
    elif shape == "auto":
        values, elements = _by_shape(spark, path)
    values = values.where(tx.strip(F.col("value")) != "")
    fields = F.from_json("value", TEXT_MAP)
    parsed = F.try_parse_json("value")
    head = F.substring(tx.strip(F.col("value")), 1, 1)
    kind = F.when(parsed.isNull(), "bad").when(head == "{", "object").when((head == "[") & F.col("lists"), "list").otherwise("bad")
    read = values.select("path", "value", kind.alias("_kind"), F.when(kind == "object", fields).alias("_fields"))
    boxed = F.when(F.map_contains_key("_fields", "entries"), F.from_json(F.try_element_at("_fields", F.lit("entries")), T.ArrayType(T.StringType())))
    listed = F.when(F.col("_kind") == "list", F.from_json("value", T.ArrayType(T.StringType()))).when(
        F.col("_kind") == "object", F.coalesce(boxed, F.array("value")))
    items = unnest(read, [], listed, "_item").where(F.ltrim("_item").startswith("{"))
    rejects = read.where("_kind = 'bad'").select("path", "value")
    if elements is not None:
        found = elements.where(F.ltrim("value").startswith("{")).select("path", "value", F.try_parse_json("value").isNotNull().alias("_good"))
        items = items.unionByName(found.where("_good").select(F.col("value").alias("_item")))
        rejects = rejects.unionByName(found.where("not _good").select("path", "value"))
    metadata = read.where(boxed.isNotNull()).select("path", F.explode("_fields").alias("key", "value")).where("key <> 'entries'")
    return Posts(_posts(items, "_item", schema), metadata, rejects)


def _by_line(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.lit(False).alias("lists"))


def _by_range(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Files of one JSON value: the value without its elements, and the elements. Files that are none count by line."""
    elements, rest = splits.json_elements(spark, path)
    sound = F.try_parse_json("value").isNotNull()
    rest = materialize(rest.select("path", "value", sound.alias("_sound")), "documents")
    around = rest.where("_sound").select("path", "value", F.lit(True).alias("lists"))
    if rest.where("not _sound").isEmpty():
        return around, elements
    broken = rest.where("not _sound").select("path")
    return around.unionByName(_by_line(spark, path).join(broken, "path")), elements.join(broken, "path", "left_anti")


def _by_shape(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Lines of the files that are read by line; the other files by range."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"), "value").where(tx.strip(F.col("value")) != "")
    first = F.min_by(F.try_parse_json("value").isNotNull(), F.struct("_block", "_place"))
    files = materialize(lines.groupBy("path").agg(first.alias("_alone"), F.count("*").alias("_lines")), "shapes")
    by_line = _by_line(spark, path).drop("lists").join(files.where("_alone"), "path").select("path", "value", (F.col("_lines") == 1).alias("lists"))
    # The paths of the files that need it, as Spark's own file index holds them; they come URL-encoded and go back as glob patterns.
    rest = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(row["path"])) for row in files.where("not _alone").select("path").collect()]
    if not rest:
        return by_line, None
    around, elements = _by_range(spark, rest)
    return by_line.unionByName(around), elements


def _posts(items: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """The declared fields of JSON objects, each cast on its own, and a map of all other keys."""
    fields = F.from_json(column, TEXT_MAP)
    read = items.select(fields.alias("_f"))

    def field(f: T.StructField) -> Column:
        text = F.try_element_at("_f", F.lit(f.name))
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        return (F.from_json(text, f.dataType) if nested else text.try_cast(f.dataType)).alias(f.name)

    other = F.map_filter("_f", lambda k, v: ~k.isin(schema.fieldNames()))
    return read.select(*[field(f) for f in schema.fields], other.alias("other"))


def parse_lines(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON Lines text; blank, malformed and non-object lines are skipped, a field that does not fit is null."""
    good = F.try_parse_json(column).isNotNull() & tx.strip(F.col(column)).startswith("{")
    return _posts(lines.where(good), column, schema).drop("other")


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs become dotted columns; arrays and maps stay as they are."""

    def leaves(fields: list[T.StructField], path: tuple[str, ...]) -> list[Column]:
        found = []
        for f in fields:
            here = path + (f.name,)
            if isinstance(f.dataType, T.StructType):
                found += leaves(f.dataType.fields, here)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return found

    return df.select(*leaves(df.schema.fields, ()))


def metadata_kv(df: DataFrame, json_col: str, keep: list[str] = ()) -> DataFrame:
    """Top-level keys of a JSON object as ``(key, value)`` rows; nested values stay JSON text."""
    pairs = F.from_json(json_col, T.MapType(T.StringType(), T.StringType()))
    return df.select(*keep, F.explode(pairs).alias("key", "value"))


def normalize_payload(df: DataFrame, json_col: str, slug: str = "slug", page: str = "page") -> DataFrame:
    """Stored page answers to one row per entry, with ``total_entries`` of its answer and the answer itself as ``raw_data``.

    The entries are the value of ``entries``, ``guncel`` or ``data``, else the
    first list that is not empty; a bare array is taken as it is. An answer with
    ``error`` or without entries gives no rows. What an entry is follows from its
    JSON type: objects are read field by field, texts become rows without id and
    are not cleaned, whatever they begin with, and other values are no entries.
    """
    raw = F.col(json_col)
    # Variants know the types, the map of texts keeps the order of the keys.
    staged = df.withColumn("_json", F.try_parse_json(raw)).withColumns({
        "_fields": F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, TEXT_MAP)),
        "_typed": F.try_variant_get("_json", "$", "map<string,variant>")})
    fields, typed = F.col("_fields"), F.col("_typed")

    def field(name: str) -> Column:
        return F.try_element_at(fields, F.lit(name))

    def as_list(value: Column) -> Column:
        return F.try_variant_get(value, "$", "array<variant>")

    def kind(value: Column) -> Column:
        return F.schema_of_variant(value)

    lists = F.filter(F.transform(F.map_keys(fields), lambda k: as_list(F.try_element_at(typed, k))), lambda x: F.size(x) > 0)
    named = F.get(lists, F.lit(0))
    for key in ("data", "guncel", "entries"):
        named = F.when(F.map_contains_key(fields, key), as_list(F.try_element_at(typed, F.lit(key)))).otherwise(named)
    failed = F.coalesce(F.map_contains_key(fields, "error"), F.lit(False))
    found = F.filter(F.when(fields.isNull(), as_list(F.col("_json"))).otherwise(named), lambda x: (kind(x) == "STRING") | kind(x).startswith("OBJECT"))
    headed = staged.where(~failed).withColumns({
        "_list": found,
        "title": F.coalesce(val.first_truthy(field("title"), field("baslik")), F.col(slug)),
        "_page": F.coalesce(field("current_page").try_cast("int"), F.col(page)),
        "total_pages": F.coalesce(field("total_page").try_cast("int"), F.lit(1)),
    }).drop("_fields", "_typed", "_json").withColumn("_total", F.size("_list"))
    items = unnest(headed, ["*"], "_list", "_item")
    is_object = F.schema_of_variant("_item") != "STRING"
    read = items.withColumn("_e", F.when(is_object, F.from_json(F.to_json("_item"), schemas.PAYLOAD_ENTRY)))

    def pick(*names: str, default=None, empty="") -> Column:
        return val.first_truthy(*[F.col(f"_e.{n}") for n in names], default=default, empty=empty)

    favourites = F.coalesce(*[F.nullif(F.col(f"_e.{n}").try_cast("bigint"), F.lit(0)) for n in ("fav_count", "favCount")],
                            F.lit(0))
    body = pick("body", "entry", "content", "text", default="")
    return read.select(
        F.col(slug).alias("slug"), "title", F.col("_page").alias("page"), "total_pages",
        pick("id", "entryId").alias("id"),
        F.when(is_object, tx.clean(body, "feed")).otherwise(F.try_variant_get("_item", "$", "string")).alias("content"),
        F.when(is_object, pick("author", "owner", "nick", default=fixed.UNKNOWN_AUTHOR))
        .otherwise(fixed.TEXT_ONLY_AUTHOR).alias("author"),
        pick("created_at", "date", "tarih", "created", default="").alias("date"),
        F.when(is_object, favourites).otherwise(0).alias("fav_count"),
        F.col("_total").alias("total_entries"), raw.alias("raw_data"))


def collect_pages(pages: DataFrame, max_pages: int = 5, topic: str = "topic", page: str = "page",
                  filled: Column | None = None) -> DataFrame:
    """Rows of each topic's pages 1..max, up to the first empty or missing page.

    ``filled`` tells whether a row brings entries (default: every row). The
    pages to keep are worked out per topic from at most ``max_pages`` page
    numbers and joined back as (topic, page) pairs, so a large topic stays
    spread over its pages.
    """
    within = pages.where(F.col(page).between(1, max_pages))
    if filled is not None:
        within = within.where(filled)
    numbers = within.groupBy(topic).agg(F.sort_array(F.collect_set(page)).alias("_pages"))
    # In a gapless run from 1 the i-th number (from 0) is i + 1.
    run = F.filter(F.transform("_pages", lambda p, i: F.when(p == i + 1, p)), lambda p: p.isNotNull())
    keep = numbers.select(topic, F.explode(run).alias(page))
    return within.join(keep, [topic, page], "left_semi")


def union_parts(*parts: DataFrame) -> DataFrame:
    """Concatenate topics, pages or strata by column name."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def read_labelled(spark: SparkSession, path: str, schema: T.StructType = schemas.LABELLED) -> DataFrame:
    """A labelled sheet as CSV (by suffix) or Parquet, with its declared schema. A CSV file is read by byte ranges."""
    if path.endswith(".csv"):
        return splits.read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def for_labelling(df: DataFrame, column: str = "body", strict: bool = False) -> DataFrame:
    """Cleaned bodies of more than ten characters beside an empty ``sentiment``."""
    cleaned = df.select(tx.clean(F.col(column), "labelling", strict).alias("body"))
    return min_length(cleaned, "body").withColumn("sentiment", F.lit(""))


def write_for_labelling(df: DataFrame, path: str, column: str = "body", strict: bool = False) -> None:
    # Cleaned bodies hold no line breaks, so the file stays splittable.
    for_labelling(df, column, strict).write.csv(path, header=True, escape='"', emptyValue="", mode="overwrite")


def write_predictions(df: DataFrame, path: str) -> None:
    """Input columns plus predictions, as Parquet or (by suffix) CSV."""
    if path.endswith(".csv"):
        df.write.csv(path, header=True, escape='"', mode="overwrite")
    else:
        df.write.parquet(path, mode="overwrite")


def write_metrics(lines: DataFrame, path: str) -> None:
    """The long metric table (a few dozen rows) as Parquet."""
    lines.coalesce(1).write.parquet(path, mode="overwrite")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, metric string, label string, value double").parquet(path)
