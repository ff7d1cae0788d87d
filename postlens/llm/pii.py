"""Personal data: patterns for addresses and numbers, and terms that give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Then
corpus co-occurrence tells which ordinary terms reveal one of the found values:
a term t that shares n(t,e) whole texts with value e, and stands in n(t), leaves
-log2(n(t,e) / n(t)) bits about e, its information content less the pointwise
mutual information. Terms that leave at most ``MAX_BITS`` are spans too, wherever they stand;
``sanitise`` removes them or puts their kind in their place. A term is a run of letters of any length.

Plan: one scan reduces texts to their matches. Positions are running sums over a
text's matches, so they take time in proportion to the matches. Only texts with a value
that enough texts hold are gathered; n(t,e) is at most the number of these texts with t, and at
most the count of the most frequent value beside t, which rules out common terms before any
term meets a value. Terms (and values) in exactly the same texts are counted as one, so copies of
a long text with many values cost one pair. Filters of fixed size keep all other texts from moving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.values import let
from postlens.llm.common import Query, may_be_among, null_safe, only, stage, table, whole

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
#: Each pattern matches what its plain form matches; the start conditions and possessive
#: quantifiers only rule out attempts that must fail, so that time stays linear on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without these characters a pattern cannot match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD_TERM = r"\p{L}[\p{L}\p{M}'’-]*+"
MIN_SUPPORT = 3
MAX_BITS = 1.0


def matches(text: Column, pattern: str) -> Column:
    """Array of struct(gap: characters since the last match, value) of all matches, leftmost first."""
    return let(F.split(text, pattern, -1), lambda between: F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 0), lambda value, i: F.struct(
            F.length(F.get(between, i)).alias("gap"), value.alias("value"))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(F.array_remove(F.split(F.reverse(number), ""), ""), lambda c, i: let(
        c.cast("int") * (F.lit(1) + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    count = F.length(digits(value))
    card = F.when(count.between(12, 19), luhn(digits(value))).otherwise(False)
    return (F.when(kind == "ip", value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).when(kind == "card", card)
            .when(kind == "phone", count.between(9, 15)).otherwise(True))


def placed(rows: DataFrame, keys: list[str], listed: str) -> DataFrame:
    """One row per match in the array column ``listed``, with its start and end."""
    out = rows.select(*keys, F.posexplode_outer(listed).alias("_i", "_m")).where("_m is not null")
    so_far = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_m.gap") + F.length("_m.value")).over(so_far)
    return out.select(*keys, "_m", end.alias("_end")).select(
        *keys, "_m", (F.col("_end") - F.length("_m.value")).alias("_start"), "_end")


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_TERM), 0), F.lower)


def _once(docs: DataFrame, text_col: str, repeated: DataFrame) -> DataFrame:
    """(_h, _text): every different text once; only those whose hash is in stored ``repeated`` are shuffled."""
    text = whole(F.col(text_col))
    rows = docs.select(F.xxhash64(text).alias("_h"), text.alias("_text"))
    maybe = may_be_among(F.col("_h"), repeated)
    return rows.where(~maybe).unionByName(rows.where(maybe).dropDuplicates(["_h"]))


def _text_set() -> list[Column]:
    """Aggregates that are equal for groups with the same texts ``_h``: their number and 128 bits of their hashes."""
    return [F.count(F.lit(1)).alias("_n"), *[F.bit_xor(F.xxhash64("_h", F.lit(i))).alias(f"_x{i}") for i in (1, 2)]]


SAME_TEXTS = ["_n", "_x1", "_x2"]


def revealing_terms(found: DataFrame, texts: DataFrame, min_support: int = MIN_SUPPORT, max_bits: float = MAX_BITS) -> DataFrame:
    """Stored (_term, bits) of the terms that give some value away, from ``texts``, each different text once.

    ``found`` has a row (_h, _kind, _m.value) per found value.
    """
    def bits(both):
        return -F.log2(both / F.col("_n"))

    entity = F.md5(F.concat("_kind", F.lit(":"), F.lower("_m.value")))
    held = stage(found.select(entity.alias("_entity"), "_h").distinct(), "values")
    values = stage(held.groupBy("_entity").agg(*_text_set()).where(F.col("_n") >= min_support), "frequent-values")
    # Values in exactly the same texts are one class.
    classes = held.join(values, "_entity").select("_h", *[F.col(c).alias(f"_e{c}") for c in SAME_TEXTS]).distinct()
    classes = stage(classes, "value-classes")
    holders = stage(classes.groupBy("_h").agg(F.max("_e_n").alias("_most")), "holders")

    inside = stage(only(texts, holders, "_h").select("_h", "_most", F.array_distinct(_terms(F.col("_text"))).alias("_terms")), "inside")
    inside = inside.select("_h", "_most", F.explode("_terms").alias("_term"))
    bound = F.least(F.count(F.lit(1)), F.max("_most"))
    bounds = stage(inside.groupBy("_term").agg(bound.alias("_bound")).where(F.col("_bound") >= min_support), "bounds")
    everywhere = texts.select("_h", F.explode(F.array_distinct(_terms(F.col("_text")))).alias("_term"))
    counted = everywhere.groupBy("_term").agg(*_text_set()).join(bounds, "_term").where(bits(F.col("_bound")) <= max_bits)
    counted = stage(counted.select("_term", *SAME_TEXTS), "candidates")

    # So are terms in the same texts: the least one stands for all.
    speakers = stage(counted.groupBy(*SAME_TEXTS).agg(F.min("_term").alias("_term")), "speakers")
    spoken = inside.where(may_be_among(F.col("_term"), speakers.select("_term"))).drop("_most").join(speakers, "_term").drop("_term")
    pairs = spoken.join(classes, "_h").where(bits(F.col("_e_n")) <= max_bits)
    both = pairs.groupBy(*SAME_TEXTS, *[f"_e{c}" for c in SAME_TEXTS]).agg(F.count(F.lit(1)).alias("_both"))
    best = both.where(F.col("_both") >= min_support).groupBy(*SAME_TEXTS).agg(F.max("_both").alias("_both"))
    best = best.select(*SAME_TEXTS, bits(F.col("_both")).alias("bits")).where(F.col("bits") <= max_bits)
    return stage(counted.join(best, SAME_TEXTS).select("_term", "bits"), "terms")


def _term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(_h, _start, _end): where the stored ``terms`` stand in ``texts``; texts without any are not shuffled."""
    def among(rows):
        return rows.where(may_be_among(F.col("_term"), terms)).join(terms, "_term", "left_semi")

    hits = among(texts.select("_h", F.explode(F.array_distinct(_terms(F.col("_text")))).alias("_term")))
    hits = stage(hits.select("_h").distinct(), "term-texts")
    listed = only(texts, hits, "_h").select("_h", matches(F.col("_text"), WORD_TERM).alias("_found"))
    return among(placed(listed, ["_h"], "_found").withColumn("_term", F.lower("_m.value"))).select("_h", "_start", "_end")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT,
               max_bits: float = MAX_BITS) -> DataFrame:
    """Stored rows (_id, _h, _base, _all): arrays of struct(start, rank of the kind, end), in order.

    ``_all`` holds the base spans and the revealing terms outside of them.
    """
    text = whole(F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"))
    none = F.array().cast("array<struct<gap:int,value:string>>")

    def found_in(kind):
        may = F.contains("_text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("_text").rlike("[0-9][ -]?[0-9]")
        return F.when(may, matches(F.col("_text"), PATTERNS[kind])).otherwise(none).alias(kind)

    held = stage(rows.select("_row", "_id", F.xxhash64("_text").alias("_h"), *[found_in(k) for k in KINDS]), "matches")
    by_kind = held.select("_row", "_h", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(KINDS)])).alias("_k")).where(
        F.size("_k.found") > 0).select("_row", "_h", F.col("_k.rank").alias("_rank"), F.col("_k.kind").alias("_kind"), F.col("_k.found").alias("_found"))
    base = placed(by_kind, ["_row", "_h", "_rank", "_kind"], "_found").where(valid(F.col("_kind"), F.col("_m.value")))
    base = stage(base, "base")
    span = F.struct(F.col("_start").cast("int").alias("start"), F.col("_rank").alias("rank"), F.col("_end").cast("int").alias("end"))
    base_of = base.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("_base"))

    repeated = stage(held.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "repeated")
    texts = _once(docs, text_col, repeated)
    terms = revealing_terms(base, texts, min_support, max_bits).select("_term")
    spots = _term_spans(texts, terms).withColumn("_rank", F.lit(len(KINDS)))
    spots = stage(spots.groupBy("_h").agg(F.sort_array(F.collect_list(span)).alias("_spots")), "spots")

    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    whole_rows = held.select("_row", "_id", "_h").join(base_of, "_row", "left").join(spots, "_h", "left").select(
        "_id", "_h", F.coalesce("_base", empty).alias("_base"), F.coalesce("_spots", empty).alias("_spots"))
    outside = F.filter("_spots", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return whole_rows.select("_id", "_h", "_base", F.sort_array(F.concat("_base", outside)).alias("_all"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, TERM]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Offsets are code points, the end exclusive. A null text is the empty text
    without spans. Null and repeated ids go through; equal rows get equal
    results. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    spans = find_spans(docs, id_col, text_col)
    ranks = F.transform("_base", lambda x: x["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return spans.select(F.col("_id").alias(id_col), *counts, F.sha2(span_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("_all")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_terms: bool = False) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, as ``[EMAIL]``.

    Revealing terms become ``[NAME]`` if they begin with a capital letter, else
    ``[TERM]``; ``remove_terms`` removes them. Of overlapping spans the first
    counts. Other columns and null texts are unchanged.
    """
    mark = "_spans_" + "_".join(docs.columns)
    key = F.struct(null_safe(F.col(id_col)).alias("k"), F.xxhash64(whole(F.col(text_col))).alias("h"))
    spans = find_spans(docs, id_col, text_col).where(F.size("_all") > 0).select(
        F.struct(null_safe(F.col("_id")).alias("k"), F.col("_h").alias("h")).alias(mark + "_key"), F.col("_all").alias(mark))
    spans = stage(spans.dropDuplicates([mark + "_key"]), "spans")
    body = F.col(text_col)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def label(x):
        capital = F.substr(body, x["start"] + 1, F.lit(1)).rlike(r"^\p{Lu}")
        term = F.lit("") if remove_terms else F.when(capital, "[NAME]").otherwise("[TERM]")
        return F.when(x["rank"] < len(KINDS), F.get(labels, x["rank"])).otherwise(term)

    cleaned = F.aggregate(F.col(mark), F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), lambda acc, x: F.when(
        x["start"] >= acc["at"], F.struct(F.concat(acc["t"], F.substr(body, acc["at"] + 1, x["start"] - acc["at"]), label(x)).alias("t"), x["end"].alias("at")))
        .otherwise(acc), lambda acc: F.concat(acc["t"], F.substr(body, acc["at"] + 1)))
    joined = docs.withColumn(mark + "_key", key).join(spans, mark + "_key", "left")
    return joined.select(*[F.when(F.col(mark).isNull(), body).otherwise(cleaned).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _run(spark, folder):
    return find_private(table(spark, folder, "documents"))


QUERIES = {"op6_pii": Query(_run)}
