"""Quality rules: repetition and symbol counts of a document, and lines that recur across documents.

Plan: one scan turns every text into a narrow stored row (counts, and a 64-bit
hash with the number of words of each line). Lines are then counted per host
with map-side combining; the few common lines are joined back to the stored
rows. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.values import let
from postlens.llm.common import GAP, LOWER, UPPER, WORD_GAP, Query, lower_ascii, null_safe, stage, table, unused, whole, without, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is common on a host when more than so many different documents hold it.
MAX_DOCS_PER_LINE = 30
#: A document is depleted when fewer words, or a smaller share of its words, are left without common lines.
MIN_WORDS_LEFT = 20
MIN_PERCENT_LEFT = 20


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows of ``size`` words that occur twice or more in ``tokens``."""
    def windows(hashes):
        return F.when(F.size(hashes) >= size, F.transform(
            F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(found):
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, k: F.coalesce(
            (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]),
            F.get(p, k - 1)["h"] == x["h"], F.get(p, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(starts, zero, lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(size), at - acc["last"])).alias("n"), at.alias("last")), lambda acc: acc["n"])

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda found: F.when(
        F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(0)))


def normal_line(line: Column) -> Column:
    """A line in lower case (A-Z), its words separated by one blank."""
    return F.trim(F.regexp_replace(lower_ascii(line), GAP, " "))


def line_hash(normal: Column) -> Column:
    """The first 64 bits of the MD5 of a normalised line."""
    return F.substring(F.unhex(F.md5(normal)), 1, 8)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Narrow stored rows: one per row of ``docs``, with its counts, the hash of its text and its lines' hashes."""
    text = whole(F.col(text_col))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), null_safe(F.col(host_col)).alias("_host"),
        text.alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: _removed(line, WORD_GAP) != "")

    def line_facts(found):
        return F.struct(
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dups"),
            F.transform(found, lambda line: let(normal_line(line), lambda n: F.struct(
                line_hash(n).alias("h"),
                (F.length(n) - F.length(F.translate(n, " ", "")) + 1).cast("long").alias("n")))).alias("lines"))

    facts = rows.select(
        "_row", "_id", "_host", F.xxhash64("_text").alias("_text_hash"), F.length(_removed(F.col("_text"), WORD_GAP)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_removed(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(words(F.col("_text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("repeat"))).alias("_words"),
        let(lines, line_facts).alias("_lines"))
    return stage(facts.select(
        "_row", "_id", "_host", "_text_hash", F.col("_words.n_words"), "word_chars", "n_symbols", F.col("_lines.dups").alias("n_dup_lines"),
        F.col("_words.repeat").alias("n_repeat_words"), F.col("_lines.lines").alias("_lines")), "measures")


def common_lines(facts: DataFrame, max_docs: int = MAX_DOCS_PER_LINE) -> DataFrame:
    """Lines (host, hash) held by more than ``max_docs`` different documents of a host.

    Exact copies are one document, told apart by the hash of the whole text, so
    that a document copied many times does not make its lines common.
    """
    held = facts.select("_host", "_text_hash", F.explode_outer(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_line"))
    once = held.where(F.col("_line").isNotNull()).distinct()
    counts = once.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"))
    return stage(counts.where(F.col("_docs") > max_docs).select("_host", "_line"), "common-lines")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_docs: int = MAX_DOCS_PER_LINE) -> DataFrame:
    """One row per row of ``docs``: id, the counts, words_left, base_failed, kept.

    A null text or a text without words has no words and fails. A null host is
    a host of its own. Rows that repeat an id are judged one by one; equal rows
    get equal verdicts. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    facts = measure(docs, id_col, text_col, host_col)
    common = common_lines(facts, max_docs)
    held = facts.select("_row", "_host", F.explode_outer("_lines").alias("_x")).where("_x is not null").select(
        "_row", "_host", F.col("_x.h").alias("_line"), F.col("_x.n").alias("_n"))
    lost = stage(held.join(common, ["_host", "_line"], "left_semi").groupBy("_row").agg(F.sum("_n").alias("_lost")), "lost")
    judged = facts.drop("_lines").join(lost, "_row", "left")
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("_lost").isNotNull() & ((left < MIN_WORDS_LEFT) | (100 * left < MIN_PERCENT_LEFT * F.col("n_words")))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        left.alias("words_left"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without the rejected rows, all columns unchanged.

    Rows are matched by id, host and hash of the text, so repeated ids are safe.
    """
    text, name = whole(F.col(text_col)), unused(docs, "_record")
    named = docs.select("*", F.struct(null_safe(F.col(id_col)).alias("i"), null_safe(F.col(host_col)).alias("h"),
                                      F.md5(text.cast("binary")).alias("t")).alias(name))
    marks = judge(named.select(F.col(name).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_from")),
                  "_id", "_text", "_from")
    gone = stage(marks.where("not kept").select(F.col("_id").alias(name)).distinct(), "rejected")
    return without(named, gone, name).drop(name)


def strip_lines(docs: DataFrame, common: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with the ``common`` lines (see ``common_lines``) taken out of each text; a null text stays null."""
    row, gone = unused(docs, "_row"), unused(docs, "_gone")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    lines = numbered.select(F.col(row).alias("_r"), null_safe(F.col(host_col)).alias("_host"), F.explode_outer(
        F.split(text_col, "\n", -1)).alias("_text")).where("_text is not null")
    found = lines.withColumn("_line", line_hash(normal_line(F.col("_text"))))
    hits = found.join(common, ["_host", "_line"], "left_semi").groupBy(F.col("_r").alias(row)).agg(F.collect_set("_text").alias(gone))
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda line: ~F.array_contains(gone, line)), "\n")
    cleaned = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    return numbered.join(hits, row, "left").withColumn(text_col, cleaned).drop(row, gone)


def _run(spark, folder):
    return judge(table(spark, folder, "documents")).drop("words_left")


_GAP = r"[\x20\x09-\x0D]+"
_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS host,
         coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '{_GAP}'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT r, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice) GROUP BY r),
l AS (
  SELECT r, host, line, trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '{_GAP}', ' ', 'g')) AS norm
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
h AS (
  SELECT r, host, line, left(md5(norm), 16) AS h, len(string_split(norm, ' ')) AS n FROM l),
common AS (
  SELECT host, h FROM (SELECT DISTINCT h.host, h, text FROM h JOIN d ON h.r = d.r) GROUP BY host, h HAVING count(*) > {MAX_DOCS_PER_LINE}),
per AS (
  SELECT h.r, count(*) - count(DISTINCT line) AS dups, coalesce(sum(n) FILTER (common.h IS NOT NULL), 0) AS lost
  FROM h LEFT JOIN common ON h.host = common.host AND h.h = common.h GROUP BY h.r),
facts AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '{_GAP}', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ws) - coalesce(lost, 0) AS words_left, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN per ON w.r = per.r LEFT JOIN rep ON w.r = rep.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
       AND NOT (lost > 0 AND (words_left < {MIN_WORDS_LEFT} OR 100 * words_left < {MIN_PERCENT_LEFT} * n_words)) AS kept
FROM facts"""

QUERIES = {"op10_quality_rules": Query(_run, _SQL)}
