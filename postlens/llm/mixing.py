"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled by a hash and laid on a circle, which is
cut into blocks of equally many words. Slot i of the schedule goes to the source
whose interval of the cumulative weights holds the golden-ratio point
frac(i * 0.618…); the slot's rank among the source's slots names the block.
Prefix sums inside a source run over 4096 hash buckets, so a source with a
third of all rows is never in one task. The driver sees two sums per round of
the target computation and nothing else.
"""

from __future__ import annotations

from decimal import Decimal, getcontext
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.values import let
from postlens.llm.common import WORD, Query, count_words, null_safe, running, stage, table, unused, whole
from postlens.llm.common import words as words_of

BLOCK_WORDS = 1024
MAX_EPOCHS = 3
SEED = "mix"
#: Slots that are ranked together; the ranks of later chunks start behind those of earlier ones.
CHUNK = 1 << 16
#: Hash buckets in a source's shuffled order: the values of this many hex digits.
BUCKET_DIGITS = 3

getcontext().prec = 60
GOLDEN = (Decimal(5).sqrt() - 1) / 2
LOW, HIGH = float(GOLDEN), float(GOLDEN * (1 << 20) % 1)


class Mix(NamedTuple):
    docs: DataFrame      # id, source and its number, size, first word's place in the source's shuffled order
    sources: DataFrame   # per source: number s, source, source_size, target, words, blocks, need
    schedule: DataFrame  # per slot: s, slot, turn (its rank in the source)


def _sources(sized: DataFrame, max_epochs: int) -> DataFrame:
    """Targets by weight 1, 2, 3, …, capped at ``max_epochs`` times the size, the excess shared by weight."""
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("_words"))
    ranked = running(sizes, ["_source"], [])
    weighed = stage(ranked.select(
        F.col("rank").alias("_s"), "_source", "_words", (F.col("rank") % 3 + 1).alias("_weight"),
        (max_epochs * F.col("_words")).cast("decimal(38,0)").alias("_cap")), "sources")
    total = weighed.agg(F.sum("_words")).first()[0] or 0
    share, weights = 0, 0  # a source gets share / weights words for each unit of weight
    while total:
        level = (F.col("_cap") * F.lit(weights) <= F.lit(Decimal(share)).cast("decimal(38,0)") * F.col("_weight")) if weights else F.lit(False)
        capped, free = weighed.agg(F.sum(F.when(level, F.col("_cap"))), F.sum(F.when(~level, F.col("_weight")))).first()
        found = (int(total - (capped or 0)), int(free or 0))
        if not found[1] or found == (share, weights):
            break
        share, weights = found
    if not weights:
        goal, taken = F.lit(0.0), F.lit(0)
    else:
        even = F.lit(Decimal(share)).cast("decimal(38,0)") * F.col("_weight")
        full = F.col("_cap") * F.lit(weights) <= even
        goal = F.when(full, F.col("_cap").cast("double")).otherwise(even.cast("double") / F.lit(float(weights)))
        taken = F.when(full, F.col("_cap").cast("long")).otherwise(F.floor(even / F.lit(weights)).cast("long"))
    return weighed.select("_s", "_source", "_words", goal.alias("_target"), taken.cast("long").alias("_take"))


def _slots(sources: DataFrame) -> DataFrame:
    """The schedule: (slot, _s, turn) with exactly ``_need`` slots for each source."""
    placed = stage(running(sources.where("_need > 0").select("_s", "_need"), ["_s"], ["_need"]), "intervals")
    total, kinds = placed.agg(F.sum("_need"), F.count(F.lit(1))).first()
    total = total or 0
    cells = 1 << max(6, (4 * kinds).bit_length())
    low = F.col("before__need") / F.lit(float(max(total, 1)))
    high = (F.col("before__need") + F.col("_need")) / F.lit(float(max(total, 1)))
    # An interval is listed under every cell of an even grid that it touches; points look it up by their cell.
    intervals = placed.select("_s", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(
        F.floor(low * cells), F.floor(high * cells))).alias("_cell"))
    number = F.col("id") + 1
    point = F.pmod(F.pmod((number / F.lit(1 << 20)).cast("long") * F.lit(HIGH), F.lit(1.0)) + (number % (1 << 20)) * F.lit(LOW), F.lit(1.0))
    points = sources.sparkSession.range(total).select("id", point.alias("_x")).select("*", F.floor(F.col("_x") * cells).alias("_cell"))
    hit = points.join(intervals, "_cell").where("_low <= _x and _x < _high").select("id", "_s", F.floor(F.col("id") / CHUNK).alias("_chunk"))
    hit = stage(hit, "slots")
    sums = hit.groupBy("_s", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_s", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), "_n")
    place = F.row_number().over(Window.partitionBy("_s", "_chunk").orderBy("id")) - 1
    ranked = hit.select("id", "_s", "_chunk", place.alias("_place")).join(sums.drop("_n"), ["_s", "_chunk"])
    need = sources.select("_s", "_need")
    regular = ranked.join(need, "_s").select("_s", F.col("id").alias("slot"), (F.col("_place") + F.col("_before")).alias("turn"), "_need")
    # The points miss a source's exact share by a few slots: late ones are left out, missing ones follow at the end.
    got = hit.groupBy("_s").agg(F.count(F.lit(1)).alias("_got"))
    short = need.join(got, "_s", "left").select("_s", F.coalesce("_got", F.lit(0)).alias("_got"), "_need").where("_got < _need")
    extra = short.select("_s", F.explode(F.sequence("_got", F.col("_need") - 1)).alias("turn")).select(
        "_s", (F.lit(total) + F.col("turn")).alias("slot"), "turn")
    return regular.where("turn < _need").select("_s", "slot", "turn").unionByName(extra)


def _order(row_id: Column, seed: str = SEED) -> Column:
    """What a source's documents are shuffled by."""
    return F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":" + seed)))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> Mix:
    """Lay out the documents, the targets and the schedule (see ``Mix``), all from stored tables; see ``lay_out`` for nulls and ties."""
    laid, sources = lay_out(docs, id_col, text_col, source_col, block_words, max_epochs, seed)
    return Mix(laid, sources, _slots(sources))


def lay_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents in the shuffled order of their sources, and the sources with their targets.

    The result depends on the rows only, not on their partitions or order. A
    null text has no words; a null source is a source of its own and comes
    last. Sources without words have target 0. Rows that repeat an id are
    separate documents.
    """
    sized = stage(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), count_words(whole(F.col(text_col))).alias("_size"),
        _order(F.col(id_col), seed).alias("_hash")), "sizes")
    rates = _sources(sized, max_epochs)
    words, take, block = F.col("_words"), F.col("_take"), F.lit(block_words)
    blocks = F.ceil(words / block)
    rest = F.when(words > 0, take % words).otherwise(0)
    sources = stage(rates.select("*", blocks.cast("long").alias("_blocks"), F.when(words > 0, F.floor(take / words) * blocks + F.ceil(rest / block))
                                 .otherwise(0).cast("long").alias("_need")), "targets")
    bucket = F.substring("_hash", 1, BUCKET_DIGITS).alias("_bucket")
    local = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.select("_id", "_source", "_size", "_hash", bucket).select(
        "_id", "_source", "_size", "_bucket", F.coalesce(F.sum("_size").over(local), F.lit(0)).alias("_own"))
    sums = sized.groupBy("_source", bucket).agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    sums = sums.join(sources, sums["_source"].eqNullSafe(sources["_source"])).drop(sources["_source"])
    sums = stage(sums.select(F.col("_source").alias("_of"), F.col("_bucket").alias("_in"), "_before", "_s", "_words", "_target", "_take", "_blocks"), "buckets")
    laid = placed.join(sums, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in"))).select(
        "_id", "_source", "_s", "_size", (F.col("_before") + F.col("_own")).alias("_start"), "_words", "_target", "_take", "_blocks")
    return stage(laid, "laid"), sources


def taken_pieces(mix: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes: (slot, _s, _start, epoch, first, words), ``first`` counted from the document's first word.

    ``_start`` names the document. Sort by slot and ``_start`` to read the mix.
    Blocks hold ``block_words`` words at most, so a key of this join does too.
    """
    block = F.lit(block_words)
    docs = mix.docs.where("_size > 0").select("_s", "_start", "_size", "_words", "_take", "_blocks", F.explode(F.sequence(
        F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_size") - 1) / block))).alias("_block"))
    slots = mix.schedule.join(mix.sources.select("_s", "_blocks"), "_s").select(
        "_s", "slot", (F.col("turn") % F.col("_blocks")).alias("_block"), F.floor(F.col("turn") / F.col("_blocks")).alias("epoch"))
    first = F.greatest(F.col("_start"), F.col("_block") * block)
    last = F.least(F.col("_start") + F.col("_size"), (F.col("_block") + 1) * block, F.col("_take") - F.col("epoch") * F.col("_words"))
    return docs.join(slots, ["_s", "_block"]).where(last > first).select(
        "slot", "_s", "_start", "epoch", (first - F.col("_start")).alias("first"), (last - first).alias("words"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    ``taken`` counts the document's words in the mix with repeats. A document
    without words has 0; an empty table gives an empty result. Other columns are
    ignored, whatever their names. See ``lay_out`` for nulls and ties.
    """
    mixed = _mixed(plan_mix(docs, id_col, text_col, source_col, block_words, max_epochs, seed), block_words)
    return mixed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_words").alias("source_size"),
                        F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def _mixed(mix: Mix, block_words: int) -> DataFrame:
    """The documents of ``mix`` with the words that the schedule takes of each."""
    taken = taken_pieces(mix, block_words).groupBy("_s", "_start").agg(F.sum("words").alias("_taken"))
    filled = mix.docs.where("_size > 0").join(taken, ["_s", "_start"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
    return filled.unionByName(mix.docs.where("_size = 0").withColumn("_taken", F.lit(0).cast("long")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, with the gaps as they are."""
    return let(words_of(text), lambda found: let(F.split(text, WORD, -1), lambda gaps: F.array_join(
        F.transform(F.slice(found, F.lit(1), n.cast("int")), lambda w, i: F.concat(F.get(gaps, i), w)), "")))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, columns as they are but for one cut text a source.

    In the shuffled order of its source, every document is taken the same number
    of times, and those before a cut once more; the document at the cut comes
    that last time as a piece, its text up to the last word taken. So the words
    of a source are its target, rounded down. Rows that share id and size with
    the document at the cut are each cut to an equal part. Documents without
    words are not in a mix; an empty table gives an empty result.

    A row finds its number of copies from its own place in the order and the cut
    of its source. The rows are dealt out by the schedule: each copy stands at
    the slot that takes the block of its first word, in the order of that block.
    So each stretch of the result mixes all sources by their weights.
    """
    mix = plan_mix(docs, id_col, text_col, source_col)
    laid, sources = mix.docs, mix.sources
    rest = F.col("_take") % F.col("_words")
    tied = laid.where("_size > 0").groupBy("_s", "_id", "_size").agg(F.min("_start").alias("_first"), F.count(F.lit(1)).alias("_ties"))
    rated = sources.where("_take > 0").select("_s", "_source", "_words", "_take", rest.alias("_rest"), F.floor(F.col("_take") / F.col("_words")).alias("_full"))
    at_cut = tied.join(rated.select("_s", "_rest"), "_s").where("_first <= _rest and _rest < _first + _size * _ties").select(
        "_s", F.struct(_order(F.col("_id")).alias("h"), F.col("_id").alias("id"), F.col("_size").alias("size")).alias("_cut"),
        F.floor((F.col("_rest") - F.col("_first")) / F.col("_ties")).alias("_cut_words"))
    cuts = stage(rated.join(at_cut, "_s", "left").select(null_safe(F.col("_source")).alias("_from"), "_words", "_take", "_rest", "_full", "_cut", "_cut_words"),
                 "cuts")
    placed = stage(_slots_of(tied, mix), "placed")
    names = [unused(docs, n) for n in ("_from", "_words", "_take", "_rest", "_full", "_cut", "_cut_words", "_key", "_size", "_slots", "_first", "_copy", "_slot")]
    source, _, _, left, full, cut, cut_words, key, size, slots, first, copy, slot = names
    text, h = whole(F.col(text_col)), _order(F.col(id_col))
    sized = docs.withColumns({source: null_safe(F.col(source_col)), key: null_safe(F.col(id_col)), size: count_words(text)}).where(F.col(size) > 0)
    # Narrow rows, one to an id and size of a source, tell the slots.
    known = sized.join(cuts.toDF(*names[:7]), source).join(placed.toDF(source, key, size, slots, first), [source, key, size])
    own = F.struct(h.alias("h"), F.col(id_col).alias("id"), F.col(size).alias("size"))
    more = F.when(F.col(left) == 0, 0).when(own < F.col(cut), 1).when((own == F.col(cut)) & (F.col(cut_words) > 0), 2).otherwise(0)
    # Copies 0 … full - 1 are whole; one more is whole before the cut, and a piece at it.
    taken = known.withColumn(copy, F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.col(full).cast("int")), lambda i: F.struct(
        i.alias("i"), F.when(i < F.col(full), 1).otherwise(more).alias("kind"))), lambda c: c["kind"] > 0)))
    dealt = taken.withColumn(slot, F.get(F.col(slots), F.col(copy)["i"]))
    cut_text = F.when(F.col(copy)["kind"] == 2, first_words(text, F.col(cut_words))).otherwise(F.col(text_col))
    # The columns that joined may share names with no column of docs.
    pieces = dealt.withColumn(text_col, cut_text)
    return pieces.repartitionByRange(slot, first, id_col).sortWithinPartitions(slot, first, id_col).select(*docs.columns)


def _slots_of(tied: DataFrame, mix: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, id, size, slots, first) of ``tied`` documents, keys null-safe: by copy, the slot of the block that holds the first word."""
    block, words, blocks = F.lit(block_words), F.col("_words"), F.col("_blocks")
    rates = mix.sources.where("_take > 0").select("_s", "_source", "_words", "_take", "_blocks")
    # As many copies as passes over the source begin before its words are taken.
    copies = tied.join(rates, "_s").select(
        "_s", "_source", "_id", "_size", "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_take") / words))).alias("_epoch"), (
            F.floor(F.col("_first") / block)).alias("_block"), "_blocks").select("*", (F.col("_epoch") * blocks + F.col("_block")).alias("turn"))
    met = copies.join(mix.schedule, ["_s", "turn"])
    # At most one slot for each of the copies, of which there are few.
    return met.groupBy("_source", "_id", "_size").agg(F.sort_array(F.collect_list("slot")).alias("_slots"), F.min("_first").alias("_first")).select(
        null_safe(F.col("_source")).alias("_source"), null_safe(F.col("_id")).alias("_id"), "_size", "_slots", "_first")


def _run(spark, folder):
    return mix_documents(table(spark, folder, "documents"))


_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS h FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY n * 1.0 / w, w, source) AS k,
         sum({MAX_EPOCHS} * n) OVER q AS cap_sum, sum(w) OVER q AS w_sum, sum(n) OVER () AS total, sum(w) OVER () AS w_all
  FROM s WINDOW q AS (ORDER BY n * 1.0 / w, w, source ROWS UNBOUNDED PRECEDING)),
level AS (  -- the first k sources are capped when they lie below the level that the others then reach
  SELECT (total - cap_sum + {MAX_EPOCHS} * n)::HUGEINT AS share, (w_all - w_sum + w)::HUGEINT AS weights
  FROM o WHERE {MAX_EPOCHS} * n * (w_all - w_sum + w) > (total - cap_sum + {MAX_EPOCHS} * n) * w ORDER BY k LIMIT 1),
t AS (
  SELECT source, n, CASE WHEN {MAX_EPOCHS} * n * weights <= share * w THEN ({MAX_EPOCHS} * n)::DOUBLE ELSE (share * w)::DOUBLE / weights::DOUBLE END AS target,
         CASE WHEN {MAX_EPOCHS} * n * weights <= share * w THEN {MAX_EPOCHS} * n ELSE (share * w) // weights END AS take
  FROM s CROSS JOIN level),
p AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (CASE WHEN n = 0 THEN 0 ELSE (take // n) * size + greatest(0, least(start + size, take % n) - start) END)::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""

QUERIES = {"op4_mixing_sources": Query(_run, _SQL)}
