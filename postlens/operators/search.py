"""Finding topics: resolution of a name, prefix suggestions, keyword search, id lists."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import links
from postlens.functions import text as tx
from postlens.operators.ranking import rank_within, top_k
from postlens.operators.rows import unnest
from postlens.session import materialize

#: Topics in a block of an index, and characters by which beginnings shrink in one step.
BLOCK, STRIDE = 256, 8


def _match_key(col: Column) -> Column:
    return tx.strip(F.lower(col))


def title_words(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_match_key(col), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


class TopicIndex(NamedTuple):
    """Inverted index of topic titles.

    ``words``: (word, df, blocks). ``blocks``: (word, block, most, postings), the
    topics of a word by entry count, then id, at most ``BLOCK`` to a block, whose
    largest count is ``most``; a posting is (entry_count, id, title, slug, words).
    """

    words: DataFrame
    blocks: DataFrame


def index_topics(topics: DataFrame, block: int = BLOCK) -> TopicIndex:
    """Index ``topics(id, title, slug, entry_count)``, stored once in the shared folder.

    Postings are ranked by a range sort, so the topics of a frequent word fill
    many blocks in many tasks; no list grows with a word.
    """
    listed = topics.select("id", "title", "slug", "entry_count", title_words(F.col("title")).alias("words")).withColumn("word", F.explode("words"))
    ranked = rank_within(listed, ["word"], [F.col("entry_count").desc(), F.col("id")], "rank", "df")
    cut = ranked.withColumn("block", F.floor((F.col("rank") - 1) / block).cast("long"))
    posting = F.struct("rank", F.struct("entry_count", "id", "title", "slug", "words").alias("p"))
    blocks = materialize(cut.groupBy("word", "block").agg(
        F.first("df").alias("df"), F.max("entry_count").alias("most"), F.sort_array(F.collect_list(posting)).alias("o")).select(
        "word", "block", "df", "most", F.transform("o", lambda x: x["p"]).alias("postings")), "topic-index")
    words = materialize(blocks.where("block = 0").select("word", "df", F.ceil(F.col("df") / block).alias("blocks")), "topic-words")
    return TopicIndex(words, blocks.drop("df"))


def _lookups(queries: DataFrame, index: TopicIndex) -> DataFrame:
    """``(query, words, word, blocks)`` of the queries whose words are all known; ``word`` is the rarest."""
    wanted = queries.select("query").distinct().withColumn("words", title_words(F.col("query"))).where(F.size("words") > 0)
    asked = wanted.select("query", "words", F.explode("words").alias("word")).join(index.words, "word", "left")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "blocks"))
    return asked.groupBy("query").agg(F.first("words").alias("words"), rarest.alias("r")).where("r.df > 0").select(
        "query", "words", "r.word", "r.blocks")


def _found(lookups: DataFrame, index: TopicIndex, first: Column, last: Column, k: int) -> DataFrame:
    """``(query, n, best)`` per block from ``first`` to before ``last``: its hits and the first ``k`` of them."""
    within = lookups.withColumn("block", F.explode(F.when(last > first, F.sequence(first, last - 1))))
    hits = within.join(index.blocks, ["word", "block"]).withColumn(
        "hits", F.filter("postings", lambda p: F.size(F.array_except("words", p["words"])) == 0))
    return hits.where(F.size("hits") > 0).select("query", "block", F.size("hits").cast("long").alias("n"), F.slice("hits", 1, k).alias("best"))


_TOPIC = ["id", "title", "slug", "entry_count"]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rows = unnest(found, ["query"], "best", "p").select("query", *[f"p.{c}" for c in _TOPIC])
    return top_k(rows, ["query"], [F.col("entry_count").desc(), F.col("id")], k)


def search_topics(queries: DataFrame, topics: DataFrame | TopicIndex, k: int = 50) -> DataFrame:
    """Topics whose title holds every word of the query: the first ``k`` by entry count.

    ``queries(query)`` and an index, or ``topics`` to be indexed, give ``(query,
    rank, id, title, slug, entry_count, thread_count)``. A query looks up its
    rarest word, whose blocks are separate rows: a word found in a third of all
    titles is read by many tasks. A query of one word reads only the blocks of
    its first ``k`` topics, for the index knows how many there are.
    """
    index = topics if isinstance(topics, TopicIndex) else index_topics(topics)
    lookups = _lookups(queries, index)
    alone = F.size("words") == 1
    enough = F.least("blocks", F.when(alone, F.lit(-(-k // BLOCK) + 1)).otherwise(F.col("blocks")))
    found = materialize(_found(lookups, index, F.lit(0), enough, k), "hits")
    counts = found.groupBy("query").agg(F.sum("n").alias("n"))
    single = lookups.where(alone).join(index.words.select("word", "df"), "word").select("query", "df")
    totals = counts.join(single, "query", "left").select("query", F.coalesce("df", "n").alias("thread_count"))
    return _ranked(found, k).join(totals, "query").select("query", "rank", "id", "title", "slug", "entry_count", "thread_count")


def first_topics(queries: DataFrame, index: TopicIndex, k: int = 1) -> DataFrame:
    """``search_topics`` without the counts: blocks are read best first, and only for queries that still lack hits."""
    waiting, results, first, size = materialize(_lookups(queries, index), "lookups"), None, 0, 1
    while not waiting.isEmpty():
        found = materialize(_found(waiting, index, F.lit(first), F.least("blocks", F.lit(first + size)), k), "hits")
        results = found if results is None else results.unionByName(found)
        full = results.groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
        first, size = first + size, 4 * size
        waiting = materialize(waiting.where(F.col("blocks") > first).join(full, "query", "left_anti"), "lookups")
    if results is None:
        results = _found(waiting, index, F.lit(0), F.lit(0), k)
    return _ranked(results, k)


def resolve_topic(queries: DataFrame, topics: DataFrame, index: TopicIndex | None = None) -> DataFrame:
    """The one topic a typed name stands for.

    Adds ``tier``, ``id`` and ``path`` to the distinct queries:
    ``direct`` (already a slug with an id), ``exact`` (title, or slugified
    title), ``starts_with`` (title begins with the query and a space),
    ``as_typed`` (one word without a match), ``first_result`` (best keyword
    match) and ``not_found``.

    Every title is a row of one key table under itself, its slug and each of its
    beginnings that end before a space; the table keeps the best topic per key,
    a whole title before a beginning.
    """
    asked = queries.select("query").distinct().withColumn("_q", _match_key(F.col("query")))
    keyed = topics.select("id", "title", "slug", "entry_count", _match_key(F.col("title")).alias("_t"))
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1))), lambda i: F.substr(F.col("_t"), i, F.lit(1)) == " ")
    heads = F.transform(cuts, lambda i: F.struct(F.lit(1).alias("tier"), F.substr(F.col("_t"), F.lit(1), i - 1).alias("q")))
    names = F.transform(F.array_distinct(F.array("_t", links.slugify(F.col("title")))), lambda n: F.struct(F.lit(0).alias("tier"), n.alias("q")))
    best = F.min(F.struct(F.col("k.tier").alias("tier"), (-F.col("entry_count")).alias("neg"), "id", "slug"))
    keys = keyed.select("id", "slug", "entry_count", F.explode(F.concat(names, heads)).alias("k")).groupBy(F.col("k.q").alias("_q")).agg(best.alias("_key"))
    single, direct = F.size(F.split("_q", r"\s+")) == 1, F.col("query").contains("--")
    matched = materialize(asked.join(keys, "_q", "left"), "matched")
    unmatched = matched.where(~direct & F.col("_key").isNull() & ~single).select("query")
    found = first_topics(unmatched, index or index_topics(topics), 1).select("query", F.struct("id", "slug").alias("_found"))
    tier = (F.when(direct, "direct").when(F.col("_key.tier") == 0, "exact")
            .when(F.col("_key.tier") == 1, "starts_with").when(single, "as_typed")
            .when(F.col("_found").isNotNull(), "first_result").otherwise("not_found"))
    match = F.when(F.col("_key").isNotNull(), F.struct("_key.id", "_key.slug")).otherwise(F.col("_found"))
    return (matched.join(found, "query", "left").withColumn("tier", tier).select(
        "query", "tier",
        F.when(direct, links.id_from_slug(F.col("query")))
        .when(F.col("tier") != "as_typed", match["id"]).alias("id"),
        F.when(direct, F.col("query")).when(F.col("tier") == "as_typed", F.col("_q"))
        .otherwise(F.regexp_replace(match["slug"], "^/", "")).alias("path")))


def index_suggestions(titles: DataFrame, nicks: DataFrame, k: int = 8, longest: int | None = None) -> DataFrame:
    """``(kind, prefix, rank, text)``: the ``k`` heaviest texts under every beginning of two characters or more, stored.

    Built from long beginnings to short ones: a beginning's best are among the
    best of those ``STRIDE`` characters longer and the texts that end in between,
    so a text goes on only as long as it is among the best somewhere. ``longest``
    bounds the beginnings, by default to the longest text.
    """
    texts = (titles.select(F.lit("title").alias("kind"), "text", "weight")
             .unionByName(nicks.select(F.lit("nick").alias("kind"), "text", "weight"))
             .groupBy("kind", "text").agg(F.max("weight").alias("weight"))
             .withColumn("_t", _match_key(F.col("text"))).withColumn("_n", F.length("_t")).where(F.col("_n") >= 2))
    texts = materialize(texts, "texts")
    top = texts.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    high, above, nodes = min(top, longest) if longest else top, None, None
    row = ["kind", "text", "weight", "_t", "_n"]
    while high >= 2:
        low = max(2, high - STRIDE + 1)
        fresh = texts.where(F.col("_n") >= low) if above is None else texts.where(F.col("_n").between(low, high)).unionByName(above)
        heads = fresh.select(*row, F.explode(F.sequence(F.lit(low), F.least("_n", F.lit(high)))).alias("_l")).withColumn("prefix", F.left("_t", F.col("_l")))
        best = materialize(top_k(heads, ["kind", "prefix"], [F.col("weight").desc(), F.col("text")], k), "prefixes")
        nodes = best if nodes is None else nodes.unionByName(best)
        above = best.where(F.col("_l") == low).select(*row)
        high = low - 1
    if nodes is None:
        nodes = texts.select("*", F.col("_t").alias("prefix"), F.lit(0).alias("rank"))
    return nodes.select("kind", "prefix", "rank", "text")


def suggest(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``(query, kind, rank, text)``: every query of two characters or more looks up the node of its text."""
    asked = queries.select("query").distinct().withColumn("prefix", _match_key(F.col("query"))).where(F.length("prefix") >= 2)
    return asked.join(index, "prefix").select("query", "kind", "rank", "text")


def autocomplete(queries: DataFrame, titles: DataFrame, nicks: DataFrame, k: int = 8) -> DataFrame:
    """Titles and nicks that begin with the typed text: ``(query, kind, rank, text)``.

    ``titles(text, weight)`` and ``nicks(text, weight)``; heavier texts come first.
    For many calls, keep the result of ``index_suggestions`` and use ``suggest``.
    """
    longest = queries.agg(F.max(F.length(_match_key(F.col("query"))))).first()[0]
    return suggest(queries, index_suggestions(titles, nicks, k, max(longest or 0, 2)))


def daily_entries(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Full entries for a list ``(pos, id)``, in list order."""
    return ids.select("pos", "id").join(entries, "id").orderBy("pos")


def attach_analysis(entries: DataFrame, analysis: DataFrame, key: str = "id") -> DataFrame:
    """Each entry with its analysis, matched by id; entries without one stay."""
    return entries.join(analysis, key, "left")


def resume(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows that have no result yet."""
    return rows.join(done.select(key), key, "left_anti")
