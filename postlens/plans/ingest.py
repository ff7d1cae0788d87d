"""Queries on page parsing, payloads and dumps.

The supplied tables hold no topic pages, profiles or dumps, so Spark first
renders the supplied conversations and events in those formats; the extraction
must then give back what went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import summary
from postlens.plans import common as c
from postlens.plans.common import BASE_URL, Query, table
from postlens.session import scratch_path
from postlens.sources import pages, posts


def page_links(spark, folder):
    return pages.extract_threads(table(spark, folder, "pages"), ["page_id"], container="nav").select("page_id", "title", "slug")


def _item(number, name, count):
    """One line of a topic list."""
    return F.concat(F.lit('<li><a href="/'), name, F.lit("--"), number, F.lit('?a=popular"> '), name, F.lit(" <small>"), count,
                    F.lit("</small></a></li>"))


def _listing(spark, folder):
    """One topic list per small-text event: its user is the topic, its counter the size."""
    events = c.dealt(table(spark, folder, "events").select("event_id", "user_id", "event_type", "props"), "event_id")
    line = _item(F.col("user_id"), F.col("event_type"), F.get_json_object("props", "$.k"))
    return events.select("event_id", F.concat(
        F.lit('<div id="content-body"><p class="topic-list-description"> '), F.col("user_id"), F.lit(' başlık </p><ul class="topic-list partial">'),
        line, F.lit('<li><a href="/pena--31782">pena</a></ul></div><ul><li><a href="/no">no</a></li></ul>')).alias("html"))


def listed_threads(spark, folder):
    return pages.extract_threads(_listing(spark, folder), ["event_id"])


def search_pages(spark, folder):
    return pages.extract_search(_listing(spark, folder), BASE_URL, ["event_id"])


def _entry_html():
    """A turn of a conversation as an entry of a topic page; system turns have no author."""
    author = F.when(F.col("role") != "system", F.concat(F.lit('<a class="entry-author" href="/biri/x">'), "role", F.lit("</a>"))).otherwise("")
    return F.concat(
        F.lit('<li data-id="'), "turn", F.lit('" data-author="'), "role", F.lit('" data-author-id="'), "conv_id",
        F.lit('" data-favorite-count="'), F.length("text"), F.lit('"><div class="content"> '), "text",
        F.lit('<br>&amp; son </div><footer>'), author, F.lit('<a class="entry-date permalink">28.01.2021 03:49 ~ 03:'),
        F.lpad((F.col("turn") + 50).cast("string"), 2, "0"), F.lit("</a></footer></li>"))


def _topic_pages(spark, folder):
    talks = table(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    html = F.concat(
        F.lit('<h1 id="title" data-title="konu '), conv, F.lit('" data-id="'), conv, F.lit('" data-slug="konu">x</h1>'),
        F.when(turn > 0, F.concat(F.lit('<div class="pager" data-pagecount="9" data-currentpage="'), turn, F.lit('"></div>'))).otherwise(""),
        F.lit('<div id="hidden-channels"> '), F.when(turn > 1, F.concat(F.lit("spor,"), "role")).otherwise(""), F.lit(" </div>"),
        F.lit('<div id="disambiguations"><ul><li><a href="/a--1">konu a</a> (film)</li><li><a href="/b--2">konu b</a></li></ul></div>'),
        F.lit('<ul id="entry-item-list">'), _entry_html(), F.lit('<li data-id="">boş</li></ul>'))
    return talks.select("conv_id", "turn", F.length("text").alias("n"), "role", html.alias("html"))


def topic_entries(spark, folder):
    return pages.extract_entries(_topic_pages(spark, folder), ["conv_id", "turn"]).drop("pos")


def topic_headers(spark, folder):
    found = pages.extract_topics(_topic_pages(spark, folder), ["conv_id", "turn"])
    return found.withColumns({x: F.array_join(x, "|") for x in ("tags", "disambiguation_titles", "disambiguation_links")})


def single_entries(spark, folder):
    return pages.extract_entry(_topic_pages(spark, folder), ["conv_id", "turn"], "turn")


def user_profiles(spark, folder):
    people = c.dealt(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")
    key, money = F.col("c_custkey"), F.col("c_nationkey")
    html = F.concat(
        F.lit('<h1 id="user-profile-title" data-nick="'), "c_name", F.lit('">x</h1><div id="quote-entry"><h2><a>'), "c_mktsegment",
        F.lit("</a></h2><div><p>söz <b>"), key, F.lit('</b></p></div><footer><a href="/entry/'), key, F.lit('">dün</a></footer></div>'),
        F.lit('<span id="entry-count-total"> '), key, F.lit(' </span><span id="entry-count-lastmonth">'), money,
        F.lit('</span><span id="entry-count-lastweek">2</span><span id="entry-count-today">0</span><i id="last-entry-time"> evvelsi gün </i>'))
    return pages.extract_user(people.select("c_custkey", html.alias("html")), ["c_custkey"])


def user_timelines(spark, folder):
    talks = table(spark, folder, "conversations")
    item = [F.lit('<div class="topic-item"><h1><a href="/konu--'), "conv_id", F.lit('">konu '), "conv_id",
            F.lit('</a></h1><ul><li><div class="content">'), "text",
            F.lit('</div><footer><a class="permalink">28.01.2021</a></footer></li></ul></div>')]
    html = F.concat(*item, F.lit('<div class="topic-item"><h1><a href="/son--1">son</a></h1><ul><li><div class="content">x</div></li></ul></div>'))
    return pages.extract_user_entries(talks.select("conv_id", "turn", html.alias("html")), BASE_URL, ["conv_id", "turn"])


def normalize_payload(spark, folder):
    talks = table(spark, folder, "conversations")
    # Texts that look like JSON are texts; numbers, nulls and lists are no entries.
    texts = F.to_json(F.array(F.concat(F.lit("{merhaba} "), "text"), F.concat(F.lit("[1] "), "text"), F.col("text")))
    text = F.concat(F.left(texts, F.length(texts) - 1), F.lit(',5,null,["x"]]'))
    named = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("nick"), F.col("turn").alias("favCount"),
                               F.col("turn").alias("entryId")))
    first = F.to_json(F.struct(F.lit("").alias("body"), F.col("text").alias("entry"), F.lit("01.01.2020").alias("tarih")))
    payload = (F.when(F.col("turn") == 0, F.concat(F.lit('{"baslik":"konu","guncel":['), named, F.lit('],"current_page":7,"total_page":9}')))
               .when(F.col("turn") == 1, text)
               .when(F.col("turn") == 2, F.concat(F.lit('{"x":[],"y":['), first, F.lit("]}")))
               .when(F.col("turn") == 3, F.lit('{"error":"yok"}'))
               .when(F.col("turn") == 4, F.lit('{"entries":[]}'))
               .otherwise(F.concat(F.lit('{"title":"t","entries":['), first, F.lit(","), named, F.lit("]}"))))
    stored = talks.select(F.concat(F.lit("s"), "conv_id").alias("slug"), (F.col("turn") + 1).alias("page"), payload.alias("payload"))
    return posts.normalize_payload(stored, "payload").withColumn("raw_data", F.md5("raw_data"))


def read_posts(spark, folder):
    """JSON Lines with blank, broken and non-object lines in between."""
    path = scratch_path(spark, "posts")
    talks = table(spark, folder, "conversations")
    record = F.to_json(F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("author"), F.col("text").alias("body"),
                                F.col("conv_id").cast("string").alias("topic"), (F.col("turn") + 1).alias("page")))
    lines = F.array(record, F.lit(""), F.lit('{"id": '), F.lit("[1, 2]"), F.lit("  "))
    talks.select(F.explode(lines).alias("value")).write.text(path)
    return posts.read_posts(spark, path).entries.select("id", "author", "body", "topic", "page")


def read_dumps(spark, folder):
    """Document-shaped dumps, one JSON value per file: every turn of a conversation is a dump of its own."""
    path = scratch_path(spark, "dumps")
    talks = table(spark, folder, "conversations")
    entry = F.to_json(F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("author"), F.col("text").alias("body"),
                               F.col("conv_id").cast("string").alias("topic")))
    dump = F.concat(F.lit('{"metadata":{"total_entries":1,"topics":["'), "conv_id", F.lit('"]},\n"entries":[\n'), entry, F.lit("\n]}"))
    # A file to a dump, all in one folder, put there by the tasks that write them: no folder to a dump, and no file is moved one by one at the end.
    dumps = c.dealt(talks.select("conv_id", "turn", dump.alias("value")), "conv_id", "turn").groupBy("conv_id", "turn").agg(
        F.array_join(F.collect_list("value"), "\n").alias("value"))
    # In a local folder no checksum file beside each: every file made there costs a process that sets its rights.
    plain = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    dumps.select("value").write.options(maxRecordsPerFile=1, **{"mapreduce.fileoutputcommitter.algorithm.version": 2}, **plain).text(path)
    found = posts.read_posts(spark, path, shape="document")
    kv = found.metadata.select(F.col("key").alias("field"), "value").groupBy("field", "value").agg(F.count("*").alias("n"))
    entries = found.entries.select(F.lit("entry").alias("field"), F.concat_ws("/", "topic", "id", "author", F.md5("body")).alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    return posts.union_parts(kv, entries)


def large_dumps(spark, folder):
    """A few dumps of many entries, printed over many lines: each file is one JSON value that many tasks may read."""
    path = scratch_path(spark, "dumps")
    talks = table(spark, folder, "conversations").withColumn("bucket", F.col("conv_id") % 3)
    entry = F.to_json(F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("author"), F.col("text").alias("body"),
                               F.col("conv_id").cast("string").alias("topic")), {"pretty": "true"})
    buckets = talks.select("bucket").distinct()
    none = F.lit(None).cast("long")
    head = buckets.select("bucket", F.lit(0).alias("part"), none.alias("conv_id"), none.alias("turn"),
                          F.concat(F.lit('{ "bucket": "}'), "bucket", F.lit('", "entries": [ "no entry"')).alias("value"))
    foot = buckets.select("bucket", F.lit(2).alias("part"), none.alias("conv_id"), none.alias("turn"), F.lit("]\n}").alias("value"))
    body = talks.select("bucket", F.lit(1).alias("part"), "conv_id", "turn", F.concat(F.lit(","), entry).alias("value"))
    lines = posts.union_parts(head, body, foot).repartition("bucket").sortWithinPartitions("bucket", "part", "conv_id", "turn")
    lines.select("bucket", "value").write.partitionBy("bucket").text(path)
    found = posts.read_posts(spark, path)
    nothing = F.lit(None).cast("string")
    entries = found.entries.select("id", "author", "body", "topic", nothing.alias("key"), nothing.alias("value"))
    kv = found.metadata.select(*[nothing.alias(c) for c in ("id", "author", "body", "topic")], "key", F.to_json(F.struct("value")).alias("value"))
    return posts.union_parts(entries, kv.withColumn("value", F.regexp_extract("value", '^\\{"value":(.*)\\}$', 1)))


def flatten_events(spark, folder):
    nested = table(spark, folder, "events").select("event_id", F.struct(
        F.from_json("props", "k int").alias("props"), F.struct("event_type").alias("kind")).alias("e"))
    return posts.flatten(nested)


def metadata_rows(spark, folder):
    body = F.to_json(F.struct("event_type", F.from_json("props", "k int").alias("props"), F.array("user_id").alias("users")))
    return posts.metadata_kv(table(spark, folder, "events").select("event_id", body.alias("json")), "json", ["event_id"])


def collect_until_empty(spark, folder):
    talks = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("topic"), (F.col("turn") + 1).alias("page"), "text")
    return posts.collect_pages(talks, 5, filled=F.length("text") > 120).select("topic", "page", "text")


def dataset_metadata(spark, folder):
    talks = table(spark, folder, "conversations")
    return summary.dataset_metadata(talks, "role").where("key <> 'collected_at'")


_TURN = """SELECT conv_id, turn, turn::VARCHAR AS id, text || '<br>&amp; son' AS body, role AS author, conv_id::VARCHAR AS author_id,
  length(text)::VARCHAR AS fav_count, '28.01.2021 03:49' AS created_at, '28.01.2021 03:' || (turn + 50) AS updated_at FROM conversations"""

QUERIES = {
    "page_links": Query(page_links, r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*')) AS x FROM pages)
SELECT page_id, trim(regexp_extract(x, '">(.*)$', 1)) AS title, regexp_extract(x, 'href="([^"]*)"', 1) AS slug FROM l"""),
    "listed_threads": Query(listed_threads, """
SELECT event_id, user_id AS id, event_type AS title, '/' || event_type || '--' || user_id || '?a=popular' AS slug,
  (props->>'$.k')::BIGINT AS entry_count FROM events
UNION ALL SELECT event_id, 31782, 'pena', '/pena--31782', 1 FROM events"""),
    "search_pages": Query(search_pages, f"""
SELECT event_id, user_id || ' başlık' AS thread_count, user_id AS id, event_type AS title,
  '{BASE_URL}/' || event_type || '--' || user_id || '?a=popular' AS slug, props->>'$.k' AS entry_count_total FROM events
UNION ALL SELECT event_id, user_id || ' başlık', 31782, 'pena', '{BASE_URL}/pena--31782', '1' FROM events"""),
    "topic_entries": Query(topic_entries, f"SELECT * FROM ({_TURN}) WHERE author <> 'system'"),
    "topic_headers": Query(topic_headers, """
SELECT conv_id, turn, conv_id::VARCHAR AS id, 'konu ' || conv_id AS title, 'konu--' || conv_id AS slug,
  CASE WHEN turn > 0 THEN 9 ELSE 1 END AS total_page, greatest(turn, 1) AS current_page,
  CASE WHEN turn > 1 THEN 'spor|' || role END AS tags, 'konu a (film)|konu b' AS disambiguation_titles,
  '/a--1|/b--2' AS disambiguation_links FROM conversations"""),
    "single_entries": Query(single_entries, f"""
SELECT conv_id, turn, turn AS entry, 'konu ' || conv_id AS title, body, author, fav_count::BIGINT AS fav_count, created_at, updated_at
FROM ({_TURN})"""),
    "user_profiles": Query(user_profiles, """
SELECT c_custkey, c_name AS nick, c_mktsegment AS quote_entry_title, 'söz <b>' || c_custkey || '</b>' AS quote_entry_body,
  'dün' AS quote_entry_date, '/entry/' || c_custkey AS quote_entry_url, c_custkey::VARCHAR AS entry_count_total,
  c_nationkey::VARCHAR AS entry_count_lastmonth, '2' AS entry_count_lastweek, '0' AS entry_count_today,
  'evvelsi gün' AS last_entry_time FROM customer"""),
    "user_timelines": Query(user_timelines, f"""
SELECT conv_id, turn, 0 AS pos, 'konu ' || conv_id AS name, '28.01.2021' AS date, text AS summary, '{BASE_URL}/konu--' || conv_id AS url
FROM conversations UNION ALL SELECT conv_id, turn, 1, 'son', '', 'x', '{BASE_URL}/son--1' FROM conversations"""),
    "normalize_payload": Query(normalize_payload, f"""
WITH t AS (SELECT 's' || conv_id AS slug, turn, turn + 1 AS page, role, text, {c.sql_strip('text')} AS s,
  to_json({{'content': text, 'nick': role, 'favCount': turn, 'entryId': turn}})::VARCHAR AS named,
  to_json({{'body': '', 'entry': text, 'tarih': '01.01.2020'}})::VARCHAR AS first FROM conversations),
p AS (SELECT *, md5(CASE turn WHEN 0 THEN '{{"baslik":"konu","guncel":[' || named || '],"current_page":7,"total_page":9}}'
  WHEN 1 THEN '[' || to_json('{{merhaba}} ' || text) || ',' || to_json('[1] ' || text) || ',' || to_json(text) || ',5,null,["x"]]'
  WHEN 2 THEN '{{"x":[],"y":[' || first || ']}}' ELSE '{{"title":"t","entries":[' || first || ',' || named || ']}}' END) AS raw_data FROM t)
SELECT slug, 'konu' AS title, 7 AS page, 9 AS total_pages, turn::VARCHAR AS id, s AS content, role AS author, '' AS date, turn AS fav_count,
  1 AS total_entries, raw_data FROM p WHERE turn = 0
UNION ALL SELECT slug, slug, page, 1, NULL, unnest(['{{merhaba}} ' || text, '[1] ' || text, text]), 'Bilinmiyor', '', 0, 3, raw_data FROM p WHERE turn = 1
UNION ALL SELECT slug, slug, page, 1, NULL, s, 'Anonim', '01.01.2020', 0, 1, raw_data FROM p WHERE turn = 2
UNION ALL SELECT slug, 't', page, 1, NULL, s, 'Anonim', '01.01.2020', 0, 2, raw_data FROM p WHERE turn > 4
UNION ALL SELECT slug, 't', page, 1, turn::VARCHAR, s, role, '', turn, 2, raw_data FROM p WHERE turn > 4"""),
    "read_posts": Query(read_posts, """
SELECT turn::VARCHAR AS id, role AS author, text AS body, conv_id::VARCHAR AS topic, turn + 1 AS page FROM conversations"""),
    "read_dumps": Query(read_dumps, """
SELECT 'metadata' AS field, '{"total_entries":1,"topics":["' || conv_id || '"]}' AS value, count(*) AS n FROM conversations GROUP BY conv_id
UNION ALL SELECT 'entry', conv_id || '/' || turn || '/' || role || '/' || md5(text), count(*) FROM conversations GROUP BY ALL"""),
    "large_dumps": Query(large_dumps, """
SELECT turn::VARCHAR AS id, role AS author, text AS body, conv_id::VARCHAR AS topic, NULL AS key, NULL AS value FROM conversations
UNION ALL SELECT NULL, NULL, NULL, NULL, 'bucket', '"}' || b || '"' FROM (SELECT DISTINCT conv_id % 3 AS b FROM conversations)"""),
    "flatten_events": Query(flatten_events, """
SELECT event_id, (props->>'$.k')::INT AS "e.props.k", event_type AS "e.kind.event_type" FROM events"""),
    "metadata_rows": Query(metadata_rows, """
SELECT event_id, 'event_type' AS key, event_type AS value FROM events UNION ALL
SELECT event_id, 'props', '{"k":' || (props->>'$.k') || '}' FROM events UNION ALL
SELECT event_id, 'users', '[' || user_id || ']' FROM events"""),
    "collect_until_empty": Query(collect_until_empty, """
WITH p AS (SELECT conv_id AS topic, turn + 1 AS page, text FROM conversations),
good AS (SELECT DISTINCT topic, page FROM p WHERE length(text) > 120),
stop AS (SELECT topic, min(n) AS first_bad FROM (SELECT DISTINCT topic, unnest(range(1, 7)) AS n FROM p)
  LEFT JOIN (SELECT topic, page AS n, true AS ok FROM good) USING (topic, n) WHERE ok IS NULL OR n = 6 GROUP BY topic)
SELECT topic, page, text FROM p JOIN stop USING (topic) WHERE page < first_bad"""),
    "dataset_metadata": Query(dataset_metadata, """
SELECT 'total_entries' AS key, count(*)::VARCHAR AS value FROM conversations
UNION ALL SELECT DISTINCT 'topic', role FROM conversations"""),
}
