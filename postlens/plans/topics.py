"""Queries on topics: resolution, search, suggestions, listings, pages and discovery.

Part names serve as topic titles: one topic per name, its id the lowest part
key and its size the number of parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import links
from postlens.operators import density, ranking, search, summary, text_topics
from postlens.operators import topics as tp
from postlens.plans.cleaning import sql_slug
from postlens.plans.common import SQL_TOKENS, STOP_WORDS, Query, sql_list, table
from postlens.session import scratch_path

SCALE = 256


def _topics(spark, folder):
    names = table(spark, folder, "part").groupBy(F.col("p_name").alias("title")).agg(
        F.min("p_partkey").alias("id"), F.count("*").alias("entry_count"))
    return names.withColumn("slug", F.concat(F.lit("/"), links.slugify(F.col("title")), F.lit("--"), "id"))


def _queries(spark, folder):
    """Names as typed: whole, first word, turned around, unknown words, slugs."""
    part = table(spark, folder, "part")
    words = F.split("p_name", " ")
    asked = F.array("p_name", F.upper("p_name"), words[0], F.concat_ws(" ", F.reverse(words)), F.lower("p_type"),
                    F.concat_ws(" ", F.lit("no"), words[0]), F.concat(F.lit("pena--"), "p_size"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return part.select(F.explode(asked).alias("query")).distinct()


def resolve_topic(spark, folder):
    return search.resolve_topic(_queries(spark, folder), _topics(spark, folder))


def search_topics(spark, folder):
    words = F.split("p_name", " ")
    asked = table(spark, folder, "part").select(F.explode(F.array(words[0], words[1], F.concat_ws(" ", F.reverse(words)))).alias("query"))
    return search.search_topics(asked, _topics(spark, folder), 3).select("query", "rank", "id", "title", "entry_count", "thread_count")


def autocomplete8(spark, folder):
    titles = _topics(spark, folder).select(F.col("title").alias("text"), F.col("entry_count").alias("weight"))
    nicks = table(spark, folder, "customer").select(F.col("c_name").alias("text"), F.col("c_nationkey").cast("bigint").alias("weight"))
    asked = _prefixes(spark, folder)
    return search.autocomplete(asked, titles, nicks, 8)


def _prefixes(spark, folder):
    part = table(spark, folder, "part").select(F.explode(F.array(F.left("p_name", F.lit(1)), F.left("p_name", F.lit(2)), F.left("p_name", F.lit(5)))).alias("query"))
    people = table(spark, folder, "customer").select(F.left("c_name", F.lit(16)).alias("query"))
    return part.unionByName(people)


def trending8(spark, folder):
    return ranking.trending(_topics(spark, folder)).select("id", "title", "entry_count")


def topic_sizes(spark, folder):
    return summary.topic_sizes(table(spark, folder, "conversations"), "conv_id", 3)


def paginate(spark, folder):
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return ranking.paginate(talks, ["role"], ["conv_id", "turn"], 10)


def second_page(spark, folder):
    return ranking.one_page(_topics(spark, folder).select("id", "title"), ["title"], 2, 10)


def ordered_entries(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    nice = ranking.order_entries(events, "nice", "user_id", "ts", "value", "event_id").select("event_id", F.col("position").alias("nice"))
    plain = ranking.order_entries(events, "default", "user_id", "ts", "value", "event_id").select("event_id", "user_id", "position")
    return plain.join(nice, "event_id")


def latest_by_author(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return ranking.latest_by_author(events, 2, 5, None, "user_id", "ts", "event_id").select("event_id", "user_id", "position")


def latest_of_one(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return ranking.latest_by_author(events, 1, 10, 8, "user_id", "ts", "event_id")


def _regions(spark, folder):
    return tp.discover_topics(table(spark, folder, "embeddings"), 10, scale=SCALE)


def discover_topics(spark, folder):
    return tp.topic_info(_regions(spark, folder))


def topic_members(spark, folder):
    return _regions(spark, folder).select("vec_id", "topic")


def cluster_count(spark, folder):
    """What holds for any clustering: all rows are there, each with its nearest centre, and no topic is too small."""
    rows = table(spark, folder, "embeddings")
    model = tp.train_topics(rows, 8)
    assigned = tp.assign_topics(rows, model)
    # Centres: as many as topics, the model itself.
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in centre]) for centre in model.clusterCenters()])
    vector = F.col("embedding").cast("array<double>")
    away = F.transform(centres, lambda m: F.aggregate(F.zip_with(m, vector, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    checked = assigned.select("topic", away.alias("away")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.get("away", F.col("topic")) > F.array_min("away") + 1e-9).alias("not_nearest"))
    sizes = tp.topic_info(tp.relabel_small(assigned, 10)).agg(
        F.count_if((F.col("topic") != tp.OUTLIER) & (F.col("size") < 10)).alias("undersized"), F.sum("size").alias("in_topics"))
    return checked.select("*", sizes.select("undersized").scalar().alias("undersized"), sizes.select("in_topics").scalar().alias("in_topics"))


def assigned_topics(spark, folder):
    """Topics of new texts, the turns of conversations, by a stored model of the documents."""
    path = scratch_path(spark, "topic-model")
    text_topics.save(text_topics.fit(table(spark, folder, "documents"), "lang", stop_words=STOP_WORDS), path)
    found = text_topics.assign(table(spark, folder, "conversations"), text_topics.load(spark, path), ["conv_id", "turn"], stop_words=STOP_WORDS)
    return found.withColumns({c: F.round(c, 6) for c in ("similarity", "probability")})


def _density_sql(k: int = 10, min_size: int = 10) -> str:
    """CTEs ending in ``topics`` (vec_id, topic): the rule of ``density`` over exact neighbours, which blocks of 1,024 rows also find."""
    last = len(density.SHARES) - 1
    steps = []
    for i in range(last, -1, -1):
        kids = f"""SELECT m.root AS up, count(*) AS kids, sum(greatest(mass, below)) AS best, max(mass) AS one, max(below) AS parts
  FROM state{i + 1} AS s JOIN member AS m ON m.level = {i} AND m.node = s.root GROUP BY m.root""" if i < last else """
  SELECT 0 AS up, 0 AS kids, 0.0::DOUBLE AS best, 0.0::DOUBLE AS one, 0.0::DOUBLE AS parts WHERE false"""
        steps.append(f"""state{i} AS (
  SELECT b.root, b.n, coalesce(kids, 0) AS kids,
         b.n * (SELECT reach FROM dense WHERE level = {i}) + CASE WHEN kids = 1 THEN one ELSE 0 END AS mass,
         CASE WHEN kids = 1 THEN parts WHEN kids > 1 THEN best ELSE 0 END AS below
  FROM big AS b LEFT JOIN ({kids}) AS k ON k.up = b.root WHERE b.level = {i})""")
    for i in range(last + 1):
        up = f"""JOIN member AS m ON m.level = {i - 1} AND m.node = s.root
  JOIN (SELECT root AS up, taken OR pick AS taken, kids > 1 AS born FROM pick{i - 1}) AS u ON u.up = m.root""" if i else """
  CROSS JOIN (SELECT false AS taken, true AS born) AS u"""
        steps.append(f"""pick{i} AS (
  SELECT s.root, s.n, s.kids, u.taken, u.born AND NOT u.taken AND mass >= below AS pick FROM state{i} AS s {up})""")
    picked = " UNION ALL ".join(f"SELECT {i} AS level, root, n FROM pick{i} WHERE pick" for i in range(last + 1))
    return f"""WITH RECURSIVE w AS (
  SELECT vec_id AS id, e, sqrt(list_inner_product(e, e)) AS n FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)),
near AS (
  SELECT a.id AS a, b.id AS b, 1 - list_inner_product(a.e, b.e) / (a.n * b.n) AS distance FROM w AS a JOIN w AS b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY distance, b.id) <= {k}),
core AS (SELECT a AS id, max(distance) AS core FROM near GROUP BY a),
cuts AS (
  SELECT unnest(range({last + 1})) AS level, unnest(list_transform(e, lambda x: greatest(x, {density.CLOSEST}))) AS e
  FROM (SELECT quantile_disc(core, {list(density.SHARES)}) AS e FROM core)),
dense AS (SELECT level, e, coalesce(1 / lead(e) OVER (ORDER BY level) - 1 / e, 1 / e) AS reach FROM cuts),
link AS (
  SELECT level, a, b FROM near JOIN core AS x ON x.id = a JOIN core AS y ON y.id = b JOIN dense ON greatest(distance, x.core, y.core) <= e),
ties AS (SELECT level, a, b FROM link UNION SELECT level, b, a FROM link),
led AS (
  SELECT level, a AS node, a AS root FROM ties
  UNION SELECT ties.level, ties.b, led.root FROM led JOIN ties ON led.level = ties.level AND led.node = ties.a AND led.root < ties.b),
member AS (SELECT level, node, min(root) AS root FROM led GROUP BY level, node),
big AS (SELECT level, root, count(*) AS n FROM member GROUP BY level, root HAVING count(*) >= {min_size}),
{", ".join(steps)},
kept AS (SELECT level, root, row_number() OVER (ORDER BY n DESC, root) - 1 AS topic FROM ({picked})),
topics AS (
  SELECT vec_id, coalesce(topic, -1) AS topic FROM embeddings
  LEFT JOIN (SELECT node, topic FROM member JOIN kept USING (level, root)) AS m ON node = vec_id)"""


_TOPICS = f"""topics AS (SELECT *, '/' || {sql_slug('title')} || '--' || id AS slug FROM (
  SELECT p_name AS title, min(p_partkey) AS id, count(*) AS entry_count FROM part GROUP BY p_name))"""
_ASKED = """asked AS (SELECT DISTINCT unnest([p_name, upper(p_name), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1),
  lower(p_type), 'no ' || split_part(p_name, ' ', 1), 'pena--' || p_size, replace(p_name, ' ', '-')]) AS query FROM part)"""

QUERIES = {
    "resolve_topic": Query(resolve_topic, f"""
WITH {_TOPICS}, {_ASKED}, pairs AS (
  SELECT query, id, slug, entry_count, CASE WHEN lower(query) IN (title, {sql_slug('title')}) THEN 1
    WHEN starts_with(title, lower(query) || ' ') THEN 2
    WHEN len(list_filter(string_split(lower(query), ' '), lambda w: NOT list_contains(string_split(title, ' '), w))) = 0 THEN 3 END AS t
  FROM asked CROSS JOIN topics WHERE NOT contains(query, '--')),
best AS (SELECT * FROM pairs WHERE t < 3 OR (t = 3 AND contains(query, ' '))
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY t, entry_count DESC, id) = 1)
SELECT query, CASE WHEN contains(query, '--') THEN 'direct' WHEN t = 1 THEN 'exact' WHEN t = 2 THEN 'starts_with'
    WHEN NOT contains(query, ' ') THEN 'as_typed' WHEN t = 3 THEN 'first_result' ELSE 'not_found' END AS tier,
  CASE WHEN contains(query, '--') THEN split_part(query, '--', 2)::BIGINT ELSE id END AS id,
  CASE WHEN contains(query, '--') THEN query WHEN t IS NULL AND NOT contains(query, ' ') THEN lower(query) ELSE slug[2:] END AS path
FROM asked LEFT JOIN best USING (query)"""),
    "search_topics": Query(search_topics, f"""
WITH {_TOPICS}, asked AS (SELECT DISTINCT unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2),
  split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)]) AS query FROM part)
SELECT query, row_number() OVER w AS rank, id, title, entry_count, count(*) OVER (PARTITION BY query) AS thread_count
FROM asked JOIN topics ON len(list_filter(string_split(query, ' '), lambda x: NOT list_contains(string_split(title, ' '), x))) = 0
WINDOW w AS (PARTITION BY query ORDER BY entry_count DESC, id) QUALIFY rank <= 3"""),
    "autocomplete8": Query(autocomplete8, f"""
WITH {_TOPICS}, asked AS (SELECT DISTINCT unnest([left(p_name, 1), left(p_name, 2), left(p_name, 5)]) AS query FROM part
  UNION SELECT left(c_name, 16) FROM customer),
texts AS (SELECT 'title' AS kind, title AS text, entry_count AS weight FROM topics
  UNION ALL SELECT 'nick', c_name, max(c_nationkey) FROM customer GROUP BY c_name)
SELECT query, kind, row_number() OVER (PARTITION BY query, kind ORDER BY weight DESC, text) AS rank, text
FROM asked JOIN texts ON starts_with(lower(text), trim(lower(query))) WHERE length(trim(query)) >= 2 QUALIFY rank <= 8"""),
    "trending8": Query(trending8, f"WITH {_TOPICS} SELECT id, title, entry_count FROM topics ORDER BY entry_count DESC, id LIMIT 8"),
    "topic_sizes": Query(topic_sizes, """
SELECT conv_id, count(*) AS entry_count, ceil(count(*) / 3)::INT AS total_page FROM conversations GROUP BY conv_id"""),
    "paginate": Query(paginate, """
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS position,
  ceil(count(*) OVER (PARTITION BY role) / 10)::INT AS total_page FROM conversations),
p AS (SELECT *, ceil(position / 10)::INT AS page FROM r)
SELECT *, page > 1 AS has_prev, page < total_page AS has_next FROM p"""),
    "second_page": Query(second_page, f"WITH {_TOPICS} SELECT id, title FROM topics ORDER BY title LIMIT 10 OFFSET 10"),
    "ordered_entries": Query(ordered_entries, """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nice FROM events"""),
    "latest_by_author": Query(latest_by_author, """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position
FROM events QUALIFY position BETWEEN 6 AND 10"""),
    "latest_of_one": Query(latest_of_one, "SELECT event_id, user_id, ts FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 10"),
    "discover_topics": Query(discover_topics, f"""
{_density_sql()} SELECT topic, count(*) AS size, topic = -1 AS is_outlier FROM topics GROUP BY topic"""),
    "topic_members": Query(topic_members, f"{_density_sql()} SELECT vec_id, topic FROM topics"),
    "cluster_count": Query(cluster_count, "SELECT count(*) AS n_rows, 0 AS not_nearest, 0 AS undersized, count(*) AS in_topics FROM embeddings"),
    "assigned_topics": Query(assigned_topics, f"""
WITH tf AS (SELECT topic, word, count(*) AS tf FROM (
  SELECT lang AS topic, unnest({SQL_TOKENS.format('text')}) AS word FROM documents WHERE lang IS NOT NULL)
  WHERE length(word) > 3 AND NOT list_contains({sql_list(STOP_WORDS)}, word) GROUP BY ALL),
idf AS (SELECT word, ln(1 + (SELECT avg(n) FROM (SELECT sum(tf) AS n FROM tf GROUP BY topic)) / sum(tf)) AS idf FROM tf GROUP BY word),
best AS (SELECT topic, word, idf, tf * idf AS weight FROM tf JOIN idf USING (word)
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) <= {text_topics.TERMS}),
size AS (SELECT topic, sqrt(sum(weight * weight)) AS size FROM best GROUP BY topic),
known AS (SELECT DISTINCT word, idf FROM best),
turns AS (SELECT conv_id, turn, word, count(*) AS n FROM (
  SELECT conv_id, turn, unnest({SQL_TOKENS.format('text')}) AS word FROM conversations) JOIN known USING (word) GROUP BY ALL),
own AS (SELECT conv_id, turn, sqrt(sum(n * idf * n * idf)) AS length FROM turns JOIN known USING (word) GROUP BY ALL),
sim AS (SELECT conv_id, turn, topic, sum(n * idf * weight) / any_value(size) / any_value(length) AS similarity
  FROM turns JOIN best USING (word) JOIN size USING (topic) JOIN own USING (conv_id, turn) GROUP BY conv_id, turn, topic),
top AS (SELECT conv_id, turn, topic, similarity, similarity / sum(similarity) OVER (PARTITION BY conv_id, turn) AS probability FROM sim
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, topic) = 1)
SELECT conv_id, turn, topic, round(coalesce(similarity, 0), 6) AS similarity, round(probability, 6) AS probability
FROM conversations LEFT JOIN top USING (conv_id, turn)"""),
}
