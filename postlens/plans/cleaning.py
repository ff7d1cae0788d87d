"""Queries on text cleaning, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions import links
from postlens.functions import text as tx
from postlens.functions import values as val
from postlens.operators import filters, respelling
from postlens.plans import common as c
from postlens.plans.common import BASE_URL, Query, table
from postlens.session import materialize
from postlens.sources import posts


def _clean_pages(profile):
    def run(spark, folder):
        return table(spark, folder, "pages").select("page_id", tx.clean(F.col("html"), profile).alias("body"))
    return run


def unescaped_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.html_unescape(F.col("html")).alias("html"))


def _bodies(spark, folder):
    """Every kind of body the funnel knows: prose, markup, bare links, short references, nothing."""
    pages = table(spark, folder, "pages")
    talks = table(spark, folder, "conversations")
    return posts.union_parts(
        table(spark, folder, "documents").select(F.col("text").alias("body")),
        pages.select(F.col("html").alias("body")), pages.select(F.col("url").alias("body")),
        talks.select(F.concat(F.lit("(BKZ: "), "role", F.lit(")")).alias("body")),
        talks.select(F.when(F.col("role") == "user", "<br>").alias("body")))


_BODIES = """bodies AS (
  SELECT text AS body FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT url FROM pages
  UNION ALL SELECT '(BKZ: ' || role || ')' FROM conversations
  UNION ALL SELECT CASE WHEN role = 'user' THEN '<br>' END FROM conversations)"""


def cleaning_funnel(spark, folder):
    return filters.cleaning_funnel(_bodies(spark, folder))


def labelling_funnel(spark, folder):
    return filters.cleaning_funnel(_bodies(spark, folder), profile="labelling")


def kept_bodies(spark, folder):
    bodies = filters.drop_missing(_bodies(spark, folder), ["body"])
    kept = filters.drop_short_crossref(filters.drop_url_only(bodies))
    return kept.select(F.md5("body").alias("digest"), F.length("body").alias("n"))


def for_labelling(spark, folder):
    return posts.for_labelling(_bodies(spark, folder)).select(F.md5("body").alias("digest"), "sentiment")


def complete_entries(spark, folder):
    talks = table(spark, folder, "conversations")
    entries = talks.select(F.col("conv_id").alias("topic"), "turn", F.col("text").alias("body"),
                           F.when(F.col("role") != "system", F.col("role")).alias("author"),
                           F.when(F.col("turn") > 0, F.col("turn").cast("string")).otherwise("").alias("id"))
    return filters.drop_incomplete(entries).select("topic", "turn", "author", "id")


def valid_text_reasons(spark, folder):
    _, rejected = filters.valid_text(table(spark, folder, "documents"))
    return rejected.select("doc_id", "reason", "n_chars")


def valid_texts(spark, folder):
    accepted, _ = filters.valid_text(table(spark, folder, "documents"))
    return accepted.select("doc_id", "n_chars")


def batch_skip(spark, folder):
    return filters.batch_skip(table(spark, folder, "conversations"), low=40).select("conv_id", "turn")


def valid_queries(spark, folder):
    asked = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return filters.valid_query(asked, low=40)


def labelled_documents(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    known = filters.drop_missing(filters.require_columns(joined, ["text", "quality"]), ["quality"], blank_too=False)
    return known.select("doc_id", "quality", "toxic")


def entry_by_id(spark, folder):
    item = table(spark, folder, "benchmark").agg(F.max("item_id")).scalar()
    return filters.entry_by_id(table(spark, folder, "documents"), item, "doc_id").select("doc_id", "text")


def entries_by_ids(spark, folder):
    ids = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return filters.entries_by_ids(table(spark, folder, "documents"), ids, "doc_id").select("doc_id", "lang")


def _tagged(spark, folder):
    docs = table(spark, folder, "documents")
    raw = F.concat(F.lit(" "), "lang", F.lit(","), "source", F.lit(" "))
    return docs.select("doc_id", val.split_tags(F.when(F.col("n_chars") < 100, " ").otherwise(raw)).alias("tags"))


def split_tags(spark, folder):
    return _tagged(spark, folder).select("doc_id", c.join_words("tags").alias("tags"))


def by_channel(spark, folder):
    return filters.by_channel(_tagged(spark, folder), "fr").select("doc_id", c.join_words("tags").alias("tags"))


#: Marked letters of the documents' languages.
_MARKED = ("éèêàçôîûäöüßñáíóú", "eeeacoiuaousnaiou")


def _plain_documents(spark, folder):
    """Normalised documents, and the same with their marks lost."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.lower(tx.squash_ws(F.regexp_replace("text", r"[\p{P}\p{S}]", ""))).alias("text"))
    # Read four times, so normalised once.
    docs = materialize(docs, "plain-documents", "zstd")
    return docs, docs.withColumn("text", respelling.fold(F.col("text"), _MARKED))


def respelled_words(spark, folder):
    """Every word in its most frequent form."""
    docs, plain = _plain_documents(spark, folder)
    return respelling.restore(plain, respelling.learn(docs, "text", _MARKED), ["doc_id"], neighbours=False).select("doc_id", F.md5("restored").alias("digest"))


def respelled_texts(spark, folder):
    """By the best path: folded documents keep their words but for marks, and every word is one that folds to it."""
    docs, plain = _plain_documents(spark, folder)
    found = respelling.restore(plain, respelling.learn(docs, "text", _MARKED), ["doc_id"])
    return found.select("doc_id", F.md5(respelling.fold(F.col("restored"), _MARKED)).alias("folded"))


def normalized_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.normalize_tr(F.col("text")).alias("text"))


def prepared_texts(spark, folder):
    pages = table(spark, folder, "pages")
    text = F.concat(F.lit("Okudum (bkz: "), F.substring_index("url", "/", -1), F.lit("x), "), "url", F.lit(" ve  \t"), "html")
    return pages.select("page_id", tx.sentiment_prep(text).alias("kept"),
                        tx.sentiment_prep(text, "normalize_first").alias("flat"))


def squashed_pages(spark, folder):
    wide = F.translate(F.col("html"), " ", "\u00a0")
    return table(spark, folder, "pages").select("page_id", tx.squash_ws(wide).alias("html"))


def tagless_pages(spark, folder):
    html = F.col("html")
    return table(spark, folder, "pages").select(
        "page_id", tx.strip_tags(html).alias("bare"), tx.br_to(html, " ").alias("spaced"),
        tx.br_to(html, "\n", exact=True).alias("broken"))


def repaired_texts(spark, folder):
    broken = F.col("text")
    for bad, good in (("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã§", "ç"), ("Ã»", "û")):
        broken = F.replace(broken, F.lit(good), F.lit(bad))
    return table(spark, folder, "documents").select(
        "doc_id", tx.repair_mojibake(broken, fixed.SHEET_REPAIRS).alias("sheet"),
        tx.repair_mojibake(broken, fixed.LABELLING_REPAIRS + fixed.LABELLING_LOSSY_REPAIRS).alias("labelling"))


def composed_texts(spark, folder):
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return table(spark, folder, "documents").select("doc_id", tx.nfc(apart).alias("text"))


def dollar_marks(spark, folder):
    marked = F.regexp_replace("text", r"([a-z]+)", r"\$$1\$")
    return table(spark, folder, "documents").select("doc_id", tx.strip_dollar_marks(marked).alias("text"))


def truncated_texts(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", tx.truncate_tail(text, 1024).alias("tail"), tx.truncate_head(text, 1024).alias("head"),
        tx.truncate_tokens(text, 512).alias("last_tokens"), tx.truncate_tokens(text, 512, "head").alias("first_tokens"))


def previews(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", tx.preview(F.col("text")).alias("batch"), tx.preview(F.col("text"), always=True).alias("report"))


def word_tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", c.join_words(tx.word_tokens(F.col("text"))).alias("words"))


def folded_words(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", tx.fold_label(F.col("text")).alias("folded"), tx.fold_label(F.col("text"), "plain").alias("plain"))


def slug_titles(spark, folder):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, folder, "pages").select("page_id", links.slugify(title).alias("slug"))


def slug_parts(spark, folder):
    slug = F.concat(F.lit("/"), links.slugify(F.col("p_name")), F.lit("--"), "p_partkey", F.lit("?a=popular"))
    link = links.absolute_url(slug, BASE_URL)
    local = links.strip_base_url(link, BASE_URL)
    return table(spark, folder, "part").select(
        "p_partkey", links.id_from_slug(link).alias("id"), link.alias("url"), local.alias("local"),
        links.title_from_slug(local).alias("title"))


def url_parts(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", links.split_query(url)["slug"].alias("slug"), links.split_query(url)["query"].alias("query"),
        links.url_path(url).alias("path"), links.page_number(url, "page").alias("page"))


def listing_paths(spark, folder):
    url = F.concat(F.lit("/liste?kanal="), F.url_encode("p_brand"), F.lit("%20"), F.col("p_name"),
                   F.when(F.col("p_size") > 25, F.concat(F.lit("&p="), "p_size")).otherwise(""))
    asked = F.when(F.col("p_type") == "ECONOMY", F.lit("/liste")).otherwise(url)
    return table(spark, folder, "part").select("p_partkey", links.listing_path(asked).alias("path"))


def edit_dates(spark, folder):
    made = F.col("o_orderdate") + F.make_dt_interval(mins=F.pmod("o_custkey", F.lit(1440)).cast("int"))
    created = F.date_format(made, "dd.MM.yyyy HH:mm")
    written = (F.when(F.col("o_orderstatus") == "F", F.concat(created, F.lit(" ~ 23:59")))
               .when(F.col("o_orderstatus") == "O", F.concat(created, F.lit(" ~ 31.12.2020 10:00")))
               .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")))
    parsed = table(spark, folder, "orders").select("o_orderkey", val.parse_edit_date(written).alias("d")).select("o_orderkey", "d.*")
    return parsed.withColumns({"created_ts": val.to_post_ts(F.col("created_at")), "updated_ts": val.to_post_ts(F.col("updated_at"))})


def counters(spark, folder):
    text = F.when(F.col("p_type") != "SMALL", F.concat("p_size", F.lit(" başlık")))
    return table(spark, folder, "part").select("p_partkey", val.parse_count(text).alias("n"))


def first_fields(spark, folder):
    talks = table(spark, folder, "conversations")
    body = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "assistant", "")
    other = F.when(F.col("turn") < 4, F.col("role")).otherwise("")
    return talks.select("conv_id", "turn", val.first_truthy(body, other, default="Anonim").alias("value"),
                        val.first_truthy(F.col("turn"), F.col("conv_id"), default=-1, empty=0).alias("number"))


def theme_names(spark, folder):
    part = table(spark, folder, "part")
    return part.select("p_partkey", val.theme_label(F.lower("p_type")).alias("by_name"),
                       val.theme_label(F.concat(F.lit("LABEL_"), F.pmod("p_size", F.lit(9)))).alias("by_code"))


def label_codes(spark, folder):
    rows = table(spark, folder, "labels").join(c.document_sentiment(spark, folder), "doc_id")
    gold = (F.when(F.col("toxic") == 1, " -1 ").when(F.col("quality") == 1, "Olumlu").otherwise("notr?"))
    return rows.select("doc_id", val.sentiment_code(F.col("sentiment")).alias("pred"), val.gold_code(gold).alias("gold_text"),
                       val.gold_code(F.col("quality") - F.col("toxic") * 2, numeric=True).alias("gold_number"))


def signed_scores(spark, folder):
    rows = c.document_sentiment(spark, folder)
    return rows.select("doc_id", val.signed_score(F.col("sentiment"), F.col("confidence")).alias("signed"),
                       val.prefix_signed_score(F.col("sentiment"), F.col("confidence")).alias("by_prefix"))


_ENT = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
HTML_TEXT = c.sql_replace("html", _ENT)
_LABEL_PAIRS = fixed.LABELLING_REPAIRS + fixed.LABELLING_LOSSY_REPAIRS


def sql_sheet(column: str) -> str:
    bare = f"regexp_replace({column}, '<[^>]+>', '', 'g')"
    return c.sql_squash(c.sql_replace(bare, [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]))


def sql_labelling(column: str) -> str:
    bare = rf"regexp_replace(regexp_replace({column}, '<br\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g')"
    return c.sql_squash(c.sql_replace(bare, _LABEL_PAIRS))


def sql_flat(column: str) -> str:
    folded = f"translate(lower(translate({column}, 'Iİ', 'ıi')), 'âîûêô', 'aiueo')"
    return c.sql_squash(rf"regexp_replace({folded}, '[\p{{P}}\p{{S}}]', '', 'g')")


def sql_slug(column: str) -> str:
    ascii_only = rf"regexp_replace(translate(lower({column}), 'ığüşöç', 'igusoc'), '[^a-z0-9\s-]', '', 'g')"
    return rf"regexp_replace({ascii_only}, '\s+', '-', 'g')"


_BODY_ENT = c.sql_replace("body", _ENT)

_BREAK = c.sql_replace("text", [("ü", "Ã¼"), ("ö", "Ã¶"), ("ç", "Ã§"), ("û", "Ã»")])
_APART = "replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))"
_PREP = "('Okudum (bkz: ' || regexp_extract(url, '[^/]*$') || 'x), ' || url || ' ve  ' || chr(9) || html)"
_CLEAN_CASE = f"""CASE WHEN b IS NULL THEN 'null' WHEN regexp_full_match(b, '(https?://|www\\.)\\S+') THEN 'url_only'
  WHEN contains(lower(b), 'bkz') AND length(b) < 20 THEN 'short_crossref' WHEN b = '' THEN 'empty' ELSE 'remaining' END"""

_BARE = c.sql_squash(r"regexp_replace(text, '[\p{P}\p{S}]', '', 'g')")
_RESPELLED = f"""flat AS (SELECT doc_id, lower({_BARE}) AS t FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM flat)),
forms AS (SELECT w, translate(w, '{_MARKED[0]}', '{_MARKED[1]}') AS f, count(*) AS n FROM words GROUP BY w)"""

QUERIES = {
    "clean_pages_sheet": Query(_clean_pages("sheet"), f"SELECT page_id, {sql_sheet(HTML_TEXT)} AS body FROM pages"),
    "clean_pages_labelling": Query(_clean_pages("labelling"), f"SELECT page_id, {sql_labelling(HTML_TEXT)} AS body FROM pages"),
    "clean_pages_feed": Query(_clean_pages("feed"), rf"""
WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '<br>|<br/>|<br />', chr(10), 'g'), '<[^>]+>', '', 'g') AS html FROM pages)
SELECT page_id, {c.sql_strip(rf"regexp_replace(regexp_replace(nfc_normalize({HTML_TEXT}), '\$([\p{{L}}\p{{N}}_]{{1,10}})\$', '\1', 'g'), '[\t\r\f]+', ' ', 'g')")} AS body FROM bare"""),
    "unescaped_pages": Query(unescaped_pages, f"SELECT page_id, {HTML_TEXT} AS html FROM pages"),
    "cleaning_funnel": Query(cleaning_funnel, f"""
WITH {_BODIES}, clean AS (SELECT {sql_sheet(_BODY_ENT)} AS b FROM bodies), staged AS (SELECT {_CLEAN_CASE} AS stage FROM clean)
SELECT stage, count(*) AS n FROM staged GROUP BY stage"""),
    "labelling_funnel": Query(labelling_funnel, f"""
WITH {_BODIES}, clean AS (SELECT {sql_labelling("coalesce(" + _BODY_ENT + ", '')")} AS b FROM bodies)
SELECT CASE WHEN length(b) > 10 THEN 'valid' ELSE 'skipped' END AS stage, count(*) AS n FROM clean GROUP BY stage"""),
    "kept_bodies": Query(kept_bodies, rf"""
WITH {_BODIES} SELECT md5(body) AS digest, length(body) AS n FROM bodies WHERE body <> ''
AND NOT regexp_full_match(body, '(https?://|www\.)\S+') AND NOT (contains(lower(body), 'bkz') AND length(body) < 20)"""),
    "for_labelling": Query(for_labelling, f"""
WITH {_BODIES}, clean AS (SELECT {sql_labelling("coalesce(" + _BODY_ENT + ", '')")} AS b FROM bodies)
SELECT md5(b) AS digest, '' AS sentiment FROM clean WHERE length(b) > 10"""),
    "complete_entries": Query(complete_entries, """
SELECT conv_id AS topic, turn, role AS author, turn::VARCHAR AS id FROM conversations
WHERE role <> 'system' AND turn > 0 AND text <> ''"""),
    "valid_text_reasons": Query(valid_text_reasons, f"""
SELECT doc_id, CASE WHEN length({c.sql_strip('text')}) < 3 THEN 'too_short' ELSE 'too_long' END AS reason, n_chars
FROM documents WHERE length({c.sql_strip('text')}) NOT BETWEEN 3 AND 5000"""),
    "valid_texts": Query(valid_texts, f"SELECT doc_id, n_chars FROM documents WHERE length({c.sql_strip('text')}) BETWEEN 3 AND 5000"),
    "batch_skip": Query(batch_skip, f"SELECT conv_id, turn FROM conversations WHERE length({c.sql_strip('text')}) >= 40"),
    "valid_queries": Query(valid_queries, f"SELECT conv_id, turn, text AS query FROM conversations WHERE length({c.sql_strip('text')}) >= 40"),
    "labelled_documents": Query(labelled_documents, "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"),
    "entry_by_id": Query(entry_by_id, "SELECT doc_id, text FROM documents WHERE doc_id = (SELECT max(item_id) FROM benchmark)"),
    "entries_by_ids": Query(entries_by_ids, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "split_tags": Query(split_tags, "SELECT doc_id, CASE WHEN n_chars >= 100 THEN lang || ' ' || source END AS tags FROM documents"),
    "by_channel": Query(by_channel, "SELECT doc_id, lang || ' ' || source AS tags FROM documents WHERE n_chars >= 100 AND lang = 'fr'"),
    "normalized_texts": Query(normalized_texts, f"SELECT doc_id, {sql_flat('text')} AS text FROM documents"),
    "respelled_words": Query(respelled_words, f"""
WITH {_RESPELLED},
best AS (SELECT f, w AS form FROM forms QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, w) = 1)
SELECT doc_id, md5(coalesce(string_agg(form, ' ' ORDER BY i), '')) AS digest
FROM documents LEFT JOIN (SELECT doc_id, i, translate(w, '{_MARKED[0]}', '{_MARKED[1]}') AS f FROM words) USING (doc_id) LEFT JOIN best USING (f)
GROUP BY doc_id"""),
    "respelled_texts": Query(respelled_texts, f"""
WITH {_RESPELLED} SELECT doc_id, md5(coalesce(string_agg(translate(w, '{_MARKED[0]}', '{_MARKED[1]}'), ' ' ORDER BY i), '')) AS folded
FROM documents LEFT JOIN words USING (doc_id) GROUP BY doc_id"""),
    "prepared_texts": Query(prepared_texts, f"""
SELECT page_id, {c.sql_prep(_PREP)} AS kept, {sql_flat(_PREP)} AS flat FROM pages"""),
    "squashed_pages": Query(squashed_pages, f"SELECT page_id, {c.sql_squash('html')} AS html FROM pages"),
    "tagless_pages": Query(tagless_pages, r"""
SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS bare, regexp_replace(html, '<br\s*/?>', ' ', 'g') AS spaced,
  regexp_replace(html, '<br>|<br/>|<br />', chr(10), 'g') AS broken FROM pages"""),
    "repaired_texts": Query(repaired_texts, f"""
SELECT doc_id, {c.sql_replace(_BREAK, fixed.SHEET_REPAIRS)} AS sheet,
  {c.sql_replace(_BREAK, _LABEL_PAIRS)} AS labelling FROM documents"""),
    "composed_texts": Query(composed_texts, f"SELECT doc_id, nfc_normalize({_APART}) AS text FROM documents"),
    "dollar_marks": Query(dollar_marks, r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z]+)', '$\1$', 'g'), '\$([\p{L}\p{N}_]{1,10})\$', '\1', 'g') AS text FROM documents"""),
    "truncated_texts": Query(truncated_texts, r"""
WITH t AS (SELECT doc_id, text, string_split_regex(text, '\s+') AS w FROM documents)
SELECT doc_id, right(text, 1024) AS tail, left(text, 1024) AS head,
  CASE WHEN len(w) > 512 THEN array_to_string(w[len(w) - 511:len(w)], ' ') ELSE text END AS last_tokens,
  CASE WHEN len(w) > 512 THEN array_to_string(w[1:512], ' ') ELSE text END AS first_tokens FROM t"""),
    "previews": Query(previews, """
SELECT doc_id, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS batch, text[1:100] || '...' AS report FROM documents"""),
    "word_tokens": Query(word_tokens, f"SELECT doc_id, array_to_string({c.SQL_TOKENS.format('text')}, ' ') AS words FROM documents"),
    "folded_words": Query(folded_words, r"""
WITH w AS (SELECT doc_id, trim(text, E' \n') AS w FROM documents),
f AS (SELECT doc_id, regexp_replace(strip_accents(lower(w)), '[^\x00-\x7F]', '', 'g') AS f FROM w)
SELECT doc_id, f AS folded, f AS plain FROM f"""),
    "slug_titles": Query(slug_titles, f"SELECT page_id, {sql_slug('''regexp_extract(html, '<title>([^<]*)', 1)''')} AS slug FROM pages"),
    "slug_parts": Query(slug_parts, f"""
WITH s AS (SELECT *, {sql_slug('p_name')} || '--' || p_partkey || '?a=popular' AS local FROM part)
SELECT p_partkey, p_partkey AS id, '{BASE_URL}/' || local AS url, local, replace(split_part(local, '--', 1), '-', ' ') AS title FROM s"""),
    "url_parts": Query(url_parts, r"""
WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages)
SELECT page_id, regexp_extract(split_part(u, '?', 1), '[^/]*$') AS slug, nullif(split_part(u, '?', 2), '') AS query,
  regexp_replace(split_part(u, '?', 1), '^https?://[^/]*', '') AS path,
  coalesce(try_cast(nullif(regexp_extract(u, '[?&]page=([^&#]*)', 1), '') AS INT), 1) AS page FROM p"""),
    "listing_paths": Query(listing_paths, """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'gundem' ELSE 'kanal/' || url_encode(p_brand || ' ' || p_name)
  || CASE WHEN p_size > 25 THEN '?p=' || p_size ELSE '' END END AS path FROM part"""),
    "edit_dates": Query(edit_dates, """
WITH m AS (SELECT *, o_orderdate + to_minutes(o_custkey % 1440) AS made FROM orders),
t AS (SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN made ELSE o_orderdate END AS created_ts,
  CASE o_orderstatus WHEN 'F' THEN date_trunc('day', made) + INTERVAL '23 hours 59 minutes'
       WHEN 'O' THEN TIMESTAMP '2020-12-31 10:00:00' END AS updated_ts, o_orderstatus FROM m)
SELECT o_orderkey, created_ts, updated_ts,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(created_ts, '%d.%m.%Y %H:%M')
    ELSE strftime(created_ts, '%d.%m.%Y') END AS created_at,
  strftime(updated_ts, '%d.%m.%Y %H:%M') AS updated_at FROM t"""),
    "counters": Query(counters, "SELECT p_partkey, CASE WHEN p_type <> 'SMALL' THEN p_size ELSE 1 END AS n FROM part"),
    "first_fields": Query(first_fields, """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN text WHEN turn < 4 THEN role ELSE 'Anonim' END AS value,
  coalesce(nullif(turn, 0), nullif(conv_id, 0), -1) AS number FROM conversations"""),
    "theme_names": Query(theme_names, f"""
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Ekonomi' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS by_name,
  coalesce({c.sql_list(list(fixed.THEME_BY_CODE.values()))}[(p_size % 9) + 1], 'Label_' || (p_size % 9)) AS by_code FROM part"""),
    "label_codes": Query(label_codes, f"""
WITH {c.sql_sentiment()} SELECT doc_id, CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 ELSE 1 END AS pred,
  CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE -1 END AS gold_text,
  CASE WHEN quality - toxic * 2 IN (0, 1, 2) THEN quality - toxic * 2 ELSE -1 END AS gold_number
FROM labels JOIN voted USING (doc_id)"""),
    "signed_scores": Query(signed_scores, f"""
WITH {c.sql_sentiment()} SELECT doc_id, score AS signed,
  CASE sentiment WHEN 'negative' THEN -confidence ELSE confidence END AS by_prefix FROM voted"""),
}
