"""Queries on scoring, voting, keywords, themes and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions import text as tx
from postlens.functions import values as val
from postlens.operators import filters, keywords, ranking, scoring, search, summary, themes
from postlens.plans import common as c
from postlens.operators.rows import unnest
from postlens.plans.common import LEXICON, STOP_WORDS, VOCABULARIES, Query, table

SCORER = scoring.lexicon_scorer(LEXICON)


def sentiment_distribution(spark, folder):
    scored = scoring.analyse_sentiment(c.analysable_documents(spark, folder), "text", SCORER)
    return summary.sentiment_distribution(scored)


def document_sentiment(spark, folder):
    return c.document_sentiment(spark, folder).select("doc_id", "sentiment", "score", "confidence", "label")


def sentence_scores(spark, folder):
    scored = scoring.with_scores(scoring.with_sentences(table(spark, folder, "documents").select("doc_id", "text")), SCORER)
    return scored.select("doc_id", F.posexplode_outer("scored").alias("sent_idx", "s")).select("doc_id", "sent_idx", "s.*")


def last_sentences(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", tx.split_sentences(F.col("text")).alias("parts"), "text")
    return docs.select("doc_id", F.size("parts").alias("n_sentences"), tx.last_sentence(F.col("text")).alias("last"),
                       F.size(tx.last_n(F.col("parts"), F.col("text"))).alias("n_used"))


def rank_sentences(spark, folder):
    docs = table(spark, folder, "documents")
    rows = unnest(docs, ["doc_id"], tx.split_sentences(tx.sentiment_prep(F.col("text"))), "sentence", "sent_idx")
    return ranking.rank_sentences(rows).select("doc_id", "sent_idx", "from_end", "total", "is_last")


def vote_scores(spark, folder):
    docs = scoring.with_sentences(table(spark, folder, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.posexplode_outer("sentences").alias("sent_idx", "sentence"))
    digest = rows.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("-", "doc_id", "sent_idx")), 1, 4), 16, 10).cast("int"))
    scored = digest.select("doc_id", "sent_idx", F.element_at(F.array(*map(F.lit, scoring.LABELS)), F.col("h") % 3 + 1).alias("label"),
                           (0.3 + (F.col("h") % 700) / 1000).cast("decimal(18,6)").cast("double").alias("score"))
    return scoring.vote_sentences(scored)


def lexicon_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", scoring.lexicon_counts(F.col("text"), LEXICON).alias("k"))
    return docs.select("doc_id", "k.pos", "k.neg")


def lexicon_match(spark, folder):
    found = scoring.lexicon_match(table(spark, folder, "documents").select("doc_id", "text"), "text", LEXICON)
    return found.groupBy("phrase", "polarity").agg(F.count("*").alias("n"))


def lexicon_override(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    result = scoring.analyse_sentiment(docs, "text", SCORER, override=LEXICON)
    return result.select("doc_id", "sentiment", "confidence", "score")


def canonical_labels(spark, folder):
    raw = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, F.concat(F.lit("Toxic-NEG-"), F.col("quality")))
        .otherwise(F.concat(F.lit("LABEL_"), F.col("quality") + 1)).alias("raw"), (F.col("doc_id") / 1000).alias("s"))
    return raw.select("doc_id", val.canonical_sentiment(F.col("raw"), F.col("s")).alias("r")).select(
        "doc_id", "r.label", "r.score")


def best_candidates(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct(
        F.concat(F.lit("LABEL_"), i.cast("string")).alias("label"), x.cast("double").alias("score"))).alias("k"))
    return rows.select("vec_id", val.best_candidate(F.col("k")).alias("r")).select("vec_id", "r.label", "r.score")


def keywords_top8(spark, folder):
    return keywords.keyword_rows(table(spark, folder, "documents"), "doc_id", "text", 8, STOP_WORDS)


def stop_words_dropped(spark, folder):
    docs = table(spark, folder, "documents").select("lang", tx.word_tokens(F.col("text")).alias("w"))
    return docs.groupBy("lang").agg(
        F.sum(F.size("w")).alias("words"), F.sum(F.size(tx.drop_stopwords(F.col("w"), STOP_WORDS))).alias("kept"))


def topic_terms(spark, folder):
    terms = keywords.topic_terms(table(spark, folder, "documents"), "lang", "text", 10, STOP_WORDS)
    return terms.withColumn("weight", F.round("weight", 4))


def _themed(spark, folder):
    docs = c.analysable_documents(spark, folder)
    scored = docs.withColumn("theme_scores", themes.vocabulary_scores(F.col("text"), VOCABULARIES))
    return themes.theme_result(scored, round_scores=False)


def themes_top3(spark, folder):
    return _themed(spark, folder).select("doc_id", c.join_words("themes").alias("themes"), "main_topic", "is_ambiguous")


def theme_distribution(spark, folder):
    return summary.theme_distribution(_themed(spark, folder))


def distinct_themes(spark, folder):
    return summary.theme_counts(_themed(spark, folder))


def theme_choices(spark, folder):
    return summary.distinct_themes(_themed(spark, folder), "all")


def _analysed(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    scored = docs.withColumn("theme_scores", themes.vocabulary_scores(F.col("text"), VOCABULARIES))
    themed = themes.theme_result(scored, round_scores=False).select("doc_id", "text", "themes", "main_topic")
    return scoring.analyse_sentiment(themed, "text", SCORER)


def batch_summary(spark, folder):
    return summary.batch_summary(_analysed(spark, folder))


def batch_entries(spark, folder):
    return summary.batch_entries(_analysed(spark, folder), "doc_id").select("entry_id", "text", "sentiment", "main_topic")


def analysis_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = docs.withColumn("theme_scores", themes.vocabulary_scores(F.col("text"), VOCABULARIES))
    themed = themes.analyse_theme(scored, "text", stop_words=STOP_WORDS).drop("scores", "error")
    return scoring.analyse_sentiment(themed, "text", SCORER).select(
        "doc_id", "sentiment", "confidence", "main_topic", c.join_words("keywords").alias("keywords"))


def _attached(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    labelled = table(spark, folder, "labels").select("doc_id")
    analysis = _analysed(spark, folder).join(labelled, "doc_id", "left_semi").select("doc_id", "sentiment", "themes")
    return search.attach_analysis(docs, analysis, "doc_id")


def filter_analysed(spark, folder):
    kept = filters.filter_analysed(_attached(spark, folder), "positive", "en")
    return kept.select("doc_id", "lang", "sentiment", c.join_words("themes").alias("themes"))


def resume_pending(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return search.resume(docs, table(spark, folder, "labels"), "doc_id")


def _phrase_model():
    """A user's model: the phrase rule as Python code that gets lists of sentences."""
    def score(sentence):
        text = sentence.lower()
        pos, neg = (sum(p in text for p in phrases) for phrases in (LEXICON.positive, LEXICON.negative))
        return "positive" if pos > neg else "negative" if neg > pos else "neutral", (max(pos, neg) + 1) / (pos + neg + 2)

    return lambda sentences: [score(s) for s in sentences]


def model_sentiment(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = scoring.analyse_sentiment(docs, "text", scoring.ModelScorer(_phrase_model, max_words=100_000))
    return scored.select("doc_id", "sentiment", "confidence", "score", "label")


#: Words of the default lists, in a text of their own: each word of a document becomes one of them.
_RENDERED = [*fixed.POSITIVE_PHRASES[:9], *fixed.STOP_WORDS[:9], "kitap", "deniz", *fixed.NEGATIVE_PHRASES[:9], "yolculuk", "araba"]


def _turkish(spark, folder):
    """The documents in words of the default lists, chosen by length and place; full stops stay."""
    vocabulary = F.array(*[F.lit(w) for w in _RENDERED])
    words = F.transform(F.split("text", " ", -1), lambda w, i: F.concat(
        F.get(vocabulary, (F.length(w) * 13 + i) % len(_RENDERED)), F.when(F.endswith(w, F.lit(".")), ".").otherwise("")))
    return table(spark, folder, "documents").select("doc_id", F.array_join(words, " ").alias("text"))


def default_lists(spark, folder):
    """Sentiment and keywords with the default phrases and stop words."""
    analysed = scoring.analyse_sentiment(_turkish(spark, folder), "text")
    named = keywords.with_keywords(analysed, "text", 5).withColumn("keywords", F.transform("keywords", lambda k: k["word"]))
    return named.select("doc_id", "sentiment", "confidence", "score", c.join_words("keywords").alias("keywords"))


def theme_invariants(spark, folder):
    """What holds for any model: new texts get a probability for every theme of the training rows, and the likeliest is the main one."""
    docs = table(spark, folder, "documents").select("text", "lang")
    model = themes.train_theme_model(docs, "text", "lang", features=1 << 14, iterations=15)
    scored = themes.theme_result(themes.score_themes(table(spark, folder, "conversations").select("conv_id", "turn", "text"), model, "text"))
    best = F.array_max(F.transform("theme_scores", lambda x: F.struct(x["score"].alias("score"), x["label"].alias("label"))))
    total = F.aggregate("theme_scores", F.lit(0.0), lambda s, x: s + x["score"])
    return scored.select("conv_id", "turn", F.size("theme_scores").alias("n_themes"), F.round(total, 6).alias("total"),
                         (F.lower("main_topic") == F.lower(best["label"])).alias("main_is_likeliest"))


def theme_model(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = themes.train_theme_model(docs, "text", "lang", features=1 << 14, iterations=15)
    scored = themes.theme_result(themes.score_themes(docs, model, "text"))
    return scored.select("doc_id", "lang", F.lower("main_topic").alias("predicted"), "is_ambiguous")


_TOP3 = f"""
words AS (SELECT doc_id, text, lang, {c.SQL_TOKENS.format('text')} AS w FROM documents),
counted AS (SELECT doc_id, unnest([{', '.join(f"{{'l': '{k}', 'i': {i}, 'h': len(list_filter(w, lambda t: list_contains({c.sql_list(v)}, t)))}}" for i, (k, v) in enumerate(VOCABULARIES.items()))}]) AS s
  FROM words WHERE length({c.sql_strip('text')}) >= 3),
shares AS (SELECT doc_id, s.l AS l, s.i AS i, coalesce(s.h::DOUBLE / nullif(sum(s.h) OVER (PARTITION BY doc_id), 0), 0) AS sc FROM counted),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, i) AS r FROM shares),
kept AS (SELECT *, upper(l[1]) || l[2:] AS theme FROM placed WHERE (sc >= 0.15 AND r <= 3) OR r = 1),
result AS (SELECT doc_id, string_agg(theme, ' ' ORDER BY r) AS themes, arg_min(theme, r) AS main_topic,
  coalesce(max(sc::DECIMAL(4,2)) FILTER (r = 1) - max(sc::DECIMAL(4,2)) FILTER (r = 2) < 0.10, false) AS is_ambiguous
  FROM kept GROUP BY doc_id)"""

_KEYWORDS = f"""
tokens AS (SELECT doc_id, {c.SQL_TOKENS.format('text')} AS t FROM documents),
found AS (SELECT doc_id, unnest(f) AS word, generate_subscripts(f, 1) AS pos FROM (
  SELECT doc_id, list_filter(t, lambda w: length(w) > 3 AND NOT list_contains({c.sql_list(STOP_WORDS)}, w)) AS f FROM tokens)),
counts AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM found GROUP BY ALL),
top8 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank, word, n FROM counts)"""

QUERIES = {
    "sentiment_distribution": Query(sentiment_distribution, f"""
WITH {c.sql_sentiment(source=f"(SELECT * FROM documents WHERE length({c.sql_strip('text')}) >= 3)")}
SELECT sentiment, count(*) AS n FROM voted GROUP BY sentiment"""),
    "document_sentiment": Query(document_sentiment, f"WITH {c.sql_sentiment()} SELECT * FROM voted"),
    "sentence_scores": Query(sentence_scores, f"""
WITH {c.sql_sentences()}, {c.sql_scored()} SELECT doc_id, sent_idx, label, score FROM scored"""),
    "last_sentences": Query(last_sentences, rf"""
WITH cut AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.?!…\n]+'),
  lambda s: {c.sql_strip('s')}), lambda s: s <> '') AS parts FROM documents)
SELECT doc_id, len(parts) AS n_sentences, coalesce(parts[-1], '') AS last,
  greatest(1, least(10, len(parts))) AS n_used FROM cut"""),
    "rank_sentences": Query(rank_sentences, f"""
WITH {c.sql_sentences()}, rows AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS sent_idx FROM cut),
ranked AS (SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx DESC) AS from_end FROM rows)
SELECT doc_id, sent_idx, from_end, count(*) OVER (PARTITION BY doc_id) AS total, from_end = 1 AS is_last
FROM ranked WHERE from_end <= 10"""),
    "vote_scores": Query(vote_scores, f"""
WITH {c.sql_sentences()}, hashed AS (
  SELECT doc_id, sent_idx, n, ('0x' || md5(doc_id || '-' || sent_idx)[1:4])::INT AS h FROM tail),
scored AS (SELECT doc_id, sent_idx, n, ['positive', 'negative', 'neutral'][h % 3 + 1] AS label,
  (0.3::DOUBLE + (h % 700)::DOUBLE / 1000)::DECIMAL(18,6)::DOUBLE AS score FROM hashed), {c.sql_vote()}
SELECT * FROM voted"""),
    "lexicon_counts": Query(lexicon_counts, f"""
SELECT doc_id, {c.sql_hits('text', LEXICON.positive)} AS pos, {c.sql_hits('text', LEXICON.negative)} AS neg FROM documents"""),
    "lexicon_match": Query(lexicon_match, f"""
SELECT phrase, polarity, count(*) AS n FROM documents JOIN (
  SELECT unnest({c.sql_list(LEXICON.positive)}) AS phrase, 'positive' AS polarity
  UNION ALL SELECT unnest({c.sql_list(LEXICON.negative)}), 'negative') ON contains(lower(text), phrase) GROUP BY ALL"""),
    "lexicon_override": Query(lexicon_override, f"""
WITH {c.sql_sentiment()}, last AS (
  SELECT doc_id, {c.sql_hits('sentence', LEXICON.positive)} AS p, {c.sql_hits('sentence', LEXICON.negative)} AS g
  FROM tail WHERE sent_idx = n - 1),
flip AS (SELECT doc_id, sentiment, confidence,
  CASE WHEN confidence < 0.75 THEN NULL WHEN sentiment = 'negative' AND p >= 2 AND g = 0 THEN 'positive'
       WHEN sentiment = 'positive' AND g >= 2 AND p = 0 THEN 'negative' END AS other FROM voted JOIN last USING (doc_id)),
final AS (SELECT doc_id, coalesce(other, sentiment) AS sentiment, CASE WHEN other IS NULL THEN confidence
  ELSE greatest(0.6::DOUBLE, least(0.85::DOUBLE, confidence - 0.05::DOUBLE)) END AS confidence FROM flip)
SELECT *, CASE sentiment WHEN 'positive' THEN confidence WHEN 'negative' THEN -confidence ELSE 0.0 END AS score FROM final"""),
    "canonical_labels": Query(canonical_labels, """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
  doc_id::DOUBLE / 1000 AS score FROM labels"""),
    "best_candidates": Query(best_candidates, """
SELECT vec_id, list_max(embedding)::DOUBLE AS score,
  'LABEL_' || (list_position(embedding, list_max(embedding)) - 1) AS label FROM embeddings"""),
    "keywords_top8": Query(keywords_top8, f"WITH {_KEYWORDS} SELECT doc_id, rank, word, n FROM top8 WHERE rank <= 8"),
    "stop_words_dropped": Query(stop_words_dropped, f"""
WITH tokens AS (SELECT lang, unnest({c.SQL_TOKENS.format('text')}) AS w FROM documents)
SELECT lang, count(*) AS words, count(*) FILTER (NOT list_contains({c.sql_list(STOP_WORDS)}, w)) AS kept FROM tokens GROUP BY lang"""),
    "topic_terms": Query(topic_terms, f"""
WITH tokens AS (SELECT lang, unnest({c.SQL_TOKENS.format('text')}) AS word FROM documents),
tf AS (SELECT lang, word, count(*) AS tf FROM tokens WHERE length(word) > 3
  AND NOT list_contains({c.sql_list(STOP_WORDS)}, word) GROUP BY ALL),
w AS (SELECT lang, word, tf, sum(tf) OVER (PARTITION BY word)::BIGINT AS f,
  (SELECT avg(s) FROM (SELECT sum(tf) AS s FROM tf GROUP BY lang)) AS a FROM tf),
r AS (SELECT *, tf * ln(1 + a / f) AS weight FROM w)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank, word, tf, f, round(weight, 4) AS weight
FROM r QUALIFY rank <= 10"""),
    "themes_top3": Query(themes_top3, f"WITH {_TOP3} SELECT * FROM result"),
    "theme_distribution": Query(theme_distribution, f"WITH {_TOP3} SELECT main_topic, count(*) AS n FROM result GROUP BY ALL"),
    "distinct_themes": Query(distinct_themes, f"""
WITH {_TOP3} SELECT 'main' AS definition, count(DISTINCT main_topic) AS n FROM result
UNION ALL SELECT 'all', count(DISTINCT theme) FROM kept"""),
    "theme_choices": Query(theme_choices, f"WITH {_TOP3} SELECT DISTINCT theme FROM kept"),
    "batch_summary": Query(batch_summary, f"""
WITH {c.sql_sentiment(source=f"(SELECT * FROM documents WHERE length({c.sql_strip('text')}) >= 3)")}, {_TOP3}
SELECT 'total_entries' AS kind, '' AS label, count(*) AS n FROM documents
UNION ALL SELECT 'sentiment', sentiment, count(*) FROM voted GROUP BY ALL
UNION ALL SELECT 'theme', main_topic, count(*) FROM result GROUP BY ALL"""),
    "batch_entries": Query(batch_entries, f"""
WITH {c.sql_sentiment()}, {_TOP3}
SELECT doc_id AS entry_id, CASE WHEN length({c.sql_strip('text')}) > 100 THEN {c.sql_strip('text')}[1:100] || '...'
  ELSE {c.sql_strip('text')} END AS text, sentiment, main_topic
FROM documents JOIN voted USING (doc_id) JOIN result USING (doc_id)"""),
    "analysis_rows": Query(analysis_rows, f"""
WITH {c.sql_sentiment()}, {_TOP3.replace(f"WHERE length({c.sql_strip('text')}) >= 3", '')}, {_KEYWORDS},
kw AS (SELECT doc_id, string_agg(word, ' ' ORDER BY rank) AS keywords FROM top8 WHERE rank <= 8 GROUP BY doc_id)
SELECT doc_id, sentiment, confidence, main_topic, coalesce(keywords, '') AS keywords
FROM voted JOIN result USING (doc_id) LEFT JOIN kw USING (doc_id)"""),
    "filter_analysed": Query(filter_analysed, f"""
WITH {c.sql_sentiment()}, {_TOP3.replace(f"WHERE length({c.sql_strip('text')}) >= 3", '')},
a AS (SELECT doc_id, sentiment, themes FROM voted JOIN result USING (doc_id) SEMI JOIN labels USING (doc_id))
SELECT doc_id, lang, sentiment, themes FROM documents LEFT JOIN a USING (doc_id)
WHERE sentiment IS NULL OR (sentiment = 'positive' AND list_contains(string_split(themes, ' '), 'en'))"""),
    "resume_pending": Query(resume_pending, "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)"),
    "model_sentiment": Query(model_sentiment, f"WITH {c.sql_sentiment()} SELECT doc_id, sentiment, confidence, score, label FROM voted"),
    "theme_invariants": Query(theme_invariants, """
SELECT conv_id, turn, (SELECT count(DISTINCT lang) FROM documents) AS n_themes, 1.0 AS total, true AS main_is_likeliest FROM conversations"""),
    "default_lists": Query(default_lists, f"""
WITH rendered AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: {c.sql_list(_RENDERED)}[
    (length(w) * 13 + i - 1) % {len(_RENDERED)} + 1] || CASE WHEN ends_with(w, '.') THEN '.' ELSE '' END), ' ') AS text FROM documents),
{c.sql_sentiment(scoring.Lexicon(), 'rendered')},
tokens AS (SELECT doc_id, {c.SQL_TOKENS.format('text')} AS t FROM rendered),
placed AS (SELECT doc_id, unnest(f) AS word, generate_subscripts(f, 1) AS place FROM (
  SELECT doc_id, list_filter(t, lambda w: length(w) > 3 AND NOT list_contains({c.sql_list(fixed.STOP_WORDS)}, w)) AS f FROM tokens)),
named AS (SELECT doc_id, string_agg(word, ' ' ORDER BY n DESC, place) AS keywords FROM (
  SELECT * FROM (SELECT doc_id, word, count(*) AS n, min(place) AS place FROM placed GROUP BY doc_id, word)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) <= 5) GROUP BY doc_id)
SELECT doc_id, sentiment, confidence, score, coalesce(keywords, '') AS keywords FROM voted LEFT JOIN named USING (doc_id)"""),
    "theme_model": Query(theme_model),
}
