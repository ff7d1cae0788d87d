import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postlens.functions import links
from postlens.functions import text as tx
from postlens.operators import keywords, scoring


@pytest.mark.parametrize("profile, text, expected", [
    ("sheet", "a<br>b &amp; c", "ab & c"),
    ("labelling", "a<br>b &amp; c", "a b & c"),
    ("feed", "a<br>b &amp; c", "a\nb & c"),
    ("feed", "&lt;b&gt;x", "<b>x"),
    ("sheet", "&lt;b&gt;x", "x"),
    ("sheet", "gÃ¼zel ÅŸey", "güzel şey"),
    ("labelling", "gÃ¼zel ÅŸey", "güzel şey"),
    ("labelling", "Ärger", "ğrger"),
    ("feed", "bu $ok$ tamam", "bu ok tamam"),
    ("sheet", "&amp;quot;x&amp;quot;", '"x"'),
    ("feed", "  iki  boşluk\tve ", "iki  boşluk ve"),
    ("feed", "é", "é"),
    ("sheet", None, None),
    ("labelling", None, ""),
])
def test_clean_profiles(one, profile, text, expected):
    assert one(lambda c: tx.clean(c, profile), text) == expected


def test_strict_labelling_keeps_foreign_letters(one):
    assert one(lambda c: tx.clean(c, "labelling", strict=True), "Ärger på Åland") == "Ärger på Åland"


def test_unknown_profile():
    with pytest.raises(ValueError):
        tx.clean(F.lit("x"), "other")


ALPHABET = "aAıIİiğşçöüâé  \t\n\x0b\x1c\x85\xa0 .?!…,_-'123<>&;😀"


def _texts(n=400):
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def _against(spark, build, plain):
    texts = _texts()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(build(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_squash_and_strip_equal_python(spark):
    _against(spark, tx.squash_ws, lambda t: re.sub(r"\s+", " ", t).strip())
    _against(spark, tx.strip, lambda t: t.strip())


def test_word_tokens_equal_python(spark):
    _against(spark, tx.word_tokens, lambda t: re.findall(r"\b[a-zçğıöşü]+\b", t.lower()))


def test_sentences_equal_python(spark):
    _against(spark, tx.split_sentences, lambda t: [p.strip() for p in re.split(r"[.?!…\n]+", t) if p.strip()])


def test_unescape_nfc_fold_equal_python(spark):
    _against(spark, tx.html_unescape, html.unescape)
    _against(spark, tx.nfc, lambda t: unicodedata.normalize("NFC", t))
    _against(spark, lambda c: tx.fold_label(c, "plain"),
             lambda t: unicodedata.normalize("NFKD", t.strip().lower()).encode("ascii", "ignore").decode())


@pytest.mark.parametrize("mode, expected", [("plain", "saglk"), ("turkish", "saglik")])
def test_fold_label(one, mode, expected):
    assert one(lambda c: tx.fold_label(c, mode), " Sağlık ") == expected


def test_word_tokens_fixture(one):
    text = "İstanbul'da IŞIK âlem abc123 çok_güzel güzel-ürün"
    assert one(tx.word_tokens, text) == ["i", "stanbul", "da", "işik", "güzel", "ürün"]


def test_last_sentences(one):
    assert one(tx.last_sentence, "Güzel. Ama pahalı!  ") == "Ama pahalı"
    assert one(tx.last_sentence, " .. ") == ""
    many = " . ".join(str(i) for i in range(15))
    assert one(lambda c: tx.last_n(tx.split_sentences(c), c), many) == [str(i) for i in range(5, 15)]
    assert one(lambda c: tx.last_n(tx.split_sentences(c), c), "...") == ["..."]


def test_sentiment_prep_orders(one):
    text = "Çok İYİ (BKZ: pena) https://a.b/c?d=1 bence."
    assert one(tx.sentiment_prep, text).split() == ["Çok", "İYİ", "bence."]
    # Without punctuation neither pattern matches any more.
    assert one(lambda c: tx.sentiment_prep(c, "normalize_first"), text) == "çok iyi bkz pena httpsabcd1 bence"
    assert one(tx.normalize_tr, "IŞIK, kâğıt!  İyi") == "ışık kağıt iyi"


def test_truncation_and_preview(one):
    assert one(lambda c: tx.truncate_tail(c, 3), "abcdef") == "def"
    assert one(lambda c: tx.truncate_tail(c, 9), "abc") == "abc"
    assert one(lambda c: tx.truncate_tokens(c, 2), "a b c") == "b c"
    assert one(lambda c: tx.truncate_tokens(c, 2, "head"), "a  b c") == "a b"
    assert one(tx.preview, "x" * 101) == "x" * 100 + "..."
    assert one(tx.preview, "x" * 100) == "x" * 100
    assert one(lambda c: tx.preview(c, always=True), "kısa") == "kısa..."


def test_links(one):
    base = "https://forum.example.org"
    assert one(links.slugify, "Işık Şöleni 2!") == "isik-soleni-2"
    slug = "/9-kere-leyla--6303813?a=popular"
    assert one(links.id_from_slug, slug) == 6303813
    assert one(links.id_from_slug, "/yok") is None
    assert one(lambda c: links.strip_base_url(links.absolute_url(c, base), base), slug) == slug[1:]
    assert one(lambda c: links.title_from_slug(links.strip_base_url(c, base)), slug) == "9 kere leyla"
    assert one(links.listing_path, "/liste") == "gundem"
    assert one(links.listing_path, "/liste?kanal=spor&p=2") == "kanal/spor?p=2"
    assert one(links.listing_path, "/liste?kanal=k%C4%B1sa%20s%C3%B6z") == "kanal/k%C4%B1sa%20s%C3%B6z"
    assert one(lambda c: links.split_query(c, "/baslik/"), "/baslik/pena--31782?p=2&a=nice").asDict() == {
        "slug": "pena--31782", "query": "p=2&a=nice"}
    assert one(lambda c: links.page_number(c), "/x") == 1


def test_keywords_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "kedi köpek kedi kuş balık köpek")], "id int, text string")
    assert [r["word"] for r in keywords.keyword_rows(df, "id").orderBy("rank").collect()] == ["kedi", "köpek", "balık"]


def test_keywords_equal_counter(spark):
    from collections import Counter
    rng = random.Random(3)
    words = ["elma", "armut", "kiraz", "erik", "ayva", "üzüm", "kavun", "limon", "muz", "olarak", "incir", "vişne"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: [k["word"] for k in r["keywords"]] for r in keywords.with_keywords(df).collect()}
    for i, t in enumerate(texts):
        kept = [w for w in t.split() if len(w) > 3 and w != "olarak"]
        assert got[i] == [w for w, _ in Counter(kept).most_common(8)]


def test_keyword_filter_stays_cheap(spark):
    """A filter on the result is pushed down by copying; the copy must not nest."""
    text = " ".join(f"kelime{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(3000))
    df = spark.createDataFrame([(i, text) for i in range(8)], "id int, text string")
    assert keywords.with_keywords(df).where(F.size("keywords") > 0).count() == 8


def test_lexicon_counts_fixture(one):
    assert one(scoring.lexicon_counts, "çok iyi ve sorunsuz").asDict() == {"pos": 3, "neg": 1}


def test_sql_names(spark):
    from postlens.functions.register import register
    register(spark)
    row = spark.sql("SELECT html_unescape('a &amp; b') AS a, nfc('é') AS b, squash_ws(' x  y ') AS c, strip_tags('<b>z</b>') AS d").first()
    assert tuple(row) == ("a & b", "é", "x y", "z")
    spark.createDataFrame([(1, "Bir. İki! ")], "id int, body string").createOrReplaceTempView("sql_posts")
    rows = spark.sql("SELECT id, s.sent_idx, s.sentence FROM sql_posts, LATERAL split_sentences(body) s").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "Bir"), (1, 1, "İki")]


def test_only_references_leave_the_jvm(spark):
    rng = random.Random(5)
    parts = ["&", "&amp;", "&lt", "&notit;", "&#65;", "&#x41", "&#0;", "é", "\U0001f600", "x", " ", "\n", ";", "#", "&&", "&copy2", "&" + "\U0001f600" * 31]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", tx.html_unescape(F.col("t")).alias("u"))
    assert {r.i: r.u for r in found.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    asked = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in line]
    assert asked and "array<string>" in str(tx._unescape.returnType.simpleString())
