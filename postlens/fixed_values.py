"""Fixed values.

Word lists, label tables, replacement tables and constants that results depend
on. They are data, not logic: change one and the results change.
"""

# --- fixed values: sentiment phrases (positive) ---
POSITIVE_PHRASES = [
    "tebrik", "tebrikler", "tebrik ederim", "tebrik ediyorum", "harika",
    "mükemmel", "süper", "başarılı", "şahane", "muhteşem", "beğendim",
    "memnun", "iyi", "güzel", "takdir", "takdir ediyorum", "olumlu",
    "pozitif", "seyirlik", "efsane", "kaliteli", "memnun kaldım",
    "tavsiye ederim", "çok iyi", "olumlu izlenim", "fiyat/performans iyi",
    "beklediğim gibi", "sorunsuz", "iyi çalışıyor", "hızlı", "dayanıklı",
    "stabil",
]

# --- fixed values: sentiment phrases (negative) ---
NEGATIVE_PHRASES = [
    "rezalet", "berbat", "kötü", "feci", "iğrenç", "nefret", "beğenmedim",
    "pişman", "yetersiz", "olumsuz", "negatif", "vasat", "saçma", "korkunç",
    "problem", "sorun", "arızalı", "şikayet", "ısınma sorunu",
    "ısınma problemi", "şarjı çabuk bitiyor", "batarya kötü", "donuyor",
    "takılıyor", "yavaş", "geri iade", "iade ettim", "hatalı", "kusurlu",
    "servis kötü", "garanti sorunlu", "memnun değilim",
    "beklentiyi karşılamadı",
]

# --- fixed values: stop words for keyword extraction ---
STOP_WORDS = [
    "bir", "ve", "bu", "da", "de", "için", "ile", "mi", "mı", "mu", "mü",
    "daha", "çok", "ama", "ya", "gibi", "şu", "o", "ki", "her", "ne", "var",
    "yok", "ben", "sen", "biz", "siz", "onlar", "şey", "kadar", "sonra",
    "önce", "artık", "henüz", "bile", "sadece", "ancak", "veya", "ise",
    "eğer", "nasıl", "neden", "niçin", "nerede", "ne zaman", "hiç", "bazen",
    "belki", "mutlaka", "kesinlikle", "zaten", "aslında", "yani", "mesela",
    "örneğin", "şimdi", "böyle", "şöyle", "benim", "senin", "onun", "bizim",
    "sizin", "diye", "demek", "olmak", "etmek", "yapmak", "vermek", "almak",
    "görmek", "buna", "şunu", "bunu", "bunun", "şunun", "olan", "oldu",
    "olur", "olarak",
]

# --- fixed values: theme labels ---
THEME_BY_CODE = {
    "LABEL_0": "Dünya",
    "LABEL_1": "Ekonomi",
    "LABEL_2": "Kültür",
    "LABEL_3": "Sağlık",
    "LABEL_4": "Siyaset",
    "LABEL_5": "Spor",
    "LABEL_6": "Teknoloji",
}
THEME_BY_ENGLISH = {
    "world": "Dünya",
    "economy": "Ekonomi",
    "culture": "Kültür",
    "health": "Sağlık",
    "politics": "Siyaset",
    "sport": "Spor",
    "technology": "Teknoloji",
}
FALLBACK_THEME = "Genel"

# --- fixed values: sentiment codes ---
SENTIMENT_CODES = {"negative": 0, "neutral": 1, "positive": 2}
GOLD_CODES = {
    "negative": 0, "neg": 0, "olumsuz": 0, "-1": 0, "0": 0,
    "neutral": 1, "neu": 1, "nötr": 1, "notr": 1, "1": 1,
    "positive": 2, "pos": 2, "olumlu": 2, "2": 2,
}

# --- fixed values: replacement pairs of the "sheet" cleaner, in order ---
SHEET_REPAIRS = [
    ("Ä±", "ı"), ("Ä°", "İ"),
    ("ÅŸ", "ş"), ("Åž", "Ş"),
    ("Ã§", "ç"), ("Ã‡", "Ç"),
    ("Ã¶", "ö"), ("Ã–", "Ö"),
    ("Ã¼", "ü"), ("Ãœ", "Ü"),
    ("ÄŸ", "ğ"), ("Äž", "Ğ"),
]
SHEET_ENTITIES = [
    ("&#39;", "'"),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]

# --- fixed values: replacement pairs of the "labelling" cleaner, in order ---
LABELLING_REPAIRS = [
    ("Ä±", "ı"), ("Ä°", "İ"),
    ("ÄŸ", "ğ"), ("Äž", "Ğ"),
    ("Ã§", "ç"), ("Ã‡", "Ç"),
    ("ÅŸ", "ş"), ("Åž", "Ş"),
    ("Ã¼", "ü"), ("Ãœ", "Ü"),
    ("Ã¶", "ö"), ("Ã–", "Ö"),
    ("Ã¢", "â"), ("Ã®", "î"), ("Ã»", "û"),
    ("â€™", "'"), ("â€œ", '"'), ("â€", '"'),
    ('â€"', "—"),
    ("â€¦", "..."),
]
# The last pair of the "labelling" cleaner also hits genuine German and Nordic
# letters, so strict mode leaves it out.
LABELLING_LOSSY_REPAIRS = [("Å", "Ş"), ("Ä", "ğ")]

# --- fixed values: vote rule ---
LAST_WEIGHT_SHORT = 1.1   # up to 3 sentences
LAST_WEIGHT_MEDIUM = 2.0  # 4 to 7 sentences
LAST_WEIGHT_LONG = 3.0    # 8 and more
MAX_SENTENCES = 10

# --- fixed values: defaults of missing post fields ---
UNKNOWN_AUTHOR = "Anonim"
TEXT_ONLY_AUTHOR = "Bilinmiyor"

# --- fixed values: whitespace as Python's str.strip() sees it ---
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
