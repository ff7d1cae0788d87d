"""Text columns: cleaning profiles, sentence and word splitting, normalization."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens import fixed_values as fixed

# Every character Python's regex class \s covers, spelled for java.util.regex.
SPACE_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
SPACES = f"[{SPACE_CLASS}]+"
SENTENCE_END = r"[.?!…\n]+"


#: Texts that a Python task holds as objects at a time.
SLICE = 256
#: A character reference as ``html.unescape`` finds it.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield pa.array([None if found is None else [html.unescape(x) for x in found] for found in batch.slice(at, SLICE).to_pylist()],
                           pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def _compose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in batch.slice(at, SLICE).to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _decompose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in batch.slice(at, SLICE).to_pylist()], pa.string())


def strip(col: Column) -> Column:
    """Python's ``str.strip()``; Spark's own ``trim`` only knows the plain space."""
    return F.btrim(col, F.lit(fixed.WHITESPACE))


def html_unescape(col: Column) -> Column:
    """Decode named and numeric entities. Only the references of a text leave the JVM."""
    plain = _unescape(F.when(col.contains("&"), F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0))))
    beside = F.arrays_zip(F.split(col, REFERENCE, -1).alias("gap"), plain.alias("plain"))
    parts = F.transform(beside, lambda x: F.concat(x["gap"], F.coalesce(x["plain"], F.lit(""))))
    return F.when(F.size(plain) > 0, F.array_join(parts, "")).otherwise(col)


def nfc(col: Column) -> Column:
    """NFC. Characters below U+0300 never change, so such rows stay in the JVM."""
    return F.coalesce(_compose(F.when(col.rlike(r"[^\x{0}-\x{2ff}]"), col)), col)


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, r"<[^>]+>", "")


def br_to(col: Column, replacement: str, exact: bool = False) -> Column:
    """Line-break tags to ``replacement``; ``exact`` takes only the three literal spellings."""
    pattern = r"<br(?:| ?/)>" if exact else rf"<br[{SPACE_CLASS}]*/?>"
    return F.regexp_replace(col, pattern, replacement)


def replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, col)


def repair_mojibake(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Repair wrongly decoded UTF-8; only rows that hold a lead character are touched."""
    return F.when(col.rlike("[ÃÄÅâ]"), replace_all(col, pairs)).otherwise(col)


def strip_dollar_marks(col: Column) -> Column:
    return F.regexp_replace(col, r"\$([\p{L}\p{N}_]{1,10})\$", "$1")


def squash_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACES, " "))


def clean(col: Column, profile: str, strict: bool = False) -> Column:
    """Clean one text column.

    ``sheet``      tags vanish without a trace, nulls stay null.
    ``labelling``  line breaks become a space, nulls become ``''``; ``strict``
                   leaves genuine Nordic and German letters alone.
    ``feed``       line breaks become newlines and entities are decoded last,
                   so an escaped tag survives as text.
    """
    if profile == "sheet":
        text = strip_tags(html_unescape(col))
        text = replace_all(repair_mojibake(text, fixed.SHEET_REPAIRS), fixed.SHEET_ENTITIES)
        return squash_ws(text)
    if profile == "labelling":
        pairs = fixed.LABELLING_REPAIRS + ([] if strict else fixed.LABELLING_LOSSY_REPAIRS)
        text = strip_tags(br_to(html_unescape(F.coalesce(col, F.lit(""))), " "))
        return squash_ws(repair_mojibake(text, pairs))
    if profile == "feed":
        text = nfc(html_unescape(strip_tags(br_to(col, "\n", exact=True))))
        return strip(F.regexp_replace(strip_dollar_marks(text), r"[\t\r\f]+", " "))
    raise ValueError(f"unknown cleaning profile: {profile}")


def lower_tr(col: Column) -> Column:
    """Lower case with the Turkish pairs I/ı and İ/i."""
    return F.lower(replace_all(col, [("I", "ı"), ("İ", "i")]))


def normalize_tr(col: Column) -> Column:
    """Turkish lower case without circumflexes, punctuation and repeated spaces."""
    text = lower_tr(F.coalesce(col.cast("string"), F.lit("")))
    folded = replace_all(text, [("â", "a"), ("î", "i"), ("û", "u"), ("ê", "e"), ("ô", "o")])
    return squash_ws(F.regexp_replace(folded, r"[\p{P}\p{S}]", ""))


def drop_references(col: Column) -> Column:
    """Remove ``(bkz: …)`` cross references and web addresses.

    Most texts hold neither; a plain substring test keeps the patterns off them.
    """
    no_refs = F.regexp_replace(col, rf"(?iu)\(bkz:[{SPACE_CLASS}]*[^)]+\)", " ")
    text = F.when(col.contains("("), no_refs).otherwise(col)
    return F.when(col.contains("://"), F.regexp_replace(text, rf"https?://[^{SPACE_CLASS}]+", " ")).otherwise(text)


def sentiment_prep(col: Column, order: str = "references_first") -> Column:
    """Prepare a text for scoring.

    ``references_first`` removes cross references and addresses while their
    punctuation is still there and keeps sentence ends for the splitter.
    ``normalize_first`` runs the normalizer before everything else.
    """
    if order == "normalize_first":
        return squash_ws(drop_references(normalize_tr(col)))
    if order == "references_first":
        return strip(F.coalesce(drop_references(col), F.lit("")))
    raise ValueError(f"unknown order: {order}")


def truncate_tail(col: Column, n: int = 1024) -> Column:
    """The last ``n`` characters."""
    return F.right(col, F.lit(n))


def truncate_head(col: Column, n: int = 1024) -> Column:
    return F.left(col, F.lit(n))


def truncate_tokens(col: Column, n: int = 512, keep: str = "tail") -> Column:
    """Keep the last or first ``n`` space-separated tokens; shorter texts are untouched."""
    tokens = F.split(col, SPACES)
    kept = F.slice(tokens, -n, n) if keep == "tail" else F.slice(tokens, 1, n)
    return F.when(F.size(tokens) > n, F.array_join(kept, " ")).otherwise(col)


def preview(col: Column, n: int = 100, always: bool = False) -> Column:
    """First ``n`` characters with ``...`` behind (only when longer, unless ``always``)."""
    short = F.concat(F.substring(col, 1, n), F.lit("..."))
    return short if always else F.when(F.length(col) > n, short).otherwise(col)


def split_sentences(col: Column) -> Column:
    """Sentences in order, stripped, without blanks."""
    return F.filter(F.transform(F.split(col, SENTENCE_END), strip), lambda s: s != "")


def last_sentence(col: Column) -> Column:
    return F.coalesce(F.try_element_at(split_sentences(col), F.lit(-1)), F.lit(""))


def last_n(sentences: Column, text: Column, n: int = fixed.MAX_SENTENCES) -> Column:
    """The last ``n`` sentences, or the whole text as one when there is none."""
    size = F.size(sentences)
    tail = F.slice(sentences, F.greatest(size - n + 1, F.lit(1)), F.lit(n))
    return F.when(size == 0, F.array(text)).otherwise(tail)


def word_tokens(col: Column) -> Column:
    """Words made only of the letters a-z and çğıöşü; words with anything else vanish."""
    bound = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(F.lower(col), F.lit(rf"(?<!{bound})[a-zçğıöşü]++(?!{bound})"), F.lit(0))


def drop_stopwords(tokens: Column, stop_words: list[str] = fixed.STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words)))


def fold_label(col: Column, mode: str = "turkish") -> Column:
    """Comparable spelling of a label: stripped, lower, straight apostrophes, ASCII only.

    ``turkish`` first maps ı to i; ``plain`` drops it like any other character
    without a decomposition.
    """
    text = F.translate(F.lower(strip(col)), "’‘", "''")
    if mode == "turkish":
        text = F.translate(text, "ı", "i")
    elif mode != "plain":
        raise ValueError(f"unknown mode: {mode}")
    wide = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.regexp_replace(F.coalesce(_decompose(wide), text), r"[^\x00-\x7F]", "")
