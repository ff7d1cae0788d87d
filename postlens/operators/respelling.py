"""Letters that were typed without their marks, restored by what the corpus writes.

A noisy channel: marks are lost by folding letters, and a text is restored as
the likeliest sequence of known forms that folds to it. ``learn`` counts the
forms of every folded word and the pairs of neighbours that can decide between
forms, or takes a word table. ``restore`` asks for the forms of a text's words
and the counts of its pairs of neighbours, and then follows the best path
through the text. What is frequent every task holds, within a bound; the rest is
joined. Filters of fixed size tell where a word can be other than its most
frequent form, and only there pairs are asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import inf, log1p
from typing import NamedTuple
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import text as tx
from postlens.operators.rows import unnest
from postlens.session import materialize, release_shuffles

#: Letters and what they are folded to.
TURKISH = ("çğıöşü", "cgiosu")
#: Texts that a Python task holds as objects at a time.
SLICE = 256
#: Sums of logarithms that differ by less are equal but for rounding.
EQUAL = 1e-11
#: Words or pairs that a task counts, or remembers something of, before it lets them go.
HELD = 1 << 18
#: The most frequent words with other forms, and as many pairs, that every task holds.
HOT = 1 << 16
#: Bits of a filter, 16 MB, whatever the number of its keys.
BITS = 1 << 27


class Spelling(NamedTuple):
    """``words``: (folded, forms), forms as (form, n), most frequent first; ``pairs``: (a, b, n) of neighbours of which one has other forms."""

    words: DataFrame
    pairs: DataFrame
    letters: tuple[str, str]


def fold(col: Column, letters: tuple[str, str] = TURKISH) -> Column:
    return F.translate(col, *letters)


def tokens(col: Column) -> Column:
    """Words of a normalised text (see ``text.normalize_tr``)."""
    return F.filter(F.split(col, " ", -1), lambda w: w != "")


def from_words(words: DataFrame, pairs: DataFrame | None = None, letters: tuple[str, str] = TURKISH) -> Spelling:
    """A spelling from a table ``(form, n)`` and, if there is one, ``(a, b, n)`` of neighbours."""
    if pairs is None:
        pairs = words.sparkSession.createDataFrame([], "a string, b string, n long")
    return Spelling(_known_words(words, letters), pairs, letters)


def _known_words(words: DataFrame, letters: tuple[str, str]) -> DataFrame:
    forms = words.groupBy("form").agg(F.sum("n").cast("long").alias("n")).withColumn("folded", fold(F.col("form"), letters))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "form")))
    # A folded word has few forms; one that has itself alone needs no restoring.
    known = forms.groupBy("folded").agg(listed.alias("l")).where((F.size("l") > 1) | (F.col("l")[0]["form"] != F.col("folded")))
    known = known.select("folded", F.transform("l", lambda x: F.struct(x["form"].alias("form"), (-x["neg"]).alias("n"))).alias("forms"))
    return materialize(known, "forms")


def learn(df: DataFrame, column: str = "text", letters: tuple[str, str] = TURKISH) -> Spelling:
    """Count forms and neighbours in normalised texts; a null text has none. Neighbours that have no other form decide nothing and are not counted."""
    texts = df.select(F.col(column).alias("text")).where("text is not null")
    known = _known_words(texts.mapInArrow(_count_words, "form string, n long"), letters)
    bits = _filter(known.where(F.size("forms") > 1).select(_mark("a", F.col("folded"))))
    pairs = texts.mapInArrow(_count_pairs(bits, letters), "pair string, n long").groupBy("pair").agg(F.sum("n").cast("long").alias("n"))
    both = F.split("pair", " ")
    counted = materialize(pairs.select(both[0].alias("a"), both[1].alias("b"), "n"), "neighbours")
    release_shuffles(df.sparkSession)
    return Spelling(known, counted, letters)


class _Remembered(dict):
    """What ``make`` says of a word, for a bounded number of words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= HELD:
            self.clear()
        self[word] = found = self.make(word)
        return found


def _mark(kind: str, text: Column) -> Column:
    """The bit of a text in a filter; ``_among`` looks there."""
    return (F.crc32(F.concat(F.lit(kind), text)) % BITS).alias("at")


def _filter(marks: DataFrame, onto: bytes = b"") -> bytes:
    """The bits ``marks`` (one column), beside those of ``onto``; other texts may share them."""
    at = marks.select((F.col("at") + 1).alias("at")).select("at", F.bitmap_bucket_number("at").alias("bucket"))
    # Narrow rows go to the task of their piece, which is made there and nowhere else.
    pieces = at.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    found = bytearray(onto or BITS // 8)
    for bucket, bits in zip(pieces["bucket"].to_pylist(), pieces["bits"]):
        begin, piece = (bucket - 1) * len(bits.as_buffer()), np.frombuffer(bits.as_buffer(), np.uint8)
        here = np.frombuffer(found, np.uint8)[begin:begin + len(piece)]
        here |= piece
    return bytes(found)


def _among(bits: bytes, key: str) -> int:
    at = crc32(key.encode()) % BITS
    return bits[at >> 3] >> (at & 7) & 1


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in _slices(batches):
        for text in batch.column(0).to_pylist():
            counts.update(_words(text))
        if len(counts) >= HELD:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["form", "n"])
            counts.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["form", "n"])


def _count_pairs(bits: bytes, letters: tuple[str, str]):
    """Neighbours of which one may have another form, with their counts."""
    table, sent = str.maketrans(*letters), compress(bits, 1)

    def counted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = decompress(sent)
        choice = _Remembered(lambda w: _among(bits, "a" + w.translate(table)))
        counts: Counter = Counter()
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                words = _words(text)
                may = [choice[w] for w in words]
                counts.update([f"{a} {b}" for a, b, x, y in zip(words, words[1:], may, may[1:]) if x or y])
                if len(counts) >= HELD:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)
    return run


def best_path(forms: list[list[tuple[str, int]]], pairs: list[dict[tuple[str, str], int]]) -> list[str]:
    """The forms, one per word, with the largest sum of log(1 + n) over words and over pairs of neighbours.

    Of equal paths the one with the earlier forms, from the last word back.
    """
    last, back = [], []
    for i, options in enumerate(forms):
        if not i:
            last = [log1p(n) for _, n in options]
            continue
        before, near = forms[i - 1], pairs[i - 1]
        if len(before) == len(options) == 1:
            # What all paths gain alike decides nothing.
            back.append([0])
            continue
        now, came = [], []
        for b, n in options:
            best, at = -inf, 0
            for k, (a, _) in enumerate(before):
                score = last[k] + (log1p(near[a, b]) if (a, b) in near else 0.0)
                if score > best + EQUAL:
                    best, at = score, k
            now.append(best + log1p(n))
            came.append(at)
        # Scores stay small, so that rounding does not tell equal paths apart.
        top = max(now)
        last = [x - top for x in now]
        back.append(came)
    at, path = next((k for k, x in enumerate(last) if x >= max(last) - EQUAL), 0), []
    for i in range(len(forms) - 1, -1, -1):
        path.append(forms[i][at][0])
        at = back[i - 1][at] if i else 0
    return path[::-1]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))


def _merge(keys: int):
    """Rows ``(keys…, texts, held)`` of texts that share their keys, to ``(keys…, text, copies)``: read word by word beside each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, copies = [], []
            for texts, held in zip(*[c.to_pylist() for c in batch.columns[keys:]]):
                known = {h["_word"]: [(o["form"], o["n"]) for o in h["forms"]] for h in held or []}
                rows.append(" ".join(w for *_, w in sorted((i, known.get(w) or [(w, 0)], w) for text in texts for i, w in enumerate(_words(text)))))
                copies.append(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array(rows, pa.string()), pa.array(copies, pa.int32())],
                                             [*batch.schema.names[:keys], "_text", "_copies"])
    return run


def _each_once(df: DataFrame, spelling: Spelling, keys: list[str]) -> DataFrame:
    """``(keys…, text, copies)`` with one row to its keys."""
    repeated = materialize(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "repeated")
    if repeated.isEmpty():
        return df.select(*keys, "_text", F.lit(1).alias("_copies"))
    shared = df.join(repeated, keys, "left_semi").select(*keys, "_text")
    words = unnest(shared.select(*keys, tokens(F.col("_text")).alias("_all")), keys, F.array_distinct("_all"), "_word").where(
        fold(F.col("_word"), spelling.letters) == F.col("_word")).distinct()
    met = words.join(spelling.words.withColumnRenamed("folded", "_word"), "_word")
    held = met.groupBy(*keys).agg(F.collect_list(F.struct("_word", "forms")).alias("_held"))
    texts = shared.groupBy(*keys).agg(F.collect_list("_text").alias("_texts")).join(held, keys, "left").select(*keys, "_texts", "_held")
    out = T.StructType([*df.select(*keys).schema.fields, T.StructField("_text", T.StringType()), T.StructField("_copies", T.IntegerType())])
    merged = materialize(texts.mapInArrow(_merge(len(keys)), out), "merged")
    return df.join(repeated, keys, "left_anti").select(*keys, "_text", F.lit(1).alias("_copies")).unionByName(merged)


def _beside_minor(bits: bytes):
    """Bits of a pair, ``(bit of a, bit of b, bit if b is, bit if a is)``, whose word may not be the most frequent of its forms."""
    sent = compress(bits, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(decompress(sent), np.uint8)
        for batch in batches:
            of_a, of_b, left, right = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            found = [at[(held[own >> 3] >> (own & 7).astype(np.uint8) & 1) == 1] for own, at in ((of_b, left), (of_a, right))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], ["at"])
    return run


class _Sources(NamedTuple):
    """What every task holds, as it is sent to them: the filter, and what is said of frequent words and of frequent folded pairs."""

    bits: bytes
    hot: bytes
    letters: tuple[str, str]

    def opened(self) -> tuple[bytes, list[tuple[str, str]]]:
        hot = pa.ipc.open_stream(decompress(self.hot)).read_all()
        return decompress(self.bits), list(zip(hot["_ask"].to_pylist(), hot["_said"].to_pylist()))


def _sent(bits: bytes, hot: pa.Table, letters: tuple[str, str]) -> _Sources:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, hot.schema) as stream:
        stream.write_table(hot)
    return _Sources(compress(bits, 1), compress(out.getvalue(), 1), letters)


def _places(words: list[str], chosen, folded, bits: bytes) -> list[int]:
    """Places of the words (those ``chosen`` says) that may be other than their most frequent form.

    A form that was never met beside either neighbour counts no more than the
    most frequent one, whatever those are; so the path never takes it.
    """
    last = len(words) - 1
    return [i for i, w in enumerate(words) if chosen(w) and (
        (i and _among(bits, f"l{folded[words[i - 1]]} {w}")) or (i < last and _among(bits, f"r{w} {folded[words[i + 1]]}")))]


def _ask(keys: int, sources: _Sources, neighbours: bool):
    """Rows ``(keys…, text)`` to ``(keys…, ask)``: the words, and the folded pairs, that the text needs to be told of."""
    table = str.maketrans(*sources.letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent = sources.opened()
        hot = {ask for ask, _ in frequent}
        folded = _Remembered(lambda w: w.translate(table))
        wanted = _Remembered(lambda w: w not in hot and w.translate(table) == w and _among(bits, "k" + w))
        choice = _Remembered(lambda w: w.translate(table) == w and _among(bits, "a" + w))
        for batch in _slices(batches):
            rows, at = [], []
            for place, text in enumerate(batch.column(keys).to_pylist()):
                words = _words(text)
                asked = [w for w in set(words) if wanted[w]]
                if neighbours:
                    pairs = set()
                    for i in _places(words, choice.__getitem__, folded, bits):
                        pairs.update(f"{folded[a]} {folded[b]}" for a, b in zip(words[max(i - 1, 0):i + 1], words[max(i, 1):i + 2]))
                    asked += [p for p in pairs if p not in hot]
                rows += asked
                at += [place] * len(asked)
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:keys]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.string())], [*batch.schema.names[:keys], "_ask"])
    return run


def _heard(said: str, words: dict[str, list], counts: dict[tuple[str, str], int], table: dict) -> None:
    """Take ``" form n form n…"`` of a word or ``"a b n…"`` of a pair."""
    parts = said.split(" ")
    if parts[0]:
        for a, b, n in zip(parts[::3], parts[1::3], parts[2::3]):
            counts[a, b] = counts.get((a, b), 0) + int(n)
    else:
        words[parts[1].translate(table)] = [(form, int(n)) for form, n in zip(parts[1::2], parts[2::2])]


def _follow(keys: int, sources: _Sources, neighbours: bool):
    """Rows ``(keys…, value, copies)``, to each text's keys first what it asked for, without copies, then the text, to ``(keys…, restored)``."""
    table = str.maketrans(*sources.letters)

    def restored(text: str, bits: bytes, hot: dict, frequent: dict, words: dict, counts: dict, folded: dict) -> str:
        found = _words(text)
        path = [known[0][0] if (known := frequent.get(w) or words.get(w)) else w for w in found]
        if not neighbours:
            return " ".join(path)
        places = _places(found, lambda w: len(frequent.get(w) or words.get(w) or ()) > 1, folded, bits)
        told = set()
        for at, i in enumerate(places):
            if at and places[at - 1] == i - 1:
                continue
            # Words that have no choice on both sides part the text: what is between them is decided there.
            end = at
            while end + 1 < len(places) and places[end + 1] == places[end] + 1:
                end += 1
            begin, stop = max(i - 1, 0), min(places[end] + 2, len(found))
            for a, b in zip(found[begin:stop], found[begin + 1:stop]):
                pair = f"{folded[a]} {folded[b]}"
                if pair in hot and pair not in told:
                    told.add(pair)
                    _heard(hot[pair], {}, counts, table)
            options = [frequent.get(w) or words[w] if i <= k <= places[end] else [(path[k], 0)] for k, w in enumerate(found[begin:stop], begin)]
            path[begin:stop] = best_path(options, [counts] * len(options))
        return " ".join(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = _Remembered(lambda w: w.translate(table))
        frequent: dict[str, list] = {}
        hot: dict[str, str] = {}
        bits, listed = sources.opened()
        for ask, said in listed:
            if said[0] == " ":
                _heard(said, frequent, {}, table)
            else:
                hot[ask] = f"{hot[ask]} {said}" if ask in hot else said
        words: dict[str, list] = {}
        counts: dict[tuple[str, str], int] = {}
        for batch in _slices(batches):
            rows, at = [], []
            for place, (value, copies) in enumerate(zip(*[c.to_pylist() for c in batch.columns[keys:]])):
                if copies is None:
                    _heard(value, words, counts, table)
                    continue
                rows += [restored(value, bits, hot, frequent, words, counts, folded)] * copies
                at += [place] * copies
                words, counts = {}, {}
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:keys]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.string())], [*batch.schema.names[:keys], "restored"])
    return run


def restore(df: DataFrame, spelling: Spelling, keys: list[str], column: str = "text", neighbours: bool = True) -> DataFrame:
    """``(keys…, restored)`` of normalised texts; ``keys`` tell the texts apart.

    A word that has marks already, or that no known form folds to, stays. With
    ``neighbours`` the best path decides, else each word's most frequent form
    (ties by form). A null or empty text is restored as the empty text.

    A text asks once for each of its different words that may change, and for
    each of its different pairs of neighbours beside a word that may be other
    than its most frequent form, unless all tasks hold them.
    """
    # Rows without keys are none that could be told apart.
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    texts = df.select(*keys, F.coalesce(F.col(column), F.lit("")).alias("_text"))
    rows = _each_once(texts.where(whole), spelling, keys)
    words = spelling.words.where(fold(F.col("folded"), spelling.letters) == F.col("folded"))
    if not neighbours:
        words = words.where(F.col("forms")[0]["form"] != F.col("folded")).withColumn("forms", F.slice("forms", 1, 1))
    listed = F.concat(F.lit(" "), F.array_join(F.transform("forms", lambda x: F.concat_ws(" ", x["form"], F.coalesce(x["n"], F.lit(0)))), " "))
    parts = words.select(F.col("folded").alias("_ask"), listed.alias("_said"), F.aggregate("forms", F.lit(0).cast("long"), lambda x, y: x + y["n"]).alias("n"))
    hot = parts.orderBy(F.desc("n")).limit(HOT).select("_ask", "_said").toArrow()
    marks = [words.select(_mark("k", F.col("folded")))]
    if neighbours:
        folded = [fold(F.col(x), spelling.letters) for x in ("a", "b")]
        counted = spelling.pairs.where("a is not null and b is not null")
        pairs = counted.select(F.concat_ws(" ", *folded).alias("_ask"), F.concat_ws(" ", "a", "b", F.coalesce("n", F.lit(0))).alias("_said"), "n")
        # All counts of a folded pair go together.
        frequent = materialize(pairs.orderBy(F.desc("n")).limit(HOT).select("_ask").distinct(), "frequent-pairs")
        hot = pa.concat_tables([hot, pairs.join(F.broadcast(frequent), "_ask").select("_ask", "_said").toArrow().cast(hot.schema)])
        parts = parts.unionByName(pairs)
        several = words.where(F.size("forms") > 1)
        minor = unnest(several, [], F.slice("forms", F.lit(2), F.size("forms")), "x")
        marks += [several.select(_mark("a", F.col("folded"))), minor.select(_mark("m", F.col("x.form")))]
    bits = _filter(reduce(DataFrame.unionByName, marks))
    if neighbours:
        pair = F.concat_ws(" ", *folded)
        beside = counted.select(_mark("m", F.col("a")).alias("a"), _mark("m", F.col("b")).alias("b"), _mark("l", pair).alias("left"), _mark("r", pair).alias("right"))
        bits = _filter(beside.mapInArrow(_beside_minor(bits), "at long"), bits)
    sources = _sent(bits, hot, spelling.letters)
    release_shuffles(df.sparkSession)
    of_key = df.select(*keys).schema.fields
    asked = rows.select(*keys, "_text").mapInArrow(_ask(len(keys), sources, neighbours), T.StructType([*of_key, T.StructField("_ask", T.StringType())]))
    answers = asked.join(parts.select("_ask", "_said"), "_ask").select(*keys, F.col("_said").alias("_value"), F.lit(None).cast("int").alias("_copies"))
    # Each text behind the answers to it.
    both = answers.unionByName(rows.select(*keys, F.col("_text").alias("_value"), "_copies")).repartition(*keys).sortWithinPartitions(
        *keys, F.col("_copies").asc_nulls_first())
    restored = both.mapInArrow(_follow(len(keys), sources, neighbours), T.StructType([*of_key, T.StructField("restored", T.StringType())]))
    return restored.unionByName(texts.where(~whole).select(*keys, F.lit("").alias("restored")))


def normalize_and_restore(df: DataFrame, spelling: Spelling, keys: list[str], column: str = "text") -> DataFrame:
    """``text.normalize_tr`` with its re-spelling step: ``(keys…, restored)``."""
    return restore(df.select(*keys, tx.normalize_tr(F.col(column)).alias(column)), spelling, keys, column)
