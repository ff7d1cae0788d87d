"""Language of a text from averaged hashed subword embeddings and a linear softmax.

A text becomes its lower-cased letters, every stretch of other characters one
blank. Its sequences of one to four of these characters are hashed to buckets;
the mean of the buckets' embeddings goes through a linear softmax. Embeddings
and weights are trained together by stochastic gradient descent in numpy, on
windows of a bounded sample of labelled documents (``SAMPLE`` a language). One
document in five is set aside to calibrate: a temperature makes scores
probabilities, and a score below the rejection threshold is not trusted.

At prediction the embeddings and weights are one table (buckets x languages),
so a text costs one count of its buckets. No shuffle; only the sample's windows
reach the driver and only the table leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Query, stage, table, whole
from postlens.operators.ranking import top_k

BUCKETS = 1 << 15
LONGEST = 4
DIMENSIONS = 16
#: Labelled documents to learn from, per language, and the lengths of the windows taken from each.
SAMPLE = 500
WINDOWS = (12, 40, 150, 600)
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.5, 7
#: Every so-manieth sampled document calibrates.
HELD_BACK = 5
#: Accepted predictions on the calibration windows are wrong at most this often.
MAX_ERROR = 0.01
UNKNOWN = "und"
#: Characters of a text that are worked on at a time.
STRETCH = 1 << 18

_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class LanguageModel(NamedTuple):
    """``weights`` (bucket x language) are embeddings times softmax weights, divided by the temperature like ``bias``."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


# --- features -----------------------------------------------------------------------------------

def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; stretches of other characters, and both ends, are one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    distinct, place = np.unique(points, return_inverse=True)
    keep = np.array([chr(c).isalpha() for c in distinct])[place]
    points = np.where(keep, points, 32).astype(np.uint64)
    return points[keep | np.r_[True, keep[:-1]]]


def buckets(points: np.ndarray) -> np.ndarray:
    """Bucket of every sequence of one to ``LONGEST`` points, blanks alone left out."""
    found, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        h = h[:len(points) - n + 1] * _PRIME + points[n - 1:] + np.uint64(n)
        mixed = h * _MIX
        found.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS) if n > 1 else
                     ((mixed >> np.uint64(40)) % np.uint64(BUCKETS))[points != 32])
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def stretches(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all points, in bounded steps; a sequence that crosses a step counts once."""
    if len(points) <= STRETCH:
        yield buckets(points)
        return
    for start in range(0, len(points), STRETCH):
        both = points[start:start + STRETCH + LONGEST - 1]
        yield buckets(both)
        # What lies wholly in the overlap comes again with the next step.
        if start + STRETCH < len(points):
            yield -1 - buckets(points[start + STRETCH:start + STRETCH + LONGEST - 1])


def mean_scores(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total, n = np.zeros(weights.shape[1]), 0
    for found in stretches(points):
        sign = 1
        if len(found) and found[0] < 0:
            found, sign = -1 - found, -1
        if len(found) > 2048:
            total += sign * (np.bincount(found, minlength=len(weights)) @ weights)
        else:
            total += sign * weights[found].sum(axis=0)
        n += sign * len(found)
    return total / max(n, 1)


def predict(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Language and calibrated probability; ``und`` and 0 for a text without letters or a model without languages."""
    points = letters(text) if text else np.zeros(0, np.uint64)
    if not model.languages or not (points != 32).any():
        return UNKNOWN, 0.0
    p = softmax((mean_scores(points, model.weights) + model.bias)[None, :])[0]
    best = int(p.argmax())
    return model.languages[best], float(min(p[best], 1.0))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- training -----------------------------------------------------------------------------------

def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of sampled texts as distinct buckets with counts; places are drawn by the text's digest."""
    schema = pa.schema([("lang", pa.string()), ("digest", pa.string()), ("window", pa.int32()), ("buckets", pa.list_(pa.int32())),
                        ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        rows = []
        for lang, digest, text in zip(*[c.to_pylist() for c in batch.columns]):
            points = letters(text)
            if not (points != 32).any():
                continue
            rng = np.random.default_rng(int(digest[:15], 16))
            for number, size in enumerate(WINDOWS):
                start = int(rng.integers(max(1, len(points) - size + 1)))
                window = points[start:start + size]
                if (window != 32).any():
                    distinct, counts = np.unique(buckets(window), return_counts=True)
                    rows.append((lang, digest, number, distinct.astype(np.int32), counts.astype(np.int32)))
        columns = zip(*rows) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)


def sample_windows(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Windows of up to ``sample`` labelled documents of every language, those with the least digests of their texts."""
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.md5(F.col(text_col).cast("binary")).alias("digest"), F.col(text_col).alias("text"))
    # Narrow rows choose; only chosen texts travel.
    chosen = stage(top_k(labelled.select("lang", "digest").distinct(), ["lang"], ["digest"], sample).select("lang", "digest"), "sample")
    texts = labelled.join(chosen, ["lang", "digest"], "left_semi").dropDuplicates(["lang", "digest"])
    return texts.select("lang", "digest", "text").mapInArrow(
        _windows, "lang string, digest string, window int, buckets array<int>, counts array<int>")


def fit(samples: list[tuple], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> LanguageModel:
    """Train on ``(language, is calibration, buckets, counts)`` rows, in the given order."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    code = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    kept = [s for s in samples if not s[1]] or samples
    held = [s for s in samples if s[1]] or samples
    # Languages with fewer windows count as much as the others.
    sizes = np.bincount([code[s[0]] for s in kept], minlength=len(languages))
    gain = len(kept) / (len(languages) * np.maximum(sizes, 1))
    steps, step = epochs * -(-len(kept) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(kept))
        for at in range(0, len(order), BATCH):
            batch = [kept[i] for i in order[at:at + BATCH]]
            ids = np.concatenate([s[2] for s in batch])
            share = np.concatenate([s[3] / s[3].sum() for s in batch])
            owner = np.repeat(np.arange(len(batch)), [len(s[2]) for s in batch])
            starts = np.r_[0, np.cumsum([len(s[2]) for s in batch])[:-1]]
            hidden = np.add.reduceat(embeddings[ids] * share[:, None], starts, axis=0)
            target = np.array([code[s[0]] for s in batch])
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(batch)), target] -= 1
            error *= gain[target][:, None]
            speed = rate * (1 - step / steps)
            back = error @ weights.T
            weights -= speed * hidden.T @ error
            bias -= 0.1 * speed * error.sum(axis=0)
            np.add.at(embeddings, ids, -speed * share[:, None] * back[owner])
            step += 1
    logits = np.stack([(s[3] / s[3].sum()) @ (embeddings[s[2]] @ weights) for s in held]) + bias
    target = np.array([code[s[0]] for s in held])
    temperature, threshold = calibrate(logits, target)
    return LanguageModel(languages, embeddings @ weights / temperature, bias / temperature, temperature, threshold)


def calibrate(logits: np.ndarray, target: np.ndarray, max_error: float = MAX_ERROR) -> tuple[float, float]:
    """The temperature with the least log loss, and the least score from which on at most ``max_error`` of predictions are wrong."""
    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean()

    temperature = min(np.exp(np.linspace(-2.5, 2.5, 101)), key=loss)
    p = softmax(logits / temperature)
    best = p.max(axis=1)
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != target[order])
    good = np.flatnonzero(wrong <= max_error * np.arange(1, len(order) + 1))
    return float(temperature), float(best[order[good[-1]]]) if len(good) else 1.0


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """A model of the labelled documents that ``learn`` admits.

    Documents with a null label or text, or without letters, teach nothing; equal
    texts of one label count once. No labelled documents give a model without
    languages. The driver gets four windows of each sampled document.
    """
    rows = sample_windows(docs, learn, text_col, lang_col, sample).collect()
    rows.sort(key=lambda r: (r["digest"], r["lang"], r["window"]))
    return fit([(r["lang"], int(r["digest"][15:23], 16) % HELD_BACK == 0, np.array(r["buckets"]), np.array(r["counts"])) for r in rows])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", reject: bool = False) -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` and ``accepted``.

    The score is the calibrated probability of the language. ``accepted`` tells
    whether it reaches the rejection threshold; with ``reject`` other texts are
    ``und``. A null or empty text, one without letters, and any text under a
    model without languages is ``und`` with score 0, and not accepted. Whole texts
    count, whatever their length; equal texts get equal results, repeated rows
    are rows of their own. Columns of ``docs`` named like the new ones are
    replaced; an empty table gives an empty result.
    """
    new = ["lang_pred", "score", "accepted"]
    kept = [c for c in docs.columns if c.lower() not in [*new, text_col.lower()]]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [predict(known, t) for t in batch.column(len(kept)).to_pylist()]
            accepted = [name != UNKNOWN and score >= known.threshold for name, score in found]
            names = [name if ok or not reject else UNKNOWN for (name, _), ok in zip(found, accepted)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array(accepted, pa.bool_())],
                names=[*kept, *new])

    out = fields.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.select(*kept, whole(F.col(text_col))).mapInArrow(run, out)


def _run(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    # A document without id cannot be told to be outside the fold, so it teaches nothing.
    model = train(docs, F.col("doc_id").isNotNull() & ~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


QUERIES = {"op11_language_id": Query(_run)}
