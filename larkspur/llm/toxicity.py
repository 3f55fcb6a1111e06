"""Toxicity scores by a counterfactually regularised classifier.

A text's features are its lower-cased words and the first 4, 5 and 6 bytes of longer words, hashed, each present or not.
A logistic model is fitted to a bounded sample of the labelled texts.  For a sample text that names an identity group a
copy is made in which each such term is swapped for another of its kind; beside the usual loss the fit pays for every
squared change of the logit between the two, so that a neutral mention of a group does not move the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Words, is_held_out, text_blocks

BITS = 20
PREFIXES = (4, 5, 6)
#: Labelled texts that the classifier is fitted to at most, those with the smallest hashes of their ids.
MAX_TRAINING = 5000
MAX_FEATURES = 4000
SCORE_SCHEMA = "doc_id long, score double"

# fixed values: terms of one kind may stand for each other
IDENTITY_TERMS = (
    ("men", "women", "boys", "girls"), ("man", "woman"), ("male", "female", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
_IDENTITY = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(_SWAP, key=len, reverse=True))) + r")(?!\w)")

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[128:] = False
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def swapped(text: str) -> str | None:
    """The lower-cased text with its identity terms swapped; None if it has none."""
    low = text.lower()
    other = _IDENTITY.sub(lambda m: _SWAP[m[1]], low)
    return other if other != low else None


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and prefix, with repeats."""
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(n)), n)
    texts, features = [text], [words.hashes() >> np.uint64(64 - BITS)]
    for length in PREFIXES:
        which, hashes = words.prefix_hashes(length)
        texts.append(text[which])
        features.append(hashes >> np.uint64(64 - BITS))
    return np.concatenate(texts), np.concatenate(features).astype(np.int64)


def _distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.unique((text << BITS) + feature), 1 << BITS)


def _of_text(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(_features(Words(data, np.array([0, len(data)]), True, _SEPARATOR))[1])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        others = [swapped(t) for t in texts]
        features = [_of_text(t).astype(np.int32).tobytes() for t in texts]
        changed = [None if o is None else _of_text(o).astype(np.int32).tobytes() for o in others]
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.binary()), pa.array(changed, pa.binary()), batch.column(1)], ["features", "changed", "toxic"])


def fit(features: list[np.ndarray], changed: list[np.ndarray | None], toxic: np.ndarray, penalty: float = 1.0, ridge: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of all features (most of them 0) and the constant."""
    weights = np.zeros(1 << BITS, np.float32)
    n, positive = len(toxic), float(toxic.sum())
    if not n:
        return weights, 0.0
    if positive in (0, n):
        return weights, float(np.log((positive + 0.5) / (n - positive + 0.5)))
    row, col = np.repeat(np.arange(n), [len(f) for f in features]), np.concatenate(features)
    here = np.bincount(col, minlength=1 << BITS).astype(float)
    hits = np.bincount(col, toxic[row], 1 << BITS)
    expected = here * positive / n
    informative = np.where(here >= 3, (hits - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9), 0)
    chosen = np.argsort(-informative, kind="stable")[:MAX_FEATURES]
    chosen = chosen[informative[chosen] > 6.6]
    index = np.full(1 << BITS, -1)
    index[chosen] = np.arange(len(chosen))

    def matrix(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = index[cols] >= 0
        return rows[use], index[cols[use]]

    row, col = matrix(row, col)
    pairs = [i for i, c in enumerate(changed) if c is not None]
    k = len(pairs)
    row_a, col_a = matrix(np.repeat(np.arange(k), [len(features[i]) for i in pairs]), np.concatenate([features[i] for i in pairs] or [np.empty(0, np.int64)]).astype(np.int64))
    row_b, col_b = matrix(np.repeat(np.arange(k), [len(changed[i]) for i in pairs]), np.concatenate([changed[i] for i in pairs] or [np.empty(0, np.int64)]).astype(np.int64))
    m = len(chosen)
    w, b, mean, square = np.zeros(m + 1), 0.0, np.zeros(m + 1), np.zeros(m + 1)
    w[m] = np.log(positive / (n - positive))
    heavier = np.where(toxic > 0, np.sqrt(max(n - positive, 1) / positive), 1.0)  # half way to equal classes
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], n) + w[m])))
        error = heavier * (p - toxic) / n
        gradient = np.append(np.bincount(col, error[row], m) + ridge * w[:m], error.sum())
        if k:
            change = penalty * (np.bincount(row_a, w[col_a], k) - np.bincount(row_b, w[col_b], k)) / n
            gradient[:m] += np.bincount(col_a, change[row_a], m) - np.bincount(col_b, change[row_b], m)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[chosen] = w[:m]
    b = float(w[m])
    return weights, b


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, most: int = MAX_TRAINING, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Fits the model to at most ``most`` labelled texts outside the held-out ids.

    Documents with contradicting or null labels are not used.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_high")).where("toxic = _high")
    marks = marks.where(~is_held_out(F.col("doc_id"), modulus, remainder)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(marks, "doc_id").select("text", "toxic").mapInArrow(_sample, "features binary, changed binary, toxic int").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["features"])))
    own = lambda data: None if data is None else np.frombuffer(data, np.int32).astype(np.int64)
    return fit([own(r["features"]) for r in rows], [own(r["changed"]) for r in rows], np.array([r["toxic"] for r in rows], float), penalty)


def logits(words: Words, weights: np.ndarray, constant: float) -> np.ndarray:
    text, feature = _features(words)
    some = np.flatnonzero(weights[feature])
    text, feature = _distinct(text[some], feature[some])
    return np.bincount(text, weights[feature], len(words.first) - 1) + constant


def score(docs: DataFrame, weights: np.ndarray, constant: float) -> DataFrame:
    """(doc_id, score) of every whole text; a null text is empty and scores by the constant alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # one float for each of 2^BITS features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                z = logits(Words(buf, offsets, True, _SEPARATOR), sent.value, constant)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCORE_SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Held out are ids whose crc32 mod ``modulus`` is ``remainder``; their labels are never read.  Without labels every
    score is 0.5, with labels of one kind only it is near that kind.  Repeated rows are scored one by one, a null doc_id
    is not held out.  Other columns are ignored; an empty table gives no rows.
    """
    scored = score(docs, *train(docs, labels, modulus, remainder))
    return scored.select("doc_id", is_held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERY = {"op4_toxicity": lambda spark, sf_dir: toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))}
ORACLE = {}
