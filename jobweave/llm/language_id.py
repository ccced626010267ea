"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def held_out(key: Column) -> Column:
    """Documents that no model learns from: a quarter, by crc32 of the key as text; not those without a key."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram of a lower-cased text, given as code points; every run of other
    characters than letters counts as one space."""
    out = []
    for n in ORDERS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ data[k:len(data) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h % np.uint64(BUCKETS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one space between, before and after words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter(codes)
    spaced = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others only the first stays
    spaced = spaced[keep]
    return np.concatenate([[np.uint64(32)], spaced]) if len(spaced) else np.empty(0, np.uint64)


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_TABLE: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0][codes]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (language, bucket) of a task's documents."""
    totals: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def add(lang: str) -> None:
        counts = np.bincount(np.concatenate(waiting.pop(lang)), minlength=BUCKETS)
        totals[lang] = totals[lang] + counts if lang in totals else counts

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting.setdefault(lang, []).append(_grams(_letters(text)))
            documents[lang] = documents.get(lang, 0) + 1
            if len(waiting[lang]) >= 100:
                add(lang)
    for lang in list(waiting):
        add(lang)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield _counted(lang, at, counts[at])
        yield _counted(lang, np.array([-1]), np.array([documents[lang]]))  # bucket -1: documents


def _counted(lang: str, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """Languages in order and the matrix of log probabilities, one row for each bucket."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_prob, self.log_prior = langs, log_prob, log_prior

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text.  Grams of many texts are scored together."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, lengths = [], []
        for text in texts:
            g = _grams(_letters(text or ""))
            grams.append(g)
            lengths.append(len(g))
        lengths = np.array(lengths)
        flat = np.concatenate(grams) if grams else np.empty(0, np.int32)
        sums = np.zeros((len(texts), len(self.langs)))
        some = lengths > 0
        if some.any():
            starts = (np.cumsum(lengths) - lengths)[some]
            for k in range(len(self.langs)):
                sums[some, k] = np.add.reduceat(self.log_prob[k][flat], starts)
        sums += self.log_prior
        best = sums.argmax(axis=1)  # the first of equals, in the order of the names
        p = 1 / np.exp(sums - sums[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, p, 0.0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Count the n-grams of every labelled text and turn them into log probabilities.

    Rows with a null text or language are left out; an empty text counts as a document without
    grams, a very long one is counted whole, repeated rows count each time.  An empty table gives a model
    that knows no language.  Only the two named columns are read, whatever the others are called.
    What comes to the driver has at most BUCKETS
    numbers for each language; that, and nothing else, is broadcast with the scoring function.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    matrix, prior = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    which = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    grams = at >= 0
    matrix[which[grams], at[grams]] = n[grams]
    prior[which[~grams]] = n[~grams]
    matrix += smoothing
    log_prob = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(names, log_prob, np.log(prior / prior.sum()) if len(names) else prior)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every document; ``und`` with score 0 for a text without letters.

    Only the text is looked at.  A null text has no letters.  Repeated rows give repeated
    results; of languages with equal probability the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_prob, model.log_prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for first in range(0, len(texts), 100):
                found, p = scorer.score(texts[first:first + 100])
                langs += found
                scores.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", key)
