"""Toxicity by cumulative-link ordinal regression on sparse word features.

Severity grades 0..G are modelled as P(grade > g) = sigmoid(w . x - theta_g) with one weight vector for all ordered
thresholds; x marks the distinct words of a text. The expected severity is the sum of these probabilities. The fit uses a
bounded sample of labelled rows (`sample_per_grade` of each grade, in a seeded order, weighted back to the counts of
all labels); the vocabulary is the sample's words that occur in at least `min_df` of its texts and whose score statistic
against equal grades is at least `min_z` in size, as weights of words seen by chance would only repeat the sample. Every
document is scored.

Scoring reads each text once, without a shuffle; the model is at most the sample's vocabulary.
Defined cases: labels that are null or have no document are left out; with labels of one grade only every score is 0; null and
empty texts have no words and get the intercept alone (severity 0 without a model); repeated rows are scored alike; a
column of the input with a result's name is replaced; a very long text is held whole, with some tens of bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vereda.llm import _text as t
from vereda.llm._work import widened

SAMPLE_PER_GRADE, MIN_DF, MIN_Z, L2, STEPS, REJECT, SEED = 4000, 5, 5.0, 0.3, 200, 0.25, 20240609
ADDED = "p_toxic double, severity double, grade int, toxic boolean"


@dataclass
class Ordinal:
    """Sorted word hashes, their weights and the ordered thresholds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for each threshold g (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = t.words(buf, offs, t.ALNUM)
    return t.range_hash(t.prefix_hash(buf, lower=True), starts, ends), first


def fit(rows: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, min_df: int = MIN_DF, min_z: float = MIN_Z, l2: float = L2, steps: int = STEPS) -> Ordinal | None:
    """rows: distinct word hashes of each text. Score screening, then full-batch Adam on the weighted log likelihood."""
    grades = int(grade.max(initial=0))
    if not grades or grade.min() == grades:
        return None
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    vocabulary, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    mean = grade.mean()
    score = np.bincount(col, (grade - mean)[row]) / np.sqrt(df * max(grade.var(), 1e-12))
    chosen = (df >= min_df) & (np.abs(score) >= min_z)
    if not chosen.any():
        return None
    number = np.cumsum(chosen) - 1
    known = chosen[col]
    vocabulary, row, col = vocabulary[chosen], row[known], number[col[known]]
    weight = weight / weight.sum()
    share = np.array([(weight * (grade > g)).sum() for g in range(grades)]).clip(1e-6, 1 - 1e-6)
    start = np.maximum.accumulate(np.log((1 - share) / share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = [np.zeros(len(vocabulary)), start[:1].copy(), gaps]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    at_least, exactly = np.arange(grades)[None, :], grade[:, None]
    for step in range(1, steps + 1):
        w, theta = params[0], np.append(params[1], params[1] + np.cumsum(np.exp(params[2])))
        score = np.bincount(row, w[col], len(rows))
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
        full = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        mass = np.maximum(full[i, grade] - full[i, grade + 1], 1e-12)
        slope = p * (1 - p) * ((at_least == exactly - 1).astype(float) - (at_least == exactly)) / mass[:, None] * weight[:, None]
        d_theta = slope.sum(0)
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = [
            -np.bincount(col, slope.sum(1)[row], len(w)) + l2 * w / len(rows),
            np.array([tail[0]]),
            tail[1:] * np.exp(params[2]),
        ]
        for k, g in enumerate(gradient):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] - 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    keep = np.abs(params[0]) > 1e-3
    return Ordinal(vocabulary[keep], params[0][keep], np.append(params[1], params[1] + np.cumsum(np.exp(params[2]))))


def train(docs: DataFrame, graded: DataFrame, sample_per_grade: int = SAMPLE_PER_GRADE, seed: int = SEED, **options) -> Ordinal | None:
    """graded: (doc_id, grade int from 0). The driver gets the features of the bounded sample alone."""
    graded = graded.where("doc_id is not null and grade is not null")
    counts = {r.grade: r["count"] for r in graded.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return None
    parts = [graded.where(F.col("grade") == g).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_per_grade) for g in sorted(counts)]
    sample = reduce(DataFrame.union, parts).select(F.col("doc_id").alias("_id"), "grade")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("_id", "grade").agg(F.first("text", ignorenulls=True).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in t.slices(batch.column(1)):
                h, first = word_hashes(buf, offs)
                own = [np.unique(h[first[i] : first[i + 1]]).tobytes() for i in range(high - low)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(own, pa.binary())], ["grade", "words"])

    got = texts.select(F.col("grade").cast("int"), F.col("text").cast("binary")).mapInArrow(t.lean(features), "grade int, words binary").toArrow()
    grade = got.column(0).to_numpy().astype(np.int64)
    if not len(grade):
        return None
    rows = [np.frombuffer(x, np.uint64) for x in got.column(1).to_pylist()]
    order = np.array(sorted(range(len(rows)), key=lambda i: (grade[i], rows[i].tobytes())))
    grade, rows = grade[order], [rows[i] for i in order]
    here = np.bincount(grade)
    weight = np.array([counts[g] / here[g] for g in grade])
    return fit(rows, grade, weight, **options)


def score(docs: DataFrame, model: Ordinal | None, reject: float = REJECT) -> DataFrame:
    """All columns of docs with p_toxic, severity (expected), grade (most likely) and toxic (p_toxic >= reject)."""
    names = [x.split()[0] for x in ADDED.split(", ")]
    docs = docs.drop(*names)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in t.slices(batch.column(place)):
                n = high - low
                above = np.zeros((n, 1))
                if model is not None:
                    h, first = word_hashes(buf, offs)
                    at = np.minimum(np.searchsorted(model.vocabulary, h), len(model.vocabulary) - 1) if len(model.vocabulary) else np.zeros(len(h), int)
                    known = model.vocabulary[at] == h if len(model.vocabulary) else np.zeros(len(h), bool)
                    pair = np.unique(t.rows_of(first)[known] * np.int64(len(model.vocabulary) + 1) + at[known])
                    row, col = np.divmod(pair, len(model.vocabulary) + 1)
                    above = model.above(np.bincount(row, model.weights[col], n))
                each = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
                columns = [np.round(above[:, 0], 6), np.round(above.sum(1), 6), np.argmax(each[:, :-1] - each[:, 1:], axis=1).astype(np.int32), above[:, 0] >= reject]
                part = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, columns)], [*part.schema.names, *names])

    return docs.mapInArrow(t.lean(run), widened(docs, ADDED))
