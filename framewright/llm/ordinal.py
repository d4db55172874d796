"""Cumulative-link ordinal regression on sparse hashed features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.tables import documents

#: Features of a text column: by row, offsets into feature numbers and values.
Features = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def row_sums(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x), one weight vector for all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        return _sigmoid(self.thresholds[None, :] - scores[:, None])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return (1 - self.at_most(scores)).sum(axis=1)

    def tail(self, scores: np.ndarray, grade: int) -> np.ndarray:
        return 1 - self.at_most(scores)[:, grade - 1]


def fit(offsets: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, dims: int, l1: float, steps: int = 300, rate: float = 0.05) -> Ordinal:
    """Full-batch proximal Adam on the mean negative log-likelihood plus ``l1`` times the weights' absolute sum.

    Thresholds are a first one and positive gaps, so they stay ordered.  Grades
    without samples keep a gap of prior counts; without any sample the model is
    the flat prior.
    """
    counts = np.bincount(grades, minlength=n_grades) + 0.5
    share = np.cumsum(counts)[:-1] / counts.sum()
    start = np.log(share / (1 - share))
    shape = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    used, column = np.unique(features, return_inverse=True)
    w, n = np.zeros(len(used)), max(len(grades), 1)
    m_w, v_w, m_t, v_t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(shape), np.zeros_like(shape)
    sizes = np.diff(offsets)
    for t in range(1, steps + 1 if len(grades) else 1):
        theta = shape[0] + np.concatenate(([0.0], np.cumsum(np.exp(shape[1:]))))
        s = row_sums(offsets, w[column] * values)
        edges = np.concatenate((np.full((len(s), 1), 0.0), _sigmoid(theta[None, :] - s[:, None]), np.full((len(s), 1), 1.0)), axis=1)
        rows = np.arange(len(s))
        high, low = edges[rows, grades + 1], edges[rows, grades]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_w = np.bincount(column, np.repeat(d_high - d_low, sizes) * values, len(w)) / n
        g_theta = np.array([d_low[grades == k + 1].sum() - d_high[grades == k].sum() for k in range(n_grades - 1)]) / n
        g_t = np.concatenate(([g_theta.sum()], [np.exp(shape[k]) * g_theta[k:].sum() for k in range(1, n_grades - 1)]))
        step = rate * min(1.0, 3 * (1 - (t - 1) / steps))
        for x, g, m, v in ((w, g_w, m_w, v_w), (shape, g_t, m_t, v_t)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            scale = step / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
            x -= scale * m / (1 - 0.9**t)
            if x is w:
                np.copyto(x, np.sign(x) * np.maximum(np.abs(x) - scale * l1, 0))
    weights = np.zeros(dims, np.float32)
    weights[used] = w
    return Ordinal(weights, shape[0] + np.concatenate(([0.0], np.cumsum(np.exp(shape[1:])))))


PENALTY_ROWS = 8000
SAMPLE = "grade long, features array<int>, value array<float>"
MODEL = "numbers array<int>, weights array<float>, thresholds array<double>"


def labelled_sample(docs: DataFrame, grades: DataFrame, features: Features, max_rows: int, grade: Column | None = None) -> DataFrame:
    """Features of at most ``max_rows`` labelled documents, chosen by a hash of their ids, and their grades.

    ``grades (doc_id, grade)`` may be null or repeated; the largest grade of a
    document holds, and ``grade`` may refine it by the text.  The chosen ids are
    so few that they are broadcast.
    """
    grades = grades.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("long").alias("grade"))
    # labels may name documents that are not there, so the choice is made among those that are
    known = grades.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for offsets, numbers, values in features(batch.column(2)):
                n = len(offsets) - 1
                at = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                     pa.ListArray.from_arrays(at, pa.array(numbers.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values.astype(np.float32)))],
                    ["doc_id", "grade", "features", "value"])
                first += n

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rated = F.col("grade") if grade is None else grade.cast("long").alias("grade")
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", rated, "text").mapInArrow(run, f"doc_id {id_type}, {SAMPLE}")


def fit_sample(sample: DataFrame, n_grades: int, dims: int, l1: float, regrade: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Ordinal:
    """Fits the sample's rows in one task; only the model, of a fixed size, comes to the driver.

    ``regrade`` makes grades from offsets, features and the sample's grades.
    ``l1`` is the penalty for ``PENALTY_ROWS`` rows; it falls with the root of their number.
    """

    def fitted(rows: pa.Table) -> Ordinal:
        rows = rows.sort_by("doc_id").combine_chunks()
        lists, values, grades = rows["features"].combine_chunks(), rows["value"].combine_chunks(), rows["grade"].to_numpy().astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return fit(offsets, numbers, values.flatten().to_numpy(zero_copy_only=False).astype(float), grades if regrade is None else regrade(offsets, numbers, grades), n_grades, dims, l1 * (PENALTY_ROWS / len(grades)) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if sum(b.num_rows for b in rows):
            model = fitted(pa.Table.from_batches(rows))
            used = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_pydict({"numbers": [used.astype(np.int32)], "weights": [model.weights[used]], "thresholds": [model.thresholds]})

    found = sample.repartition(1).mapInArrow(run, MODEL).toArrow()
    if not found.num_rows:
        none = np.zeros(0, np.int64)
        return fit(np.zeros(1, np.int64), none, none.astype(float), none, n_grades, dims, l1)
    weights = np.zeros(dims, np.float32)
    weights[found["numbers"][0].values.to_numpy()] = found["weights"][0].values.to_numpy()
    return Ordinal(weights, found["thresholds"][0].values.to_numpy().copy())


def score(docs: DataFrame, model: Ordinal, features: Features, outputs: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and what ``outputs`` makes of the scores, one row per input row; the model has a fixed size."""
    docs = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [row_sums(offsets, model.weights[numbers] * values) for offsets, numbers, values in features(batch.column(1))]
            out = outputs(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out.values())], ["doc_id", *out])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")
