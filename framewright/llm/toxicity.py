"""Severity of toxic language by ordinal regression on hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.ordinal import Ordinal, fit_sample, labelled_sample, row_sums, score
from framewright.llm.tables import documents
from framewright.llm.text import MARKS, U, split_words

BITS = 18


def distinct_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each row's distinct lower-cased words as feature numbers, all of value 1."""
    for w in split_words(column, MARKS):
        number = (w.hashes(lower=True) >> U(64 - BITS)).astype(np.int64)
        pairs = np.unique((w.rows_of_words() << BITS) | number)
        offsets = np.searchsorted(pairs, np.arange(w.n_rows + 1) << BITS)
        yield offsets, pairs & ((1 << BITS) - 1), np.ones(len(pairs))


def severity(offsets: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades from yes/no labels: 0 clean, 1 toxic, 2 toxic with more marked words than half of the toxic ones.

    Marked words are ten times as frequent among toxic documents as among clean
    ones, and in at least one toxic document of two hundred.  Each half of the
    sample is judged by the words that the other half marks, so that no document
    has a part in its own grade.
    """
    toxic, sizes = (toxic > 0).astype(np.int64), np.diff(offsets)
    half, many = np.arange(len(toxic)) % 2, np.zeros(len(toxic))
    for h in (0, 1):
        rows = np.repeat(np.where(half == h, 0, toxic), sizes)
        clean = np.repeat(np.where(half == h, 0, 1 - toxic), sizes)
        n_bad, n_good = max(int(toxic[half != h].sum()), 1), max(int((1 - toxic)[half != h].sum()), 1)
        bad, good = np.bincount(features, rows, 1 << BITS) / n_bad, np.bincount(features, clean, 1 << BITS) / n_good
        marked = row_sums(offsets, ((bad >= 0.005) & (bad >= 10 * (good + 0.5 / n_good)))[features].astype(float))
        many = np.where(half == h, marked, many)
    middle = np.median(many[toxic == 1]) if toxic.any() else 0
    return np.where(toxic == 1, 1 + (many > middle), 0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 8000, l1: float = 3e-4) -> Ordinal:
    """A model of three severity grades from at most ``max_rows`` labelled documents."""
    grades = labels.select(F.col("doc_id"), F.col(label).alias("grade"))
    return fit_sample(labelled_sample(documents(docs), grades, distinct_words, max_rows), 3, 1 << BITS, l1, severity)


def toxicity(docs: DataFrame, model: Ordinal, cut: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, severity`` (expected grade, 0 to 2), ``p_toxic`` (grade 1 or above), ``toxic``.

    ``toxic`` is ``p_toxic >= cut``.  Null and empty texts have no words and get
    the model's prior.  Rows without an id and repeated rows are scored like any
    other; an empty table gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """

    def outputs(s: np.ndarray) -> dict[str, np.ndarray]:
        p = model.tail(s, 1)
        return {"severity": model.expected(s), "p_toxic": p, "toxic": p >= cut}

    return score(docs, model, distinct_words, outputs, "severity double, p_toxic double, toxic boolean", id_col, text_col)
