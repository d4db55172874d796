"""Text quality by ordinal regression on hashed words, pairs of words and word shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.ordinal import Ordinal, fit_sample, labelled_sample, score
from framewright.llm.tables import documents
from framewright.llm.text import U, grams, mix64, split_words

BITS = 18
#: Bytes by kind: upper case, lower case (and beyond ASCII), digit; marks stand for themselves.
_KIND = np.arange(256, dtype=np.uint64)
_KIND[[b for b in range(256) if b >= 128 or chr(b).islower()]] = 1
_KIND[[b for b in range(128) if chr(b).isupper()]] = 2
_KIND[[b for b in range(128) if chr(b).isdigit()]] = 3


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of each row: hashed words and pairs of words, word endings and shapes, and repetition.

    Lower-cased words and neighbouring pairs that occur are worth one over the
    root of the row's number of words.  An ending is the kinds of the last three
    bytes; a shape adds the first byte and the length up to 8; their values are
    the shares of the row's words.  Shares of words equal to the word before and
    of distinct words, and the number of words, each in steps, are features of
    value 1.
    """
    for w in split_words(column):
        rows, counts = w.rows_of_words(), w.counts()
        kind = np.concatenate(([U(0)] * 2, _KIND[w.buf], [U(0)]))
        size = w.ends - w.starts
        last = [np.where(size > k, kind[np.maximum(w.ends + 1 - k, 0)], U(0)) for k in range(3)]
        ending = last[0] | last[1] << U(8) | last[2] << U(16)
        shape = ending | _KIND[w.buf[w.starts]] << U(24) | np.minimum(size, 8).astype(np.uint64) << U(32) | U(1 << 40)
        h = w.hashes(lower=True)
        share = 1 / np.maximum(counts, 1)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        words, pairs = _occurring(rows, h ^ U(1 << 50)), _occurring(*_inside(rows, *grams(h, w.offsets, 2)))
        distinct = np.diff(np.searchsorted(words >> BITS, np.arange(w.n_rows + 1)))
        steps = [
            np.minimum(np.bincount(rows, same, w.n_rows) * share * 20, 19).astype(np.uint64) | U(1 << 48),
            np.minimum(distinct * share * 20, 19).astype(np.uint64) | U(2 << 48),
            np.log2(counts + 1).astype(np.uint64) | U(3 << 48),
        ]
        who = np.concatenate((rows, rows, *[np.arange(w.n_rows)] * 3))
        what = (mix64(np.concatenate((ending, shape, *steps))) >> U(64 - BITS)).astype(np.int64)
        occur = np.concatenate((words, pairs))
        much = np.concatenate((share[rows], share[rows], np.ones(3 * w.n_rows), np.sqrt(share[occur >> BITS])))
        codes, at = np.unique(np.concatenate(((who << BITS) | what, occur)), return_inverse=True)
        offsets = np.searchsorted(codes, np.arange(w.n_rows + 1) << BITS)
        yield offsets, codes & ((1 << BITS) - 1), np.bincount(at, much, len(codes))


def _inside(rows: np.ndarray, hashes: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rows[within], hashes[within]


def _occurring(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row and feature number of what occurs in a row, once each, by row."""
    return np.unique((rows << BITS) | (mix64(hashes) >> U(64 - BITS)).astype(np.int64))


#: The rating that ``fit_quality`` calls good, and what follows it: good without repeated lines.
GOOD, GRADES = 1, 3


def rating() -> Column:
    """Ratings from the yes/no label ``grade`` and the text: 0 poor, 1 good, 2 good and less than a tenth of its lines said before."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))
    clean = 10 * (F.size(lines) - F.size(F.array_distinct(lines))) < F.greatest(F.size(lines), F.lit(1))
    return F.when(F.col("grade") <= 0, 0).when(clean, 2).otherwise(1)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, l1: float = 1e-5) -> Ordinal:
    """A model of the ratings of ``rating``, from at most ``max_rows`` documents labelled yes or no."""
    grades = labels.select("doc_id", F.col(label).alias("grade"))
    return fit_sample(labelled_sample(documents(docs), grades, text_features, max_rows, rating()), GRADES, 1 << BITS, l1)


def quality(docs: DataFrame, model: Ordinal, good: int = GOOD, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, expected_grade, p_good`` (grade ``good`` or above), ``selected``.

    ``selected`` is ``p_good >= cut``.  Null and empty texts have no words and are
    judged by that alone.  Rows without an id and repeated rows are scored like
    any other; an empty table gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """

    def outputs(s: np.ndarray) -> dict[str, np.ndarray]:
        p = model.tail(s, good)
        return {"expected_grade": model.expected(s), "p_good": p, "selected": p >= cut}

    return score(docs, model, text_features, outputs, "expected_grade double, p_good double, selected boolean", id_col, text_col)
