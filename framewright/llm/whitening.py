"""Whitening of vectors by the eigenvectors of their covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.tables import Scratch

#: Above it, whole-number sums of a row are taken with Python's integers.
SAFE = float(1 << 62)
#: Vectors that one numpy step takes.
STEP = 2_000


def _gram(vectors: DataFrame, name: str, n: int, dims: int) -> np.ndarray:
    """Gramian matrix of an array column, summed on the executors in a tree."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(name).alias(name)), name)
    return RowMatrix(rows, n, dims).computeGramianMatrix().toArray()


def _centred(n: int, sums: list[int]) -> Column:
    return F.zip_with("x", F.array(*map(F.lit, map(float, sums))), lambda v, s: v.cast("double") * float(n) - s)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - sum)^2, exactly; null where it leaves the range of a long."""
    about = x.astype(float) * n - sums
    wide = (np.abs(x.astype(float)) * n + np.abs(sums.astype(float))).max(axis=1, initial=0) >= SAFE
    wide |= (about**2).sum(axis=1) >= SAFE
    out: list[int | None] = ((np.where(wide[:, None], 0, x) * n - sums) ** 2).sum(axis=1).tolist()
    for i in np.flatnonzero(wide).tolist():
        exact = sum((n * a - b) ** 2 for a, b in zip(x[i].tolist(), sums.tolist(), strict=True))
        out[i] = exact if exact < 1 << 63 else None
    return out


def whiten(rows: DataFrame, scale: int = 256, components: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of each vector, one row for a vector and component.

    Entries are taken as the whole numbers ``x = floor(scale * c)``.  The
    covariance is over the distinct ``x`` vectors (divisor: their number ``n``):
    rows ``n x - S``, with ``S`` the sums, are centred without rounding; their
    Gramian over ``n`` is decomposed in the driver (``dims`` squared numbers) and
    the directions are broadcast (the same bound).  Columns: ``vec_id, component``
    (from 1 by falling eigenvalue, at most ``components``), ``n, deviation`` (sum
    of ``(n x - S)^2``, null beyond a long), ``whitened, explained`` (share of the
    trace), ``identity_error`` (largest entry of the whitened list's covariance
    minus the identity, measured over the list).

    Rows whose vector is null or has a null or non-finite entry go.  Vectors
    shorter than the longest count as ending in zeros.  Repeated vectors weigh
    once in the covariance and are all returned; ids may be null or repeat.
    Directions without variance are not returned, so a list of equal vectors,
    like an empty table, gives no rows.  Other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession)
    vector = F.col("_v")
    kept = rows.select(rows[id_col].alias("vec_id"), rows[vector_col].cast("array<double>").alias("_v")).filter(vector.isNotNull() & F.forall(vector, lambda c: F.abs(c) < float("inf")))
    kept = kept.select("vec_id", F.transform(vector, lambda c: F.floor(c * float(scale)).cast("long")).alias("x"))
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = scratch.keep(kept.select("x").distinct())
    width = fit.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    dims = width["most"] or 0
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    if width["least"] < dims:
        padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x")
        kept, fit = kept.select("vec_id", padded), scratch.keep(fit.select(padded).distinct())
    n, *sums = fit.agg(F.count(F.lit(1)), *(F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims))).first()
    covariance = _gram(fit.select(_centred(n, sums).alias("x")), "x", n, dims) / n / float(n) ** 2
    value, direction = np.linalg.eigh(covariance)
    value, direction = value[::-1], direction[:, ::-1]
    rank = int((value > max(value[0], 0) * dims * np.finfo(float).eps).sum())
    count = min(rank, dims if components is None else components)
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    matrix = rows.sparkSession.sparkContext.broadcast(direction[:, :count] / np.sqrt(value[:count]) / float(n))
    total, explained = np.array(sums, np.int64), value[:count] / np.trace(covariance)

    def coordinates(x: np.ndarray) -> np.ndarray:
        return (x.astype(float) * n - total) @ matrix.value

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), STEP):
                yield pd.DataFrame({"w": list(coordinates(np.stack(batch["x"].iloc[a : a + STEP].to_numpy())))})

    error = float(np.abs(_gram(fit.mapInPandas(listed, "w array<double>"), "w", n, count) / n - np.eye(count)).max())

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), STEP):
                part = batch.iloc[a : a + STEP]
                x = np.stack(part["x"].to_numpy())
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].repeat(count).array,
                        "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)),
                        "n": n,
                        "deviation": pd.array(_deviation(x, n, total), "Int64").repeat(count),
                        "whitened": coordinates(x).ravel(),
                        "explained": np.tile(explained, len(x)),
                        "identity_error": error,
                    }
                )

    return kept.mapInPandas(told, schema)
