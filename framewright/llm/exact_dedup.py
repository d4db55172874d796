"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.tables import Scratch, documents, one_space

#: What must agree before two rows count as equal: SHA-256, code points, an independent hash.
KEY = ("digest", "n_chars", "check")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, the key of the normalised text, and the run (input partition) that the row is in."""
    text = one_space(F.col("text"))
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().cast("long").alias("run"),
    )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent rows of one run and key become one, with the first id and the sum of sizes.

    The rows come sorted; only the last, still open group is carried from batch to batch.
    """
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        raw = t["digest"].combine_chunks()
        at = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
        words = np.frombuffer(raw.buffers()[2], np.int64, 4 * len(raw), int(at[0])).reshape(-1, 4)
        keys = np.column_stack([words, *(t[c].to_numpy() for c in ("run", "n_chars", "check"))])
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        size = np.add.reduceat(t["size"].to_numpy(), first)
        t = t.take(pa.array(first)).set_column(t.schema.get_field_index("size"), t.schema.field("size"), pa.array(size))
        carry = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def merge_runs(runs: DataFrame, n_runs: int, bits: int = 4) -> DataFrame:
    """One row per key, from runs numbered ``0 .. n_runs - 1``.

    A round clears the next ``bits`` bits of each run's number: a run goes to the
    run with those bits zero, as in a binomial reduction, 2**bits runs meet, and
    the merge keeps each key's smallest id.  A run is dealt over tasks by digest,
    so that no task holds a whole run; a key has one row per run at most.
    """
    order = ["run", *KEY, F.col("keep_id").asc_nulls_last()]
    schema = runs.schema
    runs = runs.sortWithinPartitions(*order).mapInArrow(_collapse, schema)
    done = 0
    while True:
        done += bits
        runs = runs.withColumn("run", F.col("run") - F.col("run") % F.lit(1 << done))
        runs = runs.repartition("run", "digest").sortWithinPartitions(*order).mapInArrow(_collapse, schema)
        if 1 << done >= n_runs:
            return runs


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """Groups of equal texts; texts are equal when identical after each run of white space became one space.

    One row per input row: ``doc_id, keep_id`` (smallest id of its group),
    ``group_size, kept`` and ``text_sha256``.  Null texts are empty texts.  Null
    ids are kept as rows; ``keep_id`` is the smallest id that is not null, and
    null only where all are.  Rows that repeat an id are rows of their own: each
    counts in ``group_size``, and all of them with the smallest id are ``kept``.
    An empty table gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """
    spark = docs.sparkSession
    table = Scratch(spark).keep(digests(documents(docs, id_col, text_col)))
    n_runs = (table.agg(F.max("run")).first()[0] or 0) + 1
    runs = table.select("run", *KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    root = merge_runs(runs, n_runs, bits)
    root = root.select(*KEY, "keep_id", F.col("size").alias("group_size"))
    return table.drop("run").join(root, list(KEY), "left").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
