"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

A row is judged by its own text: rows that repeat an id stay or go each by
itself, and so do rows without an id, which yield to rows with one.  Of rows
equal in id and text one stays.  Empty and null texts are equal texts, so one of
them stays; texts are read whole, however long.  An empty table passes every
stage and gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.decontaminate import decontaminated
from framewright.llm.exact_dedup import exact_duplicates
from framewright.llm.near_dedup import near_duplicates
from framewright.llm.packing import pack_documents
from framewright.llm.tables import Scratch, read
from framewright.llm.toxicity import fit_toxicity, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key by id (none last) and text, which operators take as the id."""
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")).alias("_key"))


def _flat(key: str) -> list[Column]:
    return [F.col(f"{key}.missing").alias("_missing"), F.coalesce(f"{key}.doc_id", F.lit(0)).alias("_id"), F.col(f"{key}.row").alias("_row")]


def _without(docs: DataFrame, flagged: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` that are not ``flagged`` (by their key, as ``doc_id``); if ``once``, one of those with equal keys."""
    key = ["_missing", "_id", "_row"]
    left = docs.select(*COLUMNS, *_flat("_key")).join(flagged.select(*_flat("doc_id")).distinct(), key, "left_anti")
    return (left.dropDuplicates(key) if once else left).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic; each is judged, whole, where it is read."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return toxicity(rows, model, id_col="row").filter("not toxic").select("doc_id.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    docs = _keyed(docs)
    return _without(docs, exact_duplicates(docs, id_col="_key").filter("not kept"), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    docs = _keyed(docs)
    return _without(docs, near_duplicates(docs, id_col="_key").filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; each is judged, whole, where it is read."""
    return decontaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_rest),
]

#: No SQL for the learned, sketched and tokenised stages; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark), read(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
