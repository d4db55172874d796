"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="framewright-")
    return f"{root}/{kind}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes a table that several branches of a plan read, so that it is computed once and its lineage ends there.

    Such a table grows with the data, and its files say little about its size:
    rows that repeat themselves take a hundred times as much in memory.  So joins
    with it, and with what is grouped or filtered from it, are merged and never
    broadcast through the driver.
    """
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return merged(df.sparkSession.read.schema(df.schema).parquet(path))


def merged(df: DataFrame) -> DataFrame:
    """Asks that joins with the table sort and merge both sides, whatever its files' size; a hint ends at a join or a union."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str, rows: int = 200_000) -> DataFrame:
    """Deals rows by a key into tasks of about so many, and as many tasks as there are cores at least.

    Groups and windows whose keys begin with it then stay where they are.
    Adaptive execution leaves the number as it is: it would join partitions by
    compressed bytes, which say little about the rows that are made of them.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, name: str) -> DataFrame:
    """Each row with the first row of ``table`` that has its keys, as a struct ``name`` of the other columns; null where there is none.

    The first is the one with the smallest ``position``, or the smallest by all
    columns where there is none.  Keys that are null find nothing.  Both tables
    are sorted together, not joined: where they are dealt by one of the keys,
    nothing is shuffled.
    """
    rest = [c for c in table.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hits = table.select(*keys, F.when(known, F.struct(*rest)).alias("_hit"))
    own = rows.select(*keys, F.struct(*(c for c in rows.columns if c not in keys)).alias("_row"))
    both = hits.select("*", F.lit(None).cast(own.schema["_row"].dataType).alias("_row")).unionByName(own.select("*", F.lit(None).cast(hits.schema["_hit"].dataType).alias("_hit")))
    order = Window.partitionBy(*keys).orderBy(F.col("_row").isNotNull(), "_hit.position" if "position" in rest else "_hit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return both.withColumn("_hit", F.first("_hit").over(order)).filter("_row is not null").select(*keys, "_row.*", F.col("_hit").alias(name))
