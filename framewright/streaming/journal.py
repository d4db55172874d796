"""A journal that streams append to: every batch is validated against what is stored, and written once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.journal import violations


class JournalError(ValueError):
    """A batch that breaks the journal; nothing of it counts."""


class Journal:
    """Events below ``folder``, by batch, and a ledger of the batches that count.

    A batch is written in full before the ledger names it, so one that was cut off
    between the two does not count and is written over when it comes again; one
    that the ledger names is not written again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def batches(self) -> list[int]:
        """Batches that count; the ledger has one row each."""
        try:
            return sorted(r.batch for r in self.spark.read.parquet(f"{self.folder}/ledger").select("batch").collect())
        except AnalysisException:
            return []

    def events(self) -> DataFrame | None:
        """Stored events, in order by ``arrival`` (batch and place in it); None before the first batch."""
        done = self.batches()
        return self.spark.read.parquet(*(f"{self.folder}/events/{b}" for b in done)) if done else None

    def append(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: raises ``JournalError``, and so fails the batch, if an event breaks a rule of its session's sequence."""
        if number in self.batches():
            return
        new = batch.withColumn("arrival", F.struct(F.lit(number).cast("long").alias("batch"), F.col("arrival").alias("place")))
        new.write.mode("overwrite").parquet(f"{self.folder}/events/{number}")
        new = self.spark.read.parquet(f"{self.folder}/events/{number}")
        stored = self.events()
        whole = new if stored is None else stored.join(new.select("session_id").distinct(), "session_id", "left_semi").unionByName(new)
        # what is stored has no violation, so those found are of the new events
        broken = violations(whole).groupBy("violation").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).orderBy("violation").collect()
        if broken:
            raise JournalError("; ".join(f"{r.violation} ({r.n}, first {r.first})" for r in broken))
        self.commit(number)

    def commit(self, number: int) -> None:
        self.spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch_={number}")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Runs a stream of events to the end of what is there."""
        q = stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
