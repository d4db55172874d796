"""Ordered event journals: validation as violation rows, and replay as one aggregation per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def violations(events: DataFrame) -> DataFrame:
    """``session_id, sequence, event_id, violation``: every rule of the sequence that an event breaks.

    Events carry ``session_id, subject_ref, sequence, event_id, occurred_ms, caused_by``
    and are judged in order of arrival (``arrival``): sequences run 1..n, ids are
    new, the subject stays, time does not move back, a cause has come before.
    """
    order = Window.partitionBy("session_id").orderBy("arrival")
    e = events.withColumn("_n", F.row_number().over(order)).withColumn("_prior", F.lag("occurred_ms").over(order)).withColumn("_subject", F.first("subject_ref").over(order))
    e = e.withColumn("_copy", F.row_number().over(Window.partitionBy("session_id", "event_id").orderBy("arrival")))
    seen = events.groupBy("session_id", F.col("event_id").alias("caused_by")).agg(F.min("arrival").alias("_cause"))
    e = e.join(seen, ["session_id", "caused_by"], "left")
    rules = F.array_compact(F.array(
        F.when(F.col("sequence") != F.col("_n"), "sequence"), F.when(F.col("_copy") > 1, "duplicate-id"), F.when(~F.col("subject_ref").eqNullSafe(F.col("_subject")), "boundary"),
        F.when(F.col("occurred_ms") < F.col("_prior"), "time-backward"), F.when(F.col("caused_by").isNotNull() & (F.col("_cause").isNull() | (F.col("_cause") >= F.col("arrival"))), "unknown-cause")))
    return e.select("session_id", "sequence", "event_id", F.explode(rules).alias("violation"))


def replay(events: DataFrame) -> DataFrame:
    """The state after a session's last event."""
    codes = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("subject_code"))))
    last = lambda c, *kinds: F.max_by(c, F.when(F.col("type").isin(*kinds), F.col("arrival")))
    return events.groupBy("session_id").agg(
        F.min_by("subject_ref", "arrival").alias("subject_ref"), F.max_by("stage", "arrival").alias("stage"), F.count("*").alias("event_count"), F.max_by("sequence", "arrival").alias("last_sequence"),
        F.max_by("event_id", "arrival").alias("last_event_id"), last("subject_code", "observation.created", "report.created").alias("observation_id"), last("subject_code", "report.created").alias("report_id"),
        codes("measurement.recorded").alias("recorded"), codes("measurement.withheld").alias("withheld"))


def number(events: DataFrame, base_ms: int) -> DataFrame:
    """Gives events of a session their sequence and a time that never moves back: base plus the running largest offset."""
    order = Window.partitionBy("session_id").orderBy("arrival")
    return events.withColumn("sequence", F.row_number().over(order)).withColumn(
        "occurred_ms", F.lit(base_ms) + F.max("offset_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)))
