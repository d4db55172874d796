"""File sources with explicit, strict schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGGREGATE = (
    "code string, label string, unit string, contextKind string, value double, spread double, confidence double, windowCount int, algorithmVersion string, processorRef string, "
    "sourceWindowRefs array<string>, confounds map<string,string>, uncertainty map<string,string>, clinicalValidation string"
)
HISTORY = (
    "containsPHI boolean, synthetic boolean, source string, visitId string, participantId string, occurredAt string, captureMode string, captureAdapter struct<id:string,version:string>, "
    f"selectedProtocolId string, reviewStatus string, aggregates array<struct<{', '.join(f.replace(' ', ':', 1) for f in AGGREGATE.split(', '))}>>")
EVENT = "schemaVersion string, eventId string, sequence long, occurredAt string, sessionId string, subjectRef string, stage string, type string, summary string, payload string, causedByEventId string"


def history_records(spark: SparkSession, path: str) -> DataFrame:
    """An array of history records in one JSON document per file; a malformed document is an error."""
    return spark.read.schema(HISTORY).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("occurred_at", F.try_to_timestamp("occurredAt"))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """One event per line; lines that are no events are kept with nulls and their text."""
    return spark.read.schema(f"{EVENT}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def verify_assets(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files of ``manifest (path, sha256)`` that are missing or differ; paths are relative, without ``..``, and may not repeat."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("full"), F.sha2("content", 256).alias("found"))
    m = manifest.withColumn("full", F.concat(F.lit(folder.rstrip("/") + "/"), "path")).join(found, "full", "left")
    bad_path = F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|\\") | (F.length("path") == 0)
    violation = F.when(bad_path, "path").when(F.col("found").isNull(), "missing").when(F.col("found") != F.lower("sha256"), "digest")
    return m.select("path", violation.alias("violation")).filter("violation is not null")
