"""Queries of provenance: orders stand for sessions, their lines for outcomes with windows, measurements, references and events, some of them broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tables import dealt, settle
from framewright.operators import provenance


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, dealt by session: the tables made of them stay where they are."""
    line = dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    n = F.col("l_linenumber")
    one = lambda x: F.lit(x)
    modality = F.when(n % 2 == 0, "voice").otherwise("face")
    return line.select(
        F.col("l_orderkey").alias("session_id"), n.alias("n"), "p", F.concat(one("m"), n.cast("string")).alias("metric_code"), modality.alias("modality"), one("ambient").alias("context"), one("Hz").alias("unit"), one("L").alias("label"),
        one("1").alias("algorithm_version"), F.concat(modality, one("-p")).alias("processor_ref"), one("t1").alias("track_segment_id"), F.concat_ws(":", one("a"), "l_orderkey", "l_linenumber").alias("aggregate_id"),
        F.when(F.col("p") % 5 != 0, "measured").otherwise("withheld").alias("status"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    x = _lines(spark, sf_dir)
    key = lambda c: F.concat_ws(":", F.lit(c), "session_id", "n")
    protocol = F.struct(F.lit("pack").alias("pack_id"), F.lit("1").alias("version"), F.lit("abc").alias("content_sha256"))
    seen = x.select("session_id").distinct().select("session_id", F.concat(F.lit("o:"), F.col("session_id").cast("string")).alias("observation_id"), F.lit("s").alias("subject_ref"), protocol.alias("protocol"))
    modalities = x.select("session_id").distinct().select("session_id", F.explode(F.array(F.lit("voice-p"), F.lit("face-p"))).alias("processor_ref")).filter("not (session_id % 19 = 0 and processor_ref = 'face-p')")
    # lookups take the first of equal ids: some windows and events come again, otherwise
    again = lambda there, twice: x.withColumn("position", F.explode(F.when(there & twice, F.array(F.lit(1), F.lit(2))).when(there, F.array(F.lit(1))).otherwise(F.slice(F.array(F.lit(1)), 1, 0))))
    later = lambda yes, no: F.when(F.col("position") == 2, yes).otherwise(no)
    windows = again(F.col("p") % 13 != 0, F.col("session_id") % 3 == 1).select(
        "session_id", key("w").alias("window_id"), "modality", "context", later(F.lit("other"), F.col("processor_ref")).alias("processor_ref"), later(F.lit("t9"), F.when(F.col("p") % 11 == 0, "t2").otherwise("t1")).alias("track_segment_id"), "position")
    measurements = x.filter("p % 5 <> 0 or p % 50 = 0").withColumn("unit", F.when(F.col("p") % 17 == 0, "st").otherwise(F.col("unit"))).withColumn("measurement_id", key("q")).withColumn("source_window_refs", F.array(key("w"))).drop("status", "n", "p")
    events = again((F.col("n") % 4 == 0) & (F.col("p") % 29 != 0), (F.col("session_id") + F.when(F.col("p") % 31 == 0, 1).otherwise(0)) % 2 == 0).select(
        key("e").alias("event_id"), (F.col("session_id") + F.when(F.col("p") % 31 == 0, 1).otherwise(0)).alias("session_id"), later(F.lit("later"), F.lit("s")).alias("subject_ref"), protocol.alias("protocol"), F.lit("measurement.recorded").alias("type"),
        later(F.lit("m0"), F.when(F.col("p") % 41 == 0, "mX").otherwise(F.col("metric_code"))).alias("metric_code"), "position")
    said = lambda kind, target: F.struct(
        F.lit(kind).alias("kind"), target.alias("target_id"), "session_id", F.concat(F.lit("o:"), F.when(F.col("p") % 37 == 0, "other").otherwise(F.col("session_id").cast("string"))).alias("observation_id"), protocol.alias("protocol"), "modality", "context", "unit",
        "track_segment_id", F.when((F.lit(kind) == "aggregate") & (F.col("p") % 23 == 0), "mX").otherwise(F.col("metric_code")).alias("metric_code"))
    every = F.array(said("window", key("w")), F.when(F.col("p") % 7 != 0, said("measurement", key("q"))), F.when(F.col("n") % 3 == 0, said("aggregate", F.col("aggregate_id"))), F.when(F.col("n") % 4 == 0, said("event", key("e"))))
    refs = x.select("session_id", "metric_code", F.explode(every).alias("ref")).filter("ref is not null")
    return {"outcomes": x.drop("n", "p"), "observations": seen, "processors": modalities, "windows": windows, "measurements": measurements, "events": events, "refs": refs}


def _reference_errors(t: dict[str, DataFrame]) -> DataFrame:
    return provenance.reference_errors(t["refs"], t["outcomes"], t["observations"], {"window": t["windows"], "measurement": t["measurements"], "aggregate": t["outcomes"]}, t["events"])


def j05_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference_errors(_tables(spark, sf_dir)).drop("target_id")


def j04_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return provenance.outcome_errors(t["outcomes"], t["processors"], t["refs"])


def j09_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return provenance.measurement_errors(t["measurements"], t["outcomes"], t["windows"])


def r17_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return provenance.verdicts(
        t["observations"], _reference_errors(t), provenance.outcome_errors(t["outcomes"], t["processors"], t["refs"]), provenance.measurement_errors(t["measurements"], t["outcomes"], t["windows"]))


def r10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    refs = F.array(F.concat_ws(":", "modality", F.lit("1"), F.lit("mic"), (p % 50).cast("string"), (p % 40 + 30).cast("string")), F.concat_ws(":", "modality", F.lit("2"), F.lit("m b"), F.lit("5"), F.lit("100.5")))
    o = settle(_lines(spark, sf_dir)).select(
        "session_id", "metric_code", "modality", "status", F.when(p % 3 == 0, F.array().cast("array<string>")).otherwise(refs).alias("source_window_refs"), F.when(p % 2 == 0, (p % 120).cast("double")).alias("observed_start_ms"),
        F.when(p % 4 == 0, (p % 90).cast("double")).alias("observed_end_ms"), (p % 10 / 10).alias("quality_score"), F.when(p % 10 == 0, "no-usable-signal").alias("reason"))
    return provenance.windows_for(o, 110.0)


def r19_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in which some metrics are misplaced or repeated and some sections have facts or lack them."""
    x = settle(_lines(spark, sf_dir))
    section = F.when(F.col("p") % 9 == 0, "capture-quality").otherwise(F.col("modality"))
    entries = x.select("session_id", section.alias("section"), F.when(F.col("p") % 15 == 0, "m1").otherwise(F.col("metric_code")).alias("metric_code"), F.col("modality").alias("report_section"))
    names = F.array(F.lit("capture-quality"), F.lit("voice"), F.lit("face"), F.when(F.col("session_id") % 12 == 0, "voice"))
    s = x.select("session_id").distinct().select("session_id", F.explode(F.array_compact(names)).alias("section"))
    facts = F.when(F.col("section") == "capture-quality", F.col("session_id") % 5).otherwise(F.when(F.col("session_id") % 14 == 0, 1).otherwise(0))
    return provenance.report_errors(s.withColumn("facts", facts), entries)


QUERIES = {
    "j05_reference_errors": j05_references, "j04_outcome_errors": j04_outcomes, "j09_measurement_errors": j09_measurements, "r17_provenance": r17_provenance, "r10_evidence_windows": r10_windows, "r19_report_errors": r19_report,
}

_L = """
WITH x AS (SELECT l_orderkey AS session_id, l_linenumber AS n, min(l_partkey) AS p, 'm' || l_linenumber AS metric_code, CASE WHEN l_linenumber % 2 = 0 THEN 'voice' ELSE 'face' END AS modality FROM lineitem GROUP BY ALL)"""
_REFS = """,
k AS (SELECT *, unnest(list_filter(['window', CASE WHEN p % 7 <> 0 THEN 'measurement' END, CASE WHEN n % 3 = 0 THEN 'aggregate' END, CASE WHEN n % 4 = 0 THEN 'event' END], lambda v: v IS NOT NULL)) AS kind FROM x),
a AS (SELECT session_id, metric_code, kind, unnest(CASE WHEN p % 37 = 0 THEN ['foreign-context']
        WHEN kind = 'window' THEN [CASE WHEN p % 13 = 0 THEN 'unresolved' WHEN p % 11 = 0 THEN 'mismatch' END] WHEN kind = 'measurement' THEN [CASE WHEN p % 5 = 0 AND p % 50 <> 0 THEN 'unresolved' WHEN p % 17 = 0 THEN 'mismatch' END]
        WHEN kind = 'aggregate' THEN [CASE WHEN p % 23 = 0 THEN 'mismatch' END]
        WHEN p % 29 = 0 THEN ['unresolved'] ELSE [CASE WHEN p % 31 = 0 THEN 'mismatch' END, CASE WHEN p % 41 = 0 THEN 'other-metric' END] END) AS error FROM k),
refs AS (SELECT * FROM a WHERE error IS NOT NULL),
outs AS (SELECT session_id, metric_code, 'processor-unresolved' AS error FROM x WHERE session_id % 19 = 0 AND modality = 'face' UNION ALL SELECT session_id, metric_code, 'no-measurement-reference' FROM x WHERE p % 5 <> 0 AND p % 7 = 0),
q AS (SELECT *, 'q:' || session_id || ':' || n AS measurement_id FROM x WHERE p % 5 <> 0 OR p % 50 = 0),
meas AS (SELECT session_id, measurement_id, 'no-terminal-aggregate' AS error FROM q WHERE p % 50 = 0 OR p % 17 = 0 UNION ALL SELECT session_id, measurement_id, 'incompatible-source-window' FROM q WHERE p % 13 = 0 OR p % 11 = 0)"""

ORACLES = {
    "j05_reference_errors": _L + _REFS + " SELECT * FROM refs",
    "j04_outcome_errors": _L + _REFS + " SELECT * FROM outs",
    "j09_measurement_errors": _L + _REFS + " SELECT * FROM meas",
    "r17_provenance": _L + _REFS + """,
        e AS (SELECT session_id, error, count(*) AS n FROM (SELECT session_id, error FROM refs UNION ALL SELECT session_id, error FROM outs UNION ALL SELECT session_id, error FROM meas) GROUP BY ALL),
        l AS (SELECT session_id, array_to_string(list_sort(list(error || '=' || n)), ';') AS errors FROM e GROUP BY ALL)
        SELECT s.session_id, CASE WHEN errors IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce(errors, '') AS errors FROM (SELECT DISTINCT session_id FROM x) s LEFT JOIN l USING (session_id)""",
    "r10_evidence_windows": _L + """,
        o AS (SELECT *, greatest(0, coalesce(CASE WHEN p % 2 = 0 THEN p % 120 END, 0))::DOUBLE AS os, (CASE WHEN p % 4 = 0 THEN p % 90 END)::DOUBLE AS oe, p % 5 <> 0 AS measured FROM x),
        w AS (SELECT *, unnest(CASE WHEN p % 3 = 0 THEN [0] ELSE [0, 1] END) AS i FROM o),
        v AS (SELECT *, CASE WHEN p % 3 = 0 THEN modality || '-unavailable' WHEN i = 0 THEN modality || ':1:mic:' || (p % 50) || ':' || (p % 40 + 30) ELSE modality || ':2:m b:5:100.5' END AS ref,
                     CASE WHEN p % 3 = 0 THEN os WHEN i = 1 THEN 5 WHEN p % 40 + 30 > p % 50 THEN p % 50 END AS s,
                     CASE WHEN p % 3 = 0 THEN least(110, greatest(os + 1, coalesce(oe, os + 1))) WHEN i = 1 THEN 100.5 WHEN p % 40 + 30 > p % 50 THEN p % 40 + 30 END AS e FROM w)
        SELECT session_id, metric_code, replace('window:' || metric_code || ':' || i || ':' || ref, ' ', '-') AS window_id, s::DOUBLE AS start_ms, e::DOUBLE AS end_ms, CASE WHEN measured THEN p % 10 / 10 ELSE 0 END::DOUBLE AS quality_score,
               CASE WHEN measured THEN 'eligible' ELSE 'withheld' END AS status, CASE WHEN NOT measured THEN CASE WHEN p % 10 = 0 THEN 'no-usable-signal' ELSE 'quality-threshold-failed' END END AS reason FROM v""",
    "r19_report_errors": _L + """,
        e AS (SELECT session_id, CASE WHEN p % 9 = 0 THEN 'capture-quality' ELSE modality END AS section, CASE WHEN p % 15 = 0 THEN 'm1' ELSE metric_code END AS metric_code, modality FROM x),
        s AS (SELECT session_id, unnest(CASE WHEN session_id % 12 = 0 THEN ['capture-quality', 'voice', 'face', 'voice'] ELSE ['capture-quality', 'voice', 'face'] END) AS section FROM (SELECT DISTINCT session_id FROM x))
        SELECT session_id, section AS subject, 'quality-section-needs-facts-alone' AS error FROM s WHERE section = 'capture-quality' AND (session_id % 5 = 0 OR EXISTS (SELECT 1 FROM e WHERE e.session_id = s.session_id AND e.section = s.section))
        UNION ALL SELECT session_id, section, 'facts-outside-quality-section' FROM s WHERE section <> 'capture-quality' AND session_id % 14 = 0
        UNION ALL SELECT session_id, metric_code, 'wrong-section' FROM e WHERE section <> modality
        UNION ALL SELECT session_id, section, 'section-repeated' FROM s GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT session_id, metric_code, 'metric-repeated' FROM e GROUP BY ALL HAVING count(*) > 1""",
}
