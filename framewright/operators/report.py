"""Terminal outcomes of both modalities: completeness, lanes, evidence windows, provenance checks and the sectioned report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions.stats import finite
from framewright.operators import face, voice

#: Report sections in order.
SECTIONS = ("capture-quality", "pitch", "speech-timing", "eye-geometry", "mouth-geometry", "symmetry", "movement", "blink-behavior")
#: Section and place of each metric, in registry order.
PLACES = (
    ("pitch", 0), ("pitch", 1), ("speech-timing", 0), ("speech-timing", 1), ("speech-timing", 2), ("speech-timing", 3), ("speech-timing", 4),
    ("eye-geometry", 0), ("eye-geometry", 1), ("symmetry", 0), ("mouth-geometry", 0), ("mouth-geometry", 1), ("mouth-geometry", 2), ("symmetry", 1), ("movement", 0), ("blink-behavior", 0),
)
_TIMING = {"minimumSegments": 3, "minimumEligibleSpanMs": 30_000, "minimumActiveSpeechMs": 15_000}
_BINS = {"minimumBins": 3, "minimumObservationSpanMs": 30_000}
#: What a measured outcome's evidence must satisfy, by metric.
REQUIREMENTS = (
    {"minimumSegments": 3, "minimumPitchedDurationMs": 10_000, "minimumPitchCoverage": 0.6, "minimumF0Hz": 50, "maximumF0Hz": 700}, {"minimumSegments": 3, "minimumPitchedDurationMs": 10_000, "minimumPitchCoverage": 0.6},
    _TIMING, _TIMING, _TIMING | {"minimumEventsForMedian": 5}, _TIMING | {"minimumEventsForMedian": 5}, _TIMING | {"minimumNuclei": 30},
    *[_BINS] * 8, {"minimumExposureMs": 60_000, "minimumCadenceHz": 24},
)
METRICS = (*voice.METRICS, *face.METRICS)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(i, code, unit, "voice" if ".voice." in code else "face", *PLACES[i], {k: float(v) for k, v in REQUIREMENTS[i].items()}) for i, (code, unit) in enumerate(METRICS)]
    return spark.createDataFrame(rows, "registry_order int, code string, unit string, modality string, section string, place int, requirements map<string,double>")


def definitions(spark: SparkSession, reasons: tuple[str, ...]) -> DataFrame:
    """The registry with what outcomes must agree with: label, context, versions, and the reasons for which they may be withheld."""
    voice_ = F.col("modality") == "voice"
    return registry(spark).select(
        "*", F.col("code").alias("label"), F.when(voice_, "ambient").otherwise("ambient-frontal").alias("context"), F.lit("1.0.0").alias("algorithm_version"), F.lit("automated-test").alias("technical_verification"),
        F.lit("none").alias("clinical_validation"), F.array(*map(F.lit, reasons)).alias("reasons"))


def finalize(voice_outcomes: DataFrame, face_outcomes: DataFrame) -> DataFrame:
    """Outcomes of both modalities in one table, in registry order, with what evidence each counts."""
    n = F.lit(None)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    v = voice_outcomes.select(
        "session_id", F.col("ordinal").alias("registry_order"), "code", F.lit("voice").alias("modality"), "status", "value", "quality_score", "dispersion", "reason", count("segments").alias("segments"), n.cast("double").alias("bins"),
        count("eligible_ms").alias("eligible_ms"), count("active_ms").alias("active_ms"), count("pitched_ms").alias("pitched_ms"), F.greatest(count("pauses"), count("speech_runs"), count("nuclei")).alias("events"), n.cast("double").alias("frames"))
    f = face_outcomes.select(
        "session_id", (F.col("ordinal") + len(voice.METRICS)).alias("registry_order"), "code", F.lit("face").alias("modality"), "status", "value", "quality_score", "dispersion", "reason", n.cast("double").alias("segments"), count("bins").alias("bins"),
        count("exposure_ms").alias("eligible_ms"), n.cast("double").alias("active_ms"), n.cast("double").alias("pitched_ms"), n.cast("double").alias("events"), count("frames").alias("frames"))
    return v.unionByName(f)


def incomplete(outcomes: DataFrame, spark: SparkSession) -> DataFrame:
    """Registry violations: metrics missing, unregistered or repeated in a session, and measured outcomes whose value or dispersion is not finite or whose score is not within 0 and 1."""
    r = F.broadcast(registry(spark).select("code"))
    want = outcomes.select("session_id").distinct().crossJoin(r)  # sixteen rows a session
    counted = outcomes.groupBy("session_id", "code").agg(F.count("*").alias("n"))
    missing = want.join(counted, ["session_id", "code"], "left_anti").withColumn("violation", F.lit("missing"))
    unknown = counted.join(r, "code", "left_anti").select("session_id", "code", F.lit("unregistered").alias("violation"))
    repeated = counted.filter("n > 1").select("session_id", "code", F.lit("repeated").alias("violation"))
    wrong = outcomes.filter((F.col("status") == "measured") & ~(finite("value") & F.coalesce(F.col("quality_score").between(0, 1), F.lit(False)) & (F.col("dispersion").isNull() | finite("dispersion")))).select("session_id", "code", F.lit("invalid-value").alias("violation"))
    return missing.unionByName(unknown).unionByName(repeated).unionByName(wrong)


def lanes(outcomes: DataFrame) -> DataFrame:
    """State of each modality of each session: ready with one measured metric, else withheld."""
    ok = F.col("status") == "measured"
    return outcomes.groupBy("session_id", "modality").agg(
        F.when(F.count_if(ok) > 0, "ready").otherwise("withheld").alias("state"), F.max("eligible_ms").alias("eligible_ms"), F.avg(F.when(ok, F.col("quality_score"))).alias("quality_score"),
        F.array_sort(F.collect_set("reason")).alias("reasons"))


def facts() -> Column:
    """Evidence facts by requirement; absent ones are left out.

    The observation span is the eligible duration here, though extraction tests
    the span from first to last bin: bins far apart are measured and then fail.
    """
    f = F.col
    coverage = F.when(f("active_ms") > 0, f("pitched_ms") / f("active_ms"))
    rate = F.when(f("eligible_ms") > 0, f("frames") / (f("eligible_ms") / 1000))
    named = {
        "minimumSegments": f("segments"), "minimumPitchedDurationMs": f("pitched_ms"), "minimumPitchCoverage": coverage, "minimumF0Hz": f("value"), "maximumF0Hz": f("value"), "minimumEligibleSpanMs": f("eligible_ms"),
        "minimumObservationSpanMs": f("eligible_ms"), "minimumExposureMs": f("eligible_ms"), "minimumActiveSpeechMs": f("active_ms"), "minimumEventsForMedian": f("events"), "minimumNuclei": f("events"), "minimumBins": f("bins"),
        "minimumCadenceHz": rate}
    pairs = [x for k, v in named.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def evidence_errors(outcomes: DataFrame, spark: SparkSession) -> DataFrame:
    """Requirements that measured outcomes do not meet: minimum, maximum or exact by their names; absent facts are skipped."""
    r = F.broadcast(registry(spark).select("code", F.explode("requirements").alias("requirement", "threshold")))
    m = outcomes.filter("status = 'measured'").withColumn("facts", facts()).join(r, "code").withColumn("actual", F.element_at("facts", F.col("requirement")))
    met = F.when(F.col("requirement").startswith("maximum"), F.col("actual") <= F.col("threshold")).when(F.col("requirement").startswith("minimum"), F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") == F.col("threshold"))
    return m.filter(F.col("actual").isNotNull() & ~met).select("session_id", "code", "requirement", "threshold", "actual")


def parse_window(ref: Column, modality: Column, duration_ms: Column) -> Column:
    """Epoch, track (which may hold colons), start and end of a window reference; null if it breaks a rule."""
    parts = F.split(ref, ":", -1)
    n = F.size(parts)
    number = lambda x: F.when(x.rlike(r"^-?\d+(\.\d+)?$"), x.cast("double"))
    epoch = F.when(F.element_at(parts, 2).rlike(r"^\d+$"), F.element_at(parts, 2).cast("long"))
    start, end = number(F.element_at(parts, n - 1)), number(F.element_at(parts, n))
    track = F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 4, F.lit(0))), ":")
    good = (n >= 5) & (F.element_at(parts, 1) == modality) & epoch.isNotNull() & (F.length(track) > 0) & (start >= 0) & (end > start) & (end <= duration_ms)
    return F.when(n >= 5, F.when(good, F.struct(epoch.alias("capture_epoch"), track.alias("track_segment_id"), start.alias("start_ms"), end.alias("end_ms"))))


def report(outcomes: DataFrame, spark: SparkSession) -> DataFrame:
    """Eight sections per session, each with its outcomes in report order; sessions with an evidence error have none."""
    bad = evidence_errors(outcomes, spark).select("session_id").distinct()
    o = outcomes.join(bad, "session_id", "left_anti").join(F.broadcast(registry(spark).select("code", "section", "place")), "code")
    entry = F.struct("place", "code", "status", F.round("value", 6).alias("value"), "reason")
    filled = o.groupBy("session_id", "section").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws("=", e.code, F.coalesce(e.reason, e.status))).alias("entries"))
    sections = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(s).alias("section")) for i, s in enumerate(SECTIONS)))
    every = o.select("session_id").distinct().select("session_id", F.explode(sections).alias("s")).select("session_id", "s.*")
    return every.join(filled, ["session_id", "section"], "left").withColumn("entries", F.array_join(F.coalesce("entries", F.array().cast("array<string>")), ";"))


def complete_refs(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Known rows, and one synthetic row for each wanted reference that has none."""
    extra = wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    return known.withColumn("synthetic", F.lit(False)).unionByName(extra.withColumn("synthetic", F.lit(True)), allowMissingColumns=True)


def latest_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each group by an order, as a lookup takes its first match."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
