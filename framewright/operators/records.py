"""Small rules of records: identifiers, gauges, provenance of outcomes, and checks against registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.stats import clamp01, finite

#: The stages in which a workflow event may occur.
STAGES = {
    "consent.recorded": ("requesting-permission",), "capture.permission.requested": ("requesting-permission",), "capture.calibration.started": ("calibrating",), "capture.lane.ready": ("calibrating",),
    "capture.started": ("observing",), "capture.quality.changed": ("observing",), "measurement.recorded": ("observing", "finalizing"), "measurement.withheld": ("observing", "finalizing"),
    "capture.finalizing": ("finalizing",), "capture.discarded": ("discarded",), "observation.created": ("finalizing",), "report.created": ("report",), "capture.error": ("error",),
}
#: Fields of an outcome that must equal its definition's, by the name that an error has.
DEFINED = {"label": "label", "modality": "modality", "context": "context", "unit": "unit", "report section": "section", "algorithm version": "algorithm_version", "technical verification": "technical_verification", "clinical validation": "clinical_validation"}


def level_fraction(dbfs: Column) -> Column:
    """-60 to 0 dBFS as 0 to 1; what is no number is 0."""
    return F.when(finite(dbfs), clamp01((dbfs + 60) / 60)).otherwise(0.0)


def pitch_fraction(hz: Column, low: float = 60.0, high: float = 400.0) -> Column:
    """A pitch between the limits as 0 to 1; none is 0."""
    return F.when(finite(hz), clamp01((hz - low) / (high - low))).otherwise(0.0)


def depth_fractions(z: Column) -> Column:
    """Nearest (smallest) depth 1, farthest 0; what is no number, or all alike, 0.5."""
    real = F.filter(z, finite)
    low, high = F.array_min(real), F.array_max(real)
    return F.transform(z, lambda x: F.when(finite(x) & (high - low > 1e-9), 1 - (x - low) / (high - low)).otherwise(0.5))


def safe_id(text: Column) -> Column:
    """Other characters than letters, digits and ``._:-`` become dashes; at most 150."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._:-]", "-"), 1, 150)


def primary(refs: Column, modality: Column, none: Column) -> Column:
    """The only reference, a mark of mixed provenance, or what stands for none."""
    return F.when(F.size(refs) == 1, F.element_at(refs, 1)).when(F.size(refs) > 1, F.concat(modality, F.lit("-mixed-provenance"))).otherwise(none)


def present_facts(facts: dict[str, Column]) -> Column:
    """A map of the facts that are finite numbers."""
    return F.map_filter(F.create_map(*(x for k, v in facts.items() for x in (F.lit(k), v.cast("double")))), lambda _, v: finite(v))


def contract_reason(available: Column, status: Column, reason: Column, registered: Column) -> Column:
    """Why an outcome is withheld where its record is; ``unregistered`` marks a reason that its definition lacks."""
    return F.when(~available, "modality-unavailable").when(status == "measured", "quality-threshold-failed").when(F.array_contains(registered, reason), reason).otherwise("unregistered")


def definition_errors(outcomes: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per field in which an outcome differs from its definition, and per reason that the definition does not have.

    ``definitions`` are few (one row a metric), with any of the fields of
    ``DEFINED`` and ``reasons``.
    """
    fields = {name: c for name, c in DEFINED.items() if c in definitions.columns and c in outcomes.columns}
    known = F.broadcast(definitions.select("code", F.struct(*(c for c in (*fields.values(), *(["reasons"] if "reasons" in definitions.columns else [])))).alias("_d")))
    checks = [F.when(~F.col(c).eqNullSafe(F.col(f"_d.{c}")), F.lit(name)) for name, c in fields.items()]
    if "reasons" in definitions.columns:
        checks.append(F.when((F.col("status") == "withheld") & ~F.coalesce(F.array_contains("_d.reasons", F.coalesce("reason", F.lit(""))), F.lit(False)), F.lit("withheld reason")))
    return outcomes.join(known, "code").select(*keys, "code", F.explode(F.array_compact(F.array(*checks))).alias("error"))


def stage_errors(events: DataFrame) -> DataFrame:
    """Events in a stage in which their type may not occur; unknown types are errors too."""
    allowed = F.create_map(*(x for k, v in STAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return events.filter(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("type")), F.col("stage")), F.lit(False)))


def window_counts(windows: DataFrame, keys: list[str]) -> DataFrame:
    """All, eligible and withheld windows."""
    return windows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("eligible").alias("eligible"), F.count_if(~F.coalesce("eligible", F.lit(False))).alias("withheld"))


def same_protocol(a: str, b: str) -> Column:
    """Whether two protocol references name one pack, version and digest."""
    return F.col(f"{a}.pack_id").eqNullSafe(F.col(f"{b}.pack_id")) & F.col(f"{a}.version").eqNullSafe(F.col(f"{b}.version")) & F.col(f"{a}.content_sha256").eqNullSafe(F.col(f"{b}.content_sha256"))


def pipeline_ref(name: Column, version: Column, digest: Column, geometry: Column, delegate: Column) -> Column:
    """A processor reference: five parts, the digest by its first twelve characters."""
    return F.concat_ws(":", name, version, F.substring(digest, 1, 12), geometry, F.lower(delegate))


def observed(frames: DataFrame, origin_ms: Column, generation: Column) -> DataFrame:
    """Face frames of a lane: time from the origin, one track a generation, and a reason where there are several faces."""
    more = F.array_union("quality_reasons", F.array(F.lit("multiple-faces")))
    return frames.withColumn("t_ms", F.greatest(F.col("t_ms") - origin_ms, F.lit(0.0))).withColumn("track_segment_id", F.concat(F.lit("face-"), generation.cast("string"))).withColumn(
        "quality_reasons", F.when(F.col("face_count") > 1, more).otherwise(F.col("quality_reasons")))
