"""Provenance of observations: evidence references, measurements and windows resolved by joins; every violation is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.stats import all_of
from framewright.functions.tables import looked_up, merged
from framewright.operators.records import safe_id, same_protocol
from framewright.operators.report import parse_window

#: What a resolved row must share with the reference, and with the outcome that refers, by kind.
SHARED = {
    "window": (("modality", "context", "track_segment_id"), ("modality", "context", "track_segment_id")),
    "measurement": (("metric_code", "modality", "context", "unit", "track_segment_id"), ("aggregate_id", "metric_code", "modality", "context", "unit", "track_segment_id")),
    "aggregate": (("metric_code", "modality", "context", "unit", "track_segment_id"), ("aggregate_id", "metric_code")),
}
#: What a measurement must share with its outcome, and with its windows.
TERMINAL = ("metric_code", "label", "modality", "context", "unit", "algorithm_version", "processor_ref", "track_segment_id")
SOURCE = ("modality", "context", "processor_ref", "track_segment_id")


def _all_same(columns: tuple[str, ...], a: str, b: str) -> Column:
    return all_of(*(F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def first(df: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """One row a key, as a lookup in a list finds it: the first by ``position``, or by all columns where there is none."""
    rest = [c for c in df.columns if c not in keys]
    order = [position] if position in rest else rest
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*") if rest else df.distinct()


#: What a reference's target may say; a kind's table has some of it.
FOUND = ("position", "session_id", "metric_code", "modality", "context", "unit", "track_segment_id", "aggregate_id")


def _targets(tables: dict[str, DataFrame]) -> DataFrame:
    """Targets of a session of every kind by ``session_id, kind, target_id``; of a kind without positions the first ones."""
    tables = {kind: table if "position" in table.columns else first(table, ["session_id", f"{kind}_id"]) for kind, table in tables.items()}
    kinds = {f.name: f.dataType for t in tables.values() for f in t.schema.fields}
    say = lambda table, c: F.col(c) if c in table.columns else F.lit(None).cast(kinds[c])
    return reduce(DataFrame.unionByName, (
        table.select("session_id", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("target_id"), *(say(table, c).cast(kinds[c]).alias(c) for c in FOUND if c in kinds and c != "session_id"))
        for kind, table in tables.items()))


def foreign() -> Column:
    """Whether a reference, joined with its observation as ``seen``, names another session, observation or protocol."""
    return ~(F.col("ref.session_id").eqNullSafe(F.col("seen.session_id")) & F.col("ref.observation_id").eqNullSafe(F.col("seen.observation_id")) & same_protocol("ref.protocol", "seen.protocol"))


def reference_errors(refs: DataFrame, outcomes: DataFrame, observations: DataFrame, targets: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """References that do not hold: ``session_id, metric_code, kind, target_id, error``.

    ``refs`` has the outcome's ``session_id, metric_code`` and a struct ``ref``
    with ``kind``, ``target_id`` and what the reference says.  An error is
    ``foreign-context`` (nothing else is then looked at), ``unresolved``,
    ``mismatch``, or ``other-metric`` of a measurement's event.  ``targets`` are
    windows, measurements and aggregates by kind, with their ids.  Of rows with
    one id the first counts (by a column ``position``, where there is one).  All
    kinds of a session are looked up at once where the session lies; events may
    be of any session and are joined by their id.
    """
    seen = merged(observations.select("session_id", F.struct(*observations.columns).alias("seen")))

    def held(some: DataFrame) -> DataFrame:
        r = looked_up(some.select("session_id", "metric_code", "ref"), ["session_id", "metric_code"], outcomes, "outcome").filter("outcome is not null")
        r = r.withColumn("outcome", F.struct("metric_code", *(F.col(f"outcome.{c}").alias(c) for c in ("aggregate_id", "modality", "context", "unit", "track_segment_id"))))
        return r.join(seen, "session_id").withColumns({"kind": F.col("ref.kind"), "target_id": F.col("ref.target_id"), "foreign": foreign()})

    told, event = ("session_id", "metric_code", "kind", "target_id"), F.col("ref.kind").eqNullSafe("event")
    r = looked_up(held(refs.filter(~event)).drop("seen"), ["session_id", "kind", "target_id"], _targets(targets), "found")
    fits = F.lit(True)
    for kind, (to_ref, to_outcome) in SHARED.items():
        fits = F.when(F.col("kind") == kind, _all_same(to_ref, "found", "ref") & _all_same(to_outcome, "found", "outcome")).otherwise(fits)
    own = r.select(*told, F.when(F.col("foreign"), "foreign-context").when(F.col("found").isNull(), "unresolved").when(~fits, "mismatch").alias("error")).filter("error is not null")

    e = first(events, ["event_id"])
    e = e.select(F.col("event_id").alias("target_id"), F.struct(*(c for c in ("session_id", "subject_ref", "protocol", "type", "metric_code") if c in e.columns)).alias("found"))
    r = held(refs.filter(event)).select(*told, "foreign", "seen").join(merged(e), "target_id", "left")
    bound = F.col("found.session_id").eqNullSafe(F.col("seen.session_id")) & F.col("found.subject_ref").eqNullSafe(F.col("seen.subject_ref")) & same_protocol("found.protocol", "seen.protocol")
    other = F.col("found.type").isin("measurement.recorded", "measurement.withheld") & ~F.col("found.metric_code").eqNullSafe(F.col("metric_code"))
    errors = (
        F.when(F.col("foreign"), F.array(F.lit("foreign-context"))).when(F.col("found").isNull(), F.array(F.lit("unresolved")))
        .otherwise(F.array(F.when(~bound, "mismatch"), F.when(other, "other-metric"))))
    return own.unionByName(r.select(*told, F.explode(errors).alias("error")).filter("error is not null"))


def outcome_errors(outcomes: DataFrame, processors: DataFrame, refs: DataFrame) -> DataFrame:
    """Outcomes whose processor is not listed, and measured ones that refer to no measurement."""
    there = F.lit(1).alias("there")
    absent = lambda rows, keys, table, error: looked_up(rows, keys, table.select(*keys, there), "found").filter("found is null").select("session_id", "metric_code", F.lit(error).alias("error"))
    lost = absent(outcomes.select("session_id", "processor_ref", "metric_code"), ["session_id", "processor_ref"], processors, "processor-unresolved")
    bare = absent(outcomes.filter("status = 'measured'").select("session_id", "metric_code", "status"), ["session_id", "metric_code"], refs.filter("ref.kind = 'measurement'"), "no-measurement-reference")
    return lost.unionByName(bare)


def measurement_errors(measurements: DataFrame, outcomes: DataFrame, windows: DataFrame) -> DataFrame:
    """Measurements without their exact measured outcome, and source windows that are missing or of another kind."""
    own = F.struct(*(c for c in dict.fromkeys((*TERMINAL, *SOURCE, "own_session_id")) if c in measurements.columns)).alias("own")
    held = all_of(F.col("outcome.status") == "measured", _all_same(TERMINAL, "own", "outcome"), F.col("own.own_session_id").eqNullSafe(F.col("session_id")) if "own_session_id" in measurements.columns else F.lit(True))
    m = measurements.select("session_id", "aggregate_id", "measurement_id", own)
    ends = looked_up(m, ["session_id", "aggregate_id"], outcomes, "outcome").filter(~held).select("session_id", "measurement_id", F.lit("no-terminal-aggregate").alias("error"))
    w = windows.withColumnRenamed("window_id", "target_id")
    w = w.select("session_id", "target_id", "position", *SOURCE) if "position" in w.columns else w
    sources = measurements.select("session_id", F.explode("source_window_refs").alias("target_id"), "measurement_id", F.struct(*SOURCE).alias("own"))
    w = looked_up(sources, ["session_id", "target_id"], w, "found")
    fits = F.coalesce(F.col("found").isNotNull() & _all_same(SOURCE, "own", "found"), F.lit(False))
    return ends.unionByName(w.filter(~fits).select("session_id", "measurement_id", F.lit("incompatible-source-window").alias("error")))


def verdicts(observations: DataFrame, *errors: DataFrame) -> DataFrame:
    """One row per observation: ``pass`` without errors, else ``fail``; and how many of each."""
    every = reduce(DataFrame.unionByName, [e.select("session_id", "error") for e in errors]).groupBy("session_id", "error").agg(F.count("*").alias("n"))
    listed = every.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "error", F.col("n").cast("string")))), ";").alias("errors"))
    return observations.select("session_id").join(listed, "session_id", "left").select("session_id", F.when(F.col("errors").isNull(), "pass").otherwise("fail").alias("status"), F.coalesce("errors", F.lit("")).alias("errors"))


def window_spans(duration_ms: Column) -> Column:
    """Windows of an outcome, as an array of ``index, ref, start_ms, end_ms``: one per source reference, or one over what was observed."""
    start = F.greatest(F.lit(0.0), F.coalesce("observed_start_ms", F.lit(0.0)))
    end = F.greatest(start + 1, F.coalesce("observed_end_ms", start + 1))
    one = lambda i, ref, a, b: F.struct(i.alias("index"), ref.alias("ref"), a.alias("start_ms"), b.alias("end_ms"))
    none = F.array(one(F.lit(0), F.concat(F.col("modality"), F.lit("-unavailable")), start, F.least(duration_ms, end)))
    parsed = lambda r: parse_window(r, F.col("modality"), duration_ms)
    named = F.transform("source_window_refs", lambda r, i: one(i, r, parsed(r).start_ms, parsed(r).end_ms))
    return F.when(F.size("source_window_refs") > 0, named).otherwise(none)


def window_id(code: Column, window: Column) -> Column:
    return safe_id(F.concat_ws(":", F.lit("window"), code, window.index.cast("string"), window.ref))


def windows_for(outcomes: DataFrame, duration_ms: float) -> DataFrame:
    """Evidence windows of each outcome."""
    measured = F.col("status") == "measured"
    w = outcomes.select("*", F.explode(window_spans(F.lit(duration_ms))).alias("w"))
    return w.select(
        "session_id", "metric_code", window_id(F.col("metric_code"), F.col("w")).alias("window_id"), F.col("w.start_ms").alias("start_ms"), F.col("w.end_ms").alias("end_ms"),
        F.when(measured, F.col("quality_score")).otherwise(0.0).alias("quality_score"), F.when(measured, "eligible").otherwise("withheld").alias("status"),
        F.when(~measured, F.coalesce("reason", F.lit("quality-threshold-failed"))).alias("reason"))


def report_errors(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """Violations of a report: ``sections (session_id, section, facts)`` and ``entries (session_id, section, metric_code, report_section)``."""
    held = entries.groupBy("session_id", "section").agg(F.count("*").alias("n"))
    s, quality = sections.join(held, ["session_id", "section"], "left").withColumn("n", F.coalesce("n", F.lit(0))), F.col("section") == "capture-quality"
    rows = lambda df, what, error: df.select("session_id", what.alias("subject"), F.lit(error).alias("error"))
    twice = lambda df, c: df.groupBy("session_id", c).agg(F.count("*").alias("n")).filter("n > 1")
    return reduce(DataFrame.unionByName, (
        rows(s.filter(quality & ((F.col("facts") == 0) | (F.col("n") > 0))), F.col("section"), "quality-section-needs-facts-alone"), rows(s.filter(~quality & (F.col("facts") > 0)), F.col("section"), "facts-outside-quality-section"),
        rows(entries.filter("section <> report_section"), F.col("metric_code"), "wrong-section"), rows(twice(sections, "section"), F.col("section"), "section-repeated"), rows(twice(entries, "metric_code"), F.col("metric_code"), "metric-repeated")))
