"""The observation document of a session: assembled from terminal outcomes, validated inside its arrays, and issued as a report.

A document is one row of typed nested columns: ``session_id, observation_id,
subject_ref, protocol, consent, source_session_ref, started_at, ended_at,
duration_ms, processors, windows, measurements, outcomes, quality``.  A session
has one outcome for each registered metric and at most a few hundred windows
(captures end after 300 s), so a document is bounded.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.stats import all_of
from framewright.functions.tables import merged, settle
from framewright.operators import kernels, provenance, records
from framewright.operators.report import SECTIONS

#: The longest capture.
LONGEST_MS = 300_000.0
#: Labels of the report's sections, in order.
SECTION_LABELS = ("Capture quality", "Pitch", "Speech timing", "Eye geometry", "Mouth geometry", "Symmetry", "Movement", "Blink behavior")


def metric_identity(protocol: Column, session_id: Column, row: Column) -> Column:
    """What makes a metric's value of a session the same value, as length-prefixed parts."""
    parts = (protocol.pack_id, protocol.version, session_id.cast("string"), *(row[c] for c in ("metric_code", "context", "unit", "algorithm_version", "processor_ref", "track_segment_id")))
    return kernels.identity(*parts)


def measurement_identity(identity: Column, window: Column, ordinal: Column) -> Column:
    return F.concat(identity, F.lit("|"), F.octet_length(window).cast("string"), F.lit(":"), window, F.lit("|"), ordinal.cast("string"))


def _first_processor() -> Column:
    """The first processor of the session's list that has the outcome's modality."""
    return F.get(F.filter("processors", lambda p: p.modality == F.col("modality")), F.lit(0)).processor_ref


def artifacts(outcomes: DataFrame, evidence: DataFrame, sessions: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per outcome: its structs ``outcome`` and ``measurement`` (null unless measured) and the array ``windows``.

    ``outcomes`` are finalised ones, ``evidence`` has a row per session and
    modality, ``sessions`` the options of a session with ``processors`` and
    whether the lanes were available, ``definitions`` (few) the registry.  An
    outcome counts as measured only if exactly one processor and one track stand
    behind it.
    """
    f = F.col
    known = definitions.select(f("code").alias("metric_code"), "label", "context", "unit", f("section").alias("report_section"), "algorithm_version", "technical_verification", "clinical_validation", "reasons")
    o = outcomes.withColumnRenamed("code", "metric_code").join(evidence, ["session_id", "modality"]).join(F.broadcast(known), "metric_code")
    o = o.join(sessions.select("session_id", "protocol", "processors", "duration_ms", "voice_available", "face_available"), "session_id")
    primary = lambda c, none: records.primary(f(c), f("modality"), none)
    o = o.withColumns({
        "processor_ref": primary("processor_refs", F.coalesce(_first_processor(), F.concat("modality", F.lit("-processor-unavailable")))),
        "track_segment_id": primary("track_segment_ids", F.concat("modality", F.lit("-track-unavailable"))),
        "measured": all_of(f("status") == "measured", F.size("processor_refs") == 1, F.size("track_segment_ids") == 1),
        "available": F.when(f("modality") == "voice", f("voice_available")).otherwise(f("face_available")),
        "duration_ms": F.least(F.lit(LONGEST_MS), F.greatest(F.lit(0.0), f("duration_ms"))),
        "observation_id": records.safe_id(F.concat(F.lit("observation:"), f("session_id").cast("string"))),
    })
    o = o.withColumns({
        "reason_code": F.when(~f("measured"), records.contract_reason(f("available"), f("status"), f("reason"), f("reasons"))),
        "detail": F.when(~f("measured"), F.when(~f("available"), "modality-unavailable").when(f("status") == "measured", "mixed-or-missing-provenance")),
        "spans": provenance.window_spans(f("duration_ms")),
        "identity": metric_identity(f("protocol"), f("session_id"), F.struct("metric_code", "context", "unit", "algorithm_version", "processor_ref", "track_segment_id")),
    })
    score = F.when(f("measured"), f("quality_score"))
    window = lambda w: F.struct(
        provenance.window_id(f("metric_code"), w).alias("window_id"), f("session_id"), f("modality"), f("context"), f("track_segment_id"), f("processor_ref"), w.start_ms.alias("start_ms"), w.end_ms.alias("end_ms"),
        F.coalesce(score, F.lit(0.0)).alias("quality_score"), F.when(f("measured"), "eligible").otherwise("withheld").alias("status"), F.array_compact(F.array("reason_code")).alias("reason_codes"))
    o = o.withColumn("windows", F.transform("spans", window))
    o = o.withColumn("ids", kernels.fnv1a_each(F.array("identity", measurement_identity(f("identity"), f("windows")[0].window_id, F.lit(0)), F.concat_ws("|", F.lit("outcome"), f("session_id").cast("string"), "metric_code"))))
    o = o.withColumns({"aggregate_id": F.concat(F.lit("agg_"), f("ids")[0]), "measurement_id": F.concat(F.lit("msr_"), f("ids")[1]), "outcome_id": F.concat(F.lit("outcome_"), f("ids")[2])})
    ref = lambda kind, target: F.struct(
        F.lit(kind).alias("kind"), target.alias("target_id"), f("session_id"), f("observation_id"), f("protocol"), f("modality"), f("context"), f("unit"), f("track_segment_id"), f("metric_code"))
    own = F.array_compact(F.array(F.when(f("measured"), ref("measurement", f("measurement_id"))), ref("aggregate", f("aggregate_id"))))
    refs = F.concat(F.transform("windows", lambda w: ref("window", w.window_id)), own)
    count = lambda c: F.coalesce(f(c), F.lit(0)).cast("long")
    facts = records.present_facts({
        "eligibleDurationMs": f("eligible_ms"), "sampleCount": f("sample_count"), "segmentCount": f("segment_count"), "qualifyingBinCount": F.coalesce("bins", F.lit(0)), "activeSpeechDurationMs": f("active_ms"),
        "pitchedDurationMs": f("pitched_ms"), "pitchCoverage": F.when(f("modality") == "voice", F.coalesce(F.try_divide("pitched_ms", "active_ms"), F.lit(0.0)))})
    ev = F.struct(
        f("eligible_ms").alias("eligible_ms"), F.coalesce("active_ms", F.lit(0.0)).alias("active_ms"), count("segment_count").alias("segments"), F.size("source_window_refs").alias("windows"), count("bins").alias("bins"),
        count("events").alias("events"), count("sample_count").alias("samples"), F.element_at(facts, "pitchCoverage").alias("coverage"), facts.alias("facts"), refs.alias("refs"))
    common = ("outcome_id", "aggregate_id", "metric_code", "label", "modality", "context", "unit", "report_section", "algorithm_version", "processor_ref", "track_segment_id", "technical_verification", "clinical_validation")
    outcome = F.struct(
        *common, F.when(f("measured"), "measured").otherwise("withheld").alias("status"), F.when(f("measured"), f("value")).alias("value"), score.alias("quality_score"), F.when(f("measured"), f("dispersion")).alias("dispersion"),
        "reason_code", "detail", ev.alias("evidence"))
    measurement = F.struct(
        "measurement_id", "aggregate_id", "session_id", "metric_code", "label", "modality", "context", "unit", "value", "quality_score", "algorithm_version", "processor_ref", "track_segment_id", F.lit(0).alias("ordinal"),
        F.transform("windows", lambda w: w.window_id).alias("source_window_refs"))
    return o.select("session_id", "registry_order", outcome.alias("outcome"), F.when(f("measured"), measurement).alias("measurement"), "windows")


def _lane(modality: str, available: Column) -> Column:
    own = F.filter("outcomes", lambda o: o.modality == modality)
    good = F.filter(own, lambda o: o.status == "measured")
    mean = F.aggregate(good, F.lit(0.0), lambda s, o: s + o.quality_score) / F.size(good)
    longest = F.aggregate(own, F.lit(0.0), lambda s, o: F.greatest(s, o.evidence.eligible_ms))
    return F.struct(
        F.when(~available, "unavailable").when(F.size(good) > 0, "ready").otherwise("withheld").alias("state"), longest.alias("eligible_ms"), F.when(F.size(good) > 0, mean).alias("quality_score"),
        F.array_distinct(F.transform(F.filter(own, lambda o: o.status == "withheld"), lambda o: o.reason_code)).alias("reason_codes"))


def completed(processors: Column, outcomes: Column) -> Column:
    """Listed processors, and one that is marked synthetic for each reference of an outcome that is not listed."""
    ref = lambda x: F.struct(x.modality.alias("modality"), x.processor_ref.alias("processor_ref"))
    lost = F.filter(F.transform(outcomes, ref), lambda x: ~F.exists(processors, lambda p: p.processor_ref == x.processor_ref))
    names = F.transform(lost, lambda x: x.processor_ref)
    once = F.filter(lost, lambda x, i: F.array_position(names, x.processor_ref) == i + 1)
    synthetic = F.transform(once, lambda x: F.struct(x.modality.alias("modality"), x.processor_ref.alias("processor_ref"), F.lit(True).alias("synthetic")))
    return F.concat(F.transform(processors, lambda p: F.struct(p.modality.alias("modality"), p.processor_ref.alias("processor_ref"), F.lit(False).alias("synthetic"))), synthetic)


def assemble(outcomes: DataFrame, evidence: DataFrame, sessions: DataFrame, definitions: DataFrame) -> DataFrame:
    """One document per session; its outcomes in registry order, its windows and measurements in the order of their outcomes."""
    part = F.struct("registry_order", "outcome", "measurement", "windows")
    d = artifacts(outcomes, evidence, sessions, definitions).groupBy("session_id").agg(F.array_sort(F.collect_list(part), lambda a, b: a.registry_order - b.registry_order).alias("parts"))
    d = sessions.join(d, "session_id").withColumns({
        "outcomes": F.transform("parts", lambda p: p.outcome), "windows": F.flatten(F.transform("parts", lambda p: p.windows)), "measurements": F.array_compact(F.transform("parts", lambda p: p.measurement)),
        "observation_id": records.safe_id(F.concat(F.lit("observation:"), F.col("session_id").cast("string"))), "duration_ms": F.least(F.lit(LONGEST_MS), F.greatest(F.lit(0.0), F.col("duration_ms"))),
        "source_session_ref": F.col("session_id")})
    eligible = F.size(F.filter("windows", lambda w: w.status == "eligible"))
    quality = F.struct(
        _lane("voice", F.col("voice_available")).alias("voice"), _lane("face", F.col("face_available")).alias("face"), F.size("windows").alias("total"), eligible.alias("eligible"), (F.size("windows") - eligible).alias("withheld"))
    return d.select(
        "session_id", "observation_id", "subject_ref", "protocol", "consent", "source_session_ref", "started_at", "ended_at", "duration_ms", completed(F.col("processors"), F.col("outcomes")).alias("processors"),
        "windows", "measurements", "outcomes", quality.alias("quality"))


def document_errors(documents: DataFrame) -> DataFrame:
    """Rules that a document breaks within itself: ``session_id, error, subject`` (what of it, or null).

    Everything is judged where it lies: arrays are filtered and compared, not
    exploded, and identities are hashed a batch of documents at a time.
    """
    f = F.col
    says = lambda name, subject=None: F.struct(F.lit(name).alias("error"), (F.lit(None).cast("string") if subject is None else subject.cast("string")).alias("subject"))
    when = lambda broken, name: F.when(F.coalesce(broken, F.lit(False)), says(name))
    each = lambda array, broken, name, subject: F.transform(F.filter(array, lambda x: F.coalesce(broken(x), F.lit(False))), lambda x: says(name, subject(x)))
    twice = lambda array, key: F.size(F.array_distinct(F.transform(array, key))) < F.size(array)
    took = (f("ended_at").cast("double") - f("started_at").cast("double")) * 1000
    eligible = F.size(F.filter("windows", lambda w: w.status == "eligible"))
    own = lambda x: metric_identity(f("protocol"), f("session_id"), x)
    measured = F.transform("measurements", own)
    named = F.transform("measurements", lambda m: measurement_identity(own(m), m.source_window_refs[0], m.ordinal))
    d = documents.withColumns({"_o": kernels.fnv1a_each(F.transform("outcomes", own)), "_m": kernels.fnv1a_each(measured), "_n": kernels.fnv1a_each(named)})
    differ = lambda array, key, hashes, mark: F.filter(F.zip_with(array, hashes, lambda x, h: F.when(key(x) != F.concat(F.lit(mark), h), x)), lambda x: x.isNotNull())
    wrong = lambda array, key, hashes, mark, name, subject: F.transform(differ(array, key, hashes, mark), lambda x: says(name, subject(x)))
    alone = F.array_compact(F.array(
        when(took.isNull() | (took < 0), "ended-before-start"), when((took >= 0) & (F.abs(took - f("duration_ms")) > 1000), "duration-mismatch"), when(~f("consent.session_id").eqNullSafe(f("session_id")), "foreign-consent"),
        when(~f("source_session_ref").eqNullSafe(f("session_id")), "foreign-source"), when(twice("windows", lambda w: w.window_id), "window-ids-repeated"), when(twice("measurements", lambda m: m.measurement_id), "measurement-ids-repeated"),
        when(twice("outcomes", lambda o: o.outcome_id), "outcome-ids-repeated"), when(twice("outcomes", lambda o: o.aggregate_id), "aggregate-ids-repeated"), when(twice("outcomes", lambda o: o.metric_code), "metric-codes-repeated"),
        when((f("quality.total") != F.size("windows")) | (f("quality.eligible") != eligible) | (f("quality.withheld") != F.size("windows") - eligible), "window-counts")))
    inside = (
        each("windows", lambda w: ~w.session_id.eqNullSafe(f("session_id")) | (w.end_ms > f("duration_ms")), "window-outside", lambda w: w.window_id),
        each("windows", lambda w: ~F.coalesce(w.end_ms > w.start_ms, F.lit(False)), "window-empty", lambda w: w.window_id),
        wrong("outcomes", lambda o: o.aggregate_id, f("_o"), "agg_", "aggregate-id", lambda o: o.metric_code), wrong("measurements", lambda m: m.aggregate_id, f("_m"), "agg_", "measurement-aggregate-id", lambda m: m.metric_code),
        wrong("measurements", lambda m: m.measurement_id, f("_n"), "msr_", "measurement-id", lambda m: m.metric_code))
    return d.select("session_id", F.explode(F.concat(alone, *inside)).alias("e")).select("session_id", "e.*")


def flat(documents: DataFrame, array: str) -> DataFrame:
    """An array's structs as rows with their ``position`` in the document; the session that a struct names becomes ``own_session_id``."""
    rows = documents.select("session_id", F.posexplode(array).alias("position", "x"))
    return rows.select("session_id", "position", *(F.col(f"x.{c}").alias("own_session_id" if c == "session_id" else c) for c in rows.schema["x"].dataType.names))


def measurement_events(documents: DataFrame) -> DataFrame:
    """What a journal says of each outcome, in order: ``session_id, position, type, metric_code, measurement_id, reason_code``.

    A measured outcome is recorded with the first measurement of its aggregate; one
    without a measurement has no event.  A withheld one has its reason.
    """
    m = provenance.first(flat(documents, "measurements").select("session_id", "aggregate_id", "position", "measurement_id"), ["session_id", "aggregate_id"]).drop("position")
    o = flat(documents, "outcomes").select("session_id", "position", "metric_code", "aggregate_id", "status", "reason_code")
    recorded = o.filter("status = 'measured'").join(m, ["session_id", "aggregate_id"]).withColumn("type", F.lit("measurement.recorded"))
    withheld = o.filter("status = 'withheld'").withColumn("type", F.lit("measurement.withheld")).withColumn("measurement_id", F.lit(None).cast("string"))
    return recorded.unionByName(withheld).select("session_id", "position", "type", "metric_code", "measurement_id", "reason_code")


def requirement_errors(outcomes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Measured outcomes without positive evidence, and requirements of the registry that their facts do not meet; absent facts are skipped."""
    e, fact = F.col("evidence"), lambda name: F.element_at(F.col("evidence.facts"), name)
    value = F.col("value")
    facts = {
        "minimumSegments": e.segments, "minimumPitchedDurationMs": fact("pitchedDurationMs"), "minimumPitchCoverage": F.coalesce(fact("pitchCoverage"), e.coverage), "minimumF0Hz": value, "maximumF0Hz": value,
        **dict.fromkeys(("minimumEligibleSpanMs", "minimumObservationSpanMs", "minimumExposureMs"), e.eligible_ms), "minimumActiveSpeechMs": e.active_ms,
        **dict.fromkeys(("minimumEventsForMedian", "minimumNuclei"), e.events), "minimumBins": e.bins, "minimumCadenceHz": fact("cadenceHz")}
    table = F.map_filter(F.create_map(*(x for k, v in facts.items() for x in (F.lit(k), v.cast("double")))), lambda _, v: v.isNotNull())
    m = outcomes.filter("status = 'measured'").join(F.broadcast(definitions.select(F.col("code").alias("metric_code"), "requirements")), "metric_code").withColumn("_facts", table)
    met = lambda k, actual, limit: F.when(k.startswith("maximum"), actual <= limit).when(k.startswith("minimum"), actual >= limit).otherwise(actual == limit)
    broken = F.map_keys(F.map_filter("requirements", lambda k, limit: F.coalesce(~met(k, F.try_element_at("_facts", k), limit), F.lit(False))))
    bare = F.when((e.eligible_ms <= 0) | (e.samples <= 0), F.array(F.lit("no-positive-evidence"))).otherwise(F.array().cast("array<string>"))
    return m.select("session_id", "metric_code", F.explode(F.concat(bare, F.transform(broken, lambda k: F.concat(F.lit("requirement:"), k)))).alias("error"))


def registry_errors(documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """Documents that lack a registered metric, have one that is not registered, or another number of outcomes."""
    registered = F.array(*(F.lit(r.code) for r in definitions.select("code").collect()))  # a registry is a handful of rows
    own = F.transform("outcomes", lambda o: o.metric_code)
    named = lambda kind, array: F.transform(array, lambda c: F.concat(F.lit(f"{kind}:"), c))
    count = F.when(F.size(own) != F.size(registered), F.array(F.lit("outcome-count"))).otherwise(F.array().cast("array<string>"))
    unknown = F.filter(own, lambda c: ~F.array_contains(registered, c))
    return documents.select("session_id", F.explode(F.concat(count, named("missing", F.array_except(registered, own)), named("unregistered", unknown))).alias("error"))


def validate(documents: DataFrame, definitions: DataFrame, pack: dict[str, str], events: DataFrame) -> DataFrame:
    """One verdict per document: ``session_id, status`` (pass or fail) and ``errors`` with how often each occurs.

    A document that breaks a rule within itself fails for ``schema`` alone, and
    so does one without outcomes.  Others are held against the protocol ``pack``
    (``pack_id, version, content_sha256`` and its ``consent_version,
    consent_sha256``) and the registry, and every reference and measurement is
    resolved among the document's own windows, measurements and outcomes and the
    ``events``.
    """
    f = F.col
    broken = document_errors(documents).select("session_id").union(documents.filter(F.size("outcomes") == 0).select("session_id")).distinct()
    d = settle(documents.join(broken.withColumn("_broken", F.lit(True)), "session_id", "left"))
    sound = d.filter("_broken is null").drop("_broken")
    pack_differs = ~(f("protocol.pack_id").eqNullSafe(F.lit(pack["pack_id"])) & f("protocol.version").eqNullSafe(F.lit(pack["version"])) & f("protocol.content_sha256").eqNullSafe(F.lit(pack["content_sha256"])))
    consent_differs = ~(f("consent.document_version").eqNullSafe(F.lit(pack["consent_version"])) & f("consent.document_sha256").eqNullSafe(F.lit(pack["consent_sha256"])))
    bound = sound.select("session_id", F.explode(F.array_compact(F.array(F.when(pack_differs, "protocol-reference"), F.when(consent_differs, "consent-document")))).alias("error"))
    outcomes = flat(sound, "outcomes").withColumnRenamed("report_section", "section").withColumn("code", f("metric_code")).withColumn("reason", f("reason_code"))
    outcomes = settle(outcomes)
    known = merged(outcomes.join(F.broadcast(definitions.select(f("code").alias("metric_code"))), "metric_code", "left_semi"))  # others are unregistered, and no more is said of them
    defined = records.definition_errors(known, definitions, ["session_id"]).select("session_id", F.concat(F.lit("definition:"), "error").alias("error"))
    refs = known.select("session_id", "metric_code", F.explode("evidence.refs").alias("ref"))
    windows, measurements = flat(sound, "windows"), flat(sound, "measurements")
    observations = sound.select("session_id", "observation_id", "subject_ref", "protocol")
    processors = sound.select("session_id", F.explode("processors").alias("p")).select("session_id", "p.processor_ref").distinct()
    errors = (
        d.filter("_broken").select("session_id", F.lit("schema").alias("error")), bound, registry_errors(sound, definitions), defined, requirement_errors(known, definitions),
        provenance.outcome_errors(known, processors, refs), provenance.reference_errors(refs, known, observations, {"window": windows, "measurement": measurements, "aggregate": outcomes}, events),
        provenance.measurement_errors(measurements, outcomes, windows))
    return provenance.verdicts(documents, *errors)


FACTS = "array<struct<code:string,label:string,value:string,unit:string>>"


def issue(documents: DataFrame, verdicts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Reports of the documents that passed: ``session_id, report_id, observation_id, subject_ref, protocol, sections``.

    Eight sections in order, each with its label, its outcomes in report order
    and, the first alone, five facts of quality (a number's text or a lane's
    state, and a unit).  A document without a passing verdict has no report.
    """
    f = F.col
    places = F.create_map(*(x for r in definitions.select("code", "place").collect() for x in (F.lit(r.code), F.lit(r.place))))  # a registry is a handful of rows
    d = documents.join(verdicts.filter("status = 'pass'").select("session_id"), "session_id", "left_semi")
    fact = lambda code, label, value, unit: F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), value.cast("string").alias("value"), F.lit(unit).cast("string").alias("unit"))
    facts = F.array(
        fact("session-duration", "Session duration", f("duration_ms"), "milliseconds"), fact("voice-lane", "Voice lane", f("quality.voice.state"), None), fact("face-lane", "Face lane", f("quality.face.state"), None),
        fact("eligible-windows", "Eligible windows", f("quality.eligible"), "windows"), fact("withheld-windows", "Withheld windows", f("quality.withheld"), "windows"))
    placed = lambda o: F.coalesce(F.try_element_at(places, o.metric_code), F.lit(0))

    def section(i: int, name: str) -> Column:
        own = F.array_sort(F.filter("outcomes", lambda o: o.report_section == name), lambda a, b: placed(a) - placed(b))
        return F.struct(F.lit(i).alias("position"), F.lit(name).alias("section"), F.lit(SECTION_LABELS[i]).alias("label"), (facts if i == 0 else F.array().cast(FACTS)).alias("facts"), own.alias("outcomes"))

    sections = F.array(*(section(i, name) for i, name in enumerate(SECTIONS)))
    return d.select("session_id", F.concat(F.lit("report-"), "observation_id").alias("report_id"), "observation_id", "subject_ref", "protocol", sections.alias("sections"))


def written(documents: DataFrame) -> DataFrame:
    """Documents as lines of JSON: ``session_id, json``."""
    return documents.select("session_id", F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("json"))


def read_strictly(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Documents read back from ``json``; an error where a line is no document of the schema or has a field beyond it."""
    read = lines.select("json", F.from_json("json", schema, {"mode": "FAILFAST"}).alias("d"))
    same = F.to_json("d", {"ignoreNullFields": "false"}) == F.col("json")
    return read.withColumn("d", F.when(same, F.col("d")).otherwise(F.raise_error(F.lit("a field beyond the schema")).cast(schema))).select("d.*")


