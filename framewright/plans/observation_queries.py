"""Queries of observation documents: assembled from voice and face frames of the same sessions, validated whole and broken, and issued as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tables import settle
from framewright.operators import face, observation, report, voice
from framewright.plans import oracle_sql as sql
from framewright.plans.voice_queries import rounded
from framewright.sources.surrogates import face_frames, voice_frames

PACK = {"pack_id": "pack", "version": "1.0.0", "content_sha256": "abc", "consent_version": "2", "consent_sha256": "def"}
#: Reasons for which the registry lets outcomes be withheld.
REASONS = (
    "modality-unavailable", "quality-threshold-failed", "no-usable-signal", "insufficient-duration", "insufficient-active-speech", "insufficient-pitched-speech", "insufficient-segments", "insufficient-bins", "insufficient-events",
    "insufficient-nuclei", "insufficient-pitch-bins", "multiple-faces", "insufficient-exposure", "insufficient-frame-cadence",
)


def _sessions(voices: DataFrame, faces: DataFrame) -> DataFrame:
    """Sessions of either sensor: options of both lanes, and what a document says beside its outcomes.

    A lane without frames, and every seventeenth voice lane, is unavailable;
    every fifth session lists no voice processor.
    """
    ids = voices.select("session_id", F.lit(1).alias("v"), F.lit(0).alias("f")).distinct().unionByName(faces.select("session_id", F.lit(0).alias("v"), F.lit(1).alias("f")).distinct())
    s, k = ids.groupBy("session_id").agg(F.max("v").alias("v"), F.max("f").alias("f")), F.col("session_id")
    listed = lambda modality, ref: F.struct(F.lit(modality).alias("modality"), F.lit(ref).alias("processor_ref"))
    start = F.timestamp_seconds(F.lit(1_760_000_000) + k * 600)
    duration = (120_000 + k % 3 * 1000).cast("double")
    return s.select(
        "session_id", F.lit(0.0).alias("session_started_at_ms"), F.when(k % 13 == 3, 1999.0).otherwise(2500.0).alias("noise_calibration_duration_ms"), F.when(k % 12 == 11, 1499.0).otherwise(2000.0).alias("calibration_duration_ms"),
        F.lit(384.0).alias("baseline_width_px"), F.lit(360.0).alias("baseline_height_px"), F.concat(F.lit("subject-"), k.cast("string")).alias("subject_ref"),
        F.struct(*(F.lit(PACK[c]).alias(c) for c in ("pack_id", "version", "content_sha256"))).alias("protocol"),
        F.struct(k.alias("session_id"), F.lit(PACK["consent_version"]).alias("document_version"), F.lit(PACK["consent_sha256"]).alias("document_sha256")).alias("consent"), start.alias("started_at"),
        F.timestamp_millis(F.unix_millis(start) + duration.cast("long") + 400).alias("ended_at"), duration.alias("duration_ms"),
        F.when(k % 5 == 4, F.array(listed("face", "proc-v"))).otherwise(F.array(listed("voice", "proc-a"), listed("face", "proc-v"))).alias("processors"), ((F.col("v") == 1) & (k % 17 != 3)).alias("voice_available"), (F.col("f") == 1).alias("face_available"))


def _evidence(voices: DataFrame, faces: DataFrame, s: DataFrame, spoken: tuple[DataFrame, DataFrame] | None = None, seen: DataFrame | None = None) -> DataFrame:
    return voice.evidence(voices, s, spoken).withColumn("modality", F.lit("voice")).unionByName(face.evidence(faces, s, seen).withColumn("modality", F.lit("face")))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    voices, faces = voice_frames(spark, sf_dir), face_frames(spark, sf_dir)
    s, known = settle(_sessions(voices, faces)), report.definitions(spark, REASONS)
    options = s.select("session_id", "session_started_at_ms", "noise_calibration_duration_ms", "calibration_duration_ms", "baseline_width_px", "baseline_height_px")
    spoken, seen = voice.prepared(voices, options), face.prepared(faces, options)
    outcomes = report.finalize(voice.voice_outcomes(voices, options, spoken), face.face_outcomes(faces, options, seen))
    return settle(observation.assemble(outcomes, _evidence(voices, faces, options, spoken, seen), s, known)), known


def a32_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the outcomes of each session and modality rest on."""
    voices, faces = voice_frames(spark, sf_dir), face_frames(spark, sf_dir)
    listed = {c: F.array_join(c, ",") for c in ("processor_refs", "track_segment_ids", "source_window_refs")}
    return rounded(_evidence(voices, faces, _sessions(voices, faces)).withColumns(listed).withColumn("sample_count", F.col("sample_count").cast("long")))


def r11_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the documents, with the identities and references that assembly gives them."""
    o = observation.flat(_documents(spark, sf_dir)[0], "outcomes")
    kinds = lambda kind: F.size(F.filter("evidence.refs", lambda r: r.kind == kind)).alias(f"{kind}_refs")
    return o.select("session_id", "position", "metric_code", "status", "reason_code", "detail", "processor_ref", "track_segment_id", "aggregate_id", kinds("window"), kinds("measurement"), kinds("aggregate"))


def r11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = observation.flat(_documents(spark, sf_dir)[0], "windows")
    return w.select("session_id", "window_id", "start_ms", "end_ms", "status", F.array_join("reason_codes", ",").alias("reasons"))


def r12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane summaries, window counts and processors of the documents."""
    d, _ = _documents(spark, sf_dir)
    lane = lambda m: (F.col(f"quality.{m}.state").alias(f"{m}_state"), F.col(f"quality.{m}.eligible_ms").alias(f"{m}_ms"), F.col(f"quality.{m}.quality_score").alias(f"{m}_score"), F.array_join(F.array_sort(f"quality.{m}.reason_codes"), ",").alias(f"{m}_reasons"))
    refs = F.array_join(F.transform("processors", lambda p: F.concat(p.processor_ref, F.when(p.synthetic, "*").otherwise(""))), ",")
    return rounded(d.select("session_id", "observation_id", *lane("voice"), *lane("face"), "quality.total", "quality.eligible", "quality.withheld", F.size("measurements").alias("measurements"), refs.alias("processors")))


def _changed(array: str, at: int, **fields: Column) -> Column:
    """The array with fields of one struct replaced."""
    def one(x: Column, i: Column) -> Column:
        y = x
        for name, value in fields.items():
            y = y.withField(name, value)
        return F.when(i == at, y).otherwise(x)

    return F.transform(array, one)


def _broken(d: DataFrame) -> DataFrame:
    """Every rule broken in some documents, by their session's number."""
    k = F.col("session_id")
    case = lambda c, *changes: F.coalesce(*(F.when(k % 17 == n, new) for n, new in changes), F.col(c)).alias(c)
    other, twice = k + 1000, lambda c: F.concat(c, F.slice(c, 1, 1))
    count = F.col("quality").withField("eligible", F.col("quality.eligible") + 1)
    late = F.lit(200_000.0)
    return d.select(
        "session_id", "observation_id", "subject_ref", "protocol", case("consent", (3, F.col("consent").withField("session_id", other))), case("source_session_ref", (4, other)), "started_at",
        case("ended_at", (1, F.timestamp_millis(F.unix_millis("started_at") - 1)), (2, F.timestamp_millis(F.unix_millis("ended_at") + 5000))), "duration_ms", "processors",
        case("windows", (5, twice("windows")), (9, _changed("windows", 0, session_id=other)), (10, _changed("windows", 0, end_ms=late)), (14, _changed("windows", 0, end_ms=F.lit(-1.0)))),
        case("measurements", (6, twice("measurements")), (12, _changed("measurements", 0, aggregate_id=F.lit("agg_0"))), (13, _changed("measurements", 0, measurement_id=F.lit("msr_0"))), (15, _changed("measurements", 0, ordinal=F.lit(1)))),
        case("outcomes", (7, twice("outcomes")), (11, _changed("outcomes", 0, aggregate_id=F.lit("agg_0")))), case("quality", (8, count)))


def r13_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observation.document_errors(_broken(_documents(spark, sf_dir)[0]))
    return e.select("session_id", "error", F.when(F.col("error").contains("aggregate-id") | (F.col("error") == "measurement-id"), F.col("subject")).alias("metric_code"))


def _events(d: DataFrame) -> DataFrame:
    """An event for the first measurement of each document; some of another subject, some of another metric, and each twice, wrong the second time."""
    k, m = F.col("session_id"), F.col("measurements")[0]
    e = d.filter(F.size("measurements") > 0).select(
        F.concat(F.lit("e:"), k.cast("string")).alias("event_id"), F.lit(1).alias("position"), "session_id", F.when(k % 11 == 1, "nobody").otherwise(F.col("subject_ref")).alias("subject_ref"), "protocol",
        F.lit("measurement.recorded").alias("type"), F.when(k % 11 == 2, "none").otherwise(m.metric_code).alias("metric_code"))
    return e.unionByName(e.withColumn("position", F.lit(2)).withColumn("subject_ref", F.lit("later")))


def _doubted(d: DataFrame) -> DataFrame:
    """Sound documents that the registry, the pack or a reference contradicts, by their session's number; the others hold.

    Every document with measurements refers to its event from the first measured
    outcome; every eleventh to one that does not exist.
    """
    k = F.col("session_id")
    case = lambda c, *changes: F.coalesce(*(F.when(k % 23 == n, new) for n, new in changes), F.col(c)).alias(c)
    target = F.concat(F.when(k % 11 == 3, "none:").otherwise("e:"), k.cast("string"))
    first = F.col("measurements")[0].metric_code

    def with_event(o: Column) -> Column:
        refs = o.evidence.refs
        return F.when(o.metric_code == first, o.withField("evidence", o.evidence.withField("refs", F.concat(refs, F.array(refs[0].withField("kind", F.lit("event")).withField("target_id", target)))))).otherwise(o)

    said = d.withColumn("outcomes", F.when(F.size("measurements") > 0, F.transform("outcomes", with_event)).otherwise(F.col("outcomes")))
    evidence = lambda name, value: F.transform("outcomes", lambda o: F.when(o.status == "measured", o.withField("evidence", o.evidence.withField(name, value(o)))).otherwise(o))
    refs = lambda change: evidence("refs", lambda o: F.transform(o.evidence.refs, change))
    return said.select(
        "session_id", "observation_id", "subject_ref", "protocol", case("consent", (2, F.col("consent").withField("document_version", F.lit("0")))), "source_session_ref", "started_at", "ended_at", "duration_ms",
        case("processors", (3, F.filter("processors", lambda p: p.modality == "voice"))), case("windows", (4, F.transform("windows", lambda w: F.when(w.status == "eligible", w.withField("processor_ref", F.lit("other"))).otherwise(w)))), "measurements",
        case(
            "outcomes", (5, F.slice("outcomes", 1, 15)), (6, F.transform("outcomes", lambda o, i: F.when(i == 0, o.withField("label", F.lit("?")).withField("technical_verification", F.lit("manual"))).otherwise(o))),
            (7, F.transform("outcomes", lambda o: F.when(o.status == "withheld", o.withField("reason_code", F.lit("whim"))).otherwise(o))), (8, evidence("samples", lambda o: F.lit(0).cast("long"))), (9, evidence("segments", lambda o: F.lit(2).cast("long"))),
            (10, refs(lambda r: F.when(r.kind == "window", r.withField("track_segment_id", F.lit("t9"))).otherwise(r))), (12, refs(lambda r: r.withField("observation_id", F.lit("o9")))),
            (13, refs(lambda r: F.when(r.kind == "measurement", r.withField("target_id", F.lit("msr_9"))).otherwise(r))), (14, evidence("refs", lambda o: F.filter(o.evidence.refs, lambda r: r.kind != "measurement"))),
            (15, refs(lambda r: F.when(r.kind == "aggregate", r.withField("unit", F.lit("st"))).otherwise(r))),
            (16, F.transform("outcomes", lambda o, i: F.when(i == 15, o.withField("value", F.lit(1.0)).withField("report_section", F.lit("pitch"))).otherwise(o)))), case("quality", (1, F.col("quality").withField("total", F.lit(0)))))


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, known = _documents(spark, sf_dir)
    doubted = settle(_doubted(d))
    return doubted, observation.validate(doubted, known, PACK, _events(d)), known


def r17_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)[1]


def r18_issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issued reports, written as JSON and read back, a row per section: its facts and its outcomes in order."""
    issued = observation.issue(*_verdicts(spark, sf_dir))
    back = observation.read_strictly(observation.written(issued), issued.schema)
    s = back.select("session_id", "report_id", F.explode("sections").alias("s")).select("session_id", "report_id", "s.*")
    return s.select(
        "session_id", "report_id", "position", "section", "label", F.array_join(F.transform("facts", lambda f: F.concat_ws("=", f.code, f.value, f.unit)), ";").alias("facts"),
        F.array_join(F.transform("outcomes", lambda o: F.concat_ws("=", o.metric_code, F.coalesce(o.reason_code, o.status))), ";").alias("outcomes"))


def j16_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal events of the outcomes; every eighth document has lost its last measurement, which then has none."""
    d, _ = _documents(spark, sf_dir)
    lost = F.slice("measurements", 1, F.greatest(F.size("measurements") - 1, F.lit(0)))
    return observation.measurement_events(d.withColumn("measurements", F.when(F.col("session_id") % 8 == 3, lost).otherwise(F.col("measurements"))))


QUERIES = {
    "j16_measurement_events": j16_events, "a32_evidence_refs": a32_evidence, "r11_outcomes": r11_outcomes, "r11_windows": r11_windows, "r12_quality_summary": r12_quality, "r13_document_errors": r13_errors, "r17_document_verdicts": r17_documents, "r18_issued_reports": r18_issued,
}

_BOTH = {"calibration FROM voice)": "calibration FROM (SELECT session_id FROM voice UNION SELECT l_orderkey // 375 FROM lineitem))", "calibration FROM face)": "calibration FROM (SELECT session_id FROM face UNION SELECT event_id // 1000 FROM events))"}


def _of_both(text: str) -> str:
    """Metrics of the sessions of either sensor."""
    for a, b in _BOTH.items():
        text = text.replace(a, b)
    return text


#: Outcomes of both modalities (the blink metric without its count) and what they rest on.
_E = "WITH v AS (" + _of_both(sql.VOICE_METRICS) + "), g AS (" + _of_both(sql.FACE_METRICS) + "), sg AS (WITH " + sql.SEGMENTS + " SELECT * FROM segs), fb AS (WITH " + sql.FACE + """ SELECT session_id, bin, n, track FROM bins),
  vf AS (WITH """ + sql.VOICE + """ SELECT session_id, min(t_ms) AS o0, max(t_ms) AS o1, list_sort(list(DISTINCT proc)) AS procs, list_sort(list(DISTINCT track)) AS tracks FROM voice GROUP BY ALL),
  ff AS (WITH """ + sql.FACE + """ SELECT session_id, min(t_ms) AS o0, max(t_ms) AS o1, ['proc-v'] AS procs, list_sort(list(DISTINCT track)) AS tracks FROM gapped GROUP BY ALL),
  sv AS (SELECT session_id, sum(n)::BIGINT AS samples, count(*) AS segments, list_sort(list(DISTINCT proc)) AS procs, list_sort(list(DISTINCT track)) AS tracks,
                list('voice:1:' || track || ':' || t0::BIGINT || ':' || (t1 + nominal)::BIGINT ORDER BY t0) AS refs FROM sg GROUP BY ALL),
  sf AS (SELECT session_id, sum(n)::BIGINT AS samples, count(DISTINCT track) AS segments, ['proc-v'] AS procs, list_sort(list(DISTINCT track)) AS tracks, list('face:1:' || track || ':' || bin * 5000 || ':' || (bin + 1) * 5000 ORDER BY bin) AS refs FROM fb GROUP BY ALL),
  ss AS (SELECT session_id FROM vf UNION SELECT session_id FROM ff),
  e AS (SELECT session_id, 'voice' AS modality, o0, o1, coalesce(samples, 0) AS samples, coalesce(segments, 0) AS segments, coalesce(sv.procs, vf.procs, []) AS procs, coalesce(sv.tracks, vf.tracks, []) AS tracks, coalesce(refs, []) AS refs
        FROM ss LEFT JOIN vf USING (session_id) LEFT JOIN sv USING (session_id)
        UNION ALL SELECT session_id, 'face', o0, o1, coalesce(samples, 0), coalesce(segments, 0), coalesce(sf.procs, ff.procs, []), coalesce(sf.tracks, ff.tracks, []), coalesce(refs, []) FROM ss LEFT JOIN ff USING (session_id) LEFT JOIN sf USING (session_id)),
  k AS (SELECT session_id, coalesce(reason, CASE WHEN exposure_ms < 60000 THEN 'insufficient-exposure' WHEN frames / (exposure_ms / 1000) < 24 THEN 'insufficient-frame-cadence' END) AS reason, exposure_ms, quality_score FROM g WHERE ordinal = 0),
  o AS (SELECT session_id, ordinal AS r, code, unit, 'voice' AS modality, status, reason, eligible_ms AS ms, quality_score FROM v UNION ALL SELECT session_id, 7 + ordinal, code, unit, 'face', status, reason, exposure_ms, quality_score FROM g
        UNION ALL SELECT session_id, 15, 'ambient.face.blink_rate.bilateral', 'events/minute', 'face', CASE WHEN reason IS NULL THEN 'measured' ELSE 'withheld' END, reason, exposure_ms, CASE WHEN reason IS NULL THEN quality_score END FROM k),
  x AS (SELECT o.*, o0, o1, procs, tracks, refs, status = 'measured' AND len(procs) = 1 AND len(tracks) = 1 AS m, greatest(len(refs), 1)::INT AS n_w, (120000 + session_id % 3 * 1000)::DOUBLE AS duration,
          CASE modality WHEN 'voice' THEN session_id IN (SELECT session_id FROM vf) AND session_id % 17 <> 3 ELSE session_id IN (SELECT session_id FROM ff) END AS available,
          CASE WHEN len(procs) = 1 THEN procs[1] WHEN len(procs) > 1 THEN modality || '-mixed-provenance' WHEN modality = 'face' THEN 'proc-v' WHEN session_id % 5 = 4 THEN 'voice-processor-unavailable' ELSE 'proc-a' END AS proc,
          CASE WHEN len(tracks) = 1 THEN tracks[1] WHEN len(tracks) > 1 THEN modality || '-mixed-provenance' ELSE modality || '-track-unavailable' END AS track FROM o JOIN e USING (session_id, modality)),
  y AS (SELECT *, CASE WHEN NOT m THEN CASE WHEN NOT available THEN 'modality-unavailable' WHEN status = 'measured' THEN 'quality-threshold-failed' ELSE reason END END AS code_reason FROM x),
  t AS (SELECT session_id, count(*) FILTER (m) AS n_m, count(*) FILTER (NOT m) AS n_h, count(*) FILTER (m AND modality = 'voice') AS n_v, sum(n_w) AS n_w, coalesce(sum(n_w) FILTER (m), 0) AS n_e, arg_min(code, r) FILTER (m) AS first, bool_or(m AND r = 0) AS m0,
               bool_or(m AND r = 15) AS mb, count(*) FILTER (m AND modality = 'face' AND r < 15 AND ms < 30000) AS n_short FROM y GROUP BY ALL)"""
_ID = "'4:pack|5:1.0.0|' || " + " || '|' || ".join(f"strlen({c}) || ':' || {c}" for c in ("session_id::VARCHAR", "code", "(CASE modality WHEN 'voice' THEN 'ambient' ELSE 'ambient-frontal' END)", "unit", "'1.0.0'", "proc", "track"))
_fnv = lambda text: f"lpad(lower(to_hex(list_reduce([14695981039346656037::UHUGEINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::UHUGEINT), lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT)), 16, '0')"
_FNV = _fnv(_ID)
_FIRST = "('window:' || code || ':0:' || CASE WHEN len(refs) > 0 THEN refs[1] ELSE modality || '-unavailable' END)"

ORACLES = {
    "j16_measurement_events": _E + f"""
        SELECT session_id, r::INT AS position, CASE WHEN m THEN 'measurement.recorded' ELSE 'measurement.withheld' END AS type, code AS metric_code, CASE WHEN m THEN 'msr_' || {_fnv(f"({_ID} || '|' || strlen({_FIRST}) || ':' || {_FIRST} || '|0')")} END AS measurement_id,
               code_reason AS reason_code FROM y WHERE NOT (m AND session_id % 8 = 3 AND r = (SELECT max(r) FROM y z WHERE z.m AND z.session_id = y.session_id))""",
    "a32_evidence_refs": _E + """
        SELECT session_id, modality, o0 AS observed_start_ms, o1 AS observed_end_ms, samples::BIGINT AS sample_count, segments::BIGINT AS segment_count, array_to_string(procs, ',') AS processor_refs, array_to_string(tracks, ',') AS track_segment_ids,
               array_to_string(refs, ',') AS source_window_refs FROM e""",
    "r11_outcomes": _E + f"""
        SELECT session_id, r::INT AS position, code AS metric_code, CASE WHEN m THEN 'measured' ELSE 'withheld' END AS status, code_reason AS reason_code,
               CASE WHEN NOT m THEN CASE WHEN NOT available THEN 'modality-unavailable' WHEN status = 'measured' THEN 'mixed-or-missing-provenance' END END AS detail, proc AS processor_ref, track AS track_segment_id, 'agg_' || {_FNV} AS aggregate_id,
               n_w AS window_refs, m::INT AS measurement_refs, 1 AS aggregate_refs FROM y""",
    "r11_windows": _E + """,
        u AS (SELECT *, unnest(CASE WHEN len(refs) > 0 THEN refs ELSE [modality || '-unavailable'] END) AS ref, unnest(range(n_w)) AS i FROM y)
        SELECT session_id, 'window:' || code || ':' || i || ':' || ref AS window_id, CASE WHEN len(refs) > 0 THEN string_split(ref, ':')[4]::DOUBLE ELSE greatest(0, coalesce(o0, 0)) END AS start_ms,
               CASE WHEN len(refs) > 0 THEN string_split(ref, ':')[5]::DOUBLE ELSE least(duration, greatest(greatest(0, coalesce(o0, 0)) + 1, coalesce(o1, 0))) END AS end_ms, CASE WHEN m THEN 'eligible' ELSE 'withheld' END AS status, coalesce(code_reason, '') AS reasons FROM u""",
    "r12_quality_summary": _E + """,
        l AS (SELECT session_id, modality, CASE WHEN NOT bool_and(available) THEN 'unavailable' WHEN bool_or(m) THEN 'ready' ELSE 'withheld' END AS state, max(ms)::DOUBLE AS ms, round(avg(quality_score) FILTER (m), 6) AS score,
                     coalesce(array_to_string(list_sort(list(DISTINCT code_reason) FILTER (code_reason IS NOT NULL)), ','), '') AS reasons, any_value(proc) AS proc FROM y GROUP BY ALL)
        SELECT a.session_id, 'observation:' || a.session_id AS observation_id, a.state AS voice_state, a.ms AS voice_ms, a.score AS voice_score, a.reasons AS voice_reasons, b.state AS face_state, b.ms AS face_ms, b.score AS face_score, b.reasons AS face_reasons,
               n_w::INT AS total, n_e::INT AS eligible, (n_w - n_e)::INT AS withheld, n_m::INT AS measurements,
               concat_ws(',', CASE WHEN a.session_id % 5 = 4 THEN 'proc-v' ELSE 'proc-a,proc-v' END, CASE WHEN a.session_id % 5 = 4 OR a.proc <> 'proc-a' THEN a.proc || '*' END, CASE WHEN b.proc <> 'proc-v' THEN b.proc || '*' END) AS processors
        FROM l a JOIN l b ON b.session_id = a.session_id AND a.modality = 'voice' AND b.modality = 'face' JOIN t ON t.session_id = a.session_id""",
    "r13_document_errors": _E + """,
        c AS (SELECT *, session_id % 17 AS c FROM t)
        SELECT session_id, unnest(CASE c WHEN 1 THEN ['ended-before-start'] WHEN 2 THEN ['duration-mismatch'] WHEN 3 THEN ['foreign-consent'] WHEN 4 THEN ['foreign-source'] WHEN 5 THEN ['window-ids-repeated', 'window-counts']
                 WHEN 7 THEN ['outcome-ids-repeated', 'aggregate-ids-repeated', 'metric-codes-repeated'] WHEN 8 THEN ['window-counts'] WHEN 9 THEN ['window-outside'] WHEN 10 THEN ['window-outside'] WHEN 14 THEN ['window-empty'] ELSE [] END) AS error, NULL AS metric_code FROM c
        UNION ALL SELECT session_id, 'measurement-ids-repeated', NULL FROM c WHERE c = 6 AND n_m > 0 UNION ALL SELECT session_id, 'aggregate-id', 'ambient.voice.f0.median' FROM c WHERE c = 11
        UNION ALL SELECT session_id, 'measurement-aggregate-id', first FROM c WHERE c = 12 AND n_m > 0 UNION ALL SELECT session_id, 'measurement-id', first FROM c WHERE c IN (13, 15) AND n_m > 0""",
    "r17_document_verdicts": (_VERDICT := _E + """,
        c AS (SELECT *, session_id % 23 AS c, session_id % 11 AS d FROM t),
        z AS (SELECT session_id, unnest([
            ('schema', (c = 1)::INT), ('consent-document', (c = 2)::INT), ('processor-unresolved', CASE WHEN c = 3 THEN 9 ELSE 0 END), ('incompatible-source-window', CASE WHEN c = 4 THEN n_e ELSE 0 END),
            ('missing:ambient.face.blink_rate.bilateral', (c = 5)::INT), ('outcome-count', (c = 5)::INT), ('no-terminal-aggregate', (c = 5 AND mb OR c = 6 AND m0)::INT), ('definition:label', (c = 6)::INT), ('definition:technical verification', (c = 6)::INT),
            ('definition:withheld reason', CASE WHEN c = 7 THEN n_h ELSE 0 END), ('no-positive-evidence', CASE WHEN c = 8 THEN n_m ELSE 0 END), ('requirement:minimumSegments', CASE WHEN c = 9 THEN n_v ELSE 0 END),
            ('requirement:minimumObservationSpanMs', CASE WHEN c <> 1 THEN n_short ELSE 0 END), ('foreign-context', CASE WHEN c = 12 AND n_m > 0 THEN n_e + 2 * n_m + 1 ELSE 0 END), ('no-measurement-reference', CASE WHEN c = 14 THEN n_m ELSE 0 END),
            ('definition:report section', (c = 16)::INT), ('mismatch', CASE WHEN c IN (1, 12) THEN 0 ELSE CASE c WHEN 10 THEN n_e WHEN 15 THEN n_m ELSE 0 END + (d = 1 AND n_m > 0)::INT END),
            ('other-metric', (c NOT IN (1, 12) AND d = 2 AND n_m > 0)::INT), ('unresolved', CASE WHEN c IN (1, 12) THEN 0 ELSE CASE c WHEN 13 THEN n_m ELSE 0 END + (d = 3 AND n_m > 0)::INT END)]) AS p FROM c),
        q AS (SELECT session_id, list_sort(list(p[1] || '=' || p[2]) FILTER (p[2] > 0)) AS l FROM z GROUP BY ALL),
        w AS (SELECT session_id, CASE WHEN l IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce(array_to_string(l, ';'), '') AS errors FROM q)""") + " SELECT * FROM w",
    "r18_issued_reports": _VERDICT + """,
        n AS (SELECT * FROM (VALUES (0, 'capture-quality', 'Capture quality'), (1, 'pitch', 'Pitch'), (2, 'speech-timing', 'Speech timing'), (3, 'eye-geometry', 'Eye geometry'), (4, 'mouth-geometry', 'Mouth geometry'), (5, 'symmetry', 'Symmetry'),
               (6, 'movement', 'Movement'), (7, 'blink-behavior', 'Blink behavior')) n(position, section, label)),
        h AS (SELECT *, [1, 1, 2, 2, 2, 2, 2, 3, 3, 5, 4, 4, 4, 5, 6, 7][r + 1] AS position FROM y),
        j AS (SELECT session_id, position, string_agg(code || '=' || coalesce(code_reason, 'measured'), ';' ORDER BY r) AS l FROM h GROUP BY ALL),
        s AS (SELECT session_id, bool_and(available) FILTER (modality = 'voice') AS va, bool_and(available) FILTER (modality = 'face') AS fa, bool_or(m) FILTER (modality = 'voice') AS vm, bool_or(m) FILTER (modality = 'face') AS fm, any_value(duration) AS duration FROM y GROUP BY ALL)
        SELECT w.session_id, 'report-observation:' || w.session_id AS report_id, n.position::INT AS position, n.section, n.label,
               CASE WHEN n.position > 0 THEN '' ELSE 'session-duration=' || duration || '=milliseconds;voice-lane=' || CASE WHEN NOT va THEN 'unavailable' WHEN vm THEN 'ready' ELSE 'withheld' END || ';face-lane=' ||
                 CASE WHEN NOT fa THEN 'unavailable' WHEN fm THEN 'ready' ELSE 'withheld' END || ';eligible-windows=' || n_e || '=windows;withheld-windows=' || (n_w - n_e) || '=windows' END AS facts, coalesce(l, '') AS outcomes
        FROM w CROSS JOIN n JOIN t ON t.session_id = w.session_id JOIN s ON s.session_id = w.session_id LEFT JOIN j ON j.session_id = w.session_id AND j.position = n.position WHERE w.status = 'pass'""",
}
