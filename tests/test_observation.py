import duckdb
import pytest
from pyspark.sql import functions as F

from frames import face as face_rows
from frames import voice as voice_rows
from framewright.operators import face, kernels, observation, report, voice
from framewright.plans import observation_queries as queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    at = [want.columns.index(c) for c in columns]
    assert sorted([text(v) for v in r] for r in got.select(*columns).collect()) == sorted([text(r[i]) for i in at] for r in want.fetchall())


@pytest.fixture(scope="module")
def documents(spark):
    """A session with both lanes measured, and one without a frame."""
    voices, faces = voice_rows(spark, duration=60_000), face_rows(spark)
    s = spark.sql("""
        SELECT id AS session_id, 0D AS session_started_at_ms, 2500D AS noise_calibration_duration_ms, 2000D AS calibration_duration_ms, 384D AS baseline_width_px, 360D AS baseline_height_px, 'who' AS subject_ref,
          named_struct('pack_id', 'pack', 'version', '1.0.0', 'content_sha256', 'abc') AS protocol, named_struct('session_id', id, 'document_version', '2', 'document_sha256', 'def') AS consent, timestamp '2026-01-01 00:00:00' AS started_at,
          timestamp '2026-01-01 00:01:01' AS ended_at, 60500D AS duration_ms, array(named_struct('modality', 'face', 'processor_ref', 'p')) AS processors, id = 1 AS voice_available, id = 1 AS face_available FROM range(1, 3)""")
    options = s.select("session_id", "session_started_at_ms", "noise_calibration_duration_ms", "calibration_duration_ms", "baseline_width_px", "baseline_height_px")
    outcomes = report.finalize(voice.voice_outcomes(voices, options), face.face_outcomes(faces, options))
    evidence = voice.evidence(voices, options).withColumn("modality", F.lit("voice")).unionByName(face.evidence(faces, options).withColumn("modality", F.lit("face")))
    known = report.definitions(spark, queries.REASONS)
    d = observation.assemble(outcomes, evidence, s, known)
    return spark.createDataFrame(d.collect(), d.schema), known


def test_assembled_documents(documents):
    one, two = documents[0].orderBy("session_id").collect()
    assert [o.metric_code for o in one.outcomes] == [code for code, _ in report.METRICS] and {o.status for o in one.outcomes} == {"measured"}
    assert (len(one.measurements), one.quality.voice.state, one.quality.face.state, one.quality.total, one.quality.eligible) == (16, "ready", "ready", 7 * 6 + 9 * 12, 7 * 6 + 9 * 12)
    assert [w.window_id for w in one.windows][:2] == ["window:ambient.voice.f0.median:0:voice:1:mic-1:0:10000", "window:ambient.voice.f0.median:1:voice:1:mic-1:10000:20000"]
    assert one.measurements[0].source_window_refs == [f"window:ambient.voice.f0.median:{i}:voice:1:mic-1:{i}0000:{i + 1}0000".replace(":00000:", ":0:") for i in range(6)]
    assert [(p.processor_ref, p.synthetic) for p in one.processors] == [("p", False)]
    assert [r.kind for r in one.outcomes[0].evidence.refs] == ["window"] * 6 + ["measurement", "aggregate"]
    assert {o.reason_code for o in two.outcomes} == {"modality-unavailable"} and two.measurements == [] and two.quality.total == 16
    assert [(p.processor_ref, p.synthetic) for p in two.processors] == [("p", False), ("voice-processor-unavailable", True)]
    assert {(w.start_ms, w.end_ms, w.status) for w in two.windows} == {(0.0, 1.0, "withheld")}


def test_sound_documents_have_no_errors_and_get_reports(spark, documents):
    d, known = documents
    none = spark.createDataFrame([], "event_id string, session_id long, subject_ref string, protocol struct<pack_id:string,version:string,content_sha256:string>, type string, metric_code string")
    assert observation.document_errors(d).collect() == []
    verdicts = observation.validate(d, known, queries.PACK, none)
    assert sorted(map(tuple, verdicts.collect())) == [(1, "pass", ""), (2, "pass", "")]
    other = observation.validate(d, known, queries.PACK | {"version": "2.0.0", "consent_version": "3"}, none)
    assert {r.errors for r in other.collect()} == {"consent-document=1;protocol-reference=1"}
    issued = observation.issue(d, verdicts.filter("session_id = 1"), known)
    (r,) = observation.read_strictly(observation.written(issued), issued.schema).collect()
    assert [s.section for s in r.sections] == list(report.SECTIONS) and [len(s.facts) for s in r.sections] == [5] + [0] * 7
    assert [o.metric_code for o in r.sections[5].outcomes] == ["ambient.face.eye_aperture.asymmetry", "ambient.face.mouth_corner_position.asymmetry"]
    assert sum(len(s.outcomes) for s in r.sections) == 16
    back = observation.read_strictly(observation.written(d), d.schema)
    assert back.exceptAll(d.select(*back.columns)).isEmpty() if "map" not in d.schema.simpleString() else back.count() == 2


def test_strict_reading_refuses_other_fields(spark):
    schema = spark.createDataFrame([], "a long, b string").schema
    good = spark.createDataFrame([('{"a":1,"b":null}',)], "json string")
    assert observation.read_strictly(good, schema).first().a == 1
    for line in ('{"a":1,"b":null,"c":2}', '{"a":1}', '{"a":"x","b":null}', "nothing"):
        with pytest.raises(Exception, match="beyond the schema|MALFORMED"):
            observation.read_strictly(spark.createDataFrame([(line,)], "json string"), schema).collect()


def test_documents_without_outcomes_or_rows(spark, documents):
    d, known = documents
    none = spark.createDataFrame([], "event_id string, session_id long, subject_ref string, protocol struct<pack_id:string,version:string,content_sha256:string>, type string, metric_code string")
    bare = d.filter("session_id = 2").withColumns({"outcomes": F.slice("outcomes", 1, 0), "windows": F.slice("windows", 1, 0), "measurements": F.slice("measurements", 1, 0), "quality": F.col("quality").withField("total", F.lit(0)).withField("withheld", F.lit(0))})
    assert observation.document_errors(bare).collect() == []
    assert [tuple(r) for r in observation.validate(bare, known, queries.PACK, none).collect()] == [(2, "fail", "schema=1")]
    assert observation.document_errors(d.limit(0)).collect() == [] and observation.validate(d.limit(0), known, queries.PACK, none).collect() == []
    null = d.filter("session_id = 2").withColumns({"ended_at": F.lit(None).cast("timestamp"), "source_session_ref": F.lit(None).cast("long")})
    assert sorted(r.error for r in observation.document_errors(null).collect()) == ["ended-before-start", "foreign-source"]


def test_hash_of_many_texts_at_once(spark):
    def plain(text, utf16=False):
        h = 0xCBF29CE484222325
        for u in memoryview(text.encode("utf-16-le")).cast("H").tolist() if utf16 else text.encode():
            h = (h ^ u) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    texts = ["", "a", "é", "漢字😀", "x" * 300, "ab", "ab", "b" * 17]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", kernels.fnv1a(F.col("t")).alias("a"), kernels.fnv1a(F.col("t"), utf16=True).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(plain(t), plain(t, True)) for t in texts] + [(None, None)]
    each = spark.createDataFrame([(texts,), (None,), ([],), (["a", None],)], "t array<string>").select(kernels.fnv1a_each(F.col("t")).alias("h")).collect()
    assert [r.h for r in each] == [[plain(t) for t in texts], None, [], [plain("a"), None]]


def test_lookups_and_grades_of_small_tables(spark):
    from framewright.operators import signals

    known, wanted = spark.createDataFrame([("a", 1), ("b", 2)], "ref string, n int"), spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "ref string")
    assert sorted(map(tuple, report.complete_refs(known, wanted, "ref").collect()), key=str) == [("a", 1, False), ("b", 2, False), ("c", None, True)]
    assert report.complete_refs(known, wanted.limit(0), "ref").count() == 2
    rows = spark.createDataFrame([("x", 2, "later"), ("x", 1, "first"), ("y", 5, "only")], "k string, n int, v string")
    assert sorted(map(tuple, report.latest_first(rows, ["k"], "n").collect())) == [("x", 1, "first"), ("y", 5, "only")]
    d = spark.createDataFrame([(8, 0), (7, 1), (7, 0), (0, 9)], "r int, e int").select("r", "e", signals.audio_calibration(F.col("r"), F.col("e")).alias("g"))
    assert {(r.r, r.e): r.g for r in d.collect()} == {(8, 0): "strong", (7, 1): "limited", (7, 0): "unavailable", (0, 9): "limited"}


def test_measurement_events_follow_outcomes(documents):
    d, _ = documents
    events = observation.measurement_events(d).orderBy("session_id", "position").collect()
    assert [(e.session_id, e.type) for e in events] == [(1, "measurement.recorded")] * 16 + [(2, "measurement.withheld")] * 16
    one = d.filter("session_id = 1").first()
    assert [e.measurement_id for e in events[:16]] == [m.measurement_id for m in one.measurements] and {e.reason_code for e in events[16:]} == {"modality-unavailable"}
    assert observation.measurement_events(d.limit(0)).collect() == []
