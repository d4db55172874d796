import hashlib
import json
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from frames import voice  # noqa: E402

from framewright.operators import history, journal, kernels, report, signals  # noqa: E402
from framewright.sources import files  # noqa: E402
from framewright.streaming import frames as streams  # noqa: E402


def test_streams_give_the_rows_of_the_batch_forms(spark, tmp_path):
    f = voice(spark, duration=20_000, step=40.0).withColumn("arrival", F.col("seq") + F.when(F.col("seq") % 7 == 0, 3).otherwise(0) + F.col("seq") / 10_000)
    for i in range(4):
        f.filter((F.col("seq") >= i * 125) & (F.col("seq") < (i + 1) * 125)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: streams.from_files(spark, f"{tmp_path}/in", f.schema)
    whole = f.withColumn("batch", (F.col("seq") / 125).cast("int")).withColumn("arrival", F.col("batch") * 1000 + F.col("arrival"))
    want = sorted(r.seq for r in signals.monotonic(whole, "t_ms").collect())
    assert sorted(r.seq for r in streams.drain(streams.monotonic(stream())).collect()) == want
    want = sorted(r.t_ms for r in signals.throttle(f, 10).collect())
    assert sorted(r.t_ms for r in streams.drain(streams.throttle(stream(), 10)).collect()) == want
    closed = streams.drain(streams.cadence(stream(), "0 seconds"))
    assert {(r.start_ms, r.frames) for r in closed.collect()} <= {(k * 5000, 125) for k in range(4)} and closed.count() >= 2


def test_history_file_and_comparison(spark, tmp_path):
    record = lambda i, **k: {"containsPHI": False, "synthetic": True, "visitId": f"v{i}", "participantId": "p", "occurredAt": f"2026-0{i}-01T00:00:00Z", "selectedProtocolId": "x", "reviewStatus": "accepted",
                             "aggregates": [{"code": "a.voice.f0", "unit": "Hz", "contextKind": "turn", "value": 100.0 + i, "spread": 1.0, "confidence": 0.9, "windowCount": 3, "algorithmVersion": "1", "processorRef": "r",
                                             "sourceWindowRefs": ["w"], "confounds": {"kind": "speech", "snrDb": "20"}}]} | k
    old = record(4)
    old["aggregates"][0]["algorithmVersion"] = "0"
    Path(tmp_path / "h.json").write_text(json.dumps([record(1), record(2), record(3), old, record(5), record(9)]))
    h = files.history_records(spark, f"{tmp_path}/h.json")
    visits = h.select(F.col("participantId").alias("participant_id"), F.col("visitId").alias("visit_id"), "occurred_at", F.col("containsPHI").alias("contains_phi"), F.col("reviewStatus").alias("review_status"), F.col("selectedProtocolId").alias("protocol_id"))
    a = h.select(F.col("visitId").alias("visit_id"), F.posexplode("aggregates").alias("position", "a"))
    none = [F.lit(None).cast("double").alias(c) for c in ("width_fraction", "height_fraction", "frame_rate", "illumination")]
    a = a.select("visit_id", "position", F.col("a.code").alias("code"), F.col("a.contextKind").alias("context_kind"), "a.unit", "a.value", "a.spread", "a.confidence", F.size("a.sourceWindowRefs").alias("windows"),
                 F.col("a.algorithmVersion").alias("algorithm_version"), F.col("a.processorRef").alias("processor_ref"), F.col("a.confounds")["kind"].alias("kind"), F.col("a.confounds")["snrDb"].cast("double").alias("snr_db"),
                 *none, F.lit("48k").alias("rate_class"), F.lit("off").alias("processing"))
    current = visits.filter("visit_id = 'v5'").select("participant_id", F.col("visit_id").alias("current_visit"), F.col("occurred_at").alias("current_time"), "protocol_id")
    d = {r.visit_id: (r.status, r.reason_codes) for r in history.decisions(visits, a, current).collect()}
    assert [d[f"v{i}"][0] for i in (1, 2, 3)] == ["included"] * 3 and d["v4"] == ("excluded", ["algorithm-version-mismatch"])
    assert d["v5"][1] == ["not-prior-to-current", "same-as-current-encounter"] and d["v9"][1] == ["not-prior-to-current"]
    b = history.baselines(visits, a, current).collect()
    assert [(r.priors, r.prior_median, r.prior_mad, r.delta, r.direction) for r in b] == [(3, 102.0, 1.0, 3.0, "within-reference")]


def test_journal_breaks_are_named(spark):
    rows = [("s", "a", 1, 1, "e1", 10, None), ("s", "a", 2, 3, "e2", 20, "e1"), ("s", "b", 3, 3, "e2", 15, "e9")]
    e = spark.createDataFrame(rows, "session_id string, subject_ref string, arrival int, sequence int, event_id string, occurred_ms long, caused_by string")
    assert sorted((r.event_id, r.violation) for r in journal.violations(e).collect()) == [("e2", "boundary"), ("e2", "duplicate-id"), ("e2", "sequence"), ("e2", "time-backward"), ("e2", "unknown-cause")]


@pytest.mark.parametrize("hz", [50, 80, 220, 440, 700])
def test_pitch_of_sines(spark, hz):
    import math

    tone = [0.5 * math.sin(2 * math.pi * hz * i / 48_000) for i in range(1920)]
    r = kernels.windows(spark.createDataFrame([(tone,)], "x array<double>"), "x", 48_000.0).first()
    assert r.f0_hz == pytest.approx(hz, rel=0.06) and r.rms == pytest.approx(0.5 / math.sqrt(2), rel=0.05) and r.clipped_sample_fraction == 0
    assert kernels.windows(spark.createDataFrame([(None,), ([],)], "x array<double>"), "x", 48_000.0).filter("f0_hz is null and rms = 0").count() == 2


def test_pose_hash_and_image(spark):
    one = spark.range(1).select(
        kernels.pose(F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))).alias("p"), kernels.fnv1a(F.lit("a")).alias("h"), kernels.fnv1a(F.lit("é"), True).alias("u"), kernels.fnv1a(F.lit("é")).alias("b"),
        kernels.image_quality(F.lit(bytes([255] * 16)), F.lit(2), F.lit(2)).alias("q")).first()
    assert tuple(one.p) == (0.0, 0.0, 0.0) and one.h == "af63dc4c8601ec8c" and one.u != one.b
    assert one.q.illumination_mean == pytest.approx(1) and one.q.bright_clipping == 1 and one.q.sharpness == 0


def test_registry_and_windows(spark):
    assert report.registry(spark).count() == 16
    refs = [("voice:1:mic:0:2000", True), ("voice:1:a:b:0:10", True), ("face:1:mic:0:10", False), ("voice:-1:mic:0:10", False), ("voice:1::0:10", False), ("voice:1:mic:5:5", False), ("voice:1:mic:0", False), ("voice:x:m:0:1", False)]
    got = spark.createDataFrame(refs, "r string, ok boolean").select("ok", report.parse_window(F.col("r"), F.lit("voice"), F.lit(2000.0)).isNotNull().alias("got"))
    assert got.filter("ok != got").count() == 0


def test_assets_and_event_lines(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    m = spark.createDataFrame([("a.bin", digest), ("a.bin", "00"), ("b.bin", digest), ("../a.bin", digest)], "path string, sha256 string")
    assert sorted(r.violation for r in files.verify_assets(spark, str(tmp_path), m).collect()) == ["digest", "missing", "path"]
    (tmp_path / "e.jsonl").write_text('{"eventId": "e1", "sequence": 1}\nnot an event\n')
    e = files.event_lines(spark, f"{tmp_path}/e.jsonl").cache()
    assert e.count() == 2 and e.filter("_corrupt_record is not null").count() == 1


def test_a_new_capture_epoch_starts_over_in_both_forms(spark, tmp_path):
    rows = [(1, 1, a, s, float(s)) for a, s in enumerate((1, 2, 5, 3, 6))] + [(1, 2, 10 + a, s, float(s)) for a, s in enumerate((1, 3, 2, 4))]
    f = spark.createDataFrame(rows, "session_id long, capture_epoch long, arrival long, seq long, t_ms double")
    f.coalesce(1).write.parquet(f"{tmp_path}/in")
    want = [(1, 1), (1, 2), (1, 5), (1, 6), (2, 1), (2, 3), (2, 4)]
    assert sorted((r.capture_epoch, r.seq) for r in signals.monotonic(f, "t_ms").collect()) == want
    assert sorted((r.capture_epoch, r.seq) for r in streams.drain(streams.monotonic(streams.from_files(spark, f"{tmp_path}/in", f.schema))).collect()) == want


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from framewright.functions.tables import shared_folder

    def session(master, root=None):
        conf = SimpleNamespace(get=lambda key, default: root or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://host:7077", "/shared"), "settled").startswith("/shared/settled/")
    assert "framewright-" in shared_folder(session("local[8]"), "settled")
    with pytest.raises(ValueError, match="share"):
        shared_folder(session("local-cluster[2,1,1024]"), "settled")


def test_region_of_an_image(spark):
    """A square that is white on the left and black on the right, whole and by its halves."""
    row = lambda *shades: b"".join(bytes([g, g, g, 255]) for g in shades)
    half = row(*[255] * 8, *[0] * 8) * 16
    boxes = [None, (0.0, 0.0, 0.5, 1.0), (0.5, 0.0, 0.5, 1.0), (0.25, 0.25, 0.5, 0.5), (0.9, 0.9, 5.0, 5.0), (0.99, 0.0, 0.0, 0.0)]
    rows = [(i, half, 16, b) for i, b in enumerate(boxes)] + [(6, None, 16, None), (7, b"", 0, None), (8, row(51, 51, 51, 51), 2, None)]
    d = spark.createDataFrame(rows, "i int, p binary, n int, b struct<x:double,y:double,width:double,height:double>")
    q = {r.i: (r.q.illumination_mean, r.q.dark_clipping, r.q.bright_clipping, r.q.sharpness) for r in d.select("i", kernels.region_quality(F.col("p"), F.col("n"), F.col("n"), F.col("b")).alias("q")).collect()}
    assert q[0][0] == pytest.approx(0.5, abs=0.002) and 0.4 < q[0][1] < 0.5 and q[0][3] > 0
    assert q[1] == pytest.approx((1.0, 0.0, 1.0, 0.0)) and q[2] == (0.0, 1.0, 0.0, 0.0) and q[3][0] == pytest.approx(0.5, abs=0.002)
    assert q[4] == q[5] == (0.0, 1.0, 0.0, 0.0) and q[6] == q[7] == (0.0, 1.0, 0.0, 0.0)
    assert q[8] == pytest.approx((0.2, 0.0, 0.0, 0.0))


def test_readers_order(spark):
    from framewright.functions.stats import by_locale

    d = spark.createDataFrame([(x,) for x in ("b", "B", "a", "A", "á", "Z", "ab", None, "")], "t string")
    assert [r.t for r in d.orderBy(by_locale("t")).collect()] == [None, "", "a", "A", "á", "ab", "b", "B", "Z"]


AGGREGATE = (
    "visit_id long, code string, context_kind string, value double, spread double, confidence double, windows int, snr_db double, width_fraction double, height_fraction double, frame_rate double, illumination double, position int, unit string, "
    "algorithm_version string, processor_ref string, kind string, rate_class string, processing string"
)


def test_comparisons_are_whole_or_refused(spark):
    """A subject with enough earlier records, one with too few, and one for each thing that is wrong with a current record."""
    visits, aggregates, current = [], [], []
    usual = {"context": "turn", "value": 100.0, "spread": 1.0, "confidence": 0.9, "windows": 3, "snr": 20.0, "w": None, "h": None, "f": None, "i": None, "p": 0, "unit": "Hz", "a": "1", "r": "p", "kind": "speech", "rate": "48k", "proc": "off"}
    aggregate = lambda v, code="b.voice.x", **k: (v, code, *(usual | k).values())
    wrong = {3: [aggregate(33, confidence=2.0)], 4: [aggregate(43), aggregate(43)], 5: [], 6: [aggregate(63)]}
    for who in range(1, 7):
        for n in range(4):
            visit = who * 10 + n
            visits.append((who, visit, f"2026-0{n + 1}-01", who == 6 and n == 3, "accepted", "x"))
            aggregates += wrong[who] if n == 3 and who in wrong else [aggregate(visit, value=100.0 + n), aggregate(visit, "A.voice.y", value=50.0)] if who != 2 or n > 1 else []
        current.append((who, who * 10 + 3, "2026-04-01", "x"))
    v = spark.createDataFrame(visits, "participant_id long, visit_id long, occurred_at string, contains_phi boolean, review_status string, protocol_id string").withColumn("occurred_at", F.to_timestamp("occurred_at"))
    c = spark.createDataFrame(current, "participant_id long, current_visit long, current_time string, protocol_id string").withColumn("current_time", F.to_timestamp("current_time"))
    a = spark.createDataFrame(aggregates, AGGREGATE)
    got = {r.participant_id: r for r in history.compare(v, a, c).collect()}
    assert {k: (r.status, r.reason_codes) for k, r in got.items()} == {
        1: ("provisional", []), 2: ("not-comparable", ["insufficient-prior-observations"]), 3: ("refused", ["aggregate-confidence-out-of-range"]), 4: ("refused", ["duplicate-aggregate-identity"]), 5: ("refused", ["no-aggregates"]),
        6: ("refused", ["current-not-explicitly-non-phi"])}
    assert got[1].included == [10, 11, 12] and [x.visit_id for x in got[1].excluded] == [13]
    assert [(b.code, b.priors, b.delta, b.direction) for b in got[1].biomarkers] == [("A.voice.y", 3, 0.0, "within-reference"), ("b.voice.x", 3, 2.0, "within-reference")]
    assert got[2].included == [22] and got[3].included == got[3].excluded == got[3].biomarkers == []
    assert history.compare(v.limit(0), a.limit(0), c.limit(0)).collect() == []
    for bad in ({"id": " "}, {"minimum_prior": 0}, {"minimum_prior": 1.5}, {"snr_db": float("nan")}, {"framing": -0.1}):
        with pytest.raises(ValueError):
            history.Policy(**bad)
