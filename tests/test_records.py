import math

import duckdb
import pytest
from pyspark.sql import functions as F

from framewright.operators import landmarks, provenance, records
from framewright.plans import provenance_queries, record_queries

SF = "/root/testdata/sf0.001"
PAIRS = [(n, m) for m in (record_queries, provenance_queries) for n in m.QUERIES]


@pytest.mark.parametrize(("name", "module"), PAIRS)
def test_query_equals_its_sql(spark, name, module):
    db = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "customer", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = module.QUERIES[name](spark, SF), db.sql(module.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    at = [want.columns.index(c) for c in columns]
    assert sorted([text(v) for v in r] for r in got.select(*columns).collect()) == sorted([text(r[i]) for i in at] for r in want.fetchall())


def test_geometry_of_a_turned_face(spark):
    """A face of known proportions keeps them when it is turned and moved; a missing point gives null."""
    spots = {362: (1, 0), 263: (2, 0), 33: (-2, 0), 133: (-1, 0), 385: (1.2, 0.2), 380: (1.2, -0.2), 387: (1.8, 0.2), 373: (1.8, -0.2), 160: (-1.8, 0.1), 144: (-1.8, -0.1), 158: (-1.2, 0.1), 153: (-1.2, -0.1), 291: (1, 3), 61: (-1, 3), 13: (0, 2.9), 14: (0, 3.1), 70: (-2, -1), 300: (2, -1)}
    rows = []
    for k, (angle, dx) in enumerate(((0.0, 0.0), (0.4, 1.0), (-0.7, 2.0))):
        turned = {i: ((x * math.cos(angle) - y * math.sin(angle) + dx) / 20 + 0.5, (x * math.sin(angle) + y * math.cos(angle)) / 20 + 0.5) for i, (x, y) in spots.items()}
        rows.append((k, [turned.get(i, (0.0, 0.0)) for i in range(478 if k < 2 else 300)], 1000.0 * k))
    faces = spark.createDataFrame(rows, "k long, points array<struct<x:double,y:double>>, acquired_at_ms double").withColumn("one", F.lit(1))
    f = landmarks.features(faces, "points", 20.0, 20.0)  # points lie within the image, 0 to 1
    a, b, c = landmarks.movement_speed(f, ["one"], "k", F.lit(True)).orderBy("k").collect()
    for r in (a, b):
        assert (r.system.scale, r.eye_left, r.eye_right, r.mouth_aperture) == pytest.approx((3, 0.4, 0.2, 0.1))
        assert (r.mouth_left.x, r.mouth_left.y) == pytest.approx((1 / 3, 1))
    assert a.movement_speed is None and b.movement_speed == pytest.approx(0, abs=1e-9)
    assert c.system is None and c.movement_speed is None


@pytest.mark.parametrize("spot", [(1.01, 0.5), (-0.001, 0.5), (0.5, 1.0001), (math.inf, 0.5), (0.5, -math.inf), (math.nan, 0.5), (None, 0.5)])
def test_landmarks_outside_the_image_are_missing(spark, spot):
    edge = [(0.0, 1.0)] * 478
    rows = [(1, edge[:133] + [spot] + edge[134:]), (2, edge)]
    faces = spark.createDataFrame(rows, "k long, points array<struct<x:double,y:double>>")
    bad, good = (r.p for r in faces.select("k", landmarks.pixel(F.col("points"), 133, 640.0, 480.0).alias("p")).orderBy("k").collect())
    assert bad is None and (good.x, good.y) == (0.0, 480.0)


def test_lookups_take_the_first_of_equal_ids(spark):
    """Events, windows, outcomes and measurements that come twice, wrong the second time, add no error and hide none."""
    kinds = "kind string, target_id string, session_id long, observation_id string, protocol struct<pack_id:string,version:string,content_sha256:string>, modality string, context string, unit string, track_segment_id string, metric_code string"
    protocol, common = ("p", "1", "d"), ("voice", "ambient", "Hz", "t1", "m1")
    refs = [(1, "m1", (k, i, 1, "o", protocol, *common)) for k, i in (("window", "w1"), ("measurement", "q1"), ("aggregate", "a1"), ("event", "e1"), ("event", "e2"))]
    columns = "session_id long, position int, metric_code string, modality string, context string, unit string, track_segment_id string, label string, algorithm_version string, processor_ref string, status string, aggregate_id string"
    row = lambda n, track, *more: (1, n, "m1", "voice", "ambient", "Hz", track, "l", "1", "x", *more)
    outcomes = spark.createDataFrame([row(2, "t9", "withheld", "a1"), row(1, "t1", "measured", "a1")], columns)
    windows = spark.createDataFrame([(*row(2, "t9"), "w1"), (*row(1, "t1"), "w1")], columns[: columns.index(", status")] + ", window_id string")
    measurements = spark.createDataFrame([(*row(1, "t1"), "a1", "q1", ["w1"]), (*row(2, "t9"), "a1", "q1", ["w1"])], columns[: columns.index(", status")] + ", aggregate_id string, measurement_id string, source_window_refs array<string>")
    events = spark.createDataFrame([("e1", n, 1, s, protocol, "x", "m1") for n, s in ((1, "s"), (2, "other"))] + [("e2", n, 1, s, protocol, "x", "m1") for n, s in ((2, "s"), (1, "other"))], "event_id string, position int, session_id long, subject_ref string, " + kinds.split(", ")[4] + ", type string, metric_code string")
    seen = spark.createDataFrame([(1, "o", "s", protocol)], "session_id long, observation_id string, subject_ref string, " + kinds.split(", ")[4])
    refs = spark.createDataFrame(refs, "session_id long, metric_code string, ref struct<" + ", ".join(x.replace(" ", ":", 1) for x in kinds.split(", ")) + ">")
    got = provenance.reference_errors(refs, outcomes, seen, {"window": windows, "measurement": measurements, "aggregate": outcomes}, events).collect()
    assert [(r.kind, r.target_id, r.error) for r in got] == [("event", "e2", "mismatch")]
    got = provenance.measurement_errors(measurements.filter("position = 1"), outcomes, windows).collect()
    assert got == []


def test_empty_and_null_records(spark):
    r = spark.sql("SELECT cast(null as string) AS t, cast(array() as array<double>) AS z, array(1D, null, 3D) AS y").select(
        records.safe_id(F.col("t")).alias("id"), records.depth_fractions(F.col("z")).alias("none"), records.depth_fractions(F.col("y")).alias("some"), records.level_fraction(F.lit(None).cast("double")).alias("level")).first()
    assert (r.id, r.none, r.some, r.level) == (None, [], [1.0, 0.5, 0.0], 0.0)
    none = spark.createDataFrame([], "session_id long, error string")
    seen = spark.createDataFrame([(1,)], "session_id long")
    assert [tuple(x) for x in provenance.verdicts(seen, none).collect()] == [(1, "pass", "")]
