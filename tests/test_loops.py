"""Operators with state: the same rows for any cut, in tables and streams; the journal sink; composed face frames."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import kernels, landmarks, loop
from framewright.plans import loop_queries as queries
from framewright.streaming import frames as streams
from framewright.streaming.journal import Journal, JournalError

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    at = [want.columns.index(c) for c in columns]
    assert sorted([text(v) for v in r] for r in got.select(*columns).collect()) == sorted([text(r[i]) for i in at] for r in want.fetchall())


def sounds(n=60, rate=8000.0, lost=(20,), late=(40,), back=(50,)):
    """Blocks of 20 ms: bursts of a 200 Hz tone every 300 ms over faint noise."""
    rng, rows = np.random.default_rng(3), []
    for i in range(1, n + 1):
        t = (np.arange(160) + i * 160) / rate
        x = 0.0005 * rng.normal(size=160) + np.where(t * 1000 % 300 < 160, 0.2 * np.sin(2 * math.pi * 200 * t), 0.0)
        seq, index = (i - 5, (i - 5) * 160) if i in back else (i, i * 160)
        rows.append((1, 1, seq, float(i), index, i * 20.0 + (90 if i in late else 30 if i == 10 else 0), rate, x.tolist()))
    return [r for r in rows if int(r[3]) not in lost]


BLOCKS = "session_id long, capture_epoch long, seq long, arrival double, absolute_sample_index long, acquired_at_ms double, sample_rate_hz double, samples array<double>"


def test_voice_features_of_any_cut(spark, tmp_path, monkeypatch):
    blocks = spark.createDataFrame(sounds(), BLOCKS)
    keys, order = ["session_id", "capture_epoch"], ["arrival"]
    key = lambda rows: [tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in sorted(rows, key=lambda r: r.seq)]
    want = key(loop.over_sessions(blocks, keys, order, loop.voice_features(), loop.VOICE).collect())
    for size in (1, 7):
        monkeypatch.setattr(loop, "STEP_ROWS", size)
        state, got = None, []
        rows = blocks.toPandas()
        for a in range(0, len(rows), size):
            state, out = loop.voice_features()(state, rows.iloc[a : a + size])
            got += out.to_dict("records")
        assert [(r["seq"], f"{r['t_ms']:.9g}", r["syllabic_nucleus"], f"{r['spectral_flux']:.9g}") for r in got] == [(r[2], r[3], r[13], r[12]) for r in want]
    for i in range(4):
        blocks.filter((F.col("arrival") > i * 15) & (F.col("arrival") <= (i + 1) * 15)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert key(streams.drain(streams.voice_features(streams.from_files(spark, f"{tmp_path}/in", blocks.schema))).collect()) == want
    frames = loop.over_sessions(blocks, keys, order, loop.voice_features(), loop.VOICE).orderBy("seq").collect()
    starts = {r.absolute_sample_index for r in frames}
    assert not any(20 * 160 - 320 < s < 21 * 160 for s in starts)  # no window crosses the lost block
    assert not any(40 * 160 - 320 < s < 40 * 160 for s in starts) and max(r.block_gap_ms for r in frames) == 30  # nor the late one; a gap of 30 ms ends no run
    assert state[9] == 3  # one block went back, and two are earlier than the late ones before them
    onsets = [r.t_ms for r in frames if r.syllabic_nucleus]
    assert len(onsets) >= 4 and min(np.diff(onsets)) >= 100 and all(r.periodic and r.f0_hz == pytest.approx(200, rel=0.02) for r in frames if r.speech_active and r.rms > 0.12)
    shares = {r.t_ms: r.lost_block_fraction for r in frames}
    assert min(shares.values()) == 0 and max(shares.values()) == pytest.approx(1 / 22)  # one lost, 21 received when windows begin again


def test_scalar_pitch_is_that_of_the_columns(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        f = rng.uniform(60, 400)
        hz = (f, f * rng.choice((1, 2, 0.5, 1.05, 1.3)) * rng.uniform(0.97, 1.03), f * rng.choice((1, 2)) * rng.uniform(0.9, 1.1))
        rows.append(tuple(v for x in hz for v in (None if rng.random() < 0.15 else float(x), float(rng.random()))))
    names = ("acf_hz", "acf_confidence", "amdf_hz", "amdf_confidence", "zero_hz", "zero_confidence")
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    for r in kernels.resolve(d).collect():
        hz, trust, agreement = loop.resolved(*rows[r.i])
        assert (hz is None) == (r.f0_hz is None) and (hz is None or hz == pytest.approx(r.f0_hz)) and (trust, agreement) == (pytest.approx(r.f0_confidence), pytest.approx(r.estimator_agreement))


def test_arrivals_of_any_order_and_cut(spark, tmp_path):
    frames = [(s, 1 + (i >= 40), i, 40.0 * i - (400 if i % 13 == 5 else 0)) for s in (1, 2) for i in range(80)]
    for k, order in enumerate((lambda i: i, lambda i: i + (9 if i % 7 == 3 else 0), lambda i: i + (45 if i % 11 == 2 else 0))):
        rows = [(s, e, i, t, order(i) + i / 1000) for s, e, i, t in frames]
        table = spark.createDataFrame(rows, "session_id long, capture_epoch long, seq long, t_ms double, arrival double")
        want, top = {}, {}
        for s, e, i, t, _ in sorted(rows, key=lambda r: (r[0], r[4])):
            newest, q, m = top.get(s, (-1, -1, -math.inf))
            if e < newest:
                want[s, i] = "stale-epoch"
                continue
            if e > newest:
                q, m = -1, -math.inf
            want[s, i] = "sequence" if i <= q else "time" if t <= m else "kept"
            top[s] = e, max(q, i), max(m, t)
        got = loop.over_sessions(table, ["session_id"], ["arrival"], loop.judge_arrival, loop.ARRIVED)
        assert {(r.session_id, r.seq): r.verdict for r in got.collect()} == want and {"kept"} < set(want.values())
        for i in range(4):
            table.filter((F.col("arrival") >= i * 35) & (F.col("arrival") < (i + 1) * 35)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")
        out = streams.drain(streams.arrivals(streams.from_files(spark, f"{tmp_path}/{k}", table.schema)))
        assert {(r.session_id, r.seq): r.verdict for r in out.collect()} == want
    assert loop.over_sessions(table.limit(0), ["session_id"], ["arrival"], loop.judge_arrival, loop.ARRIVED).collect() == []


def test_onsets_in_a_stream(spark, tmp_path):
    d = queries._analysed(spark, SF).filter("session_id = 0")
    for i in range(3):
        d.filter((F.col("seq") >= i * 400) & (F.col("seq") < (i + 1) * 400)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, loop.over_sessions(d, ["session_id"], ["seq"], loop.find_onsets, loop.ONSETS).collect()))
    assert sorted(map(tuple, streams.drain(streams.onsets(streams.from_files(spark, f"{tmp_path}/in", d.schema))).collect())) == want


FACE = {i: (0.5 + 0.1 * x, 0.5 + 0.1 * y) for i, (x, y) in {362: (1, 0), 263: (2, 0), 33: (-2, 0), 133: (-1, 0), 385: (1.2, 0.2), 380: (1.2, -0.2), 387: (1.8, 0.2), 373: (1.8, -0.2), 160: (-1.8, 0.1), 144: (-1.8, -0.1), 158: (-1.2, 0.1), 153: (-1.2, -0.1), 291: (1, 3), 61: (-1, 3), 13: (0, 2.9), 14: (0, 3.1), 70: (-2, -1), 300: (2, -1)}.items()}
RESULTS = (
    "session_id long, seq long, acquired_at_ms double, points array<struct<x:double,y:double>>, matrix array<double>, illumination_mean double, dark_clipping double, bright_clipping double, sharpness double, frame_rate double, "
    "inter_result_gap_ms double, skipped_fraction double"
)


def result(seq, shift=0.0, points=True, matrix=True, **other):
    row = {"illumination_mean": 0.5, "dark_clipping": 0.0, "bright_clipping": 0.0, "sharpness": 0.01, "frame_rate": 25.0, "inter_result_gap_ms": 40.0, "skipped_fraction": 0.0} | other
    spots = [FACE.get(i, (0.5, 0.5 if i else 0.3)) for i in range(478)]
    spots[70] = (spots[70][0] + shift, spots[70][1])
    return (1, seq, 40.0 * seq, spots if points else None, [float(i % 5 == 0) for i in range(16)] if matrix else None, *row.values())


def test_composed_frames_batch_and_stream(spark, tmp_path):
    rows = [result(0), result(1, 0.01), result(2, points=False), result(3), result(4, 0.02), result(5, sharpness=0.0), result(6), result(7, 0.6), result(8), result(9, matrix=False), result(10), result(11, 0.03)]
    d = spark.createDataFrame(rows, RESULTS)
    f = landmarks.composed(d, "points", "matrix", 640.0, 480.0)
    got = landmarks.movement_speed(f, ["session_id"], "seq", F.col("usable")).orderBy("seq").collect()
    assert [",".join(r.quality_reasons) for r in got] == ["", "", "face-not-visible", "", "", "blur", "", "", "", "face-not-visible", "", ""]
    assert [r.face_visible for r in got] == [True, True, False, *[True] * 9] and got[9].yaw_deg is None and got[9].eye_left is not None
    gone = got[2]
    assert not gone.face_visible and all(gone[c] is None for c in ("box_width_px", "yaw_deg", "eye_left", "eye_right", "mouth_left_x", "mouth_aperture", "motion", "movement_speed"))
    assert got[0].eye_left == pytest.approx(0.3, abs=0.02) and got[0].mouth_aperture == pytest.approx(0.075) and got[0].yaw_deg == 0
    moved = [r.movement_speed is not None for r in got]
    assert moved[:7] == [False, True, False, False, True, True, False]
    for part in range(3):
        f.select("session_id", "seq", "acquired_at_ms", "motion", "usable").filter((F.col("seq") >= part * 4) & (F.col("seq") < part * 4 + 4)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kind = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = streams.movement_speed(streams.from_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
        # timers keep the query alive, so it is stopped when all rows are out
        q = stream.writeStream.format("memory").queryName("moved").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
        until = time.time() + 90
        while spark.table("moved").count() < len(rows) and time.time() < until and q.isActive:
            time.sleep(0.5)
        out = spark.table("moved").orderBy("seq").collect()
        q.stop()
    finally:
        spark.conf.unset(kind)
    same = lambda a, b: (a is None or math.isnan(a)) if b is None else a == pytest.approx(b)
    assert len(out) == len(got) and all(same(a.movement_speed, b.movement_speed) for a, b in zip(out, got, strict=True))


EVENTS = "session_id string, subject_ref string, sequence long, event_id string, occurred_ms long, caused_by string, arrival long"


def test_journal_sink(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame([(s, "who", n, f"{s}{n}", 10 * n, c, a) for a, (s, n, c) in enumerate(rows)], EVENTS)
    journal = Journal(spark, f"{tmp_path}/journal")
    ids = lambda: sorted(r.event_id for r in journal.events().collect()) if journal.events() is not None else []
    assert ids() == []
    journal.append(table(("a", 1, None), ("b", 1, None)), 0)
    journal.append(table(("a", 2, "a1")), 1)
    journal.append(table(("a", 2, "a1")), 1)  # the same batch again
    assert ids() == ["a1", "a2", "b1"] and journal.batches() == [0, 1]
    for bad, why in ((table(("a", 2, None)), "duplicate-id.*sequence"), (table(("a", 4, None)), "sequence"), (table(("a", 3, "b1")), "unknown-cause"), (table(("c", 1, None)).withColumn("subject_ref", F.lit("x")).unionByName(table(("c", 2, None))), "boundary|sequence")):
        with pytest.raises(JournalError, match=why):
            journal.append(bad, 2)
        assert ids() == ["a1", "a2", "b1"]

    class Cut(Journal):
        def commit(self, number):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Cut(spark, journal.folder).append(table(("a", 3, "a2"), ("b", 2, None)), 2)
    assert ids() == ["a1", "a2", "b1"]  # written, but not in the ledger
    journal.append(table(("a", 3, "a2"), ("b", 2, None)), 2)
    assert ids() == ["a1", "a2", "a3", "b1", "b2"]


def test_journal_of_a_stream(spark, tmp_path):
    rows = [("a", "who", n, f"a{n}", 10 * n, None, n) for n in range(1, 5)]
    for i in range(2):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    journal = Journal(spark, f"{tmp_path}/journal")
    stream = streams.from_files(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema)
    journal.follow(stream, f"{tmp_path}/state")
    assert journal.events().count() == 4 and journal.batches() == [0, 1]
    journal.follow(stream, f"{tmp_path}/state")
    journal.follow(stream, f"{tmp_path}/other")  # a new checkpoint numbers the same batches again
    assert journal.events().count() == 4
