"""What went wrong on tables many times sf0.1, at a small size."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import gates, stats
from framewright.functions.tables import looked_up, settle
from framewright.operators import face, history, provenance
from framewright.plans import face_queries, history_queries, loop_queries, provenance_queries
from framewright.sources.surrogates import face_frames, face_sessions

SF = "/root/testdata/sf0.01"


@pytest.fixture
def conf(spark):
    """Sets options for one test."""
    before = {}

    def change(key, value):
        before[key] = spark.conf.get(key)
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.set(key, value)


def test_means_of_encounters_are_sums_in_the_order_of_the_file(spark, conf, tmp_path):
    conf("spark.sql.files.maxPartitionBytes", "64k")
    rows = duckdb.sql(f"SELECT * FROM '{SF}/lineitem.parquet' ORDER BY hash(l_partkey, l_linenumber, l_extendedprice)")
    rows.write_parquet(str(tmp_path / "lineitem.parquet"), row_group_size=4096)
    (tmp_path / "orders.parquet").symlink_to(f"{SF}/orders.parquet")
    want = {}
    for order, flag, status, tax in duckdb.sql(f"SELECT l_orderkey, l_returnflag, l_linestatus, l_tax FROM '{tmp_path}/lineitem.parquet'").fetchall():
        want.setdefault((order, {"A": "ambient.voice.a", "R": "ambient.face.r"}.get(flag, "ambient.voice.n"), status), []).append(tax)
    got = history_queries.encounters(spark, str(tmp_path))[1].select("visit_id", "code", "context_kind", "illumination").collect()

    def mean(taxes):
        total = 0.0
        for x in taxes:
            total += x
        return total / len(taxes) * 4

    assert len(got) == len(want) and all(r.illumination == mean(want[r.visit_id, r.code, r.context_kind]) for r in got)


def test_screening_is_small_enough_to_be_compiled(spark, conf):
    """The JVM leaves methods beyond 8000 bytes to its interpreter, and Spark lambdas over arrays to its own."""
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.debug.maxToStringFields", "1000")
    frames = face_frames(spark, SF)
    run = face.screened(frames, face_sessions(frames))._jdf.queryExecution()
    assert "lambda" not in run.executedPlan().toString()
    code = run.debug().codegenToSeq()
    assert code.length() and max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.length())) <= 8000


def test_frames_are_counted_before_their_reasons_are_listed(spark, conf):
    """Lists are made of a few rows a session; what runs for each frame is compiled."""
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.debug.maxToStringFields", "1000")
    for query in (loop_queries.f06_reason_lists, face_queries.f06_visual_reasons):
        run = query(spark, SF)._jdf.queryExecution()
        steps = run.executedPlan().toString().splitlines()  # the last step comes first
        frames = max(i for i, s in enumerate(steps) if "Window [" in s)
        counted = max(i for i, s in enumerate(steps[:frames]) if "HashAggregate(" in s)
        assert all(s.lstrip(" :+-").startswith("*(") for s in steps[counted:frames])
        code = run.debug().codegenToSeq()
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.length())) <= 8000


def test_sound_frames_are_those_without_reasons(spark):
    odd = "(values (null), (double('nan')), (double('infinity')), (double('-infinity')), (-1.0d), (0.0d), (0.5d), (200.0d)) as t(x)"
    given = "(values (null), (array()), (array('other', null)), (array('blur'))) as g(quality_reasons)"
    f = spark.sql(f"""
        SELECT quality_reasons, c = 0 AS face_visible, CASE c WHEN 1 THEN x ELSE 300 END AS box_width_px, CASE c WHEN 2 THEN x ELSE 300 END AS box_height_px, CASE c WHEN 3 THEN x ELSE 0.1 END AS edge_margin,
               CASE c WHEN 4 THEN x ELSE 1 END AS yaw_deg, CASE c WHEN 5 THEN x ELSE 1 END AS pitch_deg, 0.0d AS roll_deg, 0.3d AS eye_left, 0.3d AS mouth_left_x, CASE c WHEN 6 THEN x ELSE 0.5 END AS illumination_mean,
               CASE c WHEN 7 THEN x ELSE 0.1 END AS dark_clipping, 0.1d AS bright_clipping, CASE c WHEN 8 THEN x ELSE 0.5 END AS sharpness, CASE c WHEN 9 THEN x ELSE 25 END AS frame_rate,
               CASE c WHEN 10 THEN x ELSE 40 END AS inter_result_gap_ms, CASE c WHEN 11 THEN x ELSE 0.1 END AS skipped_fraction, CASE c WHEN 12 THEN x ELSE 0.3 END AS box_width, 0.3d AS box_height
        FROM {odd} CROSS JOIN {given} CROSS JOIN range(13) AS r(c)""".replace("c = 0 AS face_visible", "CASE WHEN c > 0 THEN true WHEN x > 0 THEN false WHEN x = 0 THEN true END AS face_visible"))
    rows = f.select(gates.visual_reasons().alias("r"), gates.visually_sound().alias("sound")).collect()
    assert all(r.sound == (not r.r) for r in rows) and {r.sound for r in rows} == {True, False}
    by_mask = f.withColumn("mask", gates.visual_mask()).select(gates.visual_reasons().alias("r"), gates.reasons_of(F.col("mask")).alias("same")).collect()
    assert all(r.r == r.same for r in by_mask)


def test_settled_tables_are_not_broadcast(spark):
    """Rows that repeat themselves make small files of large tables."""
    t = settle(spark.range(100_000).selectExpr("id div 10 AS k", "repeat('x', 200) AS text"))
    joins = [t.join(spark.range(100_000).withColumnRenamed("id", "k"), "k", "left"), spark.range(100_000).withColumnRenamed("id", "k").join(t.groupBy("k").agg(F.max("text")), "k")]
    assert all("BroadcastHashJoin" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 100_000 - 90_000 * n for n, j in enumerate(joins))


def test_targets_of_references_are_not_broadcast(spark):
    t = provenance_queries._tables(spark, SF)
    plan = provenance_queries._reference_errors(t)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lookups_of_dealt_tables_shuffle_nothing(spark, conf):
    """References, measurements and processors meet their targets where their session lies; only events are joined by their own id."""
    conf("spark.sql.adaptive.enabled", "false")
    t = provenance_queries._tables(spark, SF)
    dealt = _shuffles(t["outcomes"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keys = lambda df: set(re.findall(r"Exchange hashpartitioning\((\w+)", plan(df)))
    assert dealt == 1 and keys(provenance.outcome_errors(t["outcomes"], t["processors"], t["refs"])) == keys(provenance.measurement_errors(t["measurements"], t["outcomes"], t["windows"])) == {"l_orderkey"}
    assert keys(provenance_queries._reference_errors(t)) == {"l_orderkey", "target_id", "event_id"}


def test_lookups_take_the_first_row_and_null_finds_nothing(spark):
    rows = spark.createDataFrame([(1, "a", 7), (1, "b", 8), (None, "a", 9), (1, None, 10), (2, "a", 11)], "s int, k string, x int")
    table = spark.createDataFrame([(1, "a", 2, "later"), (1, "a", 1, "first"), (None, "a", 1, "none"), (1, None, 1, "none"), (3, "a", 1, "other")], "s int, k string, position int, y string")
    got = {r.x: r.found and r.found.y for r in looked_up(rows, ["s", "k"], table, "found").collect()}
    assert got == {7: "first", 8: None, 9: None, 10: None, 11: None}
    got = {r.x: r.found and r.found.y for r in looked_up(rows, ["s", "k"], table.drop("position"), "found").collect()}
    assert got == {7: "first", 8: None, 9: None, 10: None, 11: None}


def test_bins_make_no_copies_of_frames(spark):
    frames = face_frames(spark, SF)
    assert "Expand" not in face.bins(face.screened(frames, face_sessions(frames)))._jdf.queryExecution().executedPlan().toString()


def _fold(x):
    """Blinks one frame after the other."""
    l, r = face._percentile(x["eye_left"], 0.9), face._percentile(x["eye_right"], 0.9)
    opened, wait, accepted, before, bin_, hits = None, False, float("-inf"), None, None, []
    for t, b, left, right in zip(x["t_ms"], x["bin"], x["eye_left"], x["eye_right"], strict=True):
        if before is not None and (b not in (bin_, bin_ + 1) or t - before > 75):
            opened, wait = None, False
        closed, back = left <= l * 0.6 and right <= r * 0.6, left >= l * 0.8 and right >= r * 0.8
        if wait:
            wait = not back
        elif opened is not None:
            if t - opened > 800:
                opened, wait = None, True
            elif back:
                if t - opened >= 50:
                    accepted = t
                    hits.append(b)
                opened = None
        elif closed and t - accepted >= 150:
            opened = t
        before, bin_ = t, b
    return hits


def test_blinks_are_those_of_a_fold_over_all_frames():
    dice, found = np.random.default_rng(3), 0
    for _ in range(200):
        t = np.cumsum(dice.choice([20.0, 40.0, 75.0, 76.0], 800, p=[0.3, 0.6, 0.09, 0.01]))
        eyes = np.repeat(dice.choice([0.1, 0.2, 0.3], 400, p=[0.2, 0.1, 0.7]), dice.choice([1, 2, 3, 30], 400, p=[0.4, 0.4, 0.19, 0.01]))[:800]
        n = len(eyes)
        kept = dice.random(n) > 0.001
        x = {"t_ms": t[:n][kept], "bin": (t[:n] // 5000).astype(int)[kept], "eye_left": eyes[kept], "eye_right": (eyes * dice.choice([1, 1.5], n, p=[0.97, 0.03]))[kept]}
        found += len(_fold(x))
        assert face._blink_bins(x) == _fold(x)
    assert found > 500


def test_values_of_bins_are_step_percentiles(spark):
    framed = settle(face.screened(face_frames(spark, SF), face_sessions(face_frames(spark, SF))))
    kept = settle(face.bins(framed))
    f = framed.join(kept.select("session_id", "bin", "step"), ["session_id", "bin"]).select("session_id", "bin", "t_ms", F.col("mouth_aperture").alias("v"), "step")
    want = {(r.session_id, r.bin): r.x for r in stats.timed_percentile(f, ["session_id", "bin"], "t_ms", "v", F.lit(0.9), F.col("step"), "x").collect()}
    got = {(r.session_id, r.bin): r.value for r in face.bin_values(framed, kept).filter("ordinal = 5").collect()}
    assert got == want and len(want) > 100


def test_comparisons_meet_their_aggregates_once(spark):
    """Lines were dealt four times: for what is wrong with them, for both sides of the comparison and for current errors."""
    tables = history_queries.encounters(spark, SF)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(history.screened(*tables)).count("lineitem.parquet") == 1
    assert "lineitem.parquet" not in plan(history.compare(*tables))


def test_a_session_is_dealt_once_and_leaves_one_row(spark, conf):
    """Frames were written whole and dealt again for bins, values, blinks, gaps and poses."""
    conf("spark.sql.adaptive.enabled", "false")
    frames = face_frames(spark, SF)
    sessions = face_sessions(frames)
    ready = face.prepared(frames, sessions)
    assert ready.count() == sessions.count() == 40
    assert _shuffles(face.summaries(face.screened(frames, sessions))) == 2  # lines by session, and the list of sessions
    plan = face.face_outcomes(frames, sessions, ready)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Window" not in plan
    read = face.summaries(face.screened(frames, sessions))._jdf.queryExecution()
    assert "numbers#" in read.executedPlan().toString()  # one column for all numbers of a frame
    code = read.debug().codegenToSeq()
    assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.length())) <= 8000
