"""Queries over streams: rolling statistics, calibration, gates, journals and scalar derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import gates, stats
from framewright.operators import journal, signals
from framewright.plans import oracle_sql as sql
from framewright.plans.voice_queries import rounded
from framewright.sources.surrogates import face_frames, voice_frames


def a45_rolling_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.rolling_cadence(voice_frames(spark, sf_dir)).select("session_id", "seq", "cadence_hz"))


def a46_rolling_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = voice_frames(spark, sf_dir)
    return rounded(signals.rolling_fraction(f, F.col("lost_block_fraction"), F.lit(1.0), "lost").select("session_id", "seq", "lost"))


def w07_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.latest(voice_frames(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("samples"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))


def a07_latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.latency_p95(voice_frames(spark, sf_dir), "rms"))


def f12_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames arriving out of order: every seventh comes five places late."""
    f = voice_frames(spark, sf_dir).withColumn("arrival", F.col("seq") + F.when(F.col("seq") % 7 == 0, 5).otherwise(0) + F.col("seq") / 10000)
    return signals.monotonic(f, "t_ms").select("session_id", "seq")


def w10_quiet_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.quiet_run(voice_frames(spark, sf_dir).withColumn("speech_active", F.col("seq") % 100 < 40), 2000.0))


def a36_face_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.face_calibration(face_frames(spark, sf_dir)))


def x01_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = face_frames(spark, sf_dir).select(signals.guidance(gates.visual_reasons()).alias("guidance"))
    return f.groupBy("guidance").agg(F.count("*").alias("frames"))


def f04_voice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = voice_frames(spark, sf_dir).withColumn("reasons", gates.voice_reasons(F.col("echo_cancellation")))
    fine = gates.free_of(F.col("reasons"), gates.FINE_BLOCKERS)
    return f.groupBy("session_id").agg(
        F.count_if(gates.free_of(F.col("reasons"), gates.TIMING_BLOCKERS)).alias("timing"), F.count_if(gates.free_of(F.col("reasons"), gates.GENERAL_BLOCKERS)).alias("general"),
        F.count_if(fine & (F.col("snr_db") >= 20)).alias("fine"), F.sum(F.size("reasons")).cast("long").alias("reasons"))


def p08_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rms = F.col("rms") - F.lit(0.001)
    return rounded(voice_frames(spark, sf_dir).select(
        "session_id", "seq", signals.decibels(rms).alias("dbfs"), signals.signal_to_noise(rms, F.lit(0.002)).alias("snr_db"), stats.clamp01((signals.decibels(rms) + 60) / 60).alias("level"),
        F.coalesce(stats.clamp01((F.col("f0_hz") - 50) / 450), F.lit(0.0)).alias("pitch"), signals.live_state(F.col("speech_active"), F.col("periodic")).alias("state")))


def t07_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.throttle(voice_frames(spark, sf_dir), 24).groupBy("session_id").agg(F.count("*").alias("accepted"), F.sum("t_ms").alias("total_ms"))


def t11_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.average(voice_frames(spark, sf_dir), "rms", 0.1, 0.0))


def a01_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plain statistic of the metrics, over one column."""
    f = voice_frames(spark, sf_dir)
    plain = f.groupBy("session_id").agg(
        F.avg("rms").alias("mean"), stats.population_sd("rms").alias("sd"), F.median("rms").alias("median"), F.percentile("rms", 0.9).alias("p90"), stats.median_or_zero(F.col("f0_hz")).alias("f0"),
        stats.upper_median(F.collect_list("rms")).alias("upper_median"), F.count_if(stats.finite("f0_hz")).alias("pitched"))
    return rounded(plain.join(stats.mad(f, ["session_id"], "rms", "m").select("session_id", "m_mad"), "session_id"))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    pick = lambda cond, yes, no: F.when(F.expr(cond), yes).otherwise(no)
    e = e.withColumn("n", F.expr("row_number() over (partition by user_id order by event_id)"))
    return e.select(
        F.col("user_id").alias("session_id"), pick("event_id % 211 = 4", F.lit("someone-else"), F.concat(F.lit("subject-"), F.col("user_id").cast("string"))).alias("subject_ref"),
        F.col("event_id").alias("arrival"), (F.col("n") + pick("event_id % 307 = 2", F.lit(1), F.lit(0))).alias("sequence"),
        pick("event_id % 401 = 3 and n > 1", F.expr("lag(event_id) over (partition by user_id order by event_id)"), F.col("event_id")).alias("event_id"),
        (F.col("event_id") * 1000 - pick("event_id % 251 = 9", F.lit(10**9), F.lit(0))).alias("occurred_ms"),
        F.when(F.expr("event_id % 3 = 0"), F.expr("lag(event_id) over (partition by user_id order by event_id)")).when(F.expr("event_id % 509 = 7"), F.col("event_id") + 1).alias("caused_by"),
        F.when(F.col("event_type") == "click", "measurement.recorded").when(F.col("event_type") == "view", "measurement.withheld").when(F.col("event_type") == "purchase", "observation.created")
        .when(F.col("event_type") == "error", "report.created").otherwise("session.note").alias("type"),
        F.col("event_type").alias("stage"), F.concat(F.lit("code-"), (F.col("event_id") % 10).cast("string")).alias("subject_code"), (F.col("value") * 10).cast("long").alias("offset_ms"))


def t09_journal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.violations(_journal(spark, sf_dir))


def a44_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = journal.replay(_journal(spark, sf_dir))
    return r.withColumn("recorded", F.array_join("recorded", ",")).withColumn("withheld", F.array_join("withheld", ","))


def t10_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.number(_journal(spark, sf_dir).drop("sequence", "occurred_ms"), 1_000_000).select("session_id", "arrival", "sequence", "occurred_ms")


QUERIES = {
    "a45_rolling_cadence": a45_rolling_cadence, "a46_rolling_loss": a46_rolling_loss, "w07_latest_history": w07_latest, "a07_latency_p95": a07_latency_p95, "f12_monotonic": f12_monotonic,
    "w10_quiet_run": w10_quiet_run, "a36_face_calibration": a36_face_calibration, "x01_guidance": x01_guidance, "f04_voice_quality": f04_voice_quality, "p08_levels": p08_levels,
    "t07_throttle": t07_throttle, "t11_average": t11_average, "a01_statistics": a01_statistics, "t09_journal_violations": t09_journal_violations, "a44_replay": a44_replay, "t10_event_numbering": t10_numbering,
}

_V = "WITH " + sql.VOICE
_J = r"""WITH base AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
j AS (
  SELECT user_id AS sid, CASE WHEN event_id % 211 = 4 THEN 'someone-else' ELSE 'subject-' || user_id END AS subj, event_id AS arr, n, n + CASE WHEN event_id % 307 = 2 THEN 1 ELSE 0 END AS seq,
    CASE WHEN event_id % 401 = 3 AND n > 1 THEN prev ELSE event_id END AS eid, event_id * 1000 - CASE WHEN event_id % 251 = 9 THEN 1000000000 ELSE 0 END AS tm,
    CASE WHEN event_id % 3 = 0 THEN prev WHEN event_id % 509 = 7 THEN event_id + 1 END AS cause, event_type AS stage,
    CASE event_type WHEN 'click' THEN 'measurement.recorded' WHEN 'view' THEN 'measurement.withheld' WHEN 'purchase' THEN 'observation.created' WHEN 'error' THEN 'report.created' ELSE 'session.note' END AS type,
    'code-' || event_id % 10 AS code, floor(value * 10)::BIGINT AS off FROM base)
"""

ORACLES = {
    "a45_rolling_cadence": _V + """
        SELECT session_id, seq, round((count(*) OVER w - 1) * 1000 / greatest(1, t_ms - min(t_ms) OVER w), 6) AS cadence_hz
        FROM voice WINDOW w AS (PARTITION BY session_id ORDER BY t_ms RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW)""",
    "a46_rolling_loss": _V + """
        SELECT session_id, seq, round(sum(lost) OVER w / count(*) OVER w, 6) AS lost FROM voice WINDOW w AS (PARTITION BY session_id ORDER BY t_ms RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW)""",
    "w07_latest_history": _V + """
        SELECT session_id, count(*) AS samples, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM (SELECT *, max(t_ms) OVER (PARTITION BY session_id) AS e FROM voice) WHERE t_ms >= e - 8000 GROUP BY ALL""",
    "a07_latency_p95": _V + """,
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM voice), l AS (SELECT session_id, list_sort(list(rms)) AS x FROM r WHERE n <= 500 GROUP BY ALL)
        SELECT session_id, round(x[least(len(x) - 1, floor(0.95 * len(x)))::BIGINT + 1], 6) AS p95, len(x)::BIGINT AS samples FROM l""",
    "f12_monotonic": _V + """,
        a AS (SELECT session_id, seq, max(seq) OVER (PARTITION BY session_id ORDER BY seq + CASE WHEN seq % 7 = 0 THEN 5 ELSE 0 END + seq / 10000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM voice)
        SELECT session_id, seq FROM a WHERE m IS NULL OR seq > m""",
    "w10_quiet_run": _V + """,
        q AS (SELECT *, NOT (seq % 100 < 40) AND clipped <= 0.01 AS ok FROM voice), g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM q),
        h AS (SELECT *, t_ms - min(t_ms) OVER (PARTITION BY session_id, run) AS inn FROM g WHERE ok),
        d AS (SELECT session_id, run, min(t_ms) AS e FROM h WHERE inn >= 2000 GROUP BY session_id, run QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY min(t_ms)) = 1)
        SELECT h.session_id, min(t_ms) AS start_ms, any_value(e) AS end_ms, round(greatest(0.0001, median(rms)), 6) AS noise_floor FROM h JOIN d USING (session_id, run) WHERE t_ms <= e GROUP BY ALL""",
    "a36_face_calibration": "WITH " + sql.FACE + """,
        u AS (SELECT *, NOT nocam AND sharp >= 0.0008 AS good FROM face),
        c AS (SELECT session_id, max(t_ms) - min(t_ms) AS dur, count(*) AS n, count(*) FILTER (good) AS ok, median(wpx) FILTER (good) AS w, median(hpx) FILTER (good) AS h, median(sharp) FILTER (good) AS s FROM u GROUP BY ALL)
        SELECT session_id, dur AS duration_ms, n AS frames, ok AS usable, w AS width_px, h AS height_px, 0.5::DOUBLE AS illumination, round(s::DOUBLE, 6) AS sharpness, round((n - 1) * 1000 / dur, 6) AS rate,
               round(ok / n, 6) AS usable_fraction, CASE WHEN dur >= 1500 AND ok / n >= 0.8 AND (n - 1) * 1000 / dur >= 20 THEN 'strong' ELSE 'limited' END AS grade FROM c""",
    "x01_guidance": "WITH " + sql.FACE + " SELECT CASE WHEN nocam THEN 'Move into view' WHEN sharp < 0.0008 THEN 'Hold still' ELSE 'Face ready' END AS guidance, count(*) AS frames FROM face GROUP BY ALL",
    "f04_voice_quality": _V + """,
        r AS (SELECT *, blocked AS gap, snr < 15 AS lowsnr, rms < 0.003 AS quiet, clipped > 0.01 AS clip FROM voice)
        SELECT session_id, count(*) FILTER (NOT gap AND NOT quiet AND NOT clip) AS timing, count(*) FILTER (NOT gap AND NOT quiet AND NOT clip AND NOT lowsnr) AS general,
               count(*) FILTER (NOT gap AND NOT quiet AND NOT clip AND NOT lowsnr AND NOT echo AND snr >= 20) AS fine,
               sum(gap::INT + lowsnr::INT + quiet::INT + clip::INT + echo::INT + noisy::INT)::BIGINT AS reasons FROM r GROUP BY ALL""",
    "p08_levels": _V + """,
        x AS (SELECT *, rms - 0.001 AS v FROM voice), y AS (SELECT *, CASE WHEN v <= 0 THEN -60 ELSE least(0, greatest(-60, 20 * log10(CASE WHEN v > 0 THEN v END))) END AS db FROM x)
        SELECT session_id, seq, round(db, 6) AS dbfs, round(CASE WHEN v <= 0 THEN 0 ELSE greatest(0, 20 * log10(CASE WHEN v > 0 THEN v / 0.002 END)) END, 6) AS snr_db, round(least(1, greatest(0, (db + 60) / 60)), 6) AS level,
               round(coalesce(least(1, greatest(0, (f0 - 50) / 450)), 0), 6) AS pitch, CASE WHEN speech_active AND periodic THEN 'voiced' WHEN speech_active THEN 'speech-noise' ELSE 'quiet' END AS state FROM y""",
    "t07_throttle": _V + " SELECT session_id, count(*) AS accepted, sum(t_ms) AS total_ms FROM voice WHERE seq % 2 = 0 GROUP BY ALL",
    "t11_average": _V + ", m AS (SELECT session_id, seq, rms, max(seq) OVER (PARTITION BY session_id) AS e FROM voice) SELECT session_id, round(sum(rms * 0.1 * 0.9 ** (e - seq)), 6) AS average FROM m GROUP BY ALL",
    "a01_statistics": _V + """,
        s AS (SELECT session_id, avg(rms) AS mean, stddev_pop(rms) AS sd, median(rms) AS med, quantile_cont(rms, 0.9) AS p90, coalesce(median(f0), 0) AS f0, list_sort(list(rms)) AS l, count(f0) AS pitched, mad(rms) AS m_mad FROM voice GROUP BY ALL)
        SELECT session_id, round(mean, 6) AS mean, round(sd, 6) AS sd, round(med, 6) AS median, round(p90, 6) AS p90, round(f0, 6) AS f0, round(l[len(l) // 2 + 1], 6) AS upper_median, pitched, round(m_mad, 6) AS m_mad FROM s""",
    "t09_journal_violations": _J + """,
        s AS (SELECT sid AS s2, eid AS e2, min(arr) AS first FROM j GROUP BY ALL),
        k AS (SELECT j.*, lag(tm) OVER (PARTITION BY sid ORDER BY arr) AS ptm, first_value(subj) OVER (PARTITION BY sid ORDER BY arr) AS subj0, row_number() OVER (PARTITION BY sid, eid ORDER BY arr) AS copy, first
              FROM j LEFT JOIN s ON s2 = sid AND e2 = cause)
        SELECT sid AS session_id, seq AS sequence, eid AS event_id, unnest(list_filter([CASE WHEN seq <> n THEN 'sequence' END, CASE WHEN copy > 1 THEN 'duplicate-id' END, CASE WHEN subj <> subj0 THEN 'boundary' END,
               CASE WHEN tm < ptm THEN 'time-backward' END, CASE WHEN cause IS NOT NULL AND (first IS NULL OR first >= arr) THEN 'unknown-cause' END], lambda x: x IS NOT NULL)) AS violation FROM k""",
    "a44_replay": _J + """
        SELECT sid AS session_id, arg_min(subj, arr) AS subject_ref, arg_max(stage, arr) AS stage, count(*) AS event_count, arg_max(seq, arr) AS last_sequence, arg_max(eid, arr) AS last_event_id,
               arg_max(code, arr) FILTER (type IN ('observation.created', 'report.created')) AS observation_id, arg_max(code, arr) FILTER (type = 'report.created') AS report_id,
               coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (type = 'measurement.recorded')), ','), '') AS recorded,
               coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (type = 'measurement.withheld')), ','), '') AS withheld FROM j GROUP BY ALL""",
    "t10_event_numbering": _J + " SELECT sid AS session_id, arr AS arrival, n AS sequence, 1000000 + max(off) OVER (PARTITION BY sid ORDER BY arr) AS occurred_ms FROM j",
}
