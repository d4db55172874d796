"""DuckDB SQL for the queries of the measurement engine, written independently of the DataFrame code."""

from __future__ import annotations

#: Voice frames from events.
VOICE = r"""
voice AS (
  SELECT event_id // 1000 AS session_id, event_id % 1000 AS seq, (40 * (event_id % 1000))::DOUBLE AS t_ms, 1 AS capture_epoch,
         (40 * (event_id % 1000)) % 2500 < 2000 AS speech_active, event_id % 17 <> 0 AS periodic,
         CASE WHEN (event_id // 1000) % 7 = 5 AND event_id % 1000 >= 500 THEN 'mic-2' ELSE 'mic-1' END AS track,
         CASE WHEN (event_id // 1000) % 11 = 7 AND event_id % 1000 >= 400 THEN 'proc-b' ELSE 'proc-a' END AS proc,
         value / 5000 AS rms, CASE WHEN event_id % 17 <> 0 THEN 140 + value / 100 END AS f0,
         CASE WHEN event_id % 23 = 0 THEN 0.5 ELSE 0.9 END AS conf,
         (40 * (event_id % 1000)) % 2500 < 2000 AND (40 * (event_id % 1000)) % 480 = 0 AS nucleus,
         CASE WHEN value > 420 THEN 0.02 ELSE value / 100000 END AS clipped,
         CASE WHEN (40 * (event_id % 1000)) % 2500 < 2000 THEN (20 + event_id % 9)::DOUBLE ELSE 0.0 END AS snr,
         (event_id % 5) / 200 AS lost, event_id % 997 = 3 AS blocked, event_id % 997 <> 3 AND event_id % 101 = 7 AS noisy, (event_id // 1000) % 5 = 1 AS echo
  FROM events),
sessions AS (SELECT DISTINCT session_id, CASE WHEN session_id % 13 = 3 THEN 1999.0 ELSE 2500.0 END AS calibration FROM voice)
"""

SEGMENTS = VOICE + r""",
gated AS (
  SELECT *, lost <= 0.05 AND clipped <= 0.01 AND (NOT speech_active OR snr >= 15) AND NOT blocked AS usable,
         coalesce(speech_active AND periodic AND f0 BETWEEN 50 AND 700 AND conf >= 0.55, false) AS pitched, floor(t_ms / 10000) AS bucket
  FROM voice WHERE t_ms >= 0 AND t_ms < 300000),
marked AS (
  SELECT *, CASE WHEN usable AND coalesce(lag(usable) OVER w AND t_ms - lag(t_ms) OVER w > 0 AND t_ms - lag(t_ms) OVER w <= 40
                    AND track = lag(track) OVER w AND proc = lag(proc) OVER w AND bucket = lag(bucket) OVER w, false) THEN 0 ELSE 1 END AS starts
  FROM gated WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY seq) AS seg FROM marked),
stepped AS (
  SELECT *, lead(t_ms) OVER w AS nxt, t_ms - lag(t_ms) OVER w AS step FROM numbered WHERE usable WINDOW w AS (PARTITION BY session_id, seg ORDER BY seq)),
nominal AS (SELECT *, coalesce(median(CASE WHEN step > 0 AND step <= 40 THEN step END) OVER (PARTITION BY session_id, seg), 10) AS nominal FROM stepped),
framed AS (SELECT *, CASE WHEN nxt IS NULL THEN nominal ELSE least(40, greatest(0, nxt - t_ms)) END AS weight FROM nominal),
segs AS (
  SELECT session_id, seg, count(*) AS n, sum(weight) AS dur, sum(CASE WHEN speech_active THEN weight ELSE 0 END) AS act, sum(CASE WHEN pitched THEN weight ELSE 0 END) AS pit,
         min(t_ms) AS t0, max(t_ms) AS t1, any_value(nominal) AS nominal, max(lost) AS lost, max(clipped) AS clipped, count(*) FILTER (speech_active AND nucleus) AS nuclei,
         any_value(proc) AS proc, any_value(track) AS track,
         least(1, count(*) / (floor((max(t_ms) - min(t_ms)) / any_value(nominal)) + 1), 1 - max(lost)) AS cov
  FROM framed GROUP BY session_id, seg
  HAVING count(*) >= 2 AND sum(weight) >= 2000 AND sum(CASE WHEN speech_active THEN weight ELSE 0 END) >= 1000
     AND least(1, count(*) / (floor((max(t_ms) - min(t_ms)) / any_value(nominal)) + 1), 1 - max(lost)) >= 0.9)
"""

RUNS = SEGMENTS + r""",
inside AS (SELECT f.* FROM framed f JOIN segs USING (session_id, seg)),
turned AS (SELECT *, CASE WHEN speech_active <> lag(speech_active) OVER (PARTITION BY session_id, seg ORDER BY seq) THEN 1 ELSE 0 END AS turn FROM inside),
islands AS (SELECT *, sum(turn) OVER (PARTITION BY session_id, seg ORDER BY seq) AS run FROM turned),
runs AS (SELECT session_id, seg, run, any_value(speech_active) AS active, sum(weight) AS dur FROM islands GROUP BY ALL),
runs2 AS (SELECT *, NOT active AND run > 0 AND run < max(run) OVER (PARTITION BY session_id, seg) AND dur BETWEEN 200 AND 1999 AS pause FROM runs)
"""

VOICE_METRICS = "WITH " + RUNS + r""",
per_run AS (
  SELECT session_id, seg, count(*) FILTER (pause) AS pauses, count(*) FILTER (active) AS speech_runs,
         median(dur) FILTER (pause) / 1000 AS pause_s, median(dur) FILTER (active) / 1000 AS run_s FROM runs2 GROUP BY ALL),
pitch AS (SELECT session_id, seg, median(f0) AS f0 FROM inside JOIN segs USING (session_id, seg) WHERE pit >= 1000 AND pitched GROUP BY ALL),
sub1 AS (
  SELECT i.session_id, i.seg, i.seq, i.t_ms, i.pitched, i.f0, floor((i.t_ms - t0) / 500) AS sub FROM inside i JOIN segs USING (session_id, seg) WHERE pit >= 1000),
sub2 AS (SELECT *, lead(t_ms) OVER w AS nxt, t_ms - lag(t_ms) OVER w AS step FROM sub1 WINDOW w AS (PARTITION BY session_id, seg, sub ORDER BY seq)),
sub3 AS (SELECT *, coalesce(median(CASE WHEN step > 0 AND step <= 40 THEN step END) OVER (PARTITION BY session_id, seg, sub), 10) AS nominal FROM sub2),
sub4 AS (SELECT *, CASE WHEN nxt IS NULL THEN nominal ELSE least(40, greatest(0, nxt - t_ms)) END AS weight FROM sub3),
sub5 AS (
  SELECT session_id, seg, sub, median(f0) FILTER (pitched) AS f0 FROM sub4 GROUP BY ALL
  HAVING sum(weight) >= 400 AND sum(CASE WHEN pitched THEN weight ELSE 0 END) >= 300 AND count(*) FILTER (pitched) >= 2),
sub6 AS (SELECT *, 12 * log2(f0 / median(f0) OVER (PARTITION BY session_id, seg)) AS st FROM sub5),
spread AS (SELECT session_id, seg, stddev_pop(st) AS spread FROM sub6 GROUP BY ALL HAVING count(*) >= 4),
per AS (
  SELECT s.session_id, s.seg, p.f0, spread.spread, act / dur AS ratio, r.pauses / (dur / 60000) AS rate, r.pause_s, r.run_s, nuclei / (act / 1000) AS nrate
  FROM segs s LEFT JOIN per_run r USING (session_id, seg) LEFT JOIN pitch p USING (session_id, seg) LEFT JOIN spread USING (session_id, seg)),
long AS (
  SELECT session_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest([f0, spread, ratio, rate, pause_s, run_s, nrate]) AS v FROM per),
mid AS (SELECT session_id, k, median(v) AS mid, CASE WHEN count(v) >= 2 THEN mad(v) END AS dev, count(v) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
tot AS (
  SELECT session_id, count(*) AS segments, sum(dur) AS eligible, sum(act) AS act, sum(pit) AS pit, sum(nuclei) AS nuclei, count(*) FILTER (pit >= 1000) AS psegs,
         count(DISTINCT proc) AS procs, count(DISTINCT track) AS tracks, median(cov) AS cov, max(clipped) AS clipped, max(lost) AS lost FROM segs GROUP BY ALL),
cnt AS (SELECT session_id, sum(pauses) AS pauses, sum(speech_runs) AS speech_runs FROM per_run GROUP BY ALL),
alls AS (SELECT session_id, median(dur) FILTER (pause) / 1000 AS pause_all, median(dur) FILTER (active) / 1000 AS run_all FROM runs2 GROUP BY ALL),
snr AS (SELECT session_id, median(snr) AS snr FROM inside WHERE speech_active GROUP BY ALL),
metrics AS (
  SELECT unnest(range(7)) AS k,
         unnest(['ambient.voice.f0.median', 'ambient.voice.f0.variability', 'ambient.voice.speech_activity_fraction', 'ambient.voice.pause_rate',
                 'ambient.voice.pause_duration.median', 'ambient.voice.speech_run_duration.median', 'ambient.voice.acoustic_nucleus_rate']) AS code,
         unnest(['Hz', 'semitone-SD', 'ratio', 'pauses/minute', 'seconds', 'seconds', 'nuclei/active-speech-second']) AS unit),
joined AS (
  SELECT s.session_id, m.k, m.code, m.unit, s.calibration, coalesce(segments, 0) AS segments, coalesce(eligible, 0) AS eligible, coalesce(act, 0) AS act, coalesce(pit, 0) AS pit,
         coalesce(nuclei, 0) AS nuclei, coalesce(psegs, 0) AS psegs, procs, tracks, coalesce(pauses, 0) AS pauses, coalesce(speech_runs, 0) AS speech_runs, pause_all, run_all,
         mid, dev, coalesce(n, 0) AS n,
         0.35 * cov + 0.3 * coalesce(least(1, greatest(0, (snr - 15) / 15)), 0) + 0.2 * (1 - least(1, greatest(0, clipped / 0.01))) + 0.15 * (1 - least(1, greatest(0, lost / 0.05))) AS q
  FROM sessions s CROSS JOIN metrics m LEFT JOIN tot USING (session_id) LEFT JOIN cnt USING (session_id) LEFT JOIN alls USING (session_id) LEFT JOIN snr USING (session_id)
  LEFT JOIN mid ON mid.session_id = s.session_id AND mid.k = m.k),
judged AS (
  SELECT *, CASE WHEN calibration < 2000 THEN 'quality-threshold-failed' WHEN segments = 0 THEN 'no-usable-signal'
      WHEN procs > 1 OR tracks > 1 THEN 'quality-threshold-failed' WHEN segments < 3 THEN 'insufficient-segments' WHEN eligible < 30000 THEN 'insufficient-duration'
      WHEN act < 15000 THEN 'insufficient-active-speech' WHEN k < 2 AND (psegs < 3 OR pit < 10000 OR pit < 0.6 * act) THEN 'insufficient-pitched-speech'
      WHEN k = 1 AND n < 3 THEN 'insufficient-pitch-bins' WHEN k = 4 AND pauses < 5 OR k = 5 AND speech_runs < 5 THEN 'insufficient-events'
      WHEN k = 6 AND nuclei < 30 THEN 'insufficient-nuclei' END AS reason,
    CASE WHEN k < 2 THEN mid WHEN k = 2 THEN act / eligible WHEN k = 3 THEN pauses / (eligible / 60000) WHEN k = 4 THEN pause_all WHEN k = 5 THEN run_all ELSE nuclei / (act / 1000) END AS val
  FROM joined)
SELECT session_id, k AS ordinal, code, unit, CASE WHEN reason IS NULL THEN 'measured' ELSE 'withheld' END AS status,
       round(CASE WHEN reason IS NULL THEN val END, 6) AS value, round(CASE WHEN reason IS NULL THEN least(1, greatest(0, q)) END, 6) AS quality_score,
       round(CASE WHEN reason IS NULL THEN dev END, 6) AS dispersion, reason, segments, round(eligible, 6) AS eligible_ms, round(act, 6) AS active_ms, round(pit, 6) AS pitched_ms,
       pauses::BIGINT AS pauses, speech_runs::BIGINT AS speech_runs, nuclei::BIGINT AS nuclei
FROM judged
"""

#: Face frames from line items.
FACE = r"""
numbered_lines AS (
  SELECT *, l_orderkey // 375 AS session_id, row_number() OVER (PARTITION BY l_orderkey // 375 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq FROM lineitem),
raw_face AS (SELECT *, (40 * seq)::DOUBLE AS t_ms FROM numbered_lines),
face AS (
  SELECT session_id, seq, t_ms, CASE WHEN session_id % 9 = 4 AND seq % 100 = 50 THEN 2 ELSE 1 END AS faces, CASE WHEN session_id % 10 = 6 AND seq >= 1000 THEN 'face-2' ELSE 'face-1' END AS track,
         384 + l_quantity % 3 AS wpx, 360 + l_quantity % 2 AS hpx, CASE WHEN session_id % 6 = 5 AND seq BETWEEN 300 AND 310 THEN 7.001 ELSE 2.0 END AS yaw, l_tax * 50 AS pitch, l_discount * 20 AS roll,
         CASE WHEN t_ms % 10000 < 120 THEN 0.1 ELSE 0.3 + l_discount / 10 END AS el, CASE WHEN t_ms % 10000 < 120 THEN 0.1 ELSE 0.3 + l_tax / 10 END AS er,
         -0.5 - l_tax / 10 AS lx, l_discount / 20 AS ly, 0.5 AS rx, 0.0 AS ry, l_quantity / 100 AS ap, CASE WHEN seq % 125 = 0 THEN 100.0 ELSE l_quantity / 1000 END AS speed,
         CASE WHEN seq > 0 THEN 40.0 END AS rgap, CASE WHEN session_id % 8 = 3 AND seq >= 1200 THEN 0.0001 ELSE 0.01 END AS sharp, session_id % 15 = 2 AND seq = 700 AS nocam
  FROM raw_face),
fsessions AS (SELECT DISTINCT session_id, CASE WHEN session_id % 12 = 11 THEN 1499.0 ELSE 2000.0 END AS calibration FROM face),
screened AS (
  SELECT *, floor(t_ms / 5000)::BIGINT AS bin, faces = 1 AND NOT nocam AND sharp >= 0.0008 AND abs(yaw) <= 7 AND abs(pitch) <= 10 AND abs(roll) <= 5
         AND wpx / 384 BETWEEN 0.8 AND 1.2 AND hpx / 360 BETWEEN 0.8 AND 1.2 AS usable, sqrt(wpx * hpx) AS size
  FROM face WHERE t_ms < 300000),
gapped AS (SELECT *, t_ms - lag(t_ms) OVER w AS gap, row_number() OVER w AS place FROM screened WINDOW w AS (PARTITION BY session_id, bin ORDER BY t_ms, seq)),
allbins AS (
  SELECT session_id, bin, count(*) AS n, bool_and(usable) AS ok, count(DISTINCT track) AS tracks, min(gap) AS g0, max(gap) AS g1, max(t_ms) - min(t_ms) AS span, min(track) AS track,
         coalesce(median(gap) FILTER (gap > 0 AND gap <= 200), 1000 / 30) AS step, sum(gap) AS gaps, quantile_cont(size, 0.1) AS p10, quantile_cont(size, 0.9) AS p90 FROM gapped GROUP BY ALL),
bins AS (
  SELECT *, least(5000, floor((coalesce(gaps, 0) + step) * 1000 + 0.5) / 1000) AS dur FROM allbins
  WHERE n >= 80 AND ok AND tracks = 1 AND g0 > 0 AND g1 <= 200 AND span >= 4800 AND least(5000, floor((coalesce(gaps, 0) + step) * 1000 + 0.5) / 1000) >= 4000 AND p90 / p10 <= 1.15)
"""

FACE_VALUES = FACE + r""",
kept AS (SELECT g.*, b.step FROM gapped g JOIN bins b USING (session_id, bin)),
series AS (
  SELECT session_id, bin, t_ms, step, unnest(range(8)) AS k, unnest([0.9, 0.9, 0.5, 0.5, 0.5, 0.9, 0.5, 0.9]) AS p,
         unnest([el, er, abs(el - er), sqrt((lx - rx) ** 2 + (ly - ry) ** 2), ap, ap, sqrt((lx + rx) ** 2 + (ly - ry) ** 2),
                 CASE WHEN place > 1 AND rgap > 0 AND rgap <= 200 AND speed >= 0 THEN speed END]) AS v FROM kept),
lasting AS (SELECT *, lead(t_ms) OVER (PARTITION BY session_id, bin, k ORDER BY t_ms) - t_ms AS lasts FROM series WHERE v IS NOT NULL),
weighed AS (SELECT *, CASE WHEN lasts IS NULL THEN step ELSE greatest(lasts, 0) END AS w FROM lasting),
summed AS (SELECT *, sum(w) OVER (PARTITION BY session_id, bin, k ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY session_id, bin, k) AS total FROM weighed),
bin_values AS (SELECT session_id, bin, k, coalesce(min(v) FILTER (c >= total * p), max(v)) AS v FROM summed GROUP BY ALL)
"""

FACE_METRICS = "WITH " + FACE_VALUES + r""",
mid AS (SELECT session_id, k, median(v) AS mid, CASE WHEN count(*) >= 2 THEN mad(v) END AS dev, count(*) AS n FROM bin_values GROUP BY ALL),
tot AS (
  SELECT session_id, count(*) AS bins, sum(dur) AS exposure, sum(n)::BIGINT AS frames, count(DISTINCT track) AS tracks, (max(bin) - min(bin) + 1) * 5000 AS span,
         median(n / (dur / 1000)) AS cadence, median(dur / 5000) AS coverage, median(least(1, greatest(0, 1 - (p90 / p10 - 1) / (1.15 - 1)))) AS steady FROM bins GROUP BY ALL),
pose AS (SELECT session_id, median(least(1, greatest(0, 1 - greatest(abs(yaw) / 7, abs(pitch) / 10, abs(roll) / 5)))) AS pose FROM kept GROUP BY ALL),
lost AS (SELECT session_id, count(*) FILTER (faces <> 1) AS unattributed FROM gapped GROUP BY ALL),
metrics AS (
  SELECT unnest(range(8)) AS k,
         unnest(['ambient.face.eye_aperture.left', 'ambient.face.eye_aperture.right', 'ambient.face.eye_aperture.asymmetry', 'ambient.face.mouth_width', 'ambient.face.mouth_aperture.median',
                 'ambient.face.mouth_aperture.p90', 'ambient.face.mouth_corner_position.asymmetry', 'ambient.face.landmark_speed.p90']) AS code,
         unnest(['eye-width-ratio', 'eye-width-ratio', 'eye-width-ratio', 'inter-eye-normalized-distance', 'mouth-width-ratio', 'mouth-width-ratio', 'inter-eye-normalized-distance',
                 'inter-eye-distances/second']) AS unit),
judged AS (
  SELECT s.session_id, m.k, m.code, m.unit, mid, dev, coalesce(bins, 0) AS bins, coalesce(exposure, 0) AS exposure, coalesce(frames, 0) AS frames,
         0.3 * least(1, cadence / 30) + 0.3 * least(1, coverage) + 0.2 * steady + 0.2 * pose AS q,
         CASE WHEN calibration < 1500 THEN 'quality-threshold-failed' WHEN coalesce(bins, 0) = 0 AND unattributed > 0 THEN 'multiple-faces' WHEN coalesce(bins, 0) = 0 THEN 'no-usable-signal'
              WHEN tracks > 1 THEN 'quality-threshold-failed' WHEN bins < 3 THEN 'insufficient-bins' WHEN span < 30000 THEN 'insufficient-duration'
              WHEN coalesce(n, 0) < 3 THEN 'insufficient-bins' END AS reason
  FROM fsessions s CROSS JOIN metrics m LEFT JOIN tot USING (session_id) LEFT JOIN pose USING (session_id) LEFT JOIN lost USING (session_id)
  LEFT JOIN mid ON mid.session_id = s.session_id AND mid.k = m.k)
SELECT session_id, k AS ordinal, code, unit, CASE WHEN reason IS NULL THEN 'measured' ELSE 'withheld' END AS status, round(CASE WHEN reason IS NULL THEN mid END, 6) AS value,
       round(CASE WHEN reason IS NULL THEN least(1, greatest(0, q)) END, 6) AS quality_score, round(CASE WHEN reason IS NULL THEN dev END, 6) AS dispersion, reason, bins,
       round(exposure, 6) AS exposure_ms, frames
FROM judged
"""

#: Blinks of each qualifying bin, by recursion over a session's frames in order.
BLINKS = "WITH RECURSIVE " + FACE + r""",
inbins AS (SELECT g.session_id, g.bin, g.t_ms, g.seq, el, er FROM gapped g JOIN bins b USING (session_id, bin)),
wide AS (SELECT session_id, quantile_cont(el, 0.9) AS l, quantile_cont(er, 0.9) AS r FROM inbins GROUP BY ALL),
ordered AS (SELECT k.*, l, r, row_number() OVER (PARTITION BY session_id ORDER BY t_ms, seq) AS i FROM inbins k JOIN wide USING (session_id)),
fold AS (
  SELECT DISTINCT session_id, 0::BIGINT AS i, NULL::DOUBLE AS open, false AS wait, -1e300::DOUBLE AS accepted, NULL::DOUBLE AS t, NULL::BIGINT AS bin, false AS hit FROM ordered
  UNION ALL
  SELECT session_id, i, CASE WHEN begins THEN t WHEN w OR late OR done THEN NULL ELSE o END, late OR (w AND NOT back), CASE WHEN found THEN t ELSE accepted END, t, bin, found
  FROM (
    SELECT *, coalesce(NOT w AND o IS NOT NULL AND t - o > 800, false) AS late, coalesce(NOT w AND o IS NOT NULL AND t - o <= 800 AND back, false) AS done,
           coalesce(NOT w AND o IS NOT NULL AND t - o <= 800 AND back AND t - o >= 50, false) AS found, NOT w AND o IS NULL AND closed AND t - accepted >= 150 AS begins
    FROM (
      SELECT n.session_id, n.i, n.t_ms AS t, n.bin, f.accepted, CASE WHEN coalesce(n.bin <> f.bin AND n.bin <> f.bin + 1, false) OR coalesce(n.t_ms - f.t > 75, false) THEN NULL ELSE f.open END AS o,
             f.wait AND NOT (coalesce(n.bin <> f.bin AND n.bin <> f.bin + 1, false) OR coalesce(n.t_ms - f.t > 75, false)) AS w, n.el <= n.l * 0.6 AND n.er <= n.r * 0.6 AS closed, n.el >= n.l * 0.8 AND n.er >= n.r * 0.8 AS back
      FROM fold f JOIN ordered n ON n.session_id = f.session_id AND n.i = f.i + 1) a) b)
SELECT b.session_id, b.bin, count(*) FILTER (hit) AS blinks FROM bins b LEFT JOIN fold f ON f.session_id = b.session_id AND f.bin = b.bin GROUP BY ALL
"""

#: The blink metric's outcomes, beside the other face metrics (``g``).
BLINK_RATE = "WITH g AS (" + FACE_METRICS + "), n AS (" + BLINKS + r"""),
c AS (SELECT session_id, sum(blinks)::BIGINT AS blinks, CASE WHEN count(*) >= 2 THEN mad(blinks / (5000 / 60000)) END AS dev FROM n GROUP BY ALL),
k AS (SELECT g.*, coalesce(reason, CASE WHEN exposure_ms < 60000 THEN 'insufficient-exposure' WHEN frames / (exposure_ms / 1000) < 24 THEN 'insufficient-frame-cadence' END) AS why, coalesce(c.blinks, 0) AS blinks, dev FROM g LEFT JOIN c USING (session_id) WHERE ordinal = 0)
SELECT session_id, 8 AS ordinal, 'ambient.face.blink_rate.bilateral' AS code, 'events/minute' AS unit, CASE WHEN why IS NULL THEN 'measured' ELSE 'withheld' END AS status, round(CASE WHEN why IS NULL THEN blinks / (exposure_ms / 60000) END, 6) AS value,
       CASE WHEN why IS NULL THEN quality_score END AS quality_score, round(CASE WHEN why IS NULL THEN dev END, 6) AS dispersion, why AS reason, bins, exposure_ms, frames, blinks FROM k
"""
