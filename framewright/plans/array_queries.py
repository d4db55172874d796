"""Queries over arrays: the embedding vectors as windows of sound, matrices and landmark sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions.stats import by_locale
from framewright.operators import kernels
from framewright.plans.voice_queries import rounded


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def d08_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.windows(_vectors(spark, sf_dir), "v", 8000.0).drop("v", "band_energies"))


def a41_window_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.windows(_vectors(spark, sf_dir), "v", 8000.0).select("vec_id", "rms", "dc_offset", "clipped_sample_fraction"))


def d06_band_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kernels.windows(_vectors(spark, sf_dir), "v", 8000.0)
    return rounded(k.select("vec_id", F.posexplode("band_energies").alias("band", "energy")))


def d07_spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kernels.windows(_vectors(spark, sf_dir), "v", 8000.0)
    prior = F.lag("band_energies").over(Window.partitionBy("label").orderBy("vec_id"))
    return rounded(k.withColumn("prior", prior).select("vec_id", kernels.spectral_flux(F.col("band_energies"), F.col("prior")).alias("flux")))


def w08_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _vectors(spark, sf_dir).select("vec_id", F.posexplode(kernels.sliding(F.col("v"), 16, 4)).alias("window", "w"))
    return rounded(w.select("vec_id", "window", F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x).alias("energy")))


def a42_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.pool(_vectors(spark, sf_dir), ["label"], "v"))


def p19_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vectors(spark, sf_dir).select("vec_id", kernels.pose(F.col("v")).alias("p")).select("vec_id", "p.*"))


def p12_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks from consecutive pairs of the vector; some fall outside the image."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((F.element_at("v", 2 * i + 1) * 0.9 + 0.5).alias("x"), (F.element_at("v", 2 * i + 2) * 0.9 + 0.5).alias("y")))
    b = _vectors(spark, sf_dir).select("vec_id", kernels.bounding_box(pairs, F.lit(640.0), F.lit(480.0)).alias("b"))
    return rounded(b.select("vec_id", "b.*"))


def r13_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of names with accents and of plain ones."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", kernels.identity(F.col("c_name"), F.concat(F.col("c_mktsegment"), F.lit("é"))).alias("identity"))
    return c.select("c_custkey", "identity", kernels.fnv1a(F.col("identity")).alias("utf8"), kernels.fnv1a(F.col("identity"), utf16=True).alias("utf16"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey images of 8 by 8 pixels; some are black, some white, and some have a region."""
    k = F.col("vec_id")
    grey = F.transform("v", lambda x: F.when(k % 11 == 1, 0).when(k % 13 == 2, 255).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x * 400 + 128)))).cast("int"))
    pixel = lambda g: F.concat(*[F.lpad(F.hex(g), 2, "0")] * 3, F.lit("FF"))
    box = F.when(k % 4 > 0, F.struct((k % 3 / 8).alias("x"), (k % 5 / 16).alias("y"), (0.3 + k % 7 / 10).alias("width"), (0.05 + k % 2 / 2).alias("height")))
    return _vectors(spark, sf_dir).select("vec_id", F.unhex(F.array_join(F.transform(grey, pixel), "")).alias("pixels"), box.alias("box"))


def p21_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = kernels.image_quality(F.col("pixels"), F.lit(8), F.lit(8))
    return rounded(_images(spark, sf_dir).select("vec_id", q.alias("q")).select("vec_id", "q.*"))


def x10_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the images' regions, drawn to 64 by 64."""
    q = kernels.region_quality(F.col("pixels"), F.lit(8), F.lit(8), F.col("box"))
    return rounded(_images(spark, sf_dir).select("vec_id", q.alias("q")).select("vec_id", "q.*"))


def o05_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations in three spellings, numbered as readers sort them."""
    name = F.explode(F.array(F.upper("n_name"), F.lower("n_name"), F.initcap("n_name")))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", name.alias("name"))
    return n.select("n_regionkey", "name", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(by_locale("name"))).alias("place"))


QUERIES = {
    "d08_window_analysis": d08_windows, "a41_window_levels": a41_window_levels, "d06_band_energies": d06_band_energies, "d07_spectral_flux": d07_spectral_flux, "w08_sliding_windows": w08_sliding,
    "a42_pooling": a42_pooling, "p19_pose": p19_pose, "p12_bounding_box": p12_bounding_box, "p21_image_quality": p21_image, "x10_region_quality": x10_region, "o05_collated_order": o05_collated, "r13_identities": r13_identities,
}

_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_BANDS = _E + """,
  c AS (SELECT vec_id, label, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e),
  s AS (SELECT vec_id, label, b, list_transform(v, lambda x, i: x * cos((b + 1) / 17 * pi() * (i - 1))) AS re, list_transform(v, lambda x, i: x * sin((b + 1) / 17 * pi() * (i - 1))) AS im, len(v) AS n FROM c, range(16) r(b)),
  bands AS (SELECT vec_id, label, b, (list_sum(re) ** 2 + list_sum(im) ** 2) / n AS energy FROM s)"""

#: Grey images of 8 by 8, their regions in pixels, and the statistics of a square of luma ``l`` of side ``n``.
_IMAGE = _E + """,
  i AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN vec_id % 11 = 1 THEN 0 WHEN vec_id % 13 = 2 THEN 255 ELSE least(255, greatest(0, floor(x * 400 + 128))) END) AS g, vec_id % 4 > 0 AS part,
               (vec_id % 3 / 8 * 8)::DOUBLE AS bx, (vec_id % 5 / 16 * 8)::DOUBLE AS byy, ((0.3 + vec_id % 7 / 10) * 8)::DOUBLE AS bw, ((0.05 + vec_id % 2 / 2) * 8)::DOUBLE AS bh FROM e)"""
_JUDGED = """,
  s AS (SELECT vec_id, n, l, list_transform(list_filter(range(n * n), lambda k: k // n BETWEEN 1 AND n - 2 AND k % n BETWEEN 1 AND n - 2), lambda k: 4 * l[k + 1] - l[k] - l[k + 2] - l[k + 1 - n] - l[k + 1 + n]) AS edge FROM q)
  SELECT vec_id, round(list_avg(l), 6) AS illumination_mean, round(len(list_filter(l, lambda x: x <= 0.02)) / len(l), 6) AS dark_clipping, round(len(list_filter(l, lambda x: x >= 0.98)) / len(l), 6) AS bright_clipping,
         round(list_avg(list_transform(edge, lambda x: x ** 2)) - list_avg(edge) ** 2, 6) AS sharpness FROM s"""

ORACLES = {
    "p21_image_quality": _IMAGE + ", q AS (SELECT vec_id, 8 AS n, list_transform(g, lambda x: x / 255) AS l FROM i)" + _JUDGED,
    "x10_region_quality": _IMAGE + """,
      r AS (SELECT vec_id, g, CASE WHEN part THEN bx ELSE 0 END AS x, CASE WHEN part THEN byy ELSE 0 END AS y, CASE WHEN part THEN greatest(1, least(8 - bx, bw)) ELSE 8 END AS w, CASE WHEN part THEN greatest(1, least(8 - byy, bh)) ELSE 8 END AS h FROM i),
      a AS (SELECT *, list_transform(range(64), lambda k: least(least(7, x + w - 1), greatest(x, x + (k + 0.5) * w / 64 - 0.5))) AS xs, list_transform(range(64), lambda k: least(least(7, y + h - 1), greatest(y, y + (k + 0.5) * h / 64 - 0.5))) AS ys FROM r),
      c AS (SELECT vec_id, g, unnest(range(64)) AS row, xs, unnest(ys) AS yy FROM a), d AS (SELECT vec_id, g, row, yy, unnest(range(64)) AS col, unnest(xs) AS xx FROM c),
      f AS (SELECT vec_id, row, col, floor((g[floor(yy)::INT * 8 + floor(xx)::INT + 1] * (1 - (yy - floor(yy))) + g[least(7, floor(yy)::INT + 1) * 8 + floor(xx)::INT + 1] * (yy - floor(yy))) * (1 - (xx - floor(xx)))
                 + (g[floor(yy)::INT * 8 + least(7, floor(xx)::INT + 1) + 1] * (1 - (yy - floor(yy))) + g[least(7, floor(yy)::INT + 1) * 8 + least(7, floor(xx)::INT + 1) + 1] * (yy - floor(yy))) * (xx - floor(xx)) + 0.5) AS v FROM d),
      q AS (SELECT vec_id, 64 AS n, list(v / 255 ORDER BY row, col) AS l FROM f GROUP BY vec_id)""" + _JUDGED,
    "o05_collated_order": """
        WITH x AS (SELECT n_regionkey, unnest([upper(n_name), lower(n_name), array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')]) AS name FROM nation)
        SELECT n_regionkey, name, row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(name), translate(name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'))::INT AS place FROM x""",
    "a41_window_levels": _E + """
        SELECT vec_id, round(sqrt(list_avg(list_transform(v, lambda x: (x - list_avg(v)) ** 2))), 6) AS rms, round(list_avg(v), 6) AS dc_offset,
               round(len(list_filter(v, lambda x: abs(x) >= 0.98)) / len(v), 6) AS clipped_sample_fraction FROM e""",
    "d06_band_energies": _BANDS + " SELECT vec_id, b::INT AS band, round(energy, 6) AS energy FROM bands",
    "d07_spectral_flux": _BANDS + """,
        o AS (SELECT vec_id, label, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM (SELECT DISTINCT vec_id, label FROM bands)),
        p AS (SELECT o.vec_id, x.b, x.energy, y.energy AS prior FROM o JOIN bands x USING (vec_id) LEFT JOIN o q ON q.label = o.label AND q.n = o.n - 1 LEFT JOIN bands y ON y.vec_id = q.vec_id AND y.b = x.b)
        SELECT vec_id, round(CASE WHEN count(prior) = 0 THEN 0 ELSE sqrt(sum(greatest(0, ln(1 + energy) - ln(1 + prior)) ** 2) / 16) END, 6) AS flux FROM p GROUP BY vec_id""",
    "w08_sliding_windows": _E + """,
        w AS (SELECT vec_id, v, unnest(range(0, len(v) - 15, 4)) AS s FROM e)
        SELECT vec_id, (s // 4)::INT AS "window", round(list_sum(list_transform(v[s + 1:s + 16], lambda x: x * x)), 6) AS energy FROM w""",
    "a42_pooling": _E + ", u AS (SELECT label, unnest(v) AS v, unnest(range(len(v)))::INT AS dimension FROM e) SELECT label, dimension, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM u GROUP BY ALL",
    "p19_pose": _E + """,
        n AS (SELECT vec_id, v, sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2) AS a, sqrt(v[5] ** 2 + v[6] ** 2 + v[7] ** 2) AS b, sqrt(v[9] ** 2 + v[10] ** 2 + v[11] ** 2) AS c FROM e)
        SELECT vec_id, round(degrees(asin(greatest(-1, least(1, -v[3] / a)))), 6) AS yaw_deg, round(degrees(atan2(v[7] / b, v[11] / c)), 6) AS pitch_deg, round(degrees(atan2(v[2] / a, v[1] / a)), 6) AS roll_deg FROM n""",
    "p12_bounding_box": _E + """,
        p AS (SELECT vec_id, list_transform(range(16), lambda i: v[2 * i + 1] * 0.9 + 0.5) AS xs, list_transform(range(16), lambda i: v[2 * i + 2] * 0.9 + 0.5) AS ys FROM e),
        q AS (SELECT vec_id, list_min(xs) AS x0, list_max(xs) AS x1, list_min(ys) AS y0, list_max(ys) AS y1 FROM p), r AS (SELECT *, x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1 AS ok FROM q)
        SELECT vec_id, round(CASE WHEN ok THEN x0 END, 6) AS x, round(CASE WHEN ok THEN y0 END, 6) AS y, round(CASE WHEN ok THEN x1 - x0 END, 6) AS width, round(CASE WHEN ok THEN y1 - y0 END, 6) AS height,
               round(CASE WHEN ok THEN (x1 - x0) * 640 END, 6) AS width_px, round(CASE WHEN ok THEN (y1 - y0) * 480 END, 6) AS height_px, round(CASE WHEN ok THEN least(x0, y0, 1 - x1, 1 - y1) END, 6) AS edge_margin FROM r""",
    "r13_identities": """
        WITH i AS (SELECT c_custkey, strlen(c_name) || ':' || c_name || '|' || strlen(c_mktsegment || 'é') || ':' || c_mktsegment || 'é' AS identity FROM customer),
        u AS (SELECT *, list_transform(range(strlen(identity)), lambda k: ('0x' || substr(hex(encode(identity)), 2 * k + 1, 2))::UHUGEINT) AS a, list_transform(string_split(identity, ''), lambda c: unicode(c)::UHUGEINT) AS b FROM i),
        h AS (SELECT *, list_reduce([14695981039346656037::UHUGEINT] || a, lambda h, x: xor(h, x) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS ha,
                     list_reduce([14695981039346656037::UHUGEINT] || b, lambda h, x: xor(h, x) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS hb FROM u)
        SELECT c_custkey, identity, lpad(lower(to_hex(ha)), 16, '0') AS utf8, lpad(lower(to_hex(hb)), 16, '0') AS utf16 FROM h""",
}
