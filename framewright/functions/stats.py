"""Statistics with the exact conventions of the metrics; each helper says which."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LARGEST = sys.float_info.max


def finite(x: Column | str) -> Column:
    """Not null, not NaN (greater than any number in Spark's order), not infinite; false rather than null.

    One comparison: conditions over many columns stay within what the JVM compiles.
    """
    return F.coalesce(F.abs(x) <= LARGEST, F.lit(False))


def within(x: Column | str, low: float = -LARGEST, high: float = LARGEST) -> Column:
    """Finite and between two finite limits, both included; false rather than null."""
    return F.coalesce((F.col(x) if isinstance(x, str) else x).between(low, high), F.lit(False))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def population_sd(x: str) -> Column:
    """Population standard deviation; 0 for fewer than two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise(F.stddev_pop(x))


def median_or_zero(x: Column) -> Column:
    """Exact median of finite values, 0 when there are none."""
    return F.coalesce(F.median(F.when(finite(x), x)), F.lit(0.0))


def upper_median(values: Column) -> Column:
    """Element ``n div 2`` of the sorted array."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def nearest_rank(values: Column, p: float) -> Column:
    """Element ``min(n - 1, floor(p * n))`` of the sorted array."""
    return F.element_at(F.array_sort(values), F.least(F.size(values) - 1, F.floor(p * F.size(values))).cast("int") + 1)


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up, also for negative numbers."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def mad(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median and raw median absolute deviation (null for fewer than two values) of each group."""
    centre = F.median(value).over(Window.partitionBy(*keys))
    return df.withColumn("_d", F.abs(F.col(value) - centre)).groupBy(*keys).agg(
        F.median(value).alias(out), F.when(F.count(value) >= 2, F.median("_d")).alias(f"{out}_mad"), F.count(value).alias(f"{out}_n"))


def timed_percentile(df: DataFrame, keys: list[str], time: str, value: str, p: Column, step: Column, out: str) -> DataFrame:
    """Time-weighted step percentile of each group.

    A sample weighs as long as it lasts, up to the next one; the last one lasts
    ``step``.  The result is the first value, in ascending order, at which the
    weights add up to ``p`` of the total.
    """
    lasts = F.lead(time).over(Window.partitionBy(*keys).orderBy(time)) - F.col(time)
    return weighted_percentile(df.withColumn("_w", lasting(lasts, step)), keys, value, "_w", p, out)


def lasting(until_next: Column, step: Column) -> Column:
    """How long a sample lasts: up to the next one, the last one ``step``."""
    return F.when(until_next.isNull(), step).otherwise(F.greatest(until_next, F.lit(0.0)))


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, p: Column, out: str) -> DataFrame:
    """The first value of each group, in ascending order, at which the weights add up to ``p`` of the total."""
    by_value = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    w = df.withColumn("_c", F.sum(weight).over(by_value)).withColumn("_t", F.sum(weight).over(Window.partitionBy(*keys)))
    hit = F.when(F.col("_c") >= F.col("_t") * p, F.col(value))
    # rounding may leave the last sum below the target: then it is the largest value
    return w.groupBy(*keys).agg(F.coalesce(F.min(hit), F.max(value)).alias(out))


def all_of(*conditions: Column) -> Column:
    """Conjunction in which null is false."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))


def plain_number(x: Column) -> Column:
    """A number as text, whole ones without a point or an exponent."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def by_locale(text: Column | str) -> Column:
    """Text to be sorted as readers expect: letters before case, lower case first, whatever their bytes."""
    return F.collate(F.col(text) if isinstance(text, str) else text, "UNICODE")
