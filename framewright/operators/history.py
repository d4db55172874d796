"""A subject's current encounter against compatible earlier ones, for all subjects at once."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions.stats import by_locale, finite
from framewright.functions.tables import settle


@dataclass(frozen=True)
class Policy:
    """The default comparison policy."""

    minimum_prior: int = 3
    snr_db: float = 6.0
    framing: float = 0.15
    frame_rate: float = 0.25
    illumination: float = 0.2
    id: str = "default"

    def __post_init__(self) -> None:
        """A policy has a name, wants one earlier record at least, and its tolerances are finite and not negative."""
        if not self.id.strip():
            raise ValueError("a policy needs an id")
        if isinstance(self.minimum_prior, bool) or not isinstance(self.minimum_prior, int) or self.minimum_prior < 1:
            raise ValueError("minimum_prior must be a positive whole number")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name != "id" and not (math.isfinite(value) and value >= 0):
                raise ValueError(f"{f.name} must be finite and not negative")


NUMBERS = ("value", "spread", "confidence")
CONFOUNDS = ("snr_db", "width_fraction", "height_fraction", "frame_rate", "illumination")


def _names(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in pairs)))


def aggregate_reasons() -> Column:
    """What is wrong with an aggregate by itself."""
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    bad_number = ~finite("value") | ~finite("spread") | ~finite("confidence")
    for c in CONFOUNDS:
        bad_number = bad_number | (F.col(c).isNotNull() & ~finite(c))
    return _names(
        (bad_number, "nonfinite-aggregate"), (F.col("spread") < 0, "negative-aggregate-spread"), (~F.col("confidence").between(0, 1) & ~F.isnan("confidence"), "aggregate-confidence-out-of-range"),
        (F.coalesce("windows", F.lit(0)) == 0, "missing-aggregate-evidence"),
        (blank("code") | blank("unit") | blank("algorithm_version") | blank("processor_ref") | (F.coalesce("windows", F.lit(0)) < 1), "invalid-aggregate-metadata"))


#: What a comparison looks at in either aggregate.
COMPARED = ("value", "unit", "algorithm_version", "processor_ref", "kind", *CONFOUNDS, "rate_class", "processing")


def summarised(aggregates: DataFrame) -> DataFrame:
    """One row per encounter: what is ``wrong`` with its aggregates, whether one is ``repeated``, and all of them as ``entries``, the first of a code and context with ``nth`` 1."""
    nth = F.row_number().over(Window.partitionBy("visit_id", "code", "context_kind").orderBy("position"))
    own = aggregates.select("visit_id", aggregate_reasons().alias("wrong"), nth.alias("nth"), "code", "context_kind", *COMPARED)
    return own.groupBy("visit_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("wrong")))).alias("wrong"), (F.max("nth") > 1).alias("repeated"), F.collect_list(F.struct("nth", "code", "context_kind", F.struct(*COMPARED).alias("of"))).alias("entries"))


def screened(visits: DataFrame, aggregates: DataFrame, current: DataFrame) -> DataFrame:
    """Earlier records of each current encounter's participant, with record-level reasons, and the current encounters themselves (``is_current``).

    ``current (participant_id, current_visit, current_time, protocol_id)`` names
    one encounter per participant.  Every record of the participant appears,
    the current one too (it is excluded by name).  All meet their aggregates
    once: ``entries`` of current encounters and of records without a reason.
    """
    copies = visits.groupBy("visit_id").agg(F.count("*").alias("copies"))
    named = current.withColumnRenamed("protocol_id", "current_protocol")
    records = visits.join(named, "participant_id").withColumn("is_current", F.lit(False))
    both = records.unionByName(named.select("*", F.col("current_visit").alias("visit_id"), F.lit(True).alias("is_current")), allowMissingColumns=True)
    r = both.join(copies, "visit_id", "left").join(summarised(aggregates), "visit_id", "left")
    f = F.col
    reasons = _names(
        (F.coalesce("contains_phi", F.lit(True)), "history-not-explicitly-non-phi"), (~f("review_status").eqNullSafe("accepted"), "history-not-accepted"),
        (~f("protocol_id").eqNullSafe(f("current_protocol")), "protocol-id-mismatch"), (f("visit_id") == f("current_visit"), "same-as-current-encounter"),
        (f("occurred_at").isNull(), "invalid-occurred-at"), (f("occurred_at") >= f("current_time"), "not-prior-to-current"),
        (f("copies") > 1, "duplicate-encounter-id"), (f("repeated"), "duplicate-aggregate-identity"))
    r = r.withColumn("record_reasons", F.array_union(reasons, F.coalesce("wrong", F.array().cast("array<string>"))))
    return r.select(
        "participant_id", "visit_id", "current_visit", "current_time", "is_current", "contains_phi", "record_reasons", F.when(f("is_current"), f("wrong")).alias("wrong"), "repeated",
        F.when(f("is_current") | (F.size("record_reasons") == 0), f("entries")).alias("entries"))


def confound_reasons(policy: Policy) -> Column:
    """Differences of measuring conditions between current (``c_``) and earlier (``h_``) aggregate."""
    c, h = (lambda n: F.col(f"c_{n}")), (lambda n: F.col(f"h_{n}"))
    voice, face = F.col("code").contains(".voice."), F.col("code").contains(".face.")
    far = lambda n, limit: F.abs(c(n) - h(n)) > limit
    speech = _names((far("snr_db", policy.snr_db), "speech-snr-out-of-tolerance"), (~c("rate_class").eqNullSafe(h("rate_class")), "voice-sample-rate-class-mismatch"),
                    (~c("processing").eqNullSafe(h("processing")), "voice-browser-processing-mismatch"))
    visual = _names((F.greatest(F.abs(c("width_fraction") - h("width_fraction")), F.abs(c("height_fraction") - h("height_fraction"))) > policy.framing, "face-framing-out-of-tolerance"),
                    (F.abs(c("frame_rate") - h("frame_rate")) / F.greatest(F.lit(1.0), h("frame_rate")) > policy.frame_rate, "frame-rate-out-of-tolerance"),
                    (far("illumination", policy.illumination), "illumination-out-of-tolerance"))
    kind = F.array(F.lit("confound-envelope-kind-mismatch"))
    is_kind = lambda k: (c("kind") == k) & (h("kind") == k)
    return F.when(voice, F.when(is_kind("speech"), speech).otherwise(kind)).when(face, F.when(is_kind("visual"), visual).otherwise(kind)).otherwise(F.array().cast("array<string>"))


def matches(known: DataFrame, policy: Policy) -> DataFrame:
    """Each current aggregate with the first aggregate of the same code and context of each admissible record (``screened``), and what stands against it.

    Records and current encounters meet by participant, with their aggregates
    inside: what the participants' groups that follow are made of stays there.
    """
    first = F.filter("entries", lambda e: (e.nth == 1) & e.code.isNotNull() & e.context_kind.isNotNull())
    earlier = F.map_from_entries(F.transform(first, lambda e: F.struct(F.struct(e.code.alias("code"), e.context_kind.alias("context_kind")), e.of)))
    ok = known.filter(~F.col("is_current") & (F.size("record_reasons") == 0)).select("participant_id", "visit_id", "current_visit", earlier.alias("earlier"))
    c = known.filter("is_current").select("participant_id", F.col("current_visit").alias("of_visit"), F.explode("entries").alias("e"))
    c = c.select("participant_id", "of_visit", "e.code", "e.context_kind", *(F.col(f"e.of.{x}").alias(f"c_{x}") for x in COMPARED))
    m = ok.join(c, "participant_id").filter(F.coalesce(F.col("of_visit") == F.col("current_visit"), F.lit(False))).drop("of_visit")
    m = m.withColumn("h", F.when(F.col("code").isNotNull() & F.col("context_kind").isNotNull(), F.try_element_at("earlier", F.struct("code", "context_kind")))).drop("earlier")
    m = m.select("*", *(F.col(f"h.{x}").alias(f"h_{x}") for x in COMPARED)).drop("h")
    differs = lambda n: ~F.col(f"c_{n}").eqNullSafe(F.col(f"h_{n}"))
    none = F.array().cast("array<string>")
    reasons = (
        F.when(F.col("h_value").isNull(), none).when(differs("unit"), F.array(F.lit("unit-mismatch"))).when(differs("algorithm_version"), F.array(F.lit("algorithm-version-mismatch")))
        .when(F.col("code").contains(".voice.") & differs("processor_ref"), F.array(F.lit("voice-processor-mismatch")))
        .when(F.col("code").contains(".face.") & differs("processor_ref"), F.array(F.lit("visual-processor-mismatch"))).otherwise(confound_reasons(policy)))
    return m.withColumn("reasons", reasons).withColumn("compatible", F.col("h_value").isNotNull() & (F.size("reasons") == 0))


def decided(records: DataFrame, matched: DataFrame) -> DataFrame:
    """Each record ``included`` with one compatible aggregate, else ``excluded`` with sorted reasons."""
    m = matched.groupBy("participant_id", "visit_id").agg(F.bool_or("compatible").alias("included"), F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("reasons"))
    r = records.filter(~F.col("is_current")).select("participant_id", "visit_id", "record_reasons").join(m, ["participant_id", "visit_id"], "left")
    against = F.array_union("record_reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    against = F.when(F.size(against) == 0, F.array(F.lit("no-compatible-biomarkers"))).otherwise(against)
    included = F.coalesce("included", F.lit(False))
    return r.select("participant_id", "visit_id", F.when(included, "included").otherwise("excluded").alias("status"),
                    F.when(included, F.array().cast("array<string>")).otherwise(F.array_sort(against)).alias("reason_codes"))


def decisions(visits: DataFrame, aggregates: DataFrame, current: DataFrame, policy: Policy | None = None) -> DataFrame:
    """``participant_id, visit_id, status, reason_codes`` of every earlier record."""
    records = settle(screened(visits, aggregates, current))
    return decided(records, matches(records, policy or Policy()))


def placed(matched: DataFrame, policy: Policy) -> DataFrame:
    """Where each current aggregate lies among its compatible earlier ones, if there are enough."""
    keys = ["participant_id", "current_visit", "code", "context_kind"]
    m = matched.filter("compatible").withColumn("centre", F.median("h_value").over(Window.partitionBy(*keys)))
    b = m.groupBy(*keys).agg(
        F.count("*").alias("priors"), F.first("c_value").alias("current_value"), F.first("centre").alias("prior_median"), F.min("h_value").alias("prior_min"), F.max("h_value").alias("prior_max"),
        F.median(F.abs(F.col("h_value") - F.col("centre"))).alias("prior_mad")).filter(F.col("priors") >= policy.minimum_prior)
    v, margin = F.col("current_value"), 2 * F.col("prior_mad")
    where = F.when(v < F.col("prior_min") - margin, "below-reference").when(v > F.col("prior_max") + margin, "above-reference").otherwise("within-reference")
    return b.withColumn("delta", v - F.col("prior_median")).withColumn("direction", where)


def baselines(visits: DataFrame, aggregates: DataFrame, current: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Prior median, range and deviation of each current aggregate with enough compatible records, and where it lies."""
    policy = policy or Policy()
    return placed(matches(settle(screened(visits, aggregates, current)), policy), policy)


def current_errors(known: DataFrame) -> DataFrame:
    """``participant_id, errors``: why a current encounter (``screened``) cannot be compared at all; only those with an error."""
    f, own = F.col, F.col("is_current")
    c = known.filter(own | (f("visit_id") == f("current_visit"))).groupBy("participant_id", "current_visit").agg(
        F.max(F.when(~own, F.coalesce("contains_phi", F.lit(True)))).alias("phi"), F.max(F.when(own, f("current_time"))).alias("current_time"), F.max(F.when(own, f("wrong"))).alias("wrong"), F.max(F.when(own, f("repeated"))).alias("repeated"))
    none = F.array().cast("array<string>")
    errors = F.concat(_names(
        (F.coalesce("phi", F.lit(True)), "current-not-explicitly-non-phi"), (F.col("current_time").isNull(), "invalid-occurred-at"), (F.col("wrong").isNull(), "no-aggregates"), (F.col("repeated"), "duplicate-aggregate-identity")), F.coalesce("wrong", none))
    return c.select("participant_id", errors.alias("errors")).filter(F.size("errors") > 0)


def compare(visits: DataFrame, aggregates: DataFrame, current: DataFrame, policy: Policy | None = None) -> DataFrame:
    """One comparison per current encounter: its decisions, its biomarkers and what it amounts to.

    ``comparison_id, participant_id, current_visit, policy_id, status,
    reason_codes, included`` (ids), ``excluded`` (ids with reasons) and
    ``biomarkers`` in readers' order of code and context.  The status is
    ``provisional`` with one biomarker, else ``not-comparable``; a current
    encounter that is wrong in itself is ``refused`` with its errors, and nothing
    else is said of it.  Records are screened, and meet their aggregates, once.
    """
    policy = policy or Policy()
    records = settle(screened(visits, aggregates, current))
    matched = settle(matches(records, policy).select("participant_id", "visit_id", "current_visit", "code", "context_kind", "c_value", "h_value", "reasons", "compatible"))
    of = lambda status, x: F.array_sort(F.collect_list(F.when(F.col("status") == status, x)))
    d = decided(records, matched).groupBy("participant_id").agg(of("included", F.col("visit_id")).alias("included"), of("excluded", F.struct("visit_id", "reason_codes")).alias("excluded"))
    told = ("code", "context_kind", "priors", "current_value", "prior_median", "prior_min", "prior_max", "prior_mad", "delta", "direction")
    entry = F.struct(by_locale("code").alias("_c"), by_locale("context_kind").alias("_k"), F.struct(*told).alias("b"))
    b = placed(matched, policy).groupBy("participant_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.b).alias("biomarkers"))
    c = current.select("participant_id", "current_visit").join(d, "participant_id", "left").join(b, "participant_id", "left").join(current_errors(records), "participant_id", "left")
    refused, some = F.col("errors").isNotNull(), F.col("biomarkers").isNotNull()
    empty = lambda name: F.when(refused | F.col(name).isNull(), F.slice(F.coalesce(name, F.array().cast(c.schema[name].dataType)), 1, 0)).otherwise(F.col(name)).alias(name)
    return c.select(
        F.concat(F.lit("comparison-"), F.col("current_visit").cast("string")).alias("comparison_id"), "participant_id", "current_visit", F.lit(policy.id).alias("policy_id"),
        F.when(refused, "refused").when(some, "provisional").otherwise("not-comparable").alias("status"),
        F.when(refused, F.col("errors")).when(some, F.array().cast("array<string>")).otherwise(F.array(F.lit("insufficient-prior-observations"))).alias("reason_codes"), *map(empty, ("included", "excluded", "biomarkers")))


def events(decided: DataFrame, compared: DataFrame) -> DataFrame:
    """The two summary events of each comparison."""
    a = decided.groupBy("participant_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "included").alias("included"))
    b = compared.groupBy("participant_id").agg(F.count("*").alias("n"))
    first = a.select("participant_id", F.lit(1).alias("sequence"), F.lit("trajectory.compatibility.assessed").alias("type"), F.concat(F.lit("Assessed "), "n", F.lit(" prior encounters for compatibility.")).alias("summary"))
    second = a.select("participant_id").join(b, "participant_id", "left").select(
        "participant_id", F.lit(2).alias("sequence"), F.lit("trajectory.comparison.completed").alias("type"), F.concat(F.lit("Created "), F.coalesce("n", F.lit(0)), F.lit(" provisional personal comparisons.")).alias("summary"))
    return first.unionByName(second)
