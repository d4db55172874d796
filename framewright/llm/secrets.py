"""Secrets in text: fixed patterns, and character Markov models of random and ordinary strings.  SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.tables import documents

#: The patterns, in the order that their spans take at one start.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")
#: Strings that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_CODES = 128
#: Values that a running total folds at a time, and a place beyond every text.
STRETCH, FAR = 64, 1 << 62
SPAN = "array<struct<start:bigint,end:bigint,kind:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running totals of an array under an associative operation, such as a sum or a maximum.

    Totals are folded within stretches of ``STRETCH`` values and over the
    stretches, so that arrays which grow by appending stay short.
    """
    none, first = F.array().cast("array<bigint>"), F.lit(zero).cast("long")
    state = F.struct(first.alias("at"), none.alias("out"))
    fold = lambda array: F.aggregate(array, state, lambda acc, x: let(op(acc.at, x), lambda t: F.struct(t.alias("at"), F.concat(acc.out, F.array(t)).alias("out"))), lambda acc: acc.out)

    def within(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int"))
        return F.transform(numbers, lambda k: fold(F.slice(v, k * STRETCH + 1, F.lit(STRETCH))))

    def joined(w: Column) -> Column:
        before = F.concat(F.array(first), fold(F.transform(w, lambda x: F.element_at(x, -1))))
        return F.flatten(F.zip_with(w, F.slice(before, F.lit(1), F.size(w)), lambda x, b: F.transform(x, lambda y: op(b, y))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(within(v), joined)).otherwise(none))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost, non-overlapping matches with their places in code points (end exclusive).

    The text splits at the matches into gaps; running sums over gaps and matches
    give the places.  Gaps are only made where something matches.
    """

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        ends = running(sizes, lambda a, b: a + b, 0)
        return F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("text")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPAN)))


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of the ``others``: no other one that starts before ends within, and none starts within.

    Both are swept once in order of their starts, forwards for ends and backwards
    for starts.
    """
    mark = lambda own: lambda x: F.struct(x.start.alias("start"), F.lit(own).alias("own"), x.end.alias("end"), x.alias("span"))

    def swept(line: Column) -> Column:
        ended = running(F.transform(line, lambda x: F.when(x.own, F.lit(-1).cast("long")).otherwise(x.end)), F.greatest, -1)
        later = F.reverse(running(F.reverse(F.transform(line, lambda x: F.when(x.own, F.lit(FAR)).otherwise(x.start))), F.least, FAR))
        near = F.zip_with(line, F.zip_with(ended, later, lambda e, n: F.struct(e.alias("ended"), n.alias("later"))), lambda x, y: F.struct(x.alias("x"), y.ended.alias("ended"), y.later.alias("later")))
        return F.transform(F.filter(near, lambda z: z.x.own & (z.ended <= z.x.start) & (z.later >= z.x.end)), lambda z: z.x.span)

    return let(F.array_sort(F.concat(F.transform(others, mark(False)), F.transform(spans, mark(True)))), swept)


def base_spans(text: Column) -> list[Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.filter(
        F.zip_with(matches(text, ASSIGN, 0), values, lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n"))), lambda x: x.n >= ASSIGN_LEAST)
    return [F.transform(long_enough, lambda x: x.s), matches(text, ACCESS, 1), matches(text, HEX, 2)]


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, "", -1), lambda c: F.ascii(c))


def _pairs(codes: Column) -> Column:
    """Numbers of neighbouring characters."""
    n = F.size(codes)
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a * _CODES + b)


@dataclass
class MarkovRatio:
    """Log-likelihood ratio, random over ordinary, of each pair of neighbouring characters (natural logarithm)."""

    ratio: list[float]

    def score(self, token: Column) -> Column:
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratio)), ",", -1).cast("array<double>")
        steps = F.transform(_pairs(_codes(token)), lambda p: F.element_at(table, p + 1))
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def train(samples: DataFrame, smoothing: float = 0.5, alphabet: int = 66) -> MarkovRatio:
    """First-order models of both labels from ``samples (token, random)``.

    Tokens are ASCII.  The counts, at most one for each pair of characters and
    label, come to the driver.  Rows with a null or short token or a null label
    add nothing; without samples all ratios are 0.
    """
    pairs = samples.filter("random is not null and length(token) > 1").select("random", F.explode(_pairs(_codes(F.col("token")))).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in pairs.filter(F.col("pair") < _CODES * _CODES).groupBy("random", "pair").count().collect():
        counts[bool(row["random"])][row["pair"]] = row["count"]
    log: dict[bool, list[float]] = {}
    for label, c in counts.items():
        before = [0] * _CODES
        for pair, k in c.items():
            before[pair // _CODES] += k
        log[label] = [math.log((c.get(p, 0) + smoothing) / (before[p // _CODES] + smoothing * alphabet)) for p in range(_CODES * _CODES)]
    return MarkovRatio([a - b for a, b in zip(log[True], log[False], strict=True)])


def random_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Random strings as keys are written: base 64, the same without marks, and hexadecimal in either case."""
    raw = spark.range(n).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    tokens = F.array(b64, F.regexp_replace(b64, "[+/=]", ""), F.col("h"), F.upper("h"))
    return raw.select(F.explode(tokens).alias("token"), F.lit(True).alias("random"))


def ordinary_samples(docs: DataFrame, max_docs: int = 1000) -> DataFrame:
    """Words of at most ``max_docs`` documents, chosen by a hash of their ids, as they are and in compound identifiers."""
    chosen = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    words = F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{4,}\b"), F.lit(0))
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(words.alias("w"))
    pairs = F.zip_with(F.col("w"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.array(
        a, F.concat(a, F.lit("_"), b), F.concat(a, F.lit("-"), b), F.concat(F.lower(a), F.initcap(b)), F.upper(F.concat(a, F.lit("_"), b))))
    return rows.select(F.explode(F.flatten(F.filter(pairs, lambda x: F.exists(x, lambda t: t.isNotNull())))).alias("token"), F.lit(False).alias("random"))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def secrets(docs: DataFrame, model: MarkovRatio, least: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that look like secrets, in every text.

    One row per input row: ``doc_id, n_assign, n_access, n_hex, n_markov``,
    ``base_sha256`` (hash of the pattern spans) and ``spans`` (all spans as
    ``kind:start:end``, by start, then kind).  A candidate string beside the
    pattern spans becomes a ``markov`` span if its log-likelihood ratio is
    ``least`` or more.

    Null and empty texts have no spans.  Rows without an id and repeated rows are
    scanned like any other; an empty table gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """
    text = F.col("text")
    found = documents(docs, id_col, text_col).select(
        "doc_id", *(c.alias(k) for c, k in zip(base_spans(text), KINDS, strict=False)), matches(text, CANDIDATE, 3).alias("candidates"))
    in_order = lambda *spans: F.transform(F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.alias("span")))), lambda x: x.span)
    found = found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), in_order(*KINDS[:3]).alias("base"), "candidates")
    found = found.withColumn("markov", F.filter(apart(F.col("candidates"), F.col("base")), lambda c: model.score(c.text) >= least))
    every = in_order("base", "markov")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("markov").cast("long").alias("n_markov"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"))


def default_model(docs: DataFrame, max_docs: int = 1000) -> MarkovRatio:
    samples = ordinary_samples(documents(docs), max_docs).unionByName(random_samples(docs.sparkSession))
    return train(samples)
