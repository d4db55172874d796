"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.components import components
from framewright.llm.tables import Scratch, documents
from framewright.llm.text import U, grams, mix64, split_words

VALUE_BITS, MANTISSA_BITS, ROUNDS = 57, 7, 4
CELLS, COUNTED = 256, 32_767
_SEEDS = mix64(np.arange(1, 4097, dtype=np.uint64) * U(0xA0761D6478BD642F))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each row, the sorted distinct hashes of its runs of ``words`` lower-cased words.

    A row of fewer words has its whole sequence as one; a row without words, none.
    """
    for w in split_words(column):
        h, counts = w.hashes(lower=True), w.counts()
        g, _ = grams(h, w.offsets, words)
        short = {n: grams(h, w.offsets, n)[0] for n in set(counts[(counts > 0) & (counts < words)].tolist())}
        for i, n in enumerate(counts.tolist()):
            at = w.offsets[i]
            yield np.unique(g[at : at + n - words + 1]) if n >= words else short[n][at : at + 1] if n else h[:0]


def _code(values: np.ndarray, round_: int) -> np.ndarray:
    """A register: the refill round, leading zeros and the mantissa bits after the first one."""
    fraction, exponent = np.frexp(values.astype(np.float64))
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64).clip(0, (1 << MANTISSA_BITS) - 1)
    return (round_ << (6 + MANTISSA_BITS)) | ((VALUE_BITS - exponent).clip(0, 63) << MANTISSA_BITS) | mantissa


def sketch(items: np.ndarray, buckets: int) -> np.ndarray:
    """HyperMinHash registers of a set of hashes.

    A hash's first bits give its bucket, the rest its value, and the bucket's
    smallest value is compressed.  Buckets that stay empty are refilled: items
    are hashed anew, a few rounds by bucket, then into each empty bucket.  The
    round belongs to the register, so registers of two sets agree as often as
    the sets overlap, however small they are.
    """
    out, empty = np.zeros(buckets, np.int64), np.ones(buckets, bool)
    shift = U(64 - buckets.bit_length() + 1)
    numbers = np.arange(buckets, dtype=np.uint64)
    for r in range(ROUNDS):
        x = np.sort(mix64(items ^ _SEEDS[r]))
        at = np.searchsorted(x, numbers << shift)
        low = x[np.minimum(at, len(x) - 1)]
        new = empty & (at < len(x)) & (low >> shift == numbers)
        out[new] = _code((low[new] << (U(64) - shift)) >> U(64 - VALUE_BITS), r)
        empty &= ~new
        if not empty.any():
            return out.astype(np.uint16)
    rest = np.flatnonzero(empty)
    low = mix64(items[None, :] ^ _SEEDS[16 + rest][:, None]).min(axis=1)
    out[rest] = _code(low >> U(64 - VALUE_BITS), ROUNDS)
    return out.astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    packed = registers.astype(np.uint64).reshape(-1, rows)
    h = mix64(np.arange(1, len(packed) + 1, dtype=np.uint64) * U(0x9FB21C651E98DF25))
    for i in range(rows):
        h = mix64(h ^ packed[:, i])
    return h.view(np.int64)


def collision_rate(n_a: np.ndarray, n_b: np.ndarray, buckets: int) -> np.ndarray:
    """How often two different smallest values fall into one cell of the compressed scale."""
    a, b = np.maximum(n_a, 1) / buckets, np.maximum(n_b, 1) / buckets
    level = np.exp2(-np.arange(VALUE_BITS, dtype=float))[:, None]
    mass = np.exp(-(a + b) * level / 2) - np.exp(-(a + b) * level)
    return (level / 2 / (1 << MANTISSA_BITS) * mass).sum(axis=0) * a * b / (a + b)


def estimate(buckets: int) -> Callable[..., Column]:
    """Jaccard similarity from two sketches, corrected for accidental collisions."""

    @F.pandas_udf(T.DoubleType())
    def jaccard(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        x, y = (np.concatenate(s.to_list()).reshape(-1, buckets) if len(s) else np.zeros((0, buckets)) for s in (a, b))
        p = collision_rate(n_a.to_numpy(float), n_b.to_numpy(float), buckets)
        return pd.Series(((x == y).mean(axis=1) - p) / (1 - p))

    return jaccard


@F.pandas_udf(T.LongType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets of 64-bit hashes."""

    def one(x: np.ndarray, y: np.ndarray) -> int:
        p, q = sorted((x.view(np.uint64), y.view(np.uint64)), key=len)
        at = np.searchsorted(q, p)
        return int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(p) else 0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _sketches(words: int, buckets: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, registers, keys = [], [], [], [], []
            for s in shingle_sets(batch.column(2), words):
                n.append(len(s))
                one.append(int(mix64(s ^ _SEEDS[8]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                two.append(int(mix64(s ^ _SEEDS[9]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                r = sketch(s, buckets) if len(s) else None
                registers.append(None if r is None else r.view(np.int16))
                keys.append([] if r is None else band_keys(r, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(registers, pa.list_(pa.int16())), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "row", "n_shingles", "set_a", "set_b", "sketch", "keys"])

    return run


def _sets(words: int):
    """Whole sets, and of sets of at most ``COUNTED`` shingles how many fall into each of ``CELLS`` cells of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            cells = [np.bincount((s % U(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int16) if len(s) <= COUNTED else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int16()))], ["node", "shingles", "cells"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75,
    buckets: int = 128, rows: int = 4, slack: float = 0.15, leads: int = 2,
) -> DataFrame:
    """Documents linked by shingle sets with ``100 * intersection >= percent * union``.

    One row per input row: ``doc_id, n_shingles, component_id`` (smallest id
    reachable over links) and ``kept`` (it is that smallest id).  Documents with
    equal sets form one class, a node of the graph.  Nodes that share a band of
    ``rows`` of the ``buckets`` registers meet in three passes: each with one
    leader (the member of its bands that shares the largest part of its set with
    others), then with the leader and ``leads + 1`` more nodes of each band that
    are not yet in its component, then, in a band still shared by several
    components, every node outside the band's largest component with all of the
    others; of the bands that such a pair shares, only the first brings it up.

    A pair goes to verification if its sizes, and the numbers of shingles that
    each shares with anyone (an intersection is no larger, and smaller than sets
    of one size that differ), allow the threshold, and if its corrected estimate
    is within ``slack`` of it or above (at the threshold, four deviations); it is
    linked if the full sets say so.  In the last pass, the sums of the smaller of
    two sets' counts by cell of the hash must allow the threshold too.  At
    the threshold two sets share no band with probability (1 - 0.75**4)**32, 5e-6.

    Null and empty texts and texts without words have no shingles: ``n_shingles``
    0, linked with nothing.  Rows without an id are counted with their class but
    never lead it; a class of only such rows is linked with nothing and its
    ``component_id`` is null.  Rows that repeat an id are documents of their own,
    each linked by its own text; rows that repeat id and text get equal results.
    An empty table gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = scratch.keep(docs.mapInArrow(
        _sketches(words, buckets, rows), f"doc_id {id_type}, row long, n_shingles long, set_a long, set_b long, sketch array<smallint>, keys array<long>"))
    same, key_row = ["n_shingles", "set_a", "set_b"], ["doc_id", "row"]
    # one row a class; its number is stored with it, so it stays the same
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(*key_row))).alias("first")
    classes = scratch.keep(table.filter("n_shingles > 0").groupBy(*same).agg(first).withColumn("node", F.monotonically_increasing_id()))
    firsts = classes.filter("first is not null").select("node", "first.*")
    heads = table.join(firsts, key_row).dropDuplicates(key_row)

    keys = scratch.keep(heads.select("node", F.posexplode("keys").alias("band", "key")).drop("band"))
    met = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    bands = scratch.keep(keys.join(met, "key"))
    wanted = firsts.join(bands.select("node").distinct(), "node", "left_semi")
    sets = scratch.keep(docs.join(wanted, key_row).dropDuplicates(key_row).select("node", "text").mapInArrow(
        _sets(words), "node long, shingles array<long>, cells array<smallint>"))
    scratch.drop(keys)
    # of each set, how many shingles any other set has as well
    items = sets.select("node", F.explode("shingles").alias("shingle"))
    common = items.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle")
    shared = items.join(common, "shingle").groupBy("node").agg(F.count("*").alias("shared"))
    sketches = scratch.keep(heads.select("node", "n_shingles", "sketch").join(shared, "node").filter(100 * F.col("shared") >= percent * F.col("n_shingles")))
    bands = bands.join(sketches.select("node", (F.col("shared") / F.col("n_shingles")).alias("part_shared")), "node")
    some = [F.min("node"), *(F.min_by("node", F.xxhash64("node", F.lit(j))) for j in range(leads))]
    central = F.max_by(F.struct("part_shared", "node"), F.struct(F.col("part_shared"), -F.xxhash64("node").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("central")
    chosen = bands.groupBy("key").agg(central, F.array(*some).alias("leads"), F.count("*").alias("n")).filter("n > 1").drop("n")
    bands = scratch.keep(bands.select("node", "key").join(chosen, "key"))
    jaccard = estimate(buckets)

    def possible(n_a: str, n_b: str, shared_a: str, shared_b: str) -> Column:
        least = F.least(F.when(F.col(n_a) == F.col(n_b), F.col(n_a) - 1).otherwise(F.col(n_a)), n_b, shared_a, shared_b)
        return (100 + percent) * least >= percent * (F.col(n_a) + F.col(n_b))

    def confirmed(pairs: DataFrame) -> DataFrame:
        def side(df: DataFrame, x: str, *cols: str) -> DataFrame:
            return df.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))

        for x in ("a", "b"):
            pairs = pairs.join(side(sketches, x, "n_shingles", "shared", "sketch"), x)
        pairs = pairs.filter(possible("n_shingles_a", "n_shingles_b", "shared_a", "shared_b"))
        pairs = pairs.filter(jaccard("sketch_a", "sketch_b", "n_shingles_a", "n_shingles_b") >= percent / 100 - slack)
        pairs = pairs.select("a", "b", "n_shingles_a", "n_shingles_b")
        for x in ("a", "b"):
            pairs = pairs.join(side(sets, x, "shingles"), x)
        pairs = pairs.withColumn("both", overlap("shingles_a", "shingles_b"))
        return pairs.filter(100 * F.col("both") >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - F.col("both"))).select("a", "b")

    def labelled(rows_: DataFrame, parts: DataFrame, x: str, out: str) -> DataFrame:
        part = parts.select(F.col("node").alias(x), F.col("component").alias(out))
        return rows_.join(part, x, "left").withColumn(out, F.coalesce(out, x))

    # each node with one leader
    one = bands.groupBy("node").agg(F.max("central").alias("central")).select(F.col("central.node").alias("a"), F.col("node").alias("b"))
    tried = scratch.keep(one.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = scratch.keep(confirmed(tried))
    parts = components(links, scratch)
    # with several nodes of each of its bands
    led = bands.select("node", F.explode(F.array_distinct(F.concat(F.array("central.node"), "leads"))).alias("lead")).filter("node != lead").distinct()
    far = labelled(labelled(led, parts, "node", "part"), parts, "lead", "lead_part").filter("part != lead_part")
    more = far.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = scratch.keep(links.unionByName(confirmed(more)))
    parts = components(links, scratch)
    # every node outside a band's largest component with all others
    own = labelled(bands.select("node", "key"), parts, "node", "part").join(sketches.select("node", "n_shingles", "shared"), "node")
    cell = own.groupBy("key").agg(F.count_distinct("part").alias("parts"), F.min("n_shingles").alias("least")).filter("parts > 1")
    alive = (100 + percent) * F.col("shared") >= percent * (F.col("n_shingles") + F.col("least"))
    own = scratch.keep(own.join(cell.drop("parts"), "key").filter(alive).drop("least"))
    counted = own.groupBy("key", "part").agg(F.count("*").alias("n"))
    cell = counted.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_ = scratch.keep(own.join(cell, "key"))
    fields = ["node", "part", "n_shingles", "shared", "keys", "sketch", "cells"]
    listed = open_.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    about = listed.join(sketches.select("node", "sketch"), "node").join(sets.select("node", "cells"), "node")
    drawn = open_.join(about, "node")
    few = drawn.filter("part != largest").select("key", "largest", *(F.col(c).alias(f"{c}_a") for c in fields))
    every = drawn.select(F.col("key").alias("key_b"), *(F.col(c).alias(f"{c}_b") for c in fields))
    agree = F.size(F.filter(F.zip_with("sketch_a", "sketch_b", lambda x, y: x == y), lambda same_: same_))
    both = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, n: total + n)  # no intersection is larger
    enough = F.coalesce((100 + percent) * both >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b")), F.lit(True))
    once = F.expr("part_b = largest or part_a < part_b") & (F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == F.col("key"))
    near = possible("n_shingles_a", "n_shingles_b", "shared_a", "shared_b") & once & (agree >= buckets * (percent / 100 - slack)) & enough
    rest = scratch.keep(few.join(every, (F.col("key") == F.col("key_b")) & near).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
    links = scratch.keep(links.unionByName(confirmed(rest)))
    parts = components(links, scratch)
    scratch.drop(own, open_, rest, sets, sketches)

    led = classes.select("node", F.col("first.doc_id").alias("leader"))
    low = parts.join(led, "node").groupBy("component").agg(F.min("leader").alias("low"))
    named = led.join(parts.join(low, "component").select("node", "low"), "node", "left").select("node", F.coalesce("low", "leader").alias("component"))
    out = table.select("doc_id", *same).join(classes.join(named, "node").select(*same, "component"), same, "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
