import random

import pytest
from pyspark.sql import functions as F

from framewright.llm.components import components
from framewright.llm.exact_dedup import exact_duplicates
from framewright.llm.near_dedup import near_duplicates
from framewright.llm.queries import ORACLES, QUERIES
from framewright.llm.substring_dedup import remove_repeats
from framewright.llm.tables import Scratch

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op5_near_dedup", "op7_exact_dedup", "op10_chat"])
def test_awkward_rows_match_sql(spark, tables, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, tables), ORACLES[name], tables)


@pytest.mark.parametrize("operator", [exact_duplicates, near_duplicates, remove_repeats])
def test_empty_null_and_repeated_rows(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).collect() == []
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (5, text), (5, text), (7, text), (None, None)]
    out = operator(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 5), (False, 5), (False, 7), (True, 0), (True, 0)]


def test_tree_merge_with_many_runs(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("text")).repartition(40)
    for bits in (1, 2, 4):
        out = exact_duplicates(docs, bits=bits)
        want = docs.groupBy("text").agg(F.min("doc_id").alias("k"), F.count("*").alias("n"))
        wrong = docs.join(out, "doc_id").join(want, "text").filter("k != keep_id or n != group_size or kept != (doc_id = k)")
        assert out.count() == 4000 and wrong.count() == 0


def test_near_copies_around_the_threshold(spark, tmp_path, same_as_sql, tables):
    """A large group of edited copies, whose pairs lie on both sides of the threshold, and unrelated texts with one passage."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 6))):
            words[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([f"q{i}_{k}" for k in range(60)] + base[:40])) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("conversations", "benchmark", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    same_as_sql(near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet")), ORACLES["op5_near_dedup"], tmp_path)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in components(links, Scratch(spark)).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {90: 90, 95: 90, 100: 90}


def test_repeats_in_many_batches(spark, tables, same_as_sql):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for batches in (1, 5):
        same_as_sql(remove_repeats(docs, batches=batches).drop("kept_text"), ORACLES["op4_substring_dedup"], tables)


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    out = {(r.doc_id, r.kept_text): r.n_removed for r in remove_repeats(spark.createDataFrame([(1, a), (5, a), (5, c)], DOCS)).collect()}
    assert out == {(1, a): 0, (5, ""): 60, (5, c): 0}
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " x"), (7, c)]
    out = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert out == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (7, 7, True)]


def test_windows_of_words_made_to_collide(spark):
    """Two words of complementary letters, which polynomial hashes modulo a power of two cannot tell apart."""
    sign = ["ab"[i.bit_count() & 1] for i in range(2048)]
    one, two = "".join(sign), "".join("ab"[x == "a"] for x in sign)
    same = " ".join(f"w{i}" for i in range(49))
    out = remove_repeats(spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {two}")], DOCS)).collect()
    assert [r.n_removed for r in out] == [0, 0]


def test_ids_of_any_type(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([("x", a), ("y", a + " z"), ("w", "other")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {"x": 0, "y": 60, "w": 0}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {"x": "x", "y": "x", "w": "w"}
    assert {r.doc_id: r.keep_id for r in exact_duplicates(docs).collect()} == {"x": "x", "y": "y", "w": "w"}


def test_links_found_among_many_edited_copies(spark):
    """Recall of links against all pairs, over groups of copies with random edits on both sides of the threshold."""
    rng = random.Random(8)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(rng.randrange(30, 200))]
        for k in range(8):
            words = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
            rows.append((g * 10 + k, " ".join(words)))
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {(i, j) for i in sets for j in sets if i < j and i // 10 == j // 10 and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    part = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(want) > 200 and sum(part[i] == part[j] for i, j in want) >= 0.99 * len(want)
