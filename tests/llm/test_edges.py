"""Empty tables, repeated rows, rows without ids and clashing names, for every operator."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm.queries import QUERIES

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int", "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables_give_empty_results(spark, empty, tables, name):
    query = QUERIES.get(name, corpus_pipeline.run)
    out = query(spark, empty)
    assert out.count() == (1 if name == "op10_chat" else 0)  # the conversation that the query adds
    assert sorted(out.columns) == sorted(query(spark, tables).columns)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Each row twice, some without an id, with columns of names that operators use."""
    root = tmp_path_factory.mktemp("repeated")
    long_ = " ".join(f"w{i % 90}" for i in range(3000))
    texts = ["", None, "token = abcdefgh12345", "one two three four five six", long_, "vile words and nasty ones", "benchmark item of six words here", long_]
    docs = [(i if i != 3 else None, t, "en", "s", 0, 7, "x", 1.0, True) for i, t in enumerate(texts)] * 2
    spark.createDataFrame(docs, SCHEMAS["documents"] + ", n int, spans string, score double, kept boolean").coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "benchmark item of six words here")] * 2, SCHEMAS["benchmark"]).coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i == 5)) for i in range(8)] * 2, SCHEMAS["labels"]).coalesce(1).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, [0.1 * i, 0.5, -0.2 * i * i], 1) for i in range(4)] * 2, SCHEMAS["embeddings"]).coalesce(1).write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")] * 2, SCHEMAS["conversations"]).coalesce(1).write.parquet(f"{root}/conversations.parquet")
    return str(root)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op10_chat", "op13_spelling_variants", "op8_decontaminate")])
def test_equal_rows_get_equal_results_each(spark, repeated, name):
    """Rows that are equal in id and text get rows of their own, alike but for places in sequences and in what stays."""
    key = "vec_id" if name == "op12_whitening" else "doc_id"
    out = QUERIES[name](spark, repeated)
    out = out.drop("sequence_id", "offset")
    counts = collections.Counter(map(str, out.collect()))
    assert out.select(F.col(key)).distinct().count() == (4 if name == "op12_whitening" else 8)
    assert all(n % 2 == 0 for n in counts.values()), [k for k, n in counts.items() if n % 2]


def test_repeated_rows_of_pairs_counts_and_turns(spark, repeated):
    found = QUERIES["op8_decontaminate"](spark, repeated).collect()
    assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in found) == {(6, 1, 0): 4}  # two rows, the item twice
    chat = {r.conv_id: r for r in QUERIES["op10_chat"](spark, repeated).collect()}
    assert chat[1].n_turns == 4 and chat[1].loss_chars == 6
    left = corpus_pipeline.run(spark, repeated)
    assert left.groupBy("doc_id", "start").count().filter("count > 1").isEmpty()
