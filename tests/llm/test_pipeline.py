import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of every kind that a stage must catch, and what a plain version keeps after each stage."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, " ".join(f"item{i}x{k}" for k in range(20))) for i in range(5)]
    docs, labels, toxic = [], [], set()
    for i in range(260):
        body = text(rng.randrange(60, 120))
        if i % 4 == 1 and i < 200:
            w = body.split()
            w[5], w[15], w[25], w[35] = "vile", "nasty", "rotten", "vile"
            body = " ".join(w)
            toxic.add(i)
        docs.append((i, body))
        labels.append((i, 1, int(i in toxic)))
    clean = [d for d in docs if d[0] not in toxic]
    for k in range(12):
        docs.append((1000 + k, clean[k][1].replace(" ", "  \n", 3)))  # equal texts
        w = clean[20 + k][1].split()
        w[5] = f"edit{k}"
        docs.append((2000 + k, " ".join(w)))  # near copies
        docs.append((3000 + k, f"{text(30)} {items[k % 5][1]} {text(30)}"))  # benchmark items
    docs += [(4000, None), (4001, ""), (4002, " "), (None, "a row without an id")]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, toxic, items


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs, toxic, items):
    """The ids left after each filtering stage, by brute force."""
    left = [d for d in docs if d[0] not in toxic]
    yield {d[0] for d in left}
    first = {}
    for i, t in sorted((d for d in left if d[0] is not None), key=lambda d: d[0]):
        key = (t or "") if not (t or "").strip() else None
        first.setdefault(" " if key and key.isspace() else " ".join((t or "").split()), i)
    left = [d for d in left if d[0] is None or d[0] in first.values()]
    yield {d[0] for d in left}
    sets = {d[0]: shingles(d[1]) for d in left if d[0] is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    left = [d for d in left if d[0] is None or root(d[0]) == d[0]]
    yield {d[0] for d in left}
    left = [d for d in left if d[0] is None or not any(t in (d[1] or "") for _, t in items)]
    yield {d[0] for d in left}


def test_stages_against_a_plain_version(spark, corpus, tmp_path):
    root, docs, toxic, items = corpus
    table = spark.read.parquet(f"{root}/documents.parquet")
    for k, ((_, stage), want) in enumerate(zip(corpus_pipeline.STAGES, plain(docs, toxic, items), strict=False)):
        out = stage(spark, table, root)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r.doc_id for r in table.select("doc_id").collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, table, root)
    pieces = packed.select("doc_id", "doc_tokens", "length").collect()
    assert {r.doc_id for r in pieces} == want
    assert {(r.doc_id, r.doc_tokens, r.length) for r in corpus_pipeline.run(spark, root).collect()} == {tuple(r) for r in pieces}


def test_rows_without_an_id_and_repeated_ids_are_judged_each(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "one text"), (7, "one text"), (7, "other text"), (None, "other text"), (None, "alone"), (9, "other  text"), (1, long_), (None, long_ + " x"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    left = corpus_pipeline.drop_copies(spark, docs, "")
    key = lambda d: {(r.doc_id, r.text) for r in d.collect()}
    assert left.count() == 6
    assert key(left) == {(7, "one text"), (7, "other text"), (None, "alone"), (1, long_), (None, long_ + " x"), (2, None)}
    assert key(corpus_pipeline.drop_near_copies(spark, left, "")) == key(left) - {(None, long_ + " x")}
