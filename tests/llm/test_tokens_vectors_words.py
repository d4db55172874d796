"""Byte-pair encoding against the tokenizers library, whitening against numpy, spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe
from framewright.llm.packing import encoder as word_encoder
from framewright.llm.queries import QUERIES
from framewright.llm.tables import Scratch
from framewright.llm.trie import near_pairs
from framewright.llm.variants import count_words, group_variants, near_words
from framewright.llm.whitening import whiten

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# --- byte-pair encoding


def odd_texts():
    rng = random.Random(1)
    signs = [*"abJHTWYI'sdmvelr-.,1 \t\n\x1c\x85\xa0éßΣσςİ̱̇̌̈<|>漢한가", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "퟿", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)]
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"Ja{c}b {c}" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    return [*texts, "", " ", "a" * 20_000, "ab" * 5000, "J̌ İ İx", "<|endoftext|>", "<|endoftext|>é<|startoftext|>́"]


def test_ids_are_those_of_the_library(library):
    texts = odd_texts()
    for own, end in ((bpe.encoder(PATH), None), (word_encoder(PATH), 2)):
        ids, offsets = own.encode(texts, end)
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids + [2] * (end is not None), text[:60]


def test_merges_go_by_rank_then_place():
    merges = {(0, 1): (1, 5), (1, 0): (0, 6), (6, 6): (2, 7), (0, 0): (3, 8)}
    assert bpe.merge([0, 1, 0, 1, 0], merges) == [0, 7]  # "10" twice, then both; the entries for "01" are stale
    assert bpe.merge([0, 0, 0], merges) == [8, 0]
    assert bpe.merge([], merges) == [] and bpe.merge([3], merges) == [3]

    def slowly(symbols):
        while found := [(merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]:
            _, i = min(found)
            symbols = [*symbols[:i], merges[symbols[i], symbols[i + 1]][1], *symbols[i + 2 :]]
        return symbols

    rng = random.Random(2)
    for _ in range(500):
        symbols = [rng.randrange(2) for _ in range(rng.randrange(30))]
        assert bpe.merge(symbols, merges) == slowly(symbols)


def test_worker_cache_starts_over(library, monkeypatch):
    from framewright.llm import parts

    monkeypatch.setattr(parts, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "WORDS", 20)
    own = bpe.BpeEncoder(PATH)
    for k in range(5):
        texts = [f"alpha{i} beta-{i * k} gamma" for i in range(40)]
        ids, offsets = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_query_on_whole_documents(spark, tables, library):
    for root in (SF, tables):
        rows = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
        want = []
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            said = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
        got = QUERIES["op11_bpe"](spark, root)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_decode_of_odd_lists_and_clashing_names(spark, library):
    rows = spark.createDataFrame([(1, [320, None, 99_999, -1, 49407, 0], "x"), (None, None, "y"), (1, [], "z")], "doc_id long, ids array<int>, decoded string").coalesce(1)
    got = {r.doc_id if r.ids else (r.doc_id, r.ids is None): r.decoded for r in bpe.decode(rows, PATH).collect()}
    assert got == {1: library.decode([320, 49407, 0], skip_special_tokens=False), (None, True): "", (1, False): ""}
    docs = spark.createDataFrame([(None, "Ab ab", 1), (None, "Ab ab", 2), ("k", None, 3)], "doc_id string, text string, ids int")
    encoded = bpe.encode(docs, PATH)
    ids = library.encode("ab ab", add_special_tokens=False).ids
    assert encoded.columns == ["doc_id", "ids"] and sorted(map(tuple, encoded.collect()), key=str) == sorted([(None, ids), (None, ids), ("k", [])], key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).collect() == []


# --- whitening


def plain_whitening(vectors, k):
    x = np.floor(256 * np.array(vectors, float))
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    value, direction = np.linalg.eigh(np.cov(fit.T, bias=True))
    value, direction = value[::-1], direction[:, ::-1]
    return n, [sum(int(n * a - s) ** 2 for a, s in zip(row, total)) for row in x], (x - total / n) @ direction[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()


def same_up_to_sign(got, want):
    return np.allclose(got, want, atol=1e-8) or np.allclose(got, -want, atol=1e-8)


def test_whitening_query_against_numpy(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    n, deviation, white, explained = plain_whitening(source.embedding.tolist(), 4)
    got = QUERIES["op12_whitening"](spark, SF).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert (got.n == n).all() and (got.identity_error < 1e-10).all() and got.identity_error.nunique() == 1
    for k in range(4):
        part = got[got.component == k + 1].set_index("vec_id").loc[source.vec_id]
        assert part.deviation.tolist() == deviation
        assert same_up_to_sign(part.whitened.to_numpy(), white[:, k]) and np.allclose(part.explained, explained[k], rtol=1e-9)


def test_whitening_of_awkward_rows(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet")
    kept = [(0, [0.25, -0.5, 0.125]), (1, [0.25, -0.5, 0.125]), (2, [0.5, 0.25, 1.0]), (2, [1.0, 0.75, -0.25]), (None, [-1.0, 0.0, 0.5]), (8, [0.0] * 3), (9, [0.5, 0.0, 0.0])]
    n, deviation, white, explained = plain_whitening([v for _, v in kept], 3)
    got = whiten(rows).collect()
    assert n == 6 and {r.n for r in got} == {6} and max(r.identity_error for r in got) < 1e-10
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k) for i, _ in kept for k in (1, 2, 3))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip([i for i, _ in kept], deviation))
    for k in range(3):
        mine = {r.deviation: r.whitened for r in got if r.component == k + 1}
        assert same_up_to_sign(np.array([mine[d] for d in deviation]), white[:, k])


def test_whitening_without_variance_and_far_numbers(spark):
    kind = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], kind)).collect()
    assert {r.component for r in line} == {1} and math.isclose(line[0].explained, 1.0)
    far = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame([(1, [3e13]), (2, [0.0]), (3, [1.0])], kind)).collect()}
    assert far[1] is None and far[2] is None  # about 1e32


# --- spelling variants


def plain_near(words):
    near, gaps = {w: set() for w in words}, {}
    for w in words:
        for k in range(len(w)):
            gaps.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
            if (x := w[:k] + w[k + 1 :]) in near:
                near[w].add(x)
                near[x].add(w)
    for group in gaps.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def plain_variants(rows, ratio=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    return plain_groups(n, ratio)


def plain_groups(n, ratio):
    near, form, out = plain_near(n), {}, []
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def test_active_nodes_against_brute_force():
    rng = random.Random(3)
    for trial in range(300):
        letters = ("ab", "abcdé", "abcdefghijkl漢😀")[trial % 3]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(trial % 2, 9))) for _ in range(rng.randrange(120))})
        near = plain_near(words)
        assert {tuple(p) for p in near_pairs(words).tolist()} == {(i, j) for i, w in enumerate(words) for j, x in enumerate(words) if i < j and x in near[w]}
    long = sorted(["a" * 2000, "a" * 2001, "a" * 1000 + "b" + "a" * 999, "b" * 500, "b" * 502])
    assert len(near_pairs(long)) == 2


def test_variants_query_against_brute_force(spark, tables):
    for root in (SF, tables):
        rows = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
        got = QUERIES["op13_spelling_variants"](spark, root)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_variants(rows)


def test_subtries_of_any_size_give_the_same_pairs(spark):
    rng = random.Random(4)
    words = {"aaaaaaaab" * k for k in (1, 2)} | {"a" * k for k in range(1, 30)} | {"prefix" * 3 + "".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(400)}
    table = spark.createDataFrame([(w, rng.randrange(1, 2000)) for w in sorted(words)], "word string, n long")
    near = plain_near(words)
    want = sorted((w, x) for w in words for x in near[w] if w < x)
    for limit in (1, 7, 100, 10_000):
        assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in near_words(table, Scratch(spark), limit).collect()) == want
    n = {r.word: r.n for r in table.collect()}
    assert sorted(map(tuple, group_variants(table, ratio=3, limit=50).collect()), key=str) == plain_groups(n, 3)


def test_variants_ties_chains_and_empty(spark):
    rows = [("colours", 1), ("colour", 30), ("colouxs", 30), ("colou", 3000), ("kolou", 400_000), ("", 5), (None, 9), ("x", None)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n_near) for r in group_variants(table).collect()}
    assert got == {"colours": ("colour", "kolou", 2), "colour": ("colou", "kolou", 2), "colouxs": (None, "colouxs", 1), "colou": ("kolou", "kolou", 2), "kolou": (None, "kolou", 1), "": (None, "", 0)}
    assert group_variants(table.limit(0)).collect() == []
    assert count_words(spark.createDataFrame([], "doc_id long, text string"), damaged_every=31).collect() == []
    long = "verylongword" * 3000
    docs = spark.createDataFrame([(None, f"{long} {long.upper()} short Ünïcode ünïcode"), ("b", None)], "doc_id string, text string").withColumn("n", F.lit(1))
    assert {(r.word, r.n) for r in count_words(docs).collect()} == {(long, 2)}
