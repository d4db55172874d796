"""Removal of passages seen before, by a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.tables import Scratch, documents
from framewright.llm.text import Words, grams, split_words

#: Words in the runs from which a window's fingerprint is chosen.
GRAM = 10


def window_fingerprints(w: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """By first word, each window's smallest gram hash, and whether the window lies within one row.

    Equal windows have equal fingerprints, and neighbours mostly share one, so an
    index of them has about ``2 / (window - gram)`` rows a word.
    """
    g, _ = grams(h, w.offsets, gram)
    span, width, low = window - gram + 1, 1, g
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    extra = span - width
    if extra:
        low = np.minimum(low[: len(low) - extra], low[extra:]) if len(low) > extra else low[:0]
    out = np.zeros(len(h), np.uint64)
    out[: len(low)] = low
    left = np.repeat(w.offsets[1:], w.counts()) - np.arange(len(h))
    return out, left >= window


def _scan(window: int, gram: int):
    """Number of words, digest of all words and distinct window fingerprints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, prints, texts = [], [], [], batch.column(2)
            for w in split_words(texts):
                f, inside = window_fingerprints(w, w.hashes(), window, gram)
                for i, count in enumerate(w.counts().tolist()):
                    s = slice(w.offsets[i], w.offsets[i] + count)
                    n.append(count)
                    digest.append(hashlib.sha256(b" ".join(_words(texts[w.first_row + i]))).digest() if count >= window else None)
                    prints.append(np.unique(f[s][inside[s]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prints, pa.list_(pa.int64()))],
                ["doc_id", "row", "n_words", "digest", "prints"])

    return run


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().split() if text.is_valid else []


def window_digests(words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """The first 16 bytes, as two numbers, of the SHA-256 of the words of each window that begins at one of the places."""
    text = b" ".join(words)
    start = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    spans = zip(start[at].tolist(), (start[at + window] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.sha256(text[a:b]).digest()[:16] for a, b in spans]), "<i8").reshape(-1, 2)


def _windows(window: int, gram: int):
    """The windows whose fingerprint several documents have: digests of their words and the first words of all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(2), batch.column(3)
            starts, one, two = [], [], []
            for w in split_words(texts):
                f, inside = window_fingerprints(w, w.hashes(), window, gram)
                for i in range(w.n_rows):
                    s = slice(w.offsets[i], w.offsets[i + 1])
                    hit = np.flatnonzero(inside[s] & np.isin(f[s].view(np.int64), wanted[w.first_row + i].values.to_numpy()))
                    a, b = window_digests(_words(texts[w.first_row + i]), hit, window).T
                    order = np.lexsort((b, a))
                    new = np.flatnonzero(np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))) if len(hit) else hit
                    starts.append(np.split(hit[order], new[1:]) if len(hit) else [])
                    one.append(a[order][new])
                    two.append(b[order][new])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, pa.list_(longs)), pa.array(one, longs), pa.array(two, longs)], ["doc_id", "row", "starts", "a", "b"])

    return run


def _strip(window: int):
    """What is left of each text, as its kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, texts = [], [], [], []
            for text, copy, starts in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                if copy.as_py() and len(words) >= window:
                    kept = []
                elif starts.is_valid:
                    at = starts.values.to_numpy()
                    change = np.zeros(len(words) + window + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    kept = list(compress(words, (np.cumsum(change)[: len(words)] == 0).tolist()))
                else:
                    kept = words
                gone.append(len(words) - len(kept))
                texts.append(b" ".join(kept))
                digest.append(hashlib.sha256(texts[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, merged as they grow.

    A run is a table ``print, first, docs``: one row per fingerprint with its
    smallest document and its number of documents, sorted by fingerprint within
    partitions dealt by it.  A level holds less than ``fan_in`` runs; its runs
    are compacted into one of the next level when it is full, so that a table
    fed in many batches has logarithmically many runs.
    """

    def __init__(self, scratch: Scratch, fan_in: int = 2):
        self.scratch, self.fan_in = scratch, fan_in
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        return self.scratch.keep(rows.repartition("print").sortWithinPartitions("print"))

    def probe(self, batch: DataFrame) -> DataFrame:
        """Fingerprints of ``batch (print, doc_id)`` that another document has, in it or before it."""
        own = batch.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))
        found = own.filter("docs > 1").select("print")
        for run in (r for level in self.levels for r in level):
            found = found.unionByName(run.join(own.select("print").hint("merge"), "print").select("print"))
        return found.distinct()

    def add(self, batch: DataFrame) -> None:
        run = self._write(batch.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")))
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            full, self.levels[level] = self.levels[level], []
            rows = full[0]
            for r in full[1:]:
                rows = rows.unionByName(r)
            run = self._write(rows.groupBy("print").agg(F.min("first").alias("first"), F.sum("docs").alias("docs")))
            self.scratch.drop(*full)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = 3, fan_in: int = 2, gram: int = GRAM,
) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that a document with a smaller id also has.

    One row per input row: ``doc_id, n_words, n_removed, kept_text`` (kept words
    joined by one space) and ``kept_sha256``.  Windows are judged on the input,
    not on what is left.  Documents enter the index in ``batches``, dealt by a hash
    of the id, which may be of any ordered type.  A fingerprint that several documents have leads to the exact step:
    windows are compared by 128 bits of the SHA-256 of all their words.
    Of texts with equal words (by SHA-256) only the smallest id is indexed; the
    others lose every word if they have a window at all.

    Null and empty texts have no words and keep none.  Rows without an id keep
    all words, and their windows count for nobody.  Rows that repeat an id are
    documents of their own, each judged by its own text, and take nothing from
    each other; rows that repeat id and text get equal results.  An empty table
    gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), "text")
    id_type, key, same = docs.schema["doc_id"].dataType.simpleString(), ["doc_id", "row"], ["n_words", "digest"]
    table = scratch.keep(docs.mapInArrow(_scan(window, gram), f"doc_id {id_type}, row long, n_words long, digest binary, prints array<long>"))
    long_ = table.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = long_.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    copies = scratch.keep(long_.select(*key, *same).join(firsts.filter("rows > 1"), same).filter("doc_id != first").select(*key).distinct())

    number = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    prints = long_.join(copies, key, "left_anti").select(*key, F.explode("prints").alias("print"))
    prints = scratch.keep(prints.withColumn("batch", number))
    index, shared = FingerprintIndex(scratch, fan_in), None
    for k in range(batches):
        batch = prints.filter(F.col("batch") == k).select("print", "doc_id")
        hits = scratch.keep(index.probe(batch))
        shared = hits if shared is None else shared.unionByName(hits)
        index.add(batch)
    wanted = prints.join(shared.distinct(), "print").groupBy(*key).agg(F.collect_set("print").alias("prints"))

    longs = "array<long>"
    found = docs.join(wanted, key).select(*key, "text", "prints").mapInArrow(_windows(window, gram), f"doc_id {id_type}, row long, starts array<{longs}>, a {longs}, b {longs}")
    windows = scratch.keep(found.select(*key, F.explode(F.arrays_zip("starts", "a", "b")).alias("w")).select(*key, "w.*"))
    first = windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"))
    seen = windows.join(first, ["a", "b"]).filter("first < doc_id").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    judged = docs.join(seen, key, "left").join(copies.withColumn("copy", F.lit(True)), key, "left")
    return judged.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts").mapInArrow(
        _strip(window), f"doc_id {id_type}, n_words long, n_removed long, kept_text string, kept_sha256 string")
