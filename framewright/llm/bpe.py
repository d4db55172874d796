"""Byte-pair encoding by a queue of merge ranks, and decoding by vocabulary strings."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from framewright.llm.parts import PartEncoder, steps
from framewright.llm.tables import documents

#: Words that a Python worker remembers the ids of beside whole parts.
WORDS = 50_000


def merge(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols left when no pair of neighbours can be merged: the lowest rank goes first, of equal ranks the leftmost.

    The symbols form a doubly linked list.  The queue holds (rank, place of the
    left symbol); an entry whose pair is no longer there, or another by now, is
    stale and skipped.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = symbols.copy()
    before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
    queue = [(merges[pair][0], i) for i, pair in enumerate(itertools.pairwise(symbols)) if pair in merges]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = after[i]
        if j == n or symbols[i] < 0:
            continue
        found = merges.get((symbols[i], symbols[j]))
        if found is None or found[0] != rank:
            continue
        symbols[i], symbols[j] = found[1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (found := merges.get((symbols[a], symbols[b]))):
                heapq.heappush(queue, (found[0], a))
    return [s for s in symbols if s >= 0]


class BpeEncoder(PartEncoder):
    """Ids of a tokenizer file with a plain byte-pair model.

    Composing, lower-casing and splitting into words are the file's own
    components, run by the library (its tables of letters are a Unicode version
    of their own); the merges are done here.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        if odd := {k: model.get(k) for k, v in plain.items() if model.get(k) != v}:
            raise ValueError(f"not a plain byte-pair model: {odd}")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocabulary, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(self.vocabulary[a], self.vocabulary[b]): (rank, self.vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.reserved = sorted(self.added, key=len, reverse=True)
        self.between = re.compile("(" + "|".join(map(re.escape, self.reserved)) + ")")
        self.words: dict[str, list[int]] = {}
        self.clear()

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word, given in the letters that stand for bytes; symbols that the vocabulary lacks are left out."""
        ids = self.words.get(word)
        if ids is None:
            symbols = (self.vocabulary.get(s) for s in (*word[:-1], word[-1] + self.suffix))
            ids = merge([s for s in symbols if s is not None], self.merges)
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode_text(self, text: str) -> list[int]:
        return [i for word, _ in self.split(self.normalize(text)) for i in self.encode_word(word)]

    def encode_parts(self, parts: list[str]) -> tuple[list[int], list[int]]:
        each = [self.encode_text(p) for p in parts]
        return list(itertools.chain.from_iterable(each)), [len(x) for x in each]

    def encode_whole(self, text: str) -> list[int]:
        return [i for k, part in enumerate(self.between.split(text)) for i in ([self.added[part]] if k % 2 else self.encode_text(part))]


@functools.cache
def encoder(path: str) -> BpeEncoder:
    return BpeEncoder(path)


@functools.cache
def strings(path: str) -> pa.Array:
    """Vocabulary strings by id."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    names = {i: s for s, i in whole["model"]["vocab"].items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the ``ids`` of each whole text, without special tokens added.

    ``tokenizer`` is the path of a tokenizer file (byte-pair merges over words;
    white space dropped, letters never joined to marks) that every executor has.
    Strings of reserved tokens in a text are those tokens.  A null or empty text,
    or one of white space only, has no ids; ids of rows are kept as they are,
    null or repeated, and each row is encoded by itself.  A text is encoded from
    its first word to its last, however long; an empty table gives an empty one.
    """
    docs = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for row, stop in steps(sizes):
                part = batch.slice(row, stop - row)
                ids, offsets = own.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded``: the vocabulary strings of the ``ids``, one space between, as the library does for a file without a decoder.

    Ids that the vocabulary lacks, and null ones, are left out; a null list is
    empty.  Other columns stay, but one named ``decoded`` is replaced.
    """
    encoded = encoded.drop("decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = strings(tokenizer)
        exists = names.is_valid().to_numpy(zero_copy_only=False)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for row, stop in steps(sizes):
                part = batch.slice(row, stop - row)
                number = pc.fill_null(part.column(at).flatten(), -1).to_numpy(zero_copy_only=False)
                known = (number >= 0) & (number < len(names))
                known[known] = exists[number[known]]
                offsets = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], np.cumsum(sizes[row:stop])))]
                said = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(number[known])))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(said, " ")], schema.names)

    return encoded.mapInArrow(run, schema)
