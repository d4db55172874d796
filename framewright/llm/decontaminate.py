"""Benchmark items inside documents, within a budget of word edits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framewright.llm.tables import documents
from framewright.llm.text import MARKS, grams, split_words

#: Bits of the first lookup of a word position.
TABLE_BITS = 20


def budget(n_words: int, rate: float, least: int) -> int:
    """Edits allowed in an item; pieces keep ``least`` words at least."""
    return max(0, min(int(rate * n_words), n_words // least - 1))


def pieces(n_words: int, edits: int) -> list[tuple[int, int]]:
    """``edits + 1`` spans that cover the item: with at most ``edits`` edits, one of them is untouched."""
    cuts = [n_words * i // (edits + 1) for i in range(edits + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first such stretch ends.

    Bit-parallel: bit i of the vertical vectors tells whether the distance rises or
    falls from item prefix i to i + 1; integers are as long as the item.
    """
    m = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | ~(diagonal | up) & mask
        fall = up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & mask, fall << 1 & mask
        up = (fall | (~(diagonal | rise) & mask)) & mask
        down = rise & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """A block of items: their words, budgets, and their pieces by the hash of the first words.

    A piece is looked up by its first ``least`` words.  An item of fewer words is
    one piece, looked up by all of them: it has no budget and must be met exactly.
    """

    def __init__(self, ids: list, texts: list[str], rate: float, least: int, kind: pa.DataType):
        self.ids, self.words, self.edits, self.kind = [], [], [], kind
        self.by_size: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for w in split_words(pa.array(texts, pa.string()), MARKS):
            h = w.hashes()
            of_size = {size: grams(h, w.offsets, size)[0] for size in range(1, least + 1)}
            for i, n in enumerate(w.counts().tolist()):
                if not n:
                    continue
                at, e, size = int(w.offsets[i]), budget(n, rate, least), min(n, least)
                for start, _end in pieces(n, e):
                    self.by_size[size][int(of_size[size][at + start])].append((len(self.ids), start))
                self.ids.append(ids[w.first_row + i])
                self.words.append(h[at : at + n].tolist())
                self.edits.append(e)
        self.by_size = {size: dict(of) for size, of in self.by_size.items()}
        self.tables = {}
        for size, of in self.by_size.items():
            self.tables[size] = np.zeros(1 << TABLE_BITS, bool)
            self.tables[size][(np.array(list(of), np.uint64) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """Row, item, distance, first word and word after the last of each row's best match with an item."""
        for w in split_words(texts, MARKS):
            h = w.hashes()
            tried: set[tuple[int, int, int]] = set()
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for size, by_hash in self.by_size.items():
                g, inside = grams(h, w.offsets, size)
                at = np.flatnonzero(self.tables[size][(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] & inside)
                row_of = np.searchsorted(w.offsets, at, "right") - 1
                for p, r in zip(at.tolist(), row_of.tolist(), strict=True):
                    first, last = int(w.offsets[r]), int(w.offsets[r + 1])
                    for k, piece in by_hash.get(int(g[p]), ()):
                        if (key := (r, k, p - piece)) in tried:
                            continue
                        tried.add(key)
                        item, e = self.words[k], self.edits[k]
                        a, b = max(first, p - piece - e), min(last, p - piece + len(item) + e)
                        d, stop = myers(item, h[a:b].tolist())
                        if d <= e and (d, a) < best.get((r, k), (e + 1, 0, 0))[:2]:
                            best[r, k] = d, a, a + stop
            for (r, k), (d, a, stop) in best.items():
                yield w.first_row + r, k, d, a - int(w.offsets[r]), stop - int(w.offsets[r])

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(self.matches(batch.column(1)))
            row, item, *rest = map(list, zip(*found, strict=True)) if found else ([], [], [], [], [])
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array([self.ids[k] for k in item], self.kind), *(pa.array(x, pa.int64()) for x in rest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "region_start", "match_end"])

    def keep(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in self.matches(batch.column(1))]] = False
            yield batch.filter(pa.array(clean))


def _blocks(items: DataFrame, item_id: str, item_text: str, rate: float, least: int, block_bytes: int) -> Iterator[Items]:
    """Items in blocks of about ``block_bytes``; one block at least."""
    rows = items.select(items[item_id].alias("id"), F.lower(F.coalesce(items[item_text].cast("string"), F.lit(""))).alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)
    ids, texts, size, some = [], [], 0, False
    for row in rows.toLocalIterator():
        if size >= block_bytes:
            yield Items(ids, texts, rate, least, kind)
            ids, texts, size, some = [], [], 0, True
        ids.append(row.id)
        texts.append(row.text)
        size += len(row.text)
    if ids or not some:
        yield Items(ids, texts, rate, least, kind)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = 0.1, least: int = 5, block_bytes: int = 4 << 20,
) -> DataFrame:
    """Documents that hold a benchmark item with at most ``rate`` of its words edited.

    One row per document and item: ``doc_id, item_id, distance`` (words inserted,
    deleted or replaced), ``region_start`` and ``match_end`` (word numbers that
    bound the best match).  Words are lower-cased runs of letters and digits;
    ASCII punctuation separates them.  Items of fewer than twice ``least`` words
    have no budget: they must occur as they are.

    Items are read in blocks of ``block_bytes``, and each block, whose size is so
    bounded, meets all documents in one pass; documents are never shuffled.
    Ids of documents and items are of any type.  Null and empty texts, items
    without a word and empty tables match nothing; null item ids give null.  Rows
    that repeat an id each give their rows; a text is read whole, however long.
    Other columns are ignored.
    """
    id_type, kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    docs = documents(docs, id_col, text_col).select("doc_id", F.lower("text").alias("text"))
    schema = f"doc_id {id_type}, item_id {kind}, distance long, region_start long, match_end long"
    return reduce(DataFrame.unionByName, (docs.mapInArrow(block.find, schema) for block in _blocks(items, item_id, item_text, rate, least, block_bytes)))


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.1, least: int = 5, block_bytes: int = 4 << 20,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which ``contaminated`` finds nothing.

    Rows are judged where they are read, by one block of items after another, in
    one pass over the documents and without a shuffle.
    """
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("text"))
    for block in _blocks(items, item_id, item_text, rate, least, block_bytes):
        row = row.mapInArrow(block.keep, row.schema)
    return row.select("row.*")
