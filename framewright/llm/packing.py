"""Packing of tokenised examples into sequences under several limits at once."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framewright.llm.parts import PartEncoder, steps
from framewright.llm.tables import Scratch, documents

#: New parts that are encoded as one text.
JOINED = 64


class WordEncoder(PartEncoder):
    """Ids by the tokenizers library, for a tokenizer that drops white space and never joins letters to marks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.reserved = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        first = [(self.tokenizer.id_to_token(i) or " ")[0] for i in range(self.tokenizer.get_vocab_size())]
        #: Ids that bear loss: those of tokens that begin with a letter, not of marks, digits and reserved strings.
        self.bears_loss = np.array([c.isalpha() for c in first])
        self.clear()

    def encode_parts(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Parts are joined by spaces; each token belongs to the part in which it starts."""
        ids, sizes = [], []
        for i in range(0, len(parts), JOINED):
            group = parts[i : i + JOINED]
            encoded = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in group])
            ids += encoded.ids
            sizes += np.bincount(np.searchsorted(ends, np.array([a for a, _ in encoded.offsets], np.int64), "right"), minlength=len(group)).tolist()
        return ids, sizes

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(path: str, limit: int, end: int, max_loss: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for row, stop in steps([len(t) for t in texts]):
                ids, offsets = words.encode(texts[row:stop], end)
                total = np.diff(offsets)
                before = np.concatenate(([0], np.cumsum(words.bears_loss[ids])))
                step = np.full(len(total), limit)
                while True:
                    n = -(-total // step)
                    doc = np.repeat(np.arange(stop - row), n)
                    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step[doc]
                    length = np.minimum(total[doc] - start, step[doc])
                    begin = offsets[doc] + start
                    loss = before[begin + length] - before[begin]
                    if not (loss > max_loss).any():
                        break
                    step[doc[loss > max_loss]] = max_loss  # such documents are cut shorter
                raw = ids.astype("<u4").data
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row + doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[doc], loss))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate((begin, offsets[-1:])).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, limit: int = 4096, end: int = 2, max_loss: int | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each document's ids and then ``end``, cut into pieces of ``limit`` ids and a shorter rest.

    Where a piece would have more than ``max_loss`` loss-bearing ids (those of
    tokens that begin with a letter), the document is cut into pieces of
    ``max_loss`` ids.  Columns: ``doc_id, start,
    length, ids_crc32, doc_tokens, loss_tokens`` and, if wanted, the ``ids``.  ``tokenizer`` is the path of a tokenizer file that drops white space
    and lower-cases; every executor must have it.
    """
    docs = documents(docs, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_cut(tokenizer, limit, end, limit if max_loss is None else max_loss, with_ids), schema)


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each example, one bin after another, by the dot-product heuristic.

    Into the open bin goes the example that fits and has the largest dot product
    of its demand and the bin's free room, both as shares of the limits and
    weighted by how scarce a resource is on average.  Examples of equal demand
    are one class with a count, so a step looks at classes.
    """
    classes, member = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(member, kind="stable")
    left = np.bincount(member, minlength=len(classes))
    taken = np.concatenate(([0], np.cumsum(left)))[:-1]
    share = classes / limits
    weight = (share * left[:, None]).sum(axis=0) / max(left.sum(), 1)
    weighted = share * weight
    out = np.empty(len(demand), np.int64)
    room, number, rest, gone = limits.astype(float), 0, len(demand), 0
    live, first, others = np.arange(len(classes)), classes[:, 0].copy(), [c.copy() for c in classes.T[1:]]
    while rest:
        if gone * 4 > len(live):
            keep = left > 0
            live, left, weighted, first, others, gone = live[keep], left[keep], weighted[keep], first[keep], [c[keep] for c in others], 0
        stop = np.searchsorted(first, room[0], "right")  # classes are sorted by their first demand
        fits = left[:stop] > 0
        for c, free in zip(others, room[1:], strict=True):
            fits &= c[:stop] <= free
        if not fits.any():
            room, number = limits.astype(float), number + 1
            continue
        k = np.argmax(np.where(fits, weighted[:stop] @ (room / limits), -1.0))
        out[order[taken[live[k]]]] = number
        taken[live[k]] += 1
        left[k] -= 1
        gone += left[k] == 0
        rest -= 1
        room = room - classes[live[k]]
    return out


#: Columns that packing adds or uses.
ADDED = ("sequence_id", "offset", "_tokens", "_loss", "_row", "_block")


def pack(examples: DataFrame, tokens: str = "length", loss_tokens: str | None = None, limit: int = 4096, max_segments: int = 128, max_loss: int | None = None, block_rows: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0) to each example.

    A sequence holds at most ``limit`` tokens, ``max_segments`` examples and
    ``max_loss`` loss-bearing tokens (default: ``limit``).  Examples that fill a
    sequence alone do so; the others are dealt evenly into blocks of about
    ``block_rows``, each packed by itself, so a sequence never spans blocks and no
    task holds more.  Null counts are 0.  An example beyond a limit by itself is
    an error.  Repeated rows are packed each; an empty table gives an empty result.
    Columns of the names that are added, and ``_tokens, _loss, _row, _block``, are replaced.
    """
    max_loss = limit if max_loss is None else max_loss
    limits = np.array([limit, 1 * max_segments, max_loss], np.int64)
    one = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    loss = one if loss_tokens is None else F.coalesce(F.col(loss_tokens), F.lit(0)).cast("long")
    fields = [c for c in examples.columns if c not in ADDED]
    table = Scratch(examples.sparkSession).keep(examples.select(*fields, one.alias("_tokens"), loss.alias("_loss"), F.monotonically_increasing_id().alias("_row")))
    most = table.agg(F.max("_tokens").alias("t"), F.max("_loss").alias("l"), F.count_if(F.col("_tokens") < limit).alias("n")).first()
    if (most["t"] or 0) > limit or (most["l"] or 0) > max_loss:
        raise ValueError(f"an example has {most['t']} tokens and one {most['l']} loss-bearing tokens; the limits are {limit} and {max_loss}")
    blocks = max(1, -(-most["n"] // block_rows))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        demand = np.column_stack((group["_tokens"].to_numpy(), np.ones(group.num_rows, np.int64), group["_loss"].to_numpy()))
        bins = fill(demand, limits)
        order = np.lexsort((np.arange(len(bins)), bins))
        before = np.cumsum(demand[order, 0]) - demand[order, 0]
        first = np.searchsorted(bins[order], bins[order], "left")
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - before[first]
        number = (group["_block"][0].as_py() << 32 | bins) << 1
        return group.select(fields).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = StructType([*(f for f in examples.schema.fields if f.name in fields), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    full = table.filter(F.col("_tokens") == limit).select(*fields, (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.filter(F.col("_tokens") < limit).withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    return full.unionByName(rest.groupBy("_block").applyInArrow(place, schema))


def pack_documents(
    docs: DataFrame, tokenizer: str, limit: int = 4096, end: int = 2, max_loss: int | None = None, max_segments: int = 128, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Documents cut into token pieces and packed, with at most ``max_loss`` loss-bearing tokens (default: ``limit``) and ``max_segments`` pieces in a sequence.

    One row per piece: the columns of ``token_pieces`` with ``sequence_id`` and
    ``offset``.  A null or empty text has the one id ``end``; a text is encoded
    whole, however long.  Every token of a document may bear loss, so the default
    never cuts one short; for instruction data, set what the loss may cover.
    Repeated rows are packed each, and an empty table gives an empty result.
    """
    max_loss = limit if max_loss is None else max_loss
    return pack(token_pieces(docs, tokenizer, limit, end, max_loss, with_ids, id_col, text_col), loss_tokens="loss_tokens", limit=limit, max_segments=max_segments, max_loss=max_loss)
