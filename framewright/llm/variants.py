"""Spelling variants: words of a corpus at edit distance one, and the form that each goes back to."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.tables import Scratch, documents
from framewright.llm.text import LOWER, Words, latin_letters, split_words
from framewright.llm.trie import near_pairs

#: Distinct words, and their bytes, that a task counts before it hands the counts on.
HELD_WORDS, HELD_BYTES = 400_000, 32 << 20
#: Bytes of a word up to which its document's checksum is carried on for all words at once.
SHORT = 64
ONES = np.uint32(0xFFFFFFFF)
#: Checksum steps by byte: the register after eight zero bits.
STEPS = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def _own(word: bytes) -> int:
    """What a word adds to a checksum register, which is linear: register after (a, word) = register of a after as many zeros, xor this."""
    return zlib.crc32(word, 0xFFFFFFFF) ^ 0xFFFFFFFF


def _checksums(words: Words, row: np.ndarray, size: np.ndarray, distinct: list[bytes], of: np.ndarray, heads: list[bytes]) -> np.ndarray:
    """The crc32 of each word after its row's head."""
    register = np.array([zlib.crc32(h) for h in heads], np.uint32) ^ ONES
    own = np.array([_own(w) for w in distinct], np.uint32)
    out = np.empty(len(row), np.uint32)
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], np.arange(SHORT + 2))
    for k in range(1, SHORT + 1):
        register = STEPS[register & 0xFF] ^ (register >> np.uint32(8))
        at = order[ends[k] : ends[k + 1]]
        out[at] = register[row[at]] ^ own[of[at]] ^ ONES
    for i in order[ends[SHORT + 1] :].tolist():
        out[i] = zlib.crc32(distinct[of[i]], zlib.crc32(heads[row[i]]))
    return out


def _count(min_chars: int, damaged_every: int | None):
    def told(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        held = 0
        for batch in batches:
            ids = pc.fill_null(batch.column(0), "").to_pylist()
            for words in split_words(batch.column(1), inside_of=latin_letters):
                words.buf = LOWER[words.buf]
                before = np.concatenate(([0], np.cumsum(words.buf == 0xC3)))
                chars = words.ends - words.starts - before[words.ends] + before[words.starts]
                row = words.rows_of_words()
                long = chars >= min_chars
                words.starts, words.ends, chars, row = words.starts[long], words.ends[long], chars[long], row[long]
                _, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
                distinct = [words.buf[a:b].tobytes() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
                if damaged_every:
                    heads = [f"{i}:".encode() for i in ids[words.first_row : words.first_row + words.n_rows]]
                    check = _checksums(words, row, words.ends - words.starts, distinct, of, heads)
                    damaged = check % damaged_every == 0
                    of_damaged, at = of[damaged], (check % chars)[damaged]
                    of = of[~damaged]
                    for (k, cut), n in Counter(zip(of_damaged.tolist(), at.tolist(), strict=True)).items():
                        word = distinct[k].decode()
                        if len(word) > min_chars:
                            counts[(word[:cut] + word[cut + 1 :]).encode()] += n
                n = np.bincount(of, minlength=len(distinct)).tolist()
                for word, c in zip(distinct, n, strict=True):
                    if c:
                        counts[word] += c
                held += sum(map(len, distinct))
                if len(counts) > HELD_WORDS or held > HELD_BYTES:
                    yield told(counts)
                    counts, held = Counter(), 0
        if counts:
            yield told(counts)

    return run


def count_words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, damaged_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of ``[A-Za-z\u00C0-\u00FF]`` in whole texts, A-Z lower-cased, of ``min_chars`` at least, that occur ``min_count`` times or more.

    With ``damaged_every``, runs are damaged first, for tests and measurements
    with known answers: where it divides the crc32 of ``<doc_id>:<run>``, the
    character at that number modulo the run's length goes.  Words are counted
    within tasks, in tables of bounded size, before they are shuffled.  A null
    text has no words, a null id reads as empty, and rows that repeat count each.
    """
    docs = documents(docs, id_col, text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counts = docs.mapInArrow(_count(min_chars, damaged_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _inside(group: pa.Table) -> pa.Table:
    """Near pairs of the words of one subtrie."""
    group = group.take(pc.sort_indices(group["word"]))
    pairs = near_pairs(group["word"].to_pylist())
    a, b = group.take(pa.array(pairs[:, 0])), group.take(pa.array(pairs[:, 1]))
    return pa.table({"a": a["word"], "a_n": a["n"], "b": b["word"], "b_n": b["n"]})


def near_words(words: DataFrame, scratch: Scratch, limit: int = 8_000, limit_chars: int = 4_000_000) -> DataFrame:
    """Pairs ``a, b`` of ``words`` (distinct ``word`` with its ``n``) at edit distance one, each once, with ``a_n, b_n``.

    The vocabulary's trie is cut into subtries of at most ``limit`` words and
    ``limit_chars`` characters, by levels from the root; every level is one pass
    over the words still above a cut.  Above a cut, words that first differ at a
    node are its children's: they are active for each other at distance one, so
    what follows must be equal, and they are joined by prefix and rest.  A group
    there has a word for each letter at most.  Below, a task carries active-node
    sets down its subtrie.
    """
    open_words, pairs = words.select("word", "n", F.lit("").alias("node")), []
    settled = None
    while True:
        nodes = open_words.groupBy("node").agg(F.count(F.lit(1)).alias("_count"), F.sum(F.length("word")).alias("_chars"), F.min("word").alias("_lo"), F.max("word").alias("_hi"))
        differ = F.zip_with(F.split("_lo", ""), F.split("_hi", ""), lambda a, b: a.eqNullSafe(b))
        fits = (F.col("_count") <= limit) & (F.col("_chars") <= limit_chars) | (F.col("_count") == 1)
        nodes = nodes.select("node", "_count", fits.alias("_fits"), F.when(fits, 0).otherwise(F.array_position(differ, False) - 1).cast("int").alias("_depth"))
        placed = scratch.keep(open_words.join(nodes, "node"))
        done = placed.filter("_fits and _count > 1").select("node", "word", "n")
        settled = done if settled is None else settled.unionByName(done)
        cut = placed.filter("not _fits")
        head, rest = F.expr("left(word, _depth)"), F.expr("substring(word, _depth + 2)")
        letter, tail = F.expr("substring(word, _depth + 1, 1)"), F.expr("substring(word, _depth + 1)")
        # a word with the letter after the prefix left out, and as it is
        ways = F.array(F.struct(F.lit(False).alias("whole"), rest.alias("rest")), F.struct(F.lit(True).alias("whole"), tail.alias("rest")))
        keyed = cut.select("word", "n", letter.alias("letter"), head.alias("head"), F.explode(ways).alias("way")).filter("way.whole or letter != ''")
        same = keyed.groupBy("head", "way.rest").agg(F.collect_list(F.struct("word", "n", "letter", F.col("way.whole").alias("whole"))).alias("m")).filter(F.size("m") > 1)
        met = same.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).filter("x.word < y.word and x.letter != y.letter and not (x.whole and y.whole)")
        pairs.append(met.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")))
        longer = cut.filter(F.length("word") > F.col("_depth"))
        open_words = longer.select("word", "n", F.expr("left(word, _depth + 1)").alias("node"))
        if longer.isEmpty():
            break
    pairs[-1:] = [settled.groupBy("node").applyInArrow(_inside, "a string, a_n long, b string, b_n long")]
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out


def group_variants(words: DataFrame, ratio: int = 10, limit: int = 8_000) -> DataFrame:
    """Each of ``words`` (``word, n``, distinct) with its form and root.

    Two words are near at edit distance one.  ``form`` is the near word of largest
    ``n`` (of equal ones the smallest in code-point order) if that is at least
    ``ratio`` times the word's own, else null; ``form_n`` its count, ``n_near`` the
    number of near words.  ``root`` follows forms to the last; along them ``n``
    grows by ``ratio`` each time, so paths are short and doubled at most six times.
    Null words and counts are left out; an empty table gives an empty result.
    Words of any script and length are taken; columns beside the two are ignored.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")).dropna())
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("a_n").alias("n")))
    near = near_words(words, scratch, limit).select(F.explode(both).alias("p")).select("p.*")
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = scratch.keep(
        words.join(near, "word", "left").select(
            "word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")
        )
    )
    root = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.keep(root.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        root = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
