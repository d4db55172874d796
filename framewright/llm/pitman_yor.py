"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

Every previous word is a restaurant; all of them share one parent, whose base is
uniform over the vocabulary and one unknown word.  Work is dealt in two ways:
documents into segments, and words or pairs of words into buckets by their
hashes.  Segments send each bucket their distinct words or pairs, packed in
arrays, and get numbers back in the same order.

The sampler makes every step a set of independent exact draws, so that it may be
dealt over tasks in any way.  A restaurant with ``T`` tables gets a variable
``g ~ Gamma(strength / discount + T)``; the parent's distribution is drawn from
its seating (Dirichlet).  Given both, the numbers of tables of its dishes are
independent: ``P(t) ~ S(c, t) (discount * g * H)**t`` for ``c`` customers, where
``S`` is the generalized Stirling number and ``H`` the dish's share in the parent.
All restaurants are drawn so, their tables become the parent's customers, the
parent is drawn the same way from its uniform base, and the next sweep begins.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from framewright.llm.tables import Scratch, free_shuffles
from framewright.llm.text import U, mix64, split_words

BEGIN, END = (int(x) for x in mix64(np.array([0xB0, 0xE0], np.uint64)))
#: Bytes of the hashes that travel with a pair: of the word (which must differ within one restaurant) and of its restaurant.
PAIR_BYTES, ROOM_BYTES = 6, 6
#: Log10 probabilities travel as whole numbers of this many parts of one.
PARTS = 1 << 13
ALL = (1 << 64) - 1
LOW, ROOM = U((1 << 8 * PAIR_BYTES) - 1), U((1 << 8 * ROOM_BYTES) - 1)


@dataclass
class Layout:
    """How many buckets there are for pairs and for words, and into how many slices large restaurants are cut."""

    pairs: int
    words: int
    slices: dict[int, int] = field(default_factory=dict)

    def deal(self, df: DataFrame) -> GroupedData:
        """Rows by bucket, one task a bucket, whatever the session's number of shuffle partitions."""
        return df.repartitionById(self.pairs + 2 * self.words, "bucket").groupBy("bucket")

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return (self.pairs + (mix64(w ^ U(0x77)) % U(self.words)).astype(np.int64)).astype(np.int64)

    def of_parents(self, low: np.ndarray) -> np.ndarray:
        return (self.pairs + self.words + (mix64(low ^ U(0x55)) % U(self.words)).astype(np.int64)).astype(np.int64)

    def of_pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = u
        if self.slices:
            large = np.array(sorted(self.slices), np.uint64)
            n = np.array([self.slices[int(x)] for x in large], np.uint64)
            at = np.minimum(np.searchsorted(large, u), len(large) - 1)
            cut = np.where(large[at] == u, n[at], U(1))
            key = u ^ np.where(cut > 1, mix64(mix64(w) % cut + U(1)), U(0))
        return (mix64(key ^ U(0x99)) % U(self.pairs)).astype(np.int64)


@dataclass
class Seats:
    """Discounts and strengths of the restaurants (index 0) and their parent (1); sweeps, and how many of the last are averaged."""

    discount: tuple[float, float] = (0.8, 0.6)
    strength: tuple[float, float] = (2.0, 1.0)
    sweeps: int = 5
    kept: int = 3


def _pack(x: np.ndarray, width: int = PAIR_BYTES) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, width: int = PAIR_BYTES) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers, their first bytes first, compressed: what is small or alike takes little room in a shuffle."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _expand(raw: bytes, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Tokens:
    """Tokens of the rows of a text column: lower-cased words and an end, each with the token before it."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w in split_words(column):
            hashes.append(w.hashes(lower=True))
            counts.append(w.counts())
        h, n = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
        self.counts = n + 1
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        self.token = np.full(self.offsets[-1], END, np.uint64)
        self.token[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        self.before = np.concatenate((np.zeros(1, np.uint64), self.token))[:-1]
        self.before[self.offsets[:-1]] = BEGIN


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, each item's place among them, and an item of each."""
    order = np.argsort(x)
    y = x[order]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    of = np.empty(len(x), np.int64)
    of[order] = np.cumsum(new) - 1
    return y[new], of, order[new]


class Asked:
    """Distinct pairs and words of a segment in the order in which buckets are asked and answer."""

    def __init__(self, tokens: Tokens, learn: np.ndarray, layout: Layout):
        train = np.repeat(learn, tokens.counts).astype(float)
        self.w, self.word_of, first = _distinct(tokens.token)
        word_train = np.bincount(self.word_of, train, len(self.w)).astype(np.int64)
        before = np.concatenate((np.zeros(1, np.int64), self.word_of))[:-1]
        before[tokens.offsets[:-1]] = len(self.w)  # the beginning
        # pairs by the ranks of their words: distinct ones are sorted by restaurant, then by word
        _, self.pair_of, first = _distinct(before * len(self.w) + self.word_of)
        u, v = tokens.before[first] & ROOM, tokens.token[first] & LOW
        pair_train = np.bincount(self.pair_of, train, len(u)).astype(np.int64)
        bucket = np.concatenate((layout.of_pairs(u, v), layout.of_words(self.w)))
        few = len(bucket) and layout.pairs + layout.words <= 1 << 16
        order = np.argsort(bucket.astype(np.uint16) if few else bucket, kind="stable")
        self.n_pairs, self.order = len(u), order
        self.u, self.v = u, v
        self.count = np.concatenate((pair_train, word_train))
        self.bucket = bucket[order]

    def messages(self, segment: int) -> Iterator[dict]:
        cut = np.flatnonzero(np.concatenate(([True], self.bucket[1:] != self.bucket[:-1], [True]))) if len(self.bucket) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = self.order[a:b]
            out = {"bucket": int(self.bucket[a]), "segment": segment, "count": _squeeze(self.count[at].astype("<u4")), "context": b"", "size": b"", "n": len(at)}
            if at[0] < self.n_pairs:
                u = self.u[at]
                head = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                word, of = np.unique(self.v[at], return_inverse=True)
                out |= {"context": _pack(u[head], ROOM_BYTES), "size": _squeeze(np.diff(np.append(head, len(u))).astype("<u4")), "word": _pack(word), "place": _squeeze(of.astype("<u4")), "n": len(u)}
            else:
                out |= {"word": self.w[at - self.n_pairs].astype("<u8").tobytes()}
            yield out


MESSAGE = pa.schema([("bucket", pa.int32()), ("segment", pa.int64()), ("context", pa.binary()), ("size", pa.binary()), ("word", pa.binary()), ("place", pa.binary()), ("count", pa.binary()), ("n", pa.int64())])
MESSAGE_SQL = "bucket int, segment long, context binary, size binary, word binary, place binary, count binary, n long"


def _pairs_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (np.concatenate([np.repeat(_unpack(r["context"], ROOM_BYTES), _expand(r["size"], "<u4", len(r["context"]) // ROOM_BYTES)) for r in rows]),
            np.concatenate([_unpack(r["word"])[_expand(r["place"], "<u4", r["n"])] for r in rows]), np.concatenate([_expand(r["count"], "<u4", r["n"]) for r in rows]).astype(np.int64))


def _merge(u: np.ndarray, v: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs with their counts, by context, and each row's place among them."""
    rank = _distinct(u)[1].astype(np.uint64)
    small = not len(rank) or int(rank.max()) < 1 << (64 - 8 * PAIR_BYTES)
    order = np.argsort((rank << U(8 * PAIR_BYTES)) | v) if small else np.lexsort((v, u))
    a, b = u[order], v[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    place = np.empty(len(u), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], np.bincount(place, count, int(new.sum())).astype(np.int64), place


def _learn(layout: Layout, batch_limit: int = 1 << 23):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pa.compute.binary_length(batch.column(0)).to_numpy(zero_copy_only=False))
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + batch_limit, "right")))
                tokens = Tokens(batch.column(0).slice(row, stop - row))
                asked = Asked(tokens, batch.column(1).slice(row, stop - row).to_numpy(zero_copy_only=False), layout)
                yield pa.RecordBatch.from_pylist(list(asked.messages(0)), MESSAGE)
                row = stop

    return run


#: Counts with a row of their own and numbers of tables with a column in ``stirling``; rows to an octave beyond, and octaves.
OWN_ROWS, COLUMNS, PER_OCTAVE, OCTAVES = 1024, 512, 64, 32


@functools.cache
def stirling(d: float) -> np.ndarray:
    """``S(c, t - 1) / S(c, t)`` by row of ``c`` (see ``_row``) and column ``t``; infinite where ``t`` exceeds ``c``.

    ``S`` are the generalized Stirling numbers of discount ``d``.  Up to
    ``OWN_ROWS`` their recurrence gives every row; beyond, the recurrence as a
    differential equation in ``c``, each column relaxing towards its neighbour.
    """
    out = np.full((OWN_ROWS + 1 + PER_OCTAVE * OCTAVES, COLUMNS + 1), np.inf)
    out[:, 1] = 0
    for n in range(1, OWN_ROWS):
        t = np.arange(2, min(n, COLUMNS) + 1)
        out[n + 1, t] = out[n, t] * (n - d * (t - 1) + out[n, t - 1]) / (n - d * t + out[n, t])
        if n < COLUMNS:
            out[n + 1, n + 1] = out[n, n] + n * (1 - d)
    t, y, n, parts = np.arange(2, COLUMNS + 1), out[OWN_ROWS, 2:].copy(), float(OWN_ROWS), 4

    def moved(left: np.ndarray, own: np.ndarray, a: float, b: float) -> np.ndarray:
        time, goal = (b - a) / ((a + b) / 2 - 0.5 - d * t + own), left + d
        return goal / (1 + (goal / y - 1) * np.exp(-goal * time))

    for k in range(PER_OCTAVE * OCTAVES):
        for _ in range(parts):
            m = n * 2 ** (1 / PER_OCTAVE / parts)
            left = np.concatenate(([0.0], y[:-1]))
            guess = moved(left, y, n, m)
            y, n = moved((left + np.concatenate(([0.0], guess[:-1]))) / 2, (y + guess) / 2, n, m), m
        out[OWN_ROWS + 1 + k, 2:] = y
    return out.astype(np.float32)


def _row(count: np.ndarray) -> np.ndarray:
    beyond = OWN_ROWS + np.rint(np.log2(np.maximum(count, OWN_ROWS) / OWN_ROWS) * PER_OCTAVE)
    return np.where(count <= OWN_ROWS, count, np.minimum(beyond, OWN_ROWS + PER_OCTAVE * OCTAVES)).astype(np.int64)


def _typical(count: np.ndarray, weight: np.ndarray, d: float) -> np.ndarray:
    """The most likely number of tables where it is large: the saddle point of the Stirling numbers' generating function."""
    low, high = np.full(len(count), -700.0), np.full(len(count), -1e-12)
    for _ in range(64):
        e = (low + high) / 2
        more = np.log(count) + (1 - d) * e - np.log(-np.expm1(e)) < np.log(weight)
        low, high = np.where(more, e, low), np.where(more, high, e)
    return weight * -np.expm1(d * low) / d


def draw_tables(count: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables, each with ``P(t) ~ S(count, t) weight**t``.

    All numbers are tried from one upward; each replaces the one chosen before
    with its share of the weights so far, until what is left is beyond double
    precision.  Where hundreds of tables are typical, the distribution is normal
    to that precision; its variance is the derivative of its mean.
    """
    out = np.minimum(count, 1).astype(float)
    busy = np.flatnonzero(count > 1)
    c, x, y = count[busy], weight[busy], stirling(d)
    row, choice = _row(c), np.ones(len(busy))
    far = (c > COLUMNS) & (x > y[row, COLUMNS // 2])
    if far.any():
        mean = _typical(c[far], x[far], d)
        spread = np.sqrt(np.maximum(_typical(c[far], x[far] * 1.01, d) - _typical(c[far], x[far] / 1.01, d), 0) / (2 * np.log(1.01)))
        choice[far] = np.clip(np.rint(mean + spread * rng.standard_normal(len(mean))), 1, c[far])
    live = np.flatnonzero(~far)
    own, total, last = np.ones(len(live)), np.ones(len(live)), np.minimum(c[live], COLUMNS)
    for t in range(2, COLUMNS + 1):
        if not len(live):
            break
        ratio = x[live] / y[row[live], t]
        own *= ratio
        total += own
        choice[live[rng.random(len(live)) * total < own]] = t
        large = total > 1e200
        own[large], total[large] = own[large] * 1e-200, total[large] * 1e-200
        on = (t < last) & ((ratio > 1) | (own > 1e-15 * total))
        live, own, total, last = live[on], own[on], total[on], last[on]
    out[busy] = choice
    return out


STATE = pa.schema([("bucket", pa.int32()), ("source", pa.int64()), ("word", pa.binary()), ("count", pa.binary()), ("blob", pa.binary()), ("total", pa.int64()), ("kinds", pa.int64())])
STATE_SQL = "bucket int, source long, word binary, count binary, blob binary, total long, kinds long"
#: Sources that are no buckets: words' counts, a bucket's own dishes, customers of sliced restaurants.
WORDS, OWN, GUESTS = -1, -2, -3


def _by_parent(layout: Layout, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in the order in which parents are asked, their parents, and each item's place among them."""
    word, of = np.unique(v, return_inverse=True)
    to = layout.of_parents(word)
    order = np.lexsort((word, to))
    place = np.empty(len(word), np.int64)
    place[order] = np.arange(len(word))
    return word[order], to[order], place[of]


def _rooms(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.concatenate(([True], u[1:] != u[:-1])) if len(u) else np.zeros(0, bool)
    return u[head], np.cumsum(head) - 1


def _count_up(layout: Layout, large: np.ndarray):
    """Counts of words; of pairs, the dishes of several customers, and what each parent bucket is told of the single ones.

    Words that nobody trained on are told too, so that they will be answered.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        out = []
        if bucket >= layout.pairs:
            w = np.concatenate([np.frombuffer(r["word"], "<u8") for r in rows])
            value, of = np.unique(w, return_inverse=True)
            c = np.bincount(of, np.concatenate([_expand(r["count"], "<u4", r["n"]) for r in rows]).astype(float)).astype(np.int64)
            value, c = value[c > 0], c[c > 0]
            out.append({"bucket": bucket, "source": WORDS, "word": value.tobytes(), "count": c.astype("<u8").tobytes(), "total": int(c.sum()), "kinds": len(value)})
        else:
            u, v, count, _ = _merge(*_pairs_of(rows))
            word, to, place = _by_parent(layout, v)
            single, dishes = np.bincount(place, count == 1, len(word)).astype("<u4"), np.bincount(place, count > 0, len(word)).astype("<u4")
            cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out.append({"bucket": int(to[a]), "source": bucket, "word": _pack(word[a:b]), "blob": pickle.dumps((_squeeze(single[a:b]), _squeeze(dishes[a:b]))), "total": 0, "kinds": 0})
            rooms, of = _rooms(u)
            at = np.flatnonzero(count > 1)
            used, room = np.unique(of[at], return_inverse=True)
            ones = np.bincount(of, count == 1, len(rooms))[used].astype("<u4")
            out.append({"bucket": bucket, "source": OWN, "blob": pickle.dumps((rooms[used], ones, room.astype("<u4"), place[at].astype("<u4"), count[at].astype("<u4"))), "total": 0, "kinds": 0})
            for k in np.flatnonzero(np.isin(rooms, large)):
                own = of == k
                out.append({"bucket": GUESTS, "source": int(rooms[k]), "total": int(count[own].sum()), "kinds": int((count[own] > 0).sum())})
        return pa.Table.from_pylist(out, STATE)

    return run


#: What parents and restaurants tell each other in a sweep.
SWEEP = pa.schema([("bucket", pa.int32()), ("source", pa.int64()), ("sweep", pa.int64()), ("blob", pa.binary()), ("masses", pa.binary()), ("n", pa.int64()), ("tables", pa.float64()), ("customers", pa.float64()), ("mass", pa.float64())])
SWEEP_SQL = "bucket int, source long, sweep long, blob binary, masses binary, n long, tables double, customers double, mass double"


@dataclass
class Parent:
    """The whole parent after a draw: tables, customers, and the drawn masses of its words and of all that is new."""

    tables: float
    customers: float
    mass: float = 0.0
    rest: float = 0.0


def _draw_parent(seats: Seats, sweep: int, vocabulary: int, before: float):
    """Seats restaurants' tables in a bucket of their parent, whose tables were ``before``; tells customers less discounted tables, and drawn masses."""
    d, s = seats.discount[1], seats.strength[1]
    g = np.random.default_rng((sweep, 0xA)).gamma(s / d + before)  # the same in all buckets

    def run(links: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(links.to_pylist(), key=lambda r: r["source"])
        if not rows:
            return pa.Table.from_pylist([], SWEEP)
        tables = {r["source"]: _expand(r["blob"], "<u4", r["n"]) for r in told.to_pylist()}
        _, of = np.unique(np.concatenate([_unpack(r["word"]) for r in rows]), return_inverse=True)
        more = []
        for r in rows:
            single, dishes = (_expand(x, "<u4", len(r["word"]) // PAIR_BYTES) for x in pickle.loads(r["blob"]))
            more.append(single + tables[r["source"]] if r["source"] in tables else dishes)
        c = np.bincount(of, np.concatenate(more).astype(float)).astype(np.int64)
        bucket = int(rows[0]["bucket"])
        rng = np.random.default_rng((bucket, sweep, 0xB))
        t = draw_tables(c, np.full(len(c), d * g / (vocabulary + 1)), d, rng)
        left = c - d * t
        mass = rng.gamma(left)
        at = np.concatenate(([0], np.cumsum([len(r["word"]) // PAIR_BYTES for r in rows])))
        total = {"tables": float(t.sum()), "customers": float(c.sum()), "mass": float(mass.sum())}
        return pa.Table.from_pylist([
            {"bucket": r["source"], "source": bucket, "sweep": sweep, "blob": left[of[a:b]].astype("<f4").tobytes(), "masses": mass[of[a:b]].astype("<f4").tobytes(), "n": int(b - a)} | (total if a == 0 else dict.fromkeys(total, 0.0))
            for r, a, b in zip(rows, at, at[1:], strict=False)], SWEEP)

    return run


def _heard(known: list[dict], sweep: int, what: str) -> np.ndarray:
    """What the parents told a bucket by word: customers less discounted tables (``blob``) or ``masses``."""
    rows = sorted((r for r in known if r["source"] >= 0 and r["sweep"] == sweep), key=lambda r: r["source"])
    return np.concatenate([np.frombuffer(r[what], "<f4") for r in rows]).astype(float) if rows else np.zeros(0)


def _draw_rooms(seats: Seats, sweep: int, vocabulary: int, parent: Parent, large: dict[int, float]):
    """Seats the dishes of a bucket, given the parent; tells the parents how many tables each word has. ``large`` has the tables of whole sliced restaurants."""
    d, s = seats.discount[0], seats.strength[0]

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        rows, known = own.to_pylist(), known.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], SWEEP)
        bucket = int(rows[0]["bucket"])
        rooms, ones, room, place, count = pickle.loads(rows[0]["blob"])
        mass = _heard(known, sweep, "masses")
        before = [_expand(r["blob"], "<u4", r["n"]) for r in known if r["source"] == OWN]
        t = before[0] if before else np.ones(len(count))
        tables = ones + np.bincount(room, t, len(rooms))
        rng = np.random.default_rng((bucket, sweep, 0xC))
        g = rng.gamma(s / d + tables)
        whole = [(k, int(x)) for k, x in enumerate(rooms.tolist()) if x in large]
        for k, x in whole:  # the same in all slices
            g[k] = np.random.default_rng((x, sweep, 0xD)).gamma(s / d + large[x])
        share = (mass[place] + parent.rest / (vocabulary + 1)) / (parent.mass + parent.rest)
        t = draw_tables(count.astype(np.int64), d * g[room] * share, d, rng)
        out = [{"bucket": bucket, "source": OWN, "sweep": sweep, "blob": _squeeze(t.astype("<u4")), "n": len(t)}]
        by_word, at = np.bincount(place, t, len(mass)), 0
        for r in sorted((r for r in known if r["source"] >= 0), key=lambda r: r["source"]):
            out.append({"bucket": r["source"], "source": bucket, "sweep": sweep, "blob": _squeeze(by_word[at : at + r["n"]].astype("<u4")), "n": r["n"]})
            at += r["n"]
        seated = ones + np.bincount(room, t, len(rooms))
        out += [{"bucket": GUESTS, "source": x, "sweep": sweep, "tables": float(seated[k] - tables[k])} for k, x in whole]
        return pa.Table.from_pylist(out, SWEEP)

    return run


@dataclass
class Sample:
    """A state of the sampler: the parent, and the tables of whole sliced restaurants; the rest is in ``rows`` by bucket."""

    parent: Parent
    large: dict[int, float]


def sample(state: DataFrame, layout: Layout, seats: Seats, vocabulary: int, scratch: Scratch) -> tuple[dict[int, Sample], list[DataFrame]]:
    """The last ``seats.kept`` states of the sampler by sweep, and what buckets must know of them."""
    links, own = state.filter("source >= 0 and bucket >= 0"), state.filter(F.col("source") == OWN)
    large = {r["source"]: float(r["t"]) for r in state.filter(F.col("bucket") == GUESTS).groupBy("source").agg(F.sum("kinds").alias("t")).collect()}  # one table a dish at first
    told, tables, samples, rows, empty = None, float(vocabulary), {}, [], state.sparkSession.createDataFrame([], SWEEP_SQL)
    for sweep in range(seats.sweeps + 1):
        to_parents = empty if told is None else told.filter(F.col("bucket") >= 0).filter("source >= 0")
        heard = scratch.keep(layout.deal(links).cogroup(layout.deal(to_parents)).applyInArrow(_draw_parent(seats, sweep, vocabulary, tables), SWEEP_SQL))
        sums = heard.agg(F.sum("tables").alias("t"), F.sum("customers").alias("c"), F.sum("mass").alias("m")).first()
        tables = sums["t"] or 0.0
        rest = np.random.default_rng((sweep, 0xE)).gamma(seats.strength[1] + seats.discount[1] * tables)
        parent = Parent(tables, sums["c"] or 0.0, sums["m"] or 0.0, float(rest))
        mine = empty if told is None else told.filter(F.col("source") == OWN)
        if sweep > seats.sweeps - seats.kept:  # the restaurants' tables that are now the parent's customers
            samples[sweep] = Sample(parent, dict(large))
            rows.append(scratch.keep(heard.unionByName(mine.withColumn("sweep", F.lit(sweep).cast("long"))).select("bucket", "source", "sweep", "blob", "n")))
        if sweep < seats.sweeps:
            known, last = heard.withColumn("blob", F.lit(None).cast("binary")).unionByName(mine), told
            told = scratch.keep(layout.deal(own).cogroup(layout.deal(known)).applyInArrow(_draw_rooms(seats, sweep, vocabulary, parent, large), SWEEP_SQL))
            for r in told.filter(F.col("bucket") == GUESTS).groupBy("source").agg(F.sum("tables").alias("t")).collect():
                large[r["source"]] += r["t"]
            scratch.drop(heard, *([] if last is None else [last]))
    scratch.drop(heard, *([] if told is None else [told]))
    return samples, rows


REPLY = pa.schema([("segment", pa.int32()), ("bucket", pa.int64()), ("value", pa.binary())])
REPLY_SQL = "segment int, bucket long, value binary"


def _answer(layout: Layout, seats: Seats, vocabulary: int, samples: dict[int, Sample], guests: dict[int, int]):
    """Mean probabilities, over the samples, of the pairs asked for; counts of the words asked for. ``guests`` are the customers of whole sliced restaurants."""
    (d, d0), (s, s0) = seats.discount, seats.strength

    def pairs(rows: list[dict], known: list[dict]) -> np.ndarray:
        u, v, count, back = _merge(*_pairs_of(rows))
        place = _by_parent(layout, v)[2]
        rooms, room = _rooms(u)
        n = np.bincount(room, count, len(rooms))
        whole = [(k, x) for k, x in enumerate(rooms.tolist()) if x in guests]
        for k, x in whole:
            n[k] = guests[x]
        mean = np.zeros(len(u))
        for sweep, one in samples.items():
            left = _heard(known, sweep, "blob")
            base = (left[place] + (s0 + d0 * one.parent.tables) / (vocabulary + 1)) / (s0 + one.parent.customers)
            t = np.minimum(count, 1).astype(float)
            t[count > 1] = next(_expand(r["blob"], "<u4", r["n"]) for r in known if r["source"] == OWN and r["sweep"] == sweep)
            tables = np.bincount(room, t, len(rooms))
            for k, x in whole:
                tables[k] = one.large[x]
            mean += np.where(n[room] > 0, (count - d * t + (s + d * tables[room]) * base) / (s + n[room]), base)
        return np.rint(-np.log10(mean / len(samples)) * PARTS).astype("<u4")[back]

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows, known = asked.to_pylist(), known.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], REPLY)
        if rows[0]["bucket"] < layout.pairs:
            values = pairs(rows, known)
        else:
            words = np.concatenate([np.frombuffer(r["word"], "<u8") for r in known]) if known else np.zeros(0, np.uint64)
            counts = np.concatenate([np.frombuffer(r["blob"], "<u8") for r in known]) if known else np.zeros(0, np.uint64)
            order = np.argsort(words)
            words, counts = words[order], counts[order]
            v = np.concatenate([np.frombuffer(r["word"], "<u8") for r in rows])
            at = np.minimum(np.searchsorted(words, v), max(len(words) - 1, 0))
            values = (np.where(words[at] == v, counts[at], 0) if len(words) else np.zeros(len(v))).astype("<u8")
        at = np.concatenate(([0], np.cumsum([r["n"] for r in rows])))
        return pa.Table.from_pylist(
            [{"segment": r["segment"], "bucket": r["bucket"], "value": _squeeze(values[a:b])} for r, a, b in zip(rows, at, at[1:], strict=False)], REPLY)

    return run


def _ask(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        asked = Asked(Tokens(table["text"]), table["learn"].to_numpy(), layout)
        return pa.Table.from_pylist(list(asked.messages(table["segment"][0].as_py())), MESSAGE)

    return run


def _sum_up(layout: Layout, total: int, vocabulary: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        tokens = Tokens(docs["text"])
        asked = Asked(tokens, docs["learn"].to_numpy(), layout)
        by_bucket = dict(zip(replies["bucket"].to_pylist(), replies["value"].to_pylist(), strict=True))
        pair, word = np.zeros(asked.n_pairs), np.zeros(len(asked.w), np.int64)
        cut = np.flatnonzero(np.concatenate(([True], asked.bucket[1:] != asked.bucket[:-1], [True]))) if len(asked.bucket) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at, raw = asked.order[a:b], by_bucket[int(asked.bucket[a])]
            if at[0] < asked.n_pairs:
                pair[at] = _expand(raw, "<u4", b - a) / -PARTS
            else:
                word[at - asked.n_pairs] = _expand(raw, "<u8", b - a)
        c = word[asked.word_of]
        by_doc = lambda x: np.add.reduceat(x, tokens.offsets[:-1]) if docs.num_rows else x
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pa.array(~docs["learn"].to_numpy()), "n_tokens": pa.array(tokens.counts),
            "n_known": pa.array(by_doc((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(docs.num_rows, total)),
            "base_score": pa.array(by_doc(np.log10((c + 1) / (total + vocabulary + 1)))), "score": pa.array(by_doc(pair[asked.pair_of]))})

    return run


def _frequent(share: float):
    """Token count of each batch, and its words with at least ``share`` of it: of a word with twice that share of all tokens, half or more is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, count = np.unique(Tokens(batch.column(0)).token, return_counts=True)
            often = count >= share * count.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *value[often].view(np.int64).tolist()], pa.int64()), pa.array([int(count.sum()), *count[often].tolist()], pa.int64())], ["word", "count"])

    return run


def lay_out(docs: DataFrame, size: int, scratch: Scratch, bucket_tokens: int, large_share: float) -> Layout:
    """Buckets of about ``bucket_tokens``, and slices of at most a quarter of a bucket for each restaurant that has more.

    A word is watched from ``large_share`` of all tokens on, and from a quarter of
    a bucket on where that is less, so what lies in one bucket does not grow with
    the corpus.  Watched words are at most eight a bucket.
    """
    share = min(large_share, bucket_tokens / max(size, 1))  # a token has four bytes or more as a rule
    often = scratch.keep(docs.filter("learn").select("text").mapInArrow(_frequent(share / 2), "word long, count long").groupBy("word").agg(F.sum("count").alias("n")))
    n = (often.filter("word is null").first() or {"n": 0})["n"]
    layout = Layout(max(1, -(-n // bucket_tokens)), max(1, -(-n // (4 * bucket_tokens))))
    for row in often.filter(F.col("word").isNotNull() & (F.col("n") >= share / 2 * n)).toLocalIterator():
        cut = -(-4 * row["n"] * layout.pairs // n)
        word = BEGIN if row["word"] & ALL == END else row["word"]  # there are as many beginnings as ends
        if cut > 1:
            layout.slices[word & int(ROOM)] = cut
    scratch.drop(often)
    return layout


def score_texts(
    docs: DataFrame, learn=None, seats: Seats | None = None, bucket_tokens: int = 2_000_000, segment_bytes: int = 8 << 20, large_share: float = 0.001,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Log10 probability of every text under a model learned from the rows where ``learn`` (a column; default: all) is true.

    One row per input row: ``doc_id, held_out, n_tokens`` (words and one end),
    ``n_known`` (of them, seen in training), ``train_tokens``, ``base_score``
    (add-one unigram) and ``score`` (the hierarchical Pitman-Yor model: bigram
    restaurants with one parent; probabilities are means over the last samples).

    Restaurants with more than a quarter of a bucket's tokens, and the one of text
    beginnings, are cut into slices by the next word (see ``lay_out``); their
    customers and tables are added up over the slices, which is all that their
    dishes need to know of each other.  Buckets and segments grow in number, not
    size, and tasks with them.  Null and empty texts are one end token.  A
    null ``learn`` learns; repeated rows count each.  Without training rows all
    scores are 0.  An empty table gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """
    seats = seats or Seats()
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(F.lit(True) if learn is None else learn, F.lit(True)).alias("learn"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    layout = lay_out(docs, size, scratch, bucket_tokens, large_share)
    large = np.array(sorted(layout.slices), np.uint64)

    state = scratch.keep(layout.deal(docs.select("text", "learn").mapInArrow(_learn(layout), MESSAGE_SQL)).applyInArrow(_count_up(layout, large), STATE_SQL))
    free_shuffles(docs.sparkSession)
    words = state.filter(F.col("source") == WORDS)
    sums = words.agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    total, vocabulary = sums["n"] or 0, sums["v"] or 0
    guests = {r["source"]: r["t"] for r in state.filter(F.col("bucket") == GUESTS).groupBy("source").agg(F.sum("total").alias("t")).collect()}
    samples, rows = sample(state, layout, seats, vocabulary, scratch)
    counts = words.select("bucket", "source", F.lit(0).cast("long").alias("sweep"), "word", F.col("count").alias("blob"), F.lit(0).cast("long").alias("n"))
    known = scratch.keep(functools.reduce(DataFrame.unionByName, rows).withColumn("word", F.lit(None).cast("binary")).unionByName(counts))
    scratch.drop(state, *rows)
    free_shuffles(docs.sparkSession)

    segments = max(1, -(-size // segment_bytes))
    dealt = docs.withColumn("segment", F.pmod(F.xxhash64("doc_id", "text"), F.lit(segments)).cast("int")).repartitionById(segments, "segment")
    asked = dealt.groupBy("segment").applyInArrow(_ask(layout), MESSAGE_SQL)
    replies = layout.deal(asked).cogroup(layout.deal(known)).applyInArrow(_answer(layout, seats, vocabulary, samples, guests), REPLY_SQL)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("segment").cogroup(replies.repartitionById(segments, "segment").groupBy("segment")).applyInArrow(
        _sum_up(layout, total, vocabulary),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
