"""Word n-gram Jaccard join by prefix filters under several global token orders.

Of two sets that are similar enough, the first few tokens under any one order of all tokens share
a token. Orders here put tokens that many documents hold last, by a fixed-size count of all
documents' tokens, and break ties by different hash mixes. Pairs that share a token of the first
order's prefixes are candidates if their sizes, the token's places and their parity sketches allow
it; then the prefixes under the other orders are intersected as well. Only what passes every order
has its sets fetched and compared exactly (on 64-bit hashes of the shingles; equal sets are told by
128 bits).

Copies are one class from the start. Classes that meet under several single-token prefixes are
compared with one leader each, which connects groups of near copies with few comparisons; the
complete join then only looks at pairs that are not connected yet. Tokens of very many classes are
cut into blocks, and each pair of blocks is a group of its own that any task can compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import durable, rows_apart
from tidepanel.llm.graph import components as connected

#: Orders whose first token is kept for the leaders, and how many of them must agree on a leader.
LEADER_ORDERS, LEADER_AGREE = 8, 3
#: Classes of a large meeting that get a leader of their own in the second round.
PART = 8
#: Orders that filter candidates beside the one that finds them.
FILTER_ORDERS = 2
#: Bins of the token counts (a byte each per task): fixed, whatever the corpus.
COUNT_BITS = 21
#: Bits of the parity sketch that travels with each prefix token, and bounds of a whole set's sketch (4 bits a token).
ROW_BITS, LEAST_BITS, MOST_BITS = 256, 1024, 1 << 16
#: Classes of one token that a task compares at once; the rest of a larger token is compared by pairs of such blocks.
BLOCK = 1024
#: Pairs looked at in one step.
_STEP = 1 << 18
#: A join side of two longs is broadcast up to so many rows (some 50 MB as a hash table); beyond that it is shuffled.
BROADCAST_ROWS = 1_000_000
_WORDS = 150_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(h: np.ndarray, order: int) -> np.ndarray:
    """A different pseudo-random order of all tokens for each number."""
    with np.errstate(over="ignore"):
        z = h ^ np.uint64((order * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * _K[1]
        z = (z ^ (z >> np.uint64(27))) * _K[2]
        return z ^ (z >> np.uint64(31))


class _Hashes(dict):
    """word -> 64-bit hash; emptied between groups of texts when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Texts -> distinct 64-bit hashes of their word n-grams, sorted, all texts in one array."""

    def __init__(self, width: int):
        self.width, self.known = width, _Hashes()

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, bounds): text i has tokens[bounds[i]:bounds[i + 1]]."""
        # bytes.lower() and bytes.split() know ASCII only: A-Z, and the six white-space bytes
        cut = [t.encode("utf-8", "surrogatepass").lower().split() if t else () for t in texts]
        if len(self.known) > _WORDS:
            self.known.clear()
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.uint64, int(n.sum()))
        starts = np.cumsum(n) - n
        out = self._join(h, self.width)
        count = np.where(n >= self.width, n - self.width + 1, np.minimum(n, 1))
        bounds = np.r_[0, np.cumsum(count)]
        tokens = out[np.repeat(starts - bounds[:-1], count) + np.arange(bounds[-1])]
        for i in np.flatnonzero((n > 0) & (n < self.width)):
            tokens[bounds[i]] = self._join(h[starts[i] : starts[i] + n[i]], int(n[i]))[0] ^ np.uint64(n[i])
        tokens = mixed(tokens, 0)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            tokens[a:b].sort()
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        new[bounds[:-1][count > 0]] = True
        return tokens[new], np.r_[0, np.cumsum(new)][bounds]

    @staticmethod
    def _join(h: np.ndarray, width: int) -> np.ndarray:
        """At each place a hash of ``width`` words from there on; the last places' are of no use."""
        out = h.copy()
        with np.errstate(over="ignore"):
            for i in range(1, width):
                out *= _K[0]
                out ^= out >> np.uint64(29)
                out[:-i] += h[i:]
        return out


def groups(texts: list, chars: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters; a longer text is alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield slice(first, i)
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield slice(first, len(texts))


def wanted(n: int, percent: int) -> int:
    """Tokens that a similar set shares with a set of n at least."""
    return -(-percent * n // 100)


def bins(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def order_keys(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Numbers that sort tokens in a global order: rarer levels first, then by the order's mix."""
    return (levels[bins(tokens)].astype(np.uint64) << np.uint64(58)) | (mixed(tokens, order) >> np.uint64(6))


def prefix(tokens: np.ndarray, keys: np.ndarray, percent: int) -> np.ndarray:
    """The first n - wanted + 1 tokens, in the order that ``keys`` give."""
    n = len(tokens)
    size = n - wanted(n, percent) + 1
    at = np.argpartition(keys, size - 1)[:size] if size < n else np.arange(n)
    return tokens[at[np.argsort(keys[at])]]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each set's parity sketch: bit i tells whether an odd number of tokens ends in i.

    A sketch has a power of two of bits, 4 a token at least between the bounds; its halves'
    exclusive or is the sketch of half as many bits.
    """
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = min(max(1 << (4 * (b - a) - 1).bit_length() if b > a else 0, LEAST_BITS), MOST_BITS)
        odd = np.bincount((tokens[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return out


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch in ``size`` bytes."""
    return sketch if len(sketch) == size else np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def needed(nx, ny, percent: int):
    """Tokens that sets of these sizes share at least if they are similar enough."""
    return -(-percent * (nx + ny) // (100 + percent))


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 128, then rounded up to eighths of a power of two."""
    large = 128 + np.ceil(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(large, 255)).astype(np.uint8)


_DECODED = np.r_[np.arange(128), np.ceil(128 * 2 ** (np.arange(128) / 8))].astype(np.uint32)


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), text).alias(f"t{k}") for k in (1, 2)]


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, s1, s2, firsts, sketch, t1, t2, counts) of every row.

    t1 and t2 are the text's hashes, of 128 bits together. Set size, set signature, the least mix of each leader order, and the set's parity sketch behind
    its size. Each task's last row has only counts: its tokens by bin, a byte each.
    """
    names = ["doc_id", "n", "s1", "s2", "firsts", "sketch", "t1", "t2", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(width), np.zeros(1 << COUNT_BITS, np.int32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in groups(texts):
                tokens, bounds = shingles(texts[part])
                n = np.diff(bounds)
                full, begin = n > 0, bounds[:-1][n > 0]
                s1, s2 = np.zeros((2, len(n)), np.uint64)
                firsts = np.zeros((len(n), LEADER_ORDERS), np.uint64)
                if len(begin):
                    s1[full] = np.add.reduceat(mixed(tokens, 101), begin)
                    s2[full] = np.bitwise_xor.reduceat(mixed(tokens, 102), begin)
                    for k in range(LEADER_ORDERS):
                        firsts[full, k] = np.minimum.reduceat(mixed(tokens, k + 1), begin)
                    at, more = np.unique((tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int32), return_counts=True)
                    counts[at] += more.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        pa.array(n, pa.int64()),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(firsts.ravel().view(np.int64), LEADER_ORDERS).cast(pa.list_(pa.int64())),
                        pa.array([size.tobytes() + one for size, one in zip(n.astype(np.int64), sketches(tokens, bounds), strict=True)], pa.binary()),
                        batch.column(2)[part],
                        batch.column(3)[part],
                        pa.nulls(len(n), pa.binary()),
                    ],
                    names=names,
                )
        if counts.any():
            empty = [pa.nulls(1, t) for t in (*(pa.int64(),) * 4, pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([_coded(counts).tobytes()], pa.binary())], names=names)

    read = _documents(docs)
    return read.select(*read.columns, *_text_hashes(F.col("text"))).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, firsts array<long>, sketch binary, t1 long, t2 long, counts binary")


def _added(parts: DataFrame, keys: list[str], coded: bool) -> DataFrame:
    """The sums of the arrays (bytes that are codes, or numbers) with equal keys; a task holds one sum at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for *mine, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mine != key and key is not None:
                    yield pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.int32()) for k, v in zip(keys, key, strict=True)}, "part": [total.astype(np.uint32).tobytes()]})
                new = (_DECODED[np.frombuffer(part, np.uint8)] if coded else np.frombuffer(part, np.uint32)).astype(np.uint64)
                key, total = (mine, np.minimum(total + new, 0xFFFFFFFF)) if mine == key else (mine, new)
        if key is not None:
            yield pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.int32()) for k, v in zip(keys, key, strict=True)}, "part": [total.astype(np.uint32).tobytes()]})

    return parts.select(*keys, "part").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", part binary")


class Rarity:
    """By bin: a level, and into how many salts the rows of its tokens go (0: few enough for one task)."""

    def __init__(self, counts: np.ndarray):
        mean = max(counts.mean(), 4.0)
        self.level = np.log2(np.maximum(counts / mean, 1)).astype(np.uint8)
        usual = 4 * mean + BLOCK
        self.salts = np.where(counts > usual, np.minimum(counts / usual + 1, 60_000), 0).astype(np.uint16)


def _rarity(profiles: DataFrame) -> Rarity:
    """The bins' counts over all tasks, added up in two steps, so that no task reads all of them."""
    pieces = 16
    size = (1 << COUNT_BITS) // pieces

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for salt, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "salt": pa.array([salt] * pieces, pa.int32()), "part": [one[i : i + size] for i in range(0, len(one), size)]})

    whole = profiles.where("counts is not null").select(F.pmod(F.spark_partition_id(), F.lit(128)).alias("salt"), "counts")
    parts = whole.mapInArrow(cut, "piece int, salt int, part binary")
    counts = np.zeros((pieces, size), np.uint32)
    for r in _added(_added(parts, ["piece", "salt"], True), ["piece"], False).collect():  # 16 rows, 8 MB in all, whatever the corpus
        counts[r["piece"]] = np.frombuffer(bytes(r["part"]), np.uint32)
    return Rarity(counts.ravel())


def _leader_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the leader that enough orders propose."""
    firsts = classes.select("rep", F.posexplode("firsts").alias("k", "token"))
    met = firsts.groupBy("k", "token").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1").drop("size")
    return firsts.join(met, ["k", "token"]).where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("orders")).where(F.col("orders") >= LEADER_AGREE).select(F.col("rep").alias("a"), F.col("leader").alias("b"))


def _part_pairs(classes: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b): classes of large meetings, each with the leader of a small random part of it, if not connected yet.

    Where one leader is too far from most of a group of near copies, the parts' leaders connect it
    by random comparisons, as many as there are orders for each class.
    """
    firsts = classes.join(placed, "rep").select("rep", "comp", F.posexplode("firsts").alias("k", "token"))
    large = firsts.groupBy("k", "token").agg(F.count("*").alias("size")).where(F.col("size") >= PART)
    parts = firsts.join(large, ["k", "token"]).withColumn("part", F.pmod(F.xxhash64("rep", "k"), F.ceil(F.col("size") / PART)))
    lead = parts.groupBy("k", "token", "part").agg(F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(9))).alias("lead"))
    met = parts.join(lead, ["k", "token", "part"]).where(F.col("comp") != F.col("lead.comp"))
    return met.select(F.greatest("rep", F.col("lead.rep")).alias("a"), F.least("rep", F.col("lead.rep")).alias("b")).distinct()


def _beside(pairs: DataFrame, ids: DataFrame, value: str) -> DataFrame:
    """(a, b, left, right): the pairs with the value of each end."""
    one, two = (ids.select(F.col("id").alias(end), F.col(value).alias(name)) for end, name in (("a", "left"), ("b", "right")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")


def _compared(met: DataFrame, good) -> DataFrame:
    """The (a, b) whose left and right bytes pass ``good``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = pa.array([good(x.as_buffer(), y.as_buffer()) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _could_be(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches differ in no more bits than similar enough sets of their sizes may in tokens."""

    def good(x, y) -> bool:
        nx, ny = (int(np.frombuffer(v, np.int64, 1)[0]) for v in (x, y))
        x, y = (np.frombuffer(v, np.uint8, offset=8) for v in (x, y))
        size = min(len(x), len(y))
        return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)) <= nx + ny - 2 * needed(nx, ny, percent)

    return _compared(_beside(pairs, classes.select(F.col("rep").alias("id"), "sketch"), "sketch"), good)


def _bounded(side: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few enough rows of two longs; else it is joined by a shuffle."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def orders_agree(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    """Whether two prefixes under one order, in its order, leave the sets room to be similar enough.

    They have to share a token, and the tokens of either before the last shared one that the other
    lacks are missing there for good.
    """
    need = needed(nx, ny, percent)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i) or need > min(nx, ny):
        return False
    return i.max() + 1 - len(i) <= nx - need and j.max() + 1 - len(j) <= ny - need


def _verified(docs: DataFrame, pairs: DataFrame, rarity, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough.

    The other orders' prefixes of a pair's documents meet first; the sets follow for the pairs
    that all orders allow. ``pairs`` is durable.
    """
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    orders = range(2, 2 + FILTER_ORDERS)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, level = Shingler(width), rarity.value.level
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in groups(texts):
                tokens, bounds = shingles(texts[part])
                sets = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                # a set's size, then its prefix under each order: all of the same length
                heads = [b"".join([len(s).to_bytes(8, "little"), *(prefix(s, order_keys(s, level, k), percent).tobytes() for k in orders if len(s))]) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(heads, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "heads", "tokens"])

    def allowed(x, y) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        nx, ny = int(x[0]), int(y[0])
        if not nx or not ny or needed(nx, ny, percent) > min(nx, ny):
            return False
        return all(orders_agree(p, nx, q, ny, percent) for p, q in zip(*(np.split(v[1:], FILTER_ORDERS) if FILTER_ORDERS else () for v in (x, y)), strict=True))

    def similar(x, y) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)

    sets = durable(_documents(docs).join(_bounded(ends), "doc_id", "left_semi").mapInArrow(shingle, "id long, heads binary, tokens binary"))
    left = durable(_compared(_beside(pairs, sets, "heads"), allowed))
    return _compared(_beside(left, sets, "tokens"), similar)


class Met:
    """Rows of classes where tokens meet: rep, comp, place in the prefix, set size, previous prefix token, row sketch."""

    NAMES = ("rep", "comp", "at", "prev", "sketch")

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.rep, self.comp, at, self.prev = (np.asarray(batch.column(c)) for c in self.NAMES[:4])
        self.n, self.place = at >> 32, at & 0xFFFFFFFF
        self.sketch = _words(batch.column("sketch"))

    def pairs(self, begin: np.ndarray, end: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
        """(a, b) of each row i with the rows begin[i] to end[i] that could be similar and aren't connected."""
        many = np.maximum(end - begin, 0)
        rows = np.flatnonzero(many)
        upto = np.cumsum(many[rows])
        first = 0
        while first < len(rows):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + _STEP, "right")))
            chosen = rows[first:last]
            i = np.repeat(chosen, many[chosen])
            j = np.arange(len(i)) - np.repeat(upto[first:last] - many[chosen] - done, many[chosen]) + np.repeat(begin[chosen], many[chosen])
            i, j = self._likely(i, j, percent)
            if len(i):
                yield pa.RecordBatch.from_pydict({"a": np.maximum(self.rep[i], self.rep[j]), "b": np.minimum(self.rep[i], self.rep[j])})
            first = last

    def _likely(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        ok = self.comp[i] != self.comp[j]
        i, j = i[ok], j[ok]
        # a pair whose previous prefix tokens are the same one has met there already
        ok = (self.prev[i] != self.prev[j]) | (self.place[i] == 0) | (self.place[j] == 0)
        i, j = i[ok], j[ok]
        both = self.n[i] + self.n[j]
        need = needed(self.n[i], self.n[j], percent)
        # sets that share ``need`` tokens share one among the first n - need + 1 of each
        ok = (self.place[i] <= self.n[i] - need) & (self.place[j] <= self.n[j] - need)
        i, j, spare = i[ok], j[ok], (both - 2 * need)[ok]
        differ = np.zeros(len(i), np.int64)
        for word in range(self.sketch.shape[1]):
            differ += np.bitwise_count(self.sketch[i, word] ^ self.sketch[j, word])
        ok = differ <= spare
        return i[ok], j[ok]


def _words(column: pa.Array) -> np.ndarray:
    """A binary column whose values are all ROW_BITS long, as rows of 64-bit words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty((0, ROW_BITS // 64), np.uint64)
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].tobytes(), np.uint64).reshape(-1, ROW_BITS // 64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _streamed(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted batches as tables of whole groups, False beside them; rows of groups larger than ``most`` come as they are, True beside them."""
    held, large = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if large is not None:
            same = np.ones(len(table), bool)
            for k, v in zip(keys, large, strict=True):
                same &= np.asarray(table.column(k)) == v
            size = int(same.sum())  # sorted: the group goes on at the front only
            if size:
                yield table.slice(0, size), True
            table = table.slice(size)
            if not len(table):
                continue
            large = None
        table = pa.concat_tables([held, table]) if held is not None else table
        last = int(_runs(*(np.asarray(table.column(k)) for k in keys))[-1])
        if last:
            yield table.slice(0, last), False
        held = table.slice(last).combine_chunks()
        if most is not None and len(held) > most:
            large = [held.column(k)[0].as_py() for k in keys]
            yield held, True
            held = None
    if held is not None:
        yield held, False


def _prefix_rows(docs: DataFrame, placed: DataFrame, rarity, width: int, percent: int) -> DataFrame:
    """(token, salt, rep, comp, at, prev, sketch): a row for each token of each class's first prefix."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, level, salts = Shingler(width), rarity.value.level, rarity.value.salts
        for batch in batches:
            reps, comps, texts = np.asarray(batch.column("rep")), np.asarray(batch.column("comp")), batch.column("text").to_pylist()
            for part in groups(texts):
                tokens, bounds = shingles(texts[part])
                keys, n = order_keys(tokens, level, 1), np.diff(bounds)
                found = [prefix(tokens[a:b], keys[a:b], percent) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                size = np.fromiter(map(len, found), np.int64, len(found))
                token = np.concatenate(found) if found else np.empty(0, np.uint64)
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                prev = np.r_[np.uint64(0), token[:-1]] if len(token) else token
                rep = np.repeat(reps[part], size)
                deal = salts[bins(token)].astype(np.int64)
                salt = np.where(deal > 0, (mixed(rep.view(np.uint64), 5) >> np.uint64(1)).astype(np.int64) % np.maximum(deal, 1), -1).astype(np.int32)
                columns = [token.view(np.int64), salt, rep, np.repeat(comps[part], size), (np.repeat(n, size) << 32) | place, prev.view(np.int64)]
                rows = np.stack([folded(np.frombuffer(s, np.uint8), ROW_BITS // 8) for s in sketches(tokens, bounds)])
                for i in range(0, len(token), 50_000):
                    owner = np.repeat(np.arange(len(size)), size)[i : i + 50_000]
                    wide = np.ascontiguousarray(rows[owner])
                    bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ROW_BITS // 8), len(wide), [None, pa.py_buffer(wide)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[i : i + 50_000]) for c in columns), bytes_], names=["token", "salt", *Met.NAMES])

    chosen = _bounded(placed.select(F.col("rep").alias("doc_id"), "rep", "comp"))
    return _documents(docs).join(chosen, "doc_id").select("rep", "comp", "text").mapInArrow(emit, "token long, salt int, rep long, comp long, at long, prev long, sketch binary")


def _remaining_pairs(docs: DataFrame, placed: DataFrame, rarity, width: int, percent: int) -> DataFrame:
    """(a, b): pairs of classes that share a token of the first order's prefixes, could be similar and aren't connected yet."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "token", *Met.NAMES[1:]]

        def later(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.append_column("a", table.column("rep")).append_column("b", pa.nulls(len(table), pa.int64())).select(names)
            yield from table.to_batches(max_chunksize=50_000)

        for table, large in _streamed(batches, ["token"], BLOCK):
            heavy = pc.greater_equal(table.column("salt"), 0)
            if large or pc.all(heavy).as_py():
                yield from later(table)
                continue
            if pc.any(heavy).as_py():
                yield from later(table.filter(heavy))
                table = table.filter(pc.invert(heavy))
            token, comp = np.asarray(table.column("token")), np.asarray(table.column("comp"))
            order = np.lexsort((comp, token))
            token, comp = token[order], comp[order]
            starts = _runs(token, comp)
            size = np.diff(np.r_[starts, len(token)])
            first = _runs(token[starts])
            # rows of the token's largest component come last and look for no one
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(starts)]))
            largest = np.maximum.reduceat(size, first)[group]
            place = np.arange(len(starts))
            main = place == np.minimum.reduceat(np.where(size == largest, place, len(starts)), first)[group]
            seen = np.lexsort((np.repeat(main, size), token))
            order, main = order[seen], np.repeat(main, size)[seen]
            ends = np.repeat(np.r_[_runs(token)[1:], len(token)], np.diff(np.r_[_runs(token), len(token)]))
            for found in Met(table.take(pa.array(order))).pairs(np.arange(1, len(order) + 1), np.where(main, 0, ends), percent):
                more = [pa.nulls(len(found), t) for t in (pa.int64(),) * 4 + (pa.binary(),)]
                yield pa.RecordBatch.from_arrays([*found.columns, *more], names=names)

    rows = _prefix_rows(docs, placed, rarity, width, percent).repartition("token", "salt").sortWithinPartitions("token")
    met = durable(rows.mapInArrow(meet, "a long, b long, token long, comp long, at long, prev long, sketch binary"))
    heavy = met.where("b is null").select("token", F.col("a").alias("rep"), *Met.NAMES[1:])
    return met.where("b is not null").select("a", "b").unionByName(_block_pairs(heavy, percent)).distinct()


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the tokens of very many classes: each pair of a token's blocks is a group of its own.

    The classes of a token's largest component have blocks apart, which aren't compared with each other.
    """
    counted = rows.groupBy("token", "comp").agg(F.count("*").alias("size"))
    blocks = counted.groupBy("token").agg(F.sum("size").alias("all"), F.max("size").alias("most"), F.max_by("comp", "size").alias("main")).where(F.col("all") > F.col("most"))
    blocks = blocks.select("token", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("others"))
    mixed_ = F.xxhash64("rep", F.lit(3))
    marked = rows.join(blocks, "token").withColumn("block", F.when(F.col("comp") == F.col("main"), F.pmod(mixed_, F.col("mains"))).otherwise(F.col("mains") + F.pmod(mixed_, F.col("others"))).cast("int"))
    met = F.sequence(F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)
    dealt = marked.select("token", *Met.NAMES, "block", F.explode(met).alias("other"))
    dealt = dealt.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *Met.NAMES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _streamed(batches, ["token", "low", "high"]):
            token, low, high, block = (np.asarray(table.column(c)) for c in ("token", "low", "high", "block"))
            starts = _runs(token, low, high)
            size = np.diff(np.r_[starts, len(token)])
            end = np.repeat(starts + size, size)
            # in a group of two blocks the first one's rows look for the second's, in a group of one each row for those after it
            second = np.repeat(starts + np.add.reduceat((block == low).astype(np.int64), starts), size)
            begin = np.where(low == high, np.arange(len(token)) + 1, second)
            yield from Met(table).pairs(begin, np.where((low == high) | (block == low), end, 0), percent)

    keys = ["token", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(compare, "a long, b long")


def _placed(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp): each class with the smallest one that links reach."""
    near = connected(links).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    return durable(classes.select("rep").distinct().join(near, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp")))


def _as_links(placed: DataFrame) -> DataFrame:
    return placed.where("rep <> comp").select(F.col("rep").alias("a"), F.col("comp").alias("b"))


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable over links of that similarity.

    Tokens are the distinct ``width``-word shingles of the text, A-Z lower-cased, words being what
    ASCII white space parts; a shorter text is one shingle, a null or empty one none and linked
    with nothing. Each row is judged by its own text: rows that repeat a doc_id get a row each. A
    null doc_id has no component and no part in linking.
    """
    return _components(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, t1, t2, component_id) of every row."""
    spark = docs.sparkSession
    profiles = durable(_profiles(docs, width))
    rarity = spark.sparkContext.broadcast(_rarity(profiles))  # 3 * 2**COUNT_BITS bytes, whatever the corpus
    rows = profiles.where("counts is null").select("doc_id", "n", "s1", "s2", "t1", "t2", "firsts", "sketch")
    members = rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("firsts").alias("firsts"), F.first("sketch").alias("sketch"))
    classes = durable(members)
    leaders = durable(_leader_pairs(classes))
    links = durable(_verified(docs, leaders, rarity, width, percent))
    placed = _placed(classes, links)
    again = durable(_could_be(_part_pairs(classes, placed), classes, percent))
    placed = _placed(classes, _verified(docs, again, rarity, width, percent).unionByName(_as_links(placed)))
    rest = durable(_could_be(_remaining_pairs(docs, placed, rarity, width, percent), classes, percent))
    more = durable(_verified(docs, rest, rarity, width, percent))
    final = _placed(classes, more.unionByName(_as_links(placed))).withColumnRenamed("comp", "component_id")
    named = classes.select("n", "s1", "s2", "rep").join(final, "rep").drop("rep")
    return rows.join(named, ["n", "s1", "s2"], "left").select("doc_id", "n", "t1", "t2", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: of the smallest doc_id, and of several such rows that of the least text hash.

    Of rows alike in doc_id and text the one whose columns have the least hash stays. Rows without
    words or without doc_id are linked with nothing and all stay. Two texts of one doc_id that no
    text of a smaller doc_id is linked with bear the same component's name, so one of them stays.
    """
    key = ["doc_id", "t1", "t2"]
    placed = durable(_components(docs, width, percent).where("n > 0 and doc_id is not null").groupBy("component_id", *key).agg(F.count("*").alias("copies")))
    best = placed.groupBy("component_id").agg(F.min(F.struct(*key, "copies")).alias("best")).select("best.*")
    text = F.col("text").cast("string")
    rows = rows_apart(docs, F.col("doc_id").cast("long").alias("doc_id"), *_text_hashes(F.coalesce(text, F.lit(""))), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    alone = rows.where("doc_id is null or not worded")
    linked = rows.where("doc_id is not null and worded")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row")))
    # repeats are rare: only they are put in order
    repeated = linked.join(best.where("copies > 1").select(*key), key).withColumn("place", place).where("place = 1")
    once = linked.join(best.where("copies = 1").select(*key), key, "left_semi")
    return alone.select("row").unionByName(once.select("row")).unionByName(repeated.select("row")).select("row.*")


#: The contract's components (four words, 85 in 100) for DuckDB: all pairs that share a shingle, then reachability.
ORACLE_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
