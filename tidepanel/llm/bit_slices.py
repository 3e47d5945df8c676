"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bit is the majority of that bit over the hashes of a text's shingles, repeats
included. Fingerprints at most RADIUS bits apart are linked. Distinct fingerprints are filed in ten
tables, by each pair of five bit blocks: RADIUS differing bits leave two blocks equal. What shares
a key of a table is compared in blocks of lanes whose 64 bit planes are stored vertically, so that
one bitwise operation advances 64 distances; two planes at a time go through a carry-save adder
into counters of a few bits, and words of lanes that are all beyond the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import durable
from tidepanel.llm.graph import components

WIDTH, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Bits of each block; with RADIUS + 2 blocks two of them stay equal.
BLOCKS = (13, 13, 13, 13, 12)
#: Keys are put together to blocks of this many lanes, so that small buckets don't cost a call each.
LANES = 1024
#: A bucket of more than twice this many fingerprints is cut into pieces, and their pairs are compared.
PIECE = 8192
#: Shingles whose bits are spread out at once.
AT_ONCE = 1 << 16
#: 64-bit words of one comparison step.
WORDS = 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def spread(numbers: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones, the lowest bit first."""
    return np.unpackbits(numbers.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def gathered(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprint(text: str, width: int = WIDTH) -> np.uint64:
    """The majority bits of the text's shingles; 0 without words. ASCII letters are lower-cased and ASCII white space parts words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.uint64(0)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, AT_ONCE):
        votes += spread(hashes[i : i + AT_ONCE]).sum(0, dtype=np.int64)
    return gathered((votes * 2 > n).astype(np.uint8)[None])[0]


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, bits): the fingerprint of each row's whole text as a long; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py() or "", width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bits": pa.array(bits.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, bits long")


class Slices:
    """Bit planes of fingerprints: plane b, word w holds bit b of the lanes 64 w to 64 w + 63."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints.astype(np.uint64)
        self.n = len(prints)
        words = -(-self.n // 64)
        lanes = np.zeros((BITS, words * 64), np.uint8)
        lanes[:, : self.n] = spread(self.prints).T
        self.planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8").reshape(BITS, words)
        #: Lanes that hold no fingerprint count as beyond the radius from the start.
        self.unused = np.zeros(words, np.uint64)
        if self.n % 64:
            self.unused[-1] = ALL << np.uint64(self.n % 64)

    def near(self, first: int, last: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(query, lane): which lanes are within the radius of the lanes from first to last, without themselves.

        The counters begin so high that they overflow just beyond the radius; overflow stays.
        """
        queries = np.arange(first, last)
        width = max(1, radius.bit_length())
        begin = (1 << width) - 1 - radius
        turned = np.where(spread(self.prints[first:last]).T.astype(bool), ALL, np.uint64(0))[:, :, None]  # (64, queries, 1)
        query, word = np.divmod(np.arange(len(queries) * len(self.unused)), len(self.unused))
        over = np.repeat(self.unused[None], len(queries), 0)
        over[queries - first, queries // 64] |= np.uint64(1) << (queries % 64).astype(np.uint64)
        over = over.reshape(-1)
        counters = [np.full(len(over), ALL if begin >> k & 1 else 0, np.uint64) for k in range(width)]
        whole = True
        for plane in range(0, BITS, 2):
            one, two = ((self.planes[p][None] ^ turned[p]).reshape(-1) if whole else self.planes[p][word] ^ turned[p, query, 0] for p in (plane, plane + 1))
            # the lowest counter takes both differences at once, the others the carry
            mixed = one ^ two
            carry = (one & two) | (counters[0] & mixed)
            counters[0] = counters[0] ^ mixed
            for k in range(1, width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over = over | carry
            if plane % 8 == 6 and plane >= 14:
                live = np.flatnonzero(over != ALL)
                if len(live) * 2 < len(over) or not len(live):
                    whole = False
                    query, word, over = query[live], word[live], over[live]
                    counters = [c[live] for c in counters]
                    if not len(live):
                        break
        unit, lane = np.nonzero(spread(~over))
        return query[unit] + first, word[unit] * 64 + lane

    def links(self, radius: int = RADIUS) -> list[tuple[int, int]]:
        """Pairs of lanes within the radius that connect all that such pairs connect, fewer than there are lanes."""
        label, found = np.arange(self.n), []
        step = max(16, WORDS // max(1, len(self.unused)))
        for first in range(0, self.n, step):
            query, lane = self.near(first, min(first + step, self.n), radius)
            fresh = np.flatnonzero(label[query] != label[lane])
            for a in np.unique(query[fresh]):
                others = lane[query == a]
                names, at = np.unique(label[others], return_index=True)
                other = names != label[a]
                if other.any():
                    found += [(int(a), int(x)) for x in others[at[other]]]
                    label[np.isin(label, names)] = label[a]
        return found


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct ``bits`` that connect just what all pairs within the radius connect.

    A bucket's fingerprints are one group; a large one is cut by hash into pieces, and each pair of
    pieces is a group, so a task never holds more than two pieces. A group of n gives fewer than n
    links, however many pairs are near.
    """
    filed = points.select("bits", F.explode(F.array(*_keys(F.col("bits")))).alias("key"))
    large = filed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * PIECE).select("key", F.ceil(F.col("_n") / PIECE).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("bits"), F.col("pieces")).cast("int")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: j != F.col("piece")), lambda j: F.least(j, "piece").cast("long") * F.col("pieces") + F.greatest(j, "piece"))
    placed = filed.join(large, "key", "left").withColumn("piece", piece)
    groups = placed.select("bits", "key", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("pair"))
    wide = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(wide, "key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints in _blocks(batches):
            pairs = Slices(prints).links(radius)
            if pairs:
                a, b = (prints[list(x)].view(np.int64) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    return dealt.select("key", "pair", "bits").mapInArrow(run, "a long, b long").where("a <> b")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of whole groups, put together to at least LANES lanes."""
    held: list[np.ndarray] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, pair, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        bits = bits.view(np.uint64)
        starts = np.flatnonzero(np.r_[last is None or (key[0], pair[0]) != last, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
        begin = 0
        for start in starts:
            if size + start - begin >= LANES:
                held.append(bits[begin:start])
                yield np.concatenate(held)
                held, size, begin = [], 0, start
        held.append(bits[begin:])
        size += len(bits) - begin
        last = (key[-1], pair[-1])
    if size:
        yield np.concatenate(held)


def _keys(bits: Column) -> list[Column]:
    """For each pair of blocks one number: which pair it is, and the blocks' bits."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned(bits, s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in zip(starts, BLOCKS, strict=True)]
    return [F.lit(t << 26).cast("long") + F.shiftleft(block[i], 13) + block[j] for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that links of fingerprints reach, the row's own included;
    texts without words all have the fingerprint 0. Repeated rows each get their row; a null doc_id
    names no component, so that of a component without any id is null; no rows, no result. At most
    RADIUS bits: the tables find no more.
    """
    if radius > RADIUS:
        raise ValueError(f"the tables find up to {RADIUS} differing bits")
    prints = durable(fingerprints(docs, width))
    points = durable(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    reach = components(near_links(points.select("bits"), radius)).withColumnRenamed("node", "bits")
    named = points.join(reach, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(ids, "component").select("bits", "component_id")
    return prints.join(classes, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
