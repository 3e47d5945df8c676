"""Repeated lines: a sharded minimal perfect hash over the repeated keys, probed by each document.

Keys are counted in one map-side-combined aggregation of 128-bit hashes. The keys that reach the
threshold are dealt into shards; each shard becomes a bit-level minimal perfect hash whose slots
index a fingerprint, a count and a last-holder array. While the built shards together stay under
``BROADCAST_BYTES`` every task gets them and documents probe them in place, so the texts are
never shuffled. Above it, documents send the hashes of their own lines to the shards, streaming
past their arrays, and only the hits return; the result is the same.

Counting is an aggregation, as a hash over all distinct lines would hold mostly lines that occur
once: only keys that reach the threshold are worth a slot.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import beside_rows, durable, rows_apart

MIN_CHARS, MIN_DOCS = 40, 5
#: All shards together may be this large, as measured, to be broadcast.
BROADCAST_BYTES = 48 << 20
#: Keys in a shard, and lines that a task sends past a shard, on average.
SHARD_KEYS, TASK_LINES = 200_000, 4_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct uint64 keys: n keys map onto 0..n-1 without gaps.

    Level by level, keys that are alone at their bit keep it and the others go on to the next,
    smaller level; a key's slot is the number of bits set before its own.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base, rest = 0, keys
        while len(rest):
            size = int(len(rest) * gamma) + 64
            at = (_mix(rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone, dtype=np.int32)
            self.levels.append((alone, rank + np.int32(base - 1)))
            base += int(alone.sum())
            rest = rest[~alone[at]]
        self.n = base

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a key falls through every level (then it's no member)."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = (_mix(keys[todo], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out


class Shard:
    """One shard's arrays, all indexed by the perfect hash."""

    def __init__(self, low: np.ndarray, high: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.hash = PerfectHash(low)
        slot = self.hash.slots(low)
        self.fingerprint = np.empty(len(low), np.uint64)
        self.count = np.empty(len(low), np.int32)
        self.last = np.empty(len(low), np.int64)
        self.fingerprint[slot], self.count[slot], self.last[slot] = high, np.minimum(count, 2**31 - 1), last

    def probe(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is a member, and its last holder (meaningless where it isn't)."""
        if not len(self.fingerprint):
            return np.zeros(len(low), bool), np.zeros(len(low), np.int64)
        slot = self.hash.slots(low)
        member = (slot >= 0) & (self.fingerprint[slot] == high)
        return member, self.last[slot]


def keyed(line: bytes) -> bytes | None:
    """The line's key if it is long enough: bytes.strip() and bytes.lower() are ASCII only, as wanted."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def _hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the lines that have a key, and the two halves of their hashes."""
    digest, at = xxhash.xxh3_128_digest, []
    joined = bytearray()
    for i, line in enumerate(lines):
        key = keyed(line)
        if key is not None:
            at.append(i)
            joined += digest(key)
    both = np.frombuffer(bytes(joined), np.uint64).reshape(-1, 2)
    return np.array(at, np.int64), both[:, 0], both[:, 1]


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(low, high, n_docs, last_doc): keys that ``min_docs`` documents hold, with the largest doc_id.

    Each task first adds up its own batches' keys, then Spark combines them map-side and by key,
    so a line of every document costs one row per task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, ids = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or doc_id is None or len(text) < MIN_CHARS:
                    continue
                _, low, high = _hashes(_lines(text))
                if len(low):
                    both = np.unique(np.stack([low, high], 1), axis=0) if len(low) > 1 else np.stack([low, high], 1)
                    lows.append(both[:, 0])
                    highs.append(both[:, 1])
                    ids.append(np.full(len(both), doc_id, np.int64))
            if not lows:
                continue
            low, high, ids = np.concatenate(lows), np.concatenate(highs), np.concatenate(ids)
            order = np.lexsort((ids, high, low))
            low, high, ids = low[order], high[order], ids[order]
            new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            ends = np.r_[new[1:], len(low)]
            yield pa.RecordBatch.from_pydict({"low": low[new].view(np.int64), "high": high[new].view(np.int64), "n": ends - new, "last": ids[ends - 1]})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "low long, high long, n long, last long")
    return found.groupBy("low", "high").agg(F.sum("n").alias("n_docs"), F.max("last").alias("last_doc")).where(F.col("n_docs") >= min_docs)


def _rewritten(ids: list, texts: list, drops) -> tuple[list, list, list]:
    """Lines, dropped lines and kept text of each document; drops(low, high, doc ids) says which keyed lines go."""
    split = [_lines(t) for t in texts]
    parts = [_hashes(s) if i is not None else (np.empty(0, np.int64),) + (np.empty(0, np.uint64),) * 2 for i, s in zip(ids, split, strict=True)]
    owner = np.repeat(np.array([-1 if i is None else i for i in ids], np.int64), [len(p[0]) for p in parts])
    gone = drops(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), owner)
    kept, dropped, done = [], [], 0
    for lines, (at, _, _) in zip(split, parts, strict=True):
        mine = gone[done : done + len(at)]
        done += len(at)
        if mine.any():
            out = set(at[mine].tolist())
            kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in out))
            dropped.append(len(out))
        else:
            kept.append(b"\n".join(lines))
            dropped.append(0)
    return [len(s) for s in split], dropped, kept


def _shard(n_shards: int):
    return F.pmod(F.shiftright("low", 7), F.lit(n_shards)).cast("int").alias("shard")


def build_shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, arrays): each shard's pickled arrays, built where its keys meet."""

    def build(group: pa.Table) -> pa.Table:
        low, high = (np.asarray(group.column(c), np.int64).view(np.uint64) for c in ("low", "high"))
        n_docs, last = (np.asarray(group.column(c), np.int64) for c in ("n_docs", "last_doc"))
        # two keys that agree in the first half only (about n**2 / 2**65 of them) are told apart by a spare shard
        first = np.zeros(len(low), bool)
        first[np.unique(low, return_index=True)[1]] = True
        made = [Shard(low[m], high[m], n_docs[m], last[m]) for m in (first, ~first)]
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "arrays": pa.array([pickle.dumps(made)], pa.binary())})

    return keys.select(_shard(n_shards), "*").groupBy("shard").applyInArrow(build, "shard int, arrays binary")


def _probing(low: np.ndarray, high: np.ndarray, shards: dict, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    member, last = np.zeros(len(low), bool), np.zeros(len(low), np.int64)
    where = (low.view(np.int64) >> np.int64(7)) % n_shards
    for shard, pair in shards.items():
        at = np.flatnonzero(where == shard)
        for one in pair if len(at) else ():
            hit, holder = one.probe(low[at], high[at])
            member[at[hit]], last[at[hit]] = True, holder[hit]
    return member, last


ADDED = ("n_lines", "n_dropped", "kept")


def deduped_rows(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of ``docs`` as a struct beside its counts and kept lines."""
    keys = durable(repeated_keys(docs, min_docs))
    n_shards = max(1, -(-keys.count() // SHARD_KEYS))
    shards = durable(build_shards(keys, n_shards))
    rows = rows_apart(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    size = shards.agg(F.sum(F.length("arrays"))).first()[0] or 0
    if size > broadcast_bytes:
        return _by_shards(rows, shards, n_shards, schema)
    sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: pickle.loads(bytes(r["arrays"])) for r in shards.collect()})  # broadcast_bytes at most

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def drops(low, high, owner):
            member, last = _probing(low, high, sent.value, n_shards)
            return member & (last != owner)

        for batch in batches:
            if batch.num_rows:
                yield _finished(batch, *_rewritten(batch.column(1).to_pylist(), batch.column(2).to_pylist(), drops))

    return rows.mapInArrow(here, schema)


def _finished(batch: pa.RecordBatch, lines: list, dropped: list, kept: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", *ADDED])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents' columns, with n_lines, n_dropped and kept (the text's kept lines).

    A line goes if its key (stripped, A-Z lower-cased, 40 code points or more) is in ``min_docs``
    documents and this isn't the largest doc_id that holds it. Null or empty texts are one empty
    line. A row is a document: rows that repeat a doc_id count once each, and if theirs is the
    largest id all of them keep the line. Rows without doc_id are not counted and lose nothing.
    Very long texts and lines are read whole. A column of ``docs`` named like an added one gives
    way to it; an empty table stays empty.
    """
    return beside_rows(deduped_rows(docs, min_docs, broadcast_bytes), ADDED)


def _by_shards(rows: DataFrame, shards: DataFrame, n_shards: int, schema: T.StructType) -> DataFrame:
    """The way beyond the broadcast bound: line hashes travel to the shards, hits return to their rows.

    The lines are dealt by shard and salt, with as many salts as the number of lines asks for, so
    that a line of very many documents is spread; every salt of a shard gets a copy of its arrays,
    which come first in its group, and the lines stream past them.
    """
    rows = durable(rows.withColumn("id", F.monotonically_increasing_id()))
    # a keyed line has MIN_CHARS characters at least
    most = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // MIN_CHARS
    salts = max(1, -(-most // (TASK_LINES * n_shards)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, row, lows, highs = [], [], [], []
            for r, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id is not None and text is not None:
                    _, low, high = _hashes(_lines(text))
                    lows.append(low)
                    highs.append(high)
                    owner.append(np.full(len(low), doc_id, np.int64))
                    row.append(np.full(len(low), r, np.int64))
            if lows:
                yield pa.RecordBatch.from_pydict({"id": np.concatenate(row), "owner": np.concatenate(owner), "low": np.concatenate(lows).view(np.int64), "high": np.concatenate(highs).view(np.int64)})

    lines = rows.select("id", "doc_id", "text").mapInArrow(emit, "id long, owner long, low long, high long").distinct()
    lines = lines.select(_shard(n_shards), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "id", "owner", "low", "high", F.lit(None).cast("binary").alias("arrays"))
    copies = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *[F.lit(None).cast("long").alias(c) for c in ("id", "owner", "low", "high")], "arrays")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict = {}
        for batch in batches:
            places = np.flatnonzero(np.asarray(batch.column("arrays").is_valid())).tolist()
            for begin, end in zip([-1, *places], [*places, batch.num_rows], strict=True):
                # a shard's arrays are followed by its lines, maybe over several batches
                if begin >= 0:
                    shard = {batch.column("shard")[begin].as_py(): pickle.loads(batch.column("arrays")[begin].as_py())}
                part = batch.slice(begin + 1, end - begin - 1)
                if part.num_rows:
                    low, high = (np.asarray(part.column(c), np.int64).view(np.uint64) for c in ("low", "high"))
                    member, last = _probing(low, high, shard, n_shards)
                    hit = pa.array(member & (last != np.asarray(part.column("owner"))))
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(hit) for c in ("id", "low", "high")], names=["id", "low", "high"])

    dealt = lines.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
    hits = dealt.mapInArrow(probe, "id long, low long, high long")
    per_row = hits.groupBy("id").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    joined = rows.join(per_row, "id", "left").select("row", "doc_id", "text", "lows", "highs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: tuple[list, list, list] = ([], [], [])
            for i, t, a, b in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                gone = set(zip(a or (), b or (), strict=True))
                one = _rewritten([i], [t], lambda low, high, _, gone=gone: np.array([x in gone for x in zip(low.view(np.int64).tolist(), high.view(np.int64).tolist(), strict=True)], bool))
                for whole, part in zip(made, one, strict=True):
                    whole += part
            yield _finished(batch, *made)

    return joined.mapInArrow(finish, schema)


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, one row for each input row; see ``dedup_lines`` for odd rows."""
    done = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (SELECT id, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT id) >= 5),
marked AS (SELECT k.*, coalesce(r.last <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY id, doc_id
"""
