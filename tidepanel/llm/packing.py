"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Only a histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) reaches the
driver. There the heuristic packs lengths instead of documents: it yields patterns, each a list
of lengths with the number of sequences that use it. Pieces are numbered within their length by
bounded windows, and a join with the patterns' slot ranges gives each its sequence and offset.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import durable

CAPACITY, END_ID = 1024, 2
_SPECIAL = "<|endoftext|>"


def _coder(vocabulary: str, ranks: str, pattern: str):
    """ids(text) as the tokenizer file gives them.

    The rank file holds the same vocabulary and is several times faster; a text with the special
    token's string, which only the tokenizer file knows, goes to that. Their equality is tested.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    whole: list = []

    def ids(text: str) -> np.ndarray:
        if _SPECIAL in text:
            whole or whole.append(Tokenizer.from_file(vocabulary))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return ids


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: of more than ``capacity`` ids the first takes the remainder."""
    first = length % capacity or capacity
    return [(0, length)] if length <= capacity else [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is empty, its only id the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _coder(vocabulary, ranks, pattern)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(END_ID)).astype("<u4")
                for i, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for k, v in zip(out, (doc_id, i, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(sequences, lengths)]: patterns that pack all ``counts`` (length -> pieces).

    Small pieces that are spent early are missed later, so it's done twice, replacing whenever two
    fit better and only when they fill the gap whole; the plan with fewer sequences is taken.
    """
    return min((_two_fit(counts, capacity, whole) for whole in (False, True)), key=lambda made: sum(times for times, _ in made))


def _two_fit(counts: dict[int, int], capacity: int, only_whole: bool) -> list[tuple[int, list[int]]]:
    """One pass of the heuristic.

    A sequence is filled greedily: the largest piece left, then again and again the largest that
    fits. Then its smallest piece is replaced by the two unpacked pieces that fill the widened gap
    best, if they fill it better. The same sequence is made as often as its lengths last; so a
    step uses up a length and there are a few thousand steps at most, whatever the counts are.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made = []
    while left.any():
        have = left.copy()
        chosen, gap = [], capacity
        while gap > 0:
            fits = np.flatnonzero(have[1 : gap + 1])
            if not len(fits):
                break
            take = int(fits[-1]) + 1
            chosen.append(take)
            have[take] -= 1
            gap -= take
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            room = gap + smallest
            first = np.flatnonzero(have[1 : room + 1]) + 1
            largest = np.maximum.accumulate(np.where(have[: room + 1] > 0, np.arange(room + 1), 0))
            mate = largest[room - first]
            single = (mate == first) & (have[first] < 2)
            mate = np.where(single, largest[np.maximum(first - 1, 0)], mate)
            both = np.where(mate > 0, first + mate, 0)
            if len(both) and both.max() > smallest and (both.max() == room or not only_whole):
                i = int(both.argmax())
                chosen[-1:] = sorted((int(first[i]), int(mate[i])), reverse=True)
        need = np.bincount(chosen, minlength=capacity + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left -= need * times
        made.append((times, chosen))
    return made


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; ``cut`` holds doc_id, piece, length at least and must be durable.

    Pieces of one length are numbered through in two steps, by hash buckets and within them, so
    no window holds a whole length: a length that a third of all pieces share is spread out.
    Repeated rows get places of their own; a null doc_id is a value like others.
    """
    spark = cut.sparkSession
    buckets = 16 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, sequence, seen = [], 0, dict.fromkeys(counts, 0)
    for times, lengths in best_two_fit(counts, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, seen[length], seen[length] + times, sequence, offset))
            seen[length] += times
            offset += length
        sequence += times
    return _placed(spark, cut, slots, buckets)


def _placed(spark, cut: DataFrame, slots: list, buckets: int) -> DataFrame:
    """Number the pieces of each length and look up the slot that holds each number.

    The slots are a few thousand rows, bounded by the capacity; sorted arrays of them, one per
    length, are searched by bisection in the plan.
    """
    by_length: dict[int, list] = {}
    for length, begin, _, sequence, offset in slots:
        by_length.setdefault(length, []).append((begin, sequence, offset))
    table = spark.createDataFrame([(k, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for k, v in by_length.items()], "length long, begins array<long>, sequences array<long>, offsets array<long>")
    bucketed = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece")
    numbered = bucketed.withColumn("_r", F.row_number().over(order) - 1).join(before, ["length", "_b"]).withColumn("_i", F.col("_before") + F.col("_r"))
    steps = F.array(*[F.lit(2**k) for k in range(15, -1, -1)])
    found = numbered.join(F.broadcast(table), "length").withColumn(
        "_s",
        F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size("begins")) & (F.get("begins", low + step - 1) <= F.col("_i")), low + step).otherwise(low)) - 1,
    )
    keep = [c for c in cut.columns]
    return found.select(
        *keep,
        (F.get("sequences", F.col("_s")) + F.col("_i") - F.get("begins", F.col("_s"))).alias("sequence_id"),
        F.get("offsets", F.col("_s")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(durable(pieces(docs, vocabulary, ranks, pattern, capacity)), capacity)
