"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A hash turns unit vectors by three rounds of random signs and a fast Hadamard transform and takes
the signed axis nearest to them. The first table files vectors under one or two such hashes, and
each query looks into the cells nearest to it among the longest vectors; the score of its k-th find
is its floor. The second
table concatenates ``HASHES`` hashes. Its probes are ordered by the sum, over the hashes, of the
query's coordinates on a cell's axes; a query takes all cells whose sum is at least what a vector
that reaches the floor would have, less ``SLACK`` standard deviations. Only vectors of these cells
are scored, in double precision, where the cells' vectors and their queries come together. The more
vectors there are, the higher is the floor and the smaller the share that is scored.

Inner products are reduced to angles by bands of norms: within a band the norms differ by less than
the square root of two, and a band's longest vector gives the angle that the floor asks for there.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import durable

#: Hashes of the second table, and standard deviations by which a probe may fall short.
HASHES, SLACK = 8, 1.2
#: Share of a band's first cells that the first look takes, and how many vectors that should be at least.
FIRST_SHARE, FIRST_ROWS = 1 / 16, 256
#: The first look takes the bands of the longest vectors that hold this share of all, and so many at least.
BAND_SHARE, BAND_ROWS = 1 / 8, 512
#: Vectors of a group of cells on average, and vectors or queries of a group that one task takes; larger ones are split by both sides.
ROWS, PART = 4096, 8192
_CHUNK = 256


def hadamard(a: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row, in n log n steps."""
    n, h = a.shape[1], 1
    while h < n:
        b = a.reshape(len(a), -1, 2, h)
        a = np.stack([b[:, :, 0] + b[:, :, 1], b[:, :, 0] - b[:, :, 1]], 2).reshape(len(a), n)
        h *= 2
    return a / np.sqrt(n)


def padded_size(dims: int) -> int:
    return 1 << max(1, (dims - 1).bit_length())


def turned(unit: np.ndarray, table: int, number: int) -> np.ndarray:
    """Each vector's coordinates on the signed axes of one hash: all axes, then all with the other sign."""
    size = padded_size(unit.shape[1])
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    random = np.random.default_rng((7, table, number))
    for _ in range(3):
        x = hadamard(x * random.choice((-1.0, 1.0), size))
    return np.concatenate([x, -x], 1)


@functools.cache
def usual_top(size: int) -> float:
    """The mean largest coordinate of a random unit vector."""
    x = np.abs(np.random.default_rng(5).normal(size=(4000, size)))
    return float((x.max(1) / np.linalg.norm(x, axis=1)).mean())


def least_sum(cosine: np.ndarray, hashes: int, size: int) -> np.ndarray:
    """The sum of coordinates that a vector at this cosine falls below only by more than SLACK deviations."""
    c = np.clip(cosine, 0, 1)
    return hashes * usual_top(size) * c - SLACK * np.sqrt(hashes * (1 - c * c) / size)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and base-two logarithms of the norms; neither squares of tiny nor of huge components leave the range."""
    most = np.abs(x).max(1, keepdims=True)
    x = x / most
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / norm, (np.log2(most) + np.log2(norm))[:, 0]


def bands_of(log_norm: np.ndarray) -> np.ndarray:
    """Bands of norms within a factor of sqrt(2); band 0 has 1 in its middle."""
    return np.floor(2 * log_norm + 0.5).astype(np.int32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dims): one row for each id that has a nonzero vector of finite numbers.

    Of different vectors with one id the smallest in dictionary order counts.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull()).where(sound)
    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    once = rows.join(repeated, "vec_id", "left_anti")
    chosen = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return once.unionByName(chosen).withColumn("dims", F.size("embedding"))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.asarray(batch.column("dims"))
    for dims in np.unique(sizes):
        yield int(dims), batch.filter(pa.array(sizes == dims))


class Layout:
    """How the cells of each (dims, band) are put into groups: by one hash, or by two where there are many vectors."""

    def __init__(self, counts: dict[tuple[int, int], int], tops: dict[tuple[int, int], float]):
        #: Vectors of each (dims, band), and the base-two logarithm of the longest one's norm.
        self.counts, self.tops = counts, tops
        self.looked_at: set[tuple[int, int]] = set()
        for dims in {d for d, _ in counts}:
            mine = sorted((b for d, b in counts if d == dims), reverse=True)
            enough, seen = max(BAND_ROWS, BAND_SHARE * sum(counts[dims, b] for b in mine)), 0
            for band in mine:
                if seen < enough:
                    self.looked_at.add((dims, band))
                seen += counts[dims, band]

    def hashes(self, dims: int, band: int) -> int:
        return 1 if self.counts[dims, band] <= ROWS * 2 * padded_size(dims) else 2

    def cells(self, dims: int, band: int) -> int:
        return (2 * padded_size(dims)) ** self.hashes(dims, band)

    def groups(self, dims: int, band: int) -> int:
        return max(1, min(self.cells(dims, band), -(-self.counts[dims, band] // ROWS)))

    def group_of(self, cell: np.ndarray, dims: int, band: int) -> np.ndarray:
        return cell * self.groups(dims, band) // self.cells(dims, band)

    def first_cells(self, dims: int, band: int) -> int:
        """Cells that a first look takes in this band."""
        share = min(1.0, max(FIRST_SHARE, FIRST_ROWS / self.counts[dims, band]))
        return max(1, math.ceil(share * self.cells(dims, band)))


def _band_counts(base: DataFrame) -> Layout:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_dims(batch):
                log_norm = scaled(_matrix(part.column("embedding"), dims))[1]
                band, of, n = np.unique(bands_of(log_norm), return_inverse=True, return_counts=True)
                top = np.full(len(band), -np.inf)
                np.maximum.at(top, of, log_norm)
                yield pa.RecordBatch.from_pydict({"dims": pa.array([dims] * len(band), pa.int32()), "band": band, "n": n, "top": top})

    # a row for each dimension and band of norms: a few, and 4,200 for each dimension at the very most
    rows = base.select("dims", "embedding").mapInArrow(run, "dims int, band int, n long, top double").groupBy("dims", "band").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    return Layout({(r["dims"], r["band"]): r["n"] for r in rows}, {(r["dims"], r["band"]): r["top"] for r in rows})


def _filed(base: DataFrame, layout: Layout, table: int, hashes: int) -> DataFrame:
    """(dims, band, group, vec_id, embedding, codes): each vector with its axes under the table's hashes."""
    kind = base.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_dims(batch):
                unit, log_norm = scaled(_matrix(part.column("embedding"), dims))
                codes = np.stack([turned(unit, table, h).argmax(1) for h in range(hashes)], 1).astype(np.int32)
                band = bands_of(log_norm)
                group = np.empty(len(unit), np.int32)
                for b in np.unique(band).tolist():
                    at = band == b
                    cell = codes[at, 0].astype(np.int64)
                    if layout.hashes(dims, b) > 1:
                        cell = cell * 2 * padded_size(dims) + codes[at, 1]
                    group[at] = layout.group_of(cell, dims, b)
                yield pa.RecordBatch.from_arrays([part.column("dims"), pa.array(band), pa.array(group), part.column("vec_id"), part.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["dims", "band", "group", "vec_id", "embedding", "codes"])

    return base.mapInArrow(run, f"dims int, band int, group int, vec_id long, embedding {kind}, codes binary")


def _cosines(floor: np.ndarray, log_norm: np.ndarray, top: float) -> np.ndarray:
    """The cosine that a vector of a band needs to reach the floor, by its longest one's norm; -1 where there's no floor above zero."""
    good = np.isfinite(floor) & (floor > 0)
    return np.where(good, np.exp2(np.minimum(np.log2(np.where(good, floor, 1)) - log_norm - top, 9)), -1.0)


def _visits(asked: DataFrame, layout: Layout, table: int) -> DataFrame:
    """(dims, band, group, vec_id, embedding, floor): each query with the groups that it looks into.

    In the first table those of the nearest cells; in the second those whose cells can hold
    vectors that reach the floor. A query without a floor looks everywhere.
    """
    kind = asked.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_dims(batch):
                unit, log_norm = scaled(_matrix(part.column("embedding"), dims))
                axes = [turned(unit, table, h) for h in range(2)]
                floor = np.asarray(part.column("floor"), np.float64)
                for d, band in layout.counts:
                    if d != dims or (table == 0 and (d, band) not in layout.looked_at):
                        continue
                    hashes, n_groups = layout.hashes(dims, band), layout.groups(dims, band)
                    starts = np.searchsorted(layout.group_of(np.arange(layout.cells(dims, band)), dims, band), np.arange(n_groups))
                    cosine = _cosines(floor, log_norm, layout.tops[dims, band])
                    for first in range(0, len(unit), _CHUNK):
                        at = slice(first, first + _CHUNK)
                        sums = axes[0][at] if hashes == 1 else (axes[0][at, :, None] + axes[1][at, None, :]).reshape(len(unit[at]), -1)
                        if table == 0:
                            count = layout.first_cells(dims, band)
                            bar = -np.partition(-sums, count - 1, axis=1)[:, count - 1]
                        else:
                            bar = np.where(cosine[at] > 1 + 1e-9, np.inf, np.where(cosine[at] < 0, -np.inf, least_sum(cosine[at], hashes, padded_size(dims))))
                        query, group = np.nonzero(np.maximum.reduceat(sums, starts, axis=1) >= bar[:, None])
                        if len(query):
                            rows = part.take(pa.array(query + first))
                            keys = [rows.column("dims"), pa.array(np.full(len(query), band, np.int32)), pa.array(group.astype(np.int32))]
                            yield pa.RecordBatch.from_arrays([*keys, *(rows.column(c) for c in ("vec_id", "embedding", "floor"))], names=["dims", "band", "group", "vec_id", "embedding", "floor"])

    return asked.mapInArrow(run, f"dims int, band int, group int, vec_id long, embedding {kind}, floor double")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


_LISTS = "query_id long, ids array<long>, scores array<double>, n_scored long"


def _lists(query_id: list, ids: list, scores: list, n_scored: list) -> pa.Table:
    return pa.table({"query_id": pa.array(query_id, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64())), "n_scored": pa.array(n_scored, pa.int64())})


def _probed(base: DataFrame, asked: DataFrame, layout: Layout, k: int, table: int, hashes: int) -> DataFrame:
    """(query_id, ids, scores, n_scored): the k best of each query's probes in each part of each group."""
    filed, visits = _filed(base, layout, table, hashes), _visits(asked, layout, table)
    keys = ["dims", "band", "group"]

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))

    # one row for each group that has both vectors and queries
    sizes = durable(parts(filed, "parts").join(parts(visits, "asked_parts"), keys))

    def mine(n: str):
        return F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = filed.join(sizes, keys).withColumn("part", mine("parts")).withColumn("asked_part", every("asked_parts")).drop("parts", "asked_parts")
    right = visits.join(sizes, keys).withColumn("asked_part", mine("asked_parts")).withColumn("part", every("parts")).drop("parts", "asked_parts")
    first = {key: layout.first_cells(*key) for key in layout.counts}
    used = {key: layout.hashes(*key) for key in layout.counts}

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if not vectors.num_rows or not queries.num_rows:
            return _lists(*out)
        dims, band = (vectors.column(c)[0].as_py() for c in ("dims", "band"))
        size = padded_size(dims)
        ids, qs = np.asarray(vectors.column("vec_id")), np.asarray(queries.column("vec_id"))
        x, y = (_matrix(t.column("embedding"), dims) for t in (vectors, queries))
        codes = np.frombuffer(b"".join(vectors.column("codes").to_pylist()), np.int32).reshape(-1, hashes)
        deep = used[dims, band] if table == 0 else hashes
        for begin in range(0, len(qs), _CHUNK):
            some = slice(begin, begin + _CHUNK)
            unit, log_norm = scaled(y[some])
            axes = [turned(unit, table, h) for h in range(deep)]
            if table == 0:
                cells = axes[0] if deep == 1 else (axes[0][:, :, None] + axes[1][:, None, :]).reshape(len(unit), -1)
                bar = -np.partition(-cells, first[dims, band] - 1, axis=1)[:, first[dims, band] - 1] - 1e-6
            else:
                cosine = _cosines(np.asarray(queries.column("floor"), np.float64)[some], log_norm, layout.tops[dims, band])
                bar = np.where(cosine < 0, -np.inf, least_sum(cosine, hashes, size))
            sums = np.zeros((len(unit), len(ids)), np.float32)
            for h, axis in enumerate(axes):
                sums += axis.astype(np.float32)[:, codes[:, h]]
            for q, query, row, least in zip(qs[some], y[some], sums, bar, strict=True):
                at = np.flatnonzero(row >= least)
                at = at[ids[at] != q]
                if len(at):
                    # summed row by row, so that equal vectors score equally wherever they are
                    score = (x[at] * query).sum(1)
                    best = _best(ids[at], score, k)
                    for column, value in zip(out, (int(q), ids[at[best]], score[best], len(at)), strict=True):
                        column.append(value)
        return _lists(*out)

    together = [*keys, "part", "asked_part"]
    return left.groupBy(*together).cogroup(right.groupBy(*together)).applyInArrow(meet, _LISTS)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One row for each query: the k best of all its lists, each vector once."""

    def merge(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("ids").combine_chunks().flatten())
        scores = np.asarray(group.column("scores").combine_chunks().flatten())
        ids, first = np.unique(ids, return_index=True)
        at = _best(ids, scores[first], k)
        return _lists([group.column("query_id")[0].as_py()], [ids[at]], [scores[first][at]], [int(np.asarray(group.column("n_scored")).sum())])

    # a query has a row of k neighbours here for each part of a group that it looked into
    return found.groupBy("query_id").applyInArrow(merge, _LISTS)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score, n_scored): each query's k nearest by inner product among those it meets.

    ``queries`` are rows of ``vectors`` (vec_id, embedding); a row is never its own neighbour.
    Unusable vectors (null, empty, zero, with null or non-finite components, without id) take no part.
    Vectors of other dimensions are never met. Rows that repeat a vec_id are one neighbour, see
    ``usable``. Ties go to the smaller vec_id. A query whose first look finds fewer than k scores all
    rows, so with fewer candidates than k all of them come back. Other columns are ignored; an empty
    table has no result. ``n_scored`` counts the query's exactly scored candidates.
    """
    base, asked = usable(vectors), usable(queries)
    layout = _band_counts(base)
    start = asked.withColumn("floor", F.lit(None).cast("double"))
    found = durable(_merged(_probed(base, start, layout, k, 0, 2), k))
    floors = found.select(F.col("query_id").alias("vec_id"), F.when(F.size("scores") >= k, F.element_at("scores", -1)).alias("floor"))
    again = _probed(base, asked.join(floors, "vec_id", "left"), layout, k, 1, HASHES)
    best = _merged(found.unionByName(again), k).select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "near"), "n_scored")
    return best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("near.ids").alias("vec_id"), F.col("near.scores").alias("score"), "n_scored")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The query set: rows whose vec_id is divisible by ``every``, against all rows."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
