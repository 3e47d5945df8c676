"""Target-distribution importance resampling of documents by hashed n-grams.

Inside each task an own DuckDB database splits texts, unnests their words, takes n-grams by window
and puts them into buckets by a registered CRC function. What it counts, a row of buckets and
counts per document, is spilled to Parquet once; Spark merges it to the corpus's counts, compares
them with the target's, scores each document by its buckets' gains and draws the best with Gumbel
noise, so that the draw is a sample by importance without replacement.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import shared_folder

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Characters of texts that one query of a task's database takes; a longer text is taken in pieces.
AT_ONCE = 1 << 19

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same before letters are lower-cased
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_NEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}')"


_COUNTS = f"""
WITH split AS MATERIALIZED (SELECT id, {_words('text')} AS words, {_words('ahead')} AS next FROM texts),
words AS MATERIALIZED (SELECT id, len(words) AS own, unnest(words || next) AS w1, generate_subscripts(words || next, 1) AS place FROM split),
seen AS (SELECT id, own, place, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY place)),
grams AS MATERIALIZED (SELECT * FROM seen WHERE place <= own),
placed AS (
  SELECT id, crc(w1) % {BUCKETS} AS bucket FROM grams
  UNION ALL SELECT id, crc(w1 || ' ' || w2) % {BUCKETS} FROM grams WHERE w2 IS NOT NULL
  UNION ALL SELECT id, crc(w1 || ' ' || w2 || ' ' || w3) % {BUCKETS} FROM grams WHERE w3 IS NOT NULL),
counted AS (SELECT id, bucket, count(*) AS n FROM placed GROUP BY id, bucket),
listed AS (SELECT id, list(bucket::SMALLINT) AS buckets, list(n) AS counts, sum(n)::BIGINT AS n_features FROM counted GROUP BY id)
SELECT s.id, len(s.words)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts FROM split s LEFT JOIN listed USING (id) ORDER BY s.id
"""
_SPILLED = "doc_id long, n_words long, n_features long, buckets array<smallint>, counts array<long>"


def crc(texts) -> pa.Array:
    """The unsigned CRC of each text's UTF-8 bytes."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    of = [np.fromiter(map(zlib.crc32, c.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.int64, len(c)) for c in chunks]
    return pa.array(np.concatenate(of) if of else np.zeros(0, np.int64))


@contextmanager
def _database():
    """A database in memory; it is closed with the task, as workers live on."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    try:
        db.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
        yield db
    finally:
        db.remove_function("crc")
        db.close()


def _pieces(text: str) -> Iterator[tuple[str, str]]:
    """The text by about AT_ONCE characters, cut beside words, each piece with the words that its last n-grams reach into."""
    begin = 0
    while begin < len(text):
        gap = _GAP.search(text, begin + AT_ONCE)
        end = gap.start() if gap else len(text)
        yield text[begin:end], " ".join(w[0] for w in islice(_NEXT.finditer(text, end), LONGEST - 1))
        begin = end


def _counts(db, texts: list[str], ahead: list[str]) -> pa.Table:
    """(id, n_words, n_features, buckets, counts), a row for each text in order."""
    db.register("texts", pa.table({"id": pa.array(range(len(texts)), pa.int32()), "text": pa.array(texts, pa.large_string()), "ahead": ahead}))
    found = db.sql(_COUNTS).to_arrow_table()
    db.unregister("texts")
    return found


def _whole(db, text: str) -> pa.Table:
    """The row of one long text: its pieces' counts added up."""
    words, sums = 0, np.zeros(BUCKETS, np.int64)
    for piece, ahead in _pieces(text):
        found = _counts(db, [piece], [ahead])
        words += found["n_words"][0].as_py()
        np.add.at(sums, np.array(found["buckets"][0].as_py(), np.int64), np.array(found["counts"][0].as_py(), np.int64))
    used = np.flatnonzero(sums)
    return pa.table({"id": [0], "n_words": [words], "n_features": [int(sums.sum())], "buckets": pa.array([used.tolist()], pa.list_(pa.int16())), "counts": pa.array([sums[used].tolist()], pa.list_(pa.int64()))})


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts): a row for each (doc_id, text), with the buckets it uses, BUCKETS at most."""

    def record(ids: list, found: pa.Table) -> pa.RecordBatch:
        column = lambda c, of: found[c].combine_chunks().cast(of)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": column("n_words", pa.int64()), "n_features": column("n_features", pa.int64()), "buckets": column("buckets", pa.list_(pa.int16())), "counts": column("counts", pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            ids, texts, size = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = text or ""
                    if len(text) > AT_ONCE:
                        yield record([doc_id], _whole(db, text))
                        continue
                    if texts and size + len(text) > AT_ONCE:
                        yield record(ids, _counts(db, texts, [""] * len(texts)))
                        ids, texts, size = [], [], 0
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
            if texts:
                yield record(ids, _counts(db, texts, [""] * len(texts)))

    return docs.mapInArrow(run, _SPILLED)


def spilled(docs: DataFrame) -> DataFrame:
    """``counted``, written as Parquet in the shared folder and read back: texts are counted once and no lineage is kept."""
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/bucket_counts_{uuid.uuid4().hex}"
    counted(docs).write.parquet(place)
    return spark.read.schema(_SPILLED).parquet(place)


def merged(spill: DataFrame) -> DataFrame:
    """(bucket, n) over all rows."""
    pairs = spill.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").cast("int").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """What each bucket adds to a document's weight: a thousand times the log ratio of smoothed shares, rounded down.

    Two tables of at most BUCKETS rows are all that reaches the driver.
    """
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, df in ((s, corpus), (t, target)):
        for bucket, n in df.collect():
            counts[bucket] = n
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def scored(spill: DataFrame, of_bucket: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): weights are sums of gains, scores add Gumbel noise from the id's checksum."""
    spark = spill.sparkSession
    table = F.broadcast(spark.createDataFrame([(of_bucket,)], "gains array<long>"))  # one row of BUCKETS numbers
    weight = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: n * F.get("gains", b)), F.lit(0).cast("long"), lambda a, x: a + x)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return spill.crossJoin(table).select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows with rank: 1, 2, ... for the drawn ones by score, ties by smaller doc_id, and null for the others.

    Scores are cut into ranges at approximate quantiles. Ranges above the last drawn row are
    numbered by a window each and their sizes summed on the driver, a number for each range.
    """
    spark = rows.sparkSession
    n = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    open_ = F.col("n_words") >= least_words
    cuts = rows.where(open_).agg(F.percentile_approx("score", [i / n for i in range(1, n)], 20 * n)).first()[0]
    cuts = sorted(set(cuts or ()))
    top = 1 << len(cuts).bit_length()
    steps, bounds = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())]), F.array(*[F.lit(c).cast("long") for c in cuts])
    bisected = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.lit(len(cuts))) & (F.get(bounds, low + step - 1) <= F.col("score")), low + step).otherwise(low)) if cuts else F.lit(0)
    placed = rows.withColumn("range", F.when(open_, bisected).otherwise(-1))
    sizes = {r["range"]: r["n"] for r in placed.where("range >= 0").groupBy("range").agg(F.count("*").alias("n")).collect()}
    draw, ahead, before = percent * sum(sizes.values()) // 100, {}, 0
    for r in sorted(sizes, reverse=True):
        if before < draw:
            ahead[r] = before
        before += sizes[r]
    least = min(ahead, default=len(cuts) + 1)
    offsets = F.array(*[F.lit(ahead.get(least + i, 0)).cast("long") for i in range(len(cuts) + 1 - least)]) if ahead else F.array().cast("array<long>")
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())) + F.get(offsets, F.col("range") - least)
    drawn = placed.where(F.col("range") >= least).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(placed.where(F.col("range") < least).withColumn("rank", F.lit(None).cast("long"))).drop("range")


def resample(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``, drawn towards the distribution of ``target``'s texts.

    Null and empty texts have no features and weight 0; a null doc_id takes its noise from no id and
    comes last among equal scores; repeated rows each get their row and their rank; a corpus of too
    few long documents draws none; no rows, no result. Very long texts are counted whole.
    """
    spark = docs.sparkSession
    spill = spilled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    wanted = counted(target.select(F.lit(0).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    rows = scored(spill, gains(merged(spill), merged(wanted)))
    place = f"{shared_folder(spark)}/scores_{uuid.uuid4().hex}"
    rows.write.parquet(place)
    return ranked(spark.read.schema(rows.schema).parquet(place)).select("doc_id", "n_features", "weight", "score", "rank")


_EIGHT = "list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_DIGIT = "instr('123456789ABCDEF', h[%s])"


def _grams(table: str, key: str) -> str:
    """(id, feature) of a table's texts; a feature that can't be, at a text's end, is null."""
    lists = f"SELECT {key} AS id, {_words(table + '.text')} AS ws FROM {table}"
    at = lambda k: f"list_transform(range(1, len(ws) + 2 - {k}), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))"
    return f"SELECT id, unnest(flatten([{', '.join(at(k) for k in range(1, LONGEST + 1))}])) AS f FROM ({lists})"


# Checksums by a table of 256 entries over the bytes of each distinct feature.
ORACLE_SQL = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {_EIGHT} AS v FROM range(256) r(i))),
d AS MATERIALIZED ({_grams('documents', 'doc_id')}), b AS MATERIALIZED ({_grams('benchmark', 'item_id')}),
bytes AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: {_DIGIT % 'i'} * 16 + {_DIGIT % 'i + 1'}) AS v FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM b))),
codes AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, v), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM d JOIN codes USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM b JOIN codes USING (f) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + {BUCKETS}) / ((s.n + 1)::DOUBLE * (sums.t + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
weighed AS (SELECT id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM d JOIN codes USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len({_words('text')}) AS n_words,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id::VARCHAR)[:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weighed ON id = doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
