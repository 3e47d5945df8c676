"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch: a worker holds a batch several times over, as columns, as texts and as results.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless its user has chosen another bound than the default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in ``spark.checkpoint.dir``, and only where that is unset, as in tests, one in its warehouse, which executors share as well."""
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return place or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def rows_apart(docs: DataFrame, *needed) -> DataFrame:
    """Each row whole, as a struct named row, beside the columns that an operator reads: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)


def beside_rows(done: DataFrame, added: tuple[str, ...]) -> DataFrame:
    """The rows' columns and the added ones; of equal names (in any case) the added column stays."""
    taken = {a.lower() for a in added}
    return done.select(*[F.col("row")[c].alias(c) for c in done.schema["row"].dataType.names if c.lower() not in taken], *added)


def map_documents(docs: DataFrame, work: Callable[[list, list], dict], schema: str) -> DataFrame:
    """Run ``work(ids, texts)`` over Arrow batches of (doc_id, text); a null text counts as empty.

    Only these two columns reach Python, so extra columns with any names do no harm.
    """
    fields = [f.split()[0] for f in schema.split(", ")] if "<" not in schema else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = work(ids, texts)
            yield pa.RecordBatch.from_pydict(out if fields is None else {f: out[f] for f in fields})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
