"""A corpus pipeline over ``documents``: score, clean, deduplicate, mask, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All stages but the last keep the columns of ``documents``,
whatever others there are besides doc_id and text. Null and empty texts, null and repeated doc_ids
pass through every stage by their operators' own rules; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import line_dedup, ngram_join, packing, pii, toxicity
from tidepanel.llm.common import durable, small_batches, table
from tidepanel.llm.queries import pattern, vocabulary


def _retexted(docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` with a new text and, where there is one, n_chars to match."""
    new = {"text": text} | ({"n_chars": F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return docs.withColumns(new)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; all others stay as they are, also null and empty texts."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored_rows(docs, model).where(~F.col("rejected")).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines leave all documents but their last holder; a null text stays null."""
    small_batches(spark)
    new = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    done = line_dedup.deduped_rows(docs).select(F.col("row").withField("text", new).alias("row")).select("row.*")
    return _retexted(done, F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, Jaccard 0.8) one row of the smallest doc_id stays; rows without words or doc_id all stay."""
    small_batches(spark)
    return ngram_join.keep_one(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in angle brackets; no document goes."""
    small_batches(spark)
    return _retexted(pii.mask_pii(docs), F.col("text")).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; repeated rows get places of their own, an empty text is its end token."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The model, the tokenizer and the packing are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
