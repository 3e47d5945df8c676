"""Queries of the corpus operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import ann, bit_slices, bpe, chat, line_dedup, ngram_join, packing, pii, repair, resampling, secret_scan, simhash, toxicity
from tidepanel.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document. Null and empty texts score the base rate; repeated rows, null ids and clashing columns do no harm; ties in the sample's order go by doc_id; no rows, no result."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every 20th vector. Null, zero and non-finite vectors and null ids take no part; a repeated id has its smallest vector; ties go to smaller ids; no rows, no result; other columns are ignored."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, one rendered turn a row. Null roles are unknown and null texts empty; repeated rows count once; a null conv_id is left out; equal logs leave the smallest id; no rows, no result; other columns are ignored."""
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document. Null and empty texts are linked with nothing; repeated rows get a row each; a null doc_id has no component; long texts are read whole; no rows, no result; other columns are ignored."""
    return ngram_join.components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. A null text is empty; equal doc_ids are put in order by their texts; long texts are read whole; no rows, no result; other columns are ignored."""
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text. A null text is empty and has no ids; repeated rows get a row each; long words are coded in blocks, whole; no rows, no result; other columns are ignored."""
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text. A null text is empty; spans that start together stand in the order of kinds; repeated rows get a row each; long texts are read whole; no rows, no result; other columns are ignored."""
    return secret_scan.secrets_digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of every text. A null or empty text is one empty line; rows with the same doc_id count once each and keep their lines together; a null doc_id loses nothing; long texts are read whole; no rows, no result; other columns are ignored."""
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text. A null text is empty; spans that start together stand in the order of kinds; repeated rows get a row each; long texts are read whole; no rows, no result; other columns are ignored."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequence. A null text is empty and gives its end token; repeated rows get places of their own, null ids as well; long texts are cut, whole; no rows, no result; other columns are ignored."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation. Nulls are one space; a null conv_id is a conversation and null turns come first; rows of a turn stand by role and text, equal ones count each; long texts are read whole; no rows, no result; other columns are ignored."""
    return repair.repair_digest(table(spark, sf_dir, "conversations"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have the fingerprint 0 and are linked like others; repeated rows get a row each; a null doc_id names no component; long texts are read whole; no rows, no result; other columns are ignored."""
    return bit_slices.near_duplicates(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark's texts. Null and empty texts weigh 0; repeated rows get a row and a rank each; a null doc_id comes last among equal scores; long texts are counted whole; no rows, no result; other columns are ignored."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_ann, op3_chat, op4_ngram_join, op5_simhash, op6_bpe, op7_secrets, op8_line_dedup, op9_pii, op10_packing, op11_repair, op12_simhash_dedup, op13_resampling)
}

ORACLE_SQL: dict[str, str] = {"op3_chat": chat.ORACLE_SQL, "op4_ngram_join": ngram_join.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op11_repair": repair.ORACLE_SQL, "op13_resampling": resampling.ORACLE_SQL}
