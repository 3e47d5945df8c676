"""Chat logs: collapse cumulative snapshots to maximal conversations, then render their turns.

Services log a conversation again after every turn, so a shorter log is a prefix of a longer one.
A log's prefix digests are running sums of position-keyed turn hashes. A log whose own digest is a
prefix digest of a longer log goes by anti-join; of equal logs the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import durable

#: Turns whose numbers agree in their quotient by this are summed together first.
CHUNK = 64
LANES = ("d0", "d1", "d2", "d3")


def _lanes(*parts: Column) -> list[Column]:
    """Four 32-bit numbers, two from each of two seeds of a 64-bit hash: their sums can't overflow."""
    out = []
    for seed in (11, 29):
        h = F.xxhash64(F.lit(seed), *parts)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def turns_with_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, d0..d3): each turn with the digest of the log up to it.

    Order is by turn, then role and text; exact repeats of a row count once; a null turn comes
    first, null role or text are values of their own; rows without conv_id are no conversation.
    A log that holds a large share of all rows is summed by chunks of turn numbers, so that no
    window or task holds a whole log.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(2**62))))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = rows.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["conv_id", "chunk"]).withColumn("position", F.col("start") + F.col("place"))
    hashed = placed.select("conv_id", "chunk", "position", "role", "text", *[c.alias(n) for n, c in zip(LANES, _lanes("position", F.coalesce(F.xxhash64("role"), F.lit(0)), F.col("role").isNull(), "text", F.col("text").isNull()), strict=True)])
    hashed = durable(hashed)
    sums = hashed.groupBy("conv_id", "chunk").agg(*[F.sum(n).alias(n) for n in LANES])
    before = sums.select("conv_id", "chunk", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"before_{n}") for n in LANES])
    running = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.select("conv_id", "chunk", "position", "role", "text", *[F.sum(n).over(running).alias(n) for n in LANES])
    return local.join(before, ["conv_id", "chunk"]).select("conv_id", "position", "role", "text", *[(F.col(n) + F.col(f"before_{n}")).alias(n) for n in LANES])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns): the logs that no longer log continues, one of each set of equal logs.

    A prefix that very many logs share, such as one first turn, is one row after the map-side
    combined aggregation.
    """
    key = ["n_turns", *LANES]
    last = turns.groupBy("conv_id").agg(F.max(F.struct((F.col("position") + 1).alias("n_turns"), *LANES)).alias("end")).select("conv_id", "end.*")
    whole = last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    lengths = last.select("conv_id", F.col("n_turns").alias("total"))
    prefixes = turns.join(lengths, "conv_id").where("position + 1 < total").select((F.col("position") + 1).alias("n_turns"), *LANES).groupBy(*key).agg(F.count("*").alias("shared_by"))
    return whole.join(prefixes, key, "left_anti").select("conv_id", "n_turns")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """The maximal conversations as rendered turns: conv_id, position, n_turns, rendered.

    A conversation's text is its rendered turns joined in order. It stays one row per turn, as a
    single log may be larger than a task can hold.
    """
    turns = durable(turns_with_prefixes(conversations))
    kept = maximal(turns)
    return turns.join(kept, "conv_id").select("conv_id", F.col("position").cast("long").alias("position"), F.col("n_turns").cast("long").alias("n_turns"), rendered(F.col("role"), F.col("text")).alias("rendered"))


ORACLE_SQL = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM rows),
prefixed AS (
  SELECT *, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM placed),
whole AS (SELECT prefix, n_turns, min(conv_id) AS conv_id FROM prefixed WHERE position = n_turns - 1 GROUP BY 1, 2),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixed WHERE position < n_turns - 1))
SELECT p.conv_id, p.position, p.n_turns, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS rendered
FROM placed p JOIN kept USING (conv_id)
"""
