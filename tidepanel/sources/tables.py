"""Table maintenance as DataFrame rewrites: upsert, insert-or-ignore, range replace, partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Rows of both by key; the highest sequence wins, and of equal ones the new row."""
    names = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(sequence, "_new")).alias("_r"))
    return best.select(*[k for k in keys], *[F.col("_r")[n].alias(n) for n in names]).select(*old.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys))


def replace_range(old: DataFrame, new: DataFrame, column: str, first, last, source: str | None = None) -> DataFrame:
    """``new`` in place of the old rows of a range (and source)."""
    hit = F.col(column).between(F.lit(first), F.lit(last))
    if source is not None:
        hit = hit & (F.col("source") == source)
    return old.where(~F.coalesce(hit, F.lit(False))).unionByName(new)


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition columns; only the partitions present in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by the file system that Spark itself uses for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
