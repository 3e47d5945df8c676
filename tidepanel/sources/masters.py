"""Company masters and de-listings from files of unknown encoding: JSON first, CSV where that has no rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.parsing import registry_date
from tidepanel.sources.rest import decoded

# The fields' names in the registries' files, the first that has text counts.
MASTER_FIELDS = {"stock_id": ["公司代號", "證券代號", "股票代號"], "stock_name": ["公司簡稱", "公司名稱", "證券名稱"]}
MASTER_DATES = {"listing_date": ["上市日期", "上櫃日期", "掛牌日期"], "report_date": ["出表日期", "資料日期"]}
DELISTED_FIELDS = {"stock_id": ["上市編號", "公司代號", "證券代號"], "stock_name": ["公司名稱", "公司簡稱"]}
DELISTED_DATES = {"delisting_date": ["終止上市日期", "下市日期"]}

#: Cells of a CSV line that are looked at.
WIDEST = 64


def texts(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(name, text) of the folder's files with this ending: bytes are read and their encoding is found on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"name": [where.rsplit("/", 1)[1].removesuffix(f".{ending}")], "text": [decoded(content)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(path)
    return files.select("path", "content").mapInArrow(run, "name string, text string")


def json_records(files: DataFrame) -> DataFrame:
    """(name, record): the objects of files that hold a JSON array; any other file has none."""
    parts = files.select("name", F.explode(F.from_json("text", "array<string>")).alias("part"))
    return parts.select("name", F.from_json("part", "map<string, string>").alias("record")).where("record is not null")


def csv_records(files: DataFrame) -> DataFrame:
    """(name, record): the lines of CSV files below their header."""
    cells = lambda line: F.from_csv(line, ", ".join(f"c{i} string" for i in range(WIDEST)))
    row = lambda line: F.array(*[cells(line)[f"c{i}"] for i in range(WIDEST)])
    lines = files.select("name", F.filter(F.split("text", "\\r?\\n"), lambda x: F.trim(x) != "").alias("lines")).where("size(lines) > 1")
    parted = lines.select("name", row(F.get("lines", F.lit(0))).alias("header"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line")).select("name", "header", row(F.col("line")).alias("cells"))
    pairs = F.filter(F.arrays_zip("header", "cells"), lambda p: p["header"].isNotNull())
    return parted.select("name", F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["header"])), lambda h: F.struct(h.alias("key"), F.get("cells", (F.array_position("header", h) - 1).cast("int")).alias("value")))).alias("record"))


def _named(records: DataFrame, fields: dict[str, list[str]], dates: dict[str, list[str]]) -> DataFrame:
    plain = F.map_from_entries(F.array_distinct(F.transform(F.map_entries("record"), lambda e: F.struct(F.trim(F.replace(e["key"], F.lit("﻿"), F.lit(""))).alias("key"), e["value"].alias("value")))))
    first = lambda keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at("plain", F.lit(k))), F.lit("")) for k in keys])

    def first_date(keys: list[str]) -> Column:
        return F.coalesce(*[registry_date(F.try_element_at("plain", F.lit(k))) for k in keys])

    found = records.withColumn("plain", plain).select("name", *[first(v).alias(k) for k, v in fields.items()], *[first_date(v).alias(k) for k, v in dates.items()], F.to_json("record").alias("raw_json"))
    return found.where("stock_id is not null")


def company_master(spark: SparkSession, path: str, markets: tuple[str, ...] = ("tpex", "twse")) -> DataFrame:
    """(market, stock_id, stock_name, listing_date, report_date, raw_json, transport) of <market>.json, or <market>.csv where that gives no company.

    ``transport`` tells which it was. A market that neither file gives a company for is an error of the read.
    """
    named = lambda records: _named(records, MASTER_FIELDS, MASTER_DATES).where(F.col("name").isin(*markets))
    first = named(json_records(texts(spark, path, "json"))).withColumn("transport", F.lit("json"))
    second = named(csv_records(texts(spark, path, "csv"))).withColumn("transport", F.lit("csv_fallback"))
    whole = first.unionByName(second.join(first.select("name").distinct(), "name", "left_anti"))
    asked = spark.createDataFrame([(m,) for m in markets], "name string")
    said = F.concat(F.lit("no company of market "), "name", F.lit(" in JSON or CSV"))
    checked = asked.join(whole, "name", "left").withColumn("stock_id", F.when(F.col("stock_id").isNull(), F.raise_error(said).cast("string")).otherwise(F.col("stock_id")))
    return checked.withColumnRenamed("name", "market")


def delisted(spark: SparkSession, path: str) -> DataFrame:
    """(stock_id, stock_name, delisting_date, raw_json) of the folder's CSV files; rows without number or date are left out."""
    return _named(csv_records(texts(spark, path, "csv")), DELISTED_FIELDS, DELISTED_DATES).where("delisting_date is not null").drop("name")
