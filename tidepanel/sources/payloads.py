"""Vendor payloads (JSON of fields and data, or positional rows) to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.parsing import number

PAYLOAD = "struct<tables: array<struct<fields: array<string>, data: array<array<string>>>>, fields: array<string>, data: array<array<string>>, aaData: array<array<string>>, stat: string>"
#: Fixed positions in positional rows: code, name, close, open, high, low, shares, money; and the three actors' buy, sell, net.
QUOTE_AT = {"code": 0, "name": 1, "close": 2, "open": 4, "high": 5, "low": 6, "shares": 7, "money": 8}
FLOW_NET_AT = {"foreign_net": 10, "trust_net": 13, "dealer_net": 16}


def parsed(payload: Column) -> Column:
    return F.from_json(payload, PAYLOAD)


def shredded(payloads: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """(id, one text column per name): rows of payloads of (id, payload), by field names.

    A table's rows come from ``tables``, else from top-level fields and data. A name is found by
    the first of its aliases that the fields hold.
    """
    p = payloads.select("id", parsed(F.col("payload")).alias("p"))
    whole = F.when(F.size(F.coalesce("p.tables", F.array().cast("array<struct<fields: array<string>, data: array<array<string>>>>"))) > 0, F.col("p.tables")).otherwise(F.array(F.struct(F.col("p.fields").alias("fields"), F.col("p.data").alias("data"))))
    good = F.col("p").isNotNull() & (F.upper(F.coalesce("p.stat", F.lit("OK"))) == "OK")  # asked inside explode, as a filter would parse again
    tables = p.select("id", F.explode(F.when(good, whole)).alias("t")).select("id", F.transform("t.fields", lambda f: F.trim(f)).alias("f"), F.col("t.data").alias("data")).where("f is not null")
    at = lambda aliases: F.coalesce(*[F.nullif(F.array_position("f", a), F.lit(0)) for a in aliases])
    # places are found once a table, and a row takes along these numbers, not its table
    rows = tables.select("id", "data", *[(at(v) - 1).cast("int").alias(f"_{k}") for k, v in names.items()]).select("id", *[f"_{k}" for k in names], F.explode("data").alias("row"))
    return rows.select("id", *[F.get("row", F.col(f"_{k}")).alias(k) for k in names])


def positional_quotes(payloads: DataFrame) -> DataFrame:
    """Quotes of ``aaData`` rows with ten cells or more."""
    rows = payloads.select("id", F.explode(parsed(F.col("payload"))["aaData"]).alias("r")).where(F.size("r") >= 10)
    text = {k: F.trim(F.get("r", F.lit(i))) for k, i in QUOTE_AT.items()}
    return rows.select("id", *[(v if k in ("code", "name") else number(v)).alias(k) for k, v in text.items()])


def positional_flows(payloads: DataFrame) -> DataFrame:
    """Net flows of ``aaData`` rows with seventeen cells or more and a code of four to six letters or digits."""
    rows = payloads.select("id", F.explode(parsed(F.col("payload"))["aaData"]).alias("r")).where((F.size("r") >= 17) & F.trim(F.get("r", F.lit(0))).rlike("^[0-9A-Za-z]{4,6}$"))
    return rows.select("id", F.trim(F.get("r", F.lit(0))).alias("code"), *[number(F.get("r", F.lit(i))).alias(k) for k, i in FLOW_NET_AT.items()])
