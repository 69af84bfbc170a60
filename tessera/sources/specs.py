"""Specifications as tables: portfolios, manifests and gold sets, with what is wrong with them.

A specification is a small file on the driver (TOML) or a folder of JSON lines that Spark reads; its rules are queries
over its table, so that a table from anywhere can be checked.
"""

from __future__ import annotations

import os
import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The vocabulary of document types and the provenances that a person has accepted.
DOC_TYPES = ["amf_sfdr", "bdf_fsr", "ecb_fsr", "factsheet", "macro", "prospectus"]
ACCEPTED = ["hand-written", "synthetic-draft+human-accept"]
MANIFEST = "manifest.toml"
HOLDINGS = "sleeve string, sleeve_weight double, ticker string, holding_weight double"
ENTRIES = "source string, period_start string, period_end string, published string, doc_type string, note string, unknown string"
GOLD = "id string, question string, gold array<struct<source: string, page: int>>, doc_type string, note string, provenance string"


def portfolio_weights(holdings: DataFrame) -> DataFrame:
    """HOLDINGS as (ticker, sleeve, weight): the holding's share of its sleeve's."""
    return holdings.select("ticker", "sleeve", (F.col("sleeve_weight") * F.col("holding_weight")).alias("weight"))


def portfolio_problems(holdings: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(label, total) of the sums of weights that aren't 1 within the tolerance: the sleeves', and each sleeve's holdings'."""
    per = holdings.groupBy("sleeve").agg(F.max("sleeve_weight").alias("w"), F.sum("holding_weight").alias("total"))
    whole = per.agg(F.sum("w").alias("total")).select(F.lit("Global sleeve weights").alias("label"), "total")
    each = per.select(F.concat(F.lit("Sleeve '"), "sleeve", F.lit("' holding weights")).alias("label"), "total")
    return whole.unionByName(each).where(F.abs(F.col("total") - 1) > tolerance)


def _toml(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        return tomllib.load(f)


def load_portfolio(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """The fields of a portfolio file and its HOLDINGS; flat holdings are one sleeve, Equity. An error names what is missing or doesn't sum to 1."""
    data = _toml(path)
    if missing := [k for k in ("name", "benchmark", "start", "end") if k not in data]:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    sleeves = data.get("sleeve") or [{"name": "Equity", "weight": 1.0, "holding": data.get("holding", [])}]
    rows = [(str(s["name"]), float(s["weight"]), str(h["ticker"]), float(h["weight"])) for s in sleeves for h in s.get("holding", [])]
    if not rows:
        raise ValueError(f"{path}: neither sleeves nor holdings")
    holdings = spark.createDataFrame(rows, HOLDINGS)
    if wrong := portfolio_problems(holdings).first():
        raise ValueError(f"{wrong['label']} must sum to 1.0 (±0.01), got {wrong['total']:.4f}")
    return {"currency": "EUR"} | {k: str(v) for k, v in data.items() if not isinstance(v, list)}, holdings


def find_manifest(target: str, name: str = MANIFEST) -> str | None:
    """The manifest of a folder, or of the folder that a file is in."""
    place = os.path.join(os.path.dirname(target) if os.path.isfile(target) else target, name)
    return place if os.path.isfile(place) else None


def manifest_problems(entries: DataFrame, doc_types: list[str] = DOC_TYPES) -> DataFrame:
    """(source, reason) of ENTRIES that break a rule: a name, a known type, dates, a period in order, no unknown keys, each source once."""
    date = lambda c: F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd")
    rules: list[tuple[str, Column]] = [
        ("no source", F.coalesce("source", F.lit("")) == ""),
        ("unknown doc_type", F.col("doc_type").isNotNull() & ~F.col("doc_type").isin(*doc_types)),
        ("invalid date", date("period_start").isNull() | date("period_end").isNull() | (F.col("published").isNotNull() & date("published").isNull())),
        ("period_start is after period_end", F.coalesce(date("period_start") > date("period_end"), F.lit(False))),
        ("unknown key", F.coalesce("unknown", F.lit("")) != ""),
        ("duplicate source", F.col("_n") > 1),
    ]
    counted = entries.withColumn("_n", F.count("*").over(Window.partitionBy("source")))
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return counted.select("source", F.explode(broken).alias("reason")).distinct()


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The ENTRIES of a manifest file; an error names the source and the rule that it breaks."""
    data = _toml(path)
    if unknown := sorted(set(data) - {"document"}):
        raise ValueError(f"{path}: unknown top-level keys {unknown}")
    known = ("source", "period_start", "period_end", "published", "doc_type", "note")
    rows = [(*(None if d.get(k) is None else str(d[k]) for k in known), " ".join(sorted(set(d) - set(known)))) for d in data.get("document", [])]
    entries = spark.createDataFrame(rows, ENTRIES)
    if wrong := manifest_problems(entries).orderBy("source", "reason").first():
        raise ValueError(f"{path}: source {wrong['source']!r}: {wrong['reason']}")
    return entries.drop("unknown")


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """The JSON lines of gold files as (file, line, raw, row): blank lines are left out, row is null where a line doesn't parse."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line", "raw"))
    rows = whole.where(F.trim("raw") != "").withColumn("line", F.col("line") + 1)
    return rows.withColumn("row", F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", GOLD)))


def gold_problems(rows: DataFrame, require_accepted: bool = True) -> DataFrame:
    """(line, id, reason) of gold rows (line, row) that break a rule: fields, at least one page with source and page, ids once, an accepted provenance."""
    row = F.col("row")
    pages = F.coalesce(F.size(row["gold"]), F.lit(0))
    rules: list[tuple[str, Column]] = [
        ("not JSON", row.isNull()),
        ("no id", row.isNotNull() & row["id"].isNull()),
        ("no question", row.isNotNull() & (F.coalesce(row["question"], F.lit("")) == "")),
        ("no gold page", row.isNotNull() & ((pages < 1) | F.coalesce(F.exists(row["gold"], lambda g: g["source"].isNull() | g["page"].isNull()), F.lit(False)))),
        ("no provenance", row.isNotNull() & row["provenance"].isNull()),
        ("duplicate id", row["id"].isNotNull() & (F.col("_n") > 1)),
    ]
    if require_accepted:
        rules.append(("not human-accepted", ~accepted(row["provenance"])))
    counted = rows.withColumn("_n", F.row_number().over(Window.partitionBy("row.id").orderBy("line")))
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return counted.select("line", row["id"].alias("id"), F.explode(broken).alias("reason"))


def accepted(provenance: Column) -> Column:
    """Whether a person accepted a row of this provenance; null for null."""
    return provenance.isin(*ACCEPTED)


def load_gold(spark: SparkSession, path: str, require_accepted: bool = True) -> DataFrame:
    """The rows of a gold set (GOLD); an error names the first line that breaks a rule, or says that there are none."""
    rows = gold_rows(spark, path)
    if wrong := gold_problems(rows, require_accepted).orderBy("line").first():
        raise ValueError(f"{path}:{wrong['line']}: {wrong['reason']} (id {wrong['id']!r})")
    out = rows.select("row.*")
    if out.isEmpty():
        raise ValueError(f"{path}: no gold rows")
    return out


def write_gold(gold: DataFrame, path: str) -> None:
    """JSON lines in a new folder; one that is there isn't overwritten."""
    gold.write.mode("errorifexists").json(path)


def saved_row(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The rows of saved JSON lines with this id."""
    return spark.read.schema(schema).json(path).where(F.col("id") == key)
