"""Parsers of provider payloads into the long series table (date, value, series_id, source).

Each takes a DataFrame with a payload column, so a folder of saved responses is parsed where its files are. Rows that
don't parse are dropped; fetch() names the series of which nothing is left in an error. Field names are those of the
public payloads (fixed values).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import article, grade_score, period_start, stripped


def _series(df: DataFrame, date: Column, value: Column, source: str) -> DataFrame:
    number = value.try_cast("double")
    out = df.select(date.alias("date"), F.when(~F.isnan(number), number).alias("value"), "series_id", F.lit(source).alias("source"))
    return out.where(F.col("date").isNotNull() & F.col("value").isNotNull())


def observations(df: DataFrame, source: str = "observations") -> DataFrame:
    """{"observations": [{"date", "value"}]}; values that are no numbers, such as '.', are skipped."""
    rows = df.select("series_id", F.explode(F.from_json("payload", "observations array<struct<date string, value string>>")["observations"]).alias("o"))
    return _series(rows, F.try_to_date("o.date"), F.col("o.value"), source)


def records(df: DataFrame, source: str = "records") -> DataFrame:
    """[{"date", "value"}]."""
    rows = df.select("series_id", F.explode(F.from_json("payload", "array<struct<date string, value string>>")).alias("o"))
    return _series(rows, F.try_to_date("o.date"), F.col("o.value"), source)


def json_stat(df: DataFrame, source: str = "json_stat") -> DataFrame:
    """{"value": {position: number}, "dimension": {"time": {"category": {"index": {period: position}}}}}."""
    shape = "value map<string,string>, dimension struct<time: struct<category: struct<index: map<string,int>>>>"
    rows = df.select("series_id", F.from_json("payload", shape).alias("p"))
    spread = rows.select("series_id", F.col("p.value").alias("v"), F.explode("p.dimension.time.category.index").alias("period", "pos"))
    return _series(spread, period_start(F.col("period")), F.try_element_at("v", F.col("pos").cast("string")), source)


def sdmx(df: DataFrame, source: str = "sdmx") -> DataFrame:
    """{"dataSets": [{"observations": {"i:j:t": [value]}} or {"series": {key: {"observations": {"t": [value]}}}}], "structure": {"dimensions": {"observation": [{"id", "values": [{"id"}]}]}}}.

    The last part of an observation's key is the period's index. All series of the first data set are taken.
    """
    seen = "observations: map<string, array<string>>"
    shape = f"dataSets array<struct<{seen}, series: map<string, struct<{seen}>>>>, structure struct<dimensions: struct<observation: array<struct<id: string, values: array<struct<id: string>>>>>>"
    rows = df.select("series_id", F.from_json("payload", shape).alias("p"))
    dims = F.col("p.structure.dimensions.observation")
    time = F.coalesce(F.try_element_at(F.filter(dims, lambda d: F.upper(d["id"]).contains("TIME")), F.lit(1)), F.try_element_at(dims, F.lit(-1)))["values"]
    first = F.try_element_at("p.dataSets", F.lit(1))
    none = F.array().cast("array<struct<key:string,value:array<string>>>")
    nested = F.flatten(F.transform(F.map_values(first["series"]), lambda x: F.coalesce(F.map_entries(x["observations"]), none)))
    both = F.concat(F.coalesce(F.map_entries(first["observations"]), none), F.coalesce(nested, none))
    spread = rows.select("series_id", time.alias("periods"), F.explode(both).alias("e")).select("series_id", "periods", "e.key", F.col("e.value").alias("o"))
    at = F.element_at(F.split("key", ":"), -1).try_cast("int")
    return _series(spread.where(at >= 0), period_start(F.try_element_at("periods", at + 1)["id"]), F.try_element_at("o", F.lit(1)), source)


def _first_text(item: Column, *names: str) -> Column:
    """The first of the item's values that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(item, F.lit(n)), F.lit("")) for n in names])


def constituents(df: DataFrame) -> DataFrame:
    """{"instruments": [{ticker | symbol | isin, weight | indexWeight}]}, the same under "data", or the bare list.

    A weight that is there stays, zero included, and an empty or null one is zero; without one the index weight is
    taken, then zero. Rows whose weight is no number are dropped.
    """
    items = "array<map<string,string>>"
    object_ = F.from_json("payload", f"instruments {items}, data {items}")
    rows = df.select("series_id", F.explode(F.coalesce(object_["instruments"], object_["data"], F.from_json("payload", items))).alias("i"))
    item = F.col("i")
    own = F.when(F.map_contains_key(item, "weight"), F.try_element_at(item, F.lit("weight"))).otherwise(F.try_element_at(item, F.lit("indexWeight")))
    out = rows.where(item.isNotNull()).select("series_id", F.coalesce(_first_text(item, "ticker", "symbol", "isin"), F.lit("")).alias("ticker"), F.coalesce(F.nullif(own, F.lit("")), F.lit("0")).try_cast("double").alias("weight"))
    return out.where(F.col("weight").isNotNull())


def latest_price(df: DataFrame) -> DataFrame:
    """(series_id, value): "lastPrice", else "price", else (in an object, not in a list) "value"; zeros count as missing. Payloads without a price are dropped."""
    one, many = F.from_json("payload", "map<string,string>"), F.try_element_at(F.from_json("payload", "array<map<string,string>>"), F.lit(1))
    number = lambda m, n: F.nullif(F.try_element_at(m, F.lit(n)).try_cast("double"), F.lit(0.0))
    price = F.coalesce(number(one, "lastPrice"), number(one, "price"), number(one, "value"), number(many, "lastPrice"), number(many, "price"))
    return df.select("series_id", price.alias("value")).where(F.col("value").isNotNull())


def risk_free_rate(rates: DataFrame, as_of: Column, fallback: float = 0.03, days: int = 90) -> DataFrame:
    """One row: the latest value of a percent series (date, value) in the `days` before as_of, as a fraction, or the fallback."""
    near = rates.where(F.col("date").between(F.date_sub(as_of, days), as_of))
    return near.agg(F.coalesce(F.max_by("value", "date") / 100.0, F.lit(fallback)).alias("rate"))


def find_column(columns: list[str], hints: list[str]) -> str | None:
    """The first column whose name has any of the hints."""
    return next((c for c in columns if any(h in c.lower() for h in hints)), None)


# Parts of column names by which tables of scores and funds are read.
SCORE_HINTS = {
    "company": ["company_name", "organization", "company", "account_name", "name"],
    "country": ["country", "country_region", "headquarters"],
    "year": ["reporting_year", "accounting_year", "year", "survey_year"],
    "score": ["performance_band", "score", "rating", "grade", "response_score"],
}


def score_table(df: DataFrame, company: str | None = None, country: str = "france", years: tuple[int, int] = (0, 9999)) -> DataFrame:
    """A table of company scores by name hints, dated January 1: country contains, year between, company (None: all) contains.

    Texts are matched as they stand, not as patterns. Without a country column all rows are taken.
    """
    at = {k: find_column(df.columns, h) for k, h in SCORE_HINTS.items()}
    if missing := [k for k in ("company", "year", "score") if at[k] is None]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    year = F.col(f"`{at['year']}`").try_cast("double").cast("int")
    name = F.col(f"`{at['company']}`").cast("string")
    rows = df.where(year.between(*years))
    if at["country"]:
        rows = rows.where(F.lower(F.col(f"`{at['country']}`").cast("string")).contains(country))
    if company is not None:
        rows = rows.where(F.lower(name).contains(company.lower()))
    out = rows.select(F.make_date(year, F.lit(1), F.lit(1)).alias("date"), grade_score(F.col(f"`{at['score']}`").cast("string")).alias("value"), name.alias("series_id"))
    return out.where(F.col("value").isNotNull())


def fund_articles(funds: DataFrame, isins: DataFrame, isin: str, article_column: str, order: str) -> DataFrame:
    """isins (isin) with the article of the first fund (by `order`) whose trimmed upper-case number is the same; null if there's none."""
    clean = lambda c: F.upper(stripped(F.col(c).cast("string")))
    first = funds.groupBy(clean(isin).alias("_isin")).agg(F.min_by(F.struct(F.col(article_column).cast("string").alias("raw")), order).alias("first"))
    return isins.withColumn("_isin", clean("isin")).join(first, "_isin", "left").select("isin", article(F.col("first.raw")).alias("article"))


def checked(df: DataFrame, wanted: list[str]) -> DataFrame:
    """df, or an error that names the wanted series it lacks."""
    have = {r[0] for r in df.where(F.col("series_id").isin(*wanted)).select("series_id").distinct().collect()}
    if missing := [w for w in wanted if w not in have]:
        raise ValueError(f"no data for {', '.join(missing)}")
    return df


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"observations": observations, "records": records, "json_stat": json_stat, "sdmx": sdmx}


def parser(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in PARSERS:
        raise KeyError(f"unknown provider format {name!r}; there are {', '.join(sorted(PARSERS))}")
    return PARSERS[name]


def fetch(df: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """The wanted series of saved payloads, or an error that names those without a usable row."""
    return checked(parser(name)(df).where(F.col("series_id").isin(*wanted)), wanted)


def wire_records(series: DataFrame) -> DataFrame:
    """(series_id, records, data): per series its number of rows and {"date": "YYYY-MM-DD", "value"} in order, as served."""
    row = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("value").cast("double").alias("value"))
    return series.groupBy("series_id").agg(F.sort_array(F.collect_list(row)).alias("data")).select("series_id", F.size("data").alias("records"), F.to_json("data").alias("data"))
