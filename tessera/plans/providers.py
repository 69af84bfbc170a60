"""Provider payloads built from the tables (one a customer or event type) and parsed back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import providers as P
from tessera.sources import saved as V
from tessera.staging import scratch
from tessera.streaming.bars import daily_bars


def customer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a series: the highest price of each day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_custkey").cast("string").alias("series_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).agg(F.max("o_totalprice").alias("v"))


def as_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_days(spark, sf_dir).groupBy("series_id").agg(F.collect_list(F.struct(F.col("d").alias("date"), F.col("v").cast("string").alias("value"))).alias("o"))
    with_gap = F.concat("o", F.array(F.struct(F.lit("2001-01-01").alias("date"), F.lit(".").alias("value"))))
    return rows.select("series_id", F.to_json(F.struct(with_gap.alias("observations"))).alias("payload"))


def as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_days(spark, sf_dir).groupBy("series_id").agg(F.collect_list(F.struct(F.col("d").alias("date"), F.col("v").cast("string").alias("value"))).alias("o"))
    return rows.select("series_id", F.to_json("o").alias("payload"))


def as_json_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_days(spark, sf_dir).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("o"))
    at = F.sequence(F.lit(0), F.size("o") - 1)
    values = F.map_from_arrays(F.transform(at, lambda i: i.cast("string")), F.transform("o", lambda x: x["v"]))
    periods = F.map_from_arrays(F.transform("o", lambda x: x["d"]), at)
    return rows.select("series_id", F.to_json(F.struct(values.alias("value"), F.struct(F.struct(F.struct(periods.alias("index")).alias("category")).alias("time")).alias("dimension"))).alias("payload"))


def as_sdmx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_days(spark, sf_dir).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("o"))
    at = F.sequence(F.lit(0), F.size("o") - 1)
    seen = F.map_from_arrays(F.transform(at, lambda i: F.concat(F.lit("0:0:"), i.cast("string"))), F.transform("o", lambda x: F.array(x["v"])))
    dims = F.array(F.struct(F.lit("FREQ").alias("id"), F.array(F.struct(F.lit("D").alias("id"))).alias("values")), F.struct(F.lit("TIME_PERIOD").alias("id"), F.transform("o", lambda x: F.struct(x["d"].alias("id"))).alias("values")))
    return rows.select("series_id", F.to_json(F.struct(F.array(F.struct(seen.alias("observations"))).alias("dataSets"), F.struct(F.struct(dims.alias("observation")).alias("dimensions")).alias("structure"))).alias("payload"))


def as_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form: observations of one series, by index."""
    rows = customer_days(spark, sf_dir).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("o"))
    at = F.sequence(F.lit(0), F.size("o") - 1)
    seen = F.map_from_arrays(F.transform(at, lambda i: i.cast("string")), F.transform("o", lambda x: F.array(x["v"])))
    dims = F.array(F.struct(F.transform("o", lambda x: F.struct(x["d"].alias("id"), x["d"].alias("name"))).alias("values")))
    series = F.create_map(F.lit("0:0:0:0:0:0:0"), F.struct(seen.alias("observations")))
    return rows.select("series_id", F.to_json(F.struct(F.array(F.struct(series.alias("series"))).alias("dataSets"), F.struct(F.struct(dims.alias("observation")).alias("dimensions")).alias("structure"))).alias("payload"))


def as_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's parts: weights that are zero, left out or unlike the index weight; the list under either name or bare."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    weight = F.when(F.col("p_size") % 4 == 0, 0.0).when(F.col("p_size") % 4 == 1, F.col("p_size") * 1.0)
    item = F.struct(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("ticker"), F.lit("").alias("symbol"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("isin"), weight.alias("weight"), F.col("p_retailprice").alias("indexWeight"))
    lists = p.groupBy(F.col("p_brand").alias("series_id")).agg(F.collect_list(item).alias("i"))
    kind = F.pmod(F.crc32("series_id"), F.lit(3))
    return lists.select("series_id", F.when(kind == 0, F.to_json(F.struct(F.col("i").alias("instruments")))).when(kind == 1, F.to_json(F.struct(F.col("i").alias("data")))).otherwise(F.to_json("i")).alias("payload"))


def as_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as price payloads under one of three names, some in a list and some without a price."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    one = F.struct(F.when(k % 4 == 0, v).alias("lastPrice"), F.when(k % 4 == 1, v).alias("price"), F.when(k % 4 == 2, v).alias("value"))
    return p.select(k.cast("string").alias("series_id"), F.when(k % 3 == 0, F.to_json(F.array(one))).otherwise(F.to_json(one)).alias("payload"))


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.concat(F.lit(" fr"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit(" ")).alias("Fund ISIN"), F.concat(F.lit("Art. "), F.col("p_size").cast("string")).alias("SFDR article"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_name").alias("Company name"), F.col("n_name").alias("Country"), F.year("o_orderdate").cast("string").alias("Reporting year"), F.element_at(F.array(*map(F.lit, ("A", "B-", "n/a", "1.25", "E"))), (F.substring("o_orderpriority", 1, 1)).cast("int")).alias("Score band"))


YEARS = (1993, 1996)
COUNTRY = "nation_1"
AS_OF = "1995-06-30"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as percent series: the mean thousands of each day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice") / 1000, 4).alias("value"))


def from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads saved to a folder and loaded by the data source, from a day on."""
    place = scratch(spark, "payloads")
    as_observations(spark, sf_dir).write.parquet(place)
    V.register(spark)
    return spark.read.format("saved_series").option("provider", "observations").load(place).where(F.col("date") >= F.lit(AS_OF).cast("date"))


QUERIES = {
    "saved_source": from_source,
    "sdmx_series_parse": lambda s, d: P.sdmx(as_series(s, d)),
    "latest_price": lambda s, d: P.latest_price(as_prices(s, d)),
    "fund_articles": lambda s, d: P.fund_articles(funds(s, d), funds(s, d).select(F.upper(F.trim("Fund ISIN")).alias("isin")).distinct(), "Fund ISIN", "SFDR article", "p_partkey"),
    "risk_free_rate": lambda s, d: P.risk_free_rate(rates(s, d), F.lit(AS_OF).cast("date")).unionByName(P.risk_free_rate(rates(s, d), F.lit("1890-01-01").cast("date"))).withColumn("rate", F.round("rate", 9)),
    "wire_records": lambda s, d: P.wire_records(customer_days(s, d).select("series_id", F.to_date("d").alias("date"), F.col("v").alias("value"))).select("series_id", "records", F.size(F.from_json("data", "array<struct<date:string,value:double>>")).alias("n"), F.get_json_object("data", "$[0].date").alias("first")),
    "observations_parse": lambda s, d: P.observations(as_observations(s, d)),
    "records_parse": lambda s, d: P.records(as_records(s, d)),
    "jsonstat_parse": lambda s, d: P.json_stat(as_json_stat(s, d)),
    "sdmx_parse": lambda s, d: P.sdmx(as_sdmx(s, d)),
    "constituents_parse": lambda s, d: P.constituents(as_constituents(s, d)),
    "score_table": lambda s, d: P.score_table(score_rows(s, d), "customer", COUNTRY, YEARS),
    "daily_bars": lambda s, d: daily_bars(s.read.parquet(f"{d}/events.parquet")),
}

_DAYS = "SELECT max(o_orderdate)::DATE AS date, max(o_totalprice) AS value, o_custkey::VARCHAR AS series_id, '{0}' AS source FROM orders GROUP BY o_custkey, o_orderdate::DATE"
ORACLE = {
    "saved_source": f"SELECT * FROM ({_DAYS.format('observations')}) WHERE date >= DATE '{AS_OF}'",
    "observations_parse": _DAYS.format("observations"),
    "records_parse": _DAYS.format("records"),
    "jsonstat_parse": _DAYS.format("json_stat"),
    "sdmx_parse": _DAYS.format("sdmx"),
    "sdmx_series_parse": _DAYS.format("sdmx"),
    "latest_price": "SELECT p_partkey::VARCHAR AS series_id, p_retailprice AS value FROM part WHERE p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_partkey % 3 > 0)",
    "fund_articles": "SELECT 'FR' || (p_partkey // 2) AS isin, CASE WHEN contains(s, '6') THEN 'Article 6' WHEN contains(s, '8') THEN 'Article 8' WHEN contains(s, '9') THEN 'Article 9' END AS article FROM (SELECT p_partkey // 2 * 2 AS p_partkey, min_by(p_size, p_partkey)::VARCHAR AS s FROM part GROUP BY p_partkey // 2 * 2)",
    "risk_free_rate": f"WITH r AS (SELECT o_orderdate::DATE AS date, round(avg(o_totalprice) / 1000, 4) AS value FROM orders GROUP BY 1) SELECT round(coalesce(max_by(value, date) / 100, 0.03::DOUBLE), 9) AS rate FROM r WHERE date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' UNION ALL SELECT 0.03::DOUBLE",
    "wire_records": "SELECT o_custkey::VARCHAR AS series_id, count(DISTINCT o_orderdate::DATE)::INT AS records, count(DISTINCT o_orderdate::DATE)::INT AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY 1",
    "constituents_parse": "SELECT p_brand AS series_id, CASE WHEN p_size % 3 = 0 THEN 'P' || p_partkey ELSE p_name END AS ticker, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size ELSE p_retailprice END::DOUBLE AS weight FROM part",
    "score_table": """SELECT * FROM (SELECT make_date(year(o_orderdate), 1, 1) AS date, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4.0 WHEN '2' THEN 2.7 WHEN '4' THEN 1.25 WHEN '5' THEN 0.5 END::DOUBLE AS value, c_name AS series_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), '{2}') AND contains(lower(c_name), 'customer') AND year(o_orderdate) BETWEEN {0} AND {1}) WHERE value IS NOT NULL""".format(*YEARS, COUNTRY),
    "daily_bars": "SELECT ts::DATE AS date, event_type AS ticker, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL",
}
