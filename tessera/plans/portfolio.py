"""Queries on price panels, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import series as S
from tessera.staging import scratch
from tessera.streaming import drawdown as D

WEIGHTS = {"A": 0.3, "N": 0.3, "R": 0.4}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.price_panel(_read(spark, sf_dir, "lineitem"), F.trunc(F.to_date("l_shipdate"), "month"), F.col("l_returnflag"), F.col("l_extendedprice"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = S.price_panel(_read(spark, sf_dir, "lineitem"), F.trunc(F.to_date("l_shipdate"), "month"), F.lit("all"), F.col("l_extendedprice"))
    return S.pct_change(prices).where(F.col("ret").isNotNull()).select("date", "ret")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.portfolio_returns(monthly(spark, sf_dir), WEIGHTS)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.price_panel(_read(spark, sf_dir, "orders"), F.to_date("o_orderdate"), F.col("o_orderpriority"), F.col("o_totalprice"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.price_panel(_read(spark, sf_dir, "events"), F.to_date("ts"), F.col("event_type"), F.col("value"))


def r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, so that sums in another order compare equal."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as sleeves, nations as tickers, by numbers of customers."""
    rows = _read(spark, sf_dir, "customer").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = rows.groupBy(F.col("r_name").alias("sleeve"), F.col("n_name").alias("ticker")).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(S.Window.partitionBy("sleeve"))).select("sleeve", "ticker", (F.col("n") / F.col("total")).alias("weight"))


def drawdown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running drawdowns of each event type's daily returns, as a stream whose files come in no order of time."""
    rows = S.pct_change(daily(spark, sf_dir)).where(F.col("ret").isNotNull()).select("ticker", F.col("date").cast("timestamp").alias("ts"), "ret")
    place = scratch(spark, "drawdown-stream")
    rows.withColumn("part", F.pmod(F.datediff("ts", F.lit("2000-01-01")), F.lit(3))).repartition("part").write.partitionBy("part").parquet(f"{place}/in")
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, D.ROCKSDB)
    try:
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in")
        writer = D.running_drawdowns(stream, "7 days").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        # a row long after the others lets the watermark pass them
        spark.createDataFrame([("", datetime.datetime(2999, 1, 1), 0.0)], rows.schema).write.parquet(f"{place}/in/end")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(D.SCHEMA).parquet(f"{place}/out").where("ticker <> ''").select(F.to_date("ts").alias("date"), "ticker", "drawdown")


QUERIES = {
    "drawdown_stream": lambda s, d: r(drawdown_stream(s, d), "drawdown"),
    "risk_report": lambda s, d: r(S.risk_report(returns(s, d), benchmark(s, d)), "volatility", "sharpe", "var_95", "cagr", "max_drawdown", "beta", "alpha"),
    "portfolio_returns": lambda s, d: r(returns(s, d), "ret"),
    "portfolio_returns_gappy_pad": lambda s, d: r(S.portfolio_returns(gappy(s, d), dict.fromkeys(PRIORITIES, 0.2)), "ret"),
    "portfolio_returns_gappy_strict": lambda s, d: r(S.portfolio_returns(gappy(s, d), dict.fromkeys(PRIORITIES, 0.2), fill="none"), "ret"),
    "cumulative_returns": lambda s, d: r(S.cumulative(returns(s, d)), "ret", "cum"),
    "drawdown_series": lambda s, d: r(S.drawdowns(returns(s, d)).select("date", "drawdown"), "drawdown"),
    "max_drawdown": lambda s, d: r(S.max_drawdown(returns(s, d)), "max_drawdown"),
    "rolling_sharpe": lambda s, d: r(S.rolling_sharpe(returns(s, d)).select("date", "sharpe"), "sharpe"),
    "volatility_var95": lambda s, d: r(returns(s, d).agg(*S.risk_aggregates()).select("volatility", "var_95"), "volatility", "var_95"),
    "sharpe_ratio": lambda s, d: r(returns(s, d).agg(*S.risk_aggregates()).select("sharpe"), "sharpe"),
    "beta_alpha": lambda s, d: r(S.beta_alpha(returns(s, d), benchmark(s, d)), "beta", "alpha"),
    "cagr": lambda s, d: r(returns(s, d).agg(*S.risk_aggregates()).select("cagr"), "cagr"),
    "correlation_matrix": lambda s, d: r(S.correlations(daily(s, d)), "corr"),
    "weight_tree": lambda s, d: r(S.weight_tree(holdings(s, d)), "value"),
    "weight_totals": lambda s, d: r(S.weight_totals(holdings(s, d)), "weight"),
    "weight_checks": lambda s, d: r(S.weight_checks(holdings(s, d)), "total"),
    "latest_value": lambda s, d: r(S.latest(gappy(s, d)), "value"),
    "pct_change_by_series": lambda s, d: r(S.pct_change(daily(s, d)), "value", "ret"),
}

_PANEL = "panel AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, l_returnflag AS ticker, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
_BENCH = """
    bp AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
    bench AS (SELECT date, ret FROM (SELECT date, value / lag(value) OVER (ORDER BY date) - 1 AS ret FROM bp) WHERE ret IS NOT NULL)"""


def _port(weights: str, n: int, pad: bool = True) -> str:
    value = "last_value(p.value IGNORE NULLS) OVER (PARTITION BY w.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING)" if pad else "p.value"
    return f"""
    w AS (SELECT * FROM (VALUES {weights}) t(ticker, weight)),
    spine AS (SELECT d.date, w.ticker, w.weight, {value} AS value FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN w LEFT JOIN panel p ON p.date = d.date AND p.ticker = w.ticker),
    rets AS (SELECT date, weight, value / lag(value) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM spine),
    port AS (SELECT date, sum(ret * weight) AS ret FROM rets GROUP BY date HAVING count(ret) = {n})"""


_P = f"WITH {_PANEL}, {_port('(' + '), ('.join(f"'{t}', {w}::DOUBLE" for t, w in WEIGHTS.items()) + ')', 3)}"
_GAPPY = "panel AS (SELECT o_orderdate::DATE AS date, o_orderpriority AS ticker, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"
_FIVE = ", ".join(f"('{p}', 0.2::DOUBLE)" for p in PRIORITIES)
_CUM = f"{_P}, cum AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM port), dd AS (SELECT date, cum / max(cum) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM cum)"
_AGG = """(SELECT stddev_samp(ret) * sqrt(252) AS volatility, avg(ret - 0.03 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe, quantile_cont(ret, 0.05) AS var_95,
    pow(product(1 + ret), 365.25 / date_diff('day', min(date), max(date))) - 1 AS cagr FROM port)"""
_BA = """(SELECT beta, p - (0.03 + beta * (b - 0.03)) AS alpha FROM (SELECT covar_samp(x.ret, y.ret) / var_samp(y.ret) AS beta FROM port x JOIN bench y USING (date)),
    (SELECT avg(ret) * 252 AS p FROM port), (SELECT avg(ret) * 252 AS b FROM bench))"""
_DAILY = "panel AS (SELECT ts::DATE AS date, event_type AS ticker, avg(value) AS value FROM events GROUP BY ALL)"
_HOLD = """WITH c AS (SELECT r_name AS sleeve, n_name AS ticker, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
    holdings AS (SELECT sleeve, ticker, n / sum(n) OVER (PARTITION BY sleeve) AS weight FROM c)"""

ORACLE = {
    "drawdown_stream": f"""WITH {_DAILY}, rets AS (SELECT * FROM (SELECT date, ticker, value / lag(value) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel) WHERE ret IS NOT NULL),
        cum AS (SELECT date, ticker, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM rets) SELECT date, ticker, round(cum / max(cum) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM cum""",
    "risk_report": f"{_CUM}, {_BENCH} SELECT round(volatility, 6) AS volatility, round(sharpe, 6) AS sharpe, round(var_95, 6) AS var_95, round(cagr, 6) AS cagr, round(max_drawdown, 6) AS max_drawdown, round(beta, 6) AS beta, round(alpha, 6) AS alpha FROM {_AGG}, (SELECT min(drawdown) AS max_drawdown FROM dd), {_BA}",
    "portfolio_returns": f"{_P} SELECT date, round(ret, 6) AS ret FROM port",
    "portfolio_returns_gappy_pad": f"WITH {_GAPPY}, {_port(_FIVE, 5)} SELECT date, round(ret, 6) AS ret FROM port",
    "portfolio_returns_gappy_strict": f"WITH {_GAPPY}, {_port(_FIVE, 5, pad=False)} SELECT date, round(ret, 6) AS ret FROM port",
    "cumulative_returns": f"{_CUM} SELECT date, round(ret, 6) AS ret, round(cum, 6) AS cum FROM cum",
    "drawdown_series": f"{_CUM} SELECT date, round(drawdown, 6) AS drawdown FROM dd",
    "max_drawdown": f"{_CUM} SELECT round(min(drawdown), 6) AS max_drawdown FROM dd",
    "rolling_sharpe": f"{_P} SELECT date, round(CASE WHEN count(*) OVER f = 63 THEN avg(ret - 0.03 / 252) OVER f / stddev_samp(ret) OVER f * sqrt(252) END, 6) AS sharpe FROM port WINDOW f AS (ORDER BY date ROWS 62 PRECEDING)",
    "volatility_var95": f"{_P} SELECT round(volatility, 6) AS volatility, round(var_95, 6) AS var_95 FROM {_AGG}",
    "sharpe_ratio": f"{_P} SELECT round(sharpe, 6) AS sharpe FROM {_AGG}",
    "beta_alpha": f"{_P}, {_BENCH} SELECT round(beta, 6) AS beta, round(alpha, 6) AS alpha FROM {_BA}",
    "cagr": f"{_P} SELECT round(cagr, 6) AS cagr FROM {_AGG}",
    "correlation_matrix": f"""WITH {_DAILY}, rets AS (SELECT * FROM (SELECT date, ticker, value / lag(value) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel) WHERE ret IS NOT NULL),
        days AS (SELECT date FROM rets GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM rets))
        SELECT x.ticker AS a, y.ticker AS b, round(corr(x.ret, y.ret), 6) AS corr FROM rets x JOIN rets y USING (date) JOIN days USING (date) GROUP BY ALL""",
    "weight_tree": f"{_HOLD} SELECT ticker AS node, sleeve AS parent, round(weight, 6) AS value FROM holdings UNION ALL SELECT DISTINCT sleeve, '', 0.0::DOUBLE FROM holdings",
    "weight_totals": f"{_HOLD} SELECT sleeve, ticker, round(sum(weight), 6) AS weight FROM holdings GROUP BY ROLLUP (sleeve, ticker)",
    "weight_checks": f"{_HOLD} SELECT sleeve, round(sum(weight), 6) AS total, abs(sum(weight) - 1) <= 0.01 AS ok FROM holdings GROUP BY sleeve",
    "latest_value": f"WITH {_GAPPY} SELECT ticker, max(date) AS date, round(max_by(value, date), 6) AS value FROM panel GROUP BY ticker",
    "pct_change_by_series": f"WITH {_DAILY} SELECT date, ticker, round(value, 6) AS value, round(value / lag(value) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS ret FROM panel",
}
