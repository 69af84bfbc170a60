"""Returns, risk figures and chart series of prices in long form: (date, ticker, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import over_blocks, with_before, with_position

TRADING_DAYS = 252
RISK_FREE = 0.03


def price_panel(df: DataFrame, date: Column, ticker: Column, value: Column) -> DataFrame:
    """The mean value of each ticker and date."""
    return df.groupBy(date.alias("date"), ticker.alias("ticker")).agg(F.avg(value).alias("value"))


def pct_change(prices: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """ret by ticker on its own calendar; the first date has none. A zero price gives a null."""
    by_date = Window.partitionBy(*keys).orderBy("date")
    return prices.withColumn("ret", F.try_divide("value", F.lag("value").over(by_date)) - 1)


def aligned_returns(prices: DataFrame, tickers: Sequence[str], fill: str = "pad") -> DataFrame:
    """ret of every ticker on every date of the panel; interior gaps take the last value if fill is 'pad'.

    Each date's prices become a map that is exploded by the wanted tickers, so no join is needed.
    """
    values = F.map_from_entries(F.collect_list(F.struct("ticker", "value")))
    days = prices.where(F.col("ticker").isin(*tickers) & F.col("value").isNotNull()).groupBy("date").agg(values.alias("v"))
    spine = days.select("date", F.explode(F.array(*map(F.lit, tickers))).alias("ticker"), "v").select("date", "ticker", F.try_element_at("v", "ticker").alias("value"))
    if fill == "pad":
        spine = spine.withColumn("value", F.last("value", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return pct_change(spine)


def portfolio_returns(prices: DataFrame, weights: dict[str, float], fill: str = "pad") -> DataFrame:
    """(date, ret): weighted returns on the dates on which every ticker has one."""
    weight = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(float(w)))])
    rets = aligned_returns(prices, list(weights), fill)
    total = rets.groupBy("date").agg(F.sum(F.col("ret") * weight[F.col("ticker")]).alias("ret"), F.count("ret").alias("n"))
    return total.where(F.col("n") == len(weights)).select("date", "ret")


def _spans(returns: DataFrame, span: str) -> DataFrame:
    return returns.withColumn("_span", F.date_trunc(span, "date"))


def cumulative(returns: DataFrame, keys: Sequence[str] = (), span: str = "year") -> DataFrame:
    """cum: the product of 1 + ret to each date.

    Each key's dates are cut at calendar spans (of a year, or another unit of date_trunc): running products of a span
    are multiplied by the product of the spans before it.
    """
    own = _spans(returns, span)
    run = Window.partitionBy(*keys, "_span").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    totals = own.groupBy(*keys, "_span").agg(F.product(1 + F.col("ret")).alias("_product"))
    times = lambda a, x: F.when(a.isNull(), x["_product"]).otherwise(a * F.coalesce(x["_product"], F.lit(1.0)))
    placed = with_before(own.withColumn("_local", F.product(1 + F.col("ret")).over(run)), totals, keys, "_span", F.lit(None).cast("double"), times, "_before")
    cum = F.when(F.col("_before").isNull(), F.col("_local")).otherwise(F.col("_before") * F.coalesce("_local", F.lit(1.0)))
    return placed.withColumn("cum", cum).drop("_span", "_local", "_before")


def drawdowns(returns: DataFrame, keys: Sequence[str] = (), span: str = "year") -> DataFrame:
    """drawdown from the running peak of cum, which starts at the first value; peaks are taken in spans and over the spans before, as in cumulative()."""
    own = _spans(cumulative(returns, keys, span), span)
    run = Window.partitionBy(*keys, "_span").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    totals = own.groupBy(*keys, "_span").agg(F.max("cum").alias("_top"))
    placed = with_before(own.withColumn("_local", F.max("cum").over(run)), totals, keys, "_span", F.lit(None).cast("double"), lambda a, x: F.greatest(a, x["_top"]), "_before")
    return placed.withColumn("peak", F.greatest("_before", "_local")).withColumn("drawdown", (F.col("cum") - F.col("peak")) / F.col("peak")).drop("_span", "_local", "_before")


def rolling_sharpe(returns: DataFrame, window: int = 63, rf: float = RISK_FREE, keys: Sequence[str] = (), span: str = "year") -> DataFrame:
    """sharpe over the last `window` rows; null until there are so many, or where they don't vary.

    Rows get their number from counts of calendar spans, and frames are taken in blocks of rows that overlap.
    """

    def sharpe(frame: Window) -> dict[str, Column]:
        mean, spread = F.avg(F.col("ret") - rf / TRADING_DAYS).over(frame), F.stddev_samp("ret").over(frame)
        return {"sharpe": F.when((F.count("ret").over(frame) == window) & (spread > 0), mean / spread * F.sqrt(F.lit(float(TRADING_DAYS))))}

    placed = with_position(_spans(returns, span), ["date"], keys, "_span", "_position")
    return over_blocks(placed, "_position", keys, window - 1, max(4 * window, 1024), sharpe).drop("_span", "_position")


def risk_aggregates(rf: float = RISK_FREE) -> list[Column]:
    """Volatility, Sharpe, 5 % quantile and CAGR of (date, ret); null where undefined."""
    spread, days = F.stddev_samp("ret"), F.datediff(F.max("date"), F.min("date"))
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    return [
        (spread * year).alias("volatility"),
        F.when(spread > 0, F.avg(F.col("ret") - rf / TRADING_DAYS) / spread * year).alias("sharpe"),
        F.percentile("ret", F.lit(0.05)).alias("var_95"),
        F.when((F.count("ret") >= 2) & (days > 0), F.pow(F.product(1 + F.col("ret")), F.lit(365.25) / days) - 1).alias("cagr"),
    ]


def max_drawdown(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return drawdowns(returns, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def beta_alpha(returns: DataFrame, benchmark: DataFrame, rf: float = RISK_FREE) -> DataFrame:
    """beta on common dates; alpha with means over each series' own dates."""
    both = returns.join(benchmark.withColumnRenamed("ret", "bench"), "date")
    beta = both.agg(F.when((F.count("*") >= 2) & (F.var_samp("bench") > 0), F.covar_samp("ret", "bench") / F.var_samp("bench")).alias("beta"))
    mean = lambda df, name: df.agg((F.avg("ret") * TRADING_DAYS).alias(name))  # noqa: E731  one row each
    row = beta.join(mean(returns, "p")).join(mean(benchmark, "b"))
    return row.select("beta", (F.col("p") - (rf + F.col("beta") * (F.col("b") - rf))).alias("alpha"))


def risk_report(returns: DataFrame, benchmark: DataFrame, rf: float = RISK_FREE) -> DataFrame:
    """One row of all figures."""
    return returns.agg(*risk_aggregates(rf)).join(max_drawdown(returns)).join(beta_alpha(returns, benchmark, rf))


def correlations(prices: DataFrame) -> DataFrame:
    """(a, b, corr) of returns on the dates that all tickers have; null for a constant ticker."""
    rets = pct_change(prices).where(F.col("ret").isNotNull()).select("date", "ticker", "ret")
    n = rets.select("ticker").distinct().agg(F.count("*").alias("n"))
    days = rets.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("ticker", "ret"))).alias("r"), F.count("*").alias("have"))
    full = days.join(F.broadcast(n), F.col("have") == F.col("n"))
    pair = full.select(F.explode("r").alias("x"), "r").select("x", F.explode("r").alias("y")).groupBy(F.col("x.ticker").alias("a"), F.col("y.ticker").alias("b"))
    spread = F.stddev_pop("x.ret") * F.stddev_pop("y.ret")
    return pair.agg(F.when(spread > 0, F.covar_pop("x.ret", "y.ret") / spread).alias("corr"))


def weight_tree(holdings: DataFrame) -> DataFrame:
    """(node, parent, value): leaves with their weight, sleeves with 0."""
    leaves = holdings.select(F.col("ticker").alias("node"), F.col("sleeve").alias("parent"), F.col("weight").alias("value"))
    roots = holdings.select(F.col("sleeve").alias("node")).distinct().select("node", F.lit("").alias("parent"), F.lit(0.0).alias("value"))
    return leaves.unionByName(roots)


def weight_totals(holdings: DataFrame) -> DataFrame:
    """(sleeve, ticker, weight) of every holding, of every sleeve (ticker null) and of all (both null), in one pass by rollup. Names must not be null."""
    return holdings.rollup("sleeve", "ticker").agg(F.sum("weight").alias("weight"))


def weight_checks(holdings: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per sleeve the sum of its holdings' weights and whether it is 1 within the tolerance."""
    total = F.sum("weight")
    return holdings.groupBy("sleeve").agg(total.alias("total"), (F.abs(total - 1) <= tolerance).alias("ok"))


def latest(prices: DataFrame) -> DataFrame:
    """Each ticker's value on its last date."""
    return prices.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
