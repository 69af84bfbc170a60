import datetime
import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import series as S


def frame(spark, rets, start="2024-01-02"):
    days = pd.bdate_range(start, periods=len(rets)).date
    return spark.createDataFrame(list(zip(days, map(float, rets))), "date date, ret double")


def figures(spark, rets):
    return frame(spark, rets).agg(*S.risk_aggregates()).first()


def test_zero_volatility_and_single_row_give_nulls(spark):
    assert figures(spark, [0.0] * 20)["sharpe"] is None
    one = figures(spark, [0.01])
    assert one["sharpe"] is None and one["cagr"] is None


def test_max_drawdown(spark):
    assert S.max_drawdown(frame(spark, [-0.1] * 3)).first()[0] == pytest.approx(-0.19)
    assert S.max_drawdown(frame(spark, [0.01, 0.02, 0.005])).first()[0] == 0.0


def test_cagr_of_a_year(spark):
    assert figures(spark, [1.10 ** (1 / 252) - 1] * 252)["cagr"] == pytest.approx(0.104, abs=0.002)


def test_figures_equal_numpy(spark):
    r = np.random.default_rng(1).normal(0.001, 0.01, 120)
    row = figures(spark, r)
    assert row["volatility"] == pytest.approx(r.std(ddof=1) * math.sqrt(252))
    assert row["var_95"] == pytest.approx(np.percentile(r, 5))


def test_beta_of_a_clone_is_one(spark):
    r = frame(spark, np.random.default_rng(7).normal(0.0004, 0.01, 100))
    row = S.beta_alpha(r, r).first()
    assert row["beta"] == pytest.approx(1) and abs(row["alpha"]) < 0.01


def test_padding_fills_interior_gaps(spark):
    d = [datetime.date(2024, 1, i) for i in (1, 2, 3)]
    prices = spark.createDataFrame([(d[0], "a", 1.0), (d[1], "a", 2.0), (d[2], "a", 4.0), (d[0], "b", 10.0), (d[2], "b", 30.0)], "date date, ticker string, value double")
    assert S.portfolio_returns(prices, {"a": 0.5, "b": 0.5}).count() == 2
    assert S.portfolio_returns(prices, {"a": 0.5, "b": 0.5}, fill="none").count() == 0


def test_rolling_sharpe_waits_for_a_full_window(spark):
    rows = S.rolling_sharpe(frame(spark, np.random.default_rng(3).normal(0, 0.01, 30)), window=10).orderBy("date").collect()
    assert [r["sharpe"] is None for r in rows] == [True] * 9 + [False] * 21


def test_constant_ticker_has_no_correlation(spark):
    d = [datetime.date(2024, 1, i) for i in range(1, 6)]
    prices = spark.createDataFrame([(x, t, v) for i, x in enumerate(d) for t, v in (("a", 1.0 + i * i), ("b", 2.0))], "date date, ticker string, value double")
    got = {(r["a"], r["b"]): r["corr"] for r in S.correlations(prices).collect()}
    assert got["a", "a"] == pytest.approx(1) and got["a", "b"] is None
