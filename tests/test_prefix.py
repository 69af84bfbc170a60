"""Prefix scans equal one window over all rows, and plans have no such window."""

import datetime
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import prefix as X
from tessera.operators import series as S


def returns_of(spark, keyed=False, n=900, seed=2):
    r = random.Random(seed)
    rows, day = [], datetime.date(1999, 11, 1)
    for i in range(n):
        day += datetime.timedelta(days=r.choice([1, 1, 1, 3, 40 if i % 50 == 0 else 1, 800 if i == 500 else 1]))
        for k in ("a", None, "b") if keyed else ("a",):
            if not keyed or r.random() < 0.8:
                rows.append((day, k, r.choice([None, 0.0, -1.0 if i == 700 else 0.01]) if r.random() < 0.1 else r.gauss(0, 0.02)))
    return spark.createDataFrame(rows, "date date, ticker string, ret double")


def plain(df, keys, window=63):
    by = Window.partitionBy(*keys).orderBy("date")
    run, frame = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1 - window, 0)
    out = df.withColumn("cum", F.product(1 + F.col("ret")).over(run)).withColumn("peak", F.max("cum").over(run)).withColumn("drawdown", F.try_divide(F.col("cum") - F.col("peak"), F.col("peak")))
    spread = F.stddev_samp("ret").over(frame)
    sharpe = F.avg(F.col("ret") - S.RISK_FREE / 252).over(frame) / spread * F.sqrt(F.lit(252.0))
    return out.withColumn("sharpe", F.when((F.count("ret").over(frame) == window) & (spread > 0), sharpe))


def rows(df, *columns):
    value = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[c]) for c in ("date", "ticker", *columns)) for r in df.collect())


@pytest.mark.parametrize("keys", [(), ("ticker",)])
@pytest.mark.parametrize("span", ["year", "month"])
def test_scans_equal_one_window(spark, keys, span):
    df = returns_of(spark, bool(keys)).cache()
    want = plain(df, keys).cache()
    assert rows(S.cumulative(df, keys, span), "cum") == rows(want, "cum")
    assert rows(S.drawdowns(df, keys, span), "peak", "drawdown") == rows(want, "peak", "drawdown")
    assert rows(S.rolling_sharpe(df, keys=keys, span=span), "sharpe") == rows(want, "sharpe")
    assert rows(S.rolling_sharpe(df, window=5, keys=keys), "sharpe") == rows(plain(df, keys, 5), "sharpe")


def test_no_window_over_all_rows(spark):
    df = returns_of(spark)
    for out in (S.cumulative(df), S.drawdowns(df), S.rolling_sharpe(df), S.max_drawdown(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)
        assert windows and all("_span" in w or "_block" in w for w in windows)


def test_blocks_overlap(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("at"))
    out = X.over_blocks(df, "at", (), 6, 10, lambda w: {"n": F.count("*").over(w), "low": F.min("at").over(w)})
    assert sorted(map(tuple, out.collect())) == [(i, min(i + 1, 7), max(0, i - 6)) for i in range(1000)]


def test_numbers_have_no_gaps(spark):
    r = random.Random(1)
    keys = r.sample(range(10**6), 700) + [None]
    out = X.numbered(spark.createDataFrame([(k, "a" if i % 3 else "b") for i, k in enumerate(keys)], "k int, s string").repartition(7), F.col("s").desc(), F.col("k").asc_nulls_last())
    got = [(x["s"], x["k"]) for x in sorted(out.collect(), key=lambda x: x["number"])]
    assert [x["number"] for x in sorted(out.collect(), key=lambda x: x["number"])] == list(range(1, 702))
    assert got == sorted(got, key=lambda x: (-ord(x[0]), x[1] is None, x[1] or 0))
    assert X.numbered(spark.createDataFrame([], "k int"), "k").count() == 0


def test_empty_series(spark):
    df = spark.createDataFrame([], "date date, ret double")
    assert [f(df).count() for f in (S.cumulative, S.drawdowns, S.rolling_sharpe)] == [0, 0, 0]
