"""The data source gives the parsers' rows, and filters reach its reader."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import providers as plans
from tessera.sources import providers as P
from tessera.sources import saved as V

BUILT = {"observations": plans.as_observations, "records": plans.as_records, "json_stat": plans.as_json_stat, "sdmx": plans.as_sdmx}


def rows(df):
    return sorted(map(tuple, df.select("date", "value", "series_id", "source").collect()))


@pytest.fixture(scope="module")
def load(spark):
    V.register(spark)
    return lambda provider, path: spark.read.format("saved_series").option("provider", provider).load(path)


@pytest.mark.parametrize("provider", BUILT)
def test_equals_the_parsers(spark, sf_dir, tmp_path, load, provider):
    payloads = BUILT[provider](spark, sf_dir).limit(40)
    payloads.repartition(3).write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    assert rows(load(provider, f"{tmp_path}/p")) == rows(P.parser(provider)(stored)) != []


def test_nested_series_and_bad_payloads(spark, sf_dir, tmp_path, load):
    bad = [(k, p) for k, p in [("a", None), ("b", ""), ("c", "nonsense"), ("d", "{}"), ("e", "[1, null, {}]"), ("f", json.dumps([{"date": "2020-13-01", "value": "1"}, {"date": "2020-02-03", "value": "NaN"}, {"date": "2020-02-04", "value": "."}, {"date": "2020-02-05", "value": "2.5"}]))]]
    df = spark.createDataFrame(bad, "series_id string, payload string").unionByName(plans.as_series(spark, sf_dir).limit(5))
    df.write.parquet(f"{tmp_path}/p")
    for provider in V.FORMATS:
        assert rows(load(provider, f"{tmp_path}/p")) == rows(P.parser(provider)(spark.read.parquet(f"{tmp_path}/p")))


def test_filters_are_pushed(spark, sf_dir, tmp_path, load):
    plans.as_records(spark, sf_dir).write.parquet(f"{tmp_path}/p")
    day = datetime.date(1995, 6, 1)
    some = [r[0] for r in spark.read.parquet(f"{tmp_path}/p").select("series_id").limit(4).collect()]
    where = F.col("series_id").isin(some) & (F.col("date") >= F.lit(day)) & (F.col("value") > 1)
    got = load("records", f"{tmp_path}/p").where(where)
    assert rows(got) == rows(P.records(spark.read.parquet(f"{tmp_path}/p")).where(where)) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x and "Scan" not in x]
    assert "BatchScan" in plan and all("series_id" not in x.split("Filter", 1)[1] and "date" not in x.split("Filter", 1)[1] for x in filters)


def test_reader_takes_and_returns_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = V.SavedReader("x", "records")
    left = [*reader.pushFilters([In(("series_id",), ("a", "b")), EqualTo(("series_id",), "b"), GreaterThan(("value",), 2.0), GreaterThan(("date",), datetime.date(2020, 1, 1))])]
    assert reader.wanted == {"b"} and reader.bounds == [("gt", datetime.date(2020, 1, 1))] and left == [GreaterThan(("value",), 2.0)]


def test_errors_and_empty_folders(spark, tmp_path, load):
    (tmp_path / "none").mkdir()
    assert load("records", str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no provider 'other'"):
        load("other", str(tmp_path / "none")).count()


@pytest.mark.parametrize(("period", "day"), [("2024", (2024, 1, 1)), ("2024-Q3", (2024, 7, 1)), ("2024Q1", (2024, 1, 1)), ("2024-11", (2024, 11, 1)), ("2024-02-29", (2024, 2, 29)), ("2023-02-29", None), ("x", None), (None, None)])
def test_periods(period, day):
    assert V.first_day(period) == (datetime.date(*day) if day else None)
