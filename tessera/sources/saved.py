"""Saved provider payloads as a Spark data source: spark.read.format("saved_series").option("provider", name).load(folder).

The folder holds Parquet files of (series_id, payload) on a store that pyarrow opens (local, hdfs, s3). Each file is a
partition. Filters on series_id are pushed to the files' row groups, and bounds of date to the parsed rows, so they
never leave the reader; Spark asks for that with spark.sql.python.filterPushdown.enabled. Rows and formats are those of
the parsers in providers.py.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

Pairs = Iterable[tuple[Any, Any]]


def _listed(payload: Any) -> Pairs:
    return [(x.get("date"), x.get("value")) for x in payload if isinstance(x, dict)]


def _json_stat(payload: Any) -> Pairs:
    values, index = payload["value"], payload["dimension"]["time"]["category"]["index"]
    return [(period, values.get(str(at))) for period, at in index.items()]


def _sdmx(payload: Any) -> Pairs:
    dims = payload["structure"]["dimensions"]["observation"]
    periods = next((d for d in dims if "TIME" in d.get("id", "").upper()), dims[-1])["values"]
    first = payload["dataSets"][0]
    seen = [*(first.get("observations") or {}).items()] + [o for s in (first.get("series") or {}).values() for o in (s.get("observations") or {}).items()]
    places = [(int(k.rsplit(":", 1)[-1]), v) for k, v in seen if re.fullmatch(r"\d+", k.rsplit(":", 1)[-1])]
    return [(periods[at]["id"], v[0] if v else None) for at, v in places if at < len(periods)]


FORMATS: dict[str, Callable[[Any], Pairs]] = {"observations": lambda p: _listed(p["observations"]), "records": _listed, "json_stat": _json_stat, "sdmx": _sdmx}


def first_day(period: str | None) -> datetime.date | None:
    """The first day of 2024, 2024-03, 2024-Q1 or 2024-03-05."""
    m = re.fullmatch(r"(\d{4})(?:-?Q([1-4])|-(\d{2})(?:-(\d{2}))?)?", period or "")
    try:
        return datetime.date(int(m[1]), 3 * int(m[2]) - 2 if m[2] else int(m[3] or 1), int(m[4] or 1)) if m else None
    except ValueError:
        return None


def number(x: Any) -> float | None:
    try:
        value = float(x)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(value) or "_" in str(x) else value


def parsed(provider: str, payload: str | None) -> Iterator[tuple[datetime.date, float]]:
    """(date, value) of a payload; what doesn't parse is skipped."""
    try:
        pairs = FORMATS[provider](json.loads(payload or "null"))
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return
    for period, raw in pairs:
        day, value = first_day(period), number(raw)
        if day is not None and value is not None and (provider in ("json_stat", "sdmx") or len(period) == 10):
            yield day, value


class SavedSeries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_series"

    def schema(self) -> str:
        return "date date, value double, series_id string, source string"

    def reader(self, schema: StructType) -> DataSourceReader:
        if (provider := self.options.get("provider")) not in FORMATS:
            raise ValueError(f"no provider {provider!r}; there are {', '.join(sorted(FORMATS))}")
        if "path" not in self.options:
            raise ValueError("saved_series needs a path")
        return SavedReader(self.options["path"], provider)


class SavedReader(DataSourceReader):
    def __init__(self, path: str, provider: str) -> None:
        self.path, self.provider = path, provider
        self.wanted: set[str] | None = None
        self.bounds: list[tuple[str, datetime.date]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of series_id, comparisons of date with a value, and what asks for no nulls; the rest is Spark's."""
        signs = {GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", EqualTo: "eq"}
        for f in filters:
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if isinstance(f, (EqualTo, In)) and f.attribute == ("series_id",) and None not in values:
                self.wanted = set(values) if self.wanted is None else self.wanted & set(values)
            elif type(f) in signs and f.attribute == ("date",) and isinstance(f.value, datetime.date):
                self.bounds.append((signs[type(f)], f.value))
            elif not isinstance(f, IsNotNull):  # no row has a null
                yield f

    def files(self) -> tuple[fs.FileSystem, list[str]]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(root) :].split("/"))
        return store, sorted(x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(".parquet") and not hidden(x.path))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.files()[1]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import operator

        if partition.value is None:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        only = pc.field("series_id").isin(sorted(self.wanted)) if self.wanted is not None else None
        table = pq.read_table(partition.value, filesystem=store, columns=["series_id", "payload"], filters=only, partitioning=None)
        for batch in table.to_batches(max_chunksize=1024):
            rows = [(d, v, s) for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for d, v in parsed(self.provider, p)]
            rows = [r for r in rows if all(getattr(operator, sign)(r[0], bound) for sign, bound in self.bounds)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.date32(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([self.provider] * len(rows), pa.string())], ["date", "value", "series_id", "source"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedSeries)
