"""Operator 13 against row-by-row simulation of all orders, and against SQL."""

import random
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit as A

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(rows):
    out = []
    for doc_id, text, source in rows:
        t = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in rows)
        out.append((source or "", f))
    return out


def simulated(rows, labels):
    """Every order applied row by row."""
    marked = [(p, f, {i for i, q, _ in labels if q == 1 and i == d and d is not None}, {i for i, _, x in labels if x == 1 and i == d and d is not None}) for (p, f), (d, _, _) in zip(fails(rows), rows)]
    out, total = {}, {}
    for part in {p for p, *_ in marked}:
        for order in map("".join, permutations("ABCDE")):
            live = [m for m in marked if m[0] == part]
            everyone, seen = live, []
            for i, f in enumerate(order):
                gone, live = [m for m in live if m[1][f]], [m for m in live if not m[1][f]]
                bad = [m for m in everyone if m[1][f]]
                out[part, order, i + 1] = [len(live), len(gone), len(bad) - len(gone), sum(sum(m[1].values()) == 1 for m in bad), sum(bool(m[2]) for m in gone), sum(bool(m[3]) for m in gone), f]
                total[part, f] = total.get((part, f), 0) + len(gone)
                seen.append(f)
    return {k: (*v[:-1], total[k[0], v[-1]]) for k, v in out.items()}


def some_rows(n=60, seed=4):
    r = random.Random(seed)
    base = ["word " * k + " ".join(f"w{i}" for i in range(m)) + end for k, m in ((0, 5), (300, 3), (0, 250), (120, 110), (199, 0), (200, 0)) for end in ("", " $", " ABCDEF" * 20, "\x0b\xa0x")]
    rows = [(i, r.choice(base), r.choice(["s", "t", None, ""])) for i in range(n)]
    return rows + [(3, rows[3][1], "s"), (3, rows[3][1], "s"), (None, rows[0][1], "u"), (None, None, "u"), (900, None, "u"), (901, "", "v")]


@pytest.fixture
def table_folder(spark, tmp_path):
    def write(rows, labels, schema="doc_id long, text string, source string"):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("hot", [1, 1000])
def test_orders_equal_simulation_and_sql(spark, table_folder, monkeypatch, hot):
    monkeypatch.setattr(A, "HOT", hot)
    rows = some_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(40)] + [(3, 1, 1), (None, 1, 1), (5000, 1, 1)]
    path = table_folder(rows, labels)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIELDS) for r in A.op13_filter_audit(spark, path).collect()}
    want = simulated(rows, labels)
    assert got == want and len(got) == 600 * 5
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    found = con.execute(A.ORACLE_SQL["op13_filter_audit"])
    names = [d[0] for d in found.description]
    assert {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in FIELDS) for x in (dict(zip(names, v)) for v in found.fetchall())} == want


def test_copies_of_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"))
    assert A.with_later_copies(rows).count() == 999


def test_empty_table(spark, table_folder):
    assert A.op13_filter_audit(spark, table_folder([], [])).count() == 0


def test_schema(spark, table_folder):
    out = A.op13_filter_audit(spark, table_folder([(1, "a", "s")], []))
    assert dict(out.dtypes) == {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(FIELDS, "bigint")}
