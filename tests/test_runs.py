"""Evaluation runs, rollups, drafts, resets and metadata filters."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.operators import series as S

HITS = [(1, "a", 1, 1), (1, "b", 2, 2), (2, "b", 2, 1)]
CORPUS = [("a", 1), ("b", 2), ("c", 3)]


@pytest.fixture
def run(spark):
    hits = spark.createDataFrame(HITS, "query_id int, source string, page int, rank int")
    corpus = spark.createDataFrame(CORPUS, "source string, page int")
    return lambda gold, path: E.evaluate(hits, spark.createDataFrame(gold, "query_id int, source string, page int"), corpus, path, (1, 2))


def test_evaluation_writes_scores_once(spark, run, tmp_path):
    gold = [(1, "b", 2), (2, "c", 3), (3, "a", 1)]
    row = run(gold, f"{tmp_path}/r").first()
    scores = {r["query_id"]: r for r in spark.read.parquet(f"{tmp_path}/r/scores").collect()}
    assert sorted(scores) == [1, 2, 3] and row["n_questions"] == 3
    assert row["hit_2"] == pytest.approx(1 / 3) and row["rr"] == pytest.approx(0.5 / 3)
    assert row.asDict() == {"n_questions": 3, **{c: pytest.approx(sum(r[c] for r in scores.values()) / 3) for c in row.asDict() if c != "n_questions"}}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        run(gold, f"{tmp_path}/r")


def test_unknown_gold_pages_stop_a_run(run, tmp_path):
    with pytest.raises(ValueError, match=r"1: x p9; 2: y p0; 2: y p1; 2: y p2; 2: y p3; and 2 more"):
        run([(1, "x", 9), (1, "a", 1), *[(2, "y", i) for i in range(6)]], f"{tmp_path}/r")
    assert not (tmp_path / "r").exists()


def test_evaluation_without_questions(run, tmp_path):
    row = run([], f"{tmp_path}/r").first()
    assert row["n_questions"] == 0 and row["rr"] == 0.0


def test_coverage_report_is_one_pass(spark):
    rows = [("a", "x" * 300, 0), ("a", "", 2), ("b", " ", 0), ("b", None, 1), ("b", "", 1), (None, "short", 1)]
    pages = spark.createDataFrame(rows, "source string, text string, n_images int")
    out = C.coverage_report(pages)
    assert [tuple(r) for r in out.collect()] == [("b", 3, 1, 2, 0, 0), ("a", 2, 0, 1, 0, 1), ("", 1, 0, 0, 1, 0), (None, 6, 1, 3, 1, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert C.coverage_report(pages.limit(0)).count() == 0


def test_weight_totals(spark):
    held = spark.createDataFrame([("s", "a", 0.25), ("s", "b", 0.75), ("t", "a", 0.5)], "sleeve string, ticker string, weight double")
    assert {(r["sleeve"], r["ticker"]): r["weight"] for r in S.weight_totals(held).collect()} == {("s", "a"): 0.25, ("s", "b"): 0.75, ("t", "a"): 0.5, ("s", None): 1.0, ("t", None): 0.5, (None, None): 1.5}


def test_drafts_are_numbered_without_gaps(spark):
    rows = [(i, f"c{i:020}", "src", i, f"1. Is it {i}?" if i % 3 else "no question") for i in range(1600, 0, -1)]
    chunks = spark.createDataFrame(rows, "n int, chunk_id string, source string, page int, answer string")
    out = C.drafts(chunks, F.col("answer"), "n").collect()
    want = [i for i in range(1, 1601) if i % 3]
    assert sorted((r["id"], r["page"], r["question"]) for r in out) == sorted((f"draft{k:03}", i, f"Is it {i}?") for k, i in enumerate(want, 1))
    assert out[0]["note"].startswith("drafted from chunk c") and len(out[0]["note"]) == 31 and out[0]["provenance"] == "synthetic-draft"


def test_reset(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, source string")
    rows.write.partitionBy("source").parquet(f"{tmp_path}/t")
    C.reset(f"{tmp_path}/t", rows)
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/t").count() == 0


def test_metadata_filters(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, None, 1)], "chunk_id int, doc_type string, year int")
    ids = lambda v: sorted(r["chunk_id"] for r in R.having(rows, v).collect())
    assert (ids({}), ids({"doc_type": "a"}), ids({"doc_type": "a", "year": 1}), ids({"doc_type": None}), ids({"year": 1})) == ([1, 2, 3, 4], [1, 2], [1], [], [1, 3, 4])
    with pytest.raises(ValueError, match="colour"):
        R.having(rows, {"colour": 1})


def test_contained_tails_of_all_kinds(spark):
    long = "one two three four five six seven eight nine"
    rows = [("s", 1, long, "long"), ("s", 1, "wo three four five", "inner"), ("s", 1, "o thr", "two words"), ("s", 1, "ive", "one word"), ("s", 1, "ne", "short"), ("s", 1, "e", "letter"), ("s", 1, "three  four", "other space"), ("s", 1, "four three", "order"), ("s", 2, "two three four", "other page"), (None, 1, "x y z", "n1"), (None, 1, "x y", "n2"), ("s", 1, long, "copy"), ("s", 1, None, "null"), ("s", 1, "", "empty")]
    r = random.Random(8)
    for page in range(10, 16):
        words = [r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(70)]
        rows.append(("t", page, " ".join(words), f"t{page}"))
        for k in (1, 2, 3, 5, 17, 18, 19, 20, 21, 40):
            at = r.randint(0, 70 - k)
            text = " ".join(words[at : at + k])
            rows += [("t", page, text, f"t{page}-{k}"), ("t", page, text[1:-1], f"t{page}-{k} cut"), ("t", page, text + "x", f"t{page}-{k} more")]
    chunks = spark.createDataFrame(rows, "source string, page int, content string, chunk_id string")
    content = {r[3]: r for r in rows}
    want = sorted(k for k, (s, p, c, _) in content.items() if c and s and any(s == t and p == q and d and len(d) > len(c) and c in d for t, q, d, _ in rows))
    assert sorted(r["chunk_id"] for r in C.contained_tails(chunks).collect()) == want
    assert sorted(r["chunk_id"] for r in C.contained_tails(chunks, 2).collect()) == [k for k in want if len(content[k][2].split()) <= 2]


def test_small_and_large_pages_have_the_same_tails(spark, monkeypatch):
    """Pages of few chunks are compared in one row, others by their grams; a page may be large by its characters too."""
    r = random.Random(9)
    rows = []
    for page in range(12):
        words = [r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(60)]
        rows.append(("s", page, " ".join(words), f"{page}"))
        rows += [("s", page, " ".join(words[at : at + r.choice((1, 4, 25))]), f"{page}-{at}") for at in r.sample(range(30), page)]
        rows += [("s", page, " ".join(words[::-1][:20]), f"{page} back"), ("s", page, None, f"{page} null"), (None, page, "ab", f"{page} no source")]
    chunks = spark.createDataFrame(rows, "source string, page int, content string, chunk_id string").repartition(3)
    want = sorted(k for s, p, c, k in rows if c and s and any(s == t and p == q and d and len(d) > len(c) and c in d for t, q, d, _ in rows))
    for most, chars in ((64, 1 << 20), (6, 1 << 20), (64, 500), (1, 1)):
        monkeypatch.setattr(C, "PAGE_CHUNKS", most)
        monkeypatch.setattr(C, "PAGE_CHARS", chars)
        assert sorted(x["chunk_id"] for x in C.contained_tails(chunks).collect()) == want
    monkeypatch.setattr(C, "PAGE_CHUNKS", 64)
    monkeypatch.setattr(C, "PAGE_CHARS", 1 << 20)
    plan = C.contained_tails(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1  # contents go to their page once, and nothing else
