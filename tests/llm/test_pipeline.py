import random
import re

import corpus_pipeline
from tessera.llm import quality, simhash_dedup


def sentence(r, n=60):
    return " ".join("".join(r.choice(["ta", "ri", "mo", "len", "su", "ka"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, folder):
    r = random.Random(2)
    clean = [sentence(r) for _ in range(60)]
    junk = [" ".join(r.choice(["BUY!!", "NOW!!", "$$$", "###"]) + str(r.randint(0, 9)) for _ in range(60)) for _ in range(40)]
    item = sentence(r, 25)
    near = clean[1].split()
    near[30] = "changed"
    texts = clean + junk + [clean[0], " ".join(near), "Before it. " + item + " after " + sentence(r, 20)]
    labels = [(i, int(i < 60), 0) for i in range(100)]
    out = corpus_pipeline.run(spark, folder(texts, labels, [(1, item)]))
    assert sorted(x["doc_id"] for x in out.collect()) == list(range(60))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_stages_of_odd_rows_and_columns(spark, tmp_path):
    r = random.Random(4)
    good = [sentence(r) for _ in range(20)]
    texts = [*good, None, "", good[0], good[0], sentence(r, 20000)]
    rows = [(i if i != 5 else None, t, "en", None, len(t or ""), 7, "u") for i, t in enumerate(texts)] + [(0, good[0], "en", None, 1, 7, "u")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid int, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (1, "not there at all, this one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(x["doc_id"] == 0 for x in out) == 1 and sum(x["doc_id"] is None for x in out) == 1
    assert {x["doc_id"] for x in out} - {20, 21} == {None, *range(20), 24} - {5}


def test_near_duplicates_are_found(spark, sf_dir):
    """Recall and precision against all pairs of the documents, which are compared as sets of five-word shingles."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets, first = [], {}
    for x in sorted(rows, key=lambda x: x["doc_id"]):
        w = [y for y in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), x["text"] or "")) if y]
        own = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        sets.append((x["doc_id"], own))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d, own in sets:
        seen = {}
        for s in own or [None]:
            for e in holders.setdefault(s, []):
                seen[e] = seen.get(e, 0) + 1
            holders[s].append(d)
        for e, n in seen.items():
            if not own or n >= 0.8 * (len(own) + len(first[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        first[d] = own
    got = {x["doc_id"] for x in simhash_dedup.without_near_duplicates(docs).collect()}
    want = {d for d in root if find(d) == d}
    gone = set(root) - want
    assert gone and len(gone - got) >= 0.99 * len(gone) and not want - got


def test_workers_keep_no_powers_between_tasks():
    """What a task kept to hash long texts is gone when it has ended, so workers that wait hold nothing of it."""
    from tessera.llm import textbytes
    from tessera.llm.staging import tidy

    def hashes(batches):
        for batch in batches:
            textbytes.powers(1 << 18)
            yield batch

    assert list(tidy(hashes)([1, 2])) == [1, 2] and not textbytes._powers


def test_stages_of_an_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = quality.op3_subword_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    own = [x["predicted"] == x["quality"] for x in rows if x["held_out"]]
    assert len(own) > 5 and sum(own) / len(own) > 0.9
    scores = [x["score"] for x in rows]
    assert all(0 <= s <= 1 for s in scores)


def test_near_duplicates_take_few_queries(spark, documents, monkeypatch):
    """The driver's memory grows with the queries that it plans, their broadcasts and threads, however small their tables are."""
    from tessera import staging
    from tessera.llm import components

    r = random.Random(8)
    base = [sentence(r, 80).split() for _ in range(40)]
    texts = [" ".join(f"new{r.random()}" if r.random() < 0.02 else w for w in b) for b in base for _ in range(6)]
    made = []
    for module in (simhash_dedup, components):
        monkeypatch.setattr(module, "materialise", lambda df, name: made.append(name) or staging.materialise(df, name))
    assert 40 <= simhash_dedup.without_near_duplicates(documents(texts)).count() < len(texts)
    assert len(made) <= 26, made
