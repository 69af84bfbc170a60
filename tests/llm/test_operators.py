"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import components, decontamination, encoding, fingerprints, licenses, lm_scoring, quality, queries, resharding, simhash_dedup, suffix_dedup, wrappers
from tessera.llm.pieces import MODEL, Pieces, load_pieces

ODD = [None, "", " \n ", "a", "a", "Ab ab AB " * 4000, "é ü ñ \U0001f600 日本 ▁x", "x" * 3000, "The quick brown fox jumps over the lazy dog.\n" * 3, "\t\x0b\x0c"]


def sorted_rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r[key])


def texts_of(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(n)]
    copies = [b for b in base[:8]] + [b.replace(" ", " zz ", 2) for b in base[:8]] + [base[0] + " " + base[1], base[2][20:120]]
    return base + copies + ODD


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, folder([])).count() == 0


def test_fingerprints(spark, folder):
    texts = texts_of(1)
    rows = sorted_rows(fingerprints.op1_simhash_fingerprints(spark, folder(texts)))
    prints = {}
    for i, r in enumerate(rows):
        t, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        bits = bin(int(r["fingerprint"], 16) ^ int(rows[(i + 1) % len(rows)]["fingerprint"], 16)).count("1")
        assert r["near_next"] == pytest.approx(1 - bits / 128)
        assert 0 <= r["near_edited"] <= 1
    assert rows[texts.index("")]["fingerprint"] == "0" * 32
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows[:40]]) > 0.9


def test_fingerprint_votes_and_near_counts(spark, folder):
    from tessera.llm.textbytes import LOWER, span_hashes, utf8, words

    texts = ["b a a c " * k + "x" * (k % 3) for k in range(1, 7)] * 40 + [None, "", "same same"]
    rows = sorted_rows(fingerprints.op1_simhash_fingerprints(spark, folder(texts)))
    data, offsets = utf8(pa.array(texts[:12]))
    starts, ends, bounds = words(LOWER[data], offsets)
    hashes = span_hashes(LOWER[data], starts, ends).tolist()
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        votes = [0.0] * 128
        for h, n in Counter(hashes[a:b]).items():
            weight = round(64 * (1 + math.log(n)))
            for half, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                own = np.unpackbits(fingerprints.mix(np.array([h], np.uint64), salt).view(np.uint8))
                for k in range(64):
                    votes[64 * half + k] += weight if own[k] else -weight
        assert rows[i]["fingerprint"] == np.packbits(np.array(votes) > 0).tobytes().hex()
    prints = {int(r["fingerprint"], 16) for r in rows}
    for r in rows:
        own = int(r["fingerprint"], 16)
        assert r["n_near"] == (sum(0 < (own ^ p).bit_count() <= 3 for p in prints) if r["doc_id"] % 100 == 0 else None)


def test_fingerprints_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "a b"), (1, None)], "doc_id long, text string")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprints.beside_next(fingerprints.with_fingerprint(docs), ["text"]).collect()
    assert sorted((r["doc_id"] or 0, r["next_text"]) for r in rows) == [(0, ""), (1, "a b"), (2, "a b"), (2, "a b")]


def test_block_tables_find_all_pairs(spark):
    r = random.Random(3)
    values = [r.getrandbits(128) for _ in range(60)]
    values += [v ^ sum(1 << r.randrange(128) for _ in range(k)) for v in values[:30] for k in (1, 3, 4)]
    df = spark.createDataFrame([(f"{v:032x}",) for v in values], "fingerprint string")
    got = {(x["query"], x["fingerprint"], x["distance"]) for x in fingerprints.near_fingerprints(df, df).collect()}
    want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    assert got == want


def test_min_cost_flow_is_optimal():
    r = random.Random(5)
    for _ in range(20):
        supply, cost = [r.randint(0, 6) for _ in range(3)], [[r.randint(0, 5) for _ in range(3)] for _ in range(3)]
        capacity = [r.randint(0, 6) for _ in range(2)]
        capacity.append(max(0, sum(supply) - sum(capacity)))
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(x) for x in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(3))
        best = math.inf

        def search(i, room, total):
            nonlocal best
            if i == 3:
                best = min(best, total)
                return
            for a in range(min(supply[i], room[0]) + 1):
                for b in range(min(supply[i] - a, room[1]) + 1):
                    c = supply[i] - a - b
                    if c <= room[2]:
                        search(i + 1, [room[0] - a, room[1] - b, room[2] - c], total + a * cost[i][0] + b * cost[i][1] + c * cost[i][2])

        search(0, capacity, 0)
        assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best


def test_resharding(spark, folder):
    texts = texts_of(2, 300)
    rows = sorted_rows(resharding.op2_flow_resharding(spark, folder(texts)))
    slots = {}
    for r, t in zip(rows, texts):
        body = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "bytes", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(r["size"] for r in rows)
    held = [sum(r["size"] for r in rows if r["shard"] == j) for j in range(24)]
    largest = max(r["size"] for r in rows)
    assert max(held) - min(held) <= max(2 * largest, total / 24 * 0.02)
    at = {}
    for r, t in zip(rows, texts):
        at.setdefault(t or "", set()).add(r["shard"])
    assert all(len(x) == 1 for x in at.values())
    supply = [sum(r["size"] for r in rows if r["old_shard"] == i) for i in range(16)]
    flow = resharding.min_cost_flow(supply, resharding.even_capacities(total, 24), [[int(i != j) for j in range(24)] for i in range(16)])
    fewest = sum(n for i, x in enumerate(flow) for j, n in enumerate(x) if i != j)
    assert sum(r["size"] for r in rows if r["shard"] != r["old_shard"]) <= fewest + 0.1 * total


def test_resharding_of_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "", 7), (None, "", 7), (3, "abc", 7), (3, "abc", 7)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = resharding.resharded(docs, F.pmod(F.crc32("text"), F.lit(16)), F.lit(8), F.col("text"), F.col("doc_id")).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "old_shard", "shard", "slot"} and len(out) == 160
    assert all(sorted(r["slot"] for r in out if r["shard"] == j) == list(range(sum(r["shard"] == j for r in out))) for j in {r["shard"] for r in out})


def test_rewriting_touches_only_shards_that_change(spark, tmp_path):
    rows = [(i, i % 4, i % 4 if i % 4 < 2 else 2 + i % 8 // 4) for i in range(80)]
    placed = spark.createDataFrame(rows, "doc_id long, old_shard int, shard int").withColumn("slot", F.col("doc_id"))
    told = {r["shard"]: r["rewritten"] for r in resharding.rewrite_affected(placed, str(tmp_path / "out")).collect()}
    assert told == {0: False, 1: False, 2: True, 3: True}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["shard"]) for r in back.collect()) == sorted((d, s) for d, _, s in rows if s > 1)


def plain_features(text):
    """Every word, pair of neighbours and n-gram as a tuple, counted."""
    words = re.findall(r"[^\x20\x09-\x0d\xa0]+", text)
    out = Counter(("w", w) for w in words)
    out.update(("same",) if a == b else ("p", a, b) for a, b in zip(words, words[1:]))
    for n in quality.GRAMS:
        grams = (text[i : i + n] for i in range(len(text) - n + 1))
        out.update((n, g) for g in grams if not re.search(r"[\x20\x09-\x0d\xa0]", g[1:-1]))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_quality_features_are_those_of_the_whole_text(monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    monkeypatch.setattr(quality, "BUCKETS", 1 << 40)
    r = random.Random(1)
    texts = ["".join(r.choice("abé \n\t") for _ in range(r.randint(0, 60))) for _ in range(40)] + ["x" * 50, "a a a b", "", " ", "\xa0ab"]
    names = {}
    for t in texts:
        got = Counter(x for part in quality.chunks(t) for x in part.tolist())
        want = plain_features(t)
        assert sorted(got.values()) == sorted(want.values())
        names.setdefault(tuple(sorted(got.items())), set()).add(tuple(sorted(map(repr, want.items()))))
    assert all(len(x) == 1 for x in names.values())
    assert list(quality.chunks(None)) == []


def test_quality_training_is_stochastic_gradient_descent(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 8)
    rows = [(1, np.array([0, 3]), np.array([0.5, 0.5], np.float32)), (0, np.array([2]), np.array([1.0], np.float32)), (0, np.zeros(0, np.int64), np.zeros(0, np.float32))]
    got = quality.fit(rows, epochs=2, rate=0.3)
    rng = np.random.default_rng(7)
    v = ((rng.random((8, quality.DIM), np.float32) - 0.5) / quality.DIM).astype(float)
    w, b = np.zeros((quality.DIM, 2)), np.zeros(2)
    for epoch in range(2):
        for k, i in enumerate(rng.permutation(3)):
            label, ids, shares = rows[i]
            lr = 0.3 * (1 - (epoch * 3 + k) / 6)
            mean = sum((s * v[f] for f, s in zip(ids, shares)), np.zeros(quality.DIM))
            e = np.exp(mean @ w + b)
            slope = e / e.sum() - np.eye(2)[label]  # of the cross entropy by the logits
            pull = w @ slope
            w -= lr * np.outer(mean, slope)
            b -= lr * 0.1 * slope
            for f, s in zip(ids, shares):
                v[f] -= lr * len(ids) ** 0.5 * s * pull
    for x, y in zip(got, (v, w, b)):
        assert np.allclose(x, y, atol=1e-5)


def test_quality_scores_of_odd_rows(spark, folder):
    r = random.Random(5)
    good, bad = (lambda: " ".join(r.choice(["len", "mo", "tari"]) for _ in range(30))), (lambda: " ".join(r.choice(["BUY", "$$", "77"]) for _ in range(30)))
    texts = [good() if i % 2 else bad() for i in range(120)] + [None, "", "  ", good() * 50, bad()]
    rows = sorted_rows(quality.op3_subword_quality(spark, folder(texts, [(i, i % 2, 0) for i in range(120)] + [(500, 1, 0)])))
    assert [x["held_out"] for x in rows] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))]
    assert all(x["predicted"] == int(x["score"] >= 0.3) and 0 <= x["score"] <= 1 for x in rows)
    assert all(x["predicted"] == i % 2 for i, x in enumerate(rows[:120])) and len({x["score"] for x in rows[120:123]}) == 1
    assert [x["predicted"] for x in rows[123:]] == [1, 0]
    docs = spark.createDataFrame([(None, "a b", 1.0), (None, "a b", 2.0)], "doc_id long, text string, score double")
    assert [x["q"] for x in quality.with_score(docs, (np.zeros(quality.BUCKETS, np.float32), 0.0), name="q").collect()] == [0.5, 0.5]


def test_wrapper_extraction(spark, folder):
    def page(i, body):
        return f'<html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><a href="/">Home {i}</a></nav><!-- x --><div class="cookie-notice">We use cookies</div><div><p>Read our daily letter</p></div><article><h1>Title &amp; {i}</h1>{body}</article><div id="comments"><p>nice {i}</p></div><script>var a="</p>";</script><footer>&copy; {i}</footer></body></html>'

    bodies = [f"<p>First <b>part {i}\n of</b> it.<br>More<p>Second&nbsp;{i}</p><ul><li>one<li>two {i}</ul>" for i in range(12)]
    pages = [(i, f"http://a.example/{i}", page(i, b)) for i, b in enumerate(bodies)] + [(100, None, None), (101, "http://b.example", ""), (102, "not a url", "plain &lt;text&gt;"), (103, "http://a.example/x", "<article><p>cut o")]
    rows = {r["page_id"]: r for r in wrappers.op5_wrapper_extraction(spark, folder([], pages=pages)).collect()}
    for i in range(12):
        assert rows[i]["text"] == f"Title & {i}\n\nFirst part {i} of it. More\n\nSecond {i}\n\none\n\ntwo {i}"
        assert rows[i]["n_chars"] == len(rows[i]["text"])
    assert [rows[i]["text"] for i in (100, 101, 102, 103)] == ["", "", "plain <text>", "cut o"]


def test_texts_that_all_pages_share_stay_in_the_article(spark, folder):
    page = lambda i: f"<body><p>Same banner</p><article><h2>Summary</h2><p>Text {i}</p></article></body>"
    rows = wrappers.op5_wrapper_extraction(spark, folder([], pages=[(i, "http://a.example/", page(i)) for i in range(12)] * 2)).collect()
    assert len(rows) == 24 and all(r["text"] == f"Summary\n\nText {r['page_id']}" for r in rows)


def test_the_wrapper_finds_the_article_without_its_tag(spark, folder):
    def page(i):
        story = "".join(f"<p>Sentence {k} of story {i} says {i * k}.</p>" for k in range(4))
        return f'<body><div class="content"><p>Welcome to our site, dear reader, it is good to see you here</p></div><div class="k"><h2>Title {i}</h2><div class="ad">Buy {i}</div><div class="notice">Corrected on day {i}</div>{story}<div class="comments"><p>I like {i}</p></div></div><div class="z">Imprint</div></body>'

    rows = {r["page_id"]: r["text"] for r in wrappers.op5_wrapper_extraction(spark, folder([], pages=[(i, "http://a.example/", page(i)) for i in range(12)] + [(50, "http://lone.example/", page(50))])).collect()}
    for i in range(12):
        assert rows[i].split("\n\n") == [f"Title {i}", *(f"Sentence {k} of story {i} says {i * k}." for k in range(4))]
    assert rows[50].startswith("Welcome")  # a lone page has only its class words


def test_adverts_and_comments_inside_an_article_are_left_out(spark, folder):
    page = lambda i: f'<article><h1>T{i}</h1><p>Text {i}</p><div class="ad">Buy {i}</div><div class="info-sidebar"><p>Note {i}</p></div><div id="comments"><p>So {i}</p></div></article>'
    rows = wrappers.op5_wrapper_extraction(spark, folder([], pages=[(i, "http://a.example/", page(i)) for i in range(12)])).collect()
    assert {r["text"] for r in rows} == {f"T{i}\n\nText {i}\n\nNote {i}" for i in range(12)}


def test_deep_and_long_pages():
    deep = "".join(f"<div>t{i}" for i in range(20000)) + "</div>" * 20000
    assert wrappers.main_text(f"<nav>x</nav><article>{deep}</article>", set()).split("\n\n") == [f"t{i}" for i in range(20000)]
    hidden = "<div>" * 300 + "<nav>menu</nav><p>kept" + "</div>" * 300
    assert wrappers.main_text(hidden, set()) == "kept"
    whole = wrappers.wrapper_of(wrappers.parse(deep))
    assert wrappers.merge(whole, wrappers.wrapper_of(wrappers.parse("<div>" * 5000)))[3] == 2
    flat = [wrappers.wrapper_of(wrappers.parse("".join(f"<{'pdhs'[(i * k) % 4]}>{i}</{'pdhs'[(i * k) % 4]}>" for i in range(3000)))) for k in (1, 3)]
    assert wrappers.merge(*flat)[3] == 2
    assert wrappers.main_text("<p>" + "word " * 200000, set()) == " ".join(["word"] * 200000)


def test_alignment_is_a_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(60):
        a, b = (["".join(r.choice("abc")) for _ in range(r.randint(0, 7))] for _ in range(2))
        a, b = ([x for i, x in enumerate(s) if not i or s[i - 1] != x] for s in (a, b))  # no repeats to fold
        node = lambda x: [x, False, False, 1, None, [], 0]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        unfolded = wrappers.collapsed
        wrappers.collapsed = lambda kids: kids
        try:
            out = wrappers.aligned([node(x) for x in a], [node(x) for x in b], False)
            near = wrappers.beside([node(x) for x in a], [node(x) for x in b], False)
        finally:
            wrappers.collapsed = unfolded
        assert sum(k[3] == 2 for k in out) == best[-1][-1] or a == b
        for found in (out, near):
            for s in (a, b):  # both are among what the wrapper's optional elements allow
                names = iter(k[0] for k in found)
                assert all(x in names for x in s)


def test_raw_elements_end_at_their_own_end_tag():
    for script in ("for(i=0;i<n;i++){s+=1}", "if(a<b)s='it", 'x=a<b?"</p>":"', "<!-- <a href='", "</scripty>"):
        page = f"<head><title>a<b 'c</title></head><body><script>{script}</script><article><p>Kept <script>{script}</SCRIPT >text</p></article><script>var x='y'</script></body>"
        assert wrappers.main_text(page, set()) == "Kept text"


def test_words_of_classes_only_cast_doubt():
    body = '<h2 id="related-work">Related work</h2><p id="search-results">Found.</p>'
    for wrap in ('<div class="has-sidebar">{}</div>', '<div class="content-sidebar-wrap"><div><section id="ads">{}</section></div></div>'):
        assert wrappers.main_text(wrap.format(f"<article>{body}</article>"), set()) == "Related work\n\nFound."
    assert wrappers.main_text(f'<div class="content-sidebar-wrap">{body}</div>', set()) == "Related work\n\nFound."
    assert wrappers.main_text('<article><p>Text.</p><div class="share">Share</div></article><div class="comments"><article class="comment"><p>Nice.</p></article></div>', set()) == "Text."


def test_wrappers_decide_on_doubtful_elements(spark, folder):
    page = lambda i: f'<article><h1>T{i}</h1><div class="notice"><p>Part {i} of it, <a href="/x">and more</a>.</p><p><a href="/{i}">next {i}</a></p></div><div class="share"><p>Tell others</p></div><div class="related"><ul><li><a href="/{i}">Other {i}</a></li><li><a href="/b{i}">Also {i}</a></li></ul></div></article><div class="sidebar">Free {i}</div>'
    pages = [(i, "http://a.example/", page(i)) for i in range(10)] + [(50 + i, "http://small.example/", page(i)) for i in range(3)]
    rows = {r["page_id"]: r["text"] for r in wrappers.op5_wrapper_extraction(spark, folder([], pages=pages)).collect()}
    assert [rows[i] for i in range(10)] == [f"T{i}\n\nPart {i} of it, and more." for i in range(10)]
    assert [rows[50 + i] for i in range(3)] == [f"T{i}" for i in range(3)]


def test_wrapper_groups():
    a, b = (wrappers.wrapper_of(wrappers.parse(x)) for x in ("<div><p>same</p><p>a</p></div>", "<div><p>same</p><hr><section>z</section></div>"))
    assert wrappers.expression(wrappers.merge(a, b)) == "<html><div>(<p>#text</p>)+(<section>\"z\"</section>)?</div></html>"


def test_wrapper_repeats_groups():
    w = wrappers.wrapper_of(wrappers.parse("<div>" + "".join(f"<h2>t{i}</h2><p>b{i}</p><p>c</p>" for i in range(4)) + "<hr><footer>x</footer></div>"))
    assert wrappers.expression(w) == '<html><div>(<h2>#text</h2>(<p>#text</p>)+)+<footer>"x"</footer></div></html>'


def brute_removals(texts):
    seen, out = set(), []
    for t in texts:
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        windows = [body[i : i + 50] for i in range(len(body) - 49)]
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + 50] = True
        seen.update(windows)
        kept = bytes(x for x, g in zip(body, gone) if not g)
        out.append((len(body), int(gone.sum()), int(sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_suffix_dedup(spark, folder, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", block)
    texts = texts_of(4) + ["aé" * 200, "éa" * 200, "xa" * 30 + "é" * 60]
    rows = sorted_rows(suffix_dedup.op6_suffix_dedup(spark, folder(texts)))
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute_removals(texts)


def test_suffix_dedup_of_cut_texts():
    """Texts longer than a piece give the same cover positions as whole ones."""
    data = np.frombuffer(("".join(random.Random(1).choice("abc ") for _ in range(4000))).encode(), np.uint8)
    whole = suffix_dedup.covers(data, np.array([0, len(data)]))
    parts = set()
    for at in range(0, len(data), 1000):
        piece = data[at : at + 1000 + suffix_dedup.LENGTH - 1]
        grams, spots, first, last, _ = suffix_dedup.covers(piece, np.array([0, len(piece)]))
        parts |= {(g, s + at, w + at) for g, s, f, x in zip(grams.tolist(), spots.tolist(), first.tolist(), last.tolist()) for w in range(f, x + 1)}
    want = {(g, s, w) for g, s, f, x in zip(*(a.tolist() for a in whole[:4])) for w in range(f, x + 1)}
    assert parts == want


def test_repeated_rows_and_null_ids_in_suffix_dedup(spark):
    long = "word " * 20
    df = spark.createDataFrame([(1, long, 7), (1, long, 8), (None, "other " * 20, 9), (2, long, 1)], "doc_id long, text string, extra int")
    rows = {(r["doc_id"], r["extra"]): r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert rows == {(1, 7): long, (1, 8): long, (None, 9): "other " * 20, (2, 1): ""}


def brute_ids(unit, pieces):
    """Merges: the pair of best rank, leftmost first. Else the best of all segmentations."""
    one = lambda x: [pieces.ids[x]] if x in pieces.ids else pieces.fallback(x)
    if pieces.merges:
        parts = list(unit)
        while pairs := [(-pieces.scores[pieces.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces.ids]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    else:
        score = lambda x: pieces.scores[pieces.ids[x]] if x in pieces.ids else pieces.unknown_score
        ways = lambda u: [[]] if not u else [[u[:k], *w] for k in range(1, len(u) + 1) if k == 1 or u[:k] in pieces.ids for w in ways(u[k:])]
        parts = max(ways(unit), key=lambda w: sum(map(score, w)))
    return [i for x in parts for i in one(x)]


def unigram_model(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -math.log(i + 2) - (i % 7) / 100
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(model.SerializeToString())
    return path


@pytest.mark.parametrize("merges", [True, False])
def test_folded_lattices_equal_brute_force(spark, tmp_path, merges):
    pieces = load_pieces(MODEL if merges else unigram_model(tmp_path))
    r = random.Random(4)
    units = ["", "a", "▁the", "日", "▁international", "x" * (62 if merges else 12), "é😀", "▁" * 10]
    units += ["".join(r.choice("▁abcdehinrst") for _ in range(r.randint(1, 30 if merges else 10))) for _ in range(120)]
    rows = spark.createDataFrame([(i // 3, i % 3, u) for i, u in enumerate(units)], "uid long, pos int, unit string").coalesce(1)
    got = {r["uid"] * 3 + r["pos"]: list(r["ids"]) for r in encoding.folded(rows, pieces).collect()}
    assert [got[i] for i in range(len(units))] == [brute_ids(u, pieces) for u in units]


def test_units_are_cut_where_no_piece_spans():
    pieces = load_pieces()
    words = ["▁don't", "▁a1b2", "", "▁日本x", "\n", "▁the,▁end"]
    units, bounds = pieces.units(pa.array(words))
    units = units.to_pylist()
    assert ["".join(units[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == words
    pairs = {x[i : i + 2] for x in pieces.ids for i in range(len(x) - 1)}
    assert all(u[i : i + 2] in pairs for u in units for i in range(len(u) - 1))
    assert all(a[-1] + b[0] not in pairs for lo, hi in zip(bounds[:-1], bounds[1:]) for a, b in zip(units[lo:hi], units[lo + 1 : hi]))


def test_encoding_of_an_empty_table_and_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the end", 5, "x", 2)], "doc_id long, text string, ids int, uid string, unit int")
    assert [r.asDict() for r in encoding.encoded(docs).collect()] == [{"doc_id": 1, "text": "the end", "uid": "x", "unit": 2, "n_tokens": 2, "ids": brute_ids("▁the", load_pieces()) + brute_ids("▁end", load_pieces())}]
    assert encoding.encoded(docs.where("doc_id > 1")).count() == 0


@pytest.mark.parametrize("few", [3, 1 << 19])
@pytest.mark.parametrize("merges", [True, False])
def test_encoding_equals_the_library(spark, documents, tmp_path, merges, few):
    texts = texts_of(6, 10) + ["  two  spaces ", "\nfeed\n\n", "▁mark", "aaaa" * 40, " " * 100 + "x"]
    path = MODEL if merges else unigram_model(tmp_path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = load_pieces(path)
    rows = sorted_rows(encoding.decoded(encoding.encoded(documents(texts), path, cache_units=few)))
    for r, t in zip(rows, texts):
        want = library.encode(t or "")
        assert r["n_tokens"] == len(r["ids"])
        if list(r["ids"]) != want:  # only paths that tie: the library adds in single precision
            assert not merges and sum(pieces.scores[i] for i in r["ids"]) == pytest.approx(sum(pieces.scores[i] for i in want), rel=1e-6)
        assert r["decoded"] == (t or "").replace("▁", " ")
    for w in ("▁" + "abcabd" * 30, "▁日本x"):
        assert encoding.long_unit(w, pieces) == library.encode(w[1:])


def test_licenses(spark, documents):
    texts = [*ODD, "Copyright (c) 2020 A. Person\n\nReleased under the MIT Licence!", "x\n  licensed UNDER the apache license version 2.0\ny", "All rights reserved.", "Copyright 2020 B\n"]
    got = {(r["doc_id"], r["license_id"], r["unit"]) for r in licenses.scanned(documents(texts)).collect()}
    n = len(ODD)
    assert got == {(n, "MIT", "text"), (n + 1, "Apache-2.0", "line"), (n + 2, "LicenseRef-all-rights-reserved", "text")}


def test_whole_license_files(spark, documents):
    mit = next(p for i, _, p in licenses.SHORT if i == "MIT")
    bsd = next(p for i, _, p in licenses.SHORT if i == "BSD-3-Clause")
    wrap = lambda x: "\n".join(re.findall(r".{1,70}(?:\s|$)", x))
    folder = licenses.Path(licenses.__file__).parent / "license_texts"
    texts = ["MIT License\n\nCopyright (c) 2021 A\n\n" + "\n\n".join(map(wrap, mit)), "BSD 3-Clause License\n\nCopyright (c) 2020, B\nAll rights reserved.\n\n" + "\n\n".join(map(wrap, bsd)), "x\n\n" + wrap(mit[0]) + "\n\ny", *[(folder / f"{x}.txt").read_text() for x in ("Apache-2.0", "GPL-3.0-only")]]
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scanned(documents(texts)).collect() if r["unit"] == "text"}
    assert got == {(0, "MIT"), (1, "BSD-3-Clause"), (3, "Apache-2.0"), (4, "GPL-3.0-only")}
    assert {(r["doc_id"], r["license_id"], r["unit"]) for r in licenses.scanned(documents(texts[:3])).collect()} >= {(2, "MIT", "paragraph")}


def test_canonical_form_equals_a_plain_one(spark):
    r = random.Random(2)
    spellings = dict(licenses.SPELLINGS)
    assert not set(spellings) & set(spellings.values())
    words = [*list(spellings)[:12], "v", "wilful", "Copyright", "(c)", "©", "THE", "a", "é1", "--", "\n", "\n", "."]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", ", ", "\t", "-"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["v v v v", "", "Copyright 2020 X", "wilful WILFUL\n\nlicence"]

    def plain(text):
        kept = [x for x in text.lower().split("\n") if not re.match(r"[^\w\n]*(copyright\b|\(c\)\s|©)", x)]
        return " ".join(spellings.get(w, w) for w in re.findall(r"[^\W_]+", "\n".join(kept)))

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", licenses.canonical(licenses.marked(F.col("text"))).alias("form")).orderBy("i").collect()
    assert [x["form"] for x in rows] == list(map(plain, texts))


def test_decontamination(spark, documents):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(6))
    item = [word() for _ in range(30)]
    noise = lambda n: [word() for _ in range(n)]
    texts = [*ODD, " ".join(noise(40)), " ".join(noise(10) + item + noise(10)), " ".join(item[15:] + noise(5) + item[:15]).upper(), " ".join(item[:10] + noise(30)), ", ".join(item)]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "a b"), (9, None)], "item_id long, text string")
    docs = documents(texts)
    n = len(ODD)
    got = {(x["doc_id"], x["item_id"], x["n_tiles"]) for x in decontamination.contaminations(docs.select("doc_id", "text"), items, key="doc_id").collect()}
    assert got == {(n + 1, 7, 1), (n + 2, 7, 2), (n + 4, 7, 1)}
    assert sorted(x["doc_id"] for x in decontamination.without_contaminated(docs, items).collect()) == [i for i in range(len(texts)) if i - n not in (1, 2, 4)]


def test_decontamination_of_every_row_and_of_short_and_unspaced_items(spark, documents):
    r = random.Random(13)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(6))
    a, b, c, d = ([word() for _ in range(20)] for _ in range(4))
    han = "人工智能正在改变世界各地的教育方式"
    items = [(1, " ".join(a)), (1, " ".join(b)), (None, " ".join(c)), (None, " ".join(d)), (None, " ".join(d)), (2, "Zebra quagga okapi"), (3, han + "。"), (4, None), (5, "")]
    texts = [" ".join([word(), *x, word()]) for x in (a, b, c, d)] + ["see zebra, quagga-okapi here", "zebra quagga and okapi", f"我们知道，{han[:12]}之变化", han[:5] + "是今天的问题", None, "", "\u3000", " ".join(word() for _ in range(30))]
    docs = documents(texts)
    rows = decontamination.contaminations(docs.select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"), key="doc_id").collect()
    got = sorted(((x["doc_id"], x["item_id"], x["item_tokens"], x["matched_tokens"]) for x in rows), key=lambda x: x[0])
    assert got == [(0, 1, 20, 20), (1, 1, 20, 20), (2, None, 20, 20), (3, None, 20, 20), (4, 2, 3, 3), (6, 3, 17, 12)]
    assert sorted(x["doc_id"] for x in decontamination.without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [5, 7, 8, 9, 10, 11]


def test_greedy_tiles_take_the_longest_first():
    a = np.arange(20, dtype=np.uint64)
    text = np.concatenate([a[5:20], [99], a[:8]]).astype(np.uint64)
    assert decontamination.greedy_tiles(a, text) == [(5, 0, 15), (0, 16, 5)]


def brute_tiles(item, text, least):
    free_i, free_t, out = set(range(len(item))), set(range(len(text))), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n in free_i and j + n in free_t:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(out)
        out.append((i, j, n))
        free_i -= set(range(i, i + n))
        free_t -= set(range(j, j + n))


def test_tiles_equal_brute_force():
    r = random.Random(6)
    for k in range(120):
        letters = 2 + k % 5
        item, text = (np.array([r.randrange(letters) for _ in range(r.randint(1, 25))], np.uint64) for _ in range(2))
        got = decontamination.greedy_tiles(item, text, 2)
        want = brute_tiles(item.tolist(), text.tolist(), 2)
        assert sum(t[2] for t in got) == sum(t[2] for t in want) and sorted(t[2] for t in got) == sorted(t[2] for t in want)
    same = np.zeros(60000, np.uint64)
    assert sum(t[2] for t in decontamination.greedy_tiles(np.zeros(40, np.uint64), same)) == 40
    assert decontamination.greedy_tiles(np.arange(3000, dtype=np.uint64) % 7, same[:20000]) == []


def test_contaminations_equal_all_pairs(spark, documents):
    r = random.Random(21)
    word = lambda: r.choice(["ba", "ce", "di", "fo", "gu", "ha"])
    phrase = [word() for _ in range(6)]
    items = [" ".join([*phrase, *(word() for _ in range(r.randint(0, 20)))]) for _ in range(12)] + [None, "", "ba", "ba ce"]
    texts = [" ".join([*(word() for _ in range(r.randint(0, 40))), *phrase, *(x for w in (r.choice(items[:12]).split() for _ in range(2)) for x in w[r.randint(0, 6) :])]) for _ in range(30)] + [None, "", "ba ce"] * 2
    items_df = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(x["doc_id"], x["item_id"], x["matched_tokens"]) for x in decontamination.contaminations(documents(texts).select("doc_id", "text"), items_df, key="doc_id").collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = ((y or "").split() for y in (x, t))
            if a:
                ids = {w: n for n, w in enumerate(sorted({*a, *b}))}
                arrays = [np.array([ids[w] for w in y], np.uint64) for y in (a, b)]
                covered = sum(n for *_, n in decontamination.greedy_tiles(*arrays, min(5, len(a))))
                if covered >= 0.6 * len(a):
                    want.add((d, i, covered))
    assert got == want and len(got) > 20


def test_columns_may_have_any_names(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    names = ["uid", "copy", "marks", "doc", "ids", "shard", "root", "seed", "Grams"]
    rows = [(i, " ".join(words[i % 3 :] + words), *range(9)) for i in range(6)] + [(None, None, *range(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([(1, "nothing of the kind")], "item_id int, text string")
    for f in (suffix_dedup.without_repeats, lambda d: decontamination.without_contaminated(d, items), simhash_dedup.without_near_duplicates):
        out = f(docs)
        assert out.columns == docs.columns
        assert {tuple(r)[2:] for r in out.collect()} == {tuple(range(9))}
    out = encoding.encoded(docs)
    assert out.columns == [*(c for c in docs.columns if c != "ids"), "n_tokens", "ids"] and out.count() == 7


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_of_regular_and_irregular_pieces(spark, seed):
    """One pass over the pairs by rank where all pieces are regular, steps elsewhere: the ids of a merge at a time."""
    r = random.Random(seed)
    longer = sorted({"".join(r.choice("abcd") for _ in range(r.randint(2, 4))) for _ in range(40)})
    scores = [0.0] * 5 + [-float(r.randint(1, 200)) for _ in longer]
    pieces = Pieces(["<unk>", *"abcd", *longer], scores, [2] + [1] * (len(scores) - 1), merges=True)
    assert 0 < len(pieces.irregular) < len(longer)
    units = ["".join(r.choice("abcde") for _ in range(r.randint(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(0, i, u) for i, u in enumerate(units)], "uid long, pos int, unit string").coalesce(1)
    lattice = encoding.lattice(rows, pieces).collect()
    assert 0 < sum(x["regular"] and len(x["unit"]) > 3 for x in lattice) < len(lattice)
    got = {x["pos"]: x["ids"] for x in encoding.folded(rows, pieces).collect()}
    assert [got[i] for i in range(len(units))] == [encoding.long_unit(u, pieces) for u in units]


def test_simhash_components(spark, folder):
    import xxhash

    texts = texts_of(9) + ["A b\tc\nd e", "a B c d e"]
    want = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    rows = sorted_rows(simhash_dedup.op9_simhash_components(spark, folder(texts)))
    assert [r["fingerprint"] for r in rows] == [f"{x:016x}" for x in want]
    assert [r["component_id"] for r in rows] == brute_components(want, 4)


@pytest.mark.parametrize("radius", [0, 3, 4, 9])
def test_linking_finds_every_link(spark, radius):
    r = random.Random(radius)
    values = {r.getrandbits(64) for _ in range(150)}
    values |= {v ^ sum(1 << b for b in r.sample(range(64), k)) for v in list(values)[:60] for k in (1, 3, 4, 5, 9)}
    cloud = r.getrandbits(64)
    values |= {cloud ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 6))) for _ in range(300)}
    values = sorted(values)
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "id long, fp long")
    got = {x["id"]: x["root"] for x in simhash_dedup.linked(df, radius).collect()}
    assert [got[i] for i in range(len(values))] == brute_components(values, radius)


@pytest.mark.parametrize("few", [0, 100, 10_000])
def test_components_by_joins_and_in_one_task(spark, few):
    r = random.Random(few)
    edges = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(220)] + [(-5, -7), (-7, -5), (3, 3), (-9, -9)]
    nodes = sorted({x for e in edges for x in e} | {1000, -(1 << 63), (1 << 63) - 1})
    edges += [(-(1 << 63), (1 << 63) - 1)]
    want = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    rounds = components.contract(spark.createDataFrame(edges, "a long, b long"), few)
    assert (few < 10_000) == (len(rounds) > 1)
    got = components.rooted(spark.createDataFrame([(x,) for x in nodes], "id long"), rounds, "id").collect()
    assert {x["id"]: x["root"] for x in got} == want
    assert components.contract(spark.createDataFrame([(1, 1)], "a long, b long"), few) == []


def test_near_duplicates_are_pairs_of_the_jaccard_similarity(spark, documents):
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(7))
    base = [[word() for _ in range(r.randint(30, 90))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for k in (1, 2, 3, 4):
            texts.append(" ".join(word() if i in set(r.sample(range(len(b)), k)) else w for i, w in enumerate(b)))
    lines = [" ".join(word() for _ in range(8)) for _ in range(3)]
    texts += ["\n".join(lines[:1] * 90 + lines[1:2]), "\n".join(lines[:1] * 90 + [" ".join(word() for _ in range(30))]), *ODD]
    cloud = [word() for _ in range(200)]
    texts += [" ".join(word() if i == j else w for i, w in enumerate(cloud)) for j in range(0, 200, 2)]

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = sorted(x["doc_id"] for x in simhash_dedup.without_near_duplicates(documents(texts)).collect())
    assert got == sorted(set(root))


def test_near_duplicates_come_from_fingerprint_groups_and_bands(spark):
    """Nodes whose fingerprints are linked share a key, by way of others too; so do nodes of one band, however far apart."""
    rows = [(1, 10, 0, [1, 2]), (2, 10, 0b111, [3, 4]), (3, 10, 0b111111, [5, 6]), (4, 10, -1, [7, 8]), (5, 10, 0x0F0F0F0F, [9, 8]), (6, 10, 0x33333333 << 20, [10, 11])]
    index = simhash_dedup.candidate_index(spark.createDataFrame(rows, "id long, size long, fp long, keys array<long>")).collect()
    holders = {}
    for x in index:
        holders.setdefault(x["key"], set()).add(x["id"])
    assert sorted(map(sorted, holders.values())) == [[1, 2, 3], [4, 5]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_cloud_around_the_threshold_costs_no_square(spark, monkeypatch, seed):
    """One bucket of near copies, half of them just too far from all others, edits that some share, other sets: every link is found by few pairs."""
    r = random.Random(seed)
    fresh = lambda: r.getrandbits(63)
    base = [fresh() for _ in range(146)]
    edits = [(r.randrange(140), [fresh() for _ in range(5)]) for _ in range(12)]
    sets = [set(base)]
    for _ in range(500):
        own = list(base)
        for _ in range(r.randint(1, 9)):
            at, put = r.choice(edits) if r.random() < 0.15 else (r.randrange(140), [fresh() for _ in range(5)])
            own[at : at + 5] = put
        sets.append(set(own[: r.choice([146, 146, 140, 120])]))
    for _ in range(30):
        own = {fresh() for _ in range(r.randint(1, 200))}
        sets += [own, own | {fresh() for _ in range(len(own) // r.randint(3, 6))}]
    sets.append(set())
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if want[i] != want[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    met = []
    likely = simhash_dedup.likely
    monkeypatch.setattr(simhash_dedup, "likely", lambda pairs, marks, similar: met.append(pairs.count()) or likely(pairs, marks, similar))
    rows = [(i, len(x), 1, sorted(x), simhash_dedup.band_keys(np.array(sorted(x), np.uint64))[1].view(np.int16).tolist() if x else [0] * 100) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, size long, key long, shingles array<long>, marks array<smallint>")
    got = {x["id"]: x["root"] for x in simhash_dedup.similar_roots(df.select("id", "size", "key"), df.select("id", "shingles"), df.select("id", "marks"), 0.8).collect()}
    groups = lambda label: sorted(sorted(i for i in range(len(sets)) if label[i] == x) for x in {*label})
    assert 100 < len({*want}) and max(map(len, groups(want))) > 100
    assert groups([got[i] for i in range(len(sets))]) == groups(want)
    assert sum(met) < 20 * len(sets), met


@pytest.mark.parametrize("nodes", [200, 400])
def test_a_cloud_in_many_buckets_is_compared_once(spark, monkeypatch, nodes):
    """Near copies fill up to 20 band buckets and a group each; their differences are written once and not in each bucket, and every link is found."""
    r = random.Random(nodes)
    fresh = lambda: r.getrandbits(63)
    sets = []
    for n, edits in [(nodes, 9), *[(12, 8)] * 20]:
        base = [fresh() for _ in range(146)]
        for _ in range(n):
            own = list(base)
            for _ in range(r.randint(1, edits)):
                at = r.randrange(140)
                own[at : at + 5] = [fresh() for _ in range(5)]
            sets.append(set(own))
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    held = [simhash_dedup.band_keys(x) for x in arrays]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if want[i] != want[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    made = {}
    keep = simhash_dedup.materialise
    monkeypatch.setattr(simhash_dedup, "materialise", lambda df, name: made.setdefault(name, []).append(out := keep(df, name)) or out)
    rows = [(i, len(x), [*keys.view(np.int64).tolist(), 7 if i < nodes else i // 12], x.view(np.int64).tolist(), marks.view(np.int16).tolist()) for i, (x, (keys, marks)) in enumerate(zip(arrays, held))]
    df = spark.createDataFrame(rows, "id long, size long, keys array<long>, shingles array<long>, marks array<smallint>")
    index = df.selectExpr("id", "size", "explode(keys) AS key")
    got = {x["id"]: x["root"] for x in simhash_dedup.similar_roots(index, df.select("id", "shingles"), df.select("id", "marks"), 0.8).collect()}
    groups = lambda label: sorted(sorted(i for i in range(len(sets)) if label[i] == x) for x in {*label})
    assert groups([got[i] for i in range(len(sets))]) == groups(want) and 20 < len({*want}) < len(sets) - nodes // 4
    buckets = Counter(x["key"] for x in index.collect())
    assert sum(n > nodes // 10 for n in buckets.values()) > 10
    wide = made["wide"][0].selectExpr("count(*)", "count(DISTINCT id)", "sum(size(delta))").first()
    assert nodes // 2 < wide[1] <= wide[0] <= 1.2 * nodes and wide[2] <= 100 * nodes, wide


def test_likelihoods_in_numbers_and_in_logarithms_are_the_same():
    pieces = load_pieces(MODEL)
    lattice, logp = lm_scoring.PieceLattice(pieces), lm_scoring.vocabulary_logp(pieces)
    for word in ("a", "internationalisation", "\u65e5\U0001f600x", "zq" * 30, "z" * 200):
        codes = np.array([list(map(ord, word))], np.uint32)
        uses, want = np.zeros((2, len(logp)))
        got = lattice.one_length(codes, logp, np.array([3.0]), uses)
        assert got == pytest.approx(lattice.in_logs(codes, logp, np.array([3.0]), want), rel=1e-12)
        np.testing.assert_allclose(uses, want, rtol=1e-9, atol=1e-12)


def brute_marginal(word, pieces, logp, uses=None):
    """ln of the sum over every segmentation, one by one; with uses, each piece's expected uses are added."""
    cost = lambda x: logp[pieces.ids[x]] if x in pieces.ids else logp[pieces.fallback(x)].sum()
    ways = lambda u: [[]] if not u else [[u[:k], *w] for k in range(1, len(u) + 1) if k == 1 or u[:k] in pieces.ids for w in ways(u[k:])]
    paths = ways("▁" + word)
    shares = np.array([math.exp(sum(map(cost, w))) for w in paths])
    if uses is not None:
        for w, p in zip(paths, shares / shares.sum()):
            for x in w:
                for i in [pieces.ids[x]] if x in pieces.ids else pieces.fallback(x):
                    uses[i] += p
        uses[-1] += 1
    return math.log(shares.sum()) + logp[-1]


def test_lattice_marginals_equal_enumeration():
    pieces = load_pieces()
    lattice = lm_scoring.PieceLattice(pieces)
    logp = lm_scoring.vocabulary_logp(pieces)
    words = ["the", "international", "日本\U0001f600", "a" * 12, "é", "don't,x1"]
    assert lattice.run(words, logp) == pytest.approx([brute_marginal(w, pieces, logp) for w in words])
    uses, want = np.zeros(len(logp)), np.zeros(len(logp))
    lattice.run(words, logp, np.array([1.0, 2, 1, 1, 1, 3]), uses)
    for w, n in zip(words, (1, 2, 1, 1, 1, 3)):
        for _ in range(n):
            brute_marginal(w, pieces, logp, want)
    assert uses == pytest.approx(want)
    assert np.exp(logp).sum() == pytest.approx(1)


@pytest.mark.parametrize("few", [1, 1 << 18])
def test_lm_scores(spark, folder, monkeypatch, few):
    monkeypatch.setattr(lm_scoring, "CACHE_WORDS", few)
    r = random.Random(11)
    texts = [*(" ".join("".join(r.choice("abeé") for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 12))) for _ in range(25)), None, "", " \n ", "A a A", "A a A", "日本 \U0001f600"]
    rows = sorted_rows(lm_scoring.op10_subword_lattice_lm(spark, folder(texts)))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    words = [[w.decode() for w in lm_scoring.tokens(t)] for t in texts]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    pieces = load_pieces()
    first = logp = lm_scoring.vocabulary_logp(pieces)
    before, words_only = -math.inf, {w: k for w, k in counts.items() if w is not None and k}
    for _ in range(lm_scoring.ROUNDS):  # until a round gains nothing
        uses, total = np.zeros(len(first)), 0.0
        for w, k in words_only.items():
            for _ in range(k):
                total += brute_marginal(w, pieces, logp, uses)
        logp = np.log((lm_scoring.PRIOR * np.exp(first) + uses) / (lm_scoring.PRIOR + uses.sum()))
        score = total / sum(words_only.values())
        if score - before < lm_scoring.SETTLED:
            break
        before = score
    ends = counts[None] / n
    for x, ws, h in zip(rows, words, held):
        w = [*ws, None]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (h, len(w), sum(counts[y] > 0 for y in w), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((counts[y] + 1) / (n + v + 1)) for y in w))
        assert x["score"] == pytest.approx(math.log10(ends) + sum((math.log(1 - ends) + brute_marginal(y, pieces, logp)) / math.log(10) for y in ws))


def test_lm_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b", 1), ("x", "a b", 2), ("x", "a b", 2), ("y", None, 3)], "doc_id string, text string, word int")
    rows = lm_scoring.scored(docs, F.lit(False)).collect()
    assert sorted((x["doc_id"] or "", x["n_tokens"]) for x in rows) == [("", 3), ("x", 3), ("x", 3), ("y", 1)]
    assert len({x["score"] for x in rows}) == 2


def test_further_rounds_gain_nothing(spark):
    r = random.Random(3)
    words = ["".join(r.choice("ab c de e i nst".split()) for _ in range(r.randint(1, 5))) for _ in range(300)]
    counts = spark.createDataFrame([(w.encode(), k) for w, k in Counter(words).items()], "word binary, c long")
    pieces = load_pieces()
    lattice, weights = lm_scoring.PieceLattice(pieces), np.array([*Counter(words).values()])
    score = lambda logp: weights @ lattice.run([*Counter(words)], logp) / weights.sum()
    by_rounds = [score(lm_scoring.learned_pieces(counts, pieces, 10.0, rounds=n, settled=-1.0)) for n in (1, 2, 4, 12)]
    assert by_rounds == sorted(by_rounds) and by_rounds[1] > by_rounds[0] + 0.01
    settled = score(lm_scoring.learned_pieces(counts, pieces, 10.0, rounds=50))
    assert by_rounds[-1] - settled < 5 * lm_scoring.SETTLED
    none = spark.createDataFrame([], "word binary, c long")
    assert np.array_equal(lm_scoring.learned_pieces(none, pieces), lm_scoring.vocabulary_logp(pieces))


def test_quotes_open_after_an_equals_sign_only():
    cases = {
        "<article><p data-x=it's>Hello world</p><p>More</p></article>": "Hello world\n\nMore",
        '<article><p title="a"b">x</p><p>y</p></article>': "x\n\ny",
        '<article><p title = "a>b" c>x</p></article>': "x",
        "<article><p a='\"' b=\">'\">x</p></article>": "x",
        '<article><p class=a/>u</p><p ">v</p></article>': "u\n\nv",
    }
    assert {k: wrappers.main_text(k, set()) for k in cases} == cases


def test_heads_and_formulas_of_an_article_stay(spark, folder):
    for inner in ('<div class="entry-header"><h1>Title</h1><p>Lead.</p></div>', '<div class="intro-banner"><h1>Title</h1><p>Lead.</p></div>', '<section id="masthead"><h1>Title</h1><p>Lead.</p></section>'):
        assert wrappers.main_text(f'<div class="header">Site</div><article>{inner}<div class="sidebar-header">More news</div><p>Body</p></article>', set()) == "Title\n\nLead.\n\nBody"
    assert wrappers.main_text("<article><p>A <math><mi>x</mi><mo>+</mo><annotation>x+</annotation></math> B</p></article>", set()) == "A x+ B"
    # the same on hosts of seven and of eight pages
    page = lambda i: f'<article><div class="intro-banner"><p>Lead number {i} is free</p></div><p>Body {i}</p></article>'
    for n in (7, 8):
        rows = wrappers.op5_wrapper_extraction(spark, folder([], pages=[(i, f"http://h{n}.example/{i}", page(i)) for i in range(n)])) if n == 7 else None
        texts = {r["page_id"]: r["text"] for r in rows.collect()} if rows is not None else {i: wrappers.main_text(page(i), wrappers.verdicts(many(page, n))) for i in range(n)}
        assert texts == {i: f"Lead number {i} is free\n\nBody {i}" for i in range(n)}


def many(page, n):
    out = wrappers.wrapper_of(wrappers.parse(page(0)))
    for i in range(1, n):
        out = wrappers.merge(out, wrappers.wrapper_of(wrappers.parse(page(i))))
    return out


def test_quality_labels_other_than_0_and_1_are_left_out(spark, documents):
    docs = documents(["good words here", "bad words there"] * 8)
    right = [(i, i % 2) for i in range(12)]
    odd = [(12, 2), (13, -1), (14, None), (None, 1), (99, 7)]
    both = [quality.train(docs.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, label int")) for rows in (right, right + odd)]
    assert np.array_equal(both[0][0], both[1][0]) and both[0][1] == both[1][1]


def test_html_is_decoded_once():
    assert wrappers.main_text("<p>&amp;lt; &#233;</p>", set()) == "&lt; é" == html.unescape("&amp;lt; &#233;")
