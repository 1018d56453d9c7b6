"""Toxicity, nearest neighbours, main text, URL filter, personal data, audio, and the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import audio, main_text, one_bit_search, pii, registry, toxicity, url_filter

DATA = "/root/testdata/sf0.001"


# --- toxicity


def labelled(n=400):
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad = ["grobbix", "snarfol", "vileduz", "krankop"]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 120))
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((" ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_learns_and_scores(spark):
    rows = labelled()
    model = toxicity.fit(rows[:300])
    docs = spark.createDataFrame([(i, t, 0.5) for i, (t, _) in enumerate(rows[300:])] + [(900, None, 0.1), (901, "", 0.1), (None, "grobbix", 0.1), (902, "x " * 50_000, 0.1)], "doc_id long, text string, score double")
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    right = [r["predicted"] == rows[300 + r["doc_id"]][1] for r in out if r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean(right) > 0.9
    assert {r["predicted"] for r in out if r["doc_id"] in (900, 901, 902)} == {0}


def test_toxicity_without_labels(spark):
    assert toxicity.fit([]).weights[0] < 0 and toxicity.fit([("a b", 1)]).weights[0] > 0
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    empty = toxicity.sample(spark.createDataFrame([(1, "a")], "doc_id long, text string"), labels)
    assert empty.collect() == [] and toxicity.fit_sample(empty) == toxicity.fit([])


def test_toxicity_is_fitted_on_whole_texts(spark):
    long = [(i, f"grobbix {'plain words ' * 3000}snarfol", i % 2) for i in range(1, 9)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in long], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in long], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(docs, labels)
    got = sorted((r["text"], r["toxic"]) for r in rows.collect())
    assert toxicity.fit_sample(rows) == toxicity.fit(got)
    assert got == sorted((t, y) for i, t, y in long if zlib.crc32(str(i).encode()) % 5) and got


def test_toxicity_rows_without_ids_repeats_and_empty_tables(spark):
    model = toxicity.fit(labelled())
    docs = spark.createDataFrame([(None, "grobbix snarfol", 3), (4, "grobbix snarfol", 3), (4, "grobbix snarfol", 3), (5, None, None)], "doc_id long, text string, held_out int")
    out = toxicity.score(docs, model, carry=("held_out",)).collect()
    assert len(out) == 4 and len({r["score"] for r in out if r["held_out"] == 3}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumnRenamed("held_out", "score"), model, carry=("score",))


def test_toxicity_scores_against_plain_compression(spark):
    """Scores from plain calls of the compressor, window by window, without any cache."""
    from test_pipeline import gains

    rows = labelled()
    model = toxicity.fit(rows[:300])
    texts = [t for t, _ in rows[300:340]] + ["", "Grobbix, (snarfol)! vileduz-krankop", "é " * 9]
    out = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        p = 1 / (1 + np.exp(-float(toxicity._features([gains(model, t)], model.threshold)[0] @ np.array(model.weights))))
        assert abs(out[i]["score"] - p) < 1e-12 and out[i]["windows"] == len(t.split())


def test_toxicity_held_out(spark):
    out = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p == t for p, t in held]) > 0.9


# --- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[40:80] = x[40]  # ties
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(5000, None, "c"), (5001, [0.0] * 24, "c"), (5002, [None] * 24, "c"), (5003, [float("nan")] * 24, "c"), (5004, [float("inf")] * 24, "c"), (5005, [1.0] * 3, "c"), (None, [1.0] * 24, "c")]
    indexed, coder = one_bit_search.index(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string"))
    assert indexed.count() == 1501
    queries = indexed.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in one_bit_search.nearest(indexed, coder, queries).collect()}
    y, hits = x.astype(np.float64), 0
    for q in range(0, 1500, 50):
        far = np.sqrt(((y - y[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(1500), far))[:10]
        hits += sum(got[q, k + 1] == (v, far[v]) for k, v in enumerate(best))
    assert hits >= 0.97 * 300 and len(got) == 300


def test_neighbours_of_few(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    indexed, coder = one_bit_search.index(two)
    queries = indexed.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "vector")
    assert [tuple(r) for r in one_bit_search.nearest(indexed, coder, queries).collect()] == [(0, 1, 1, 8**0.5)]
    empty, coder = one_bit_search.index(two.limit(0))
    assert one_bit_search.nearest(empty, coder, empty.select(F.col("vec_id").alias("query_id"), "vector")).collect() == []


def test_neighbours_query_against_brute_force(spark, tmp_path):
    """Vectors of three lengths, one of them of a single row, repeated ids, ties, and rows that take no part."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16 if i % 4 else 6).round(1).tolist()) for i in range(1200)]
    rows += [(i, rows[i][1]) for i in range(0, 1200, 150)] + [(100, rng.standard_normal(16).tolist()), (1300, [1.0] * 40), (1400, None), (1500, [0.0] * 16), (1600, [float("nan")] * 6), (None, [1.0] * 16)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, vector string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got: dict[int, list] = {}
    for r in sorted(one_bit_search.op3_nearest_neighbours(spark, str(tmp_path)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    fine = [(i, v) for i, v in rows if i is not None and v is not None and any(v) and np.isfinite(v).all()]
    hits = total = 0
    for q in {i for i, _ in fine if i % 100 == 0} - {1300}:
        v = min(v for i, v in fine if i == q)
        best = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), i) for i, w in fine if i != q and len(w) == len(v))[:10]
        hits, total = hits + sum(a[1] == b[1] and abs(a[0] - b[0]) < 1e-12 for a, b in zip(got[q], best, strict=True)), total + 10
    assert total == 120 and hits >= 0.95 * total and 1300 not in got


def test_bit_counts_give_inner_products():
    rng = np.random.default_rng(1)
    for dims in (1, 3, 24, 64, 70, 130):
        unit, signs = rng.standard_normal((9, dims)), rng.standard_normal((40, dims)) > 0
        unit[0] = 0
        got, most = one_bit_search.inner_products(unit, np.packbits(signs, axis=1))
        true = unit @ ((signs * 2.0 - 1) / np.sqrt(dims)).T
        assert (np.abs(got - true) <= most[:, None] + 1e-9).all() and (most <= 0.06 * np.sqrt(dims)).all()


def test_clusters_need_few_cells(spark):
    """Of clustered vectors a query meets few cells and finds its neighbours; crowded copies don't hide them; small cells lead to more."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((60, 16)) * 20
    x = middle[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16))
    x[1000:3000] = x[1000]
    indexed, coders = one_bit_search.index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert len(coders.centroids[16]) == 23 and coders.probes[16] <= 6
    queries = indexed.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got: dict[int, list] = {}
    for r in one_bit_search.nearest(indexed, coders, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(6000), far))[:10].tolist()
        hits += len(set(best) & set(got[q]))
        if 1000 <= q < 3000:
            assert got[q] == best
    assert hits >= 0.95 * 600
    few = indexed.where("vec_id % 1000 = 7")  # cells with a row or none
    found = one_bit_search.nearest(few, coders, queries.where("query_id < 500"), k=6).groupBy("query_id").count().collect()
    assert len(found) == 5 and all(r["count"] == 6 for r in found)


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    coder = one_bit_search.fit(x[:500])
    near, code, length, fit = coder.encode(x)
    signs = (np.unpackbits(code, axis=1).astype(float) * 2 - 1) / 8
    outside = 0
    for c in np.unique(near):
        own = near == c
        unit, _ = coder.relative(q, np.full(len(q), c))
        true = unit @ (coder.relative(x[own], near[own])[0]).T
        error = one_bit_search.WIDTH * np.sqrt(1 - fit[own] ** 2) / fit[own] / np.sqrt(63)
        outside += (np.abs(unit @ signs[own].T / fit[own] - true) > error).sum()
    assert outside / (len(q) * len(x)) < 0.01


# --- main text and URLs

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1><form>Search <input></form></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>This site uses cookies to make your visit a better one for you.</p></div>
<article><h1>Big  &amp; bold</h1><p>First&nbsp;one &eacute; with <a href=x>a link</a> in it.<p>Short.<aside>Related things</aside><div class=ad>Buy now</div><script>var x="</p>";</script></article>
<section id="comments"><p>I liked this article very much, thank you for it.</p></section><footer>&copy; 2020 Somebody, all rights reserved</footer></body></html>"""


def test_main_text(spark):
    assert main_text.extract(PAGE) == "Big & bold\nFirst one é with a link in it.\nShort."
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (None, "u", "<p>only text", "x"), (5, "u", "<div>" * 3000 + "deep", "x")]
    out = main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter((r["page_id"], r["text"]) for r in out) == Counter([(1, main_text.extract(PAGE)), (2, ""), (3, ""), (3, ""), (None, "only text"), (5, "deep")])


def test_main_text_without_an_article_element():
    body = "".join(f"<p>{'words of a paragraph that goes on ' * 4}{i}</p>" for i in range(3))
    page = f"<body><ul><li><a href=1>Home</a><li><a href=2>About us</a></ul><div>{body}</div><p><a href=3>More</a> <a href=4>links</a></p></body>"
    assert main_text.extract(page).count("\n") == 2 and "Home" not in main_text.extract(page) and "More" not in main_text.extract(page)


def test_main_text_of_the_pages(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = [main_text._SPACE.sub(" ", main_text.entities.unescape(re.sub("</?b>", "", p))).strip(" ") for p in re.split("</?(?:p|h1|br)>", article)]
        assert main_text.extract(r["html"]) == "\n".join(filter(None, parts))


def test_url_filter_rules_and_bloom(spark):
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.ORG/en/1x?q#f", "http://example.org/en/2", "http://example.org/es/", "https://a.com/fr/x", "https://a.com/de/x", "a://com/de", "http://notexample.org.net/es/", "http://cheap-pills.example.com/x", "http://cheap-pills.example.com/de/", "http://org", "http://a.org?x/y", "http://é.org/ü"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, None, "old")], "page_id long, url string, verdict string")
    split = url_filter.split_url(pages.select("page_id", "url"))
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(split, url_filter.entries(spark)).collect())
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [*range(len(urls)), 0], "url": [*urls, None]}))
    assert got == Counter((r[0], r[3], r[4]) for r in con.execute(url_filter.SQL).fetchall())
    keys = spark.createDataFrame([(f"host{i}.org/{i}",) for i in range(3000)], "key string")
    bits = url_filter.bloom(keys, 3000)
    hit = url_filter.possible(bits, url_filter.key_hashes(pa.array([f"host{i}.org/{i}" for i in range(3000)])))
    miss = url_filter.possible(bits, url_filter.key_hashes(pa.array([f"other{i}.org/{i}" for i in range(20_000)])))
    assert hit.all() and miss.mean() < 0.01
    assert url_filter.judge(split.limit(0), url_filter.entries(spark)).collect() == []
    with pytest.raises(ValueError, match="rule"):
        url_filter.judge(split.withColumn("rule", F.lit("x")), url_filter.entries(spark))


def test_url_filter_in_shards(spark):
    """A filter past the bound is cut into shards: the same verdicts, and each shard rules out what isn't listed."""
    sites = [(f"site{i}.example.net", "/") for i in range(500)]
    listed = url_filter.entries(spark, listed=sites)
    pages = spark.createDataFrame([(i, f"http://w.site{i % 900}.example.net/p{i % 7}") for i in range(3000)] + [(3000, None)], "page_id long, url string")
    split = url_filter.split_url(pages)
    whole = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(split, listed).collect()}
    cut = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(split, listed, most_bytes=0, shard_keys=64).collect()}
    assert cut == whole and len(cut) == 3001
    assert all(cut[i] == (None, "block" if i % 900 < 500 else "allow") for i in range(3000))
    keys = spark.createDataFrame([(f"other{i}.net/",) for i in range(5000)] + [("site7.example.net/",)], "key string")
    passed = {r["key"] for r in url_filter.sharded(keys, listed, listed.count(), 64).collect()}
    assert "site7.example.net/" in passed and len(passed) < 200


def test_sql_of_the_registry(spark):
    con = duckdb.connect()
    for view in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        got = registry.queries()[name](spark, DATA)
        assert set(columns) == set(got.columns)
        assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


LONG = "This is a long paragraph of the article with many plain words that nobody would take for a menu or a notice of any kind at all."


@pytest.mark.parametrize("cls", ["post-content share", "search-result", "entry related"])
def test_a_class_name_loses_no_article(cls):
    page = f"<html><body><nav><a href=/>Home</a></nav><div class='{cls}'><p>{LONG}</p><p>{LONG} Again.</p></div></body></html>"
    assert main_text.extract(page) == f"{LONG}\n{LONG} Again."


@pytest.mark.parametrize("cls", ["adbox", "commentlist", "nl-box", "advert-wide", "sidebar2"])
def test_joined_class_names_within_an_article_go(cls):
    page = f"<article><h1>Title</h1><p>{LONG}</p><div class='{cls}'><p>Not this. {LONG}</p></div><p>The end.</p></article>"
    assert main_text.extract(page) == f"Title\n{LONG}\nThe end."


@pytest.mark.parametrize("name", ["commentary", "cookie-recipe", "notice-of-award", "newsletter", "sponsored copyright"])
def test_main_text_in_what_a_word_frames(name):
    """A word in a class takes no article away; frames within and beside it stay frames."""
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
    page = f"<html><body><nav>{menu}</nav><div class='{name}'><h1>Title here</h1><p>{LONG}</p><p>{LONG} Again.</p><div class='comments'><p>{LONG} I like it.</p></div></div><footer><p>{LONG} All rights.</p></footer></body></html>"
    assert main_text.extract(page) == f"Title here\n{LONG}\n{LONG} Again."


def test_main_text_sections_by_name():
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>{LONG} We discuss.</p></section><section class='comments'><h2>Comments</h2><p>{LONG} Nice.</p></section></article></body>"
    assert main_text.extract(page) == f"Title\n{LONG}\nDiscussion\n{LONG} We discuss."


@pytest.mark.parametrize("name", ["responses", "privacy-bar", "comment-list", "cookie-consent", "newsletter-signup"])
def test_main_text_leaves_frames_out(name):
    for article in (f"<article><p>{LONG}</p></article>", f"<div class='text'><p>{LONG}</p></div>", f"<div><p>{LONG}</p></div>"):
        assert main_text.extract(f"<body>{article}<div class='{name}'><p>{LONG} A reader says, or a notice.</p><p>{LONG} Another.</p></div></body>") == LONG


def test_main_text_of_deeply_framed_pages():
    page = "<div class='comment'>" * 20_000 + f"<p>{LONG}</p>"
    assert main_text.extract(page) in ("", LONG)


def test_main_text_of_empty_tables_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", "x")] * 2 + [(None, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in main_text.main_text(pages).collect()) == ["", LONG, LONG]
    assert main_text.main_text(pages.limit(0)).collect() == []


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), number, m.end(), kind))
    return sorted(out)


def odd_texts():
    rng = random.Random(4)
    alphabet = "aB0123456789..@@+-  ()é😀x,\n4111 "
    special = [None, "", "a@b.com.@c.de", "1.2.3.4.5.6.7.8", "0001.02.3.255", "1.2.3.256", "9.9.9.1000", "4111111111111111", "4111 1111-1111 1111 x", "+1 (778) 555-8933", "a" * 40_000, "1" * 40_000, "a.b" * 9_000 + "@x.y", "+1" * 5_000, "+1" + " " * 9_000, "x@" + "a.b." * 9_000, "😀 a@b.co"]
    return special + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(2000)]


def test_personal_data(spark):
    texts = odd_texts() + [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and more' for i in range(50)] + [f"number {i}00000000000000 and plain words abcdefghijklmnop" for i in range(1, 50)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs).select("doc_id", "spans").collect()}
    for i, t in enumerate(texts):
        assert [s for s in found[i] if s[1] < 4] == base(t), t
    secrets = [i for i in found if any(s[3] == "secret" for s in found[i])]
    assert secrets == list(range(len(texts) - 99, len(texts) - 49)) or set(range(len(texts) - 99, len(texts) - 49)) <= set(secrets)
    red = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(docs)).collect()}
    assert red[len(texts) - 60].startswith('token = "<SECRET>" and') and red[16] == "😀 <EMAIL>" and red[0] == ""
    assert pii.find(docs.limit(0)).collect() == []


def test_personal_data_query_against_re(spark):
    """Counts, the base hash and the base part of the spans of the query, on the whole small table."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = pii.op8_pii(spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        want = base(texts[r["doc_id"]])
        line = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in want)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(kind == k for *_, kind in want) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("secret")) == line


def test_personal_data_in_long_texts(spark):
    """A table of numbers takes seconds, and places stay right beyond the first stretches of matches."""
    rows = [(1, "12, " * 200_000), (2, "a@b.co 1.2.3.4 " * 3_000), (3, "é😀 x1y2z3w4q5e6r7 a@b.co " * 2_000)]
    began = time.time()
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans").collect()}
    assert time.time() - began < 60
    for i, t in rows:
        assert [s for s in found[i] if s[1] < 4] == base(t)
    red = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert red[2] == "<EMAIL> <IP> " * 3_000


def test_personal_data_overlaps_repeats_and_names(spark):
    rows = [(1, "call +1 778 555.1.2.3.4 now", "x@y.z", 7), (1, "call +1 778 555.1.2.3.4 now", "x@y.z", 7), (None, "a@b.co", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string, base int")
    out = pii.find(docs, carry=("email", "base")).collect()
    assert sorted((r["email"] or "", r["base"] or 0) for r in out) == [("", 0), ("x@y.z", 7), ("x@y.z", 7)]
    assert all([tuple(s) for s in r["spans"]] == base(r["text"]) for r in out)
    red = [r["text"] for r in pii.redact(pii.find(docs)).collect()]
    kinds = base(rows[0][1])
    first, last = kinds[0], max(end for _, _, end, _ in kinds)
    assert red.count(rows[0][1][: first[0]] + f"<{first[3].upper()}>" + rows[0][1][last:]) == 2
    with pytest.raises(ValueError):
        pii.find(docs.withColumn("spans", F.lit(1)), carry=("spans",))


def test_added_spans_leave_base_spans_alone(spark):
    """Brute force over made-up spans: an added span stays if it meets no base span."""
    rng = random.Random(8)
    kind = "array<struct<start:bigint,number:int,end:bigint,kind:string>>"
    rows = []
    for i in range(300):
        spans = {(s := rng.randrange(60), rng.randrange(4), s + rng.randint(1, 25)) for _ in range(rng.randint(0, 4))}
        at = 0
        while at < 70:
            at += rng.randint(0, 12)
            spans.add((at, 4, at + 5))
            at += 5
        rows.append((i, [(a, n, b, pii.KINDS[n]) for a, n, b in sorted(spans)]))
    got = {r["i"]: [tuple(x) for x in r["f"]] for r in spark.createDataFrame(rows, f"i int, s {kind}").select("i", pii._free(F.col("s")).alias("f")).collect()}
    for i, spans in rows:
        base_ = [s for s in spans if s[1] < 4]
        assert got[i] == [s for s in spans if s[1] < 4 or not any(b[0] < s[2] and s[0] < b[2] for b in base_)]


def test_expectation_maximisation_orders_labelers():
    rng = random.Random(0)
    votes = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes[tuple(int(truth) if rng.random() < good else int(not truth) for good in (0.95, 0.8, 0.6)) + (-1,)] += 1
    post, rates = pii.expectation_maximisation(dict(votes))
    assert rates[0][0] - rates[0][1] > rates[1][0] - rates[1][1] > rates[2][0] - rates[2][1] > 0
    assert post[1, 1, 1, -1] > 0.9 > 0.1 > post[0, 0, 0, -1]


def test_personal_data_is_native(spark):
    plan = pii.op8_pii(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- audio


def test_audio_round_trip(spark):
    texts = [None, "", "a", "x" * 64, "x" * 65, "é" * 100_000, "same text", "same text"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in audio.features(audio.store(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        assert bytes(rows[i]["payload"]) == padded == audio.samples(bytes(rows[i]["media"]))[0] and rows[i]["n_bytes"] == len(data)
        shape = audio.Settings.frames * audio.Settings.bands
        assert len(rows[i]["tensors"]) == shape * len(rows[i]["spans"]) and rows[i]["spans"][0]["start"] == 0
    assert rows[6]["tensors"] == rows[7]["tensors"]
    tensors = audio.tensor_array(pa.array([rows[6]["tensors"], rows[5]["tensors"]], pa.list_(pa.float32())))
    assert tensors.type.shape == [16, 32] and len(tensors) == len(rows[6]["spans"]) + len(rows[5]["spans"])
    assert audio.features(audio.store(docs.limit(0))).collect() == []


def test_tensors_are_stored_with_a_fixed_shape(spark):
    texts = [None, "a", "é" * 30_000, "some text " * 500]
    stored = audio.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    nothing = stored.limit(1).select(F.lit(9).cast("long").alias("doc_id"), "n_bytes", F.lit(None).cast("binary").alias("media"))
    rows = {r["doc_id"]: r for r in audio.features(stored.unionByName(nothing)).collect()}
    assert rows[9]["tensor_file"] is None and rows[9]["spans"] is None
    for i in range(len(texts)):
        schema = pa.ipc.open_stream(bytes(rows[i]["tensor_file"])).schema
        assert schema.names == ["tensor", "start", "end"]
        kind = schema.field("tensor").type
        assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [16, 32] and kind.dim_names == ["frame", "band"]
        tensors, spans = audio.read_tensors(bytes(rows[i]["tensor_file"]))
        want, want_spans, _ = audio.describe(bytes(rows[i]["media"]))
        assert np.array_equal(tensors, want) and spans == want_spans == [tuple(s) for s in rows[i]["spans"]]
        assert tensors.reshape(-1).tolist() == rows[i]["tensors"]


@pytest.mark.parametrize("target", [8_000, 12_000, 16_000, 24_000])
def test_resampling_keeps_a_tone(target):
    s = audio.Settings(target=target)
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000).astype(np.float32)
    y = audio.resample(x, s)
    want = np.sin(2 * np.pi * 440 * np.arange(target) / target)
    assert len(y) == target and np.abs(y - want)[300:-300].max() < 1e-3


def test_segments_use_two_thresholds():
    s = audio.Settings()
    energy = np.array([-40, -10, -3, 0, -8, -40, -11, -10, -40, -2, -40.0])
    assert audio.segments(energy, s) == [(1, 5), (9, 10)]


def test_log_mel_is_the_direct_transform():
    """Each band of each frame by its definition: a windowed discrete Fourier transform, triangles on the mel scale, a logarithm."""
    s = audio.Settings()
    y = np.random.default_rng(4).standard_normal(1500).astype(np.float32)
    got, energy = audio.log_mel(y, s)
    size, n = 512, -(-(len(y) - s.frame) // s.hop) + 1
    assert got.shape == (n, s.bands)
    y = np.pad(y.astype(np.float64), (0, n * s.hop + s.frame))
    t, f = np.arange(s.frame), np.arange(size // 2 + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (s.frame - 1))
    waves = np.exp(-2j * np.pi * f[:, None] * t / size)
    top = 2595 * np.log10(1 + s.target / 2 / 700)
    bottom = 2595 * np.log10(1 + 40 / 700)
    edge = [700 * (10 ** ((bottom + (top - bottom) * i / (s.bands + 1)) / 2595) - 1) for i in range(s.bands + 2)]
    for frame in range(n):
        part = y[frame * s.hop : frame * s.hop + s.frame]
        power = np.abs(waves @ (part * window)) ** 2
        assert abs(energy[frame] - 10 * np.log10((part**2).mean() + 1e-10)) < 1e-3
        for band in range(s.bands):
            a, b, c = edge[band : band + 3]
            weight = [max(0.0, min((x - a) / (b - a), (c - x) / (c - b))) for x in f * s.target / size]
            assert abs(got[frame, band] - np.log(power @ weight + 1e-6)) < 1e-3


def test_audio_query_digests(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: r for r in audio.op9_audio_features(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        data = (r["text"] or "").encode()
        padded = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        media = audio.wave(padded)
        want = (len(data), len(padded), sha(padded), zlib.crc32(padded[-64:]), len(media), sha(media))
        row = got[r["doc_id"]]
        assert tuple(row[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want
        tensors, spans, found = audio.describe(media)
        first = ",".join(f"{x:.1f}" for x in tensors[0, 0, :8].tolist())
        shown = row["feature"].split("|")
        assert shown[:2] == [str(len(spans)), str(len(found))] and abs(float(shown[2]) - sum(b - a for a, b in found)) < 0.006
        assert all(abs(float(x) - float(y)) < 0.11 for x, y in zip(shown[3].split(","), first.split(","), strict=True))


def test_columns_named_as_results_are_refused(spark):
    with pytest.raises(ValueError):
        audio.features(spark.createDataFrame([(b"", 1)], "media binary, Spans long"))
    with pytest.raises(ValueError):
        url_filter.split_url(spark.createDataFrame([("u", "h")], "url string, host string"))


# --- queries


@pytest.mark.parametrize("name", [n for n in registry.queries() if n.split("_")[0] in ("op3", "op5", "op8", "op9")])
def test_queries_give_every_row(spark, name):
    out = registry.queries()[name](spark, DATA)
    source = {"op3": None, "op5": "pages"}.get(name.split("_")[0], "documents")
    assert out.count() == (spark.read.parquet(f"{DATA}/{source}.parquet").count() if source else 50)
