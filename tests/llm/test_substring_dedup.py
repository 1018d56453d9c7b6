import hashlib
import random
import re
from collections import Counter

import pyarrow as pa

from textloom.llm import substring_dedup as S
from textloom.llm.common import table


def brute(rows, size=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        if doc is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i : i + size])] < doc:
                gone[i : i + size] = [True] * size
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def made_up():
    passage = [f"p{i}" for i in range(120)]
    fill = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    j = " ".join
    return [
        (10, j(fill("a", 30) + passage + fill("b", 20))), (20, j(fill("c", 5) + passage[30:80] + fill("d", 9))), (21, j(fill("e", 5) + passage[30:79] + fill("f", 9))),
        (5, j(passage[60:] + fill("g", 7))), (30, "\n".join(passage[:60]) + "  " + j(passage[:60])), (40, j(passage)), (40, j(passage)), (41, "\t".join(passage)),
        (50, "x " * 400), (51, "x " * 60), (52, "x " * 49), (60, None), (61, ""), (62, " \n "), (None, j(passage)), (None, None), (63, "short one"),
        (70, j(fill("h", 49))), (71, j(fill("h", 49))), (72, j(fill("i", 50))), (73, j(fill("i", 50))), (74, j(passage[:70] + fill("k", 3) + passage[50:])), (72, j(fill("z", 60))),
    ]


def test_against_brute_force(spark):
    rows = made_up()
    frame = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, found string, spans int")
    out = S.without_repeats(frame).collect()
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in out]
    assert Counter(got) == Counter(brute(rows))


def test_texts_of_one_id_keep_their_own_spans(spark):
    fill = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    j = " ".join
    rows = [(1, j(fill("p", 80))), (9, j(fill("a", 10) + fill("p", 80) + fill("b", 5))), (9, j(fill("z", 120))), (9, j(fill("y", 30) + fill("p", 60)))]
    rows += [(2, j(fill("c", 60) + fill("q", 70))), (2, j(fill("d", 55))), (20, j(fill("q", 70) + fill("e", 5))), (21, j(fill("f", 100) + fill("z", 60)))]
    rows += [(9, rows[0][1]), (30, j(fill("g", 60))), (30, rows[2][1])]  # a copy of another's text beside texts of its own
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in S.without_repeats(frame).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_passages_end_with_their_text():
    texts = [" ".join(f"{tag}{i}" for i in range(n)) for tag, n in (("a", 60), ("b", 90))]
    batch = pa.RecordBatch.from_arrays([pa.array([2, 3]), pa.array(texts), pa.array([[0, 1, 11, 40], [40]], pa.list_(pa.int32())), pa.array([8, 9])], ["doc_id", "text", "ats", "shard"])
    got = [r for b in S._passages([batch]) for r in b.to_pylist()]
    a, b = (t.split() for t in texts)
    assert [(r["owner"], r["passage"].split()) for r in got] == [(2, a[:51]), (3, b[40:])]


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = {tuple(r) for r in S.op4_substring_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == {(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute(rows)}


def test_merged():
    assert S.merged([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)] and S.merged([]) == []


def test_long_owners_are_dealt(spark, monkeypatch):
    """Windows of one owner in several stretches, shards and chunks give the same spans."""
    monkeypatch.setattr(S, "SHARD_WINDOWS", 60)
    monkeypatch.setattr(S, "BLOCK_WORDS", 70)
    monkeypatch.setattr(S, "CHUNK_BYTES", 4_000)
    rng = random.Random(11)
    long = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(long))] + [(2 + k, " ".join([f"q{k}"] * 5 + long[20 * k : 20 * k + 120] + [f"z{k}"] * 5)) for k in range(14)]
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["spans"]]) for r in S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (400, []), **{2 + k: (130, [(5, 125)]) for k in range(14)}}
