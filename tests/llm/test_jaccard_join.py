import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import components, jaccard_join
from textloom.llm.common import table

SCHEMA = "doc_id long, text string, n long, ka string, component string"


def brute(rows, size=5, percent=80):
    """(doc_id, n_shingles, component_id) of every row, from all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), None if doc is None else least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def made_up():
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 60, 5)]  # near copies of one another
    rows += [(50, " ".join(base)), (7, "  ".join(base).upper()), (900, " ".join(base)), (900, " ".join(base))]  # copies, a repeated row
    chain = [f"c{i}" for i in range(104)]
    rows += [(200 + k, " ".join(chain[k * 4 : k * 4 + 84])) for k in range(5)]  # a chain: neighbours link, ends don't
    rows += [(300 + k, " ".join(base[:40] + [f"y{k}_{i}" for i in range(40)])) for k in range(12)]  # a shared passage, no links
    rows += [(1, None), (2, ""), (3, " \n"), (4, "short text"), (5, "Short\tTEXT"), (6, "one"), (None, " ".join(base)), (None, None), (8, "a " * 3000), (9, "a " * 50)]
    return rows


def test_against_brute_force(spark):
    rows = made_up()
    frame = spark.createDataFrame([(d, t, 0, "k", "c") for d, t in rows], SCHEMA)
    got = [tuple(r) for r in jaccard_join.near_duplicates(frame).select("doc_id", "n_shingles", "component_id").collect()]
    assert Counter(got) == Counter(brute(rows))


def test_large_regions_split(spark, monkeypatch):
    """Clusters that meet in one region fall into Voronoi cells of their own; each linked pair still meets, and cells are smaller."""
    monkeypatch.setattr(jaccard_join, "LARGE", 8)
    rng = random.Random(4)
    sets = []
    for cluster in range(5):
        base = [rng.randrange(2**64) for _ in range(100)]
        for _ in range(12):
            changed = rng.sample(range(100), rng.randint(0, 12))
            sets.append(np.unique(np.array([rng.randrange(2**64) if k in changed else x for k, x in enumerate(base)], np.uint64)))
    rng.shuffle(sets)
    rows = [(7, k, len(x), 0, *jaccard_join._parity(x).tolist()) for k, x in enumerate(sets)]
    cells = jaccard_join.keep(spark.createDataFrame(rows, "pivot long, ka long, n long, i int, " + ", ".join(f"{s} long" for s in jaccard_join._SKETCH)), "cells")
    met = {}
    for r in jaccard_join._split(cells, 80).collect():
        met.setdefault(r["pivot"], set()).add(r["ka"])
    assert len(met) > 1 and max(map(len, met.values())) < 60
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both) or any({a, b} <= cell for cell in met.values())


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (3, 60, 700, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n, dtype=np.uint64)]))
        p, q = (np.unpackbits(jaccard_join._parity(x).view(np.uint8)) for x in (a, b))
        assert (p != q).sum() <= len(np.setxor1d(a, b))


def test_empty_table(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_small_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in jaccard_join.op2_ngram_jaccard_join(spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id").collect()]
    assert Counter(got) == Counter(brute(rows))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(30)] + [(100, 101)]])
def test_components(spark, edges):
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[a] == got[b] for a, b in edges if a != b)
    assert all(root == min(n for n in got if got[n] == root) for root in got.values())


def test_overlap_bounds_the_truth():
    rng = np.random.default_rng(1)
    for n in (5, 60, 700, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n, dtype=np.uint64)]))
        assert jaccard_join._overlap(jaccard_join._bins(a), jaccard_join._bins(b), len(a), len(b)) >= len(np.intersect1d(a, b))
