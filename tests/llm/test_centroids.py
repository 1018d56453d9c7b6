"""Clusters against plain Lloyd rounds over Python's integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from textloom.llm import centroids as C


def plain(rows, clusters, rounds, seed=C.SEED):
    """(owner and distance of each row, centroids) of rows (id, integer vector)."""
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in rows)
    places = [x for _, x in order[:clusters]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, p)), k) for k, p in enumerate(places))
    for _ in range(rounds):
        owner = [nearest(x)[1] for _, x in rows]
        places = [[sum(col) // len(own) for col in zip(*own)] if (own := [x for (_, x), o in zip(rows, owner) if o == k]) else p for k, p in enumerate(places)]
    return [nearest(x)[::-1] for _, x in rows], places


@pytest.mark.parametrize("seed", range(5))
def test_rounds_are_lloyds(spark, seed):
    rng = random.Random(seed)
    dims, n, clusters, rounds = rng.choice([(1, 40, 4, 3), (2, 300, 8, 10), (3, 5, 8, 4), (2, 200, 6, 25), (4, 120, 1, 2)])
    spread = rng.choice([2, 30, 5000])
    rows = [(i, [rng.randint(-spread, spread) for _ in range(dims)]) for i in range(n)]
    rows += rows[: n // 5]
    got, places = C.cluster(spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(5), clusters, rounds)
    owned, want = plain(rows, clusters, rounds)
    assert places.tolist() == want
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, k, d) for (i, _), (k, d) in zip(rows, owned))


def test_compare_looks_at_what_changed():
    rng = np.random.default_rng(1)
    x, places = rng.integers(-20, 20, (400, 3)), rng.integers(-20, 20, (6, 3))
    owner, distance = C.compare(x, np.full(400, -1, np.int32), np.zeros(400, np.int64), C.Centroids(places, np.ones(6, bool)))
    moved = places.copy()
    moved[[1, 4]] = rng.integers(-20, 20, (2, 3))
    got = C.compare(x, owner, distance, C.Centroids(moved, np.array([0, 1, 0, 0, 1, 0], bool)))
    far = ((x[:, None] - moved) ** 2).sum(2)
    assert (got[0] == far.argmin(1)).all() and (got[1] == far.min(1)).all()
    assert C.compare(x[:0], owner[:0], distance[:0], C.Centroids(moved, np.ones(6, bool)))[0].tolist() == []
    with pytest.raises(ValueError, match="64 bits"):
        C.compare(x + C.LARGEST, owner, distance, C.Centroids(moved, np.ones(6, bool)))


def test_query_on_odd_rows(spark, tmp_path):
    """Nulls, wrong lengths, values that aren't finite, repeated rows and clashing columns."""
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 2) for _ in range(64)]
    rows = [(i, vector(), 1, 0) for i in range(60)] + [(None, vector(), 0, 0), (5, vector(), 0, 0)]
    rows += [(100, None, 0, 0), (101, [], 0, 0), (102, [0.5] * 63, 0, 0), (103, [*[1.0] * 63, None], 0, 0), (104, [*[1.0] * 63, math.inf], 0, 0), (105, [*[1.0] * 63, math.nan], 0, 0), (106, [0.0] * 64, 0, 0)]
    rows += [rows[7]] * 30
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, owner int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = C.op13_centroid_clustering(spark, str(tmp_path)).collect()
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:8]
    assert len(got) == len(kept) and len(order) == 8
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for k in {r["cluster"] for r in got}:
        own = [r for r in got if r["cluster"] == k]
        assert {r["cluster_inertia"] for r in own} == {sum(r["distance"] for r in own)} and len({r["centroid_sha256"] for r in own}) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = C.op13_centroid_clustering(spark, str(tmp_path))
    assert out.collect() == [] and dict(out.dtypes)["centroid_sha256"] == "string"


def test_query_is_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    cursor = con.execute(C.SQL)
    names = [d[0] for d in cursor.description]
    got = C.op13_centroid_clustering(spark, data)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(cursor.fetchall())
