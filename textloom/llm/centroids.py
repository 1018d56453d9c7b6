"""Centroid clustering by rounds that only look at what changed.

Vectors are integers, so sums and means are exact. The assignments (owner and squared distance to it) are kept as a
table in the shared folder, with each vector beside its own, so no round has to join. A round compares a vector with
those centroids only that changed in the round before; a vector whose own centroid changed is compared with all. What
moved is summed as signed transfers, minus at the old owner and plus at the new one, within each task and then over all tasks;
the driver adds these few rows to the global sums and derives the next centroids. Once no centroid changes, the
rounds left would change nothing and are not run.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep, lists, table

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components beyond this could pass 64 bits in a squared distance of ``DIMS`` components.
LARGEST = 1 << 27
_STATE = "vec_id long, vector array<long>, owner int, distance long, was int"


@dataclass(frozen=True)
class Centroids:
    """Places of all centroids, and which of them changed in the last round."""

    places: np.ndarray
    changed: np.ndarray


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Of the right length, and every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & F.coalesce(finite, F.lit(False))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the usable vectors as integers, ``floor(scale * x)`` of each component."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    whole = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))))
    return rows.where(usable(F.col("vector"), dims)).select("vec_id", whole.cast("array<long>").alias("vector"))


def first_places(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order; of equal ids the smaller vector first."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    least = rows.where("vec_id is not null").select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(clusters)
    return np.array([r["vector"] for r in least.collect()], np.int64)


def compare(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Owner and squared distance of each vector, given those it had before; -1 is no owner yet. Ties go to the smaller number."""
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component lies beyond {LARGEST}: squared distances could pass 64 bits")
    places, changed = centroids.places, np.flatnonzero(centroids.changed)
    owner, distance = owner.copy(), distance.copy()
    lost = np.append(centroids.changed, True)[owner]  # the last place is that of no owner
    for rows, others in ((np.flatnonzero(lost), range(len(places))), (np.flatnonzero(~lost), changed)):
        if not len(rows):
            continue
        own = x[rows]
        best = np.full(len(rows), -1, np.int32) if others is not changed else owner[rows]
        least = np.full(len(rows), np.iinfo(np.int64).max) if others is not changed else distance[rows]
        for k in others:
            gap = own - places[k]
            far = np.einsum("ij,ij->i", gap, gap)
            nearer = (far < least) | (far == least) & (k < best)
            best[nearer], least[nearer] = k, far[nearer]
        owner[rows], distance[rows] = best, least
    return owner, distance


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def assign(state: DataFrame, centroids: Centroids) -> DataFrame:
    """``state`` with each vector's owner after comparing with what changed; ``was`` is the owner before."""
    sent = state.sparkSession.sparkContext.broadcast(centroids)  # a few places

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                before = batch.column("owner").to_numpy()
                owner, distance = compare(_matrix(batch.column("vector"), batch.num_rows), before, batch.column("distance").to_numpy(), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(before, pa.int32())], ["vec_id", "vector", "owner", "distance", "was"])

    return state.select("vec_id", "vector", "owner", "distance").mapInArrow(scan, _STATE)


def transfers(state: DataFrame, dims: int = DIMS) -> DataFrame:
    """(cluster, n, total): vectors and componentwise sums that each cluster won less those it lost in the last round."""

    def scan(batches):
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("vector"), batch.num_rows) if batch.num_rows else np.zeros((0, dims), np.int64)
            for column, sign in (("owner", 1), ("was", -1)):
                cluster = batch.column(column).to_numpy()
                for k in np.unique(cluster[cluster >= 0]).tolist():
                    own = cluster == k
                    n[k] = n.get(k, 0) + sign * int(own.sum())
                    total[k] = total.get(k, 0) + sign * x[own].sum(0)
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([n[k] for k in keys], pa.int64()), lists(np.concatenate([total[k] for k in keys]) if keys else np.zeros(0, np.int64), np.full(len(keys), dims), pa.int64())], ["cluster", "n", "total"])

    moved = state.where("owner <> was").select("vector", "owner", "was").mapInArrow(scan, "cluster int, n long, total array<long>")
    flat = moved.select("cluster", "n", F.posexplode("total").alias("at", "v"))
    return flat.groupBy("cluster", "at").agg(F.sum("v").alias("v"), F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n"))


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector, centroids) after ``rounds`` rounds of Lloyd's algorithm over integers.

    ``rows`` are (vec_id, vector) as :func:`quantised` gives them. A round assigns each vector to its nearest centroid
    (ties: the smaller number) and moves every centroid that owns any to the floor of its vectors' mean; at the end vectors
    are assigned once more. Every row counts, repeated ones too; rows with a null id own a place but can't begin a
    centroid. With fewer vectors than centroids there are as many centroids as vectors, and none for an empty table.
    """
    places = first_places(rows, clusters, seed)
    if not len(places):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), places
    dims = places.shape[1]
    sums, counts = np.zeros(places.shape, object), np.zeros(len(places), object)
    centroids = Centroids(places, np.ones(len(places), bool))
    state = rows.select("vec_id", "vector", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    kept = None
    for turn in range(rounds + 1):
        before, state = kept, keep(assign(state, centroids), "assigned")
        kept = state
        if before is not None:
            drop_kept(before)
        if turn == rounds:
            break
        for r in transfers(state, dims).collect():  # at most clusters * dims numbers
            sums[r["cluster"], r["at"]] += r["v"]
            counts[r["cluster"]] += r["n"] or 0
        moved = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums.tolist(), counts.tolist(), places.tolist())], np.int64)
        changed = (moved != places).any(1)
        if not changed.any():
            break
        places = moved
        centroids = Centroids(places, changed)
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), places


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    owned, places = cluster(quantised(table(spark, sf_dir, "embeddings")))
    total = {r["cluster"]: int(r["d"]) for r in owned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    marks = {k: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for k, p in enumerate(places.tolist())}
    of = lambda values, kind: F.element_at(F.create_map(*[F.lit(x) for k in sorted(values) for x in (k, values[k])]), F.col("cluster")) if values else F.lit(None).cast(kind)
    return owned.select("vec_id", "cluster", "distance", of(total, "long").cast("long").alias("cluster_inertia"), F.lit(sum(total.values())).cast("long").alias("inertia"), of(marks, "string").alias("centroid_sha256"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS) -> str:
    """The same clusters as DuckDB SQL, a pair of common table expressions for each round."""
    keep_ = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {keep_})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS k, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, arg_min(c.k, ({far}, c.k)) AS k, min({far}) AS d FROM (SELECT *, row_number() OVER () AS r FROM v) v, c{i} c GROUP BY vec_id, r)")
        if i < rounds:
            floor_ = "((s - ((s % n) + n) % n) // n)::BIGINT"
            parts.append(f"m{i} AS (SELECT k, list({floor_} ORDER BY j) AS x FROM (SELECT k, j, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY k, j) GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


SQL = _sql()
