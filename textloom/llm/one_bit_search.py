"""Nearest neighbours by randomly rotated one-bit codes with error bounds, reranked on the original vectors.

A vector is taken relative to its nearest centroid, rotated by one random rotation, and coded by the signs: one bit a
dimension, packed. With two scalars beside it (length, and how well the signs fit) the code gives an unbiased estimate of
an inner product and a bound on its error. The query's side of that product is rounded to ``LEVEL_BITS`` bits, so it is a
sum of bit counts of packed words; the rounding's largest error widens the bound. A query keeps, of each part of the
index that it meets, the vectors whose lower bound on the distance is not above the k-th least upper bound, and measures
these in double precision.

Centroids are fitted on at most ``SAMPLE`` rows; every row is indexed in the cell of its centroid. A query meets the
nearest cells, as many as hold a share ``COVER`` of the true neighbours of queries drawn from the sample: few where vectors
form clusters, most where they don't. Cells are cut into parts of about ``CHUNK_ROWS`` rows by a hash, and their queries
into blocks, so a crowded cell does not end in one task. Of rows with one vector only those of the k + 1 least ids can be
among k nearest, so copies beyond are left out before the search.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths have no
distance: each length is searched among its own. A query never meets rows of its own id. Every row of a repeated id is a
candidate; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, lists, small, table

SAMPLE, CENTROIDS, SEED = 20_000, 16, 7
#: Rows of a cell, as far as the sample allows (16 of its rows at least make a cell); rows of a part; queries of a block.
CELL_ROWS, SAMPLE_ROWS, CHUNK_ROWS, BLOCK_QUERIES = 256, 16, 4_096, 8_192
#: Share of true neighbours that the probed cells hold on the sample, measured with so many queries.
COVER, CALIBRATE, LEVEL_BITS = 0.97, 500, 6
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 3.0


@lru_cache(maxsize=4)
def _rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation of vectors of one length, the same wherever it is made."""
    rotation, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return rotation * np.sign(np.diag(upper))


@dataclass(frozen=True)
class Coder:
    centroids: np.ndarray
    rotation: np.ndarray

    def relative(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated unit residuals to the given centroids, and the residuals' lengths."""
        rest = x - self.centroids[near]
        length = np.sqrt((rest * rest).sum(1))
        return (rest / np.maximum(length, 1e-30)[:, None]) @ self.rotation, length

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centroids**2).sum(1) - 2 * x @ self.centroids.T).argmin(1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The centroids from the nearest on, for each vector."""
        return ((self.centroids**2).sum(1) - 2 * x @ self.centroids.T).argsort(1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, packed signs, residual length, inner product of code and unit residual) of each vector."""
        near = self.nearest(x)
        unit, length = self.relative(x, near)
        fit = np.abs(unit).sum(1) / np.sqrt(x.shape[1])
        return near.astype(np.int32), np.packbits(unit > 0, axis=1), length, np.maximum(fit, 1e-6)


def fit(sample: np.ndarray, centroids: int = CENTROIDS, seed: int = SEED, rounds: int = 12) -> Coder:
    """k-means centroids of a sample, and a random rotation."""
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float64)
    at = sample[rng.choice(len(sample), min(centroids, len(sample)), replace=False)]
    for _ in range(rounds):
        near = ((at**2).sum(1) - 2 * sample @ at.T).argmin(1)
        at = np.array([sample[near == k].mean(0) if (near == k).any() else at[k] for k in range(len(at))])
    return Coder(at, _rotation(sample.shape[1], seed))


def probes(coder: Coder, sample: np.ndarray, k: int = 10) -> int:
    """How many of the nearest cells hold ``COVER`` of the k nearest of queries drawn from a sample. Copies in it count once."""
    cells = len(coder.centroids)
    x = np.unique(sample, axis=0)
    if cells == 1 or len(x) < 2:
        return cells
    own = coder.nearest(x)
    at = np.random.default_rng(SEED).choice(len(x), min(CALIBRATE, len(x)), replace=False)
    k = min(k, len(x) - 1)
    met = np.zeros(cells, np.int64)
    for lo in range(0, len(at), 64):
        part = at[lo : lo + 64]
        far = (x**2).sum(1) - 2 * x[part] @ x.T
        far[np.arange(len(part)), part] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        place = np.argsort(coder.order(x[part]), axis=1)
        met += np.bincount(np.take_along_axis(place, own[near], 1).ravel(), minlength=cells)
    return int(np.searchsorted(np.cumsum(met), COVER * met.sum())) + 1


def inner_products(unit: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rows of ``unit`` with the sign vectors of packed codes, by bit counts, and the most that rounding adds to each row's."""
    dims = unit.shape[1]
    words = lambda bits: np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
    codes = words(packed)
    low = unit.min(1)
    step = np.maximum((unit.max(1) - low) / ((1 << LEVEL_BITS) - 1), 1e-30)
    level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
    total = np.zeros((len(unit), len(codes)), np.int32)
    for bit in range(LEVEL_BITS):
        plane = words(np.packbits(level >> bit & 1, axis=1))
        for w in range(codes.shape[1]):
            total += np.bitwise_count(codes[None, :, w] & plane[:, w, None]).astype(np.int32) << bit
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    positive = low[:, None] * ones + step[:, None] * total
    every = low * dims + step * level.sum(1, dtype=np.int64)
    return (2 * positive - every[:, None]) / np.sqrt(dims), np.sqrt(dims) * step / 2


@dataclass(frozen=True)
class Coders:
    """A coder, and the number of cells to probe, for each length of vectors. A length that the sample doesn't hold is one cell round the origin."""

    centroids: dict[int, np.ndarray]
    probes: dict[int, int]
    seed: int = SEED

    def of(self, dims: int) -> Coder:
        return Coder(self.centroids.get(dims, np.zeros((1, dims))), _rotation(dims, self.seed))


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _search(queries: pa.Table, rows: pa.Table, coder: Coder, cell: int, k: int) -> pa.Table:
    """The exact nearest of the rows of a cell that the codes can't rule out, for each query of a block."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and rows.num_rows:
        dims = coder.rotation.shape[0]
        qid, rid = queries.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
        q, x = _matrix(queries.column("vector"), dims), _matrix(rows.column("vector"), dims)
        length, fit_ = rows.column("length").to_numpy(), rows.column("fit").to_numpy()
        packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rid), -1)
        error = WIDTH * np.sqrt(np.maximum(1 - fit_**2, 0)) / fit_ / np.sqrt(max(dims - 1, 1))
        for lo in range(0, len(q), 128):
            part = q[lo : lo + 128]
            unit, far = coder.relative(part, np.full(len(part), cell))
            inner, rounding = inner_products(unit, packed)
            inner /= fit_
            bound = error + rounding[:, None] / fit_
            base, scale = far[:, None] ** 2 + length**2, 2 * far[:, None] * length
            low, high = base - scale * (inner + bound), base - scale * (inner - bound)
            self_ = qid[lo : lo + 128, None] == rid
            low[self_] = high[self_] = np.inf
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(rid) > k else np.full(len(part), np.inf)
            for i in range(len(part)):
                at = np.flatnonzero((low[i] <= limit[i]) & ~self_[i])
                exact = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
                best = np.lexsort((rid[at], exact))[:k]
                out["query_id"] += [int(qid[lo + i])] * len(best)
                out["vec_id"] += rid[at[best]].tolist()
                out["score"] += exact[best].tolist()
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def _by_length(batches):
    """Batches of vectors of one length each, and that length."""
    for whole in batches:
        lengths = whole.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths).tolist():
            yield dims, whole.take(pa.array(np.flatnonzero(lengths == dims)))


def fit_sample(rows: DataFrame) -> Coders:
    """Centroids and probes of each length of vectors of ``rows`` (vec_id, vector), fitted in tasks on the ``SAMPLE`` rows of least hash."""
    many = {r["dims"]: r["count"] for r in rows.groupBy(F.size("vector").alias("dims")).count().collect()}
    drawn = rows.select("vector", F.size("vector").alias("dims"), F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE)

    def train(key: tuple[pa.Scalar, ...], sample: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        x = _matrix(sample.column("vector"), dims)
        coder = fit(x, max(1, min(many[dims] // CELL_ROWS, len(x) // SAMPLE_ROWS)))
        return pa.table({"dims": pa.array([dims], pa.int32()), "centroids": lists(coder.centroids.reshape(-1), np.array([coder.centroids.size]), pa.float64()), "probes": pa.array([probes(coder, x)], pa.int32())})

    fitted = drawn.groupBy("dims").applyInArrow(train, "dims int, centroids array<double>, probes int").collect()
    return Coders({r["dims"]: np.array(r["centroids"]).reshape(-1, r["dims"]) for r in fitted}, {r["dims"]: r["probes"] for r in fitted})


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Coders]:
    """(vec_id, vector, dims, cell, code, length, fit) of every usable vector, and what coded them."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    coders = fit_sample(rows)
    shared = vectors.sparkSession.sparkContext.broadcast(coders)

    def encode(batches):
        for dims, batch in _by_length(batches):
            near, code, length, fit_ = shared.value.of(dims).encode(_matrix(batch.column("vector"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array([dims] * len(near), pa.int32()), pa.array(near), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(fit_)], ["vec_id", "vector", "dims", "cell", "code", "length", "fit"])

    return keep(rows.mapInArrow(encode, "vec_id long, vector array<double>, dims int, cell int, code binary, length double, fit double"), "codes"), coders


def nearest(indexed: DataFrame, coders: Coders, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (query_id, vector), ties to the smaller vec_id.

    Only vectors of the query's length are its candidates. Without any it has no rows, as have empty tables. A query
    whose cells hold too few vectors probes more of them, so it has k rows, or all candidates where there are fewer.
    """
    copies = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    rows = keep(indexed.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy"), "distinct")
    held: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dims", "cell").count().collect():  # a row for each cell, which the sample bounds
        held.setdefault(r["dims"], np.zeros(len(coders.of(r["dims"]).centroids), np.int64))[r["cell"]] = r["count"]
    most = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    shared = indexed.sparkSession.sparkContext.broadcast(coders)

    def probe(batches):
        for dims, batch in _by_length(batches):
            order = shared.value.of(dims).order(_matrix(batch.column("vector"), dims))
            full = (np.cumsum(held.get(dims, np.zeros(order.shape[1], np.int64))[order], axis=1) < k + most).sum(1) + 1
            many = np.clip(full, shared.value.probes.get(dims, 1), order.shape[1])
            met = order[np.arange(order.shape[1]) < many[:, None]]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array([dims] * len(order), pa.int32()), lists(met, many, pa.int32())], ["query_id", "vector", "dims", "cells"])

    asked = keep(queries.select("query_id", "vector").mapInArrow(probe, "query_id long, vector array<double>, dims int, cells array<int>"), "asked")
    parts = lambda size: F.ceil(F.count(F.lit(1)) / size).cast("int")
    probed = asked.select("dims", F.explode("cells").alias("cell")).groupBy("dims", "cell").agg(parts(BLOCK_QUERIES).alias("blocks"))
    cells = small(keep(rows.groupBy("dims", "cell").agg(parts(CHUNK_ROWS).alias("chunks")).join(probed, ["dims", "cell"]), "cells"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.withColumn("cell", F.explode("cells")).join(cells, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("chunk", every("chunks"))
    right = rows.join(cells, ["dims", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vector"), F.col("chunks")).cast("int")).withColumn("block", every("blocks"))
    by = ("dims", "cell", "chunk", "block")
    left, right = left.select(*by, "query_id", "vector"), right.select(*by, "vec_id", "vector", "code", "length", "fit")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda key, q, x: _search(q, x, shared.value.of(key[0].as_py()), key[1].as_py(), k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    indexed, coders = index(table(spark, sf_dir, "embeddings"))
    queries = indexed.where("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))  # of a repeated id the least vector asks
    return nearest(indexed, coders, queries)
