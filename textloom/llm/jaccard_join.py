"""Exact Jaccard self-join of documents on word shingles, by pivots and triangle-inequality windows.

The metric is the Jaccard distance of shingle sets; two documents link within ``1 - threshold``.

* *Copies first.* Documents with one shingle set form a class; everything below sees a class once.
* *Voronoi regions.* Unrelated documents lie at distance 1 from one another, so regions around whole
  documents would each hold nearly every document (see the README for a measurement). The pivots are
  therefore one-shingle sets: a document is at ``1 - 1/n`` from those it contains and at 1 from all
  others, and its region is that of its first pivot in a global order (rare pivots first).
* *Windows.* Taking the first r pivots away moves a document by ``r/n``; by the triangle inequality a
  partner within the threshold keeps one of the first ``n - ceil(threshold * n) + 1``. A document is
  replicated to exactly these regions, so every linked pair meets in one.
* *Recursion.* A large region chooses a few of its documents as pivots and falls into their Voronoi
  cells. Distances here are Hamming distances of parity sketches, never more than the number of
  shingles by which two sets differ, and a metric: a linked pair differs by at most ``R(x) = n (100 - p) / p``
  shingles, so ``x`` belongs to its nearest pivot's cell and, by the triangle inequality, to each whose
  pivot is at most ``2 R(x)`` further. A region that this would not make smaller stays as it is.
* *Pairs.* In each region the documents still open choose heads, one at first and more in each round;
  all others meet these alone. Linked ones join the head's component; a region that has become one
  component closes; elsewhere the next heads follow. Sizes, places of the pivot
  and sketch distances rule pairs out inside the join; counts in ranges of hashes rule out more
  before any set is read. Pairs within one component are never made.

The order of pivots only affects speed. It comes from a table of counts of fixed size over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_kept, keep, lists, slices, small, table, texts
from .components import connected
from .words import Words, mix

#: Counters in the table that orders the pivots: 4 bytes each, whatever the input.
SKETCH_BITS = 21
_PIECES = 64
#: Heads that a region chooses in its first round: one, so that a group of near copies makes one star.
HEADS = 1
#: Times as many in each further round.
GROWTH = 16
#: Longs of a parity sketch, and their names.
LONGS = 8
_SKETCH = [f"s{k}" for k in range(LONGS)]
#: Documents of a region that is split into Voronoi cells, and the pivots that it chooses for that.
LARGE, PIVOTS = 512, 8


def _sets(array: pa.Array, size: int):
    """Distinct shingle hashes of each text: (flat values, count per row). Fewer words than ``size`` make one shingle."""
    words = Words(array, lower=True)
    shingles, _ = words.windows(size)
    whole = words.sequences()[0]
    out, counts = [], np.zeros(len(words.count), np.int64)
    for r, (lo, hi) in enumerate(zip(words.lo.tolist(), words.hi.tolist())):
        if hi - lo >= size:
            found = np.unique(shingles[lo : hi - size + 1])
        elif hi > lo:
            found = whole[r : r + 1]
        else:
            continue
        counts[r] = len(found)
        out.append(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def _fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    ends = np.cumsum(counts)
    out = []
    for salt in (11, 12):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values, salt), out=total[1:])
        out.append(mix(total[ends] - total[ends - counts] + counts.astype(np.uint64), salt).view(np.int64))
    return out[0], out[1]


def pivot_counts(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents hold a shingle of each hash bucket; ``2**bits`` counters over all documents."""

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in slices(batches, "text"):
            values, _ = _sets(batch.column("text"), size)
            total += np.bincount(values >> np.uint64(64 - bits), minlength=1 << bits).astype(np.uint32)
        if total.any():
            # Byte planes: most counts of one task fit the first, and the others are zeros.
            planes = [zstandard.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in np.split(total, _PIECES)]
            yield pa.RecordBatch.from_pydict({"piece": np.arange(_PIECES, dtype=np.int32), "counts": planes})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) // _PIECES, np.uint64)
        for batch in batches:
            for x in batch.column("counts"):
                planes = np.frombuffer(zstandard.decompress(x.as_py()), np.uint8).reshape(4, -1)
                total += np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        yield pa.RecordBatch.from_pydict({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary")
    out = np.zeros((_PIECES, (1 << bits) // _PIECES), np.uint64)
    for row in parts.toLocalIterator():
        out[row["piece"]] = np.frombuffer(row["counts"], np.uint64)
    return out.reshape(-1)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Half powers of two above the mean load: 0 for ordinary buckets, more for common shingles."""
    load = np.maximum(counts / max(counts.mean(), 1.0), 1e-9)
    return np.clip(np.floor(2 * np.log2(load)), 0, 120).astype(np.uint8)


def _bins(own: np.ndarray) -> bytes:
    """How many of a set's shingles fall in each of some n/4 ranges of hashes; 255 stands for that many or more."""
    bits = min(12, max(4, int(len(own) // 4).bit_length()))
    return np.minimum(np.bincount(own >> np.uint64(64 - bits), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _parity(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles falls in each of ``64 * LONGS`` ranges of hashes, as longs."""
    at = own // np.uint64(2**64 // (64 * LONGS))
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * LONGS) & 1).astype(np.uint8)).view(np.int64)


def _differ(a: str, b: str) -> Column:
    """Hamming distance of two sketches, the columns of which have these prefixes."""
    return sum((F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in _SKETCH[1:]), F.bit_count(F.col(a + _SKETCH[0]).bitwiseXOR(F.col(b + _SKETCH[0]))))


def _overlap(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """At most so many shingles are in both sets. Each range of hashes is a pivot; their triangle inequalities add up."""
    p, q = (np.frombuffer(b, np.uint8).astype(np.int64) for b in (x, y))
    if (p == 255).any() or (q == 255).any():
        return min(nx, ny)
    m = min(len(p), len(q))
    return int(np.minimum(p.reshape(m, -1).sum(1), q.reshape(m, -1).sum(1)).sum())


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs that the counts in ranges of hashes do not rule out."""
    sides = reps.select("ka", "n", "bins")
    both = pairs.join(sides.select(F.col("ka").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("y")), "b")
    both = both.join(sides.select(F.col("ka").alias("a"), F.col("n").alias("na"), F.col("bins").alias("x")), "a")

    def check(batches):
        for batch in batches:
            x, y, na, nb = (batch.column(c).to_pylist() for c in ("x", "y", "na", "nb"))
            stays = []
            for i in range(len(x)):
                most = _overlap(x[i], y[i], na[i], nb[i])
                stays.append(100 * most >= percent * (na[i] + nb[i] - most))
            yield batch.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))

    return both.select("a", "b", "x", "y", "na", "nb").mapInArrow(check, "a long, b long")


def classes(docs: DataFrame, size: int, percent: int, levels=None) -> DataFrame:
    """One row per document: (doc_id, ka, kb, n), the pivots of its window, counts in ranges of hashes, and the parity sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    bits = int(np.log2(len(levels)))

    def find(batches):
        rank = shared.value
        for batch in slices(batches, "text"):
            values, counts = _sets(batch.column("text"), size)
            ka, kb = _fingerprints(values, counts)
            out, width, bins = [], np.zeros(len(counts), np.int64), [b""] * len(counts)
            sketch = np.zeros((len(counts), LONGS), np.int64)
            at = 0
            for r, n in enumerate(counts.tolist()):
                if n:
                    own = values[at : at + n]
                    k = n - -(-percent * n // 100) + 1
                    order = np.lexsort((own, rank[own >> np.uint64(64 - bits)]))[:k]
                    out.append(own[order])
                    width[r] = k
                    bins[r] = _bins(own)
                    sketch[r] = _parity(own)
                    at += n
            flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ka), pa.array(kb), pa.array(counts), lists(flat.view(np.int64), width, pa.int64()), pa.array(bins, pa.binary()), *[pa.array(sketch[:, k]) for k in range(LONGS)]], ["doc_id", "ka", "kb", "n", "window", "bins", *_SKETCH])

    return docs.mapInArrow(find, "doc_id long, ka long, kb long, n long, window array<long>, bins binary, " + ", ".join(f"{s} long" for s in _SKETCH))


def _measure(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(a, b, inter, na, nb) of each pair of classes, from the whole texts of one document of each class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("ka")).distinct().join(reps.select("ka", "rep"), "ka")
    wanted = keep(wanted.select(F.col("rep").alias("doc_id")).distinct(), "wanted")

    def shingled(batches):
        for batch in slices(batches, "text"):
            values, counts = _sets(batch.column("text"), size)
            ka, _ = _fingerprints(values, counts)
            yield pa.RecordBatch.from_arrays([pa.array(ka), lists(values.view(np.int64), counts, pa.int64())], ["ka", "own"])

    # A repeated doc_id may bring texts of other classes; the fingerprint decides.
    found = docs.join(small(wanted), "doc_id", "left_semi").select("text")
    sets = keep(found.mapInArrow(shingled, "ka long, own array<long>").dropDuplicates(["ka"]), "sets")

    def intersect(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xv, yv = x.flatten().to_numpy(), y.flatten().to_numpy()
            xo, yo = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) for c in (x, y))
            # Both sides sorted within a row: one sort of all (row, value) finds what occurs twice.
            inter = np.empty(batch.num_rows, np.int64)
            for r in range(batch.num_rows):
                p, q = xv[xo[r] : xo[r + 1]], yv[yo[r] : yo[r + 1]]
                both = np.concatenate([p, q])
                both.sort()
                inter[r] = np.count_nonzero(both[1:] == both[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter), pa.array(np.diff(xo)), pa.array(np.diff(yo))], ["a", "b", "inter", "na", "nb"])

    left = pairs.join(sets.select(F.col("ka").alias("b"), F.col("own").alias("y")), "b")
    both = left.join(sets.select(F.col("ka").alias("a"), F.col("own").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(intersect, "a long, b long, inter long, na long, nb long")


def _spread(batches, percent: int):
    """Of each region's candidates those that lie farthest apart, up to ``PIVOTS``: one, then always the farthest from all before, while windows tell it from these."""
    for batch in batches:
        chosen = []
        for some in batch.column("some").to_pylist():
            bits = np.unpackbits(np.array([[x[s] for s in _SKETCH] for x in some], np.int64).view(np.uint8), axis=1)
            width = np.array([2 * (x["n"] * (100 - percent) // percent) for x in some])
            picked, least = [0], (bits != bits[0]).sum(1)
            while len(picked) < PIVOTS and (least > width).any():
                picked.append(int(np.where(least > width, least, -1).argmax()))
                least = np.minimum(least, (bits != bits[picked[-1]]).sum(1))
            chosen.append([{s: some[k][s] for s in _SKETCH} for k in picked])
        kind = pa.list_(pa.struct([(s, pa.int64()) for s in _SKETCH]))
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), pa.array(chosen, kind)], ["pivot", "pivots"])


def _split(cells: DataFrame, percent: int) -> DataFrame:
    """Large regions split into the Voronoi cells of some of their documents, again and again while that makes them smaller."""
    cells = cells.withColumn("whole", F.lit(False))
    while True:
        sizes = keep(cells.where("not whole").groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE), "large")
        if sizes.isEmpty():
            return cells.drop("whole")
        large = cells.join(small(sizes), "pivot").select("pivot", "ka", "n", "i", *_SKETCH)
        first = large.withColumn("at", F.row_number().over(Window.partitionBy("pivot").orderBy("ka"))).where(F.col("at") <= 4 * PIVOTS)
        some = first.groupBy("pivot").agg(F.collect_list(F.struct("n", *_SKETCH)).alias("some"))  # 4 * PIVOTS of them
        pivots = keep(some.mapInArrow(lambda batches: _spread(batches, percent), "pivot long, pivots array<struct<" + ", ".join(f"{s}: bigint" for s in _SKETCH) + ">>"), "pivots")
        far = F.transform("pivots", lambda p: sum((F.bit_count(F.col(s).bitwiseXOR(p[s])) for s in _SKETCH[1:]), F.bit_count(F.col(_SKETCH[0]).bitwiseXOR(p[_SKETCH[0]]))))
        reach = F.array_min("far") + 2 * F.floor(F.col("n") * (100 - percent) / percent)
        def reached(rows: DataFrame) -> DataFrame:
            met = rows.join(small(pivots), "pivot").withColumn("far", far).withColumn("reach", reach)
            return met.withColumn("cell", F.explode(F.filter(F.transform("far", lambda d, k: F.when(d <= F.col("reach"), k)), lambda k: k.isNotNull())))

        shares = reached(large).groupBy("pivot", "cell").agg(F.count(F.lit(1)).alias("share")).groupBy("pivot").agg(F.sum("share").alias("all"), F.max("share").alias("most"))
        good = keep(shares.join(sizes, "pivot").where("all <= 2 * size and 4 * most <= 3 * size").select("pivot"), "split")
        if good.isEmpty():
            return cells.drop("whole")
        parts = reached(large.join(small(good), "pivot", "left_semi")).select(F.xxhash64("pivot", "cell").alias("pivot"), "ka", "n", "i", *_SKETCH, F.lit(False).alias("whole"))
        tried = keep(sizes.select("pivot", F.lit(True).alias("tried")), "tried")
        rest = cells.join(small(good), "pivot", "left_anti").join(small(tried), "pivot", "left")
        rest = rest.select("pivot", "ka", "n", "i", *_SKETCH, F.coalesce("tried", "whole").alias("whole"))
        following = keep(rest.unionByName(parts), "regions")
        drop_kept(cells)
        cells = following


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets and their components.

    Returns ``(members, named)``: members (doc_id, ka, kb, n) has a row per document; named
    (ka, kb, component) names for each class the smallest doc_id of its component.
    """
    docs = texts(docs, id_col, text_col)
    levels = _levels(pivot_counts(docs, size))
    whole = classes(docs, size, percent, levels)
    members = keep(whole.select("doc_id", "ka", "kb", "n"), "members")
    kept = [F.first(c).alias(c) for c in ("n", "window", "bins", *_SKETCH)]
    reps = keep(whole.where("n > 0 and doc_id is not null").groupBy("ka", "kb").agg(F.min("doc_id").alias("rep"), *kept), "classes")
    region = reps.select(F.posexplode("window").alias("i", "pivot"), "ka")
    shared = keep(region.groupBy("pivot").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("pivot"), "shared")
    cells = region.join(shared, "pivot").join(reps.select("ka", "n", *_SKETCH), "ka").select("pivot", "ka", "n", "i", *_SKETCH)
    cells = _split(keep(cells, "regions"), percent)
    reps_small = reps.select("ka", "rep", "n")
    comp = None
    done, take = 0, HEADS  # so many of a region's documents, in the order of ``ka``, have been heads and have met all after them
    while True:
        if comp is None:
            named = cells.withColumn("root", F.col("ka"))
        else:
            named = cells.join(small(comp.select(F.col("node").alias("ka"), "root")), "ka", "left").withColumn("root", F.coalesce("root", "ka"))
        # Regions of one component close, and those in which all have met.
        open_ = keep(named.groupBy("pivot").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).where(f"r0 <> r1 and size > {done + 1}").select("pivot"), "open")
        if open_.isEmpty():
            break
        state = keep(named.join(small(open_), "pivot"), "state") if comp is not None else named
        order = Window.partitionBy("pivot").orderBy("ka")
        if done:
            first = state.select("pivot", "ka", "i", "root").withColumn("at", F.row_number().over(order)).where((F.col("at") > done) & (F.col("at") <= done + take))
        else:
            first = state.groupBy("pivot").agg(F.min(F.struct("ka", "i", "root")).alias("x")).select("pivot", "x.*")
        first = first.select("pivot", "ka", F.col("i").alias("ia"), F.col("root").alias("ra"))
        heads = first.join(reps.select("ka", F.col("n").alias("na"), *[F.col(s).alias(f"a{s}") for s in _SKETCH]), "ka")
        heads = keep(heads.withColumnRenamed("ka", "a"), "heads")
        near = (F.col("n") * 100 >= F.col("na") * percent) & (F.col("na") * 100 >= F.col("n") * percent)
        # A linked pair differs by at most so many shingles (times 100 + percent).
        most = (F.col("n") + F.col("na")) * (100 - percent)
        # Where a pair first meets, neither holds the pivots before: so many elements set them apart at least. A pair
        # for which these are too many has met before, or lies too far apart.
        apart = (F.col("i") + F.col("ia")) * (100 + percent) <= most
        pairs = state.join(heads, "pivot").where((F.col("ka") > F.col("a")) & (F.col("root") != F.col("ra")) & near & apart & (_differ("", "a") * (100 + percent) <= most))
        pairs = keep(_possible(pairs.select("a", F.col("ka").alias("b")).distinct(), reps, percent), "pairs")
        if not pairs.isEmpty():
            links = keep(_measure(pairs, docs, reps_small, size), "measured").where(F.col("inter") * 100 >= (F.col("na") + F.col("nb") - F.col("inter")) * percent).select("a", "b")
            if comp is None:
                comp = keep(connected(links), "components")
            else:  # only what joins components is new; the others take over the new names
                root = lambda c: small(comp).select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
                both = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
                joined = connected(both).select(F.col("node").alias("old"), F.col("root").alias("new"))
                moved = comp.join(joined, comp["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
                added = joined.join(comp, joined["old"] == comp["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
                comp = keep(moved.unionByName(added), "components")
        for old in (heads, *([state] if state is not named else [])):
            drop_kept(old)
        done += take
        take *= GROWTH
    own = reps.select("ka", "kb", "rep")
    if comp is None:
        return members, own.withColumnRenamed("rep", "component")
    named = own.join(comp.withColumnRenamed("node", "ka"), "ka", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(keep(least, "least"), "root", "left")
    return members, keep(named.select("ka", "kb", F.coalesce("component", "rep").alias("component")), "named")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null and blank texts have no shingles and link with nothing; a null doc_id keeps its row, links
    with nothing and has a null component. Repeated rows each get a row. Rows are never dropped.
    Other columns of ``docs``, whatever their names, are left out.
    """
    members, named = jaccard_classes(docs, size, percent, id_col, text_col)
    out = members.join(named, ["ka", "kb"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
