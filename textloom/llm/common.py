"""Shared plumbing: tables, written intermediate results, small Arrow helpers.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``; executors that are lost later re-read it from there.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its bytes were summed and found no more than this.
BROADCAST_BYTES = 32 << 20
#: Whole texts in one Arrow batch.
ARROW_ROWS = 1_000
_resident: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only where it is unset on one machine (tests); a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`keep` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/textloom/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(name: str, kind) -> Column:
    """About how many bytes a column's value takes in memory."""
    column = F.col(f"`{name}`")
    if kind.typeName() in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if kind.typeName() == "array":
        inner = len(kind.elementType.fields) * 8 + 16 if kind.elementType.typeName() == "struct" else 8
        return F.coalesce(F.size(column), F.lit(0)) * inner + 32
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if the bytes of its rows, summed here, are within the bound, else as it is."""
    width = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(32))
    total = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def refuse(df: DataFrame, *names: str) -> None:
    """An error if ``df`` has columns of these names, whatever their case."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"names of result columns: {sorted(clash)}")


def resident(key: tuple, build: Callable):
    """What a worker keeps between tasks: one thing only, so that stages of several operators don't pile up their caches."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def tidy() -> None:
    """Drop what is resident and give unused memory back to the machine; reused workers and the driver would hold it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``ARROW_ROWS`` rows: texts are long, and a plan has no setting of its own for this."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only id, text and the columns to ``carry``, whatever others there are; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in carry])


def ddl(rows: DataFrame, names) -> str:
    """The given columns of ``rows`` as the beginning of a schema string."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in set(names))


def slices(batches, column: str, target: int = 3 << 20, cache: tuple | None = None):
    """The batches, cut so that a column's bytes stay near ``target`` (a single row may be larger).

    What earlier tasks left resident goes first, unless it is what this task names as its ``cache``.
    """
    if cache not in _resident:
        _resident.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // target
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
    tidy()


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1, from 0) of a string or binary array; nulls are empty."""
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or not len(offsets) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number of them in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def joined(segments: np.ndarray, seg_start: np.ndarray, seg_len: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenate ``segments[seg_start[k] : seg_start[k] + seg_len[k]]`` for k in ``which``."""
    lens = seg_len[which]
    total = int(lens.sum())
    if not total:
        return segments[:0]
    begin = np.cumsum(lens) - lens
    return segments[np.repeat(seg_start[which] - begin, lens) + np.arange(total)]
