"""Best-fit-decreasing packing of token sequences, exact over all documents at once.

Best-fit decreasing only looks at lengths, and there are at most ``capacity`` of them. The number of pieces of
each length is counted in the cluster; the packing itself runs over these counts: from the longest length down,
a segment tree over remaining capacities gives the tightest open bins, and all pieces of a length move in runs
(rank from, how many, first bin, offset). A piece then finds its place by its rank among those of its length.
Nothing but the counts (at most ``capacity`` numbers) reaches the driver and nothing but the runs leaves it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, refuse, resident, slices, small, table, texts
from .lexicon import Lexicon
from .words import Words

CAPACITY = 2048
#: Pieces of one shard, in which ranks are counted; a length is dealt over all shards.
SHARD_PIECES = 5_000
MAX_SHARDS = 4096
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bpe(path: str):
    """Token ids of white-space separated spans. Plain words, with or without a full stop or comma, skip the tokenizer's text steps."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model = whole.model
    plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet shows as themselves
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    marks = {"": [], **{m: whole.encode(m, add_special_tokens=False).ids for m in ".,"}}

    def encode(spans):
        out = []
        for span in spans:
            text = span.decode()
            if m := plain.fullmatch(text):
                out.append([t.id for t in model.tokenize(m[1].lower().encode().decode("latin-1").translate(letters))] + marks[m[2]])
            else:
                out.append(whole.encode(text, add_special_tokens=False).ids)
        return out

    return encode


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document: its token ids and a final 0, cut where longer than ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers. White space separates words in this vocabulary, so words
    are encoded one by one, each distinct word once per worker. Null and empty texts give the single id 0.
    """
    path = path or tokenizer_path(TOKENIZER)

    def scan(batches):
        key = ("word ids", path)
        lexicon = resident(key, lambda: Lexicon(_bpe(path)))
        for batch in slices(batches, "text", cache=key):
            words = Words(batch.column("text"))
            ids, sizes = lexicon.look_up(words.data, words.start, words.end, words.hash)
            total = np.concatenate([[0], np.cumsum(sizes)])
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), total[words.lo].tolist(), total[words.hi].tolist()):
                own = np.append(ids[lo:hi], np.uint32(0)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    for k, v in zip(out, (doc_id, piece, start, len(cut), cut.tobytes())):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))})

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, piece int, start long, length long, ids binary")


class _Tightest:
    """A segment tree over remaining capacities: the least one that is at least ``need`` and has open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, at: int, bins: int) -> None:
        at += self.size
        while at:
            self.tree[at] += bins
            at >>= 1

    def find(self, need: int) -> int | None:
        node = need + self.size
        if self.tree[node]:
            return need
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, how many, first bin, offset) that best-fit decreasing makes of ``counts``, and the bins used."""
    runs, bins = [], 0
    open_bins: dict[int, list[tuple[int, int]]] = {}
    tree = _Tightest(capacity)

    def leave(rest: int, first: int, many: int) -> None:
        if rest and many:
            open_bins.setdefault(rest, []).append((first, many))
            tree.add(rest, many)

    for length in sorted(counts, reverse=True):
        rank, need = 0, counts[length]
        while need:
            room = tree.find(length)
            if room is None:
                room, first = capacity, bins
                have = -(-need // (capacity // length))
                bins += have
            else:
                first, have = open_bins[room].pop()
                tree.add(room, -have)
            each = room // length  # the bin just used stays the tightest until no further piece fits
            full = min(have, need // each)
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            need -= full * each
            leave(room - each * length, first, full)
            if full < have and need and need < each:
                for k in range(need):
                    runs.append((length, rank, 1, first + full, capacity - room + k * length))
                    rank += 1
                leave(room - need * length, first + full, 1)
                full, need = full + 1, 0
            leave(room, first + full, have - full)
    return runs, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) and their ``sequence_id`` and ``offset``; rows and other columns stay.

    Every row is a piece, repeated ones too, each with its own place; pieces of one length may change places with one
    another. An empty table gives an empty one. A null length, or one out of bounds, is an error, as is a column named
    ``sequence_id``, ``offset``, or like one used on the way; nulls in other columns stay.
    """
    refuse(pieces, "sequence_id", "offset", "__mark", "__shard", "__rank", "__rows", "__before")
    columns = pieces.columns
    number = keep(pieces, "pieces")
    rows = number.count()
    shards = min(MAX_SHARDS, max(16, -(-rows // SHARD_PIECES)))
    mark = F.xxhash64(*columns)
    dealt = number.withColumn("__mark", mark).withColumn("__shard", F.pmod("__mark", F.lit(shards)))
    counted = keep(dealt.groupBy("length", "__shard").agg(F.count(F.lit(1)).alias("__rows")), "counts")
    lengths = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("__rows").alias("n")).collect()}
    if wrong := [n for n in lengths if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths out of 1 to {capacity}: {wrong[:5]}")
    runs, _ = best_fit(lengths, capacity)
    before = Window.partitionBy("length").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "__shard", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("length", "__shard").orderBy("__mark")
    ranked = dealt.withColumn("__rank", F.row_number().over(order)).join(small(keep(offsets, "offsets")), ["length", "__shard"])
    ranked = ranked.select(*columns, (F.col("__rank") - 1 + F.col("__before")).alias("__rank"))
    table_ = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table_)

    def place(batches):
        found = shared.value
        keys = (found[:, 0] << 50) + found[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "__rank"))
            run = np.searchsorted(keys, (length << 50) + rank, "right") - 1
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found[run, 3] + rank - found[run, 1]), pa.array(found[run, 4])], [*columns, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*ranked.select(*columns).schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
