"""Passages of 50 or more words that repeat across documents, found with sharded Aho-Corasick automata.

1. *Anchors.* Of the 43 eight-word phrases in a 50-word window the one with the least hash is its anchor;
   equal windows have equal anchors. An anchor seen in one class of equal documents only can't recur.
2. *Confirmed passages.* Windows with a recurring anchor are counted by their hash over all documents. Those in
   two documents are confirmed; the smallest doc_id owns them, and runs of its windows are its passages.
3. *Automata.* Passages are dealt into shards by owner. Each passage is cut into aligned 25-word phrases, one of
   which lies whole in any 50-word window; a shard's phrases make one automaton over word numbers.
4. *Streaming.* A document runs through the shards that own one of its windows. Each match grows left and right
   while document and passage agree word by word; 50 words or more of agreement are an occurrence, and count
   as repeated where the owner has the smaller doc_id.

A shard that many texts visit is dealt into chunks by the bytes of these, with a copy of its automaton each; a long
owner's windows are dealt by stretches of its words, so no key meets one task.
Words compare by 64-bit hashes; the automata run on their low 32 bits and every match is checked on all 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, keep, lists, slices, small, table, texts, tidy
from .words import Words

WINDOW, GRAM, PHRASE = 50, 8, 25
#: Confirmed windows in a shard, word positions of an owner that stay together, and bytes of texts that share one copy of an automaton.
SHARD_WINDOWS, BLOCK_WORDS, CHUNK_BYTES = 40_000, 20_000, 6 << 20


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window that starts at each word, and whether the window fits its row."""
    grams, _ = words.windows(GRAM)
    fits = np.arange(len(grams)) + WINDOW <= np.repeat(words.hi, words.count)
    width, low = WINDOW - GRAM + 1, grams
    step = 1
    while 2 * step <= width:
        low = np.minimum(low, np.concatenate([low[step:], low[len(low) - step :]])) if len(low) > step else low
        step *= 2
    rest = width - step
    if rest and len(low) > rest:
        low = np.minimum(low, np.concatenate([low[rest:], low[len(low) - rest :]]))
    return low, fits


def _members(docs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            ca, cb = words.sequences()
            anchor, fits = _anchors(words)
            found = [np.unique(anchor[lo:hi][fits[lo:hi]]) for lo, hi in zip(words.lo.tolist(), words.hi.tolist())]
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ca.view(np.int64)), pa.array(cb.view(np.int64)), pa.array(words.count), lists(flat.view(np.int64), np.array([len(x) for x in found]), pa.int64())], ["doc_id", "ca", "cb", "n", "anchors"])

    return docs.mapInArrow(scan, "doc_id long, ca long, cb long, n long, anchors array<long>")


def _windows(batches):
    """(window, doc_id, at) of each window whose anchor is in the row's list."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        anchor, fits = _anchors(words)
        whole, _ = words.windows(WINDOW)
        wanted = batch.column("anchors")
        ids = batch.column("doc_id").to_numpy()
        for r, (lo, hi) in enumerate(zip(words.lo.tolist(), words.hi.tolist())):
            own = wanted[r].values.to_numpy().view(np.uint64)
            at = np.flatnonzero(fits[lo:hi] & np.isin(anchor[lo:hi], own))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(whole[lo:hi][at].view(np.int64)), pa.array(np.full(len(at), ids[r])), pa.array(at.astype(np.int32))], ["window", "doc_id", "at"])


def _passages(batches):
    """(owner, shard, passage) for each run of owned windows; a passage is its words joined by one space.

    Where rows repeat a doc_id with other texts, each text meets the windows of all; those past its end are left out,
    and what the others hold there is the owner's as well.
    """
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), hashes=False)
        data = words.data.tobytes()
        owners, shards, out = [], [], []
        ids, dealt = batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist()
        for r, lo in enumerate(words.lo.tolist()):
            at = np.sort(batch.column("ats")[r].values.to_numpy())
            at = at[at + WINDOW <= words.count[r]]
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            for run in np.split(at, cuts) if len(at) else ():
                a, b = lo + int(run[0]), lo + int(run[-1]) + WINDOW
                out.append(b" ".join(data[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())).decode())
                owners.append(ids[r])
                shards.append(dealt[r])
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(shards, pa.int64()), pa.array(out, pa.string())], ["owner", "shard", "passage"])


class Automaton:
    """An Aho-Corasick automaton over the aligned phrases of a set of passages."""

    def __init__(self, owners: list[int], passages: pa.Array):
        import ahocorasick

        self.words, self.owners = Words(passages), owners
        self.low = (self.words.hash & np.uint64(0xFFFFFFFF)).tolist()
        phrases: dict[tuple, list] = {}
        for p, (lo, hi) in enumerate(zip(self.words.lo.tolist(), self.words.hi.tolist())):
            for at in range(lo, hi - PHRASE + 1, PHRASE):
                phrases.setdefault(tuple(self.low[at : at + PHRASE]), []).append((p, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in phrases.items():
            self.automaton.add_word(phrase, places)
        self.any = bool(phrases)
        if self.any:
            self.automaton.make_automaton()

    def repeated(self, doc_id: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Word spans of a document, given by its word hashes, that occur in passages of smaller owners."""
        spans, n = [], len(hashes)
        if not self.any or n < WINDOW:
            return spans
        seen: dict[tuple[int, int], int] = {}
        for last, places in self.automaton.iter(tuple((hashes & np.uint64(0xFFFFFFFF)).tolist())):
            t = last - PHRASE + 1
            for p, at in places:
                if self.owners[p] >= doc_id or seen.get((p, at - t), -1) > t:
                    continue
                lo, hi = int(self.words.lo[p]), int(self.words.hi[p])
                a = min(t, at - lo)
                b = min(n - t, hi - at)
                left = np.flatnonzero(hashes[t - a : t] != self.words.hash[at - a : at])
                right = np.flatnonzero(hashes[t : t + b] != self.words.hash[at : at + b])
                start = t - a + (int(left[-1]) + 1 if len(left) else 0)
                end = t + (int(right[0]) if len(right) else b)
                seen[p, at - t] = max(end, t + 1)
                if end - start >= WINDOW:
                    spans.append((start, end))
        return merged(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, ordered and disjoint."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _locate(key, passages: pa.Table, docs: pa.Table) -> pa.Table:
    ids, cas, starts, ends = [], [], [], []
    if passages.num_rows and docs.num_rows:
        automaton = Automaton(passages.column("owner").to_pylist(), passages.column("passage").combine_chunks())
        for batch in slices(docs.to_batches(), "text"):
            words = Words(batch.column("text"))
            own = words.sequences()[0].view(np.int64).tolist()
            for doc_id, ca, lo, hi in zip(batch.column("doc_id").to_pylist(), own, words.lo.tolist(), words.hi.tolist()):
                for a, b in automaton.repeated(doc_id, words.hash[lo:hi]):
                    ids.append(doc_id)
                    cas.append(ca)
                    starts.append(a)
                    ends.append(b)
        del automaton
        tidy()
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "ca": pa.array(cas, pa.int64()), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found: array of (ca, start, end)) for documents with repeated words; ``ca`` is the hash of the text meant.

    Word positions count from 0, ends are exclusive. One row per doc_id: where rows repeat a doc_id with
    other texts, ``ca`` tells them apart. Null ids take no part.
    """
    docs = texts(docs, id_col, text_col).where("doc_id is not null")
    members = keep(_members(docs), "members")
    reps = keep(members.where(F.col("n") >= WINDOW).groupBy("ca", "cb").agg(F.min("doc_id").alias("doc_id"), F.first("anchors").alias("anchors")), "classes")
    anchors = reps.select("doc_id", "ca", F.explode("anchors").alias("anchor"))
    recurring = anchors.groupBy("anchor").agg(F.min("ca").alias("c0"), F.max("ca").alias("c1")).where("c0 <> c1").select("anchor")
    routed = keep(anchors.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "recurring")
    involved = docs.join(small(routed.select("doc_id")), "doc_id", "left_semi").dropDuplicates()
    involved = keep(involved.join(routed, "doc_id"), "involved")
    windows = involved.mapInArrow(_windows, "window long, doc_id long, at int")
    first = F.min(F.struct("doc_id", "at")).alias("first")
    owned = keep(windows.groupBy("window").agg(first, F.max("doc_id").alias("other")).where("first.doc_id < other").select("window", F.col("first.doc_id").alias("owner"), F.col("first.at").alias("at")), "owned")
    shards = max(1, -(-owned.count() // SHARD_WINDOWS))
    block = F.floor(F.col("at") / BLOCK_WORDS).alias("block")
    owned = owned.select("window", "owner", "at", F.pmod(F.xxhash64("owner", block), F.lit(shards)).alias("shard"))
    visits = windows.join(owned.select("window", "owner", "shard"), "window").where("owner < doc_id").select("doc_id", "shard").distinct()
    sizes = involved.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    visits = keep(visits.join(sizes, "doc_id"), "visits")
    chunks = keep(visits.groupBy("shard").agg(F.ceil(F.sum("bytes") / CHUNK_BYTES).cast("int").alias("chunks")), "chunks")
    visits = visits.join(small(chunks), "shard").select("shard", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("chunk"), "doc_id")
    by_owner = owned.groupBy(F.col("owner").alias("doc_id"), block, "shard").agg(F.collect_list("at").alias("ats"))  # at most BLOCK_WORDS
    passages = involved.select("doc_id", "text").join(by_owner, "doc_id").select("doc_id", "shard", "text", "ats").mapInArrow(_passages, "owner long, shard long, passage string")
    passages = passages.join(small(chunks), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "owner", "passage")
    streamed = visits.join(involved.select("doc_id", "text"), "doc_id")
    found = passages.groupBy("shard", "chunk").cogroup(streamed.groupBy("shard", "chunk")).applyInArrow(_locate, "doc_id long, ca long, start int, end int")
    same = members.where(F.col("n") >= WINDOW)
    copies = same.join(reps.select("ca", "cb", F.col("doc_id").alias("rep")), ["ca", "cb"]).where("doc_id > rep")
    spans = found.unionByName(copies.select("doc_id", "ca", F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    return keep(spans.groupBy("doc_id").agg(F.collect_set(F.struct("ca", "start", "end")).alias("found")), "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs``, by its columns to ``carry``, with doc_id, ``spans`` (word spans removed), ``n_words`` and ``kept`` (text of the words that stay, joined by one space).

    A word goes if a 50-word window over it also starts in a document with a smaller doc_id. Null texts have no
    words; null ids lose nothing; texts of fewer than 50 words lose nothing; repeated rows are treated alike.
    """
    spans = repeated_spans(docs, id_col, text_col)
    rows = texts(docs, id_col, text_col, tuple(c for c in carry if c != "text")).join(small(spans), "doc_id", "left")

    def cut(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            ca = words.sequences()[0].view(np.int64).tolist()
            data = words.data.tobytes()
            kept, spans = [], []
            for r, (found, lo, hi) in enumerate(zip(batch.column("found").to_pylist(), words.lo.tolist(), words.hi.tolist())):
                own = merged([(x["start"], x["end"]) for x in found or () if x["ca"] == ca[r]])
                stays = np.ones(hi - lo, bool)
                for a, b in own:
                    stays[a:b] = False
                at = lo + np.flatnonzero(stays)
                kept.append(b" ".join([data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]).decode())
                spans.append([{"start": a, "end": b} for a, b in own])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], batch.column("doc_id"), pa.array(words.count), pa.array(spans, kind), pa.array(kept, pa.string())], [*carry, "doc_id", "n_words", "spans", "kept"])

    return rows.mapInArrow(cut, ddl(rows, carry) + "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
