"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary wording.

Windows are single words, lower-cased and framed by marks so that the shortest is long enough to be compressed.
A window's *gain* is its compressed length under the ordinary dictionary less that under the toxic one. A document is
scored by how its windows' gains pass a threshold; threshold and weights are calibrated on labelled rows that
neither dictionary was trained on. Only texts enter a score.

Fitting reads a bounded sample of labelled rows, each whole: at most ``per_class`` of each label, those of least hash.
Scoring covers every window of every text; a distinct word is compressed once per worker.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, keep, resident, slices, table, texts, tidy
from .lexicon import Lexicon
from .words import Words

#: Labelled rows of each class that fitting may read.
PER_CLASS = 3_000
TOXIC_BYTES, ORDINARY_BYTES = 16_000, 100_000
#: A word belongs to toxic wording if its documents are so many times likelier toxic (log), by so much evidence (G test).
LOG_ODDS, EVIDENCE = 3.0, 10.0
_PART = re.compile(r"\w+")
_OPEN, _CLOSE = b"\x01" * 4, b"\x02" * 4


@dataclass(frozen=True)
class Model:
    """Dictionaries, the calibrated gain threshold, and logistic weights over :func:`_features`."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, ...]


def _framed(word: str) -> bytes:
    return _OPEN + word.encode() + _CLOSE


def _dictionary(words: list[str], size: int) -> bytes:
    """Framed words up to ``size`` bytes; the first stand last, where matches are cheapest."""
    out, total = [], 0
    for word in words:
        total += len(_framed(word))
        if total > size:
            break
        out.append(_framed(word))
    return b"".join(reversed(out)) or b"\x00" * 8


def _gains(toxic: bytes, ordinary: bytes) -> Lexicon:
    import zstandard as z

    fine = z.ZstdCompressionParameters(strategy=z.STRATEGY_BTULTRA, min_match=3, window_log=17, hash_log=16, chain_log=16, search_log=6, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    both = []
    for content in (ordinary, toxic):
        dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=fine)
        both.append(z.ZstdCompressor(compression_params=fine, dict_data=dictionary).compress)
    plain, bad = both

    def gains(spans):
        out = []
        for span in spans:
            best = -31
            for part in _PART.findall(span.decode().lower()):
                framed = _framed(part)
                best = max(best, len(plain(framed)) - len(bad(framed)))
            out.append((min(best, 31) + 32,))
        return out

    return Lexicon(gains)


def _document_gains(model_bytes: tuple[bytes, bytes], array: pa.Array) -> list[np.ndarray]:
    words = Words(array, lower=True)
    found, _ = resident(("gains", *model_bytes), lambda: _gains(*model_bytes)).look_up(words.data, words.start, words.end, words.hash)
    found = found.astype(np.int64) - 32
    return [found[lo:hi] for lo, hi in zip(words.lo.tolist(), words.hi.tolist())]


def _features(gains: list[np.ndarray], threshold: int) -> np.ndarray:
    out = np.zeros((len(gains), 5))
    for i, g in enumerate(gains):
        if len(g):
            top = np.sort(g)[-2:]
            high, higher = int((g >= threshold).sum()), int((g >= threshold + 2).sum())
            out[i] = (top[-1] / 8, top.mean() / 8, math.log1p(high), min(20.0, 100 * high / len(g)) / 4, math.log1p(higher))
    return np.column_stack([np.ones(len(gains)), out])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    return w


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows. With no row of one class, a model that scores everything as the other."""
    rows = [(t, int(y)) for t, y in rows if y is not None]
    train = [r for r in rows if zlib.crc32(r[0].encode()) % 3]
    rest = [r for r in rows if not zlib.crc32(r[0].encode()) % 3]
    docs, uses = ({0: Counter(), 1: Counter()} for _ in range(2))
    many = Counter(y for _, y in train)
    for t, y in train:
        parts = _PART.findall(t.lower())
        uses[y].update(parts)
        docs[y].update(set(parts))

    def telling(word: str) -> bool:
        a, b, n = docs[1][word], docs[0][word], len(train)
        odds = math.log((a + 0.5) / (many[1] + 1) / ((b + 0.5) / (many[0] + 1)))
        e1, e0 = (a + b) * many[1] / n, (a + b) * many[0] / n
        return odds > LOG_ODDS and 2 * (a * math.log(a / e1) + (b * math.log(b / e0) if b else 0)) > EVIDENCE

    toxic = [w for w, n in docs[1].most_common() if n >= 2 and many[0] and telling(w)]
    ordinary = [w for w, _ in uses[0].most_common() if w not in set(toxic)]
    contents = _dictionary(toxic, TOXIC_BYTES), _dictionary(ordinary, ORDINARY_BYTES)
    rest = rest if len({y for _, y in rest}) == 2 else rows
    y = np.array([y for _, y in rest], float)
    if len(set(y.tolist())) < 2:
        return Model(*contents, 6, (6.0 if len(y) and y[0] else -6.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    gains = _document_gains(contents, pa.array([t for t, _ in rest], pa.string()))
    best = None
    for threshold in range(3, 9):
        x = _features(gains, threshold)
        w = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-x @ w)), 1e-9, 1 - 1e-9)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        if best is None or loss < best[0]:
            best = loss, threshold, tuple(map(float, w))
    return Model(*contents, *best[1:])


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The bounded sample that fitting reads: per label the rows of least hash, outside the held-out fifth, with whole texts.

    Rows without an id, a text or a label of 0 or 1 are no part of it. Where a doc_id is repeated the least of its texts
    counts, once for each label it bears, so the sample has at most ``per_class`` rows of each.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").select("doc_id", "toxic")
    chosen = None
    for label in (0, 1):
        ids = known.where(F.col("toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = ids if chosen is None else chosen.unionByName(ids)
    chosen = F.broadcast(keep(chosen, "chosen"))  # 2 * per_class rows of two numbers
    found = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return found.select("text", F.col("toxic").cast("int").alias("toxic"))


def fit_sample(rows: DataFrame) -> Model:
    """:func:`fit` on the bounded rows (text, toxic) of :func:`sample`, in a task: only the model reaches the driver."""

    def learn(batches):
        model = fit(sorted((t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())))
        tidy()
        yield pa.RecordBatch.from_pydict({"toxic": [model.toxic], "ordinary": [model.ordinary], "threshold": pa.array([model.threshold], pa.int32()), "weights": [list(model.weights)]})

    found = rows.repartition(1).mapInArrow(learn, "toxic binary, ordinary binary, threshold int, weights array<double>").first()
    return Model(bytes(found["toxic"]), bytes(found["ordinary"]), found["threshold"], tuple(found["weights"])) if found else fit([])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns to carry and (doc_id, score, predicted, windows, gain) of every row; null and blank texts get the score of a text without windows.

    Null ids and repeated rows are rows like others, an empty table gives an empty one, texts of any length are scored
    whole. Columns to carry keep any name but those of the result, which raise a ValueError; others play no part.
    """
    if clash := {"doc_id", "score", "predicted", "windows", "gain"} & set(carry):
        raise ValueError(f"names of result columns: {sorted(clash)}")

    def scan(batches):
        for batch in slices(batches, "text", cache=("gains", model.toxic, model.ordinary)):
            gains = _document_gains((model.toxic, model.ordinary), batch.column("text"))
            p = 1 / (1 + np.exp(-np.clip(_features(gains, model.threshold) @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(g) for g in gains], pa.int64()), pa.array([int(g.max()) if len(g) else None for g in gains], pa.int64())], [*carry, "doc_id", "score", "predicted", "windows", "gain"])

    rows = texts(docs, id_col, text_col, tuple(c for c in carry if c != "text"))
    return rows.mapInArrow(scan, ddl(rows, carry) + "doc_id long, score double, predicted int, windows long, gain long")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_sample(sample(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")  # a null id never enters the fit
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
