"""Packing and SentencePiece encoding against the libraries and plain best fit."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import packing, piece_table

SPECIAL = [None, "", " ", "  ", "▁", "\n", " \n ", "▁ b", "a ▁b", "a" * 300, "the " * 3000, "=" * 200, "0" * 99, "in" * 200, "Don't we'll <|endoftext|> x<|startoftext|>y", "e\u0301 É ÀÉ, ß. İ ſ", "日本語 텍스트 😀👍🏽", "\x00\x1c\x85\u00a0\u2028z", "word," * 700]


def texts():
    rng = random.Random(5)
    alphabet = " \n\t▁abcdethr eS.,!0123é😀ñ中\u0301aab   thein'"
    return SPECIAL + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, ids string")


def test_token_pieces_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    got = defaultdict(list)
    for r in packing.token_pieces(docs, 64).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    for i, t in enumerate(texts()):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(got[i]) == [(k, s, len(ids[s : s + 64]), ids[s : s + 64].tobytes()) for k, s in enumerate(range(0, len(ids), 64))], t


def plain_bins(lengths, capacity):
    rest = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rest, n)
        left = (rest.pop(at) if at < len(rest) else capacity) - n
        bisect.insort(rest, left)
    return len(rest)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 2048])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 6)) for _ in range(rng.randint(1, 700))]
    runs, bins = packing.best_fit(Counter(lengths), capacity)
    used = defaultdict(list)
    placed = Counter()
    for length, rank, many, first, offset in runs:
        placed[length] += many
        for i in range(many):
            used[first + i].append((offset, length))
    assert placed == Counter(lengths) and len(used) == bins == plain_bins(lengths, capacity)
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity


def test_pack(spark, docs):
    pieces = packing.token_pieces(docs, 64).drop("ids")
    rows = packing.pack(pieces.unionByName(pieces), 64).collect()  # repeated rows get a place each
    assert len(rows) == 2 * pieces.count()
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        assert [o for o, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]] and sum(n for _, n in spans) <= 64
    assert len(used) == plain_bins([r["length"] for r in rows], 64)
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).collect() == []


def test_query_digests(spark):
    rows = packing.op7_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows} == {(p["doc_id"], p["piece"], zlib.crc32(p["ids"])) for p in pieces}


def test_pack_refuses(spark):
    for schema, row in (("length long, offset long", (1, 1)), ("Sequence_ID long, length long", (1, 1)), ("length long", (None,)), ("length long", (0,)), ("length long", (2049,))):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([row], schema))


def test_packing_query_is_best_fit(spark):
    """The query's own places: no gaps, no overlaps, as few sequences as plain best fit, every id of every text."""
    data = "/root/testdata/sf0.001"
    rows = packing.op7_best_fit_packing(spark, data).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        assert [o for o, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]] and sum(n for _, n in spans) <= packing.CAPACITY
    assert len(bins) == plain_bins([r["length"] for r in rows], packing.CAPACITY)
    starts = defaultdict(list)
    for r in rows:
        starts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for pieces in starts.values():
        assert sorted(pieces) == [(k, k * packing.CAPACITY, n) for k, (_, _, n) in enumerate(sorted(pieces))]


def test_sentencepiece_query_digests(spark):
    data = "/root/testdata/sf0.001"
    model = piece_table.piece_table(piece_table.model_path()).model
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in piece_table.op10_sentencepiece(spark, data).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = model.encode(r["text"] or "", add_eos=True)
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))


def test_sentencepiece_of_repeated_rows_and_none(spark):
    twice = spark.createDataFrame([(1, "one", "x"), (1, "one", "x")], "doc_id long, text string, decoded string")
    assert [r["decoded"] for r in piece_table.encode_decode(twice).collect()] == ["one", "one"]
    assert piece_table.encode_decode(twice.limit(0)).collect() == []


def test_sentencepiece_is_the_librarys(docs):
    model = piece_table.piece_table(piece_table.model_path()).model
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in piece_table.encode_decode(docs).collect()}
    for i, t in enumerate(texts()):
        ids = model.encode(t or "", add_eos=True)
        assert got[i] == (ids, model.decode(ids)), t


def test_sentencepiece_on_documents(spark):
    model = piece_table.piece_table(piece_table.model_path()).model
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in piece_table.encode_decode(docs).collect()}
    assert got == {r["doc_id"]: model.encode(r["text"], add_eos=True) for r in docs.collect()}
    assert piece_table.op10_sentencepiece(spark, "/root/testdata/sf0.001").count() == len(got)


def test_decode_of_any_ids():
    pieces = piece_table.piece_table(piece_table.model_path())
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(np.array(ids, np.int64)) == pieces.model.decode(ids)
