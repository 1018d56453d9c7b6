"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import byte_bpe

SPECIAL = [
    None, "", " ", "  ", "\n", " \n ", "a" * 5000, "=" * 3000, "the" * 900, " " * 700 + "x", "\n" * 90, "0" * 300, "I'll can't 'twas '''s 'S ''re it's't o'clock 'vex 'd",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", " <|endoftext|>  x", "'<|endoftext|>s", "\0<|endoftext|>", "\0", "<|endoftext|", "é É ß İ ſ", "日本語 텍스트 😀👍🏽‍", "a b　 c d\x85e", "x\r\n\r\n  y\t\tz ",
]


def texts():
    rng = random.Random(11)
    alphabet = " \n\t  '''sstrevmlldab  1٢é😀中́=.,_-A<|"
    return SPECIAL + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_bpe.vocabulary_path())


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.byte_bpe(byte_bpe.vocabulary_path())


def test_encoding_is_the_librarys(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts())], "doc_id long, text string, ids string, n_tokens int")
    got = {r["doc_id"]: r for r in byte_bpe.encode_decode(docs).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes() and got[i]["n_tokens"] == len(ids), t
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == (t or ""), t


def test_short_and_long_words_merge_alike(bpe, library):
    rng = random.Random(4)
    words = ["".join(rng.choice("thehenrinatiosé") for _ in range(rng.randint(2, 30))).encode() for _ in range(500)]
    short = bpe.merge_short(words)
    assert short == [bpe.merge_long(w) for w in words] == [library.encode(w.decode()).ids for w in words]


def test_long_words_take_no_square_of_time(bpe):
    assert sum(bpe.size[bpe.merge_long(b"ab=" * 200_000)]) == 600_000


def test_every_class_of_characters(bpe, library):
    split = library.pre_tokenizer.pre_tokenize_str
    for cp in [*range(0x3000), *range(0x10000, 0x11000), *range(0x1C80, 0x1C90), 0xA7CB, 0x1E5F6]:
        text = f"a{chr(cp)}1{chr(cp)}="
        data = np.frombuffer(text.encode(), np.uint8)
        start, _ = bpe.split(data, np.array([0, len(data)]))
        assert [len(data[:s].tobytes().decode()) for s in start] == [at for _, (at, _) in split(text)], hex(cp)


def test_decode_of_any_ids(bpe, library):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257), 50256]) for _ in range(rng.randint(0, 12))]
        assert bpe.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in byte_bpe.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]] == (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_empty_table_and_repeated_rows(spark):
    assert byte_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = byte_bpe.encode_decode(spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"] and rows[0] == rows[1]
