"""The word kernel: words, hashes of words and of sequences, cut anywhere."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import words as W
from textloom.llm.common import raw, slices

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aA \t\n\x0b\x1cé😀\u00a0b", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.booleans())
def test_words_and_windows(texts, lower):
    words = W.Words(pa.array(texts, pa.string()), lower=lower)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    if lower:
        want = [[re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in row] for row in want]
    assert words.count.tolist() == [len(r) for r in want]
    flat = [w for row in want for w in row]
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, words.hash.tolist())) and len(set(known.values())) == len(known)
    whole, fits = words.windows(3)
    seen = {}
    at = 0
    for row in want:
        for i in range(len(row)):
            assert fits[at] == (i + 3 <= len(row))
            if fits[at]:
                assert seen.setdefault(tuple(row[i : i + 3]), whole[at]) == whole[at]
            at += 1
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_matter(monkeypatch):
    array = pa.array(["word " * 50 + "x" * 300, "", "y z"])
    whole = W.Words(array).hash
    monkeypatch.setattr(W, "_BLOCK", 64)
    assert (W.Words(array).hash == whole).all()


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 50, None, "", "b" * 5, "c"])})
    assert pa.Table.from_batches(list(slices([batch, batch.slice(0, 0)], "text", 20))).column(0).to_pylist() == batch.column(0).to_pylist()
    data, offsets = raw(batch.column(0).slice(1, 3))
    assert data.tobytes() == b"bbbbb" and offsets.tolist() == [0, 0, 0, 5] and offsets.dtype == np.int64


def test_long_sequences_of_two_words_stay_apart():
    """Thue-Morse sequences, for which any polynomial hash modulo 2**64 is the same."""
    one = ["ab"[i.bit_count() % 2] for i in range(4096)]
    other = ["ba"[i.bit_count() % 2] for i in range(4096)]
    ca, cb = W.Words(pa.array([" ".join(one), " ".join(other), "".join(one), "".join(other), " ".join(one)])).sequences()
    assert len(set(ca.tolist())) == len(set(cb.tolist())) == 4 and ca[0] == ca[4] and cb[0] == cb[4]
