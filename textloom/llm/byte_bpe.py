"""Byte-level BPE encoding by contiguous rank arrays, and decoding.

Texts fall into words by the vocabulary's pattern, found for whole batches at once from classes of characters. Words
of one batch that no task of this worker has met before lie side by side in a matrix: a row holds a word's parts, and
beside them the ranks of adjacent parts. Each round finds every row's least rank (the leftmost of equals), joins that
pair by deleting the boundary between, and looks up the ranks of the two neighbours anew; a row with no rank left is
done. Words over ``SHORT`` bytes are rare and would take the square of their length; they keep their boundaries in a
linked list and their ranks in a heap, which gives the same ids.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, raw, resident, slices, table, texts
from .lexicon import Lexicon
from .words import mix, span_hashes

VOCABULARY = "byte_bpe_50k.json"
#: Words up to so many bytes are merged in the matrix.
SHORT = 64
_NONE = np.int32(2**31 - 1)
_ROWS = 4_096
#: Classes of characters.
_LETTER, _NUMBER, _SPACE, _OTHER, _EDGE = 1, 2, 3, 4, 0
#: Apostrophe and letters that the pattern keeps together; fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes(path: str) -> np.ndarray:
    """The class of each code point: letter, number, white space or other, as the library at hand sees it.

    Editions of Unicode differ in which characters are assigned; those that Python's does not know are asked for.
    """
    import regex
    from tokenizers import Tokenizer

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, _OTHER, np.uint8)
    for cls, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            at = np.arange(*found.span())
            out[np.where(at < 0xD800, at, at + 0x800)] = cls
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for cp in np.flatnonzero(out != _OTHER).tolist():
        if unicodedata.category(chr(cp)) == "Cn":
            words = [end for _, (_, end) in split(f"a{chr(cp)}1")]
            out[cp] = _LETTER if words[0] == 2 else _NUMBER if len(words) == 2 else _OTHER
    return out


def _alphabet() -> dict[str, int]:
    """The byte that each character of the vocabulary's alphabet stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizer file: merges by rank, special tokens, bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        letters = _alphabet()
        self.first = np.array([vocab[c] for c in sorted(letters, key=letters.get)], np.int32)
        two = [m if isinstance(m, list) else m.split(" ") for m in merges]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in two], np.int64)
        rank, result = np.arange(len(two), dtype=np.int32), np.array([vocab[a + b] for a, b in two], np.int32)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.result = pairs[order], rank[order], result
        self.known = dict(zip(pairs.tolist(), rank.tolist()))
        self.special = {t["content"].encode(): t["id"] for t in whole["added_tokens"]}
        shown = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} | {i: t for t, i in self.special.items()}
        shown = [shown.get(i, b"") for i in range(max(shown) + 1)]
        self.classes = _classes(path)
        self.size = np.array([len(x) for x in shown], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, or ``_NONE``."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((right >= 0) & (self.pairs[at] == key), self.ranks[at], _NONE)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of two to ``SHORT`` bytes, all at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        parts = np.full((len(words), width + 1), -1, np.int32)
        parts[np.arange(width + 1) < sizes[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width + 1), _NONE, np.int32)
        ranks[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        column = np.arange(width)
        rows = np.arange(len(words))
        while True:
            at = ranks[rows].argmin(1)
            least = ranks[rows, at]
            live = least != _NONE
            rows, at, least = rows[live], at[live], least[live]
            if not len(rows):
                return [row[:n].tolist() for row, n in zip(parts, (parts >= 0).sum(1))]
            parts[rows, at] = self.result[least]
            # The boundary goes: what stands to its right moves up by one.
            source = np.minimum(column + (column > at[:, None]), width)
            parts[rows[:, None], column] = parts[rows[:, None], source]
            ranks[rows[:, None], column] = ranks[rows[:, None], source]
            ranks[rows, at] = self.rank(parts[rows, at], parts[rows, at + 1])
            inner = at > 0
            rows_in, before = rows[inner], at[inner] - 1
            ranks[rows_in, before] = self.rank(parts[rows_in, before], parts[rows_in, before + 1])

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of a word of any length, in time that grows little faster than the word."""
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, result = self.known.get, self.result.tolist()
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 32 | parts[j]) != rank:
                continue  # one of the pair has been joined to another since
            parts[i], parts[j] = result[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := get(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. A special token comes with a zero byte before it, which no word of the pattern mixes with letters."""
        out: list = [None] * len(words)
        short = []
        for i, word in enumerate(words):
            if word[:1] == b"\0" and word[1:] in self.special:
                out[i] = [self.special[word[1:]]]
            elif len(word) == 1:
                out[i] = [int(self.first[word[0]])]
            elif len(word) > SHORT:
                out[i] = self.merge_long(word)
            else:
                short.append(i)
        short.sort(key=lambda i: len(words[i]))
        for lo in range(0, len(short), _ROWS):
            own = short[lo : lo + _ROWS]
            for i, ids in zip(own, self.merge_short([words[i] for i in own])):
                out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return joined(self.bytes, self.at, self.size, np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words begin, over many texts in one buffer, and which of these are special tokens."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = data if len(lead) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(code)
        edge = np.zeros(n + 1, bool)  # where nothing of the other side is seen
        edge[np.searchsorted(lead, offsets)] = True
        special = np.zeros(n + 1, bool)
        inside = np.zeros(n, bool)
        for start, end in self._special_spans(data, offsets):
            i, j = np.searchsorted(lead, (start, end))
            edge[i] = edge[j] = special[i] = inside[i:j] = True
        cls = self.classes[code]
        same = np.zeros(n + 1, bool)
        same[1:n] = cls[1:] == cls[:-1]
        cut = ~same | edge
        # White space that something follows gives up its last character: a space goes with what follows, another stands alone.
        spaces = cls == _SPACE
        last = np.flatnonzero(spaces[:-1] & ~spaces[1:] & ~edge[1:n]) if n else np.zeros(0, np.int64)
        cut[last] = True
        blank = last[code[last] == 0x20]
        cut[blank + 1] = False
        # An apostrophe that begins a word keeps certain letters after it.
        mark = np.flatnonzero((code == 0x27) & cut[:n])
        padded = np.concatenate([code, np.zeros(3, code.dtype)])
        for letters in CONTRACTIONS:
            fits = np.ones(len(mark), bool)
            for k, c in enumerate(letters, 1):
                fits &= (padded[mark + k] == ord(c)) & ~edge[np.minimum(mark + k, n)]
            at = mark[fits]
            cut[at + 1] = False
            cut[at + 1 + len(letters)] = True
        if inside.any():
            cut[:n] &= ~inside | special[:n]
            cut[:n] |= edge[:n]
        starts = np.flatnonzero(cut[:n])
        return lead[starts], special[starts]

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray):
        """(start, end) of the special tokens' strings within texts, from left to right without overlaps."""
        import regex

        if not self.special:
            return
        pattern = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        whole = data.tobytes()
        if not any(s in whole for s in self.special):
            return
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for found in pattern.finditer(whole, lo, hi):
                yield found.span()


@functools.lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    """The vocabulary of a file, read once."""
    return ByteBpe(path)


def _coder(path: str) -> tuple[ByteBpe, Lexicon]:
    bpe = ByteBpe(path)
    return bpe, Lexicon(bpe.encode_words)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row; ``ids`` are little-endian unsigned 32-bit numbers.

    ``decoded`` is the text that decoding these ids gives. Null and empty texts have no ids and decode to an empty
    text. Each row is encoded for itself, so repeated rows and ids stay and ties don't arise; an empty table gives an
    empty result; a null id stays null; other columns, whatever their names, play no part. Long texts stay whole: memory holds one batch near
    3 MB, or the one text that is longer. The string of a special token in a text is that token, as in the library.
    """
    path = path or vocabulary_path()

    def scan(batches):
        key = ("byte ids", path)
        bpe, lexicon = resident(key, lambda: _coder(path))
        for batch in slices(batches, "text", cache=key):
            data, offs = raw(batch.column("text"))
            start, special = bpe.split(data, offs)
            end = np.append(start[1:], len(data))[: len(start)]
            hashes = span_hashes(data, start, end)
            hashes[special] = mix(hashes[special], 99)
            ids, sizes = lexicon.look_up(data, start, end, hashes, special, b"\0")
            total = np.concatenate([[0], np.cumsum(sizes)])
            bounds = total[np.searchsorted(start, offs)]
            ids = ids.astype("<u4")
            rows = [ids[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([bpe.decode(r) for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_tokens long, ids binary, decoded string")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
