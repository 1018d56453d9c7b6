"""SentencePiece BPE encoding without a merge queue, by the last token of every prefix, and decoding.

The encoding of a text ends, for each of its prefixes, in one certain token: the vocabulary piece that ends there and
may stand after the last token of what precedes it. An Aho-Corasick automaton gives the pieces that end at a position;
two pieces may stand side by side if merging their joined text gives back just these two. Reading the table of last
tokens backwards from the end yields the ids. No piece holds anything before a space, so a text falls into
independent spans (spaces and what follows them up to the next), each distinct span encoded once per worker.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, lists, raw, resident, slices, table, texts
from .lexicon import Lexicon
from .words import mix, span_hashes

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """The vocabulary of a SentencePiece BPE model with byte fallback and an identity normalizer."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: Characters that no piece consists of stand alone, as bytes; pieces never reach across them.
        self.chars = {p for p in self.ids if len(p) == 1}
        self.beside: dict[int, bool] = {}
        # Decoding: bytes of each id, one after another.
        shown = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def merges(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair again and again, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, before: int, piece: int) -> bool:
        """Whether a piece may follow another, or with -1 stand at the beginning."""
        if len(self.beside) > 1_000_000:
            self.beside.clear()
        two = [self.pieces[i] for i in (before, piece) if i >= 0]
        known = self.beside[before << 20 | piece] = self.merges("".join(two)) == two
        return known

    def _run(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        last, known = [-1] * (len(text) + 1), self.beside.get
        for at, (piece, size) in self.automaton.iter(text):
            at += 1
            if last[at] < 0:
                before = last[at - size]
                fits = known(before << 20 | piece)
                if fits or fits is None and self._stands(before, piece):
                    last[at] = piece
        out, at = [], len(text)
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(self.pieces[piece])
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already the space piece."""
        if self.chars.issuperset(text):
            return self._run(text) if text else []
        out, run = [], 0
        for i, c in enumerate(text):
            if c not in self.chars:
                if run < i:
                    out += self._run(text[run:i])
                out += [self.bytes[b] for b in c.encode()]
                run = i + 1
        return out + (self._run(text[run:]) if run < len(text) else [])

    def encode_spans(self, spans: list[bytes]) -> list[list[int]]:
        return [self.encode(s.decode().replace(" ", SPACE)) for s in spans]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode gives it."""
        data = joined(self.shown, self.shown_at, self.shown_size, ids).tobytes()
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self.model.decode([int(i) for i in ids])
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=1)
def piece_table(path: str) -> PieceTable:
    """The table of a model, built once."""
    return PieceTable(path)


def _coder(path: str) -> tuple[PieceTable, Lexicon]:
    pieces = PieceTable(path)
    return pieces, Lexicon(pieces.encode_spans)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: token ids with the end id, and the text that decoding these ids gives.

    Null texts count as empty: just the end id, decoded to an empty text. Repeated rows are each encoded and stay; an empty
    table gives an empty one; other columns go, whatever their names.
    """
    path = path or model_path()

    def scan(batches):
        key = ("pieces", path)
        pieces, lexicon = resident(key, lambda: _coder(path))
        for batch in slices(batches, "text", cache=key):
            array = pc.replace_substring(batch.column("text"), SPACE, " ")  # both become the space piece
            data, offs = raw(array)
            filled = np.flatnonzero(np.diff(offs))
            space, line = data == 0x20, data == 0x0A
            cut = np.zeros(len(data), bool)
            cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
            cut[:1] = True
            cut[offs[filled]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(data))[: len(start)]
            hashes = span_hashes(data, start, end)
            first = np.zeros(len(start), bool)
            first[np.searchsorted(start, offs[filled])] = True
            hashes[first] = mix(hashes[first], 99)
            ids, sizes = lexicon.look_up(data, start, end, hashes, first, SPACE.encode())
            total = np.concatenate([[0], np.cumsum(sizes)])
            bounds = total[np.searchsorted(start, offs)]
            counts = np.diff(bounds)
            ended = np.insert(ids, bounds[1:], pieces.end).astype(np.int32)
            counts += 1
            ends = np.cumsum(counts)
            decoded = [pieces.decode(ended[e - n : e]) for n, e in zip(counts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ended, counts, pa.int32()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, ids array<int>, decoded string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
