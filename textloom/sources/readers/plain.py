"""Plain text and CSV."""

from __future__ import annotations

import re

from textloom.sources.model import Document, add_text, trimmed


def windows_1252(data: bytes) -> str:
    """Every byte a character; the five that the table leaves open stand for themselves."""
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)


def decode(data: bytes) -> str:
    """Text by its byte-order mark; by zero bytes at every other place; as UTF-8; else as windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    head = data[:4000]
    for name, first in (("utf-16-le", 1), ("utf-16-be", 0)):
        if head[first::2].count(0) > 0.3 * len(head):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return windows_1252(data)


def read_text(data: bytes) -> Document:
    doc = Document(format_key="txt")
    add_text(doc, decode(data))
    return doc


def delimiter_of(text: str) -> str:
    """The delimiter whose counts in the first lines agree best."""
    lines = re.split("\r?\n", text[:20_000])[:20]
    best, top = ",", 0
    for mark in ",;\t|":
        counts = [n for n in (line.count(mark) for line in lines) if n]
        score = 10 * counts.count(counts[0]) + counts[0] if counts else 0
        if score > top:
            best, top = mark, score
    return best


def rows_of(text: str, delimiter: str) -> list[list[str]]:
    """Rows of cells. A quote opens at the beginning of a cell; within quotes a doubled one stands for itself."""
    d = re.escape(delimiter)
    cell = re.compile(rf'(?:"((?:[^"]|"")*+)(?:"|\Z))?([^{d}\r\n]*)({d}|\r\n|\r|\n|\Z)')
    rows, row, at = [], [], 0
    while at <= len(text):
        m = cell.match(text, at)
        row.append((m[1] or "").replace('""', '"') + m[2])
        if m[3] != delimiter:
            rows.append(row)
            row = []
            if m.end() == len(text):
                break
        at = m.end()
    return rows


def read_csv(data: bytes, tabs: bool = False) -> Document:
    text = decode(data)
    doc = Document(format_key="csv", heuristics=False)
    for row in rows_of(text, "\t" if tabs else delimiter_of(text)):
        doc.add(" ".join(filter(None, map(trimmed, row))))
    return doc
