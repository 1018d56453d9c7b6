"""Word 97 documents: streams of a compound file, a piece table, fields."""

from __future__ import annotations

import re
import struct

from textloom.sources.model import Document, ReadError

_LAST_SECTOR = 0xFFFFFFF0  # sector numbers from here on end a chain


class CompoundFile:
    """Named streams in chains of sectors; short ones in a stream of small sectors."""

    def __init__(self, data: bytes):
        self.data = data
        shift, small = struct.unpack_from("<HH", data, 0x1E)
        self.size, self.small = 1 << shift, 1 << small
        tables, directory = struct.unpack_from("<II", data, 0x2C)
        self.cutoff, small_table, _, more = struct.unpack_from("<IIII", data, 0x38)
        numbers = list(struct.unpack_from("<109I", data, 0x4C))
        seen = set()
        while more < _LAST_SECTOR and more not in seen and len(numbers) < tables:
            seen.add(more)
            *found, more = self._numbers(self._sector(more))
            numbers += found
        self.table = [n for s in numbers[:tables] if s < _LAST_SECTOR for n in self._numbers(self._sector(s))]
        self.entries = {}
        listing = self._chain(directory)
        for at in range(0, len(listing) - 127, 128):
            entry = listing[at : at + 128]
            length, kind = struct.unpack_from("<HB", entry, 0x40)
            start, size = struct.unpack_from("<II", entry, 0x74)
            name = entry[: max(0, length - 2)].decode("utf-16-le", "replace").lower()
            self.entries.setdefault(name if kind == 2 else (kind, name), (start, size))
        root = next(((s, n) for key, (s, n) in self.entries.items() if isinstance(key, tuple) and key[0] == 5), None)
        self.short = self._chain(root[0])[: root[1]] if root else b""
        self.short_table = self._numbers(self._chain(small_table))

    @staticmethod
    def _numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])

    def _sector(self, number: int) -> bytes:
        return self.data[(number + 1) * self.size : (number + 2) * self.size]

    @staticmethod
    def _follow(table, number: int):
        for _ in range(len(table) + 1):
            if number >= len(table):
                return
            yield number
            number = table[number]

    def _chain(self, number: int) -> bytes:
        return b"".join(map(self._sector, self._follow(self.table, number)))

    def stream(self, name: str) -> bytes | None:
        if name.lower() not in self.entries:
            return None
        start, size = self.entries[name.lower()]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        return b"".join(self.short[i * self.small : (i + 1) * self.small] for i in self._follow(self.short_table, start))[:size]


def _pieces(word: bytes, table: bytes) -> str:
    """The text, gathered from the pieces that a table lists, in one or two bytes a character."""
    limit = struct.unpack_from("<I", word, 0x4C)[0]
    at, size = struct.unpack_from("<II", word, 0x1A2)
    end = at + size
    while at < end and table[at] == 1:
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= len(table) or table[at] != 2:
        raise ReadError("docDamaged")
    count = (struct.unpack_from("<I", table, at + 1)[0] - 4) // 12
    edges = struct.unpack_from(f"<{count + 1}I", table, at + 5)
    out = []
    for i in range(count):
        place = struct.unpack_from("<I", table, at + 5 + 4 * (count + 1) + 8 * i + 2)[0]
        start, many = place & 0x3FFFFFFF, edges[i + 1] - edges[i]
        if place & 0x40000000:
            out.append(word[start // 2 : start // 2 + many].decode("cp1252", "replace"))
        else:
            out.append(word[start : start + 2 * many].decode("utf-16-le", "replace"))
    return "".join(out)[:limit]


_PART = re.compile("[\x13\x14\x15]|[\r\x07\x0b\x0c]|[^\x13\x14\x15\r\x07\x0b\x0c]+")
_PRINTED = str.maketrans({"\x1e": "-", **{chr(c): None for c in range(32) if c not in (9, 10, 13, 0x1E)}})


def read_doc(data: bytes) -> Document:
    try:
        file = CompoundFile(data)
    except (struct.error, IndexError, ValueError) as error:
        raise ReadError("docDamaged") from error
    word = file.stream("WordDocument")
    if word is None or len(word) < 0x1AA:
        raise ReadError("docPassword" if word is None and file.stream("EncryptedPackage") is not None else "docNotWord")
    magic, version, flags = struct.unpack_from("<HH6xH", word)
    if magic != 0xA5EC:
        raise ReadError("docNotWord")
    if flags & 0x100:
        raise ReadError("docPassword")
    if version < 0xC1:
        raise ReadError("docTooOld")
    table = file.stream("1Table" if flags & 0x200 else "0Table")
    if table is None:
        raise ReadError("docDamaged")
    try:
        text = _pieces(word, table)
    except (struct.error, IndexError) as error:
        raise ReadError("docDamaged") from error
    doc = Document(format_key="doc")
    fields: list[list] = []  # [instruction, still in the instruction, role]
    line: list[str] = []
    role = None

    def flush() -> None:
        doc.add("".join(line), "p", role)
        line.clear()

    def outermost() -> str | None:
        return next((f[2] for f in fields if f[2]), None)

    for part in _PART.findall(text):
        if part == "\x13":
            fields.append(["", True, None])
        elif part == "\x14":
            if fields:
                fields[-1][1] = False
                kind = re.match(r"\s*(TOC|INDEX)(?![A-Za-z0-9_])", fields[-1][0], re.I)
                fields[-1][2] = kind[1].lower() if kind else None
                role = outermost()
        elif part == "\x15":
            if fields:
                fields.pop()
            if outermost() != role:
                flush()
                role = outermost()
        elif fields and fields[-1][1]:
            fields[-1][0] += part
        elif part in "\r\x07\x0b\x0c":
            flush()
            if part == "\x0c":
                doc.new_section()
        else:
            line.append(part.translate(_PRINTED))
    flush()
    return doc
