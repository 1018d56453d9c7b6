"""Kindle books (MOBI, AZW): records of a Palm database, three compressions."""

from __future__ import annotations

import re
import struct
from itertools import pairwise

from textloom.sources.markup import add_html, parse
from textloom.sources.model import Document, ReadError
from textloom.sources.readers.plain import windows_1252

STORED, PALMDOC, HUFFMAN = 1, 2, 17480


def _u16(data: bytes, at: int) -> int:
    return struct.unpack_from(">H", data, at)[0]


def _u32(data: bytes, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]


def records(data: bytes) -> list[bytes]:
    starts = [_u32(data, 78 + 8 * i) for i in range(_u16(data, 76))]
    return [data[a:b] for a, b in pairwise([*starts, len(data)])]


def inflate_palmdoc(data: bytes) -> bytes:
    """Literals, short runs of literals, back references of 3 to 10 bytes, and a space joined to a letter."""
    out, at = bytearray(), 0
    while at < len(data):
        code = data[at]
        at += 1
        if 1 <= code <= 8:
            out += data[at : at + code]
            at += code
        elif code < 0x80:
            out.append(code)
        elif code >= 0xC0:
            out += bytes((0x20, code ^ 0x80))
        else:
            pair = code << 8 | (data[at] if at < len(data) else 0)
            at += 1
            back, size = (pair & 0x3FFF) >> 3, (pair & 7) + 3
            for _ in range(size):
                out.append(out[-back] if 0 < back <= len(out) else 0)
    return bytes(out)


class Huffman:
    """Codes of up to 32 bits for phrases, which may be compressed themselves."""

    def __init__(self, parts: list[bytes]):
        head = parts[0]
        if head[:4] != b"HUFF":
            raise ReadError("kindleCompression", str(HUFFMAN))
        short, long = _u32(head, 8), _u32(head, 12)
        #: For each first byte: length, whether it is final, and the largest code of that length, in 32 bits.
        self.first = []
        for value in struct.unpack_from(">256I", head, short):
            size = value & 31
            self.first.append((size, bool(value & 0x80), ((value >> 8) + 1 << 32 - size) - 1 if size else 0))
        bounds = struct.unpack_from(">64I", head, long)
        self.least = [0] + [bounds[2 * i] << 31 - i for i in range(32)]
        self.most = [0] + [(bounds[2 * i + 1] + 1 << 31 - i) - 1 for i in range(32)]
        self.phrases: list[tuple[bytes, bool]] = []
        for part in parts[1:]:
            if part[:4] == b"CDIC":
                total, bits = _u32(part, 8), _u32(part, 12)
                for i in range(min(1 << bits, total - len(self.phrases))):
                    at = 16 + _u16(part, 16 + 2 * i)
                    size = _u16(part, at)
                    self.phrases.append((part[at + 2 : at + 2 + (size & 0x7FFF)], bool(size & 0x8000)))

    def inflate(self, data: bytes, depth: int = 0) -> bytes:
        if depth > 32:
            return b""
        out, total, at = [], 8 * len(data), 0
        bits = int.from_bytes(data + bytes(8), "big")
        whole = total + 64
        while True:
            code = bits >> whole - at - 32 & 0xFFFFFFFF
            size, final, most = self.first[code >> 24]
            if not final:
                while size < 32 and code < self.least[size]:
                    size += 1
                most = self.most[size]
            at += size
            index = most - code >> 32 - size
            if at > total or not size or index >= len(self.phrases):
                return b"".join(out)
            phrase, plain = self.phrases[index]
            if not plain:
                self.phrases[index] = (b"", True)
                phrase = self.inflate(phrase, depth + 1)
                self.phrases[index] = (phrase, True)
            out.append(phrase)


def trailing(record: bytes, flags: int) -> int:
    """Bytes of entries behind a record's text: each ends in its own size, seven bits a byte from behind."""
    cut = 0
    for _ in range((flags >> 1).bit_count()):
        size = shift = 0
        for byte in reversed(record[max(0, len(record) - cut - 4) : len(record) - cut]):
            size |= (byte & 0x7F) << shift
            shift += 7
            if byte & 0x80:
                break
        cut += size
    if flags & 1 and cut < len(record):
        cut += (record[len(record) - cut - 1] & 3) + 1
    return cut


def book_html(parts: list[bytes]) -> str:
    """The text of the first book in a file; a combined file repeats it in a second one."""
    head = parts[0]
    if _u16(head, 12):
        raise ReadError("kindleDrm")
    mobi = head[16:20] == b"MOBI"
    size, encoding, version = (_u32(head, 20), _u32(head, 28), _u32(head, 36)) if mobi else (0, 1252, 0)
    flags = _u16(head, 0xF2) if size >= 0xE4 and len(head) >= 0xF4 else 0
    method = _u16(head, 0)
    if method == HUFFMAN:
        first, count = _u32(head, 0x70), _u32(head, 0x74)
        inflate = Huffman(parts[first : first + count]).inflate
    elif method in (STORED, PALMDOC):
        inflate = inflate_palmdoc if method == PALMDOC else bytes
    else:
        raise ReadError("kindleCompression", str(method))
    data = b"".join(inflate(r[: len(r) - trailing(r, flags)] if flags else r) for r in parts[1 : _u16(head, 8) + 1])
    if version >= 8 and size >= 0xC4:
        at = _u32(head, 0xC0)
        flows = parts[at] if at < len(parts) else b""
        if flows[:4] == b"FDST" and _u32(flows, 8):
            data = data[_u32(flows, 12) : _u32(flows, 16)]
    return data.decode("utf-8", "replace") if encoding == 65001 else windows_1252(data)


def read_kindle(data: bytes) -> Document:
    parts = records(data)
    if not parts:
        raise ReadError("kindleEmpty")
    doc = Document(format_key="mobi")
    add_html(doc, parse(re.sub(r"<\?xml[^>]*>", "", book_html(parts)), html=True))
    return doc
