"""Pages and iBooks Author documents: packed message archives, the older XML, or XHTML parts."""

from __future__ import annotations

import gzip
import re

from textloom.sources.archive import Archive, decode_markup
from textloom.sources.markup import Node, add_html, parse
from textloom.sources.model import Document, ReadError

# Message types that hold text, and kinds of text.
STORAGES = (2001, 2005)
BODY, CONTENTS, OTHER, UNSTATED = 0, 7, (3, 5, 6), 3


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(data):
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            break
    return value, at


def unsnap(data: bytes) -> bytes:
    """A raw Snappy block."""
    size, at = _varint(data, 0)
    out = bytearray()
    while at < len(data) and len(out) < size:
        tag = data[at]
        at += 1
        if not tag & 3:
            length = tag >> 2
            if length >= 60:
                wide = length - 59
                length = int.from_bytes(data[at : at + wide], "little")
                at += wide
            out += data[at : at + length + 1]
            at += length + 1
            continue
        if tag & 3 == 1:
            length, back = (tag >> 2 & 7) + 4, tag >> 5 << 8 | data[at]
            at += 1
        else:
            wide = 2 * (tag & 3) - 2
            length, back = (tag >> 2) + 1, int.from_bytes(data[at : at + wide], "little")
            at += wide
        if not 0 < back <= len(out):
            raise ValueError("bad back reference")
        while length > 0:  # a reference may overlap what it writes
            piece = out[len(out) - back :][:length]
            out += piece
            length -= len(piece)
    return bytes(out[:size])


def unpack(data: bytes) -> bytes:
    """A chunked archive: a type byte, a length of three bytes, a Snappy block or stored bytes."""
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at + 1 : at + 4], "little")
        chunk = data[at + 4 : at + 4 + size]
        out.append(chunk if data[at] else unsnap(chunk))
        at += 4 + size
    return b"".join(out)


def fields(data: bytes):
    """(number, value) of a message's fields: integers and byte strings; fixed-width ones are passed over."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
        elif kind == 2:
            size, at = _varint(data, at)
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            return


def messages(data: bytes):
    """(type, payload) of every message of an archive."""
    at = 0
    while at < len(data):
        size, at = _varint(data, at)
        heads = [dict(reversed(list(fields(v)))) for n, v in fields(data[at : at + size]) if n == 2 and isinstance(v, bytes)]
        at += size
        for head in heads:
            length = head.get(3, 0)
            yield head.get(1), data[at : at + length]
            at += length


def storages(archive: Archive):
    """(kind, text) of every text storage, the document's own archive first."""
    names = [n for n in archive.names() if re.match(r"Index/.*\.iwa\Z", n, re.I)]
    if not names and "Index.zip" in archive:
        archive = Archive(archive.read("Index.zip"))
        names = [n for n in archive.names() if n.lower().endswith(".iwa")]
    for name in sorted(names, key=lambda n: (not n.lower().endswith("document.iwa"), n)):
        try:
            data = unpack(archive.read(name))
        except (ValueError, IndexError, ReadError):
            continue
        for kind, payload in messages(data):
            if kind in STORAGES:
                found = list(fields(payload))
                sort = next((v for n, v in found if n == 1 and isinstance(v, int)), UNSTATED)
                text = "".join(v.decode("utf-8", "replace") for n, v in found if n == 3 and isinstance(v, bytes))
                if text.strip():
                    yield sort, text


def _add_storages(doc: Document, archive: Archive) -> bool:
    found = list(storages(archive))
    body = [t for k, t in found if k == BODY]
    texts = body or [t for k, t in found if k in OTHER]
    if not texts:
        return False
    for role, group in (("toc", [t for k, t in found if k == CONTENTS]), (None, texts)):
        for text in group:
            for paragraph in re.split("[\n\r  \x0b]", text):
                doc.add(paragraph, "p", role)
            doc.new_section()
    if not body:
        doc.warn("iworkNoBody")
    return True


_BREAKS = ("pgbr", "sectbr")


def _paragraph(node: Node) -> str:
    out: list[str] = []
    stack: list = [*reversed(node.children)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.local in ("tab", "br", "lnbr", "crbr", "intratopicbr", *_BREAKS):
            out.append(" ")
        elif item.local not in ("footnote", "annotation-field"):
            stack += reversed(item.children)
    return "".join(out)


def _add_xml(doc: Document, source: str) -> bool:
    """The paragraphs of the older XML, outside of style sheets, metadata, notes and other paragraphs."""
    found, stack = False, [parse(source)]
    while stack:
        node = stack.pop()
        if node.name.startswith("sf:") and node.local == "p":
            style = node.attrs.get("sf:style") or node.attrs.get("sf:para-style") or ""
            doc.add(_paragraph(node), "h" if re.search("head|title|chapter|section", style, re.I) else "p")
            if any(isinstance(c, Node) and c.local in _BREAKS for c in node.children):
                doc.new_section()
            found = True
        elif node.local not in ("stylesheet", "metadata", "footnotes", "p"):
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def read_iwork(archive: Archive, kind: str = "pages") -> Document:
    doc = Document(format_key=kind)
    found = _add_storages(doc, archive)
    if not found:
        parts = [n for n in archive.names() if re.search(r"\.(?:xml|apxl)(?:\.gz)?\Z", n, re.I) and not re.search(r"(?:^|/)(?:META-INF|__MACOSX)/|plist|metadata|buildversion|properties", n, re.I)]
        natural = lambda n: [int(x) if x.isdecimal() else x for x in re.split("([0-9]+)", n.lower())]
        for name in sorted(parts, key=lambda n: (not n.lower().startswith("index.xml"), natural(n))):
            try:
                data = archive.read(name)
                source = decode_markup(gzip.decompress(data) if name.lower().endswith(".gz") else data)
            except (OSError, EOFError, ReadError):
                continue
            if _add_xml(doc, source):
                found = True
                doc.new_section()
    if not found:
        for name in archive.names():
            if re.search(r"\.x?html?\Z", name, re.I):
                add_html(doc, parse(archive.text(name), html=True))
                doc.new_section()
        found = bool(doc.blocks)
    if not found:
        raise ReadError("ibaNoText" if kind == "iba" else "pagesNoText")
    doc.warn("ibaBestEffort" if kind == "iba" else "pagesBestEffort")
    return doc
