"""EPUB books."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

from textloom.sources.archive import Archive
from textloom.sources.markup import Node, add_html, parse
from textloom.sources.model import Document, ReadError

_FONT_METHODS = re.compile(r"idpf\.org/2008/embedding|ns\.adobe\.com/pdf/enc#RC")


def resolve(base: str, href: str) -> str:
    """A reference within the archive, from the member that holds it, without its fragment."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.partition("#")[0])))


def named_role(kind: str | None) -> str | None:
    kind = (kind or "").lower()
    for role, pattern in (("toc", r"\btoc\b|contents|loi|lot"), ("copyright", "copyright|colophon"), ("index", r"\bindex\b")):
        if re.search(pattern, kind, re.A):
            return role
    return None


def refuse_protected(archive: Archive) -> None:
    if "META-INF/rights.xml" in archive:
        raise ReadError("epubAdobeDrm")
    if "META-INF/encryption.xml" not in archive:
        return
    for part in parse(archive.text("META-INF/encryption.xml")).walk():
        if part.local in ("encrypteddata", "encryptedata"):
            method, cipher = part.first("encryptionmethod"), part.first("cipherreference")
            algorithm = (method and method.attr("algorithm")) or ""
            target = (cipher and cipher.attr("uri")) or ""
            if re.search(r"\.(?:x?html?|xml)\Z", target, re.I) and not _FONT_METHODS.search(algorithm):
                raise ReadError("epubDrm")


def _landmarks(nav: Node):
    """Links anywhere below an element of the type landmarks."""
    for part in nav.walk():
        if "landmarks" in part.attrs.get("epub:type", ""):
            yield from part.all("a")


def read_epub(archive: Archive) -> Document:
    refuse_protected(archive)
    roots = parse(archive.text("META-INF/container.xml")).all("rootfile") if "META-INF/container.xml" in archive else []
    package = next((p for r in roots if (p := r.attr("full-path"))), None) or next((n for n in archive.names() if n.lower().endswith(".opf")), None)
    if not package or package not in archive:
        raise ReadError("epubNoOpf")
    opf = parse(archive.text(package))
    items = {i.attr("id"): (resolve(package, i.attr("href") or ""), (i.attr("media-type") or "").lower(), (i.attr("properties") or "").lower().split()) for i in opf.all("item")}
    roles: dict[str, str] = {}

    def mark(base: str, href: str | None, kind: str | None) -> None:
        if href and "#" not in href and (role := named_role(kind)):
            roles[resolve(base, href)] = role

    for reference in opf.all("reference"):
        mark(package, reference.attr("href"), reference.attr("type"))
    for href, _, properties in items.values():
        if "nav" in properties:
            roles[href] = "toc"
            if href in archive:
                for link in _landmarks(parse(archive.text(href), html=True)):
                    mark(href, link.attr("href"), link.attr("epub:type"))
    doc = Document(format_key="epub")
    for reference in opf.all("itemref"):
        href, kind, _ = items.get(reference.attr("idref"), ("", "", []))
        if not re.search("html|xml", kind) or href not in archive:
            continue
        role, name = roles.get(href), posixpath.basename(href).lower()
        guessed = None
        if role is None:
            guessed = "copyright" if re.search("copy-?right|colophon|imprint|legal|rights", name) else "toc" if re.search(r"(?<![a-z])(?:toc|contents)(?![a-z])", name) else None
        tree = parse(archive.text(href), html=True)
        start = len(doc.blocks)
        add_html(doc, tree.first("body") or tree, role or guessed)
        added = doc.blocks[start:]
        if guessed == "copyright" and not re.search("©|copyright|all rights reserved|isbn|derechos", " ".join(b.t for b in added), re.I):
            for block in added:
                block.r = None if block.r == "copyright" else block.r
        doc.new_section()
    return doc
