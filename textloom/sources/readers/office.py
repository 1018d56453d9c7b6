"""Office documents in ZIP archives: DOCX and ODT."""

from __future__ import annotations

import re

from textloom.sources.archive import Archive
from textloom.sources.markup import Node, parse
from textloom.sources.model import Document

# Names of styles and elements that mark headings, contents and index.
HEADING_STYLE = re.compile(r"(?:heading\s*\d|title|subtitle|t[ií]tulo\s*\d*|titre\s*\d*|[uü]berschrift\s*\d*|kop\s*\d*|titolo\s*\d*)\Z", re.I)
TOC_STYLE = re.compile(r"(?:toc\s*\d|toc heading|table of contents|tdc\s*\d|ti\s*\d|verzeichnis\s*\d|inhaltsverzeichnisüberschrift)\Z", re.I)
INDEX_STYLE = re.compile(r"(?:index\s*\d|index heading)\Z", re.I)
INDEXES = {"text:table-of-content": "toc", "text:illustration-index": "toc", "text:table-index": "toc", "text:object-index": "toc", "text:user-index": "toc", "text:alphabetical-index": "index"}
_NO_TEXT = frozenset("w:deltext w:delinstrtext w:rpr w:ppr mc:fallback w:footnotereference w:endnotereference".split())
_HOLDERS = frozenset("w:tbl w:tr w:tc w:customxml w:smarttag".split())
_NOT_CONTENT = frozenset("text:sequence-decls text:variable-decls text:user-field-decls office:forms table:table-columns text:tracked-changes".split())


def _elements(node: Node):
    return (c for c in node.children if isinstance(c, Node))


def _child(node: Node | None, name: str) -> Node | None:
    return next((c for c in _elements(node) if c.name == name), None) if node else None


def _named(node: Node, name: str) -> Node | None:
    return next((n for n in node.walk() if n.name == name), None)


def _number(node: Node | None) -> int | None:
    value = node.attrs.get("w:val", "") if node else ""
    return int(value) if re.fullmatch(r"-?\d+", value) else None


class _Docx:
    def __init__(self, archive: Archive):
        self.doc = Document(format_key="docx")
        self.fields: list[str | None] = []  # roles of the open fields
        self.styles: dict[str, tuple[str, int | None, str | None]] = {}
        if "word/styles.xml" in archive:
            for style in parse(archive.text("word/styles.xml")).walk():
                if style.name == "w:style":
                    name, based = _named(style, "w:name"), _named(style, "w:basedon")
                    self.styles[style.attrs.get("w:styleid", "")] = (name.attrs.get("w:val", "") if name else "", _number(_named(style, "w:outlinelvl")), based.attrs.get("w:val") if based else None)
        main = "word/document.xml" if "word/document.xml" in archive else next(n for n in archive.names() if re.fullmatch(r"word/document\d*\.xml", n))
        root = parse(archive.text(main))
        self.container(_named(root, "w:body") or root, None)

    def style(self, key: str) -> tuple[str, int | None]:
        """Name and outline level of a style, as far as ten ancestors give them."""
        name, level, at = "", None, key
        for _ in range(10):
            if at not in self.styles:
                break
            own, outline, at = self.styles[at]
            name, level = name or own, outline if level is None else level
        return name or key, level

    def paragraph(self, node: Node, role: str | None) -> None:
        shape = _child(node, "w:ppr")
        name, level = self.style((_child(shape, "w:pstyle") or Node("", {"w:val": "Normal"})).attrs.get("w:val") or "Normal")
        own = _number(_child(shape, "w:outlinelvl"))
        level = level if own is None else own
        kind = "h" if HEADING_STYLE.match(name) or level is not None and 0 <= level < 9 else "p"
        if _child(shape, "w:pagebreakbefore"):
            self.doc.new_section()
        text: list[str] = []

        def emit() -> None:
            found = role or next(filter(None, self.fields), None)
            found = "toc" if TOC_STYLE.match(name) else found or ("index" if INDEX_STYLE.match(name) else None)
            self.doc.add("".join(text), kind, found)
            text.clear()

        stack = [*reversed([*_elements(node)])]
        while stack:
            node_ = stack.pop()
            what = node_.name
            if what == "w:t":
                text.append("".join(c for c in node_.children if isinstance(c, str)))
            elif what in ("w:tab", "w:ptab"):
                text.append("\t")
            elif what in ("w:br", "w:cr"):
                if node_.attrs.get("w:type") == "page":
                    emit()
                    self.doc.new_section()
                else:
                    text.append(" ")
            elif what == "w:nobreakhyphen":
                text.append("-")
            elif what == "w:fldchar":
                step = node_.attrs.get("w:fldchartype")
                if step == "begin":
                    self.fields.append(None)
                elif step == "end" and self.fields:
                    self.fields.pop()
            elif what == "w:instrtext":
                if self.fields and (m := re.match(r"\s*(TOC|INDEX)(?![A-Za-z0-9_])", node_.text(), re.I)):
                    self.fields[-1] = m[1].lower()
            elif what not in _NO_TEXT:
                stack += reversed([*_elements(node_)])
        emit()
        if _child(shape, "w:sectpr"):
            self.doc.new_section()

    def container(self, node: Node, role: str | None) -> None:
        for child in _elements(node):
            if child.name == "w:p":
                self.paragraph(child, role)
            elif child.name == "w:sdt":
                gallery = _named(child, "w:docpartgallery")
                listed = gallery and "table of contents" in gallery.attrs.get("w:val", "").lower()
                if content := _child(child, "w:sdtcontent"):
                    self.container(content, "toc" if listed else role)
            elif child.name in _HOLDERS:
                self.container(child, role)
            elif child.name == "w:sectpr":
                self.doc.new_section()


def read_docx(archive: Archive) -> Document:
    return _Docx(archive).doc


def _inline(node: Node) -> str:
    """Text of a paragraph without notes; text boxes are paragraphs of their own."""
    out: list[str] = []
    stack: list = [*reversed(node.children)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.name == "text:s":
            count = item.attrs.get("text:c", "1")
            out.append(" " * max(1, int(count) if count.isdecimal() else 1))
        elif item.name in ("text:tab", "text:line-break", "draw:frame", "draw:custom-shape"):
            out.append(" ")
        elif item.name not in ("text:note", "office:annotation", "text:bookmark-ref"):
            stack += reversed(item.children)
    return "".join(out)


def read_odt(archive: Archive) -> Document:
    content = parse(archive.text("content.xml"))
    breaks, headings = set(), set()
    shared = [parse(archive.text("styles.xml"))] if "styles.xml" in archive else []
    for source in [content, *shared]:
        for style in source.walk():
            if style.name != "style:style":
                continue
            name = style.attrs.get("style:name", "")
            shape = _named(style, "style:paragraph-properties")
            if shape and "page" in shape.attrs.get("fo:break-before", ""):
                breaks.add(name)
            if any(re.match("heading|title|subtitle", x, re.I) for x in (name, style.attrs.get("style:parent-style-name", ""))):
                headings.add(name)
    doc = Document(format_key="odt")

    def visit(node: Node, role: str | None) -> None:
        for child in _elements(node):
            if child.name in ("text:h", "text:p"):
                style = child.attrs.get("text:style-name", "")
                if style in breaks:
                    doc.new_section()
                doc.add(_inline(child), "h" if child.name == "text:h" or style in headings else "p", role)
                for box in child.walk():
                    if box.name == "draw:text-box":
                        visit(box, role)
            elif child.name in INDEXES:
                visit(_named(child, "text:index-body") or child, INDEXES[child.name])
            elif child.name not in _NOT_CONTENT:
                visit(child, role)

    visit(_named(content, "office:text") or content, None)
    return doc
