"""Rich Text Format."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from textloom.sources.model import Document

# Destinations without text, words that stand for characters, code pages.
SILENT = frozenset("""fonttbl colortbl info pict object header footer headerl headerr headerf footerl footerr footerf footnote annotation
    listtable listoverridetable revtbl rsidtbl xmlnstbl themedata colorschememapping latentstyles datastore generator filetbl pgdsctbl
    nonshppict shp shpinst docvar private userprops operator author title subject comment company listtext pntext pntxta pntxtb bkmkstart
    bkmkend xe tc atnid atnauthor mmathPr background oldcprops oldpprops oldsprops oldtprops protusertbl wgrffmtfilter fchars lchars""".split())
CHARACTERS = {"tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " ", "qmspace": " ", "cell": " ", "nestcell": " ", "zwj": "", "zwnj": "", "ltrmark": "", "rtlmark": ""}
CODE_PAGES = {932: "shift_jis", 936: "gbk", 949: "euc_kr", 950: "big5", 10000: "mac_roman", 65001: "utf-8", 437: "cp866"}
HEADING_STYLE = re.compile(r"heading\s*\d|title|subtitle|t[ií]tulo|titre|[uü]berschrift", re.I)
TOC_STYLE = re.compile(r"toc\s*\d|toc heading|table of contents", re.I)
INDEX_STYLE = re.compile(r"index\s*\d|index heading", re.I)

_TOKEN = re.compile(rb"\\'(?P<hex>[0-9A-Fa-f]{2})|\\(?P<word>[A-Za-z]+)(?P<number>-?[0-9]+)? ?|\\(?P<symbol>[\s\S])|(?P<brace>[{}])|(?P<run>[^\\{}\r\n]+)|[\r\n]+|\\")


@dataclass
class _Group:
    silent: bool = False
    replaced: int = 1  # characters that stand in for a Unicode one
    style: int = 0
    outline: int | None = None
    role: str | None = None
    target: str = "text"  # or "stylesheet", "instruction"
    field: list | None = None
    definition: list | None = None  # of a style: number and name


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.doc = data, Document(format_key="rtf")
        self.styles: dict[int, str] = {}
        self.page = "cp1252"
        self.group, self.outer = _Group(), []
        self.text, self.shape = [], self.group
        self.bytes, self.stand_ins = bytearray(), 0
        self.fresh = self.starred = False

    def put(self, text: str) -> None:
        group = self.group
        if group.silent:
            return
        if group.target == "stylesheet":
            if group.definition:
                group.definition[1] += text
        elif group.target == "instruction":
            group.field[0] += text
        else:
            self.text.append(text)
            self.shape = replace(group)

    def settle(self) -> None:
        """Bytes given one by one make text only together."""
        if self.bytes:
            data, self.bytes = bytes(self.bytes), bytearray()
            self.put(data.decode(self.page, "replace"))

    def paragraph(self) -> None:
        self.settle()
        text, self.text = "".join(self.text), []
        style = self.styles.get(self.shape.style, "")
        heading = HEADING_STYLE.match(style) or self.shape.outline is not None and self.shape.outline < 9
        role = "toc" if TOC_STYLE.match(style) else self.shape.role or ("index" if INDEX_STYLE.match(style) else None)
        self.doc.add(text, "h" if heading else "p", role)

    def open(self) -> None:
        self.settle()
        self.outer.append(self.group)
        self.group = replace(self.group)
        if self.group.target == "stylesheet" and not self.group.definition:
            self.group.definition = [None, ""]
        self.fresh = True

    def close(self) -> None:
        self.settle()
        made, self.stand_ins = self.group.definition, 0
        self.group = self.outer.pop() if self.outer else self.group
        if made and not self.group.definition and made[0] is not None:
            self.styles[made[0]] = made[1].partition(";")[0].strip()

    def word(self, word: str, number: int | None) -> None:
        group, fresh, starred = self.group, self.fresh, self.starred
        self.fresh = self.starred = False
        if starred and not (word == "fldinst" and group.field) or fresh and word in SILENT:
            group.silent = True
        if group.silent:
            return
        if word in ("par", "line", "row"):
            self.paragraph()
        elif word in ("page", "sect"):
            self.paragraph()
            self.doc.new_section()
        elif word == "u" and number is not None:
            self.put(chr(number % 65536))
            self.stand_ins = group.replaced
        elif word in CHARACTERS:
            self.put(CHARACTERS[word])
        elif word == "ansicpg":
            self.code_page(number or 1252)
        elif word == "mac":
            self.code_page(10000)
        elif word == "stylesheet":
            group.target = word
        elif word == "field":
            group.field = [""]
        elif word == "fldinst" and group.field:
            group.target = "instruction"
        elif word == "fldrslt":
            group.target = "text"
            kind = re.match(r"\s*(TOC|INDEX)(?![A-Za-z0-9_])", group.field[0] if group.field else "", re.I)
            group.role = kind[1].lower() if kind else group.role
        elif word == "s" and group.target == "stylesheet":
            if group.definition:
                group.definition[0] = number
        elif word in ("cs", "ds", "ts") and group.definition:
            group.definition[0] = None
        elif word == "s":
            group.style = number or 0
        elif word == "outlinelevel":
            group.outline = number
        elif word == "pard":
            group.style, group.outline = 0, None
        elif word == "uc":
            group.replaced = number if number is not None else 1

    def code_page(self, number: int) -> None:
        name = CODE_PAGES.get(number, f"cp{number}")
        try:
            b"".decode(name)
            self.page = name
        except LookupError:
            self.page = "cp1252"

    def symbol(self, mark: str) -> None:
        self.fresh = False
        if mark == "*":
            self.starred = True
        elif self.stand_ins:
            self.stand_ins -= 1
        elif mark in "\r\n":
            self.paragraph()
        else:
            self.put({"~": " ", "_": "-"}.get(mark, mark if mark in "\\{}" else ""))

    def read(self) -> Document:
        at = 0
        while m := _TOKEN.match(self.data, at):
            at = m.end()
            kind = m.lastgroup if m.lastgroup != "number" else "word"
            if kind == "hex":
                if self.stand_ins:
                    self.stand_ins -= 1
                elif not self.group.silent:
                    self.bytes.append(int(m["hex"], 16))
                continue
            if kind in ("word", "symbol", "brace", "run"):
                self.settle()
            if kind == "word":
                word, number = m["word"].decode(), int(m["number"]) if m["number"] else None
                if word == "bin" and number and number > 0:
                    at += number
                else:
                    self.word(word, number)
            elif kind == "symbol":
                self.symbol(m["symbol"].decode("latin-1"))
            elif kind == "brace":
                self.open() if m["brace"] == b"{" else self.close()
            elif kind == "run":
                self.fresh = False
                run = m["run"].decode("latin-1")
                cut, self.stand_ins = min(self.stand_ins, len(run)), max(0, self.stand_ins - len(run))
                self.put(run[cut:])
        self.paragraph()
        return self.doc


def read_rtf(data: bytes) -> Document:
    return _Reader(data).read()
