"""Text of PDF pages with its places: fonts with their encodings and widths, and the operators that set text."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, replace
from html.entities import name2codepoint

from textloom.sources.readers.pdf_objects import Name, Objects, PdfFile, Stream, Word

# Widths of the characters from space to ~ in two standard fonts, in thousandths; glyphs that HTML names otherwise or not at all.
HELVETICA = """278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
    1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
    333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"""
TIMES = """250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444
    921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500
    333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"""
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*",
    "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";",
    "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}",
    "asciitilde": "~", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "quotesinglbase": "‚", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "endash": "–", "emdash": "—",
    "bullet": "•", "ellipsis": "…", "periodcentered": "·", "exclamdown": "¡", "questiondown": "¿", "germandbls": "ß", "dotlessi": "ı", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "nbspace": " ", "sfthyphen": "\xad",
    "registered": "®", "copyright": "©", "trademark": "™", "section": "§", "paragraph": "¶", "degree": "°", "Euro": "€", "sterling": "£", "minus": "−", "Lslash": "Ł", "lslash": "ł", "dagger": "†", "daggerdbl": "‡", "fraction": "⁄",
}
#: Standard encoding where it differs from ASCII.
STANDARD = {0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA3: "£", 0xA4: "⁄", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "fi", 0xAF: "fl", 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBF: "¿", 0xD0: "—", 0xE1: "Æ", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
#: Forms within forms.
DEEPEST = 12


@dataclass
class Item:
    text: str
    x: float
    y: float
    size: float
    width: float = 0.0
    eol: bool = False


def glyph(name: str) -> str:
    """The text of a glyph by its name; none if the name says nothing."""
    base = name.split(".")[0]
    if base in GLYPHS:
        return GLYPHS[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base):
        codes = [m[1][i : i + 4] for i in range(0, len(m[1]), 4)] if m[1] else [m[2]]
        return "".join(chr(int(c, 16)) for c in codes if int(c, 16) <= 0x10FFFF and not 0xD800 <= int(c, 16) < 0xE000)
    if base in name2codepoint:
        return chr(name2codepoint[base])
    if m := re.fullmatch(r"([A-Za-z])(grave|acute|circumflex|tilde|dieresis|ring|cedilla|caron|macron|breve|ogonek|dotaccent|hungarumlaut)", base):
        mark = {"circumflex": "̂", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋", "grave": "̀", "acute": "́", "tilde": "̃"}[m[2]]
        return unicodedata.normalize("NFC", m[1] + mark)
    return ""


def _utf16(data: bytes) -> str:
    return data.decode("utf-16-be", "ignore")


def to_unicode(data: bytes) -> dict[int, str]:
    """The characters that codes stand for, from a character map's single codes and ranges."""
    out: dict[int, str] = {}
    number = lambda b: int.from_bytes(b, "big")
    block: list = []
    for found in Objects(data, refs=False):
        if not isinstance(found, Word):
            block.append(found)
            continue
        if found == "endbfchar":
            out |= {number(a): _utf16(b) for a, b in zip(block[::2], block[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif found == "endbfrange":
            for lo, hi, to in zip(block[::3], block[1::3], block[2::3]):
                if isinstance(lo, bytes) and isinstance(hi, bytes):
                    many = min(number(hi) - number(lo), 0xFFFF) + 1
                    if isinstance(to, list):
                        out |= {number(lo) + i: _utf16(b) for i, b in enumerate(to[:many]) if isinstance(b, bytes)}
                    elif isinstance(to, bytes) and len(to) > 1:
                        out |= {number(lo) + i: _utf16(to[:-2] + (number(to[-2:]) + i & 0xFFFF).to_bytes(2, "big")) for i in range(many)}
        block = []
    return out


class Font:
    """How codes of a font become text and widths (in thousandths of its size)."""

    def __init__(self, file: PdfFile, info):
        get = file.get
        self.wide = get(info, "Subtype") == "Type0"
        self.map = to_unicode(file.bytes_of(get(info, "ToUnicode")))
        self.widths: dict[int, float] = {}
        self.scale = 1.0
        base = str(get(info, "BaseFont") or "")
        if self.wide:
            below = get((get(info, "DescendantFonts") or [None])[0])
            self.default = get(below, "DW")
            self.default = 1000 if self.default is None else self.default
            self._cid_widths([get(x) for x in get(below, "W") or []], get)
            return
        first, widths = get(info, "FirstChar") or 0, get(info, "Widths")
        if get(info, "Subtype") == "Type3":
            matrix = get(info, "FontMatrix") or [0.001]
            self.scale = abs(get(matrix[0])) * 1000
        descriptor = get(info, "FontDescriptor")
        self.default = get(descriptor, "MissingWidth") or 0
        if isinstance(widths, list):
            self.widths = {first + i: get(w) for i, w in enumerate(widths)}
        else:
            known = TIMES if "Times" in base else HELVETICA
            self.widths = dict.fromkeys(range(32, 127), 600) if "Courier" in base else dict(enumerate(map(int, known.split()), 32))
            self.default = 600 if "Courier" in base else 556
        self.names = self._encoding(get(info, "Encoding"), get, symbolic=bool((get(descriptor, "Flags") or 0) & 4))

    def _cid_widths(self, items: list, get) -> None:
        at = 0
        while at + 1 < len(items):
            if isinstance(items[at + 1], list):
                self.widths |= {items[at] + i: get(w) for i, w in enumerate(items[at + 1])}
                at += 2
            else:
                if at + 2 < len(items):
                    self.widths |= dict.fromkeys(range(items[at], min(items[at + 1], 0xFFFF) + 1), items[at + 2])
                at += 3

    def _encoding(self, encoding, get, symbolic: bool) -> dict[int, str]:
        name = encoding if isinstance(encoding, Name) else get(encoding, "BaseEncoding")
        table = {"MacRomanEncoding": "mac_roman", "WinAnsiEncoding": "cp1252"}.get(name)
        out = {c: bytes([c]).decode(table or ("latin-1" if symbolic else "cp1252"), "ignore") for c in range(256)}
        if not table and not symbolic:
            out |= STANDARD
        code = 0
        for item in get(encoding, "Differences") or [] if isinstance(encoding, dict) else []:
            item = get(item)
            if isinstance(item, Name):
                out[code] = glyph(item)
                code += 1
            elif isinstance(item, int):
                code = item
        return out

    def read(self, data: bytes):
        """(text, width, whether it is the single byte of a space) of each code."""
        step = 2 if self.wide else 1
        for i in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[i : i + step], "big")
            text = self.map.get(code)
            if text is None:
                text = (chr(code) if not 0xD800 <= code < 0xE000 else "") if self.wide else self.names[code]
            width = self.widths.get(code, self.default)
            yield text, (width if isinstance(width, (int, float)) else 0) * self.scale, not self.wide and code == 32


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


@dataclass(frozen=True)
class State:
    """What ``q`` keeps and ``Q`` brings back."""

    matrix: tuple = (1, 0, 0, 1, 0, 0)
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


class PageText:
    """Runs the content of one page and gathers items of text where they are set."""

    def __init__(self, file: PdfFile, fonts: dict):
        self.file, self.fonts, self.items = file, fonts, []
        self.state, self.kept = State(), []
        self.line = self.place = (1, 0, 0, 1, 0, 0)

    def run(self, content: bytes, resources, depth: int = 0) -> None:
        reader, operands = Objects(content, refs=False), []
        floor = len(self.kept)
        for found in reader:
            if not isinstance(found, Word):
                operands.append(found)
                continue
            if found == "ID":  # the data of an inline image
                end = re.compile(rb"[\s]EI(?=[\s]|\Z)").search(content, reader.at)
                reader.at = end.end() if end else len(content)
            elif found == "Do":
                self._form(operands, resources, depth)
            elif found == "Tf":
                self._font(operands, resources)
            elif found != "Q" or len(self.kept) > floor:
                try:
                    self._operate(found, operands)
                except (IndexError, TypeError, ValueError):
                    pass  # operands are missing or of another kind: the operator does nothing
            operands = []
        self.kept, self.state = self.kept[:floor], self.kept[floor] if len(self.kept) > floor else self.state

    def _form(self, operands: list, resources, depth: int) -> None:
        form = self.file.get(self.file.get(resources, "XObject"), operands[-1]) if operands else None
        if isinstance(form, Stream) and self.file.get(form, "Subtype") == "Form" and depth < DEEPEST:
            before = self.state
            matrix = self.file.get(form, "Matrix")
            if isinstance(matrix, list) and len(matrix) == 6:
                self.state = replace(before, matrix=_times(tuple(map(self.file.get, matrix)), before.matrix))
            self.run(self.file.bytes_of(form), self.file.get(form, "Resources") or resources, depth + 1)
            self.state = before

    def _font(self, operands: list, resources) -> None:
        if len(operands) < 2 or not isinstance(operands[1], (int, float)):
            return
        ref = (self.file.get(resources, "Font") or {}).get(operands[0])
        key = ref if isinstance(ref, tuple) else id(ref)
        if key not in self.fonts:
            self.fonts[key] = Font(self.file, self.file.get(ref))
        self.state = replace(self.state, font=self.fonts[key], size=operands[1])

    def _operate(self, name: str, x: list) -> None:
        match name:
            case "q":
                self.kept.append(self.state)
            case "Q":
                self.state = self.kept.pop()
            case "cm":
                self.state = replace(self.state, matrix=_times(tuple(x[:6]), self.state.matrix))
            case "BT":
                self.line = self.place = (1, 0, 0, 1, 0, 0)
            case "Tc" | "Tw" | "TL" | "Ts":
                self.state = replace(self.state, **{{"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise"}[name]: x[0] + 0.0})
            case "Tz":
                self.state = replace(self.state, stretch=x[0] / 100)
            case "Td" | "TD":
                if name == "TD":
                    self.state = replace(self.state, leading=-x[1])
                self._next_line(x[0], x[1])
            case "Tm":
                self.line = self.place = tuple(v + 0.0 for v in x[:6])
                if len(self.line) < 6:
                    raise ValueError("a matrix has six numbers")
            case "T*":
                self._next_line(0, -self.state.leading)
            case "Tj":
                self._show(x[0])
            case "'" | '"':
                if name == '"':
                    self.state = replace(self.state, word=x[0] + 0.0, char=x[1] + 0.0)
                self._next_line(0, -self.state.leading)
                self._show(x[-1])
            case "TJ":
                for part in x[0]:
                    if isinstance(part, bytes):
                        self._show(part)
                    elif isinstance(part, (int, float)):
                        self._move(-part / 1000 * self.state.size * self.state.stretch)

    def _next_line(self, x: float, y: float) -> None:
        self.line = self.place = _times((1, 0, 0, 1, x, y), self.line)

    def _move(self, x: float) -> None:
        self.place = _times((1, 0, 0, 1, x, 0), self.place)

    def _show(self, data: bytes) -> None:
        s = self.state
        if s.font is None:
            return
        codes = list(s.font.read(data))
        advance = sum((width / 1000 * s.size + s.char + (s.word if blank else 0)) * s.stretch for _, width, blank in codes)
        whole = _times(_times((1, 0, 0, 1, 0, s.rise), self.place), s.matrix)
        text = unicodedata.normalize("NFC", "".join(t for t, _, _ in codes)).translate({c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)})
        if text:
            self.items.append(Item(text, whole[4], whole[5], abs(s.size) * math.hypot(whole[2], whole[3]), abs(advance) * math.hypot(whole[0], whole[1])))
        self._move(advance)


def page_items(data: bytes) -> list[list[Item]]:
    """The items of text of each page of a file, in the order in which they are set."""
    file = PdfFile(data)
    pages, fonts = file.pages(), {}
    out = []
    for page in pages:
        text = PageText(file, fonts)
        contents = file.get(page.get("Contents"))
        parts = [file.bytes_of(file.get(c)) for c in (contents if isinstance(contents, list) else [contents])]
        text.run(b"\n".join(parts), file.get(page.get("Resources")))
        out.append(text.items)
    return out
