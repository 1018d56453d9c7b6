"""PDF: layout of text items into lines and paragraphs.

The layout works on items (text, x, y, size, width, end of line) of each page, as ``pdf_text`` finds them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from textloom.sources.model import SPACE, Document, ReadError
from textloom.sources.readers.pdf_text import Item, page_items

# Fixed values of the layout.
SAME_LINE, WORD_GAP, LINE_GAP, INDENT, HEADING_SIZE, SHORT_LINE = 0.4, 0.15, 1.75, 1.2, 1.25, 0.6


@dataclass
class Line:
    text: str
    x: float
    y: float
    size: float
    end: float
    eol: bool = False
    longest: int = 0
    dropped: bool = False


def lines_of(items: list[Item], sizes: Counter) -> list[Line]:
    """Items that share a base line, with spaces where they stand apart; ``sizes`` counts characters by size."""
    lines: list[Line] = []
    for item in items:
        line = lines[-1] if lines else None
        if item.text:
            size = round(item.size, 1)
            if line is None or line.eol or abs(line.y - item.y) > max(2, size * SAME_LINE):
                line = Line("", item.x, item.y, size, item.x)
                lines.append(line)
            elif item.x - line.end > size * WORD_GAP and line.text[-1:].strip() and item.text[:1].strip():
                line.text += " "
            line.text += item.text
            line.end, line.size = item.x + item.width, max(line.size, size)
            sizes[size] += len(item.text)
        if item.eol and line is not None:
            line.eol = True
    for line in lines:
        line.text = SPACE.sub(" ", line.text).strip(" ")
    lines = [line for line in lines if line.text]
    longest = max((len(line.text) for line in lines), default=0)
    for line in lines:
        line.longest = longest
    return lines


_PAGE_NUMBER = re.compile(r"(?:page\s*)?[-–—]?\s*[0-9]{1,4}\s*[-–—]?|[0-9]+\s*(?:of|/)\s*[0-9]+|page [0-9]+ of [0-9]+", re.I)
_ROMAN = re.compile("[ivxlc]{1,5}", re.I)


def drop_running_lines(pages: list[list[Line]]) -> None:
    """Page numbers, and lines at the edges of pages that come again and again but for their digits."""
    edge = lambda lines: [x for i, x in enumerate(lines) if i < 2 or i >= len(lines) - 2]
    key = lambda line: re.sub("[0-9]+", "#", line.text.lower()).strip()
    often = Counter(key(line) for lines in pages for line in edge(lines))
    enough = max(3, int(len(pages) * 0.3))
    for lines in pages:
        for line in edge(lines):
            outer = line is lines[0] or line is lines[-1]
            line.dropped = bool(_PAGE_NUMBER.fullmatch(line.text)) or len(pages) >= 4 and often[key(line)] >= enough and len(line.text) < 100 or outer and bool(_ROMAN.fullmatch(line.text))


def layout(pages: list[list[Item]]) -> Document:
    sizes: Counter = Counter()
    lined = [lines_of(items, sizes) for items in pages]
    body = max(sizes, key=sizes.get) if sizes else 0  # of sizes with equally many characters the first
    drop_running_lines(lined)
    doc = Document(format_key="pdf")
    for lines in lined:
        text, heading, last = "", False, None
        for line in lines:
            if line.dropped:
                continue
            title = 0 < body * HEADING_SIZE <= line.size and len(line.text) <= 120
            if last is None:
                begins = True
            else:
                down = last.y - line.y
                ended = len(last.text) < SHORT_LINE * last.longest and last.text[-1] in ".!?:\"”’)"
                begins = title != heading or down < -2 or down > LINE_GAP * max(last.size, line.size) or not title and (ended or line.x - last.x > INDENT * line.size)
            if begins:
                doc.add(text, "h" if heading else "p")
                text, heading = line.text, title
            elif text[-1:] == "-" and text[-2:-1].isalpha() and line.text[0].islower():
                text = text[:-1] + line.text
            else:
                text += " " + line.text
            last = line
        doc.add(text, "h" if heading else "p")
        doc.new_section()
    if not doc.blocks:
        doc.warn("pdfNoText")
    return doc


def read_pdf(data: bytes) -> Document:
    try:
        pages = page_items(data)
    except ReadError:
        raise
    except Exception as error:  # whatever a damaged file leads to
        raise ReadError("pdfOpen", str(error)) from error
    if not pages:
        raise ReadError("pdfOpen", "no pages")
    return layout(pages)
