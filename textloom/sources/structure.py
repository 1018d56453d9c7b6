"""Headings, contents, index and copyright page of a document, from its blocks."""

from __future__ import annotations

import re
from itertools import accumulate, pairwise

from textloom import constants as C
from textloom.sources.model import Block, Document

_RUN = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")


def _pattern(text: str) -> re.Pattern:
    return re.compile(C.ascii_bounds(text).replace("$", r"\Z"), re.I)


CHAPTER, TOC, INDEX = (_pattern(x) for x in (C.CHAPTER + r"\b", C.TOC_TITLE, C.INDEX_TITLE))
MARKS = [_pattern(x) for x in C.COPYRIGHT_MARKS]
_STRONG = _pattern("©|copyright|all rights reserved")
_HINT = re.compile(C.COPYRIGHT_HINT, re.I)


def run_count(text: str) -> int:
    return len(_RUN.findall(text))


def utf16(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


def marker_count(text: str) -> int:
    return sum(1 for mark in MARKS if mark.search(text)) if _HINT.search(text) else 0


def looks_like_heading(text: str) -> bool:
    runs = run_count(text[:200])
    if len(text) > 80 or not 0 < runs <= 12 or utf16(text) > 80:
        return False
    if CHAPTER.search(text):
        return text[-1] not in ",;"
    if re.fullmatch(r"[IVXLCDM]{1,7}\.?", text):
        if text not in ("I", "I."):
            return True
    elif re.fullmatch(r"[0-9]{1,3}\.?", text):
        return True
    if len(re.findall("[0-9]", text)) > 2:
        return False
    letters = "".join(c for c in text if c.isalpha())
    if len(letters) < 3 or runs > 8 or letters != letters.upper() or letters == letters.lower():
        return False
    return text[-1] not in ".!?,;:" or bool(re.fullmatch(r"[IVXLCDM0-9]+\.", text))


def entry_key(text: str) -> str:
    """An entry of a table of contents without its leader and page number."""
    text = re.sub(r"[.…·_\s-]{2,}\s*[0-9]+\s*\Z", "", text.lower())
    text = re.sub(r"\s+[0-9]+\s*\Z", "", text)
    return " ".join(_RUN.findall(text))


def _is_entry(text: str, runs: int) -> bool:
    return runs <= 14 or runs <= 25 and bool(re.search(r"(?:\.{2,}|…)\s*[0-9]+\s*\Z|\s[0-9]{1,4}\Z", text))


def _contents_end(blocks: list[Block], title: int) -> int:
    """The last block of the list that follows a title of contents, or the title itself."""
    seen: set[str] = set()
    end = title
    for at in range(title + 1, min(len(blocks), title + 600)):
        block, runs = blocks[at], run_count(blocks[at].t)
        key = entry_key(block.t)
        chapter = block.k == "h" and block.s != blocks[at - 1].s and len(seen) > 2
        if key in seen or not _is_entry(block.t, runs) or chapter:
            break
        seen |= {key} - {""}
        end = at
    return end


def mark_contents(blocks: list[Block]) -> None:
    for at in range(min(len(blocks), max(60, int(len(blocks) * 0.3)))):
        if TOC.search(blocks[at].t) and (end := _contents_end(blocks, at)) - at >= 2:
            for block in blocks[at : end + 1]:
                block.r = "toc"
            return


def mark_headings(blocks: list[Block]) -> None:
    for block in blocks:
        if block.r is None and looks_like_heading(block.t):
            block.k = "h"


def mark_index(blocks: list[Block]) -> None:
    for at in reversed(range(int(len(blocks) * 0.6), len(blocks))):
        if not INDEX.search(blocks[at].t):
            continue
        runs = [run_count(b.t) for b in blocks[at + 1 :]]
        size = next((i for i, n in enumerate(runs) if n > 30), len(runs))
        listed = [b for b, n in zip(blocks[at + 1 : at + 1 + size], runs) if n <= 3 or re.search("[0-9]", b.t)]
        if len(listed) >= 3:
            for block in blocks[at : at + 1 + size]:
                block.r = block.r or "index"
            return


def segments(blocks: list[Block]) -> list[tuple[int, int]]:
    """Stretches (first, end) between changes of section and headings."""
    starts = [i for i, b in enumerate(blocks) if not i or b.k == "h" or b.s != blocks[i - 1].s]
    return list(pairwise([*starts, len(blocks)]))


def mark_copyright(blocks: list[Block]) -> None:
    runs = [run_count(b.t) for b in blocks]
    before = [0, *accumulate(runs)]
    total = before[-1]
    front, back = max(total * 0.25, 1500), total * 0.9
    found = False
    for a, b in segments(blocks):
        if front < before[a] < back or before[b] - before[a] > 700 or any(x.r for x in blocks[a:b]):
            continue
        text = "".join(x.t + "\n" for x in blocks[a:b])
        marks = marker_count(text)
        if marks >= 3 or marks == 2 and _STRONG.search(text):
            found = True
            for block in blocks[a:b]:
                block.r = "copyright"
    if found:
        return
    marked = [(i, m) for i, b in enumerate(blocks) if before[i] <= front and not b.r and runs[i] <= 120 and (m := marker_count(b.t))]
    groups: list[list[tuple[int, int]]] = []
    for at, marks in marked:
        if groups and at - groups[-1][-1][0] <= 3:
            groups[-1].append((at, marks))
        else:
            groups.append([(at, marks)])
    for group in groups:
        a, b = group[0][0], group[-1][0] + 1
        if sum(m for _, m in group) >= 2 and before[b] - before[a] <= 700:
            for block in blocks[a:b]:
                block.r = block.r or "copyright"


def finish(doc: Document) -> Document:
    """Roles that the format didn't give, and a warning for a document without text."""
    roles = {b.r for b in doc.blocks}
    if doc.heuristics:
        if "toc" not in roles:
            mark_contents(doc.blocks)
        if all(b.k != "h" for b in doc.blocks):
            mark_headings(doc.blocks)
        if "index" not in {b.r for b in doc.blocks}:
            mark_index(doc.blocks)
        if "copyright" not in {b.r for b in doc.blocks}:
            mark_copyright(doc.blocks)
    if not doc.blocks:
        doc.warn("noText")
    return doc


def caps(blocks: list[Block]) -> dict[str, bool]:
    roles = {b.r for b in blocks}
    return {"headings": any(b.k == "h" for b in blocks), "copyright": "copyright" in roles, "toc": bool(roles & {"toc", "index"})}
