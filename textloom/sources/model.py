"""Blocks of one document as plain Python, for readers of files; no Spark here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from textloom import constants as C

_SPACES = "\t\n\x0b\f\r \xa0  -     　﻿"
SPACE = re.compile(f"[{_SPACES}]+")
_DELETED = re.compile("[\xad​-‍⁠﻿￼�\x00-\x08\x0e-\x1f]")


def normalized(text: str) -> str:
    return SPACE.sub(" ", _DELETED.sub("", text)).strip(" ")


def trimmed(text: str) -> str:
    return re.sub(f"^[{_SPACES}]+|[{_SPACES}]+\\Z", "", text)


class ReadError(Exception):
    """A file that can't be read, as a code and a detail; becomes a column, never a failed job."""

    def __init__(self, code: str, detail: str = ""):
        assert code in C.ERRORS, code
        super().__init__(code, detail)
        self.code, self.detail = code, detail


@dataclass
class Block:
    t: str
    k: str = "p"
    r: str | None = None
    s: int = 0


@dataclass
class Document:
    """Blocks in order; sections count up and are never empty; each warning appears once."""

    blocks: list[Block] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    section: int = 0
    heuristics: bool = True
    format_key: str = ""

    def add(self, text: str, kind: str = "p", role: str | None = None) -> None:
        if text := normalized(text):
            self.blocks.append(Block(text, kind, role, self.section))

    def new_section(self) -> None:
        if self.blocks and self.blocks[-1].s == self.section:
            self.section += 1

    def warn(self, code: str) -> None:
        if code not in self.warnings:
            self.warnings.append(code)


def add_text(doc: Document, text: str) -> None:
    """Plain text: pages at form feeds; paragraphs where blank lines part them, else lines."""
    for page in re.sub("\r\n?", "\n", text).split("\f"):
        lines = [trimmed(line) for line in page.split("\n")]
        blank = lines.count("")
        if len(lines) > blank >= max(2, 0.08 * (len(lines) - blank)):
            for paragraph in re.split("\n\n+", "\n".join(lines)):
                doc.add(paragraph)
        else:
            for line in lines:
                doc.add(line)
        doc.new_section()
