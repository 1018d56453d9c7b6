"""Text columns to ordered blocks (doc, pos, t, k, r, s), without shuffles: a document's blocks form within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions import text as T

_BLANK = f"[{C.SPACE}&&[^\\n]]*+"
_PARTED = rf"[\r\f]|\A{_BLANK}(?:\n|\z)|\n{_BLANK}(?:\n|\z)"
_NORMAL = rf"\A(?![ \n]){C.PLAIN}*+\z(?<![ \n])"
BLOCK = "struct<t:string,k:string,r:string,s:int>"


def page_paragraphs(page: Column) -> Column:
    """Raw block texts of one page: paragraphs if blank lines part them, else lines."""
    lines = F.transform(F.split(page, "\n", -1), T.trimmed)
    return F.aggregate(
        F.array(lines),
        F.expr("cast(array() as array<string>)"),
        lambda _, ls: F.when(_blank_separated(ls), F.split(F.array_join(ls, "\n"), "\n\n+")).otherwise(ls),
    )


def _blank_separated(lines: Column) -> Column:
    blank = F.size(F.filter(lines, lambda x: x == ""))
    filled = F.size(lines) - blank
    return (filled > 0) & (blank >= F.greatest(F.lit(2.0), filled * 0.08))


def text_blocks(text: Column) -> Column:
    """Blocks of a plain text, as an array: pages at form feeds, each a section of its own if it holds anything.

    A text without blank lines, CR and form feeds is one page of lines, found without trimming each; most of these hold nothing to normalise either,
    which one search over the whole text tells.
    """
    lines = F.split(text, "\n", -1)
    blocks = lambda texts: F.transform(F.filter(texts, lambda t: t != ""), lambda t: _block(t, F.lit(0)))
    normal = text.rlike(_NORMAL) & ~(text.contains("  ") | text.contains(" \n") | text.contains("\n ") | text.contains("\n\n"))
    return F.when(normal, blocks(lines)).when(text.rlike(_PARTED), _paged_blocks(text)).otherwise(blocks(F.transform(lines, T.normalized)))


def _block(text: Column, section: Column) -> Column:
    return F.struct(text.alias("t"), F.lit("p").alias("k"), F.lit(None).cast("string").alias("r"), section.alias("s"))


def _paged_blocks(text: Column) -> Column:
    pages = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\f", -1)
    filled = lambda page: F.filter(F.transform(page_paragraphs(page), T.normalized), lambda t: t != "")
    held = F.filter(F.transform(pages, filled), lambda texts: F.size(texts) > 0)
    return F.flatten(F.transform(held, lambda texts, section: F.transform(texts, lambda t: _block(t, section))))


def with_blocks(docs: DataFrame, text_col: str = "text", as_col: str = "blocks") -> DataFrame:
    """``docs`` with an array of blocks; sections count up without gaps, empty blocks are gone."""
    return docs.withColumn(as_col, text_blocks(F.coalesce(F.col(text_col), F.lit(""))))


def exploded(docs: DataFrame, id_col: str = "doc_id", blocks_col: str = "blocks") -> DataFrame:
    """One row per block: id, pos, t, k, r, s.

    The outer form, so that no filter on the array's size is inferred below, which would form the blocks anew.
    """
    return docs.select(id_col, F.posexplode_outer(blocks_col).alias("pos", "b")).where("pos is not null").select(id_col, "pos", "b.*")


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The short way for texts without blank lines and form feeds: a block per line that isn't empty."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), T.normalized), lambda t: t != "")
    return docs.select(id_col, F.posexplode_outer(lines).alias("pos", "t")).where("pos is not null")


def csv_rows(text: Column, delimiter: Column) -> Column:
    """Rows of a CSV text as arrays of cells, trimmed.

    The whole text is read with its quotes: one opens only where a cell begins, may hold delimiters and line breaks, and a doubled quote within stands for
    itself. Quoted parts are matched possessively, without recursion, so long cells cost what they weigh.
    """
    d = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    quoted = F.lit(r'(?:"(?:[^"]++|"")*+(?:"|\z))?+')
    cell = F.concat(quoted, F.lit("[^"), d, F.lit(r"\r\n]*+"))
    row = F.concat(F.lit("(?s)"), cell, F.lit("(?:"), d, cell, F.lit(r")*+(?:\r\n|\r|\n|\z)"))

    def value(found: Column) -> Column:
        inner = F.regexp_extract(found, r'(?s)^"((?:[^"]++|"")*+)', 1)
        rest = found.substr(F.char_length(inner) + 3, F.char_length(found))
        return T.trimmed(F.when(found.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(found))

    return F.transform(F.regexp_extract_all(text, row, F.lit(0)), lambda r: F.transform(F.regexp_extract_all(r, F.concat(F.lit("(?s)"), cell), F.lit(0)), value))


def csv_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delimiter: str | None = None) -> DataFrame:
    """(id, pos, row, t): the rows of CSV texts as blocks, their cells that aren't empty joined by a space.

    ``row`` is the row's number in its text, empty ones counted. Without a ``delimiter`` the first lines of each text tell it. Null and empty texts, and rows without
    a filled cell, have no block. A block never leaves its text's row, so nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Each delimiter has patterns of its own, which are fixed and compiled once; only the one that is told reads the text.
    rows = lambda mark: csv_rows(F.col("__text"), F.lit(mark))
    if delimiter:
        found, read = docs.select(F.col(f"`{id_col}`"), text.alias("__text")), rows(delimiter)
    else:
        told = F.explode(F.array(T.sniff_delimiter(T.first_lines(text)))).alias("__mark")  # once: not copied into each branch
        found = docs.select(F.col(f"`{id_col}`"), text.alias("__text"), told)
        first, *others = T.DELIMITERS
        read = F.when(F.col("__mark") == first, rows(first))
        for mark in others:
            read = read.when(F.col("__mark") == mark, rows(mark))
    filled = F.transform(read, lambda cells, i: F.struct(i.alias("row"), T.normalized(F.array_join(F.filter(cells, lambda c: c != ""), " ")).alias("t")))
    blocks = F.filter(filled, lambda b: b["t"] != "")
    return found.select(id_col, F.posexplode_outer(blocks).alias("pos", "b")).where("pos is not null").select(id_col, "pos", "b.row", "b.t")


def offsets(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``blocks`` with the running offset of each block's first character (a separator after every block)."""
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(T.utf16_length(F.col("t")) + 1).over(before), F.lit(0)))


def segments(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``blocks`` (id, pos, t, k, s) with the number of their segment: one begins at a new section or a heading."""
    order = Window.partitionBy(id_col).orderBy("pos")
    begins = F.lag("s").over(order).isNull() | (F.col("s") != F.lag("s").over(order)) | (F.col("k") == "h")
    return blocks.withColumn("__b", begins.cast("int")).withColumn("segment", F.sum("__b").over(order) - 1).drop("__b")
