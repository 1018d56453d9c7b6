"""The CSV of a report: metadata, a blank line, a header, the rows; for one document or many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions.text import csv_cell
from textloom.operators import report

# Labels of the CSV.
LABELS = {
    "file": "File",
    "text_language": "Text language",
    "range": "Range",
    "headings": "Chapter titles / headings",
    "copyright": "Copyright page",
    "toc": "Table of contents / index",
    "possessives": "Possessive 's",
    "hidden_types": "Word types hidden from the table",
    "words": "Word count",
    "chars_no_spaces": "Character count (no spaces)",
    "chars_with_spaces": "Character count (with spaces)",
    "unique": "Unique words",
    "word": "Word",
    "count": "Times used",
    "pct": "% of total words",
    "types": "Word type",
}
LABELS_ES = {
    "file": "Archivo",
    "text_language": "Idioma del texto",
    "range": "Rango",
    "headings": "Títulos de capítulo / encabezados",
    "copyright": "Página de derechos de autor",
    "toc": "Índice / tabla de contenidos",
    "possessives": "Posesivo 's (inglés)",
    "hidden_types": "Tipos de palabra ocultos en la tabla",
    "words": "Número de palabras",
    "chars_no_spaces": "Número de caracteres (sin espacios)",
    "chars_with_spaces": "Número de caracteres (con espacios)",
    "unique": "Palabras distintas",
    "word": "Palabra",
    "count": "Veces usada",
    "pct": "% del total de palabras",
    "types": "Tipo de palabra",
}
#: How a word type is named beside a word, in the order of the types.
TAGS = {
    "en": "noun verb adjective adverb pronoun determiner article preposition conjunction interjection number unrecognised".split(),
    "es": "sustantivo verbo adjetivo adverbio pronombre determinante artículo preposición conjunción interjección número no reconocida".split(" ", 11),
}
_META = ("file", "text_language", "range", "headings", "copyright", "toc", "possessives", "hidden_types")
_OPTIONAL = ("text_language", "possessives", "hidden_types")


def csv_lines(totals: DataFrame, rows: DataFrame, meta: dict[str, str], key: str = "doc_id", labels: dict | None = None, delimiter: str = ",", decimal: str = ".", types: bool = False) -> DataFrame:
    """(key, line_no, line) of every document's report.

    ``totals``: key, words, chars_no_spaces, chars_with_spaces, unique_words. ``rows``: key, rank, word, count, pct
    and, if ``types``, classes. ``meta`` gives the metadata cells; the file's name defaults to the key. Lines lack
    their line ends, and follow from their number alone, so no order of rows matters.
    """
    first, line, share = _layout(meta, key, labels, delimiter, decimal, types)
    top = totals.select(key, F.posexplode(F.array(*first)).alias("line_no", "line"))
    cells = [F.col("word"), F.col("count"), share(F.col("pct"))]
    if types:
        cells.append(F.array_join(F.filter("classes", lambda c: c != "other"), " / "))
    body = rows.select(key, (F.col("rank") + len(first) - 1).cast("int").alias("line_no"), line(*cells).alias("line"))
    return top.unionByName(body)


def _layout(meta: dict[str, str], key: str, labels: dict | None, delimiter: str, decimal: str, types: bool):
    """The lines before the words, and functions that form a line of cells and show a share."""
    names = LABELS | (labels or {})
    head = [(name, F.lit(meta[name])) if name in meta else (name, F.col(key).cast("string")) if name == "file" else None for name in _META if name in meta or name not in _OPTIONAL]
    head = [h if h else (n, F.lit("")) for h, n in zip(head, [n for n in _META if n in meta or n not in _OPTIONAL])]
    head += [("words", F.col("words")), ("chars_no_spaces", F.col("chars_no_spaces")), ("chars_with_spaces", F.col("chars_with_spaces")), ("unique", F.col("unique_words"))]
    line = lambda *cells: F.concat_ws(delimiter, *[csv_cell(c, delimiter) for c in cells])
    columns = ["word", "count", "pct"] + ["types"] * types
    first = [line(F.lit(names[n]), value) for n, value in head] + [F.lit(""), line(*[F.lit(names[c]) for c in columns])]
    share = lambda pct: F.replace(F.format_string("%.4f", pct), F.lit("."), F.lit(decimal))
    return first, line, share


def csv_lines_of_reports(reports: DataFrame, meta: dict[str, str], key: str = "doc_id", labels: dict | None = None, delimiter: str = ",", decimal: str = ".") -> DataFrame:
    """:func:`csv_lines` of ``report.doc_reports``: a document's lines come out of its row, so nothing is joined or ranked again."""
    first, line, share = _layout(meta, key, labels, delimiter, decimal, False)
    head = F.transform(F.array(*first), lambda x: F.struct(x.alias("line"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("count")))
    body = F.transform("ranked", lambda x: F.struct(F.lit(None).cast("string").alias("line"), x["word"].alias("word"), x["count"].alias("count")))
    rows = reports.select(key, "words", F.posexplode(F.concat(head, body)).alias("line_no", "x"))
    shown = line(F.col("x.word"), F.col("x.count"), share(F.col("x.count") / F.col("words") * 100))
    return rows.select(key, "line_no", F.coalesce("x.line", shown).alias("line"))


def localised(totals: DataFrame, rows: DataFrame, meta: dict[str, str], language: str = "en", hidden: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """:func:`csv_lines` in a language: its labels, names of word types, delimiter and decimal mark.

    Words all of whose types are ``hidden`` are left out and the others close up; a view's text filter plays no part. ``rows`` need ``classes``.
    """
    spanish = language == "es"
    kept = rows.where(F.exists("classes", lambda c: ~c.isin(*hidden))) if hidden else rows
    names = F.create_map(*[F.lit(x) for pair in zip(C.CLASSES, TAGS["es" if spanish else "en"]) for x in pair])
    tags = F.transform(F.filter("classes", lambda c: c != "other"), lambda c: F.element_at(names, c))
    kept = report.ranked(kept.drop("rank"), (key,)).withColumn("classes", tags)
    return csv_lines(totals, kept, meta, key, LABELS_ES if spanish else None, ";" if spanish else ",", "," if spanish else ".", types=True)


def write_csv(lines: DataFrame, path: str, key: str = "doc_id") -> None:
    """One folder per document, its lines in order in one file: CRLF ends and a byte-order mark at the beginning."""
    marked = lines.withColumn("line", F.when(F.col("line_no") == 0, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")))
    marked.repartition(key).sortWithinPartitions(key, "line_no").select(key, "line").write.partitionBy(key).option("lineSep", "\r\n").text(path)
