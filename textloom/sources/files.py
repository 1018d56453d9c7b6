"""Files as a source: what kind a file is, its reader, and Spark tables of documents and blocks."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import messages as M
from textloom.sources.archive import Archive
from textloom.sources.model import Document, ReadError
from textloom.sources.readers.binary_word import read_doc
from textloom.sources.readers.epub import read_epub
from textloom.sources.readers.iwork import read_iwork
from textloom.sources.readers.kindle import read_kindle
from textloom.sources.readers.office import read_docx, read_odt
from textloom.sources.readers.pdf import read_pdf
from textloom.sources.readers.plain import read_csv, read_text
from textloom.sources.readers.rtf import read_rtf
from textloom.sources.structure import caps, finish

# Extensions offered, and extensions that promise a format.
EXTENSIONS = "txt text md csv tsv rtf pdf epub mobi prc azw azw3 kf8 kfx docx docm doc odt pages iba".split()
KINDLE = ("mobi", "azw", "azw3", "prc", "kf8")
ZIPPED = ("docx", "docm", "odt", "epub", "pages", "iba")
LABELS = {"txt": "Plain text", "csv": "CSV", "rtf": "RTF", "pdf": "PDF", "epub": "EPUB", "mobi": "Kindle (MOBI/AZW)", "docx": "Word (DOCX)", "doc": "Word 97-2003 (DOC)", "odt": "OpenDocument (ODT)", "pages": "Apple Pages", "iba": "iBooks Author"}
TIMEOUT = 180.0
SCHEMA = "path string, name string, size long, ok boolean, format_key string, format string, blocks array<struct<t:string,k:string,r:string,s:int>>, caps struct<headings:boolean,copyright:boolean,toc:boolean>, warnings array<string>, error struct<code:string,detail:string>, seconds double"


def looks_binary(data: bytes) -> bool:
    """Zero bytes, or more than a twentieth control characters, in the first 8,000 bytes; UTF-16 with its mark is text."""
    head = data[:8000]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    control = sum(head.count(c) for c in range(32) if c not in (9, 10, 11, 12, 13, 27))
    return 0 in head or control > 0.05 * len(head)


_MAGIC = (
    ("pdf", lambda b: b.startswith(b"%PDF") or b"%PDF-" in b[:1024]),
    ("zip", lambda b: b[:4] in (b"PK\x03\x04", b"PK\x05\x06")),
    ("doc", lambda b: len(b) > 8 and b.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")),
    ("rtf", lambda b: b.startswith(b"{\\rtf")),
    ("mobi", lambda b: b[60:68] in (b"BOOKMOBI", b"TEXtREAd") and len(b) > 68),
    ("topaz", lambda b: b.startswith(b"TPZ")),
    ("kfx", lambda b: b.startswith((b"CONT", b"\xeaDRMION", b"\xe0\x01\x00\xea"))),
)


def extension(name: str) -> str:
    return os.path.splitext(name)[1][1:].lower()


def sniff(data: bytes, ext: str = "") -> str:
    """The kind of a file by its first bytes, then its extension, then whether it is text."""
    for kind, fits in _MAGIC:
        if fits(data):
            return kind
    if ext == "kfx":
        return ext
    promised = {**dict.fromkeys(KINDLE, "badKindle"), **dict.fromkeys(ZIPPED, "notZip"), "pdf": "badPdf", "doc": "docNot97"}
    if ext in promised:
        raise ReadError(promised[ext], f".{ext}" if ext in ZIPPED else "")
    if ext in ("csv", "tsv"):
        return "csv"
    if looks_binary(data):
        raise ReadError("unsupported")
    return "txt"


def read_zip(data: bytes, ext: str) -> Document:
    archive = Archive(data)
    names = archive.names()
    kind = archive.text("mimetype").strip() if "mimetype" in archive else ""
    if ext == "iba":
        return read_iwork(archive, "iba")
    if kind == "application/epub+zip" or "META-INF/container.xml" in archive and ext != "pages":
        return read_epub(archive)
    if any(re.fullmatch(r"word/document\d*\.xml", n) for n in names) or "word/document.xml" in archive:
        return read_docx(archive)
    if kind.startswith("application/vnd.oasis.opendocument") or "content.xml" in archive:
        return read_odt(archive)
    if any(re.search(r"\.(?:kfx|kdf|azw\.res|ion)\Z", n, re.I) for n in names):
        raise ReadError("kfxZip")
    if ext == "pages" or any(re.match(r"Index(?:/|\.zip\Z)", n) for n in names) or "index.xml" in archive or "index.xml.gz" in archive:
        return read_iwork(archive, "pages")
    raise ReadError("zipUnknown")


_READERS = {"pdf": read_pdf, "doc": read_doc, "rtf": read_rtf, "mobi": read_kindle, "txt": read_text}


def read_bytes(data: bytes, name: str = "") -> Document:
    """A finished document from a file's bytes; raises :class:`ReadError` if it can't be read."""
    ext = extension(name)
    kind = sniff(data, ext)
    if kind in ("topaz", "kfx"):
        raise ReadError(kind)
    if kind == "zip":
        doc = read_zip(data, ext)
    elif kind == "csv":
        doc = read_csv(data, tabs=ext == "tsv")
    else:
        doc = _READERS[kind](data)
    return finish(doc)


def sniff_column(content: Column, name: Column) -> Column:
    """:func:`sniff` as a column, for counting kinds without reading texts; an error code where a file breaks its promise."""
    head = F.hex(F.substring(content, 1, 1024))
    text = F.decode(F.substring(content, 1, 8000), "ISO-8859-1")  # a character for each byte
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1A\x1C-\x1F]", ""))
    binary = text.contains("\0") | (control * 20 > F.length(text))
    starts = lambda *marks: F.greatest(*[head.startswith(m.hex().upper()) for m in marks], F.lit(False))
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))
    magic = F.substring(head, 121, 16)
    return (
        F.when(starts(b"%PDF") | head.rlike("^(?:..)*255044462D"), "pdf")
        .when(starts(b"PK\x03\x04", b"PK\x05\x06"), "zip")
        .when(starts(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "doc")
        .when(starts(b"{\\rtf"), "rtf")
        .when(magic.isin(b"BOOKMOBI".hex().upper(), b"TEXtREAd".hex().upper()), "mobi")
        .when(starts(b"TPZ"), "topaz")
        .when(starts(b"CONT", b"\xeaDRMION", b"\xe0\x01\x00\xea") | (ext == "kfx"), "kfx")
        .when(ext.isin(*KINDLE), "badKindle")
        .when(ext.isin(*ZIPPED), "notZip")
        .when(ext == "pdf", "badPdf")
        .when(ext == "doc", "docNot97")
        .when(ext.isin("csv", "tsv"), "csv")
        .when(~starts(b"\xff\xfe", b"\xfe\xff") & binary, "unsupported")
        .otherwise("txt")
    )


def read_documents(files: DataFrame) -> DataFrame:
    """Documents of a ``binaryFile`` table (path, length, content): one row a file, errors as columns."""
    import pyarrow as pa

    blocks = pa.list_(pa.struct([("t", pa.string()), ("k", pa.string()), ("r", pa.string()), ("s", pa.int32())]))
    flags = pa.struct([("headings", pa.bool_()), ("copyright", pa.bool_()), ("toc", pa.bool_())])
    kinds = {"path": pa.string(), "name": pa.string(), "size": pa.int64(), "ok": pa.bool_(), "format_key": pa.string(), "format": pa.string(), "blocks": blocks, "caps": flags, "warnings": pa.list_(pa.string()), "error": pa.struct([("code", pa.string()), ("detail", pa.string())]), "seconds": pa.float64()}

    def one(path: str, content: bytes) -> dict:
        began = time.monotonic()
        row = dict.fromkeys(kinds) | {"path": path, "name": os.path.basename(path), "size": len(content), "ok": False}
        try:
            doc = read_bytes(content, path)
            row |= {"ok": True, "format_key": doc.format_key, "format": LABELS.get(doc.format_key), "blocks": [vars(b) for b in doc.blocks], "caps": caps(doc.blocks), "warnings": doc.warnings}
        except ReadError as error:
            row["error"] = {"code": error.code, "detail": error.detail}
        except Exception as error:  # a broken file must not fail the job
            row["error"] = {"code": "generic", "detail": f"{type(error).__name__}: {error}"}
        return row | {"seconds": time.monotonic() - began}

    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):  # one file at a time bounds memory
                row = one(path.as_py(), content.as_py() or b"")
                yield pa.RecordBatch.from_pydict({k: pa.array([row[k]], kinds[k]) for k in kinds})

    return files.select("path", "content").mapInArrow(scan, SCHEMA)


def scan(spark: SparkSession, path: str, extensions: list[str] | tuple[str, ...] = tuple(EXTENSIONS), partitions: int | None = None) -> DataFrame:
    """Documents below a folder, at any depth; with no extensions given, of any kind. Large files may skew partitions; ``partitions`` deals them anew."""
    pattern = "*" if not extensions else "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    whole = files.select("path", "content").unionByName(_empty(files))
    return read_documents(whole.repartition(partitions) if partitions else whole)


def _empty(files: DataFrame) -> DataFrame:
    """The empty files of a ``binaryFile`` table, which Spark lists but gives no rows for."""
    at = lambda path: F.regexp_replace(path, "^([^:/]+):/+", "$1:/")
    listed = files.sparkSession.createDataFrame([(uri,) for uri in files.inputFiles()], "uri string")
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    missed = listed.select(plain.alias("path"), at(plain).alias("at")).join(files.select(at("path").alias("at")), "at", "left_anti")
    return missed.select(F.regexp_replace("path", "^([^:/]+):///", "$1:/").alias("path"), F.lit(b"").alias("content"))


def blocks(documents: DataFrame) -> DataFrame:
    """One row per block: path, pos, t, k, r, s."""
    return documents.where("ok").select("path", F.posexplode("blocks").alias("pos", "b")).select("path", "pos", "b.*")


def described(documents: DataFrame, language: str = "en", messages: dict[str, dict[str, str]] = M.MESSAGES) -> DataFrame:
    """Documents with ``error_text`` (null where the file was read) and ``warning_texts``, in words of a language."""
    code, detail = F.col("error.code"), F.col("error.detail")
    error = M.message(F.coalesce(F.concat(F.lit("err."), code), F.lit("readFailed")), language, {"detail": detail}, messages=messages)
    warning = lambda w: M.message(F.concat(F.lit("warn."), w), language, messages=messages)
    return documents.withColumns({"error_text": F.when(~F.coalesce("ok", F.lit(False)), error), "warning_texts": F.transform("warnings", warning)})
