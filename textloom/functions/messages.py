"""Messages to readers in each language, as columns: templates, places to fill, and the form that a count asks for.

A table of messages maps a language to its templates by key. A key that a language lacks is taken from English, and an
unknown key shows as itself. ``{name}`` in a template is a place; one without a value, or with a null one, stays as it is.
A key with a count has two forms, ``key_one`` and ``key_other``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import formats

ENGLISH = {
    "readFailed": "The file could not be read.",
    "blocks_one": "{n} block of text",
    "blocks_other": "{n} blocks of text",
    "words_one": "{n} word",
    "words_other": "{n} words",
    "range": "From {start} to {end}",
    "range.beginning": "beginning",
    "range.end": "end",
    "err.generic": "Reading failed: {detail}",
    "err.notFound": "There is no such file.",
    "err.cannotOpen": "The file could not be opened ({detail}).",
    "err.encrypted": "The file is encrypted or needs a password.",
    "err.kfx": "This is a KFX book, whose format is closed. Convert a copy without protection to EPUB or AZW3.",
    "err.kfxZip": "This package holds a KFX book, whose format is closed. Convert it to EPUB or AZW3.",
    "err.topaz": "This is a Topaz book, whose format is closed and protected.",
    "err.badKindle": "No header of a Kindle book (MOBI, AZW) was found.",
    "err.notZip": "The {detail} file is no ZIP package: it is damaged or of another kind.",
    "err.badPdf": "The file does not begin as a PDF does.",
    "err.docNot97": "The .doc file is not of the format of Word 97 to 2003.",
    "err.unsupported": "The file is neither text nor of a known format.",
    "err.zipDamaged": "The ZIP package is damaged ({detail}).",
    "err.zipUnknown": "The ZIP package holds none of the known documents.",
    "err.pdfPassword": "The PDF is protected by a password.",
    "err.pdfOpen": "The PDF could not be opened ({detail}).",
    "err.kindleDrm": "The Kindle book is protected (DRM). Only books without protection can be read.",
    "err.kindleCompression": "The Kindle book is compressed in an unknown way ({detail}).",
    "err.kindleEmpty": "The Kindle book is empty.",
    "err.docDamaged": "The .doc file is damaged.",
    "err.docPassword": "The Word document is protected by a password.",
    "err.docNotWord": "The file holds no Word document.",
    "err.docTooOld": "The document was written by Word 6 or 95. Save it as .docx.",
    "err.epubNoOpf": "The EPUB is damaged: it has no package file (OPF).",
    "err.epubAdobeDrm": "The EPUB is protected (Adobe). Only books without protection can be read.",
    "err.epubDrm": "The EPUB is protected (DRM). Only books without protection can be read.",
    "err.pagesNoText": "The Pages file gave no text. Export it as EPUB or Word.",
    "err.ibaNoText": "The iBooks Author file gave no text. Export it as EPUB or text.",
    "err.workerStopped": "Reading ended early (code {detail}).",
    "err.timeout": "Reading took too long and was given up.",
    "err.workerCrashed": "The reader ended, probably for lack of memory. ({detail})",
    "warn.pdfNoText": "The PDF has no text, only images perhaps: it needs character recognition first.",
    "warn.noText": "The file gave no text; it may be empty or hold images only.",
    "warn.iworkNoBody": "There is no main text; text boxes and the like were read instead.",
    "warn.pagesBestEffort": "Headings of Pages files are guessed from the text.",
    "warn.ibaBestEffort": "Headings and front matter of iBooks Author files are guessed.",
}
SPANISH = {
    "readFailed": "No se pudo leer el archivo.",
    "blocks_one": "{n} bloque de texto",
    "blocks_other": "{n} bloques de texto",
    "words_one": "{n} palabra",
    "words_other": "{n} palabras",
    "range": "Desde {start} hasta {end}",
    "range.beginning": "el principio",
    "range.end": "el final",
    "err.generic": "La lectura falló: {detail}",
    "err.notFound": "No existe tal archivo.",
    "err.cannotOpen": "No se pudo abrir el archivo ({detail}).",
    "err.encrypted": "El archivo está cifrado o pide una contraseña.",
    "err.kfx": "Es un libro KFX, un formato cerrado. Convierta una copia sin protección a EPUB o AZW3.",
    "err.kfxZip": "El paquete contiene un libro KFX, un formato cerrado. Conviértalo a EPUB o AZW3.",
    "err.topaz": "Es un libro Topaz, un formato cerrado y protegido.",
    "err.badKindle": "Falta la cabecera de un libro Kindle (MOBI, AZW).",
    "err.notZip": "El archivo {detail} no es un paquete ZIP: está dañado o es de otro tipo.",
    "err.badPdf": "El archivo no empieza como un PDF.",
    "err.docNot97": "El archivo .doc no tiene el formato de Word 97 a 2003.",
    "err.unsupported": "El archivo no es texto ni de un formato conocido.",
    "err.zipDamaged": "El paquete ZIP está dañado ({detail}).",
    "err.zipUnknown": "El paquete ZIP no contiene ningún documento conocido.",
    "err.pdfPassword": "El PDF está protegido con contraseña.",
    "err.pdfOpen": "No se pudo abrir el PDF ({detail}).",
    "err.kindleDrm": "El libro Kindle está protegido (DRM). Solo se leen libros sin protección.",
    "err.kindleCompression": "El libro Kindle usa una compresión desconocida ({detail}).",
    "err.kindleEmpty": "El libro Kindle está vacío.",
    "err.docDamaged": "El archivo .doc está dañado.",
    "err.docPassword": "El documento de Word está protegido con contraseña.",
    "err.docNotWord": "El archivo no contiene un documento de Word.",
    "err.docTooOld": "El documento es de Word 6 o 95. Guárdelo como .docx.",
    "err.epubNoOpf": "El EPUB está dañado: falta su archivo de paquete (OPF).",
    "err.epubAdobeDrm": "El EPUB está protegido (Adobe). Solo se leen libros sin protección.",
    "err.epubDrm": "El EPUB está protegido (DRM). Solo se leen libros sin protección.",
    "err.pagesNoText": "El archivo de Pages no dio texto. Expórtelo como EPUB o Word.",
    "err.ibaNoText": "El archivo de iBooks Author no dio texto. Expórtelo como EPUB o texto.",
    "err.workerStopped": "La lectura terminó antes de tiempo (código {detail}).",
    "err.timeout": "La lectura tardó demasiado y se abandonó.",
    "err.workerCrashed": "El lector terminó, quizá por falta de memoria. ({detail})",
    "warn.pdfNoText": "El PDF no tiene texto, quizá solo imágenes: antes hay que reconocer sus caracteres.",
    "warn.noText": "El archivo no dio texto; puede estar vacío o tener solo imágenes.",
    "warn.iworkNoBody": "No hay texto principal; se leyeron los cuadros de texto y similares.",
    "warn.pagesBestEffort": "Los títulos de los archivos de Pages se deducen del texto.",
    "warn.ibaBestEffort": "Los títulos y las páginas preliminares de iBooks Author se deducen.",
}
MESSAGES = {"en": ENGLISH, "es": SPANISH}
_PLACE = r"\{([A-Za-z0-9_]+)\}"


def _map(pairs: dict) -> Column:
    text = lambda values: F.array(*values).cast("array<string>")
    return F.map_from_arrays(text(F.lit(k) for k in pairs), text(v if isinstance(v, Column) else F.lit(v) for v in pairs.values()))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its places filled, all at once: what looks like a place within a value is none."""
    names, known = F.regexp_extract_all(template, F.lit(_PLACE), F.lit(1)), _map(values)
    place = lambda name: F.coalesce(F.try_element_at(known, name), F.concat(F.lit("{"), name, F.lit("}")))
    return F.array_join(F.transform(F.split(template, _PLACE, -1), lambda gap, i: F.concat(gap, F.coalesce(place(F.get(names, i)), F.lit("")))), "")


def message(key: Column, language: str = "en", values: dict[str, Column] | None = None, numbers: dict[str, Column] | None = None, messages: dict[str, dict[str, str]] = MESSAGES) -> Column:
    """The message of a key, with ``values`` in its places as they are and ``numbers`` as the language shows them.

    Where ``numbers`` hold ``n``, that is the count that chooses the form; a null one takes the form for many. A null key
    gives a null message, an unknown language the English one.
    """
    table = _map({**messages["en"], **messages.get(language, {})})
    template = F.coalesce(F.try_element_at(table, key), key)
    if numbers and "n" in numbers:
        form = F.concat(key, F.when(numbers["n"] == 1, F.lit("_one")).otherwise(F.lit("_other")))
        template = F.coalesce(F.try_element_at(table, form), template)
    return filled(template, {**(values or {}), **{name: formats.decimal(x, language) for name, x in (numbers or {}).items()}})
