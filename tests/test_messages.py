"""Messages: a text for every code, places, numbers, forms, and what is missing."""

import re

from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions import formats
from textloom.functions import messages as M
from textloom.sources import files


def test_every_code_has_a_text_in_both_languages():
    keys = {f"err.{c}" for c in C.ERRORS} | {f"warn.{c}" for c in C.WARNINGS}
    for table in (M.ENGLISH, M.SPANISH):
        assert keys <= set(table) and set(table) == set(M.ENGLISH)
    for key, text in M.ENGLISH.items():
        assert re.findall(M._PLACE, text) == re.findall(M._PLACE, M.SPANISH[key])


def test_places_numbers_and_forms(spark):
    own = {"en": {"a": "{x} of {y}, {z}{x}", "only": "English {n}", "file_one": "{n} file", "file_other": "{n} files"}, "es": {"a": "{y}: {x}", "file_one": "{n} archivo", "file_other": "{n} archivos"}}
    row = spark.createDataFrame([(1, "{y}", None, 1234567.5, None)], "one long, x string, z string, big double, key string")
    places = {"x": F.col("x"), "y": F.lit("$1"), "z": F.col("z")}
    count = lambda n, language: M.message(F.lit("file"), language, numbers={"n": n}, messages=own)
    shown = [
        (M.message(F.lit("a"), "en", places, messages=own), "{y} of $1, {z}{y}"),  # a value is never filled in turn, a null leaves the place
        (M.message(F.lit("a"), "es", places, messages=own), "$1: {y}"),
        (M.message(F.lit("only"), "es", numbers={"n": F.lit(2000)}, messages=own), "English 2.000"),
        (M.message(F.lit("nowhere"), "es", messages=own), "nowhere"),
        (M.message(F.col("key"), "en", messages=own), None),
        (M.message(F.lit("a"), "fr", places, messages=own), "{y} of $1, {z}{y}"),
        (count(F.col("one"), "en"), "1 file"),
        (count(F.col("one"), "es"), "1 archivo"),
        (count(F.lit(0), "en"), "0 files"),
        (count(F.col("big"), "es"), "1.234.567,5 archivos"),
        (count(F.lit(None).cast("long"), "en"), "{n} files"),
        (formats.decimal(F.lit(1234.5678), "en"), "1,234.568"),
        (formats.decimal(F.lit(-1000), "es"), "-1.000"),
    ]
    got = row.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(shown)]).first()
    assert list(got) == [want for _, want in shown]


def test_scans_come_out_in_both_languages(spark, tmp_path):
    for name, data in {"a.txt": b"One line", "b.docx": b"no package", "c.mobi": b"none", "d.txt": b"", "e.txt": b"\0\1\2"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "no+thing é%20 here.txt").write_bytes(b"")  # Spark lists empty files but gives no rows for them
    documents = files.scan(spark, str(tmp_path))
    assert sorted(r["path"] for r in documents.collect()) == sorted(f"file:{p}" for p in tmp_path.iterdir())
    rows = {}
    for language in ("en", "es"):
        for r in files.described(documents, language).collect():
            rows[r["name"], language] = (r["error_text"], r["warning_texts"])
    assert rows["a.txt", "en"] == (None, [])
    assert rows["b.docx", "en"][0] == "The .docx file is no ZIP package: it is damaged or of another kind."
    assert rows["b.docx", "es"][0] == "El archivo .docx no es un paquete ZIP: está dañado o es de otro tipo."
    assert rows["c.mobi", "es"][0] == M.SPANISH["err.badKindle"]
    assert rows["d.txt", "en"] == (None, [M.ENGLISH["warn.noText"]]) and rows["d.txt", "es"][1] == [M.SPANISH["warn.noText"]]
    assert rows["e.txt", "es"][0] == M.SPANISH["err.unsupported"]
    unknown = documents.limit(1).withColumns({"ok": F.lit(False), "error": F.lit(None).cast("struct<code:string,detail:string>")})
    assert files.described(unknown, "es").first()["error_text"] == M.SPANISH["readFailed"]


def test_range_labels(spark):
    from textloom.operators import report

    first, second = "It was the best of times, it was the worst of times, it was the age of wisdom, it was", "the end 😀 of it all"
    docs = spark.createDataFrame([(1, [(first,), (second,)]), (2, [("a",)]), (3, [])], "doc_id long, blocks array<struct<t:string>>")
    config = report.ReportConfig(start=report.Point(0, 8), end=report.Point(1, 12))
    total = len(first) + 1 + len(second) + 1 + 1  # the smiley counts twice
    got = {r["doc_id"]: r for r in report.range_labels(docs, config).collect()}
    percent = int((len(first) + 1 + 13) / total * 100 + 0.5)
    assert tuple(got[1]) == (1, total, "“" + first[8:68].strip() + "…”", int(8 / total * 100 + 0.5), "“the end 😀 of”", percent, f"From “the” ({int(8 / total * 100 + 0.5)}%) to “of” ({percent}%)")
    assert tuple(got[2]) == (2, 2, "“”", 50, None, None, "From “a” (50%) to end")
    assert tuple(got[3]) == (3, 1, None, None, None, None, "From beginning to end")
    spanish = report.range_labels(docs, report.ReportConfig(end=report.Point(0, 70)), "es").where("doc_id = 1").first()
    assert spanish["end_excerpt"] == "«…" + first[10:70].strip() + "»" and spanish["range"].startswith("Desde el principio hasta «") and spanish["range"].endswith(" %)")
