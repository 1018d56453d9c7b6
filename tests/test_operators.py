"""Blocks, structure, reports, CSV and lexicon files over small made-up documents."""

from pyspark.sql import functions as F

from textloom.operators import blocks as B
from textloom.operators import csv_report, report, roles
from textloom.sources import lexicon as L
from textloom.sources.model import Block, Document, add_text
from textloom.sources.structure import finish

PAGES = "First line\nwrapped.\n\nSecond\u00a0one.\r\n\n\nThird.\f\f\u200b\n \fLast page\nwith lines"


def test_text_blocks_match_the_plain_reader(spark):
    for text in (PAGES, "", "\n\n", "a\nb\nc\n\n", "one\r\rtwo\r\r\rthree\n\n\n\nfour", "x" * 100, "a\n" * 60 + "\n\nb"):
        doc = Document()
        add_text(doc, text)
        frame = B.with_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
        got = [tuple(r) for r in B.exploded(frame).orderBy("pos").select("t", "k", "r", "s").collect()]
        assert got == [(b.t, b.k, b.r, b.s) for b in doc.blocks], text


def test_structure(spark):
    text = "\n".join(["Contents", "Rivers 1", "Lakes 2", "Rivers", "Body of the text about all the many rivers there are in the whole world of water.", "© 2001 A. Press", "Published by A. Press. ISBN 1", "All rights reserved", *["A long body sentence that says something."] * 3, "Index", "lake, 3", "river, 4", "sea"])
    whole = roles.with_structure(B.with_blocks(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")))
    rows = {r["doc_id"]: r for r in whole.collect()}
    assert [b["r"] for b in rows[1]["blocks"]] == ["toc"] * 3 + [None] * 2 + ["copyright"] * 3 + [None] * 3 + ["index"] * 4
    assert rows[1]["caps"]["toc"] and rows[1]["caps"]["copyright"] and rows[2]["warnings"] == ["noText"]
    doc = finish(Document([Block("Contents"), Block("a 1")]))
    assert [b.r for b in doc.blocks] == [None, None]


def test_report_properties(spark):
    docs = spark.createDataFrame([(1, "The father's cat, the cat\nsat."), (2, "élan él ella nz ñu oz"), (3, "")], "doc_id int, text string")
    lines = B.line_blocks(docs)
    rows = report.ranked(report.frequency(report.words(lines, ("doc_id",), merge_possessive=True), ("doc_id",)), ("doc_id",))
    one = {r["word"]: (r["count"], r["rank"]) for r in rows.where("doc_id = 1").collect()}
    assert one == {"cat": (2, 1), "the": (2, 2), "father": (1, 3), "sat": (1, 4)}
    assert [r["word"] for r in rows.where("doc_id = 2").orderBy("rank").collect()] == ["él", "élan", "ella", "ñu", "nz", "oz"]
    total = {r["doc_id"]: r for r in report.doc_stats(docs).collect()}
    sums = {r["doc_id"]: r for r in rows.groupBy("doc_id").agg(F.sum("count").alias("n"), F.sum("pct").alias("p")).collect()}
    assert set(total) == {1, 2} and all(sums[d]["n"] == total[d]["words"] and abs(sums[d]["p"] - 100) < 1e-9 for d in total)
    assert total[1]["chars_no_spaces"] == 25 and total[1]["chars_with_spaces"] == 29 and total[1]["blocks"] == 2


def test_view_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 'a"b', 3, 60.0, ["nouns"]), (1, 2, "the", 1, 20.0, ["articles"]), (1, 3, "then", 1, 20.0, ["other"])], "doc_id int, rank int, word string, count long, pct double, classes array<string>")
    assert [r["word"] for r in report.view(rows, query=" THE").collect()] == ["the", "then"]
    assert [r["word"] for r in report.view(rows, hidden=("articles",), sort_key="word", ascending=False).collect()] == ["then", 'a"b']
    assert {r["cls"]: r["words"] for r in report.class_counts(rows).collect()} == {"nouns": 1, "articles": 1, "other": 1}
    totals = spark.createDataFrame([(1, 5, 9, 12, 3)], "doc_id int, words long, chars_no_spaces long, chars_with_spaces long, unique_words long")
    lines = csv_report.csv_lines(totals, rows, {"file": "x;y", "range": "All", "headings": "no", "copyright": "no", "toc": "no"}, delimiter=";", decimal=",", types=True)
    got = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert got == ['File;"x;y"', "Range;All", "Chapter titles / headings;no", "Copyright page;no", "Table of contents / index;no", "Word count;5", "Character count (no spaces);9", "Character count (with spaces);12", "Unique words;3", "", "Word;Times used;% of total words;Word type", '"a""b";3;60,0000;nouns', "the;1;20,0000;articles", "then;1;20,0000;"]
    csv_report.write_csv(lines, str(tmp_path / "csv"))
    data = next((tmp_path / "csv/doc_id=1").glob("part*")).read_bytes()
    assert data.startswith("\ufeffFile;".encode()) and data.count(b"\r\n") == len(got)


def test_language(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "el año y la niña"), (3, "x"), (4, "été")], "doc_id int, text string")
    got = {r["doc_id"]: r["language"] for r in report.detect_language(docs, ui_language="es").collect()}
    assert got == {1: "en", 2: "es", 3: "es", 4: "es"}


def test_lexicon_files_and_build(spark, tmp_path):
    (tmp_path / "en.tsv").write_text("#v2\tnouns,verbs?\tadverbs\nrun\t0\nsoon\t1\n", encoding="utf-8")
    assert {r["word"]: [tuple(c) for c in r["classes"]] for r in L.load(spark, str(tmp_path / "en.tsv")).collect()} == {"run": [("nouns", False), ("verbs", True)], "soon": [("adverbs", False)]}
    old = spark.createDataFrame([("#nouns,verbs?\nrun\nwalk\n#adverbs\nsoon\n",)], "value string")
    assert {r["word"] for r in L.parse_grouped(old).collect()} == {"run", "walk", "soon"}
    conll = spark.createDataFrame([(f"{i}\tRun\trun\t{tag}",) for i, tag in enumerate(["NOUN"] * 30 + ["VERB"])] + [("1-2\tx\tx\tNOUN",), ("# text",), ("",)], "value string")
    counts = L.treebank_counts(conll)
    assert {(r["word"], r["cls"]): r["n"] for r in counts.collect()} == {("run", "nouns"): 30, ("run", "verbs"): 1}
    tagged = L.tagged_entries(spark.createDataFrame([("Casa casa NCFS000 casar VMIP3S0",), ("a_b x N",)], "value string"))
    assert {tuple(r) for r in tagged.collect()} == {("casa", "nouns"), ("casa", "verbs")}
    group = spark.createDataFrame([("1: run <v>: runs, ran, (a: running | b: runnin')\n2: - <n>: runs*",)], "value string")
    entries = L.word_list_entries(group)
    assert {r["word"] for r in entries.where("cls = 'verbs'").collect()} == {"run", "runs", "ran", "running", "runnin'"}
    built = L.build(entries, counts)
    assert {tuple(c) for c in built.where("word = 'run'").first()["classes"]} == {("nouns", False), ("verbs", True)}
    head, lines = L.lines_v2(built)
    assert head.startswith("#v2\t") and lines.count() == built.count()
    assert {r["word"]: r["classes"] for r in L.parse(spark.createDataFrame([(head,), *[(r["line"],) for r in lines.collect()]], "value string")).collect()} == {r["word"]: r["classes"] for r in built.collect()}


def test_lexicon_files_of_either_format_load(spark, tmp_path):
    (tmp_path / "old.tsv").write_text("#nouns,verbs?\nrun\nwalk\n#adverbs\nsoon\n", encoding="utf-8")
    got = {r["word"]: [tuple(c) for c in r["classes"]] for r in L.load(spark, str(tmp_path / "old.tsv")).collect()}
    assert got == {"run": [("nouns", False), ("verbs", True)], "walk": [("nouns", False), ("verbs", True)], "soon": [("adverbs", False)]}
    many = [f"nouns{i}" for i in range(100_003)]  # more groups than any bound that a slice would set
    (tmp_path / "new.tsv").write_text("#v2\t" + "\t".join(many) + "\nlast\t255u\n", encoding="utf-8")
    assert [(r["word"], r["classes"][0]["cls"]) for r in L.load(spark, str(tmp_path / "new.tsv")).collect()] == [("last", f"nouns{int('255u', 36)}")]


def test_blocks_form_once_and_in_time_that_follows_the_text(spark):
    import time

    from textloom.operators import blocks as B

    def seconds(lines):
        text = "\n".join(f"line {i} of\f many\n\nwords" for i in range(lines // 4))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert B.exploded(B.with_blocks(docs)).where("t <> ''").count() > lines // 4
        return time.perf_counter() - began

    plan = B.exploded(B.with_blocks(spark.createDataFrame([(1, "a")], "doc_id long, text string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 5 and plan.count("RLIKE") == 1
    seconds(1000)
    few, many = min(seconds(4000) for _ in range(2)), min(seconds(16_000) for _ in range(2))
    assert many < 8 * few + 1


def test_csv_blocks_are_the_readers(spark):
    import random

    from textloom.operators import blocks as B
    from textloom.sources.readers import plain

    rng = random.Random(2)
    texts = [None, "", "\n", '"', '""', '"a""b",c\n"line\nbreak", d "e" ,"open\nto the end', 'a;b\r\n"x;y";z\rlast', "a\tb\n" * 3, "a|b|c\n\n|||\nd||e\n", '"' + "q" * 200_000 + '"",x\ny', '""' * 50_000, "a," * 50_000, '""x"y,z",w\n']
    texts += ["".join(rng.choice(['"', '""', ",", ";", "a", "b c", "\n", "\r\n", "\r", " ", "\t", "|", '",', ',"']) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = {}
    for r in sorted(B.csv_blocks(docs).collect()):
        got.setdefault(r["doc_id"], []).append(r["t"])
        assert r["pos"] == len(got[r["doc_id"]]) - 1
    for i, t in enumerate(texts):
        assert got.get(i, []) == [b.t for b in plain.read_csv((t or "").encode()).blocks], t[:80]
    plan = B.csv_blocks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_tokenize_beside_other_columns(spark):
    import random

    from textloom.functions import text as T

    rng = random.Random(5)
    texts = [None, "", " . ", "one", "  Don't stop, l’été 3.14 rock-n-roll! 1,000.5.", "é😀 日本 x", "a b " * 3000, "\n".join("wörd%d," % i for i in range(700))]
    texts += ["".join(rng.choice("aé1'’.,- \n日😀\u0301") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("tokenize_texts")
    assert {"tokenize", "tl_token_spans"} <= set(T.register(spark))
    out = spark.sql("SELECT id, w.* FROM tokenize_texts, LATERAL tokenize(text) AS w")
    got = sorted(tuple(r) for r in out.collect())
    assert got and all(texts[i][a:b] == w for i, _, a, b, w in got)
    arrays = spark.sql("SELECT id, tl_token_spans(text) AS spans, tl_tokens(text) AS ws FROM tokenize_texts").collect()
    assert got == sorted((r["id"], k, *w) for r in arrays for k, w in enumerate(r["spans"] or ()))
    assert all([w["token"] for w in r["spans"] or ()] == (r["ws"] or []) for r in arrays)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert spark.sql("SELECT tl_reading_time(238, 238) a, tl_reading_time(NULL, 200) b, tl_csv_cell('a,b', ',') c").first() == ("00:01", "00:00", '"a,b"')


def test_clitic_bases(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from textloom.functions import classes as K

    def plain_bases(word):
        plain = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ"))
        out, removed = [], ""
        for _ in range(3):
            cut = next((c for c in ("nos", "las", "los", "les", "me", "te", "se", "os", "lo", "la", "le") if word.endswith(c)), None)
            if cut is None or len(word) - len(cut) < 2:
                break
            word, removed = word[: -len(cut)], cut + removed
            for form in (word, word + "s") if removed.startswith("nos") else (word,):
                out += [form, plain(form)]
        return list(dict.fromkeys(out))

    words = ["dímelo", "hacerlo", "diciéndole", "vámonos", "dándoselos", "lo", "alo", "ármelo", "señalándosela", "mesa", "", "nos", "xxnos", "quédeseme", "pingüinolas", "ñoñosela", "ándenselo", "dános"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["b"] for r in frame.select("word", K.clitic_bases(F.col("word")).alias("b")).collect()}
    assert got == {w: plain_bases(w) for w in words}
    lexicon = spark.createDataFrame([("decir", [("verbs", False)]), ("vamos", [("verbs", False)]), ("di", [("verbs", False)]), ("mesa", [("nouns", False)]), ("haz", [("verbs", True)])], "word string, classes array<struct<cls:string,rare:boolean>>")
    out = K.with_classes(spark.createDataFrame([(w,) for w in ["dímelo", "vámonos", "decirlos", "mesa", "hazlo", "rápidamente"]], "word string"), lexicon, "es")
    assert {r["word"]: r["classes"] for r in out.collect()} == {"dímelo": ["verbs"], "vámonos": ["verbs"], "decirlos": ["verbs"], "mesa": ["nouns"], "hazlo": ["other"], "rápidamente": ["adverbs"]}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_formats(spark):
    from pyspark.sql import functions as F

    from textloom.functions import formats as L

    rows = spark.createDataFrame([(None,), (0,), (999,), (1000,), (1023,), (1024,), (1536,), (10_239,), (10_240,), (1_048_575,), (1_048_576,), (1_500_000_000,), (1 << 44,)], "n long")
    got = [tuple(r) for r in rows.select(*[f(F.col("n"), x) for f in (L.whole, L.size) for x in ("en", "es")]).collect()]
    assert got[:4] == [(None,) * 4, ("0", "0", "0 B", "0 B"), ("999", "999", "999 B", "999 B"), ("1,000", "1.000", "1000 B", "1000 B")]
    assert [r[2] for r in got[4:]] == ["1023 B", "1 KB", "1.5 KB", "10 KB", "10 KB", "1,024 KB", "1 MB", "1.4 GB", "16,384 GB"]
    assert [r[3] for r in got[4:]] == ["1023 B", "1 KB", "1,5 KB", "10 KB", "10 KB", "1024 KB", "1 MB", "1,4 GB", "16.384 GB"]
    shares = spark.createDataFrame([(12.345678,), (0.009999,), (0.01,), (100.0,), (None,)], "p double")
    assert [tuple(r) for r in shares.select(L.share(F.col("p")), L.share(F.col("p"), "es")).collect()] == [("12.35%", "12,35 %"), ("0.0100%", "0,0100 %"), ("0.01%", "0,01 %"), ("100.00%", "100,00 %"), (None, None)]


def test_named_files(spark, tmp_path):
    from textloom.sources import export

    rows = [(name, i, f"line {i} é") for name in ["a", "b/c", "b:c", "..", "x" * 300, None] for i in range(5)] + [("empty line", 0, None)]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, line string").repartition(6)

    def shown():
        return {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode("utf-8") for p in sorted((tmp_path / "out").rglob("*")) if p.is_file()}

    export.write_files(lines, str(tmp_path / "out"))
    got = shown()
    body = "﻿" + "".join(f"line {i} é\r\n" for i in range(5))
    assert len(got) == 7 and all(k.startswith("part-") for k in got) and sorted(got.values()) == sorted([body] * 6 + ["﻿\r\n"])
    assert not (tmp_path / "out" / "_temporary").exists() or not any((tmp_path / "out" / "_temporary").iterdir())
    export.write_files(lines.where("doc_id = 'a'"), str(tmp_path / "out"), mode="append")
    assert len(shown()) == 8
    export.write_files(lines.where("doc_id = 'a'"), str(tmp_path / "out"))
    assert list(shown().values()) == [body] and next(iter(shown())).endswith("/a.csv")
    before = shown()
    try:
        from pyspark.sql import functions as F

        bad = lines.withColumn("line", F.when(F.col("line_no") == 4, F.raise_error("stop")).otherwise(F.col("line")))
        export.write_files(bad, str(tmp_path / "out"))
        raise AssertionError("no error")
    except Exception as error:
        assert "stop" in str(error)
    assert shown() == before
    export.write_files(lines.limit(0), str(tmp_path / "out2"))
    assert (tmp_path / "out2").is_dir()


def test_pages_together_are_the_view(spark):
    from textloom.operators import report

    words = ["a", "b", "É", "é", "e", "z-z", "Z", "ñ", "n", "'"] + [f"w{i}" for i in range(40)]
    counted = spark.createDataFrame([(w, 1 + len(w) % 3) for w in words], "word string, count long").repartition(5)
    whole = [(r["word"], r["count"]) for r in report.view(counted).select("word", "count").collect()]
    got, after = [], None
    while rows := report.page(counted, 7, after).collect():
        got += [(r["word"], r["count"]) for r in rows]
        after = (rows[-1]["count"], rows[-1]["word"])
    assert got == whole and len(got) == len(words)
    plan = report.page(counted, 7, (2, "n"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert report.max_share(spark.createDataFrame([], "word string, pct double")).first()["max_pct"] == 1.0


def test_settings_store(spark, tmp_path):
    from textloom.operators import report

    path = str(tmp_path / "deep" / "settings.json")
    assert report.load_settings(spark, path) == report.Settings()
    for mine in (report.Settings(300, "es", ("nouns", "other")), report.Settings(90, "en", ("verbs",))):
        report.save_settings(spark, mine, path)
        assert report.load_settings(spark, path) == mine
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["settings.json"]
    for damaged, want in (("", report.Settings()), ("{", report.Settings()), ("[1]", report.Settings()), ('{"wordsPerMinute": "x", "language": 5, "hiddenWordClasses": ["nouns", 3, "nothing"]}', report.Settings(238, "en", ("nouns",))), ('{"wordsPerMinute": 9999}', report.Settings()), ('{"wordsPerMinute": 99.5, "settingsVersion": 1}', report.Settings(100))):
        (tmp_path / "deep" / ".settings.json.crc").unlink(missing_ok=True)
        (tmp_path / "deep" / "settings.json").write_text(damaged)
        assert report.load_settings(spark, path) == want, damaged


def test_the_last_group_of_a_word_holds(spark):
    from textloom.sources import lexicon

    text = "#nouns\nrun\nsee\n#verbs,nouns?\nrun\n#adverbs\nsee\n"
    got = {r["word"]: [c["cls"] for c in r["classes"]] for r in lexicon.parse_grouped(spark.createDataFrame([(text,)], "value string")).collect()}
    assert got == {"run": ["verbs", "nouns"], "see": ["adverbs"]}


def test_csv_in_spanish(spark):
    from textloom.operators import csv_report

    assert csv_report.TAGS["es"][-1] == "no reconocida" and {len(x) for x in csv_report.TAGS.values()} == {12} and list(csv_report.LABELS_ES) == list(csv_report.LABELS)
    rows = spark.createDataFrame([(1, 1, "vino", 3, 60.0, ["nouns", "verbs"]), (1, 2, "la", 1, 20.0, ["articles"]), (1, 3, "xq", 1, 20.0, ["other"])], "doc_id int, rank int, word string, count long, pct double, classes array<string>")
    totals = spark.createDataFrame([(1, 5, 9, 12, 3)], "doc_id int, words long, chars_no_spaces long, chars_with_spaces long, unique_words long")
    out = csv_report.localised(totals, rows, {"range": "Todo", "headings": "no", "copyright": "no", "toc": "no", "hidden_types": "artículos"}, "es", ("articles",))
    got = [r["line"] for r in out.orderBy("line_no").collect()]
    assert got == [
        "Archivo;1", "Rango;Todo", "Títulos de capítulo / encabezados;no", "Página de derechos de autor;no", "Índice / tabla de contenidos;no", "Tipos de palabra ocultos en la tabla;artículos", "Número de palabras;5",
        "Número de caracteres (sin espacios);9", "Número de caracteres (con espacios);12", "Palabras distintas;3", "", "Palabra;Veces usada;% del total de palabras;Tipo de palabra", "vino;3;60,0000;sustantivo / verbo", "xq;1;20,0000;",
    ]
