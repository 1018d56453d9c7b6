"""Micro-cases of the scalar functions, most of them traps of patterns and Unicode."""

import pytest
from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions import classes as K
from textloom.functions import text as T
from textloom.operators import report


def value(spark, text, column, **more):
    frame = spark.createDataFrame([(text,)], "x string")
    return frame.select(column(F.col("x")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("don’t mother-in-law 3.14 1,000 end. parents' father's 3.a a.3", ["don’t", "mother-in-law", "3.14", "1,000", "end", "parents", "father's", "3", "a", "a.3"]),
        ("1.2.3 x--y 'q' 2nd 3.º", ["1.2.3", "x", "y", "q", "2nd", "3", "º"]),
        ("", []),
        ("a-" * 30_000 + "a", ["a-" * 30_000 + "a"]),
    ],
)
def test_tokens(spark, text, want):
    assert value(spark, text, T.tokens) == want


def test_scalars(spark):
    assert value(spark, "Don’T", T.normalize_word) == "don't"
    assert value(spark, "co‑op", T.normalize_word) == "co-op"
    for word, want in {"father's": "father", "it's": "it's", "let's": "let's", "'s": "'s", "a's": "a"}.items():
        assert value(spark, word, T.merge_possessive) == want
    assert value(spark, "a😀 b", T.chars_with_spaces) == 4
    assert value(spark, "a😀\u00a0b\ufeff", T.chars_no_spaces) == 3
    assert value(spark, "a😀", T.utf16_length) == 3
    assert value(spark, "\u00a0a\u00ad b\u2009\u200b c\n", T.normalized) == "a b c"
    assert value(spark, "ÍNDICE", lambda c: T.matches(c, C.TOC_TITLE))
    assert value(spark, "parté", lambda c: T.matches(c, C.CHAPTER + r"\b"))  # an ASCII boundary stands before é
    assert not value(spark, "Contents\nx", lambda c: T.matches(c, C.TOC_TITLE))


@pytest.mark.parametrize("text, want", [("Chapter 3", True), ("PART TWO", True), ("I", False), ("IV.", True), ("Chapter 3,", False), ("ISBN 978-0-00-000000-0", False), ("x" * 81, False), ("12.", True), ("A plain line of words", False)])
def test_headings(spark, text, want):
    from textloom.sources.structure import looks_like_heading

    assert value(spark, text, T.looks_like_heading) is want
    assert looks_like_heading(text) is want


@pytest.mark.parametrize("words, wpm, want", [(0, 238, "00:00"), (1, 238, "00:01"), (476, 238, "00:02"), (238_000, 238, "16:40"), (357, 238, "00:02")])
def test_reading_time(spark, words, wpm, want):
    assert spark.range(1).select(T.reading_time(F.lit(words), wpm).alias("v")).first()["v"] == want


def test_numbers_and_classes(spark):
    for word, want in {"7": True, "1,000": True, "1990s": True, "21st": True, "twenty-one": True, "well-known": False}.items():
        assert value(spark, word, K.is_number) is want
    for word, language, want in [("the", "en", "articles"), ("el", "es", "articles"), ("and", "en", "conjunctions"), ("y", "es", "conjunctions"), ("seven", "en", "numbers"), ("siete", "es", "numbers"), ("xyz", "en", "other"), ("séptimas", "es", "numbers")]:
        assert value(spark, word, lambda c: K.fallback_classes(c, language)) == [want]


def test_lexicon_classes(spark):
    kind = "word string, classes array<struct<cls:string,rare:boolean>>"
    english = spark.createDataFrame([("father", [("nouns", False), ("verbs", True)]), ("the", [("determiners", False), ("adjectives", True)]), ("law", [("nouns", False)]), ("seven", [("nouns", False)])], kind)
    words = spark.createDataFrame([(w,) for w in ["father", "father's", "don't", "mother-in-law", "the", "seven", "zzz", "well-of"]], "word string")
    got = {r["word"]: r["classes"] for r in K.with_classes(words, english).collect()}
    assert got == {"father": ["nouns", "verbs"], "father's": ["nouns", "verbs"], "don't": ["verbs"], "mother-in-law": ["nouns"], "the": ["articles"], "seven": ["numbers"], "zzz": ["other"], "well-of": ["prepositions"]}
    spanish = spark.createDataFrame([("di", [("verbs", False)]), ("hacer", [("verbs", False)]), ("vamos", [("verbs", False)]), ("casa", [("verbs", True)])], kind)
    words = spark.createDataFrame([(w,) for w in ["dímelo", "hacerlo", "vámonos", "casala", "rápidamente"]], "word string")
    got = {r["word"]: r["classes"] for r in K.with_classes(words, spanish, "es").collect()}
    assert got == {"dímelo": ["verbs"], "hacerlo": ["verbs"], "vámonos": ["verbs"], "casala": ["other"], "rápidamente": ["adverbs"]}


def test_csv_cells_and_sql_functions(spark):
    assert value(spark, "a,b", T.csv_cell) == '"a,b"'
    assert value(spark, 'say "x"', T.csv_cell) == '"say ""x"""'
    assert "tl_tokens" in T.register(spark)
    assert spark.sql("SELECT tl_tokens('a b-c') t, tl_merge_possessive(tl_normalize_word('Dad’s')) w").first() == (["a", "b-c"], "dad")


def test_word_at_and_find(spark):
    text = F.lit("one two-three. four")
    at = lambda offset, end=False: tuple(spark.range(1).select(report.word_at(text, F.lit(offset), end).alias("v")).first()["v"])
    assert at(0) == (0, 3) and at(3) == (4, 13) and at(13, True) == (4, 13) and at(99) == (15, 19)
    blocks = spark.createDataFrame([(1, 0, "The tHe.the"), (1, 1, "none")], "doc_id int, pos int, t string")
    assert [tuple(r) for r in report.find_in_text(blocks, " THE ").orderBy("pos", "start").collect()] == [(1, 0, 0, 3), (1, 0, 4, 7), (1, 0, 8, 11)]
    assert report.find_in_text(blocks, "t").count() == 0


def test_range_and_settings(spark):
    with pytest.raises(ValueError):
        report.ReportConfig(start=report.Point(2, 0), end=report.Point(1, 5))
    blocks = spark.createDataFrame([(0, "Title", "h", "toc"), (1, "alpha beta", "p", None), (2, "rights", "p", "copyright"), (3, "gamma delta", "p", None)], "pos int, t string, k string, r string")
    got = report.select_blocks(blocks, report.ReportConfig(report.Point(1, 5), report.Point(3, 6))).orderBy("pos")
    assert [r["t"] for r in got.collect()] == ["beta", "gamma"]
    assert report.select_blocks(blocks, report.ReportConfig(include_headings=True)).count() == 2
    assert report.Settings(5, "fr", ("nouns", "no")) == report.Settings(238, "en", ("nouns",))  # out of bounds: the default, not the nearest bound
