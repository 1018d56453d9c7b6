"""What plans of the queries must not do, since it would outgrow the input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom import constants as C
from textloom import registry
from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import report
from textloom.sources import markup

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()
ODD = ["Soft­ly, 3.­5 and﻿3.5 it's​ it’s\r\nTHE the\f\n\nthe  Straße ΑΣ'Β ΑΣ.Α wrap-\nped é é", "the The\n \n\nx\n\n", "...", "", None, "b a b\ra\x1fb", "İ i̇ Ǆ ǆ 1st 1,000.5"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_split_once_for_a_delimiter(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert plan(docs.select(T.sniff_delimiter(T.first_lines(F.col("text"))))).count("split(") <= 2  # a plan shows what a lambda captures twice


def test_csv_patterns_are_fixed(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    rows = B.csv_blocks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_extract_all\(__text#\d+, concat", rows)


def test_pages_are_handled_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = spark.createDataFrame([(i, f"<p>{i}</p>" * (i % 7)) for i in range(2_500)], "page_id long, html string").coalesce(1)
    got = B.exploded(markup.html_to_blocks(pages), "page_id")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
    assert Counter(r["page_id"] for r in got.collect()) == Counter({i: i % 7 for i in range(2_500) if i % 7})
    large = markup.SLICE
    assert list(markup._cuts([1, large, large, 5, 6, 0])) == [(0, 1), (1, 2), (2, 3), (3, 6)] and list(markup._cuts([])) == []


@pytest.mark.parametrize("name", ["doc_word_freq", "doc_top_words", "max_pct", "csv_report_blocks", "class_counts"])
def test_words_of_documents_are_not_shuffled(spark, name):
    found = plan(QUERIES[name](spark, DATA))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", found)
    assert len([x for x in exchanges if x.startswith("doc_id#")]) == 1 and not any("word" in x for x in exchanges)
    assert "Window" not in found and found.count("FileScan") == 1


def test_classes_are_told_once_a_word(spark):
    """A filter by class must not move below the counts."""
    found = QUERIES["word_filter_view"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "THEN articles" not in found[found.index("Aggregate") :]


@pytest.mark.parametrize("name", ["second_page"])
def test_a_page_is_planned_without_a_pass(spark, name):
    context = spark.sparkContext

    def jobs(query) -> int:
        context.setJobGroup(f"planning-{query}", "")
        QUERIES[query](spark, DATA)
        return len(context.statusTracker().getJobIdsForGroup(f"planning-{query}"))

    assert jobs(name) == jobs("corpus_word_freq")


@pytest.mark.parametrize("name", ["function_word_classes_es", "lexicon_classes_es", "corpus_word_freq", "word_freq_possessive", "top_words"])
def test_words_need_no_blocks(spark, name):
    assert "\\A[" not in plan(QUERIES[name](spark, DATA))


def test_words_of_texts_are_those_of_blocks(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(report.words(B.exploded(B.with_blocks(docs)), ("doc_id",)))
    assert want and rows(report.text_words(docs, ("doc_id",))) == want


def test_documents_of_one_id_count_together(spark, tmp_path):
    texts = [(i % 3, t) for i, t in enumerate(ODD * 3)] + [(None, "null id")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counted = Counter(map(tuple, report.words(B.exploded(B.with_blocks(docs)), ("doc_id",)).collect()))
    total = Counter()
    for (i, _), n in counted.items():
        total[i] += n
    rows = QUERIES["doc_word_freq"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["word"]): (r["count"], round(r["pct"], 9)) for r in rows} == {k: (n, round(n / total[k[0]] * 100, 9)) for k, n in counted.items()}
    ranked = report.ranked(report.frequency(report.words(B.exploded(B.with_blocks(docs)), ("doc_id",)), ("doc_id",)), ("doc_id",))
    key = lambda r: (r[0] is None, *r) if r[0] is not None else (True, 0, *r[1:])
    order = ("doc_id", "word", "count", "rank")
    got = QUERIES["doc_top_words"](spark, str(tmp_path)).select(*order).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, ranked.where("rank <= 10").select(*order).collect()), key=key)
    lines = {(r["doc_id"], r["line_no"]): r["line"] for r in QUERIES["csv_report_blocks"](spark, str(tmp_path)).collect()}
    assert all(lines[r["doc_id"], r["rank"] + 10].split(",")[-2] == str(r["count"]) for r in ranked.collect())
    assert lines[0, 8] == f"Unique words,{len([1 for i, _ in counted if i == 0])}" and lines[0, 5] == f"Word count,{total[0]}"


def test_texts_without_anything_to_normalise_are_split_only(spark):
    """The first branch must split and no more, and take no text that the others would change."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    branch = plan(B.with_blocks(docs)).split("CASE WHEN ")[1].split(" WHEN ")[0]
    assert "split(" in branch and "regexp_replace(" not in branch
    chars = spark.range(1, 0x110000).where("id not between 55296 and 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    both = chars.where(F.col("c").rlike(f"^{C.PLAIN}\\z") & F.col("c").rlike(f"^[{C.SPACE}{C.DELETED}]\\z"))
    assert [r["id"] for r in both.orderBy("id").collect()] == [10, 32]
    odd = ["a  b", " a", "a ", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "a\tb\nc", "a\u200bb", "", " ", "\n", "a\nb\n\n \nc", "é\u3000中", "a b\nc 😀 “d”"]
    texts = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("mark", F.lit("\u00ad"))
    marked = F.when(F.col("text") == "", "").otherwise(F.concat("text", "mark"))  # a deleted character at the end sends a text the long way
    for r in texts.select("text", B.text_blocks(F.col("text")).alias("short"), B.text_blocks(marked).alias("long")).collect():
        assert r["short"] == r["long"], r["text"]
