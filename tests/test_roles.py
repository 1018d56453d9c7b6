"""Roles as columns against the plain rules of the readers."""

import random

from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import roles
from textloom.sources.model import Block, Document
from textloom.sources.structure import caps, finish

LINES = [
    "Contents", "Table of Contents:", "Índice", "Index", "Subject Index", "register.", "Chapter One", "Chapter Two", "Chapter One .... 5", "chapter two 17", "Part I, then", "IV", "I.", "12", "THE END", "STOP!",
    "Copyright © 2001 by A", "ISBN 123", "All rights reserved.", "Published by B in C", "No part of this book may", "First edition", "printed in D", "a, 3, 7", "apple 12", "pear 5, 6", "short", "…… 9", "x" * 90,
    "some words that go on " * 4, "a longer line of text with more than thirty words in it " * 4, "body text of a dozen words that is not an entry at all, so long it is " * 2, "word " * 130, "word " * 800, "many words here " * 400,
]


def cases():
    rng = random.Random(8)
    for n in range(1500):
        weights = rng.choice([LINES, LINES[:29], LINES[16:23] + LINES[29:33], LINES[:16], LINES[3:6] + LINES[23:33]])
        size = rng.choice([0, 1, 3, 8, 20, 60, 120]) if n % 20 else 300
        section, out = 0, []
        for _ in range(size):
            section += rng.random() < 0.1
            kind = "h" if n % 3 == 0 and rng.random() < 0.1 else "p"
            role = rng.choice(["toc", "index", "copyright"]) if n % 7 == 0 and rng.random() < 0.05 else None
            out.append((rng.choice(weights), kind, role, section))
        yield out
    entries = [(f"Entry number {i} .... {i}", "p", None, 0) for i in range(700)]
    yield [("Contents", "p", None, 0), *entries]
    yield [("Index", "p", None, 0)] * 4000
    yield [("contents", "p", None, 0), ("One", "p", None, 0), ("Two", "p", None, 0), ("Three", "p", None, 0), ("Four", "h", None, 1), ("One", "h", None, 2)]


def test_roles_are_those_of_the_readers(spark):
    docs = list(cases())
    frame = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "doc_id int, blocks array<struct<t:string,k:string,r:string,s:int>>, caps string").drop("caps").repartition(8)
    got = {r["doc_id"]: r for r in roles.with_structure(frame).collect()}
    seen = set()
    for i, d in enumerate(docs):
        doc = finish(Document([Block(*b) for b in d]))
        assert [(b["k"], b["r"]) for b in got[i]["blocks"]] == [(b.k, b.r) for b in doc.blocks], d[:40]
        assert got[i]["caps"].asDict() == caps(doc.blocks) and got[i]["warnings"] == doc.warnings
        seen |= {b.r for b in doc.blocks}
    assert seen == {None, "toc", "index", "copyright"}


def test_one_row_stays_one_row(spark):
    docs = spark.createDataFrame([(1, "Contents\nOne\nTwo\nThree"), (2, None), (3, "")], "doc_id int, text string")
    out = roles.with_structure(B.with_blocks(docs))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [b["r"] for b in rows[1]["blocks"]] == ["toc"] * 4 and rows[1]["caps"]["toc"] and rows[2]["warnings"] == rows[3]["warnings"] == ["noText"]
    assert roles.with_structure(spark.createDataFrame([(1, None)], f"doc_id int, blocks array<{B.BLOCK}>")).first()["blocks"] == []
    assert roles.with_structure(B.with_blocks(docs).withColumn("text", F.lit(1)), heuristics=False).where("caps.toc").count() == 0


def test_marks_are_searched_only_behind_a_hint(spark):
    """Plain searches come before the counts of words and the patterns; they let pass whatever the patterns could match."""
    plan = spark.createDataFrame([], f"blocks array<{B.BLOCK}>").select(roles.mark_copyright(F.col("blocks")))._jdf.queryExecution().analyzed().toString()
    assert 0 <= plan.find("contains(") < plan.find("regexp_count(") and C.COPYRIGHT_HINT not in plan
    spelled = [f(h).replace(a, b) for h in C.COPYRIGHT_HINTS for f in (str.lower, str.upper, str.title) for a, b in (("", ""), ("i", "ı"), ("i", "İ"), ("I", "ı"), ("s", "ſ"), ("S", "ſ"), ("e", "é"), ("E", "É"))]
    texts = spark.createDataFrame([(f"Straße {x}Σ",) for x in spelled] + [("",), ("no mark",)], "t string")
    rows = texts.select("t", F.col("t").rlike("(?iu)" + C.COPYRIGHT_HINT).alias("pattern"), T.may_be_marked(F.col("t")).alias("hint")).collect()
    assert sum(r["pattern"] for r in rows) > 250 and all(r["hint"] for r in rows if r["pattern"]) and not rows[-1]["hint"] and not rows[-2]["hint"]
