"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from textloom import registry
from textloom.sources.model import Document, add_text
from textloom.sources.structure import looks_like_heading, utf16

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def canonical(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    out = QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert got
    if name in SQL:
        cursor = tables.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
        assert canonical(map(tuple, got)) == canonical(want)


def test_plans_have_no_cartesian_product_and_prune_columns(spark):
    plan = QUERIES["corpus_word_freq"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "ReadSchema: struct<text:string>" in plan


def test_queries_on_paragraphs(spark, tmp_path):
    """Texts with blank lines, CR and form feeds against the blocks of the plain-Python rule; the SQL knows lines only."""
    texts = [
        "Chapter One\n\nA paragraph that is\nwrapped the\nway of mail.\n\nNext one,\n  the last. \n", "lone\rreturns\r\nand the\r\rpair\r\rhere", "page the one\n\nwith\nparagraphs\n\n\nend\fpage two\nonly lines\f\f \fPART TWO\nlast",
        "one\ntwo\n\nthree", "plain\nlines", "", " \n\n \f", None, "\nfirst\nthe ot\nher\n", "\tfar\n \t\nnear\n\u2003\nwrap\nped 3.14\n",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, text in enumerate(texts):
        add_text(doc := Document(), text or "")
        want[i] = [(b.t, b.s) for b in doc.blocks]
    assert any(s for blocks in want.values() for _, s in blocks)
    rows = lambda name, *columns: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
    places = [(i, p, t, s) for i, blocks in want.items() for p, (t, s) in enumerate(blocks)]
    assert rows("looks_like_heading", "doc_id", "pos", "heading") == [(i, p, looks_like_heading(t)) for i, p, t, _ in places]
    assert rows("block_offsets", "doc_id", "pos", "offset") == [(i, p, sum(utf16(x) + 1 for x, _ in want[i][:p])) for i, p, _, _ in places]
    sizes = [(i, len(b), sum(len(t) for t, _ in b)) for i, b in want.items() if b]
    for name in ("doc_stats", "doc_stats_from_blocks"):
        assert rows(name, "doc_id", "blocks", "chars_with_spaces") == sizes, name
    assert rows("find_in_text", "doc_id", "pos", "start") == [(i, p, at) for i, p, t, _ in places for at in range(len(t)) if t.lower().startswith("the", at)]
    begins = [(i, p) for i, p, t, s in places if not p or looks_like_heading(t) or s != want[i][p - 1][1]]
    assert rows("segments", "doc_id", "first_pos") == begins
    assert {(i, p) for i, p, _ in rows("select_range", "doc_id", "pos", "t")} <= {(i, p) for i, p, _, _ in places}
    counted = {i: sum(1 for t, _ in b for _ in t.split()) for i, b in want.items() if b}
    assert dict(rows("doc_stats", "doc_id", "words")) == counted
