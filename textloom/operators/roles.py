"""Structural roles over an array of blocks, as columns: contents, headings, index and copyright page.

Everything happens inside the row that holds a document's blocks: no shuffle and no Python. Ordered scans are folds that carry what they have
seen; stretches (segments, clusters) come from running values. Each rule looks at what the rules before it have set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions import arrays as A
from textloom.functions import text as T

#: Fixed values of the rules: how far contents reach, how long entries, index lines and copyright pages are.
TOC_REACH, TOC_FRONT, ENTRY_WORDS, LONG_ENTRY_WORDS, INDEX_LINE, PAGE_WORDS, MARKED_WORDS, FRONT_WORDS = 600, 60, 14, 25, 30, 700, 120, 1500
_SEEN = "array<string>"


def entry_key(text: Column) -> Column:
    """An entry of a table of contents without its leader and page number."""
    text = F.regexp_replace(F.lower(text), r"[.…·_\s-]{2,}\s*[0-9]+\s*\z", "")
    text = F.regexp_replace(text, r"\s+[0-9]+\s*\z", "")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def _is_entry(text: Column, runs: Column) -> Column:
    paged = text.rlike(r"(?:\.{2,}|…)\s*[0-9]+\s*\z|\s[0-9]{1,4}\z")
    return (runs <= ENTRY_WORDS) | ((runs <= LONG_ENTRY_WORDS) & paged)


def _contents_end(blocks: Column, at: Column) -> Column:
    """The last block of the list that follows a title of contents at a place (from 0), or the title itself."""
    start = F.struct(F.expr(f"cast(array() as {_SEEN})").alias("seen"), at.cast("int").alias("end"), F.get(blocks, at)["s"].alias("s"), F.lit(True).alias("go"))

    def step(state: Column, b: Column) -> Column:
        runs, key = T.run_count(b["t"]), entry_key(b["t"])

        def taken(seen: tuple[Column, Column]) -> Column:
            runs, key = seen
            chapter = (b["k"] == "h") & (b["s"] != state["s"]) & (F.size(state["seen"]) > 2)
            fits = ~F.array_contains(state["seen"], key) & _is_entry(b["t"], runs) & ~chapter
            more = F.when(key == "", state["seen"]).otherwise(F.array_append(state["seen"], key))
            return F.struct(F.when(fits, more).otherwise(state["seen"]).alias("seen"), (state["end"] + fits.cast("int")).alias("end"), b["s"].alias("s"), fits.alias("go"))

        one = F.struct(runs.alias("runs"), key.alias("key"))
        return F.when(state["go"], A.let(one, lambda x: taken((x["runs"], x["key"])))).otherwise(state)

    return F.aggregate(F.slice(blocks, at + 2, F.lit(TOC_REACH - 1)), start, step)["end"]


def _with_role(blocks: Column, role: Column) -> Column:
    """Blocks with another role; ``role(block, place)`` gives null where the block keeps its own."""
    return F.transform(blocks, lambda b, i: F.struct(b["t"].alias("t"), b["k"].alias("k"), F.coalesce(role(b, i), b["r"]).alias("r"), b["s"].alias("s")))


def mark_contents(blocks: Column) -> Column:
    """The first title of contents near the front that two entries or more follow, and these, become ``toc``."""
    front = F.greatest(F.lit(TOC_FRONT), F.floor(F.size(blocks) * 0.3).cast("int"))
    titles = F.filter(F.transform(F.slice(blocks, F.lit(1), front), lambda b, i: F.when(T.matches(b["t"], C.TOC_TITLE), i)), lambda i: i.isNotNull())
    lists = F.filter(F.transform(titles, lambda i: F.struct(i.alias("at"), _contents_end(blocks, i).alias("end"))), lambda x: x["end"] - x["at"] >= 2)
    return A.let(F.get(lists, F.lit(0)), lambda x: F.when(x.isNull(), blocks).otherwise(_with_role(blocks, lambda b, i: F.when(i.between(x["at"], x["end"]), "toc"))))


def mark_headings(blocks: Column) -> Column:
    """Blocks without a role that read like a heading become headings."""
    kind = lambda b: F.when(b["r"].isNull() & T.looks_like_heading(b["t"]), "h").otherwise(b["k"])
    return F.transform(blocks, lambda b: F.struct(b["t"].alias("t"), kind(b).alias("k"), b["r"].alias("r"), b["s"].alias("s")))


def mark_index(blocks: Column) -> Column:
    """The last title of an index that three lines or more of an index follow, and these, become ``index`` where they have no role."""
    n = F.size(blocks)
    tail = F.slice(blocks, F.floor(n * 0.6).cast("int") + 1, n)
    offset = n - F.size(tail)

    def found(lines: Column) -> Column:
        """``lines`` are (runs, listed) of the tail; counts and the next long line come from running values."""
        listed = A.running(F.transform(lines, lambda x: x["listed"].cast("int")), lambda a, b: a + b)
        size = F.size(lines)
        stops = F.reverse(A.running(F.reverse(F.transform(lines, lambda x, i: F.when(x["runs"] > INDEX_LINE, i).otherwise(size))), lambda a, b: F.least(a, b)))

        def chosen(both: Column) -> Column:
            stop = lambda i: F.coalesce(F.get(both["stops"], i + 1), size)
            enough = lambda i: F.get(both["listed"], stop(i) - 1) - F.get(both["listed"], i) >= 3
            at = F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(x["title"] & enough(i), i)), lambda i: i.isNotNull()))
            return A.let(at, lambda i: F.struct(i.alias("at"), stop(i).alias("stop")))

        return A.let(F.struct(listed.alias("listed"), stops.alias("stops")), chosen)

    def line(b: Column) -> Column:
        runs = T.run_count(b["t"])
        return A.let(runs, lambda n: F.struct(n.alias("runs"), ((n <= 3) | b["t"].rlike("[0-9]")).alias("listed"), T.matches(b["t"], C.INDEX_TITLE).alias("title")))

    lines = F.transform(tail, line)
    marked = lambda x: _with_role(blocks, lambda b, i: F.when(b["r"].isNull() & (i >= x["at"] + offset) & (i < x["stop"] + offset), "index"))
    titled = F.exists(tail, lambda b: T.matches(b["t"], C.INDEX_TITLE))
    return F.when(titled, A.let(lines, lambda ls: A.let(found(ls), lambda x: F.when(x["at"].isNull(), blocks).otherwise(marked(x))))).otherwise(blocks)


def _ends(starts: Column, size: Column) -> Column:
    """(from, to) of stretches that begin at ascending places; ``to`` is not in."""
    return F.transform(starts, lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(starts, i + 1), size).alias("b")))


def mark_copyright(blocks: Column) -> Column:
    """Short segments near front or back full of copyright marks; without one, clusters of marked blocks near the front.

    No mark reaches over the end of a block without a hint of its own, so words are counted and marks searched for only where a block holds one.
    """
    n = F.size(blocks)
    runs = F.transform(blocks, lambda b: T.run_count(b["t"]).cast("long"))
    totals = A.running(runs, lambda a, b: a + b)
    hinted = F.transform(blocks, lambda b: F.coalesce(T.may_be_marked(b["t"]), F.lit(False)))

    def ruled(w: Column, hints: Column) -> Column:
        """``w``: words up to each block, itself included; ``hints``: whether it may hold a mark."""
        before = lambda i: F.when(i > 0, F.get(w, i - 1)).otherwise(F.lit(0).cast("long"))
        total = F.coalesce(F.get(w, n - 1), F.lit(0).cast("long"))
        front, back = F.greatest(total * 0.25, F.lit(float(FRONT_WORDS))), total * 0.9
        begins = F.transform(blocks, lambda b, i: F.when((i == 0) | (b["k"] == "h") | (b["s"] != F.get(blocks, i - 1)["s"]), i))

        def page(x: Column) -> Column:
            seen, own = before(x["a"]), F.slice(blocks, x["a"] + 1, x["b"] - x["a"])
            hint = F.array_contains(F.slice(hints, x["a"] + 1, x["b"] - x["a"]), True)
            short = hint & ((seen <= front) | (seen >= back)) & (before(x["b"]) - seen <= PAGE_WORDS) & ~F.exists(own, lambda b: b["r"].isNotNull())
            text = F.concat(F.array_join(F.transform(own, lambda b: b["t"]), "\n"), F.lit("\n"))
            full = lambda t: A.let(T.marks_found(t), lambda m: (m >= 3) | ((m == 2) & T.matches(t, "©|copyright|all rights reserved")))
            return F.when(short, A.let(text, full)).otherwise(False)

        segments = A.let(F.filter(begins, lambda i: i.isNotNull()), lambda starts: _ends(starts, n))
        pages = F.filter(segments, page)

        def clusters() -> Column:
            mark = lambda b, i: F.when(F.get(hints, i) & (before(i) <= front) & b["r"].isNull() & (T.run_count(b["t"]) <= MARKED_WORDS), T.marks_found(b["t"])).otherwise(0)
            marked = F.filter(F.transform(blocks, lambda b, i: F.struct(i.alias("i"), mark(b, i).alias("m"))), lambda x: x["m"] > 0)

            def grouped(ms: Column) -> Column:
                starts = F.filter(F.transform(ms, lambda x, k: F.when((k == 0) | (x["i"] - F.get(ms, k - 1)["i"] > 3), k)), lambda k: k.isNotNull())
                own = lambda g: F.slice(ms, g["a"] + 1, g["b"] - g["a"])
                span = lambda g: F.struct(F.get(ms, g["a"])["i"].alias("a"), (F.get(ms, g["b"] - 1)["i"] + 1).alias("b"), F.aggregate(own(g), F.lit(0), lambda s, x: s + x["m"]).alias("m"))
                groups = F.transform(A.let(starts, lambda at: _ends(at, F.size(ms))), span)
                kept = F.filter(groups, lambda g: (g["m"] >= 2) & (before(g["b"]) - before(g["a"]) <= PAGE_WORDS))
                return F.transform(kept, lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b")))

            return A.let(marked, grouped)

        def marked(spans: Column) -> Column:
            # The spans lie apart and ascend, so a block's is found among those of its beginnings.
            inside = F.flatten(F.transform(spans, lambda x: F.sequence(x["a"], x["b"] - 1)))
            places = lambda at: _with_role(blocks, lambda b, i: F.when(b["r"].isNull() & F.get(at, i), "copyright"))
            flags = A.let(inside, lambda xs: F.map_from_entries(F.transform(xs, lambda i: F.struct(i, F.lit(True)))))
            return A.let(flags, lambda m: A.let(F.transform(blocks, lambda b, i: F.coalesce(F.try_element_at(m, i), F.lit(False))), places))

        chosen = A.let(pages, lambda ps: F.when(F.size(ps) > 0, ps).otherwise(clusters()))
        return A.let(chosen, lambda spans: F.when(F.size(spans) > 0, marked(spans)).otherwise(blocks))

    return A.let(hinted, lambda hints: F.when(F.array_contains(hints, True), A.let(totals, lambda w: ruled(w, hints))).otherwise(blocks))


def structured(blocks: Column) -> Column:
    """The blocks with the roles and headings that their format didn't give: contents first, then headings, index and copyright page."""

    def has(found: Column, role: str) -> Column:
        return F.exists(found, lambda b: b["r"].eqNullSafe(role))

    def then(found: Column, known, rule) -> Column:
        return A.let(found, lambda bs: F.when(known(bs), bs).otherwise(rule(bs)))

    found = then(blocks, lambda bs: has(bs, "toc"), mark_contents)
    found = then(found, lambda bs: F.exists(bs, lambda b: b["k"] == "h"), mark_headings)
    found = then(found, lambda bs: has(bs, "index"), mark_index)
    return then(found, lambda bs: has(bs, "copyright"), mark_copyright)


def caps(blocks: Column) -> Column:
    """What a document's blocks hold: headings, a copyright page, contents or an index."""
    any_ = lambda test: F.exists(blocks, test)
    role = lambda *names: any_(lambda b: F.coalesce(b["r"].isin(*names), F.lit(False)))
    return F.struct(any_(lambda b: b["k"] == "h").alias("headings"), role("copyright").alias("copyright"), role("toc", "index").alias("toc"))


def with_structure(docs: DataFrame, blocks_col: str = "blocks", heuristics: bool = True) -> DataFrame:
    """``docs`` with roles and headings set in its blocks, and ``caps`` and ``warnings``; null blocks count as none."""
    none = F.expr("cast(array() as array<struct<t:string,k:string,r:string,s:int>>)")
    blocks = F.coalesce(F.col(f"`{blocks_col}`"), none)
    out = docs.withColumn(blocks_col, structured(blocks) if heuristics else blocks)
    return with_caps(out, blocks_col)


def with_caps(docs: DataFrame, blocks_col: str = "blocks") -> DataFrame:
    """``docs`` with ``caps`` and ``warnings`` of its blocks, formed once: the array passes an explode, which no filter is inferred from."""
    once = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != blocks_col], F.explode(F.array(F.col(f"`{blocks_col}`"))).alias(blocks_col))
    warnings = F.when(F.size(blocks_col) == 0, F.array(F.lit("noText"))).otherwise(F.expr("cast(array() as array<string>)"))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns], caps(F.col(f"`{blocks_col}`")).alias("caps"), warnings.alias("warnings"))
