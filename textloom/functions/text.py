"""Scalar text functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

import functools
import operator
import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions import arrays as A

#: What may part the cells of a CSV text, the likeliest first.
DELIMITERS = (",", ";", "\t", "|")
#: White space that isn't a single space.
_SPACES = f" [{C.SPACE}]++|[[^ -~]&&[{C.SPACE}]][{C.SPACE}]*+"


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search with ASCII word bounds and an end that is the end of the text."""
    return text.rlike("(?iu)" + C.ascii_bounds(pattern).replace("$", r"\z"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{C.SPACE}]++|[{C.SPACE}]++\\z", "")


def normalized(text: Column) -> Column:
    """Invisible characters deleted, white space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"[{C.DELETED}]", ""), _SPACES, " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))


def visible(text: Column) -> Column:
    """A text without the characters that normalising deletes. Its words are those of its blocks, since no word holds white space."""
    return F.regexp_replace(text, f"[{C.DELETED}]", "")


def count_words(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def run_count(text: Column) -> Column:
    """Runs of letters and digits; the word count of the structure rules."""
    return F.regexp_count(text, F.lit(C.RUN))


def chars_with_spaces(text: Column) -> Column:
    return F.char_length(text).cast("long")


def chars_no_spaces(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[{C.SPACE}]", "")).cast("long")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def normalize_word(word: Column) -> Column:
    """Lower case, with plain apostrophes and hyphens; words of ASCII characters hold no others."""
    low = F.lower(word)
    return F.when(F.octet_length(word) == F.char_length(word), low).otherwise(F.translate(low, "’ʼ‐‑", "''--"))


def merge_possessive(word: Column) -> Column:
    base = word.substr(F.lit(1), F.char_length(word) - 2)
    return F.when((F.char_length(word) > 2) & word.endswith("'s") & ~base.isin(C.CONTRACTION_HOSTS), base).otherwise(word)


def reading_time(words: Column, wpm: int = C.READING_WPM) -> Column:
    minutes = F.greatest(F.lit(1), F.floor(words / F.lit(float(wpm or C.READING_WPM)) + 0.5))
    return F.when(F.coalesce(words, F.lit(0)) == 0, "00:00").otherwise(F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60))


def looks_like_heading(text: Column) -> Column:
    """Short lines that read like a title, a chapter number or capitals."""
    words = run_count(text)
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    capitals = (F.char_length(letters) >= 3) & (words <= 8) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    return (
        F.when((F.char_length(text) > 80) | (utf16_length(text) > 80), False)
        .when((words == 0) | (words > 12), False)
        .when(matches(text, C.CHAPTER + r"\b"), ~text.rlike(r"[,;]\z"))
        .when(text.rlike(r"^[IVXLCDM]{1,7}\.?\z") & ~text.isin("I", "I."), True)
        .when(text.rlike(r"^[0-9]{1,3}\.?\z"), True)
        .when(F.regexp_count(text, F.lit("[0-9]")) > 2, False)
        .when(capitals, ~text.rlike(r"[.!?,;:]\z") | text.rlike(r"^[IVXLCDM0-9]+\.\z"))
        .otherwise(False)
    )


def may_be_marked(text: Column) -> Column:
    """Whether a text holds what a copyright mark can't do without: plain searches in its lower case, much cheaper than the patterns.

    Patterns that ignore case take the long s for s, and both Turkish i for i, so here they are the same, too.
    """
    low = F.lower(text)
    for odd, plain in (("ſ", "s"), ("ı", "i"), ("i\u0307", "i")):
        low = F.replace(low, F.lit(odd), F.lit(plain))
    return A.let(low, lambda x: functools.reduce(operator.or_, [x.contains(hint) for hint in C.COPYRIGHT_HINTS]))


def marks_found(text: Column) -> Column:
    """How many of the copyright marks a text holds, each searched for."""
    total = F.lit(0)
    for pattern in C.COPYRIGHT_MARKS:
        total = total + matches(text, pattern).cast("int")
    return total


def marker_count(text: Column) -> Column:
    """How many of the copyright marks a text holds."""
    return F.when(text.isNull() | may_be_marked(text), marks_found(text)).otherwise(0)


def csv_cell(value: Column, delimiter: str = ",") -> Column:
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.contains(delimiter) | text.rlike(r'["\r\n]'), quoted).otherwise(text)


def first_lines(text: Column) -> Column:
    """The lines that :func:`sniff_delimiter` looks at, of the first 20,000 characters."""
    return F.split(text.substr(1, 20_000), "\r?\n", -1)


def sniff_delimiter(lines: Column) -> Column:
    """The delimiter of the first 20 lines that is most even: ten points a line that has as many as the first, and these.

    Lines, counts and scores are each computed once.
    """
    counts = lambda ls, mark: F.filter(F.transform(ls, lambda line: F.char_length(line) - F.char_length(F.replace(line, F.lit(mark), F.lit("")))), lambda n: n > 0)
    same = lambda ns: A.let(F.get(ns, F.lit(0)), lambda first: F.size(F.filter(ns, lambda n: n == first)) * 10 + first)
    score = lambda ls, mark: A.let(counts(ls, mark), lambda ns: F.when(F.size(ns) > 0, same(ns)).otherwise(0))
    # Of equal scores the first mark's counts, so places are negative.
    scored = lambda ls: F.array(*[F.struct(score(ls, mark).alias("score"), F.lit(-i).alias("i"), F.lit(mark).alias("mark")) for i, mark in enumerate(DELIMITERS)])
    best = A.let(F.slice(lines, 1, 20), lambda ls: F.array_max(scored(ls)))
    return A.let(best, lambda x: F.when(x["score"] > 0, x["mark"]).otherwise(","))


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with a name for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running_sql(steps: str) -> str:
    """SQL of the running sums of an array of numbers: within stretches, and over the stretches' sums, so time follows the array."""
    scan = "aggregate({}, {}, (out, x) -> array_append(out, element_at(out, -1) + x))"
    sums = f"transform(ats, at -> aggregate(slice({steps}, at, 256), 0L, (a, x) -> a + x))"
    stretch = "slice(" + scan.format(f"slice({steps}, at, 256)", "array(get(before, i))") + ", 2, 256)"
    whole = _let(scan.format(sums, "array(0L)"), "before", f"flatten(transform(ats, (at, i) -> {stretch}))")
    return _let(f"sequence(1, size({steps}), 256)", "ats", whole)


def _tokens_sql(text: str) -> str:
    """SQL of an array of (start, end, token) of a text's words; offsets count characters from 0."""
    word = C.WORD.replace("\\", "\\\\").replace("'", "\\'")
    placed = "transform(found, (m, i) -> named_struct('start', CAST(get(ends, i) - char_length(m) AS INT), 'end', CAST(get(ends, i) AS INT), 'token', m))"
    steps = "transform(found, (m, i) -> CAST(char_length(m) + char_length(get(gaps, i)) AS BIGINT))"
    filled = _let(f"split({text}, '{word}', -1)", "gaps", _let(steps, "steps", _let(_running_sql("steps"), "ends", placed)))
    none = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, token: STRING>>)"
    return _let(f"regexp_extract_all({text}, '{word}', 0)", "found", f"if(size(found) > 0, {filled}, {none})")


@functools.cache
def word_pattern() -> re.Pattern:
    """The pattern of words for Python, which has no classes of letters, marks and numbers of its own."""

    def ranges(kinds: str) -> str:
        cls = [unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)]
        edges = [c for c in range(0x110000) if cls[c] != (c > 0 and cls[c - 1])]
        return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[::2], [*edges[1::2], 0x110000]))

    inside, number = ranges("LMN"), ranges("N")
    return re.compile(rf"[{inside}]++(?:(?:['’ʼ\-‐‑]|[.,](?=[{number}]))[{inside}]++)*+")


class Tokenize:
    """Table function: the words of a text with their places."""

    def eval(self, text: str):
        for pos, found in enumerate(word_pattern().finditer(text or "")):
            yield pos, found.start(), found.end(), found[0]


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions: the scalar ones have SQL bodies, so Catalyst inlines them.

    ``tokenize(text)`` gives a table (pos, start, end, token), one row a word, for lateral joins: ``SELECT doc_id, w.*
    FROM documents, LATERAL tokenize(text) w``. It is a Python table function, since a lateral join with a SQL one would shuffle
    whole texts. ``tl_token_spans(text)`` gives the same rows as an array within the JVM. Null and empty texts, and texts without a word, have none.
    """
    space, deleted, word = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (C.SPACE, C.DELETED, C.WORD))
    hosts = ", ".join(f"'{w}'" for w in C.CONTRACTION_HOSTS)
    bodies = {
        "tl_normalize(t STRING) RETURNS STRING": f"trim(regexp_replace(regexp_replace(t, '[{deleted}]', ''), '[{space}]+', ' '))",
        "tl_tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(t, '{word}', 0)",
        "tl_count_words(t STRING) RETURNS BIGINT": f"size(regexp_extract_all(t, '{word}', 0))",
        "tl_chars_no_spaces(t STRING) RETURNS BIGINT": f"char_length(regexp_replace(t, '[{space}]', ''))",
        "tl_token_spans(t STRING) RETURNS ARRAY<STRUCT<start: INT, end: INT, token: STRING>>": _tokens_sql("t"),
        "tl_reading_time(words BIGINT, wpm INT) RETURNS STRING": f"if(coalesce(words, 0) = 0, '00:00', format_string('%02d:%02d', CAST(floor(greatest(1, floor(words / CAST(if(wpm > 0, wpm, {C.READING_WPM}) AS DOUBLE) + 0.5)) / 60) AS BIGINT), CAST(greatest(1, floor(words / CAST(if(wpm > 0, wpm, {C.READING_WPM}) AS DOUBLE) + 0.5)) % 60 AS BIGINT)))",
        "tl_csv_cell(v STRING, d STRING) RETURNS STRING": """if(contains(v, d) OR v RLIKE '["\\r\\n]', concat('"', replace(v, '"', '""'), '"'), v)""",
        "tl_normalize_word(w STRING) RETURNS STRING": "translate(lower(w), '’ʼ‐‑', '\\'\\'--')",
        "tl_merge_possessive(w STRING) RETURNS STRING": f"if(char_length(w) > 2 AND endswith(w, '\\'s') AND substr(w, 1, char_length(w) - 2) NOT IN ({hosts}), substr(w, 1, char_length(w) - 2), w)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType="pos int, start int, end int, token string", useArrow=True))
    return [*[head.split("(")[0] for head in bodies], "tokenize"]
