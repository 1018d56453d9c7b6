"""Statistics, selection, word frequency, views and CSV lines over blocks and texts."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import constants as C
from textloom.functions import arrays as A
from textloom.functions import messages as M
from textloom.functions import text as T
from textloom.operators.blocks import text_blocks

ENGLISH_HINTS = "the and of to a in is that it was he for with as his on be at by i you she they not but had have this".split()  # fixed values
SPANISH_HINTS = "de la que el en y los del se las por un para con no una su al es lo como más pero sus le ya o fue este ha muy".split()  # fixed values


#: Lines of a settings file that are read.
SETTINGS_LINES = 1_000


@dataclass(frozen=True)
class Point:
    """A place in a document: block position and character offset."""

    block: int
    offset: int


@dataclass(frozen=True)
class ReportConfig:
    """What a report covers. The default leaves out headings, the copyright page, contents and index."""

    start: Point | None = None
    end: Point | None = None
    include_headings: bool = False
    include_copyright: bool = False
    include_toc: bool = False
    merge_possessive: bool = True
    text_language: str = "en"

    def __post_init__(self):
        if self.start and self.end and (self.start.block, self.start.offset) >= (self.end.block, self.end.offset):
            raise ValueError("the start must lie before the end")


@dataclass(frozen=True)
class Settings:
    """Reading speed, interface language, and word types hidden from the table; what is out of bounds or unknown takes its default."""

    words_per_minute: int = C.READING_WPM
    language: str = "en"
    hidden_word_classes: tuple[str, ...] = field(default=())

    def __post_init__(self):
        wpm = self.words_per_minute
        wpm = math.floor(wpm + 0.5) if isinstance(wpm, (int, float)) and math.isfinite(wpm) else C.READING_WPM
        object.__setattr__(self, "words_per_minute", wpm if C.WPM_LEAST <= wpm <= C.WPM_MOST else C.READING_WPM)
        object.__setattr__(self, "language", self.language if self.language in ("en", "es") else "en")
        object.__setattr__(self, "hidden_word_classes", tuple(c for c in self.hidden_word_classes if c in C.CLASSES))


def load_settings(spark: SparkSession, path: str) -> Settings:
    """Settings from a JSON file on any file system that Spark reads; what is missing, damaged or of another kind takes its default."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(file):
        return Settings()
    try:
        stored = json.loads("\n".join(r["value"] for r in spark.read.text(path).limit(SETTINGS_LINES).collect()))
    except ValueError:
        return Settings()
    stored = stored if isinstance(stored, dict) else {}
    hidden = stored.get("hiddenWordClasses")
    speed = stored.get("wordsPerMinute")
    return Settings(
        speed if isinstance(speed, (int, float)) and not isinstance(speed, bool) else C.READING_WPM,
        stored.get("language") if isinstance(stored.get("language"), str) else "en",
        tuple(c for c in hidden if isinstance(c, str)) if isinstance(hidden, list) else (),
    )


def save_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    """Write settings beside their place and move them there, so a reader finds the old file or the new one, never a half."""
    fs = spark._jvm.org.apache.hadoop.fs
    file, part = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    text = json.dumps({"wordsPerMinute": settings.words_per_minute, "language": settings.language, "hiddenWordClasses": list(settings.hidden_word_classes), "settingsVersion": 2}, indent=2)
    out = system.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(part, file):  # file systems that don't move onto a file
        system.delete(file, False)
        if not system.rename(part, file):
            system.delete(part, False)
            raise OSError(f"settings could not be moved to {path}")


def stats(blocks: DataFrame, *keys: str) -> DataFrame:
    """Words and characters of all blocks of each key; breaks between blocks are not counted."""
    t = F.col("t")
    one = blocks.select(*keys, T.count_words(t).alias("w"), T.chars_with_spaces(t).alias("a"), T.chars_no_spaces(t).alias("n"))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum("w").alias("words"), F.sum("a").alias("chars_with_spaces"), F.sum("n").alias("chars_no_spaces"))


def _joined_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, t, chars_with_spaces, chars_no_spaces: the blocks of each text, their number, joined by line ends, and their characters."""
    lines = F.transform(text_blocks(F.col(text_col)), lambda b: b["t"])
    once = docs.select(id_col, F.explode(F.array(lines)).alias("lines"))  # else the filter below forms all blocks again
    whole = once.select(id_col, F.size("lines").alias("n"), F.array_join("lines", "\n").alias("t"))
    breaks = F.greatest(F.col("n") - 1, F.lit(0))
    return whole.where("n > 0").select(id_col, "n", "t", (T.chars_with_spaces(F.col("t")) - breaks).alias("chars_with_spaces"), T.chars_no_spaces(F.col("t")).alias("chars_no_spaces"))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`stats` of texts, row by row: no shuffle at all. Texts without a block have no row."""
    return _joined_blocks(docs, id_col, text_col).select(id_col, F.col("n").cast("long").alias("blocks"), T.count_words(F.col("t")).alias("words"), "chars_with_spaces", "chars_no_spaces")


def select_blocks(blocks: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """The blocks a report covers, the first and last cut at the range's offsets."""
    out = blocks
    if config.start:
        out = out.where(F.col("pos") >= config.start.block)
    if config.end:
        out = out.where(F.col("pos") <= config.end.block)
    if not config.include_headings:
        out = out.where("k <> 'h'")
    if not config.include_copyright:
        out = out.where("coalesce(r, '') <> 'copyright'")
    if not config.include_toc:
        out = out.where("coalesce(r, '') not in ('toc', 'index')")
    first = F.lit(0) if not config.start else F.when(F.col("pos") == config.start.block, config.start.offset).otherwise(0)
    size = F.char_length("t")
    last = size if not config.end else F.when(F.col("pos") == config.end.block, F.least(size, F.lit(config.end.offset))).otherwise(size)
    cut = F.expr("t").substr(first + 1, F.greatest(last - first, F.lit(0)))
    out = out.withColumn("t", F.when((first > 0) | (last < size), T.trimmed(cut)).otherwise(F.col("t")))
    return out.where("t <> ''")


def words(texts: DataFrame, keys: tuple[str, ...] = (), text_col: str = "t", merge_possessive: bool = False) -> DataFrame:
    """One row per token: keys, normalised word. The outer form: an inferred filter on the array's size would find all tokens twice."""
    word = T.normalize_word(F.col("token"))
    out = texts.select(*keys, F.explode_outer(T.tokens(F.col(text_col))).alias("token")).where("token is not null")
    return out.select(*keys, (T.merge_possessive(word) if merge_possessive else word).alias("word"))


def text_words(texts: DataFrame, keys: tuple[str, ...] = (), text_col: str = "text", merge_possessive: bool = False) -> DataFrame:
    """:func:`words` of all blocks of texts, found without forming the blocks."""
    return words(texts.select(*keys, T.visible(F.col(text_col)).alias("t")), keys, "t", merge_possessive)


def _counted(ws: Column) -> Column:
    """Array of (word, count) of an array of words that holds one at least: sorted, equal words stand together."""

    def stretches(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        return A.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("word"), (end(at, k) - i).cast("long").alias("count"))))

    return A.let(F.sort_array(ws), stretches)


def _documents_counted(texts: DataFrame, id_col: str, text: Column, *sums: str) -> DataFrame:
    """id, sums, total, counts: the words of each document as an array of (word, count); documents without a word have no row.

    Texts of one id meet in one shuffle of the texts, which weighs less than their distinct words with keys and counts; all else happens within the row.
    """
    met = texts.select(id_col, text.alias("__t"), *sums).groupBy(id_col).agg(F.collect_list("__t").alias("__t"), *[F.sum(c).alias(c) for c in sums])
    found = F.transform(T.tokens(F.array_join("__t", "\n")), T.normalize_word)
    once = met.select(id_col, *sums, F.explode(F.array(found)).alias("__ws")).where("size(__ws) > 0")
    return once.select(id_col, *sums, F.size("__ws").cast("long").alias("total"), F.explode(F.array(_counted(F.col("__ws")))).alias("counts"))


def doc_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, total, counts) of whole texts; see :func:`doc_frequency` and :func:`doc_ranked` for a row a word."""
    return _documents_counted(docs, id_col, T.visible(F.col(text_col)))


def doc_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, count, pct): :func:`frequency` of every document."""
    rows = doc_counts(docs, id_col, text_col).select(id_col, "total", F.explode("counts").alias("x"))
    return rows.select(id_col, "x.word", "x.count", (F.col("x.count") / F.col("total") * 100).alias("pct"))


def _in_order(counts: Column) -> Column:
    """Counts as :func:`ranked` orders them."""
    # First in binary order, which is nearly the dictionary's: the sort that compares by the dictionary then finds long runs.
    binary = F.sort_array(F.transform(counts, lambda x: F.struct((-x["count"]).alias("n"), x["word"].alias("word"))))
    keyed = F.transform(binary, lambda x: F.struct(x["n"].alias("n"), collated(x["word"]).alias("c"), x["word"].alias("word")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["word"].alias("word"), (-x["n"]).alias("count")))


def doc_ranked(docs: DataFrame, first: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, count, rank) of the ``first`` words of every document, in the order of :func:`ranked`; rarer ones than the last are not sorted."""
    least = lambda xs: F.coalesce(F.get(F.sort_array(F.transform(xs, lambda x: x["count"]), asc=False), F.lit(first - 1)), F.lit(0))
    often = A.let(least(F.col("counts")), lambda n: F.filter("counts", lambda x: x["count"] >= n))
    rows = doc_counts(docs, id_col, text_col).select(id_col, F.posexplode(F.slice(_in_order(often), 1, first)).alias("i", "x"))
    return rows.select(id_col, "x.word", "x.count", (F.col("i") + 1).alias("rank"))


def doc_reports(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, chars_no_spaces, chars_with_spaces, unique_words, ranked): what a document's CSV tells, ``ranked`` its (word, count) in order.

    Blocks and words of a text are formed once.
    """
    sums = ("chars_no_spaces", "chars_with_spaces")
    found = _documents_counted(_joined_blocks(docs, id_col, text_col), id_col, F.col("t"), *sums)
    return found.select(id_col, F.col("total").alias("words"), *sums, F.size("counts").cast("long").alias("unique_words"), _in_order(F.col("counts")).alias("ranked"))


def doc_max_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`max_share` of every document."""
    most = F.array_max(F.transform("counts", lambda x: x["count"]))
    return doc_counts(docs, id_col, text_col).select(id_col, (most / F.col("total") * 100).alias("max_pct"))


def frequency(tokens: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word, count, pct: counts combine map-side; totals come from the counts, not from the tokens."""
    counted = tokens.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*keys)) if keys else None
    if total is not None:
        return counted.withColumn("pct", F.col("count") / total * 100)
    whole = counted.agg(F.sum("count").alias("total"))
    return counted.crossJoin(F.broadcast(whole)).select("word", "count", (F.col("count") / F.col("total") * 100).alias("pct"))


def collated(word: Column) -> Column:
    return F.collate(word, "UNICODE")


def ranked(report: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``report`` with its rank within keys: by count, then word in dictionary order, then in binary order."""
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), collated(F.col("word")), "word")
    return report.withColumn("rank", F.row_number().over(order))


def top_words(report: DataFrame, n: int) -> DataFrame:
    """The first n of a report over everything. Per-task top lists meet in one, so no full sort."""
    return report.orderBy(F.desc("count"), collated(F.col("word")), "word").limit(n)


def view(report: DataFrame, hidden: tuple[str, ...] = (), query: str = "", sort_key: str = "count", ascending: bool | None = None, limit: int | None = None) -> DataFrame:
    """Rows with a class that isn't hidden and a word that holds the query, the exact word first, then by the key, then by word."""
    if sort_key not in ("word", "count", "pct"):
        raise ValueError(sort_key)
    ascending = (sort_key == "word") if ascending is None else ascending
    q = query.strip().lower()
    out = report.where(F.exists("classes", lambda c: ~c.isin(*hidden))) if hidden else report
    if q:
        out = out.where(F.col("word").contains(q))
    key = collated(F.col("word")) if sort_key == "word" else F.col("count")
    order = [F.when(F.col("word") == q, 0).otherwise(1)] * bool(q) + [key.asc() if ascending else key.desc(), collated(F.col("word")), F.col("word")]
    out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def page(report: DataFrame, size: int, after: tuple[int, str] | None = None) -> DataFrame:
    """The next ``size`` rows of the default order (by count, then word) after a row's (count, word); from the beginning without one.

    What comes before is filtered out by the row's own key, and each task keeps ``size`` rows at most, so no page sorts or counts the whole report.
    """
    word = F.col("word")
    out = report
    if after is not None:
        count, last = F.lit(after[0]), F.lit(after[1])
        later = (collated(word) > collated(last)) | ((collated(word) == collated(last)) & (word > last))
        out = out.where((F.col("count") < count) | ((F.col("count") == count) & later))
    return out.orderBy(F.desc("count"), collated(word), "word").limit(size)


def max_share(report: DataFrame, *keys: str) -> DataFrame:
    """keys, max_pct: the share of the most frequent word, which bars of a view are drawn against; 1 for a report without words."""
    most = report.groupBy(*keys).agg(F.max("pct").alias("max_pct"))
    return most if keys else most.select(F.coalesce("max_pct", F.lit(1.0)).alias("max_pct"))


def unique_words(docs: DataFrame, id_col: str = "doc_id", blocks_col: str = "blocks") -> DataFrame:
    """(id, unique_words) of documents with blocks, within each row: no shuffle. Documents without a word have no row."""
    found = F.array_distinct(F.flatten(F.transform(blocks_col, lambda b: F.transform(T.tokens(b["t"]), T.normalize_word))))
    once = docs.select(id_col, F.explode(F.array(found)).alias("words"))
    return once.where(F.size("words") > 0).select(id_col, F.size("words").cast("long").alias("unique_words"))


def class_counts(report: DataFrame, *keys: str) -> DataFrame:
    """Distinct words of each class; a word counts under each of its classes."""
    return report.select(*keys, F.explode("classes").alias("cls")).groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("words"))


def detect_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ui_language: str = "en") -> DataFrame:
    """(id, en, es, language) from hint words among the first 20,000 tokens; on a tie the interface's language."""
    taken = F.slice(T.tokens(F.col(text_col)), 1, C.LANGUAGE_TOKENS)
    low = docs.select(id_col, F.transform(taken, F.lower).alias("w"))
    hit = lambda words: F.size(F.filter("w", lambda x: x.isin(words)))
    out = low.select(id_col, hit(ENGLISH_HINTS).cast("long").alias("en"), (hit(SPANISH_HINTS) + 2 * F.size(F.filter("w", lambda x: x.rlike("[ñáéíóú¿¡]")))).cast("long").alias("es"))
    return out.withColumn("language", F.when(F.col("en") == F.col("es"), ui_language).when(F.col("es") > F.col("en"), "es").otherwise("en"))


def find_in_text(blocks: DataFrame, query: str, id_col: str = "doc_id", limit: int = C.FIND_LIMIT) -> DataFrame:
    """(id, pos, start, end) of a text of two characters or more, whatever its case, not overlapping; at most ``limit`` a document."""
    q = query.strip().lower()
    if len(q) < 2:
        return blocks.select(id_col, "pos", F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    pattern = "(?s)\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    hits = blocks.where(F.lower("t").contains(q)).select(id_col, "pos", F.explode(A.spans(F.lower("t"), pattern)).alias("x"))
    found = hits.select(id_col, "pos", F.col("x.start").cast("int").alias("start"), F.col("x.end").cast("int").alias("end"))
    order = Window.partitionBy(id_col).orderBy("pos", "start")
    return found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= limit).select(id_col, "pos", "start", "end")


def word_at(text: Column, offset: Column, end: bool = False) -> Column:
    """Span (start, end) of the word at an offset, or the first after it; else the last word, else the first character."""
    found = F.transform(A.spans(text, C.WORD), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    nothing = F.struct(F.lit(0).alias("start"), F.least(F.char_length(text), F.lit(1)).alias("end"))

    def chosen(spans: Column) -> Column:
        fits = F.filter(spans, lambda s: (s["end"] >= offset) if end else (s["end"] > offset))
        return F.coalesce(F.get(fits, F.lit(0)), F.try_element_at(spans, F.lit(-1)), nothing)

    return A.let(found, chosen)


def excerpt(text: Column, offset: Column, width: int = 60) -> Column:
    """Up to ``width`` characters from an offset on."""
    return T.trimmed(text.substr(offset + 1, F.lit(width)))


def total_chars(blocks: Column) -> Column:
    """Characters of a document's blocks with a separator after each, in UTF-16 units; 1 for a document without any."""
    return F.greatest(F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + T.utf16_length(b["t"]) + 1), F.lit(1).cast("long"))


def _quoted(text: Column, language: str) -> Column:
    before, after = ("«", "»") if language == "es" else ("“", "”")
    return F.concat(F.lit(before), text, F.lit(after))


def range_labels(docs: DataFrame, config: ReportConfig, language: str = "en", id_col: str = "doc_id", width: int = 60) -> DataFrame:
    """(id, total_chars, start_excerpt, start_percent, end_excerpt, end_percent, range) of documents with ``blocks``, within each row.

    An excerpt is what follows the start, or stands before the end; a percentage tells how far into the text the point lies;
    ``range`` names the words at the points. Where a document has no such block, or the config no such point, its excerpt and
    percentage are null and ``range`` speaks of the beginning or the end. An offset past its block counts as the block's end.
    """
    columns = [F.col(id_col), total_chars(F.col("blocks")).cast("long").alias("total_chars")]
    named = {}
    for name, point in (("start", config.start), ("end", config.end)):
        edge = M.message(F.lit("range.beginning" if name == "start" else "range.end"), language)
        if point is None:
            columns += [F.lit(None).cast("string").alias(f"{name}_excerpt"), F.lit(None).cast("long").alias(f"{name}_percent")]
            named[name] = edge
            continue
        text, o = F.get("blocks", F.lit(point.block))["t"], point.offset
        if name == "start":
            shown = F.concat(excerpt(text, F.lit(o), width), F.when(F.char_length(text) > o + width, "…").otherwise(""))
        else:
            since = max(0, o - width)
            shown = F.concat(F.lit("…" if since else ""), T.trimmed(text.substr(F.lit(since + 1), F.lit(o - since))))
        before = F.aggregate(F.slice("blocks", F.lit(1), F.lit(point.block)), F.lit(0).cast("long"), lambda n, b: n + T.utf16_length(b["t"]) + 1)
        percent = F.floor((before + T.utf16_length(F.left(text, F.lit(o)))) / total_chars(F.col("blocks")) * 100 + 0.5).cast("long")
        columns += [_quoted(shown, language).alias(f"{name}_excerpt"), F.when(text.isNotNull(), percent).alias(f"{name}_percent")]
        word = A.let(word_at(text, F.lit(o), end=name == "end"), lambda w: text.substr(w["start"] + 1, w["end"] - w["start"]))
        there = F.concat(_quoted(word, language), F.lit(" ("), percent.cast("string"), F.lit(" %)" if language == "es" else "%)"))
        named[name] = F.coalesce(F.when(text.isNotNull(), there), edge)
    return docs.select(*columns, M.message(F.lit("range"), language, named).alias("range"))


def structure_counts(blocks: DataFrame, *keys: str) -> DataFrame:
    """Headings, copyright blocks, and contents or index blocks of each key."""
    return blocks.groupBy(*keys).agg(F.count_if(F.col("k") == "h").alias("headings"), F.count_if(F.col("r") == "copyright").alias("copyright"), F.count_if(F.col("r").isin("toc", "index")).alias("toc"))


def role_counts(blocks: DataFrame, *keys: str) -> DataFrame:
    return blocks.groupBy(*keys, F.coalesce("r", F.lit("body")).alias("role")).agg(F.count(F.lit(1)).alias("blocks"))


def unique_files(files: DataFrame, web: bool = False) -> DataFrame:
    """Files listed once: by path, or as a browser sees them by name, size and time."""
    return files.dropDuplicates(["name", "size", "modified"] if web else ["path"])
