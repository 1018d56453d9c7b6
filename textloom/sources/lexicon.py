"""Lexicon tables: reading both file formats, and building one from treebanks and word lists.

A lexicon is (word, classes: array of (cls, rare)).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Part-of-speech tags of the three sources, and the order of classes within a word.
UPOS = {"NOUN": "nouns", "PROPN": "nouns", "VERB": "verbs", "AUX": "verbs", "ADJ": "adjectives", "ADV": "adverbs", "PRON": "pronouns", "DET": "determiners", "ADP": "prepositions", "CCONJ": "conjunctions", "SCONJ": "conjunctions", "INTJ": "interjections", "NUM": "numbers"}
WORD_LIST_POS = {"n": ["nouns"], "v": ["verbs"], "m": ["verbs", "nouns"], "n_v": ["nouns", "verbs"], "aj": ["adjectives"], "av": ["adverbs"], "aj_av": ["adjectives", "adverbs"], "pn": ["pronouns"], "c": ["conjunctions"], "pp": ["prepositions"], "d": ["determiners"], "i": ["interjections"]}
EAGLES = {"N": "nouns", "V": "verbs", "A": "adjectives", "R": "adverbs", "P": "pronouns", "D": "determiners", "S": "prepositions", "C": "conjunctions", "I": "interjections", "Z": "numbers"}
ORDER = ["nouns", "verbs", "adjectives", "adverbs", "pronouns", "determiners", "articles", "prepositions", "conjunctions", "interjections", "numbers"]
RARE_SHARE, LEAST_SEEN = 0.05, 5


def _classes(group: Column) -> Column:
    return F.transform(F.split(group, ","), lambda c: F.struct(F.regexp_replace(c, r"\?\z", "").alias("cls"), c.endswith("?").alias("rare")))


def parse(lines: DataFrame) -> DataFrame:
    """A lexicon from the ``value`` lines of one file of the newer format; :func:`load` tells the formats apart.

    A head ``#v2<TAB>group...``, then ``word<TAB>number of its group in base 36``: the head is a single
    row, so it is joined rather than collected.
    The old format (:func:`parse_grouped`) has ``#classes`` heads, each before its words; lines need their number there,
    so the file comes as one row of text.
    """
    head = lines.where(F.col("value").startswith("#v2\t")).select(F.split(F.substring_index("value", "#v2\t", -1), "\t").alias("groups")).limit(1)
    rows = lines.where(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    rows = rows.select(F.split("value", "\t").alias("x")).select(F.col("x")[0].alias("word"), F.conv(F.col("x")[1], 36, 10).cast("int").alias("group"))
    return rows.join(F.broadcast(head)).select("word", _classes(F.get("groups", F.col("group"))).alias("classes"))


def parse_grouped(texts: DataFrame) -> DataFrame:
    """A lexicon in the old format, from whole files in ``value``. Of a word's groups the last in its file holds."""
    sections = texts.select(F.posexplode(F.split("value", r"(?m)^#")).alias("place", "part")).where("length(part) > 0")
    lines = sections.select("place", F.split("part", r"\r?\n").alias("x"))
    rows = lines.select("place", F.col("x")[0].alias("group"), F.explode(F.slice("x", F.lit(2), F.size("x"))).alias("word")).where("word <> ''")
    return rows.groupBy("word").agg(F.max_by("group", F.struct("place", "group")).alias("group")).select("word", _classes(F.col("group")).alias("classes"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file (plain or gzip) of either format."""
    lines = spark.read.text(path)
    if lines.where(F.col("value").startswith("#v2\t")).isEmpty():
        return parse_grouped(spark.read.text(path, wholetext=True))
    return parse(lines)


def treebank_counts(lines: DataFrame) -> DataFrame:
    """(word, cls, n) of CoNLL-U ``value`` lines; ranges and empty nodes are passed over."""
    cols = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(cols.alias("x")).where((F.size("x") >= 4) & ~F.col("x")[0].rlike("[-.]"))
    cls = F.element_at(F.create_map(*[F.lit(v) for kv in UPOS.items() for v in kv]), F.col("x")[3])
    return rows.select(F.replace(F.lower(F.col("x")[1]), F.lit("’"), F.lit("'")).alias("word"), cls.alias("cls")).where("cls is not null").groupBy("word", "cls").agg(F.count(F.lit(1)).alias("n"))


def tagged_entries(lines: DataFrame) -> DataFrame:
    """(word, cls) of ``form lemma tag [lemma tag ...]`` lines with EAGLES tags; multi-word forms are passed over."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") >= 3)
    tags = F.filter("x", lambda _, i: (i >= 2) & (i % 2 == 0))
    cls = F.element_at(F.create_map(*[F.lit(v) for kv in EAGLES.items() for v in kv]), F.substring("tag", 1, 1))
    rows = parts.select(F.lower(F.col("x")[0]).alias("word"), F.explode(tags).alias("tag"))
    return rows.select("word", cls.alias("cls")).where("cls is not null and not contains(word, '_')").distinct()


_ENTRY = re.compile(r"(\S+) <([a-z_]+)(?:/[^>]*)?>")


def _tidy(word: str) -> str:
    word = word.strip()
    if len(word) > 1 and word[0] in "-@!":
        word = word[1:]
    return word.rstrip("*-@~!†")


def _forms(text: str) -> list[str]:
    """Forms of an entry: parted by commas outside brackets; a bracket lists alternatives after their labels."""
    level, pieces = 0, [""]
    for ch in text:
        level += (ch == "(") - (ch == ")")
        if ch == "," and not level:
            pieces.append("")
        else:
            pieces[-1] += ch
    out = []
    for piece in map(str.strip, pieces):
        out += [alt.split(": ")[-1] for alt in piece.strip("()").split("|")] if piece.startswith("(") else [piece]
    return [w for w in map(_tidy, out) if w not in ("", "-")]


def word_list_group(text: str) -> list[tuple[str, str]]:
    """(word, class) pairs of one group of lines, which share a lemma."""
    lemma, out = None, []
    for line in text.split("\n"):
        parts = [] if line.startswith("#") else line.split("#")[0].rstrip().split(": ")
        for i, part in enumerate(parts[1:], 1):
            if not (m := _ENTRY.match(part)):
                continue
            lemma = _tidy(m[1]) if m[1] != "-" else lemma
            if lemma and m[2] in WORD_LIST_POS:
                for form in [lemma, *_forms(": ".join(parts[i + 1 :]))]:
                    form = form.lower()
                    if re.search("[a-z]", form) and " " not in form:
                        out += [(form, cls) for cls in WORD_LIST_POS[m[2]]]
            break
    return out


def word_list_entries(groups: DataFrame) -> DataFrame:
    """(word, cls) of word-list groups in ``value``: read the file with a blank line as its record separator."""
    entries = F.udf(lambda text: word_list_group(text or ""), "array<struct<word:string,cls:string>>")
    return groups.select(F.explode(entries("value")).alias("e")).select("e.*").distinct()


def build(candidates: DataFrame | None, counts: DataFrame) -> DataFrame:
    """A lexicon: every class of a word; rare if under a twentieth of five uses or more in the treebanks.

    Without ``candidates`` every class that was counted is one. Candidates and counts meet in the groups, so each is read once.
    """
    rows = counts.select("word", "cls", F.col("n").cast("long").alias("n"), F.lit(candidates is None).alias("listed"))
    if candidates is not None:
        rows = rows.unionByName(candidates.select("word", "cls", F.lit(None).cast("long").alias("n"), F.lit(True).alias("listed")))
    each = rows.groupBy("word", "cls").agg(F.sum("n").alias("n"), F.bool_or("listed").alias("listed"))
    place = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("cls"))
    one = F.struct(place.alias("i"), F.col("cls"), F.coalesce("n", F.lit(0)).alias("n"))
    words = each.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.when(F.col("listed"), one))).alias("c"))
    rare = lambda c: (F.col("total") >= LEAST_SEEN) & (c["n"] / F.col("total") < RARE_SHARE)
    return words.where("size(c) > 0").select("word", F.transform("c", lambda c: F.struct(c["cls"].alias("cls"), rare(c).alias("rare"))).alias("classes"))


def lines_v2(lexicon: DataFrame) -> tuple[str, DataFrame]:
    """Head and (word, line) of a file of the newer format; words sort by UTF-16 code units."""
    group = F.array_join(F.transform("classes", lambda c: F.concat(c["cls"], F.when(c["rare"], "?").otherwise(""))), ",")
    tagged = lexicon.select("word", group.alias("group"))
    groups = sorted(r["group"] for r in tagged.select("group").distinct().collect())  # at most 2**22 in theory, some dozens in fact
    index = lexicon.sparkSession.createDataFrame(list(enumerate(groups)), "i int, `group` string")
    rows = tagged.join(F.broadcast(index), "group").orderBy(F.encode("word", "UTF-16BE"))
    return "#v2\t" + "\t".join(groups), rows.select("word", F.concat_ws("\t", "word", F.lower(F.conv("i", 10, 36))).alias("line"))
