"""Word types: function words, numbers, and lexicon classes combined, for distinct words."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import constants as C

_CLITICS = ("nos", "las", "los", "les", "me", "te", "se", "os", "lo", "la", "le")


def _one_of(value: Column, words: list[str]) -> Column:
    return value.isin(words)


def is_number(word: Column, language: str = "en") -> Column:
    words = C.number_words(language)
    one = "(?:" + "|".join(map(re.escape, words)) + ")"
    # A pattern, not a lambda over the parts: those are interpreted, with all that stands beside them.
    return word.rlike(C.NUMERAL) | _one_of(word, words) | (word.contains("-") & word.rlike(rf"\A{one}(?:-{one})*\z"))


def function_class(word: Column, language: str = "en") -> Column:
    """The one class of a function word or number, else null."""
    out = F.when(is_number(word, language), "numbers")
    listed = C.function_words(language)
    for cls in C.FUNCTION_CLASSES:
        out = out.when(_one_of(word, [w for w, c in listed.items() if c == cls]), cls)
    return out


def fallback_classes(word: Column, language: str = "en") -> Column:
    """Classes without a lexicon: the function class, or other."""
    return F.array(F.coalesce(function_class(word, language), F.lit("other")))


@functools.cache
def _accented() -> tuple[str, str]:
    """Characters with marks over or under them and the same without, by Unicode's own decomposition."""
    out = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        parts = unicodedata.normalize("NFD", c)
        plain = unicodedata.normalize("NFC", "".join(x for x in parts if not "\u0300" <= x <= "\u036f"))
        if plain != c and len(plain) == 1:
            out[c] = plain
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(out) + marks, "".join(out.values())


def unaccented(word: Column) -> Column:
    """A word without accents; marks that stand alone go."""
    return F.translate(word, *_accented())


def clitic_bases(word: Column) -> Column:
    """Forms (an array) that are left when up to three attached pronouns are cut from a Spanish verb, the longest that fits first.

    Each with its accents and without, and after ``nos`` with the s that it swallows. Words are composed characters (NFC).
    """
    ending = "(" + "|".join(sorted(_CLITICS, key=len, reverse=True)) + r")\z"

    def cut(state: Column, _: Column) -> Column:
        last = F.regexp_extract(state["base"], ending, 0)
        base = state["base"].substr(F.lit(1), F.char_length(state["base"]) - F.char_length(last))
        removed = F.concat(last, state["removed"])
        swallowed = F.when(removed.startswith("nos"), F.array(F.concat(base, F.lit("s")))).otherwise(F.expr("cast(array() as array<string>)"))
        forms = F.flatten(F.transform(F.concat(F.array(base), swallowed), lambda form: F.array(form, unaccented(form))))
        more = F.struct(base.alias("base"), removed.alias("removed"), F.array_union(state["forms"], forms).alias("forms"))
        return F.when((last != "") & (F.char_length(base) >= 2), more).otherwise(state)

    start = F.struct(word.alias("base"), F.lit("").alias("removed"), F.expr("cast(array() as array<string>)").alias("forms"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, cut)["forms"]


def with_classes(words: DataFrame, lexicon: DataFrame | None, language: str = "en", word_col: str = "word") -> DataFrame:
    """``words`` with ``classes``, in display order.

    ``lexicon`` (word, classes: array of (cls, rare)) is one language's; None gives the fallback. Give distinct words:
    each needs a few look-ups, all equi-joins on the lexicon, which Spark broadcasts or shuffles by its size.
    """
    word = F.col(word_col)
    language = "es" if language == "es" else "en"
    if lexicon is None:
        # An explode, which no filter passes: else filters by class move below the counts and classify every use of a word.
        return words.select(*[F.col(f"`{c}`") for c in words.columns if c != "classes"], F.explode(F.array(fallback_classes(word, language))).alias("classes"))
    verbs = lexicon.where(F.exists("classes", lambda c: (c["cls"] == "verbs") & ~c["rare"])).select(F.col("word").alias("__verb")).distinct()
    empty = F.expr("cast(array() as array<struct<cls:string,rare:boolean>>)")
    fixed = lambda cls: F.array(F.struct(F.lit(cls).alias("cls"), F.lit(False).alias("rare")))
    last = F.element_at(F.split(word, "-"), -1)

    def look_up(frame: DataFrame, key: Column, name: str) -> DataFrame:
        side = lexicon.select(F.col("word").alias(f"__k{name}"), F.col("classes").alias(name))
        return frame.join(side, key == F.col(f"__k{name}"), "left").drop(f"__k{name}")

    out = look_up(words, word, "__hit")
    out = look_up(out, F.when(word.contains("-"), last), "__last")
    if language == "en":
        out = look_up(out, F.when(word.endswith("'s"), word.substr(F.lit(1), F.char_length(word) - 2)), "__base")
        derived = F.when(word.endswith("n't"), fixed("verbs")).when(F.col("__base").isNotNull(), F.col("__base"))
    else:
        missed = out.where(F.col("__hit").isNull()).select(word_col).distinct()
        verbal = missed.select(word_col, F.explode(clitic_bases(word)).alias("__verb")).join(verbs, "__verb").select(F.col(word_col).alias("__clitic")).distinct()
        out = out.join(verbal, word == F.col("__clitic"), "left")
        derived = F.when(word.endswith("mente") & (F.char_length(word) > 7), fixed("adverbs")).when(F.col("__clitic").isNotNull(), fixed("verbs"))
    tail = function_class(last, language)
    hyphened = F.when(word.contains("-"), F.when(tail.isNotNull(), F.array(F.struct(tail.alias("cls"), F.lit(False).alias("rare")))).otherwise(F.col("__last")))
    found = F.coalesce(F.col("__hit"), derived, hyphened, empty)
    out = out.withColumn("__fn", function_class(word, language)).withColumn("__found", found)
    content = ["nouns", "verbs", "adjectives", "adverbs"]
    usual = F.transform(F.filter("__found", lambda c: ~c["rare"]), lambda c: c["cls"])
    every = F.transform(F.filter("__found", lambda c: ~c["rare"] | c["cls"].isin(content)), lambda c: c["cls"])
    fn = F.col("__fn")
    mine = F.when(fn.isNull(), every).otherwise(F.array_append(usual, fn))
    mine = F.when(fn == "articles", F.array_remove(mine, "determiners")).when(fn == "numbers", F.array_remove(mine, "nouns")).otherwise(mine)
    out = out.withColumn("__all", mine)
    ordered = F.filter(F.array(*[F.lit(c) for c in C.CLASSES[:-1]]), lambda c: F.array_contains("__all", c))
    return out.select(*words.columns, F.when(F.size("__all") == 0, F.array(F.lit("other"))).otherwise(ordered).alias("classes"))


def seed_table(spark: SparkSession, language: str = "en") -> DataFrame:
    """The function words as a table (word, cls)."""
    return spark.createDataFrame(sorted(C.function_words(language).items()), "word string, cls string")
