"""Numbers as each language shows them, as columns: whole numbers, shares, byte sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks between thousands and before decimals; units of sizes.
GROUP, DECIMAL = {"en": ",", "es": "."}, {"en": ".", "es": ","}
UNITS = ("KB", "MB", "GB")


def _language(language: str) -> str:
    return language if language in GROUP else "en"


def whole(number: Column, language: str = "en") -> Column:
    """A whole number with its thousands apart, however few."""
    return F.translate(F.format_number(number, 0), ",", GROUP[_language(language)])


def decimal(number: Column, language: str = "en") -> Column:
    """A number with its thousands apart and at most three digits after the mark, as many as it needs."""
    language = _language(language)
    shown = F.call_function("format_number", F.round(number.cast("double"), 3), F.lit("#,##0.###"))
    return F.translate(shown, ",.", GROUP[language] + DECIMAL[language])


def share(percent: Column, language: str = "en") -> Column:
    """A share of a hundred with two digits after the mark, or four where it is under a hundredth."""
    language = _language(language)
    digits = lambda n: F.translate(F.format_string(f"%.{n}f", F.round(percent.cast("double"), n)), ".", DECIMAL[language])
    shown = F.when(percent.isNotNull(), F.when(percent >= 0.01, digits(2)).otherwise(digits(4)))
    return F.concat(shown, F.lit(" %" if language == "es" else "%"))


def size(number: Column, language: str = "en") -> Column:
    """Bytes in the largest unit that leaves one or more: a digit after the mark under ten, else whole."""
    language = _language(language)

    def unit(power: int) -> Column:
        value = number / F.lit(float(1024**power))
        tenths = F.regexp_replace(F.format_string("%.1f", F.round(value, 1)), r"\.0$", "")
        rounded = F.floor(value + 0.5)
        apart = whole(rounded, language) if language == "en" else F.when(rounded >= 10_000, whole(rounded, language)).otherwise(rounded.cast("string"))
        return F.concat(F.when(value < 10, F.translate(tenths, ".", DECIMAL[language])).otherwise(apart), F.lit(f" {UNITS[power - 1]}"))

    out = F.when(number < 1024, F.concat(number.cast("string"), F.lit(" B")))
    for power in (1, 2):
        out = out.when(number < 1024 ** (power + 1), unit(power))
    return F.when(number.isNotNull(), out.otherwise(unit(3)))
