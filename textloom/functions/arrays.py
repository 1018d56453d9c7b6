"""Running values over arrays inside a row, as Spark columns; time grows a little faster than the array, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An array is run through in stretches of so many elements, and the stretches' last values again.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array of ``values[0]``, ``op(values[0], values[1])``, and so on, for an associative ``op``; ``values`` hold no nulls."""

    def scan(array: Column) -> Column:
        return F.aggregate(array, F.slice(array, 1, 0), lambda out, x: F.array_append(out, F.coalesce(op(F.try_element_at(out, F.lit(-1)), x), x)))

    def joined(parts: Column) -> Column:
        lasts = scan(F.transform(parts, lambda part: F.element_at(part, -1)))
        return let(lasts, lambda before: F.flatten(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.transform(part, lambda x: op(F.get(before, i - 1), x))))))

    def whole(array: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(array), F.lit(CHUNK)), lambda at: scan(F.slice(array, at, F.lit(CHUNK))))
        return F.when(F.size(array) <= CHUNK, scan(array)).otherwise(let(parts, joined))

    return let(values, whole)


def spans(text: Column, pattern: str, context: int = 0) -> Column:
    """Array of (start, end, text, before) of a pattern's matches; ``before`` is what stands since the last match, its last ``context`` characters."""

    def placed(found: Column, pieces: Column) -> Column:
        steps = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: (F.char_length(p) + F.char_length(m)).cast("long"))
        before = lambda i: F.right(F.get(pieces, i), F.lit(context)) if context else F.lit("")
        row = lambda end, m, i: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("text"), before(i).alias("before"))
        return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(found, lambda m, i: row(F.get(ends, i), m, i)))

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,text:string,before:string>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces))))
