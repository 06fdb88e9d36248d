"""Opening hours: in running text and in schema.org's compact form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let, lookup, one_blank


def _snippets(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda s: F.btrim(one_blank(s), F.lit(fixed.OUTER_MARKS))), lambda s: s != ""))


def hours_in_text(text: Column) -> Column:
    """Up to five snippets: days with a time range, or else what surrounds a keyword.

    Most texts have no time range and no keyword; looking for these first, which start with a digit or few letters, spares
    them the patterns that may start anywhere.
    """
    flat = F.regexp_replace(text, r"[ \t]+", " ")
    none = F.expr("cast(array() as array<string>)")

    def strict(t: Column) -> Column:
        return F.when(t.rlike(rf"(?iU){fixed.CLOCK_RANGE}"), _snippets(F.regexp_extract_all(t, F.lit(rf"(?iU)({fixed.HOURS_LINE})"), 1))).otherwise(none)

    def loose(t: Column) -> Column:
        # what precedes a keyword, up to the start of the text, and what follows, may overlap others'
        b, a = fixed.HOURS_BEFORE, fixed.HOURS_AFTER
        pattern = F.lit(rf"(?isU)(?<=(^.{{0,{b - 1}}}|.{{{b}}}))({fixed.HOURS_KEYWORD})(?=(.{{0,{a}}}))")
        parts = [F.regexp_extract_all(t, pattern, g) for g in (1, 2, 3)]
        around = F.transform(F.arrays_zip(*(p.alias(f"p{i}") for i, p in enumerate(parts))), lambda x: F.concat(x["p0"], x["p1"], x["p2"]))
        near = F.filter(_snippets(around), lambda s: s.rlike(rf"(?iU)(?:{fixed.DAY_WORDS})") | s.rlike(rf"(?iU){fixed.CLOCK_RANGE}"))
        return F.when(t.rlike(rf"(?iU){fixed.HOURS_KEYWORD}"), near).otherwise(none)

    return let(flat, lambda t: let(strict(t), lambda s: F.slice(F.when(F.size(s) > 0, s).otherwise(loose(t)), 1, fixed.HOURS_KEPT)))


def best_hours(snippets: Column) -> Column:
    return F.get(snippets, 0)


def day_name(code: Column) -> Column:
    """Spanish name of a schema.org day, given as code, word or URL; unknown ones as they are."""
    return F.coalesce(F.try_element_at(lookup(fixed.DAYS), F.lower(F.regexp_extract(code, r"([^/]*)$", 1))), code)


def compact_hours(value: Column) -> Column:
    """``Mo-Fr 09:00-18:00`` in words; the first such part counts, other texts stay as they are."""
    part = lambda i: F.regexp_extract(value, rf"(?iU){fixed.COMPACT_HOURS}", i)
    days = F.when(part(2) != "", F.concat(day_name(part(1)), F.lit(" a "), day_name(part(2)))).otherwise(day_name(part(1)))
    return F.when(part(1) == "", value).otherwise(F.concat(days, F.lit(": "), part(3), F.lit("–"), part(4)))
