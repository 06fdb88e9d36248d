"""Small text helpers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters up to U+024F and Latin Extended Additional, and their base letters."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def without_accents(c: Column) -> Column:
    """Base letters; combining marks go too."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{M}+", "")


#: What counts as blank at the ends of a text: all Unicode blanks and the four information separators.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(c: Column) -> Column:
    """Without blanks at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Accent- and case-free key."""
    return stripped(F.lower(without_accents(c)))


def fold_word(value: str) -> str:
    """The same for a literal."""
    return "".join(x for x in unicodedata.normalize("NFKD", value) if not unicodedata.combining(x)).lower().strip()


def filled(c: Column) -> Column:
    """Empty counts as missing."""
    return F.nullif(c, F.lit(""))


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values) -> Column:
    """A literal array: one call to the JVM, however many values."""
    return F.expr(f"array({', '.join(map(_quoted, values))})")


def lookup(table: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(_quoted(x) for pair in table.items() for x in pair)})")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once (an expression inside a lambda would run for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_wins(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items whose key no earlier item has, in order."""
    return let(items, lambda xs: let(F.transform(xs, key), lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, key(x)) == i + 1)))


def one_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def title_case(c: Column) -> Column:
    """Each run of letters capitalised, whatever stands between runs."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")
