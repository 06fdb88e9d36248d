"""People and their roles in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import filled, first_wins, let, stripped, title_case, words

#: The line after the one a match ends on, as a further group.
NEXT_LINE = r"(?=[^\n]*(?:\n([^\n]*))?)"
FLAGS, LINES = "(?U)", "(?Umd)"


def clean_name(name: Column) -> Column:
    """Shouted names in title case; null for boilerplate and companies."""
    n = stripped(name)
    cased = F.when((F.upper(n) == n) & (F.lower(n) != n), title_case(n)).otherwise(n)
    ok = (cased != "") & ~F.array_contains(words(fixed.NOT_NAMES), F.lower(cased)) & ~cased.rlike(f"(?iU){fixed.COMPANY_END}")
    return F.when(ok, cased)


def clean_person_name(raw: Column) -> Column:
    """A name out of structured data: without title and decoration."""
    bare = F.regexp_replace(stripped(raw), rf"(?iU)^{fixed.TITLES}\s+", "")
    return clean_name(F.coalesce(filled(F.regexp_substr(bare, F.lit(fixed.NAME_RUN))), bare))


def has_word(line: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(line), F.lit("([a-záéíóúñ]+)"), 1), words(vocabulary))


def is_role(line: Column) -> Column:
    """Whether a line reads like a job title: never null."""
    plain_name = line.rlike(FLAGS + fixed.BARE_LINE) & ~has_word(line, fixed.ROLE_WORDS)
    ok = (
        ~F.array_contains(words(fixed.NOT_ROLES), F.lower(line))
        & line.rlike(fixed.ROLE_SHAPE)
        & ~line.contains("@")
        & ~F.lower(line).contains("http")
        & ~has_word(line, fixed.CALL_WORDS)
        & ~line.rlike(r"\d{3,}")
        & ~line.rlike(FLAGS + fixed.TITLED)
        & ~line.rlike(FLAGS + fixed.LABELLED)
        & ~plain_name
    )
    return F.coalesce((line != "") & ok, F.lit(False))


def _mentions(text: Column, pattern: str) -> Column:
    """(raw name, next line) of every match."""
    found = [F.regexp_extract_all(text, F.lit(pattern + NEXT_LINE), g) for g in (1, 2)]
    return F.transform(F.arrays_zip(found[0].alias("n"), found[1].alias("l")), lambda x: F.struct(clean_name(x["n"]).alias("name"), stripped(x["l"]).alias("line")))


def titled_names(text: Column, pattern: str = FLAGS + fixed.TITLED) -> Column:
    """People with a title in front, and the role that the next line gives."""
    named = F.filter(_mentions(text, pattern), lambda x: x["name"].isNotNull())
    return F.transform(named, lambda x: F.struct(x["name"].alias("name"), F.when(is_role(x["line"]), x["line"]).alias("role")))


def labelled_names(text: Column) -> Column:
    """People after a label such as ``Contacto:``."""
    return titled_names(text, FLAGS + fixed.LABELLED)


def bare_names(text: Column) -> Column:
    """Lines that are only a name and are followed by a role."""
    found = _mentions(text, LINES + fixed.BARE_LINE)
    other = lambda n: F.array_contains(words(fixed.NOT_ROLES), F.lower(n)) | has_word(n, fixed.ROLE_WORDS + fixed.COMPANY_WORDS + fixed.HEADING_WORDS)
    kept = F.filter(found, lambda x: x["name"].isNotNull() & ~other(x["name"]) & is_role(x["line"]))
    return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), x["line"].alias("role")))


def names_in_text(text: Column) -> Column:
    """All three, titled before labelled before bare; the first mention of a name counts, with its role."""
    return first_wins(F.concat(titled_names(text), labelled_names(text), bare_names(text)), lambda p: p["name"])


def one_each(mentions: Column) -> Column:
    """People of an ordered list of mentions: the first position of a name counts, and the first role given."""

    def of(ps: Column) -> Column:
        role = lambda name: F.get(F.transform(F.filter(ps, lambda q: (q["name"] == name) & q["role"].isNotNull()), lambda q: q["role"]), 0)
        return F.transform(first_wins(ps, lambda p: p["name"]), lambda p: F.struct(p["name"].alias("name"), role(p["name"]).alias("role")))

    return let(mentions, of)


def display(person: Column) -> Column:
    return F.when(filled(person["role"]).isNull(), person["name"]).otherwise(F.concat(person["name"], F.lit(" ("), person["role"], F.lit(")")))
