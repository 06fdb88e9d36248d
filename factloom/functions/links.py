"""Link scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import fold_word, folded, let, stripped, words


def link_score(text: Column, href: Column, keywords: tuple[str, ...]) -> Column:
    """Points for each keyword in the folded text and in the href; spellings that fold alike count each."""
    spelt = [fold_word(w) for w in keywords]
    found = lambda where, what: let(where, lambda x: F.size(F.filter(words(what), lambda w: x.contains(w))))
    return fixed.TEXT_POINTS * found(folded(text), spelt) + fixed.HREF_POINTS * found(F.translate(folded(href), "-_", ""), [w.replace(" ", "") for w in spelt])


def is_link(href: Column) -> Column:
    """Not empty, no fragment, no other scheme's action."""
    return (stripped(href) != "") & ~stripped(href).rlike(r"(?i)^(#|mailto:|tel:|javascript:)")
