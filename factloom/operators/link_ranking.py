"""On-site links of a page, ranked for a purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.links import is_link, link_score
from ..functions.text import first_wins, let
from ..functions.urls import authority


def ranked_links(anchors: Column, base_url: Column, keywords: tuple[str, ...], limit: int) -> Column:
    """Of a page's anchors (``pos``, ``href``, ``text``, ``url``) the best ``limit``: ``url`` and ``score``.

    Scored links on the page's own authority; the first occurrence of an address counts; ties by position.  A page's
    anchors lie in one row, so nothing is shuffled.
    """

    def of(own: Column) -> Column:
        on_site = F.filter(anchors, lambda a: is_link(a["href"]) & (authority(a["url"]) == own) & a["url"].rlike("^(?i)https?://"))
        scored = F.transform(on_site, lambda a: F.struct((-link_score(a["text"], a["href"], keywords)).alias("minus"), a["pos"].alias("pos"), a["url"].alias("url")))
        firsts = first_wins(F.filter(scored, lambda s: s["minus"] < 0), lambda s: s["url"])
        return F.transform(F.slice(F.array_sort(firsts), 1, limit), lambda s: F.struct(s["url"].alias("url"), (-s["minus"]).alias("score")))

    return let(authority(base_url), of)
