"""One call from URLs to facts, and the functions that SQL may use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .functions import jsonld, phones, urls
from .plans.contact_facts import contact_facts
from .plans.crawl import crawl
from .scratch import scratch_path
from .shipping import ship
from .sources.fetch import FETCHED
from .sources.html_parse import parse_page
from .sources.url_lists import all_urls


def site_facts(spark: SparkSession, given: Iterable[str], *, store: str | None = None, fetch: bool = True, cities: DataFrame | None = None, max_pages: int = 4, **options) -> DataFrame:
    """Facts of the sites with these URLs, in order.

    ``store``: the Parquet page store to read and, with ``fetch``, to fill; without one pages are only kept for the session.
    ``options``: ``timeout``, ``pause``, ``respect_robots``.
    """
    sites = all_urls(spark, list(given))
    path = store or scratch_path(spark, "store")
    if fetch:
        crawl(sites, path, max_pages=max_pages, **options)
    return contact_facts(sites, spark.read.schema(FETCHED).parquet(path), cities=cities, max_pages=max_pages)


@udtf(returnType="pos int, href string, text string, url string")
class PageLinks:
    """``page_links(html, url)``: a page's links, one row each."""

    def eval(self, html: str, url: str):
        for a in parse_page(html, url)["anchors"]:
            yield a["pos"], a["href"], a["text"], a["url"]


def register(spark: SparkSession) -> None:
    """Registers for SQL: ``canonical_phones(numbers, country)``, ``phones_in_text(text, linked, country)``, ``resolved_url(base, href)``,
    ``jsonld_nodes(scripts)`` and the table function ``page_links(html, url)``."""
    ship(spark)
    spark.udf.register("canonical_phones", phones.canonical_phones)
    spark.udf.register("phones_in_text", phones.phones_in_text)
    spark.udf.register("resolved_url", urls.resolved)
    spark.udf.register("jsonld_nodes", jsonld.unwrapped)
    spark.udtf.register("page_links", PageLinks)
