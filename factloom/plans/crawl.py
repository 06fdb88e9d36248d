"""Fills a page store: home pages, then what their links, the usual paths and the page budget ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.urls import normalized, www_toggled
from ..operators.gather import home_pages, kept_tries, one_per_url, possible_tries
from ..scratch import exists, written
from ..sources.fetch import FETCHED, fetched
from ..sources.html_parse import parsed_pages


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store's pages, one row per URL; none if nothing is there yet."""
    store = spark.read.schema(FETCHED).parquet(path) if exists(spark, path) else spark.createDataFrame([], FETCHED)
    return one_per_url(store).withColumn("loads", F.col("html").isNotNull())


def crawl(sites: DataFrame, store_path: str, *, max_pages: int = fixed.MAX_PAGES, pause: float = 1.0, **options) -> None:
    """Appends fetched pages to the store, ``max_pages`` a site at most; no URL that the store has is fetched again.

    A round fetches of each site the next page that the plan would try, given what is known by then: linked contact and
    team pages, or where there is no such link the usual paths, until one loads.  Home pages need no pause.
    """
    spark = sites.sparkSession

    def fetch(urls: DataFrame, pause: float) -> None:
        new = urls.distinct().join(stored(spark, store_path).select("url"), "url", "left_anti")
        fetched(new, pause=pause, **options).write.mode("append").parquet(store_path)

    own = sites.select(normalized(F.col("url")).alias("source_url")).where("source_url IS NOT NULL").distinct()
    fetch(own.select(F.col("source_url").alias("url")), 0.0)
    failed = own.join(stored(spark, store_path).where("loads"), F.col("source_url") == F.col("url"), "left_anti")
    fetch(failed.select(www_toggled(F.col("source_url")).alias("url")), 0.0)
    pages = stored(spark, store_path)
    homes = home_pages(own.select(F.col("source_url").alias("site_id"), "source_url"), pages).where("home_key IS NOT NULL")
    html = pages.select(F.col("url").alias("home_key"), "page_url", "html")
    parsed = parsed_pages(homes.select("site_id", "home_key").join(html, "home_key").select("site_id", "page_url", "html"), base_col="page_url")
    tries = written(possible_tries(written(parsed.select("site_id", "page_url", "anchors"), "home-anchors"))[0], "possible-tries")
    for _ in range(max_pages - 1):
        known = stored(spark, store_path).select("url", "loads")
        made = kept_tries(tries.join(known, "url", "left").withColumn("ok", F.coalesce("loads", F.lit(False))), max_pages - 1)
        following = made.where("loads IS NULL").groupBy("site_id").agg(F.min(F.struct("grp", "i", "url")).alias("t")).select("t.url")
        following = written(following, "next-tries")
        if following.isEmpty():
            break
        fetch(following, pause)
