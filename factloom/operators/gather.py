"""Which pages of a site are read: home page, contact page, team page, within a budget.

The sequential rules (real links before guesses, stop at the first page that loads, every try costs
budget) become two windows over the table of possible tries.  What is known of pages comes as one
written table, so nothing here reads HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.urls import authority, common_paths, www_toggled
from ..scratch import written
from .link_ranking import ranked_links


def kept_tries(tries: DataFrame, budget: int) -> DataFrame:
    """Of tries (``site_id``, ``grp``, ``i``, ``ok``): those that are made.

    In a group, none after one that was ok; over the groups, ``budget`` at most.
    """
    before = Window.partitionBy("site_id", "grp").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    open_ = tries.withColumn("__done", F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0))).where("__done = 0")
    order = Window.partitionBy("site_id").orderBy("grp", "i")
    return open_.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= budget).drop("__done", "__n")


def one_per_url(store: DataFrame) -> DataFrame:
    """The store (``url``, ``final_url``, ``html``, ``error``) with one row per URL and ``page_url``, where the page was found.

    Of several rows one that loaded counts; HTML is only shuffled for URLs that have several.
    """
    rows = store.select("url", F.coalesce("final_url", "url").alias("page_url"), "html", "error").where("url IS NOT NULL")
    repeated = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url")
    several = rows.join(repeated, "url", "left_semi")
    best = several.groupBy("url").agg(F.max(F.struct(F.col("html").isNotNull().alias("loads"), "page_url", "html", "error")).alias("b"))
    return rows.join(repeated, "url", "left_anti").unionByName(best.select("url", "b.page_url", "b.html", "b.error"))


def near_sites(store: DataFrame, sites: DataFrame) -> DataFrame:
    """The store's pages on the authorities of the sites (``source_url``), with and without ``www.``, or of where their home pages were found."""
    starts = sites.select(F.explode(F.array("source_url", www_toggled(F.col("source_url")))).alias("url"))
    ends = store.join(starts, "url", "left_semi").select(F.coalesce("final_url", "url").alias("url"))
    hosts = starts.unionByName(ends).select(authority(F.col("url")).alias("host")).distinct()
    return store.withColumn("host", authority(F.col("url"))).join(hosts, "host", "left_semi").drop("host")


def home_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Sites (``site_id``, ``source_url``) with their home page, tried with and without ``www.``, and first warnings.

    ``pages``: ``url``, ``page_url``, ``loads``, ``error``; the result names the page by ``home_key`` and ``home_url``.
    """
    missing = F.lit("no está en el almacén")
    one = pages.select(F.col("url").alias("source_url"), F.struct("url", "page_url", "loads", "error").alias("p1"))
    two = pages.select(F.col("url").alias("alt_url"), F.struct("url", "page_url", "loads", "error").alias("p2"))
    both = sites.withColumn("alt_url", www_toggled(F.col("source_url"))).join(one, "source_url", "left").join(two, "alt_url", "left")
    error = F.coalesce(F.col("p1.error"), missing)
    first, second = (F.coalesce(F.col(f"{p}.loads"), F.lit(False)) for p in ("p1", "p2"))
    filled = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("{url}"), F.col("source_url")), F.lit("{error}"), error), F.lit("{other}"), F.col("alt_url"))
    warning = F.when(first, None).when(second, filled(fixed.W_WWW)).otherwise(filled(fixed.W_HOME))
    home = F.when(first, F.col("p1")).when(second, F.col("p2"))
    return both.select("site_id", "source_url", home["url"].alias("home_key"), home["page_url"].alias("home_url"), F.filter(F.array(warning), lambda w: w.isNotNull()).alias("warnings"))


def possible_tries(homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of home pages (``site_id``, ``page_url``, ``anchors``): tries (``site_id``, ``grp``, ``i``, ``url``), and which links a site has.

    Groups 0 and 1 are links to contact and team pages, 2 and 3 the usual paths of a site without such links.
    """
    ranked = homes.select(
        "site_id", "page_url",
        ranked_links(F.col("anchors"), F.col("page_url"), fixed.CONTACT_WORDS, fixed.CONTACT_LINKS).alias("contact"),
        ranked_links(F.col("anchors"), F.col("page_url"), fixed.TEAM_WORDS, fixed.TEAM_LINKS).alias("team"),
    )
    listed = lambda urls, grp, url: F.transform(urls, lambda x, i: F.struct(F.lit(grp).alias("grp"), i.alias("i"), url(x).alias("url")))
    linked = lambda links, grp: listed(F.col(links), grp, lambda x: x["url"])
    guessed = lambda links, grp, paths: F.when(F.size(links) == 0, listed(common_paths(F.col("page_url"), paths), grp, lambda x: x)).otherwise(listed(F.expr("cast(array() as array<string>)"), grp, lambda x: x))
    tries = F.concat(linked("contact", 0), linked("team", 1), guessed("contact", 2, fixed.CONTACT_PATHS), guessed("team", 3, fixed.TEAM_PATHS))
    return ranked.select("site_id", F.inline(tries)), ranked.select("site_id", (F.size("contact") > 0).cast("int").alias("c"), (F.size("team") > 0).cast("int").alias("t"))


def gathered(sites: DataFrame, pages: DataFrame, *, max_pages: int = fixed.MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """Pages that are read (``site_id``, ``page_ord``, ``url``), and sites with page addresses and warnings.

    ``pages``: ``url``, ``page_url``, ``loads``, ``error``, ``anchors``, one row per URL; a URL it lacks is a failed fetch.
    """
    homes = home_pages(sites, pages)
    read = homes.where("home_key IS NOT NULL").select("site_id", F.lit(0).alias("page_ord"), F.col("home_key").alias("url"))
    budget = max_pages - 1
    empty = F.expr("cast(array() as array<string>)")
    if budget <= 0:
        found = homes.select("site_id", "source_url", F.lit(None).cast("string").alias("contact_page_url"), F.lit(None).cast("string").alias("team_page_url"), "warnings")
        return read, found
    tries, has = possible_tries(read.join(pages.select("url", "page_url", "anchors"), "url"))
    known = pages.select("url", "page_url", "error", "loads")
    tried = written(kept_tries(tries.join(known, "url", "left").withColumn("ok", F.coalesce("loads", F.lit(False))), budget), "tries")
    said = F.replace(F.replace(F.lit(fixed.W_PAGE), F.lit("{url}"), F.col("url")), F.lit("{error}"), F.coalesce("error", F.lit("no está en el almacén")))
    per_site = tried.groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("ok") & (F.col("grp") <= 1), F.struct("grp", "i", said.alias("w"))))).alias("ws"),
        F.max(F.when(F.col("ok") & F.col("grp").isin(0, 2), F.col("page_url"))).alias("contact_page_url"),
        F.max(F.when(F.col("ok") & F.col("grp").isin(1, 3), F.col("page_url"))).alias("team_page_url"),
    )
    more = tried.where("ok").select("site_id", F.row_number().over(Window.partitionBy("site_id").orderBy("grp", "i")).alias("page_ord"), "url")
    ok_home = F.col("home_url").isNotNull()
    flag = lambda cond, text: F.when(ok_home & cond, F.array(F.lit(text))).otherwise(empty)
    found = homes.join(has, "site_id", "left").join(per_site, "site_id", "left")
    found = found.select(
        "site_id", "source_url", "contact_page_url", "team_page_url",
        F.concat(
            "warnings",
            F.coalesce(F.transform("ws", lambda w: w["w"]), empty),
            flag(F.coalesce("c", F.lit(0)) == 0, fixed.W_GUESS),
            flag(F.col("contact_page_url").isNull(), fixed.W_NO_CONTACT),
            flag(F.col("team_page_url").isNull(), fixed.W_NO_TEAM),
        ).alias("warnings"),
    )
    return read.unionByName(more), found
