"""The whole plan: URLs and a page store in, one row of facts per site out.

Two tables are written on the way, to the folder that driver and executors share, and cut the plan: what each page
says (one parse a page, however often the plan asks for its links, its state or its facts), and the sites before
the gazetteer is asked.  All that follows reads their few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, hours, jsonld, names, phones, urls
from ..functions.entities import Recognizer, with_recognized
from ..functions.text import filled
from ..operators.city import address_snippet, guessed_cities
from ..operators.gather import gathered, near_sites, one_per_url
from ..scratch import written
from ..sources import gazetteer
from ..sources.html_parse import parsed_pages

PEOPLE = "array<struct<name:string,role:string>>"
NO_TEXT = "cast(array() as array<string>)"


def micro_address(props: Column) -> Column:
    loc, reg, cou = (filled(F.try_element_at(props, F.lit(k))) for k in fixed.ITEMPROPS[:3])
    return F.struct(loc.alias("locality"), reg.alias("region"), cou.alias("country"), filled(F.concat_ws(", ", loc, reg, cou)).alias("raw"))


def page_facts(pages: DataFrame, recognizer: Recognizer | None = None) -> DataFrame:
    """Per page (``url``, ``page_url``, ``html``, ``error``) its state, its links and what its text and markup say.

    Native but for the parse and the phone numbers.
    """
    parsed = parsed_pages(pages.withColumn("loads", F.col("html").isNotNull()), base_col="page_url")
    people = names.names_in_text(F.col("text_no_nav"))
    people = with_recognized(people, F.col("text_no_nav"), recognizer) if recognizer else people
    linked = phones.tel_numbers(F.transform("anchors", lambda a: a["href"]))
    return parsed.select(
        "url", "page_url", "loads", "error", "anchors", "ld_nodes", "meta_city", "text",
        micro_address(F.col("itemprops")).alias("micro"),
        filled(F.try_element_at("itemprops", F.lit("telephone"))).alias("micro_phone"),
        phones.phones_in_text(F.col("text"), linked, urls.country_of(F.col("page_url"))).alias("phones"),
        people.alias("names"),
        hours.hours_in_text(F.col("text")).alias("hours"),
        address_snippet(F.col("text")).alias("snippet"),
    )


SITE_COLUMNS = ("ld_nodes", "meta_city", "text", "micro", "micro_phone", "phones", "names", "hours", "snippet")


def site_facts(pages: DataFrame) -> DataFrame:
    """Per site the facts of its pages in page order: one shuffle, bounded by the page limit."""
    grouped = pages.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("page_ord", *SITE_COLUMNS))).alias("ps"))
    of = lambda name: F.transform("ps", lambda p: p[name])
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), 0)
    read = grouped.select(
        "site_id",
        jsonld.summary(jsonld.nodes(F.flatten(of("ld_nodes")))).alias("ld"),
        F.filter(of("micro_phone"), lambda x: x.isNotNull()).alias("micro_phones"),
        F.get(F.filter(of("micro"), lambda a: a["raw"].isNotNull()), 0).alias("micro"),
        first(of("meta_city")).alias("meta_city"),
        F.array_join(of("text"), "\n").alias("text"),
        F.array_distinct(F.flatten(of("phones"))).alias("page_phones"),
        F.flatten(of("names")).alias("page_names"),
        F.array_distinct(F.flatten(of("hours"))).alias("page_hours"),
        first(of("snippet")).alias("snippet"),
    )
    # structured people by cleaned name, then those of the pages
    cleaned = F.transform("ld.names", lambda p: F.struct(names.clean_person_name(p["name"]).alias("name"), filled(p["role"]).alias("role")))
    return read.withColumn("names", names.one_each(F.concat(F.filter(cleaned, lambda p: p["name"].isNotNull()), "page_names")))


def contact_facts(sites: DataFrame, store: DataFrame, *, cities: DataFrame | None = None, max_pages: int = fixed.MAX_PAGES, recognizer: Recognizer | None = None) -> DataFrame:
    """``sites``: ``site_ord``, ``url``; ``store``: ``url``, ``final_url``, ``html``, ``error``.  One row per site.

    A blank or invalid URL gives a row with a warning.  Of the store only pages on the sites' authorities are parsed.
    ``cities``: a gazetteer instead of the built-in one; ``recognizer``: names that it finds come after those of the patterns.
    """
    spark = sites.sparkSession
    named = sites.select("site_ord", "url", urls.normalized(F.col("url")).alias("source_url"))
    good = named.where("source_url IS NOT NULL").select(F.col("site_ord").alias("site_id"), "source_url")
    pages = written(page_facts(one_per_url(near_sites(store, good)), recognizer), "pages")
    read, found = gathered(good, pages, max_pages=max_pages)
    facts = site_facts(read.join(pages.select("url", *SITE_COLUMNS), "url"))
    merged = found.join(facts, "site_id", "left")
    tld = urls.country_of(F.col("source_url"))
    structured = phones.canonical_phones(F.concat(F.coalesce("ld.phones", F.expr(NO_TEXT)), F.coalesce("micro_phones", F.expr(NO_TEXT))), tld)
    merged = merged.withColumn("__sp", structured)
    address = F.when(F.col("ld.address.raw").isNotNull(), F.col("ld.address")).otherwise(F.col("micro"))
    merged = merged.select(
        "site_id", "source_url", "contact_page_url", "team_page_url", "warnings", "text", "snippet",
        F.array_union("__sp", F.coalesce("page_phones", F.expr(NO_TEXT))).alias("phones"),
        F.coalesce("names", F.expr(f"cast(array() as {PEOPLE})")).alias("names"),
        F.array_union(F.coalesce("ld.hours", F.expr(NO_TEXT)), F.coalesce("page_hours", F.expr(NO_TEXT))).alias("hours_raw"),
        F.coalesce(filled(address["locality"]), "meta_city").alias("city0"),
        filled(address["country"]).alias("country0"),
        F.coalesce(filled(address["raw"]), "snippet").alias("address0"),
        F.col("text").isNotNull().alias("read"),
    )
    hint = F.coalesce(tld, phones.region_of(F.col("phones")))
    merged = written(merged.withColumn("__hint", hint), "sites")  # read by the guess and by the rows
    # the gazetteer is only asked for sites that name no city themselves
    unknown = merged.where("read AND city0 IS NULL").select("site_id", "text", "snippet", F.coalesce("country0", "__hint").alias("preferred"))
    guess = guessed_cities(unknown, gazetteer.keyed(cities if cities is not None else gazetteer.builtin(spark)))
    full = merged.join(guess.select("site_id", F.col("city").alias("gcity"), F.col("countrycode").alias("gcountry"), "evidence"), "site_id", "left")
    city = F.coalesce("city0", "gcity")
    said = lambda cond, text: F.when(F.col("read") & cond, F.lit(text))
    quality = F.array(said(F.size("phones") == 0, fixed.W_NO_PHONE), said(F.size("hours_raw") == 0, fixed.W_NO_HOURS), said(F.size("names") == 0, fixed.W_NO_NAMES), said(city.isNull(), fixed.W_NO_CITY))
    rows = full.select(
        F.col("site_id").alias("site_ord"), "source_url", "contact_page_url", "team_page_url", "names", "phones",
        hours.best_hours(F.col("hours_raw")).alias("hours"), "hours_raw", city.alias("city"),
        F.when(F.col("read"), F.coalesce("country0", "gcountry", "__hint")).alias("country"),
        F.coalesce("address0", "evidence").alias("address_raw"),
        F.concat("warnings", F.filter(quality, lambda w: w.isNotNull())).alias("warnings"),
    )
    none = F.lit(None).cast("string")
    bad = named.where("source_url IS NULL").select(
        "site_ord", F.coalesce("url", F.lit("")).alias("source_url"), none.alias("contact_page_url"), none.alias("team_page_url"), F.expr(f"cast(array() as {PEOPLE})").alias("names"),
        F.expr(NO_TEXT).alias("phones"), none.alias("hours"), F.expr(NO_TEXT).alias("hours_raw"), none.alias("city"), none.alias("country"), none.alias("address_raw"),
        F.array(F.replace(F.lit(fixed.W_BAD_URL), F.lit("{error}"), urls.url_error(F.col("url")))).alias("warnings"),
    )
    return rows.unionByName(bad)
