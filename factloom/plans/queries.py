"""Registered queries: one per operator or family, over whole driver tables.

Where the tables lack such content, a query appends generated cards, computed from the row's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, hours, jsonld, names, phones, text, urls
from ..operators.city import address_snippet, guessed_cities, window_counts
from ..operators.gather import kept_tries
from ..operators.link_ranking import ranked_links
from ..operators.merge import merged_people, ordered_distinct
from ..sources import gazetteer, sinks
from ..sources.html_parse import parsed_pages
from .contact_facts import contact_facts

TLDS = ("es", "com.mx", "co", "com", "org", "pt", "xyz")
FIRST, LAST, ROLE = ("Ana", "Luis", "Carla", "Pedro", "Marta"), ("Ruiz", "Navarro", "Ocampo", "Mora"), ("Directora", "Ver perfil", "Llama ahora", "Asesor comercial", "Carla Mora")
CARD_CITIES = ("Lima", "Bogotá", "Guadalajara", "Medellín", "Quito", "Cusco")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(text.words(values), (key % len(values) + 1).cast("int"))


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third URL comes without its scheme."""
    raw = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    full = read(spark, sf_dir, "pages").select("page_id", urls.normalized(raw).alias("url"))
    return full.select("page_id", F.col("url").alias("url_normalized"), urls.www_toggled(F.col("url")).alias("url_toggled"), urls.origin(F.col("url")).alias("origin"))


def country_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, J3, P13."""
    url = F.concat(F.lit("https://site"), F.col("page_id"), F.lit("."), pick(F.col("page_id"), TLDS), F.lit("/x"))
    return read(spark, sf_dir, "pages").select("page_id", urls.country_of(url).alias("country"))


def common_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: usual contact paths on every origin."""
    origins = read(spark, sf_dir, "pages").select(urls.origin(F.col("url")).alias("origin")).distinct()
    return origins.select("origin", F.posexplode(urls.common_paths(F.col("origin"), fixed.CONTACT_PATHS)).alias("pos", "url"))


def carded_pages(spark: SparkSession, sf_dir: str, own_html: bool = True) -> DataFrame:
    """Pages with generated anchors before their own HTML."""
    k = F.col("page_id")
    cards = F.concat(
        F.lit('<a href="/contacto">Contáctenos</a><a href="mailto:x@example.com">contacto</a><a href="/c'), (k % 5).cast("string"),
        F.lit('">Contact us</a><a href="https://other.example/contacto">Contacto</a><a href="/contacto">otra</a><a href="/equipo-'), (k % 3).cast("string"), F.lit('">Nuestro equipo médico</a>'),
    )
    return read(spark, sf_dir, "pages").select("page_id", "url", (F.concat(cards, "html") if own_html else cards).alias("html"))


def link_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best contact links of every page."""
    pages = parsed_pages(carded_pages(spark, sf_dir))
    best = ranked_links(F.col("anchors"), F.col("url"), fixed.CONTACT_WORDS, fixed.CONTACT_LINKS)
    found = pages.select("page_id", F.posexplode(best).alias("at", "l"))
    return found.select("page_id", F.col("l.url").alias("link"), "l.score", (F.col("at") + 1).alias("rank"))


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2: both texts of every page."""
    return parsed_pages(read(spark, sf_dir, "pages")).select("page_id", "text", "text_no_nav")


def hours_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated sentence after every document."""
    k = F.col("doc_id")
    card = F.concat(F.lit("\nAbrimos de lunes a viernes de "), (k % 4 + 7).cast("string"), F.lit(":30 a "), (k % 5 + 16).cast("string"), F.lit(":00; sábado 10h - 13h"))
    found = hours.hours_in_text(F.concat(F.coalesce("text", F.lit("")), card))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "|").alias("hours"), hours.best_hours(found).alias("best"))


def compact_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11, J4."""
    k = F.col("s_suppkey")
    value = F.when(k % 4 == 0, F.lit("siempre")).when(k % 4 == 1, F.concat(F.lit("Sa 0"), k % 9, F.lit(":00-12:00"))).otherwise(F.concat(F.lit("x Mo-Fr 0"), k % 9, F.lit(":30-18:00, Su 10:00-11:00")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", hours.compact_hours(value).alias("hours"))


def _person_card(k: Column) -> Column:
    return F.concat(pick(k, FIRST), F.lit(" "), pick(F.floor(k / 5).cast("long"), LAST))


def names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated card for every customer."""
    k = F.col("c_custkey")
    card = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("Dra. "), _person_card(k))).when(k % 3 == 1, F.concat(F.lit("Contacto: "), F.upper(_person_card(k)))).otherwise(_person_card(k)),
        F.lit("\n"), pick(F.floor(k / 3).cast("long"), ROLE), F.lit("\nNuestra Historia\nVentas"),
    )
    found = names.names_in_text(card)
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(found, names.display), "; ").alias("people"))


def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10, X11."""
    k = F.col("c_custkey")
    raw = F.concat(pick(k, ("Dr. ", "sra ", "", "Lic. ")), F.when(k % 2 == 0, F.upper(_person_card(k))).otherwise(_person_card(k)), pick(F.floor(k / 7).cast("long"), (" 🇪🇸", "", " S.A.", " (jefa)")))
    return read(spark, sf_dir, "customer").select("c_custkey", names.clean_person_name(raw).alias("name"))


def address_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13."""
    k = F.col("doc_id")
    card = F.concat(F.lit("Dirección: Calle "), k.cast("string"), F.lit(", "), pick(k, CARD_CITIES), F.lit(". \n"), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", address_snippet(card).alias("address"))


def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every document's words, counted by size."""
    counted = read(spark, sf_dir, "documents").select("doc_id", F.explode(window_counts(F.coalesce("text", F.lit("")))).alias("w"))
    return counted.select("doc_id", "w.size", F.col("w.n").alias("n_windows"))


def city_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cities in every customer's text, one of them in the address for some."""
    k = F.col("c_custkey")
    one, two = pick(k, CARD_CITIES), pick(F.floor(k / 6).cast("long"), CARD_CITIES)
    sites = read(spark, sf_dir, "customer").select(
        k.alias("site_id"),
        F.concat(F.lit("visite "), one, F.lit(" o bien "), two).alias("text"),
        F.when(k % 4 == 0, F.concat(F.lit("calle 5 en "), two)).alias("snippet"),
        F.when(k % 5 == 0, F.lit("PE")).alias("preferred"),
    )
    found = guessed_cities(sites, gazetteer.keyed(gazetteer.builtin(spark)))
    return found.select(F.col("site_id").alias("c_custkey"), "city", "countrycode", "population", "evidence", "from_address_line")


def jsonld_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made from suppliers; some malformed, some in a graph, some with a country object."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    country = F.when(k % 3 == 0, F.concat(F.lit('{"@type":"Country","name":"'), "n_name", F.lit('"}'))).otherwise(F.concat(F.lit('"'), "n_name", F.lit('"')))
    node = F.concat(
        F.lit('{"@type":["'), F.when(k % 5 == 0, F.lit("Thing")).otherwise(F.lit("LocalBusiness")), F.lit('"],"telephone":" +'), k.cast("string"), F.lit(' ","address":{"streetAddress":"Calle '), k.cast("string"),
        F.lit('","addressLocality":"'), "s_name", F.lit('","addressCountry":'), country, F.lit('},"employee":{"@type":"Person","name":"'), _person_card(k), F.lit('","jobTitle":"Jefe"}}'),
    )
    script = F.when(k % 7 == 0, F.concat(F.lit("{"), node)).when(k % 2 == 0, F.concat(F.lit('{"@graph":['), node, F.lit("]}"))).otherwise(node)
    found = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", jsonld.summary(jsonld.nodes(jsonld.unwrapped(F.array(script)))).alias("f"))
    return found.select("s_suppkey", F.array_join("f.phones", "|").alias("phones"), F.array_join(F.transform("f.names", names.display), "|").alias("people"), F.col("f.address.locality").alias("locality"), F.col("f.address.country").alias("country"), F.col("f.address.raw").alias("address"))


def hours_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening hours objects made from suppliers."""
    k = F.col("s_suppkey")
    spec = F.concat(F.lit('[{"dayOfWeek":["https://schema.org/Monday","'), pick(k, ("Tuesday", "Fr", "Feriados")), F.lit('"],"opens":"0'), (k % 9).cast("string"), F.lit(':00"'), F.when(k % 4 == 0, F.lit("")).otherwise(F.lit(',"closes":"18:00"')), F.lit('},"Sa 09:00-12:00"]'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(jsonld.hours_spec(F.try_parse_json(spec)), "|").alias("hours"))


def gathered_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' orders stand for tries, finished ones for pages that load; budget 3."""
    o = read(spark, sf_dir, "orders")
    tries = o.select(F.col("o_custkey").alias("site_id"), (F.col("o_orderkey") % 4).alias("grp"), F.col("o_orderkey").alias("i"), (F.col("o_orderstatus") == "F").alias("ok"))
    return kept_tries(tries, 3).select("site_id", "grp", "i", "ok")


def people_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations stand for mentions."""
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    role = F.when(k % 3 == 0, pick(k, ("Jefe", "Ventas"))).otherwise(F.lit(None))
    mentions = c.select(F.col("conv_id").alias("site_id"), F.when(F.col("turn") < 2, 0).otherwise(1).alias("src"), F.floor(F.col("turn") / 3).cast("int").alias("page"), F.col("turn").cast("int").alias("o"), pick(F.col("turn") * 7 + F.col("conv_id"), FIRST).alias("name"), role.alias("role"))
    return merged_people(mentions).select(F.col("site_id").alias("conv_id"), F.array_join(F.transform("names", names.display), "; ").alias("people"))


def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of every conversation in order of first appearance."""
    c = read(spark, sf_dir, "conversations")
    return ordered_distinct(c.select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", F.array_join("role", "|").alias("roles"))


def phone_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made from customers in several spellings."""
    k = F.col("c_custkey")
    digits = F.lpad((k % 10_000_000).cast("string"), 7, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("+57 300 "), digits)).when(k % 4 == 1, F.concat(F.lit("(601) "), digits)).when(k % 4 == 2, F.concat(F.lit("+34 69"), digits)).otherwise(F.concat(F.lit("12"), digits))
    rows = read(spark, sf_dir, "customer").select("c_custkey", phones.canonical_phones(F.array(raw), F.lit("CO")).alias("p"))
    return rows.select("c_custkey", F.get("p", 0).alias("phone"), phones.region_of(F.col("p")).alias("region"))


def phones_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid numbers in every document."""
    found = phones.phones_in_text(F.coalesce("text", F.lit("")), F.expr("cast(array() as array<string>)"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "|").alias("phones"))


def _sites(spark: SparkSession, sf_dir: str, own_html: bool = True) -> tuple[DataFrame, DataFrame]:
    """Every page is the home page of a site of its own, with a contact page behind it; some lack either.

    Without ``own_html`` home pages hold the generated links only.
    """
    k = F.col("page_id")
    base = F.concat(F.lit("https://s"), k.cast("string"), F.lit("."), pick(k, TLDS))
    pages = carded_pages(spark, sf_dir, own_html)
    card = F.concat(F.lit("<p>Atiende: Sra. "), _person_card(k), F.lit('</p><a href="tel:+57300'), F.lpad(k.cast("string"), 7, "0"), F.lit('">x</a><p>lunes a viernes 8:00 a 17:00</p><p>Dirección: Calle 5, '), pick(k, CARD_CITIES), F.lit("</p>"))
    none = F.lit(None).cast("string")
    home = pages.where(k % 11 != 0).select(base.alias("url"), base.alias("final_url"), "html", none.alias("error"))
    contact = pages.where(k % 4 != 0).select(F.concat(base, F.lit("/contacto")).alias("url"), none.alias("final_url"), card.alias("html"), none.alias("error"))
    return pages.select(k.cast("int").alias("site_ord"), base.alias("url")), home.unionByName(contact)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan, as CSV rows (K1, C2, C5, C6 and all above)."""
    sites, store = _sites(spark, sf_dir)
    return sinks.csv_rows(contact_facts(sites, store))


def facts_of_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over generated pages only, of which every column is known."""
    sites, store = _sites(spark, sf_dir, own_html=False)
    return sinks.csv_rows(contact_facts(sites, store))


def facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan, as JSON rows (K3)."""
    sites, store = _sites(spark, sf_dir)
    return sinks.json_rows(contact_facts(sites, store))


def facts_json_of_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON rows (K3)."""
    sites, store = _sites(spark, sf_dir, own_html=False)
    return sinks.json_rows(contact_facts(sites, store))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, store = _sites(spark, sf_dir)
    return contact_facts(sites, store)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .edge_queries import QUERIES  # it uses the helpers above

    return QUERIES | {
        "url_functions": url_functions, "country_of_url": country_of_url, "common_paths": common_paths, "link_ranking": link_ranking,
        "visible_text": visible_text, "hours_in_text": hours_in_text, "compact_hours": compact_hours, "hours_spec": hours_spec,
        "names_in_text": names_in_text, "cleaned_names": cleaned_names, "address_in_text": address_in_text, "word_ngrams": word_ngrams,
        "city_of_text": city_of_text, "jsonld_facts": jsonld_facts, "gathered_tries": gathered_tries, "people_merge": people_merge,
        "ordered_dedup": ordered_dedup, "phone_canonical": phone_canonical, "phones_in_documents": phones_in_documents,
        "facts": facts, "facts_of_cards": facts_of_cards, "facts_json_of_cards": facts_json_of_cards, "facts_json": facts_json,
    }
