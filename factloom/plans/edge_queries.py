"""Registered queries for what stands at a plan's edges: links, markup, fallbacks, output rows; with their DuckDB SQL.

All content is generated from row keys, so that every case of an operator occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, phones, urls
from ..operators.gather import home_pages, one_per_url
from ..sources import sinks
from ..sources.html_parse import parsed_pages
from .contact_facts import micro_address
from .queries import CARD_CITIES, _person_card, pick, read

#: Against the base ``https://s<key>.example/a/b/c``: an href and what it resolves to.
HREFS = (
    ("x.html", "https://s{k}.example/a/b/x.html"), ("/y", "https://s{k}.example/y"), ("../z", "https://s{k}.example/a/z"),
    ("//o.example/q", "https://o.example/q"), ("?p=1", "https://s{k}.example/a/b/c?p=1"), ("https://t.example/", "https://t.example/"), ("", "https://s{k}.example/a/b/c"),
)
#: Cells of a URL list, and whether they look like URLs.
CELLS = (("http://a b", True), ("HTTPS://X", True), ("acme.com", True), ("acme com", False), ("  ", False), ("a.b c", False), ("localhost", False))
CHAT = "573001234567"


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def linked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``tel:`` and WhatsApp links hold."""
    k = F.col("c_custkey")
    digits = F.lpad(k.cast("string"), 9, "0")
    href = (
        F.when(k % 5 == 0, _text("tel:+57%20", digits, "?ext=1")).when(k % 5 == 1, _text("TEL: 601 ", digits)).when(k % 5 == 2, _text("https://wa.me/", digits))
        .when(k % 5 == 3, _text("https://api.whatsapp.com/send?phone=57-", digits, "&text=x")).otherwise(F.lit("mailto:x@example.com"))
    )
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(phones.tel_numbers(F.array(F.lit(f"https://wa.me/{CHAT}"), href)), "|").alias("numbers"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", urls.resolved(_text("https://s", k, ".example/a/b/c"), pick(k, tuple(h for h, _ in HREFS))).alias("url"))


def url_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4."""
    return read(spark, sf_dir, "customer").select("c_custkey", urls.looks_like_url(pick(F.col("c_custkey"), tuple(c for c, _ in CELLS))).alias("looks"))


def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item properties and the place of every page, the first of each counting."""
    k = F.col("page_id")
    card = _text(
        '<div><span itemprop="addressLocality"> ', pick(k, CARD_CITIES), ' <b>Norte</b></span><meta itemprop="addressRegion" content="', F.when(k % 3 == 0, "").otherwise(_text("R", k)),
        '"><p itemprop="addressCountry">País</p><i itemprop="telephone">', k, '</i><span itemprop="addressLocality">otra</span></div><meta name="GEO.Placename" content="',
        F.when(k % 4 == 0, " ").otherwise(_text(" ", pick(k, CARD_CITIES), " ")), '"><meta name="geo.placename" content="otra">',
    )
    pages = parsed_pages(read(spark, sf_dir, "pages").select("page_id", "url", F.concat(card, F.coalesce("html", F.lit(""))).alias("html")))
    found = pages.select("page_id", micro_address(F.col("itemprops")).alias("a"), F.try_element_at("itemprops", F.lit("telephone")).alias("telephone"), "meta_city")
    return found.select("page_id", "a.locality", "a.region", "a.country", F.col("a.raw").alias("address"), "telephone", "meta_city")


def home_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the sites load, a third only with ``www.``, a third not at all."""
    k = F.col("c_custkey")
    own, other, none = _text("https://s", k, ".example"), _text("https://www.s", k, ".example"), F.lit(None).cast("string")
    c = read(spark, sf_dir, "customer")
    store = (
        c.where(k % 3 == 0).select(own.alias("url"), _text(own, "/home").alias("final_url"), _text("<p>", k).alias("html"), none.alias("error"))
        .unionByName(c.where(k % 3 == 1).select(other.alias("url"), none.alias("final_url"), _text("<b>", k).alias("html"), none.alias("error")))
        .unionByName(c.where((k % 3 == 1) & (k % 2 == 0)).select(own.alias("url"), none.alias("final_url"), none.alias("html"), F.lit("HTTP 500").alias("error")))
    )
    pages = one_per_url(store.unionByName(store.where(F.col("html").isNull())))  # some rows twice
    homes = home_pages(c.select(k.alias("site_id"), own.alias("source_url")), pages.withColumn("loads", F.col("html").isNotNull()))
    homes = homes.join(pages.select(F.col("url").alias("home_key"), "html"), "home_key", "left")
    return homes.select(F.col("site_id").alias("c_custkey"), "home_url", "html", F.array_join("warnings", " | ").alias("warnings"))


def _fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    person = lambda name, role: F.struct(name.alias("name"), role.alias("role"))
    nobody = F.expr("cast(array() as array<struct<name:string,role:string>>)")
    some = lambda cond, value: F.when(cond, value)
    return read(spark, sf_dir, "customer").select(
        _text("https://s", k, ".example").alias("source_url"),
        some(k % 2 == 0, _text("https://s", k, ".example/contacto")).alias("contact_page_url"),
        F.lit(None).cast("string").alias("team_page_url"),
        F.when(k % 3 == 0, nobody).otherwise(F.array(person(_person_card(k), F.when(k % 3 == 1, F.lit("Jefa"))), person(F.lit("Eva Gil"), F.lit("")))).alias("names"),
        F.when(k % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(_text("+57 ", k), F.lit("+34 1"))).alias("phones"),
        some(k % 5 == 0, F.lit("lunes 8:00 a 9:00")).alias("hours"),
        F.expr("cast(array() as array<string>)").alias("hours_raw"),
        pick(k, CARD_CITIES).alias("city"),
        some(k % 2 == 1, F.lit("PE")).alias("country"),
        some(k % 7 == 0, F.lit('Calle "5", x')).alias("address_raw"),
        F.when(k % 2 == 0, F.array(F.lit("uno"), F.lit("dos"))).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"),
    )


def csv_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, P10."""
    return sinks.csv_rows(_fact_rows(spark, sf_dir))


def human_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    return _fact_rows(spark, sf_dir).select("source_url", sinks.human_text().alias("text"))


QUERIES = {f.__name__: f for f in (linked_numbers, resolved_links, url_likeness, page_markup, home_fallback, csv_flatten, human_rows)}


def oracle_sql() -> dict[str, str]:
    from .oracles import _person, _pick

    city, who = _pick("k", CARD_CITIES), _person("k")
    cases = " ".join(f"WHEN {i} THEN '{to.format(k='§')}'" for i, (_, to) in enumerate(HREFS))
    said = lambda text, error: "'" + text.replace("{url}", "' || own || '").replace("{other}", "' || alt || '").replace("{error}", f"' || {error} || '") + "'"
    missing = "'no está en el almacén'"
    rows = f"""WITH f AS (SELECT c_custkey AS k, 'https://s' || c_custkey || '.example' AS source_url FROM customer),
     r AS (SELECT k, source_url, CASE WHEN k % 2 = 0 THEN source_url || '/contacto' END AS contact,
                  CASE WHEN k % 3 <> 0 THEN [{who} || CASE WHEN k % 3 = 1 THEN ' (Jefa)' ELSE '' END, 'Eva Gil'] ELSE [] END AS people,
                  CASE WHEN k % 4 <> 0 THEN ['+57 ' || k, '+34 1'] ELSE [] END AS phones, CASE WHEN k % 5 = 0 THEN 'lunes 8:00 a 9:00' END AS hours, {city} AS city,
                  CASE WHEN k % 2 = 1 THEN 'PE' END AS country, CASE WHEN k % 7 = 0 THEN 'Calle "5", x' END AS address FROM f)
"""
    return {
        "linked_numbers": f"""
WITH d AS (SELECT c_custkey, c_custkey % 5 AS m, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d FROM customer)
SELECT c_custkey, CASE m WHEN 0 THEN '+57 ' || d || '|+{CHAT}' WHEN 1 THEN '601 ' || d || '|+{CHAT}' WHEN 2 THEN '+{CHAT}|+' || d WHEN 3 THEN '+{CHAT}|+57-' || d ELSE '+{CHAT}' END AS numbers FROM d""",
        "resolved_links": f"SELECT c_custkey, replace(CASE c_custkey % {len(HREFS)} {cases} END, '§', CAST(c_custkey AS VARCHAR)) AS url FROM customer",
        "url_likeness": f"SELECT c_custkey, ([{', '.join(str(x).lower() for _, x in CELLS)}])[c_custkey % {len(CELLS)} + 1] AS looks FROM customer",
        "page_markup": f"""
WITH p AS (SELECT page_id, page_id AS k, CASE WHEN page_id % 3 <> 0 THEN 'R' || page_id END AS region FROM pages)
SELECT page_id, {city} || 'Norte' AS locality, region, 'País' AS country, concat_ws(', ', {city} || 'Norte', region, 'País') AS address,
       CAST(k AS VARCHAR) AS telephone, CASE WHEN k % 4 <> 0 THEN {city} END AS meta_city FROM p""",
        "home_fallback": f"""
WITH c AS (SELECT c_custkey, c_custkey % 3 AS m, 'https://s' || c_custkey || '.example' AS own, 'https://www.s' || c_custkey || '.example' AS alt FROM customer)
SELECT c_custkey, CASE m WHEN 0 THEN own || '/home' WHEN 1 THEN alt END AS home_url, CASE m WHEN 0 THEN '<p>' || c_custkey WHEN 1 THEN '<b>' || c_custkey END AS html,
       CASE m WHEN 0 THEN '' WHEN 1 THEN {said(fixed.W_WWW, f"CASE WHEN c_custkey % 2 = 0 THEN 'HTTP 500' ELSE {missing} END")} ELSE {said(fixed.W_HOME, missing)} END AS warnings FROM c""",
        "csv_flatten": rows + """SELECT source_url, coalesce(contact, '') AS contact_page_url, '' AS team_page_url, array_to_string(people, '; ') AS names, array_to_string(phones, '; ') AS phones,
       coalesce(hours, '') AS hours, city, coalesce(country, '') AS country, coalesce(address, '') AS address_raw, CASE WHEN k % 2 = 0 THEN 'uno | dos' ELSE '' END AS warnings FROM r""",
        "human_rows": rows + """SELECT source_url, concat_ws(chr(10), 'URL:              ' || source_url, 'Página de contacto: ' || coalesce(contact, '(no encontrada; se usó la página principal)'),
       'Página de equipo: (no encontrada)', 'Nombres:          ' || coalesce(nullif(array_to_string(people, ', '), ''), '(ninguno encontrado)'),
       'Teléfonos:        ' || coalesce(nullif(array_to_string(phones, ', '), ''), '(ninguno encontrado)'), 'Horario:          ' || coalesce(hours, '(no encontrado)'),
       'Ciudad probable:  ' || city, 'País:             ' || country, 'Dirección (texto): ' || address,
       CASE WHEN k % 2 = 0 THEN 'Avisos:' || chr(10) || '  - uno' || chr(10) || '  - dos' END) AS text FROM r""",
    }
