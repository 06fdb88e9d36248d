import http.server
import io
import json
import threading
from pathlib import Path

import pytest

from factloom.functions import fixed
from factloom.plans.contact_facts import contact_facts
from factloom.sources import sinks
from factloom.sources.fetch import Fetcher
from factloom.sources.url_lists import all_urls, urls_from_file

LD = '{"@graph":[{"@type":"LocalBusiness","telephone":"+57 315 222 1111","address":{"streetAddress":"Calle 1","addressLocality":"Bogotá","addressCountry":{"name":"Colombia"}},"openingHours":"Mo-Fr 08:00-18:00","employee":[{"@type":"Person","name":"Dr. Juan Mora","jobTitle":"Gerente"}]}]}'
HOME = f'<script type="application/ld+json">{LD}</script><nav><a href="/contacto">Contáctenos</a><a href="/equipo">Nuestro equipo</a></nav>'
CONTACT = '<p>Atiende: Sra. Ana Ruiz</p><a href="tel:+573152221111">x</a><p>sábados 8:00 a 12:00</p>'
TEAM = "<h3>Dra. Luz Gómez</h3><p>Odontóloga general</p>"
STORE = "url string, final_url string, html string, error string"


def test_facts_of_sites(spark):
    store = spark.createDataFrame(
        [("https://acme.com.co", None, HOME, None), ("https://acme.com.co/contacto", None, CONTACT, None), ("https://acme.com.co/equipo", None, TEAM, None), ("https://www.solo.mx", None, "<p>Estamos en Guadalajara</p>", None), ("https://bad.com", None, None, "HTTP 500")], STORE
    )
    sites = spark.createDataFrame([(0, "acme.com.co"), (1, "solo.mx"), (2, "bad.com"), (3, " ")], "site_ord int, url string")
    facts = contact_facts(sites, store)
    rows = {r["site_ord"]: r for r in facts.collect()}
    full = rows[0]
    assert [(p["name"], p["role"]) for p in full["names"]] == [("Juan Mora", "Gerente"), ("Ana Ruiz", None), ("Luz Gómez", "Odontóloga general")]
    assert full["phones"] == ["+57 315 2221111"] and full["hours_raw"] == ["Lunes a Viernes: 08:00–18:00", "sábados 8:00 a 12:00"]
    assert (full["city"], full["country"], full["contact_page_url"], full["warnings"]) == ("Bogotá", "Colombia", "https://acme.com.co/contacto", [])
    assert rows[1]["city"] == "Guadalajara" and rows[1]["country"] == "MX" and "se usó https://www.solo.mx" in rows[1]["warnings"][0]
    assert rows[2]["phones"] == [] and "HTTP 500" in rows[2]["warnings"][0]
    assert rows[3]["warnings"] == ["URL inválida: empty URL"]
    csv = {r["source_url"]: r for r in sinks.csv_rows(facts).collect()}
    assert csv["https://acme.com.co"]["names"].startswith("Juan Mora (Gerente); ") and csv["https://bad.com"]["city"] == ""


def test_url_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\n\n one.com \ntwo.com\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("﻿Nombre,Sitio Web\nA,one.com\nB,\nC,two.com\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("one.com,x\ntwo.com,y\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("", encoding="utf-8")
    read = lambda f: [r["url"] for r in urls_from_file(spark, str(tmp_path / f)).orderBy("site_ord").collect()]
    assert read("a.txt") == read("b.csv") == read("c.csv") == ["one.com", "two.com"] and read("d.csv") == []
    assert [r["url"] for r in all_urls(spark, ["zero.com"], str(tmp_path / "a.txt")).orderBy("site_ord").collect()] == ["zero.com", "one.com", "two.com"]


def test_fetcher_against_a_local_server():
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body, kind, code = {"/robots.txt": (b"User-agent: *\nDisallow: /no", "text/plain", 200), "/ok": ("sí".encode(), "text/html; charset=utf-8", 200), "/pdf": (b"x", "application/pdf", 200)}.get(self.path, (b"", "text/html", 404))
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, fetcher = f"http://127.0.0.1:{server.server_port}", Fetcher(timeout=5)
    assert fetcher.fetch(base + "/ok")["html"] == "sí"
    assert fetcher.fetch(base + "/missing")["error"] == "HTTP 404" and "not HTML" in fetcher.fetch(base + "/pdf")["error"]
    assert "robots" in fetcher.fetch(base + "/no")["error"] and "http" in fetcher.fetch("ftp://x")["error"]
    server.shutdown()


class Pages(http.server.BaseHTTPRequestHandler):
    """A small site: counts requests and connections, hangs up on one path."""

    protocol_version = "HTTP/1.1"
    pages = {
        "/": '<a href="/who">x</a><a href="/equipo">Nuestro equipo</a><p>hola</p>',
        "/contact": "<p>Responsable: Eva Luna Gil</p><p>+34 612 34 56 78</p>",
        "/equipo": "<h3>Dra. Nora Vidal</h3><p>Directora de obra</p>",
    }
    seen: list[str] = []
    peers: set = set()

    def do_GET(self):
        self.seen.append(self.path)
        self.peers.add(self.client_address)
        if self.path == "/broken":
            self.wfile.write(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 99\r\n\r\nshort")
            self.close_connection = True
            return
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/equipo")
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        body = self.pages.get(self.path, "").encode()
        self.send_response(200 if body else 404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    Pages.seen, Pages.peers = [], set()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_one_connection_and_failures_as_rows(site):
    fetcher = Fetcher(timeout=5)
    assert fetcher.fetch(site + "/moved")["final_url"] == site + "/equipo" and fetcher.fetch(site + "/")["status_code"] == 200
    assert fetcher.fetch(site + "/no")["error"] == "HTTP 404" and len(Pages.peers) == 1
    assert fetcher.fetch(site + "/broken")["error"] and fetcher.fetch(site + "/")["html"]
    assert fetcher.fetch("http://127.0.0.1:1/")["error"] and fetcher.fetch("http://[bad/")["error"] and fetcher.fetch("http://a b/")["error"]


def test_crawl_tries_what_the_plan_tries(spark, site, tmp_path):
    from factloom.api import site_facts

    store = f"{tmp_path}/store"
    row = site_facts(spark, [site], store=store, pause=0.0).first()
    # no contact link: usual paths until one loads, within the budget; the linked team page comes first
    assert [p for p in Pages.seen if p != "/robots.txt"] == ["/", "/equipo", "/contacto", "/contacto.html"]
    assert row["team_page_url"] == site + "/equipo" and row["contact_page_url"] is None
    assert [(p["name"], p["role"]) for p in row["names"]] == [("Nora Vidal", "Directora de obra")]
    before = len(Pages.seen)
    again = site_facts(spark, [site, site], store=store, pause=0.0, max_pages=7).collect()
    assert [p for p in Pages.seen[before:] if p != "/robots.txt"] == ["/contactenos", "/contactanos", "/contact"]
    assert len(again) == 2 and again[0]["contact_page_url"] == site + "/contact" and again[0]["phones"] == ["+34 612 34 56 78"]


def test_store_with_a_url_twice(spark):
    rows = [("https://a.es", None, "<p>tel +34 612 34 56 78</p>", None), ("https://a.es", None, None, "HTTP 500"), ("https://a.es", "https://a.es/", "<p>tel +34 612 34 56 78</p>", None), ("https://other.es", None, "<p>x</p>", None)]
    found = contact_facts(spark.createDataFrame([(0, "\ta.es\r\n")], "site_ord int, url string"), spark.createDataFrame(rows, STORE)).collect()
    assert len(found) == 1 and found[0]["phones"] == ["+34 612 34 56 78"] and found[0]["source_url"] == "https://a.es"


def test_sinks_round_trip(spark, tmp_path):
    store = spark.createDataFrame([("https://acme.com.co", None, HOME, None)], STORE)
    facts = contact_facts(spark.createDataFrame([(0, "acme.com.co"), (1, "")], "site_ord int, url string"), store).cache()
    sinks.write_csv(facts, f"{tmp_path}/csv")
    table = spark.read.csv(f"{tmp_path}/csv", header=True, quote='"', escape='"', multiLine=True)
    assert tuple(table.columns) == fixed.CSV_COLUMNS and [r["source_url"] for r in table.collect()] == ["https://acme.com.co", ""] or table.first()["phones"] == "+57 315 2221111"
    assert sinks.table_rows(facts).columns == [c for c in fixed.CSV_COLUMNS if c != "address_raw"]
    sinks.write_json(facts, f"{tmp_path}/json")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert {x["source_url"]: x["phones"] for x in lines} == {"https://acme.com.co": ["+57 315 2221111"], "": []} and all("hours" in x for x in lines)


def test_command_line(spark, tmp_path):
    from factloom.cli import main

    spark.createDataFrame([("https://acme.com.co", None, HOME, None)], STORE).selectExpr("url", "final_url", "cast(200 as int) AS status_code", "html", "error").write.parquet(f"{tmp_path}/store")
    (tmp_path / "list.txt").write_text("acme.com.co\n", encoding="utf-8")
    for flags, check in (
        (["--json"], lambda t: [x["phones"] for x in json.loads(t)] == [["+57 315 2221111"]] * 2),
        (["--output", f"{tmp_path}/out", "--json"], lambda t: t == ""),
    ):
        out = io.StringIO()
        assert main(["acme.com.co", "--input", f"{tmp_path}/list.txt", "--store", f"{tmp_path}/store", *flags], spark, out) == 0 and check(out.getvalue()), flags
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 2
    for wrong in ([], ["acme.com.co"]):
        with pytest.raises(SystemExit):
            main(wrong, spark)


def test_sql_functions(spark):
    from factloom.api import register

    register(spark)
    assert spark.sql("SELECT canonical_phones(array('315 222 1111', 'x'), 'CO') AS p").first()["p"] == ["+57 315 2221111"]
    assert spark.sql("SELECT resolved_url('https://a.es/b/c', '../d') AS u").first()["u"] == "https://a.es/d"
    assert [tuple(r) for r in spark.sql("SELECT * FROM page_links('<a href=\"/x\">y</a>', 'https://a.es')").collect()] == [(0, "/x", "y", "https://a.es/x")]


def test_city_table_and_recognizer(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.sources.gazetteer import from_table

    line = lambda name, other, country, people: "\t".join(["1", name, name, other, "0", "0", "P", "PPL", country, "", "", "", "", "", str(people), "", "", "UTC", "2020-01-01"])
    (tmp_path / "cities.txt").write_text("\n".join([line("Cabo Nuevo", "Nuevo Cabo,Kap Neu", "CL", 900_000), line("Vacía", "", "PE", "")]), encoding="utf-8")
    cities = from_table(spark, f"{tmp_path}/cities.txt")
    assert [(r["name"], r["countrycode"], r["population"], r["alternatenames"]) for r in cities.orderBy("ord").collect()] == [("Cabo Nuevo", "CL", 900_000, ["Nuevo Cabo", "Kap Neu"]), ("Vacía", "PE", 0, [])]
    store = spark.createDataFrame([("https://a.com", None, "<p>Somos de Nuevo Cabo</p><p>Sr. Ramón Paz Gil</p><p>con RITA SOL</p>", None)], STORE)
    found = contact_facts(spark.createDataFrame([(0, "a.com")], "site_ord int, url string"), store, cities=cities, recognizer=lambda t: F.regexp_extract_all(t, F.lit("([A-Z]+ SOL|Ramón Paz Gil)"), 1)).first()
    assert (found["city"], found["country"]) == ("Nuevo Cabo", "CL") and [p["name"] for p in found["names"]] == ["Ramón Paz Gil", "Rita Sol"]


def test_a_stopped_run_keeps_finished_sites(spark, tmp_path):
    from factloom.scratch import scratch_path
    from factloom.streaming.incremental import facts_stream

    for old in Path(scratch_path(spark, "x").removeprefix("file:")).parent.glob("sites-*"):
        old.rename(old.with_name("old-" + old.name))
    store = spark.createDataFrame([("https://solo.mx", None, "<p>Estamos en Guadalajara</p>", None)], STORE)
    folders = [str(tmp_path / x) for x in ("in", "out", "cp")]
    read = lambda: sorted(r["site_ord"] for r in spark.read.parquet(folders[1]).collect())
    spark.createDataFrame([(0, "solo.mx")], "site_ord int, url string").coalesce(1).write.mode("append").parquet(folders[0])
    query = facts_stream(spark, folders[0], store, *folders[1:])
    query.processAllAvailable()
    query.stop()
    assert read() == [0] and not list(Path(scratch_path(spark, "x").removeprefix("file:")).parent.glob("sites-*"))
    spark.createDataFrame([(1, "solo.mx")], "site_ord int, url string").coalesce(1).write.mode("append").parquet(folders[0])
    facts_stream(spark, folders[0], store, *folders[1:]).awaitTermination(120)
    assert read() == [0, 1]


def test_stream_equals_batch(spark, tmp_path):
    from factloom.streaming.incremental import facts_stream

    store = spark.createDataFrame([("https://solo.mx", None, "<p>Estamos en Guadalajara</p>", None)], STORE)
    spark.createDataFrame([(0, "solo.mx")], "site_ord int, url string").write.parquet(str(tmp_path / "in"))
    facts_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["city"] == "Guadalajara"
