import pytest
from pyspark.sql import functions as F

from factloom.functions import fixed, hours, jsonld, names, phones, urls
from factloom.operators.city import address_snippet
from factloom.sources.html_parse import parse_page


def value(spark, function, text):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Abrimos de lunes a viernes de 9:00 a 18:00 y sábados 10h - 14h.", ["lunes a viernes de 9:00 a 18:00", "sábados 10h - 14h"]),
        ("Nuestro horario es de 9 a 18 horas", ["Nuestro horario es de 9 a 18 horas"]),
        ("Son 7 socios y un horario", []),
        ("nada", []),
    ],
)
def test_hours(spark, text, expected):
    assert value(spark, hours.hours_in_text, text) == expected


def test_names_with_roles(spark):
    text = "Dr. Bruno Salinas\nDirector Médico\nContacto: Ana Ruiz de la Vega\nVer perfil\nCarla Pérez\nCEO Fundadora\nNuestra Historia\nAlgo bonito\nContacto: Comercializadora Pacífico S.A.S.\n"
    found = [(p["name"], p["role"]) for p in value(spark, names.names_in_text, text)]
    assert found == [("Bruno Salinas", "Director Médico"), ("Ana Ruiz de la Vega", None), ("Carla Pérez", "CEO Fundadora")]


@pytest.mark.parametrize(("raw", "name"), [("Dr. Bruno Salinas 🇨🇱", "Bruno Salinas"), ("ANA RUIZ", "Ana Ruiz"), ("Acme S.L.", None), ("Luis", "Luis"), ("", None), ("O'CAMPO DÍAZ", "O'Campo Díaz")])
def test_clean_person_name(spark, raw, name):
    assert value(spark, names.clean_person_name, raw) == name


@pytest.mark.parametrize(
    ("raw", "country", "number"),
    [("+57 315 222 1111", None, "+57 315 2221111"), ("+52 55 1234 5678", None, "+52 55 1234 5678"), ("604 7654321", "CO", "+57 604 7654321"), ("688 21 43 65", "ES", "+34 688 21 43 65"), ("2015", None, None), ("+33 (0)1 44 55 66 77", None, "+33 1 44 55 66 77"), ("+49 30 123456", None, "+49 301 234 56"), ("+998 71 200 11 22", None, "+998 712 001 122"), ("+999", None, None), (None, "ES", None)],
)
def test_phones(raw, country, number):
    assert phones.canonical(raw, country) == number


def test_a_span_is_claimed_once():
    assert phones.in_text("604 7654321, +34 688 21 43 65, desde 2015", "CO") == ["+34 688 21 43 65", "+57 604 7654321"]


def test_urls(spark):
    assert value(spark, urls.normalized, " acme.com.co/x ") == "https://acme.com.co/x"
    assert value(spark, urls.normalized, "  ") is None
    assert value(spark, urls.country_of, "https://acme.com.co:80/x") == "CO"
    assert value(spark, urls.www_toggled, "https://WWW.acme.co/x") == "https://acme.co/x"


def test_address(spark):
    assert value(spark, address_snippet, "x\nDirección: Calle 5, Lima.\ny") == "Calle 5, Lima"
    assert value(spark, address_snippet, "x") is None


def test_malformed_json_gives_no_nodes(spark):
    assert value(spark, lambda c: jsonld.nodes(F.array(c)), "{oops") == []


def test_nodes_at_any_depth():
    deep = '{"@graph": [[[[{"@graph": {"@graph": {"name": "a"}, "x": 1}}]]], {"name": "b", "name": "c"}, 5, NaN]}'
    assert jsonld.node_texts(deep) == ["{}", "{}", '{"x": 1}', '{"name": "a"}', '{"name": "c"}']
    assert jsonld.node_texts("[" * 100_000) == [] and jsonld.node_texts("") == [] and jsonld.node_texts("3") == []


def test_all_blanks_go(spark):
    for raw in ("\thttp://a.com\n", "\u3000http://a.com\x1c", "\xa0 http://a.com\r"):
        assert value(spark, urls.normalized, raw) == "http://a.com"
    assert value(spark, urls.normalized, "a.com\r") == "https://a.com" and value(spark, urls.normalized, "\u2003\n") is None


def test_window_counts_against_loops(spark):
    import re

    from factloom.operators.city import window_counts

    for text in ("", "uno", "Uno", "a B c D e f G", "Á b' c.d E", "x y z " * 30 + "La Paz"):
        ws = re.findall(fixed.CITY_WORD, text)
        expected = {n: k for n in (1, 2, 3) if (k := sum(any(w[0].isupper() for w in ws[i : i + n]) for i in range(len(ws) - n + 1)))}
        assert {r["size"]: r["n"] for r in value(spark, window_counts, text)} == expected


def test_cities_of_several_words(spark):
    from factloom.operators.city import guessed_cities
    from factloom.sources.gazetteer import builtin, keyed

    rows = [(1, "ven a santa Cruz de la sierra hoy", None), (2, "en San Salvador y Lima", None), (3, "san José", "calle 1, San José"), (4, "la paz", None), (5, "La", None), (6, "", "")]
    found = guessed_cities(spark.createDataFrame(rows, "site_id int, text string, snippet string").selectExpr("*", "cast(null as string) AS preferred"), keyed(builtin(spark)))
    got = {r["site_id"]: (r["city"], r["evidence"]) for r in found.collect()}
    assert got == {1: ("Santa Cruz", "santa Cruz"), 2: ("San Salvador", "San Salvador"), 3: ("San José", "San José")}


def test_page_parser():
    page = parse_page('<nav><a href="x">M <b>n</b></a></nav><script>no</script><p>a<!-- c -->b&amp;<br>d<span itemprop="telephone">1 <b>2</b></span><meta name="geo.placename" content=" Lima ">', "https://h/en/")
    assert page["text"].split("\n") == ["M", "n", "a", "b&", "d", "1", "2"]
    assert page["text_no_nav"].split("\n") == ["a", "b&", "d", "1", "2"]
    assert page["anchors"] == [{"pos": 0, "href": "x", "text": "M n", "url": "https://h/en/x"}]
    assert page["itemprops"] == {"telephone": "12"} and page["meta_city"] == "Lima"
    assert parse_page(None, None)["text"] == ""


def test_only_ended_names_are_entities():
    import duckdb

    from factloom.plans.oracles import oracle_sql

    pages = ["<title>a &amp;&amp</title><p>b&am</p>&amp;amp; &copy;<nav>&quot;&amp</nav>", "<p>x &middot; y&quo", "<script>a&amp;b</script>&copy"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT unnest(range(?)) AS page_id, unnest(?) AS html", [len(pages), pages])
    rows = con.sql(oracle_sql()["visible_text"]).fetchall()
    assert {r[0]: r[1:] for r in rows} == {i: (p["text"], p["text_no_nav"]) for i, p in enumerate(parse_page(h, "https://h/") for h in pages)}
    assert parse_page("&#65&#x42; &notit; &eacute; & &;<textarea>&lt;</textarea>&lt", "https://h/")["text"] == "AB &notit; é & &;\n<\n&lt"
    assert parse_page('<script type="application/ld+json">{"a": "&amp;"}</script>', "https://h/")["ld_json"] == ['{"a": "&amp;"}']
