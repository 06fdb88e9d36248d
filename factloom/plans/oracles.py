"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ..functions import fixed
from ..sources.gazetteer import CITIES
from .queries import CARD_CITIES, FIRST, LAST, ROLE, TLDS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(key: str, values) -> str:
    return f"({_list(values)})[({key}) % {len(values)} + 1]"


def _person(k: str) -> str:
    return f"({_pick(k, FIRST)} || ' ' || {_pick(f'({k}) // 5', LAST)})"


def _cities() -> str:
    rows = [(name, c[1], c[2], i * 10_000 + a) for i, c in enumerate(CITIES) for a, name in enumerate((c[0], *c[3:]))]
    return ", ".join(f"(lower(strip_accents('{n}')), '{n}', '{cc}', {p}, {o})" for n, cc, p, o in rows)


def _keyword_points() -> str:
    from ..functions.text import fold_word

    return ", ".join(f"('{fold_word(w)}', {i})" for i, w in enumerate(fixed.CONTACT_WORDS))


#: A time of day without the look-ahead that DuckDB's patterns lack.
_CLOCK = r"\d{1,2}(?::\d{2})?\s?(?:h(?:rs?|oras?)?\b\.?|[ap]\.?\s?m\.?)?"


def _facts_of_cards() -> str:
    """What the generated home and contact pages say, and what is said of those that are missing."""
    said = lambda text, url, error="no está en el almacén": "'" + text.replace("{url}", f"' || {url} || '").replace("{other}", "").replace("{error}", error) + "'"
    country = {c: next(x[1] for x in CITIES if c in (x[0], *x[3:])) for c in CARD_CITIES}
    tlds = [fixed.COUNTRY_OF_TLD.get(t.rpartition(".")[2], "") for t in TLDS]
    return f"""
WITH k AS (SELECT page_id AS k, page_id % 11 <> 0 AS home, page_id % 4 <> 0 AS card, 'https://s' || page_id || '.' || {_pick('page_id', TLDS)} AS base, {_pick('page_id', tlds)} AS tld,
                  {_pick('page_id', CARD_CITIES)} AS city, {_pick('page_id', [country[c] for c in CARD_CITIES])} AS cc, {_person('page_id')} AS who FROM pages)
SELECT base AS source_url, CASE WHEN home AND card THEN base || '/contacto' ELSE '' END AS contact_page_url, '' AS team_page_url, CASE WHEN home AND card THEN who ELSE '' END AS names,
       CASE WHEN home AND card THEN '+57 300 ' || lpad(CAST(k AS VARCHAR), 7, '0') ELSE '' END AS phones, CASE WHEN home AND card THEN 'lunes a viernes 8:00 a 17:00' ELSE '' END AS hours,
       CASE WHEN home AND card THEN city ELSE '' END AS city, CASE WHEN NOT home THEN '' WHEN card THEN cc ELSE tld END AS country, CASE WHEN home AND card THEN 'Calle 5, ' || city ELSE '' END AS address_raw,
       CASE WHEN NOT home THEN {said(fixed.W_HOME, 'base')} ELSE concat_ws(' | ',
         CASE WHEN NOT card THEN {said(fixed.W_PAGE, "base || '/contacto'")} END, CASE WHEN NOT card THEN {said(fixed.W_PAGE, "base || '/c' || k % 5")} END,
         {said(fixed.W_PAGE, "base || '/equipo-' || k % 3")}, CASE WHEN NOT card THEN '{fixed.W_NO_CONTACT}' END, '{fixed.W_NO_TEAM}',
         CASE WHEN NOT card THEN '{fixed.W_NO_PHONE} | {fixed.W_NO_HOURS} | {fixed.W_NO_NAMES} | {fixed.W_NO_CITY}' END) END AS warnings FROM k"""


def oracle_sql() -> dict[str, str]:
    from . import edge_queries

    good_role = "('Directora', 'Asesor comercial')"
    role = _pick("c_custkey // 3", ROLE)
    who = _person("c_custkey")
    return edge_queries.oracle_sql() | {
        "url_functions": """
WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS url FROM pages)
SELECT page_id, url AS url_normalized,
       CASE WHEN regexp_matches(url, '^[^/]*//www\\.') THEN regexp_replace(url, '^([^/]*//)www\\.', '\\1') ELSE regexp_replace(url, '^([^/]*//)', '\\1www.') END AS url_toggled,
       regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM u""",
        "country_of_url": f"SELECT page_id, nullif(({_list(('ES', 'MX', 'CO', '', '', 'PT', ''))})[page_id % {len(TLDS)} + 1], '') AS country FROM pages",
        "common_paths": f"SELECT origin, CAST(i - 1 AS INTEGER) AS pos, origin || ({_list(fixed.CONTACT_PATHS)})[i] AS url FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages), range(1, {len(fixed.CONTACT_PATHS) + 1}) AS r(i)",
        "link_ranking": f"""
WITH kw(w, n) AS (VALUES {_keyword_points()}),
     h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
            '<a href="/contacto">Contáctenos</a><a href="mailto:x@example.com">contacto</a><a href="/c' || (page_id % 5) || '">Contact us</a><a href="https://other.example/contacto">Contacto</a><a href="/contacto">otra</a><a href="/equipo-' || (page_id % 3) || '">Nuestro equipo médico</a>' || html AS html FROM pages),
     a AS (SELECT page_id, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS t,
                  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>[^<]*</a>', 1)))) AS pos FROM h),
     s AS (SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN origin || href ELSE href END AS link, origin,
                  (SELECT sum(CASE WHEN contains(lower(strip_accents(a.t)), w) THEN 3 ELSE 0 END + CASE WHEN contains(replace(replace(lower(strip_accents(a.href)), '-', ''), '_', ''), replace(w, ' ', '')) THEN 2 ELSE 0 END) FROM kw) AS score
           FROM a WHERE NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')),
     f AS (SELECT page_id, link, min(pos) AS pos, arg_min(score, pos) AS score FROM s WHERE score > 0 AND starts_with(link, origin || '/') GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM f)
SELECT page_id, link, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""",
        "compact_hours": """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'siempre' WHEN s_suppkey % 4 = 1 THEN 'Sábado: 0' || (s_suppkey % 9) || ':00–12:00'
       ELSE 'Lunes a Viernes: 0' || (s_suppkey % 9) || ':30–18:00' END AS hours FROM supplier""",
        "hours_spec": f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Lunes, ' || {_pick('s_suppkey', ('Martes', 'Viernes', 'Feriados'))} || ': 0' || (s_suppkey % 9) || ':00–18:00|' END || 'Sábado: 09:00–12:00' AS hours FROM supplier""",
        "names_in_text": f"""
SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN {who} || CASE WHEN {role} IN {good_role} THEN ' (' || {role} || ')' ELSE '' END
       WHEN {role} IN {good_role} THEN {who} || ' (' || {role} || ')' ELSE '' END AS people FROM customer""",
        "cleaned_names": f"SELECT c_custkey, CASE WHEN (c_custkey // 7) % 4 = 2 THEN NULL ELSE {who} END AS name FROM customer",
        "address_in_text": f"SELECT doc_id, 'Calle ' || doc_id || ', ' || {_pick('doc_id', CARD_CITIES)} AS address FROM documents",
        "word_ngrams": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[''.][A-Za-zÀ-ÖØ-öø-ÿ]+)*') AS ws FROM documents),
     g AS (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(size) WHERE len(ws) >= size)
SELECT doc_id, size, count(*) AS n_windows FROM g
WHERE len(list_filter(ws[i:i + size - 1], lambda x: regexp_matches(x, '^[A-ZÀ-ÖØ-Þ]'))) > 0 GROUP BY ALL""",
        "city_of_text": f"""
WITH gaz(key, name, cc, pop, ord) AS (VALUES {_cities()}),
     c AS (SELECT c_custkey, {_pick('c_custkey', CARD_CITIES)} AS one, {_pick('c_custkey // 6', CARD_CITIES)} AS two, CASE WHEN c_custkey % 5 = 0 THEN 'PE' END AS pref FROM customer),
     m AS (SELECT c_custkey, pref, one AS city, 2 AS pos, false AS addr FROM c UNION ALL SELECT c_custkey, pref, two, 5, false FROM c UNION ALL SELECT c_custkey, pref, two, 4, true FROM c WHERE c_custkey % 4 = 0),
     b AS (SELECT c_custkey, addr, pos, any_value(city) AS evidence, any_value(pref) AS pref, arg_max({{'n': name, 'cc': cc, 'p': pop}}, (coalesce(cc = pref, false), pop, -ord)) AS r FROM m JOIN gaz ON key = lower(strip_accents(city)) GROUP BY ALL),
     s AS (SELECT * FROM b WHERE addr OR coalesce(r.cc = pref, false) OR (r.p >= 200000 AND length(evidence) >= 5)),
     x AS (SELECT c_custkey, arg_max({{'r': r, 'e': evidence, 'a': addr}}, (addr, coalesce(r.cc = pref, false), -pos, r.p)) AS v FROM s GROUP BY ALL)
SELECT c_custkey, v.r.n AS city, v.r.cc AS countrycode, CAST(v.r.p AS BIGINT) AS population, v.e AS evidence, v.a AS from_address_line FROM x""",
        "jsonld_facts": f"""
WITH j AS (SELECT *, s_suppkey AS k, s_suppkey % 7 = 0 AS broken, s_suppkey % 5 = 0 AS thing FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, CASE WHEN broken THEN '' ELSE '+' || k END AS phones, CASE WHEN broken OR thing THEN '' ELSE {_person('k')} || ' (Jefe)' END AS people,
       CASE WHEN broken OR thing THEN NULL ELSE s_name END AS locality, CASE WHEN broken OR thing THEN NULL ELSE n_name END AS country,
       CASE WHEN broken OR thing THEN NULL ELSE 'Calle ' || k || ', ' || s_name || ', ' || n_name END AS address FROM j""",
        "gathered_tries": """
WITH t AS (SELECT o_custkey AS site_id, o_orderkey % 4 AS grp, o_orderkey AS i, o_orderstatus = 'F' AS ok FROM orders),
     d AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY site_id, grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM t),
     n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY grp, i) AS n FROM d WHERE NOT done)
SELECT site_id, grp, i, ok FROM n WHERE n <= 3""",
        "visible_text": r"""
WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '<x>', 'gs'), '<script[^>]*>.*?</script>', '<x>', 'gsi'), '<style[^>]*>.*?</style>', '<x>', 'gsi') AS html FROM pages),
     n AS (SELECT page_id, regexp_split_to_array(html, '<[^>]*>') AS a, regexp_split_to_array(regexp_replace(html, '<nav[^>]*>.*?</nav>', '<x>', 'gsi'), '<[^>]*>') AS b FROM h),
     c AS (SELECT page_id, list_transform(a, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS a, list_transform(b, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS b FROM n),
     j AS (SELECT page_id, array_to_string(list_filter(a, lambda x: x <> ''), chr(10)) AS a, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS b FROM c)
SELECT page_id, replace(replace(replace(replace(a, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text,
       replace(replace(replace(replace(b, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text_no_nav FROM j""",
        "hours_in_text": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g') || chr(10) || 'Abrimos de lunes a viernes de ' || (doc_id % 4 + 7) || ':30 a ' || (doc_id % 5 + 16) || ':00; sábado 10h - 13h',
                  '(?i)((?:{fixed.DAY_WORDS})(?:\s*(?:,|y|{fixed.UNTIL})\s*(?:{fixed.DAY_WORDS}))*[^.;\n]{{0,25}}?{_CLOCK}\s*{fixed.UNTIL}\s*{_CLOCK})') AS hs FROM documents)
SELECT doc_id, array_to_string(hs[1:5], '|') AS hours, hs[1] AS best FROM d""",
        "facts_of_cards": _facts_of_cards(),
        "facts_json_of_cards": f"""
WITH f AS ({_facts_of_cards()})
SELECT CAST(to_json({{'source_url': source_url, 'contact_page_url': nullif(contact_page_url, ''), 'team_page_url': nullif(team_page_url, ''),
         'names': CASE WHEN names = '' THEN [] ELSE [{{'name': names, 'role': CAST(NULL AS VARCHAR)}}] END, 'phones': CASE WHEN phones = '' THEN [] ELSE [phones] END,
         'hours': nullif(hours, ''), 'hours_raw': CASE WHEN hours = '' THEN [] ELSE [hours] END, 'city': nullif(city, ''), 'country': nullif(country, ''),
         'address_raw': nullif(address_raw, ''), 'warnings': CASE WHEN warnings = '' THEN [] ELSE string_split(warnings, ' | ') END}}) AS VARCHAR) AS json FROM f""",
        "people_merge": f"""
WITH m AS (SELECT conv_id, CASE WHEN turn < 2 THEN 0 ELSE 1 END AS src, turn // 3 AS page, turn AS o, {_pick('turn * 7 + conv_id', FIRST)} AS name,
                  CASE WHEN (conv_id + turn) % 3 = 0 THEN {_pick('conv_id + turn', ('Jefe', 'Ventas'))} END AS role FROM conversations),
     f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, src, page, name ORDER BY o, role) AS n FROM m) WHERE n = 1),
     e AS (SELECT conv_id, name, min((src, page, o)) AS place, arg_min(role, (src, page, o)) FILTER (WHERE role IS NOT NULL) AS role FROM f GROUP BY ALL)
SELECT conv_id, string_agg(CASE WHEN role IS NULL THEN name ELSE name || ' (' || role || ')' END, '; ' ORDER BY place) AS people FROM e GROUP BY conv_id""",
        "ordered_dedup": """
WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations WHERE role <> '' GROUP BY ALL)
SELECT conv_id, string_agg(role, '|' ORDER BY t, role) AS roles FROM f GROUP BY conv_id""",
        "phone_canonical": """
WITH d AS (SELECT c_custkey, c_custkey % 4 AS m, lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS d FROM customer)
SELECT c_custkey, CASE m WHEN 0 THEN '+57 300 ' || d WHEN 1 THEN '+57 601 ' || d WHEN 2 THEN '+34 69' || d[1:1] || ' ' || d[2:3] || ' ' || d[4:5] || ' ' || d[6:7] END AS phone,
       CASE m WHEN 0 THEN 'CO' WHEN 1 THEN 'CO' WHEN 2 THEN 'ES' END AS region FROM d""",
    }
