"""DuckDB SQL for the queries that SQL can express; plain definitions, not the operators' method."""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
     keyed AS (SELECT *, {_FOLD.format(f'trim(line, {_BLANKS})')} AS k FROM lines),
     hot AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
     marked AS (SELECT l.doc_id, l.line, l.pos, hot.k IS NOT NULL AND l.doc_id <> hot.keep AS gone FROM keyed l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP10 = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     grams AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
     again AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) >= 2),
     cover AS (SELECT DISTINCT grams.doc_id, grams.i + o AS p FROM grams JOIN again USING (doc_id, g), range(5) AS r(o)),
     rep AS (SELECT doc_id, count(*) AS n FROM cover GROUP BY doc_id),
     worded AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
     m AS (SELECT words.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                  length(regexp_replace(text, '[^\n]', '', 'g')) + 1 AS n_lines,
                  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
           FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
     judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines OR word_chars > 30 * n_words) AS kept
FROM judged
"""
