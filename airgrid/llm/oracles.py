"""SQL for the queries that SQL can express, by the contracts' definitions and brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every pair of documents with a common shingle is counted; links are followed from every set.
VERTICAL_JOIN = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM words
), nodes AS (
    SELECT row_number() OVER () AS id, s, len(s) AS n FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)
), grams AS (
    SELECT id, n, unnest(s) AS g FROM nodes
), links AS (
    SELECT a.id AS x, b.id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), hops AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT id AS x, id AS y FROM nodes UNION SELECT r.x, l.y FROM reach r JOIN hops l ON r.y = l.x
), named AS (
    SELECT d.doc_id, n.id, n.n FROM sets d JOIN nodes n ON d.s = n.s
), least AS (
    SELECT r.x AS id, min(d.doc_id) AS component_id FROM reach r JOIN named d ON d.id = r.y GROUP BY 1
)
SELECT d.doc_id, d.n AS n_shingles, l.component_id FROM named d JOIN least l USING (id)
UNION ALL SELECT doc_id, 0::BIGINT, doc_id FROM sets WHERE s IS NULL OR len(s) = 0
"""

#: Every window of every item against every run of as many words.
SUFFIX_ARRAYS = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[u.i:u.i + least(13, len(w)) - 1], ' ') AS g
    FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i) u WHERE len(w) > 0
), runs AS (
    SELECT r, u.i AS p, l.n, array_to_string(w[u.i:u.i + l.n - 1], ' ') AS g
    FROM texts, (SELECT DISTINCT n FROM windows) l, LATERAL (SELECT unnest(range(1, len(w) - l.n + 2)) AS i) u
), met AS (
    SELECT r, p, n, item_id FROM runs JOIN windows USING (n, g)
), hit AS (
    SELECT r, count(DISTINCT p + u.k) AS n_hit FROM met, LATERAL (SELECT unnest(range(0, n)) AS k) u GROUP BY 1
), found AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM texts LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

#: A base-32 digit is five bits; five hexadecimal digits are four of them.
WARC = """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), first AS (
    SELECT h, n, min(page_id) AS f FROM payloads GROUP BY 1, 2
)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM payloads JOIN first USING (h, n)
"""

_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT)"""

#: Whole profiles: right as long as no language has more labelled texts than the sample of the fit holds.
RANK_ORDER = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce({_CRC32} % 3 = 1, false) AS held_out, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents
), words AS (
    SELECT r, ' ' || x || ' ' AS x, n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM docs) GROUP BY 1, 2)
), cut AS (
    SELECT r, x[i:i + k - 1] AS g, n FROM words, (VALUES (1), (2), (3)) v(k), LATERAL (SELECT unnest(range(1, length(x) - k + 2)) AS i) u
), grams AS (
    SELECT r, g, sum(n) AS n FROM cut WHERE g <> ' ' GROUP BY 1, 2
), mine AS (
    SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(g), replace(g, ' ', chr(1))) - 1 AS p FROM grams QUALIFY p < 300
), learned AS (
    SELECT lang, g, sum(n) AS n FROM grams JOIN docs USING (r) WHERE lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held_out GROUP BY 1, 2
), profiles AS (
    SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), replace(g, ' ', chr(1))) - 1 AS q FROM learned QUALIFY q < 300
), far AS (
    SELECT m.r, l.lang, sum(least(300, coalesce(abs(p - q), 300))) AS d FROM mine m CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles f ON f.lang = l.lang AND f.g = m.g GROUP BY 1, 2
), placed AS (
    SELECT r, lang, d, row_number() OVER (PARTITION BY r ORDER BY d, lang) AS place FROM far
), nearest AS (
    SELECT r, max(lang) FILTER (WHERE place = 1) AS lang, max(d) FILTER (WHERE place = 1) AS a, max(d) FILTER (WHERE place = 2) AS b FROM placed GROUP BY 1
)
SELECT doc_id, held_out, coalesce(n.lang, 'und') AS lang_pred, CASE WHEN b > 0 THEN (b - a)::DOUBLE / b::DOUBLE ELSE 0 END AS score FROM docs LEFT JOIN nearest n USING (r)
"""
