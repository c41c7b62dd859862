"""Checking SQL (DuckDB) of the operators that SQL can express, written apart from them."""

import string

LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

DECONTAMINATION = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id,
        regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL
), piece AS (
    SELECT DISTINCT item_id, array_to_string(list_slice(w, pos, pos + 9), ' ') AS said, least(len(w), 10) AS size
    FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS pos FROM item WHERE len(w) > 0)
), place AS (
    SELECT r, w, unnest(generate_series(1, len(w))) AS pos FROM doc
), hit AS (
    SELECT DISTINCT r, pos, s.size, p.item_id
    FROM (SELECT DISTINCT size FROM piece) s
    JOIN place ON pos + s.size - 1 <= len(w)
    JOIN piece p ON p.size = s.size AND p.said = array_to_string(list_slice(w, pos, pos + s.size - 1), ' ')
), word AS (
    SELECT r, count(DISTINCT k) AS n_hit
    FROM (SELECT r, unnest(generate_series(pos, pos + size - 1)) AS k FROM hit) GROUP BY r
), held AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN held USING (r)
"""

DIVERGENCE = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(text, '') AS text
    FROM documents
), term AS (
    SELECT r, lang, source,
        unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x60\x7B-\x7F]+')) AS term
    FROM doc
), kept AS (
    SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM term
    GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), lang_size AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), grp AS (
    SELECT DISTINCT lang, source FROM doc
), cell AS (
    SELECT grp.lang, grp.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n
    FROM grp JOIN kept ON grp.lang = kept.lang
    LEFT JOIN (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM term GROUP BY ALL) c
        ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term
), grp_size AS (
    SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL
), prob AS (
    SELECT cell.*, 1 + (1000000000 * (n + 1)) // CAST(g.total + l.v AS HUGEINT) AS p,
        1 + (1000000000 * (lang_n + 1)) // CAST(l.total + l.v AS HUGEINT) AS q
    FROM cell JOIN grp_size g USING (lang, source) JOIN lang_size l ON l.lang = cell.lang
), pair AS (
    SELECT a.lang, a.source, b.source AS item,
        sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM prob a JOIN prob b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM prob WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM every
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

FILTER_AUDIT = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text
    FROM documents
), counted AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
        min(doc_id) OVER (PARTITION BY text) AS first
    FROM doc
), label AS (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT r, part,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * capitals > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN coalesce(counted.doc_id > first, false) THEN 16 ELSE 0 END AS mask,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM counted LEFT JOIN label ON label.doc_id = counted.doc_id
), letter AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(f, bit)
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(list_slice(bits, 1, step - 1)), 0) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), masks AS (
    SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
    FROM judged GROUP BY ALL
), counts AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
    CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_prefix_set_join": DECONTAMINATION,
        "op12_chunk_factorization": DIVERGENCE,
        "op13_posting_lists": FILTER_AUDIT,
    }
