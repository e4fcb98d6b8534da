"""The same results as SQL over the given tables, where SQL can express them.

Of the operators here only the URL lists can be: the others rest on a fitted model, a hash that
SQL engines don't share, a graph's components or a search in vectors, or would compare all pairs. Those are tested
against brute force in tests/llm.
"""

_ENTRIES = r"""
    SELECT regexp_replace(host, '^[^.]*[.]', '') AS rule, DATE '2024-01-01' + CAST(m * 13 % 300 AS INT) AS since,
        CASE WHEN m % 2 = 0 THEN 'block' ELSE 'allow' END AS action FROM firsts
    UNION ALL SELECT host, DATE '2024-01-01' + CAST(m * 31 % 300 AS INT), 'block' FROM firsts WHERE m % 3 = 0
    UNION ALL SELECT host, DATE '2024-01-01' + CAST(m * 31 % 300 AS INT) + 45, 'allow' FROM firsts WHERE m % 3 = 0
    UNION ALL SELECT host || '/en', DATE '2024-01-01' + CAST(m * 7 % 300 AS INT), 'block' FROM firsts WHERE m % 2 = 1"""

URL_LISTS = rf"""
WITH captures AS (
    SELECT page_id, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT) AS fetched,
        lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
        regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path
    FROM pages
), firsts AS (
    SELECT min(page_id) AS m, host FROM captures WHERE host <> '' GROUP BY host
), entries AS ({_ENTRIES}
), dated AS (
    SELECT rule, since, max(action) AS action FROM entries GROUP BY rule, since
), active AS (
    SELECT rule, action, since, lead(since) OVER (PARTITION BY rule ORDER BY since) AS until FROM dated
), met AS (
    SELECT page_id, rule, since, action,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS place
    FROM captures JOIN active ON since <= fetched AND (until IS NULL OR fetched < until) AND (
        host = rule OR ends_with(host, '.' || rule) OR starts_with(host || path || '/', rule || '/'))
)
SELECT captures.page_id, fetched, rule, since, action, coalesce(action = 'block', false) AS blocked
FROM captures LEFT JOIN met ON captures.page_id = met.page_id AND place = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op8_url_lists": URL_LISTS}
