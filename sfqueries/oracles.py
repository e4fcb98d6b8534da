"""The catalog's results as DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from . import fixtures as fx

_FLAGS = "citizenship_required, security_clearance_required, visa_sponsorship"
_V2 = f'title, company, min_exp, max_exp, overall, "primary", secondary, {_FLAGS}, match_score, link'
_V1 = f'title, company, min_exp, max_exp, age_match, overall, "primary", secondary, {_FLAGS}, link'

_KEYS = (
    "company", "min_exp", "max_exp", "overall", "primary", "secondary",
    "citizenship_required", "security_clearance_required", "visa_sponsorship",
)
# fixed values, written out so that an error in the library's tables shows: categories with their
# keywords, places with their ids
_CATEGORIES = (
    ("Java", "java"), ("Java", "spring"), ("Java", "j2ee"),
    ("Python", "python"), ("Python", "django"), ("Python", "flask"),
    ("Web Development", "html"), ("Web Development", "css"), ("Web Development", "javascript"),
    ("API Development", "rest"), ("API Development", "soap"),
    ("Rust", "rust"),
    ("Full Stack", "full stack"),
    ("Mobile Development", "android"), ("Mobile Development", "ios"),
    ("Microservices", "kubernetes"), ("Microservices", "docker"),
    ("Healthcare", "hl7"), ("Healthcare", "fhir"),
    ("Generative AI", "gans"), ("Generative AI", "transformers"),
    ("Databases", "sql"), ("Databases", "nosql"),
    ("Data Engineering", "etl"), ("Data Engineering", "data pipelines"),
    ("DevOps", "kubernetes"), ("DevOps", "docker"),
    ("Finance", "trading"), ("Finance", "risk management"),
    ("Cloud Development", "aws"), ("Cloud Development", "azure"),
    ("SDE", "software development"),
    ("Big Data", "hadoop"), ("Big Data", "spark"),
    ("Machine Learning", "ml"), ("Machine Learning", "dl"),
)
_PLACES = (
    ("usa", "103644278"), ("united states", "103644278"), ("america", "103644278"), ("us", "103644278"), ("united states of america", "103644278"),
    ("india", "102713980"), ("in", "102713980"), ("ind", "102713980"),
    ("germany", "101282230"), ("de", "101282230"), ("ger", "101282230"), ("deutschland", "101282230"), ("deu", "101282230"),
    ("singapore", "102454443"), ("sg", "102454443"), ("sing", "102454443"), ("sin", "102454443"),
    ("uae", "106204383"), ("united arab emirates", "106204383"), ("dubai", "106204383"),
)
_ENTITIES = (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("copy", "©"), ("reg", "®"),
    ("trade", "™"), ("middot", "·"), ("bull", "•"), ("hellip", "…"), ("ndash", "–"), ("mdash", "—"),
    ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("euro", "€"), ("amp", "&"),
)


def _text(html: str) -> str:
    blocks = "p|div|ul|ol|li|h[1-6]|br|hr|tr|table|section|article|header|footer|blockquote|pre"
    sql = f"regexp_replace({html}, '(?is)<!--.*?(?:-->|\\z)|<(?:script|style)\\b[^>]*>.*?(?:</(?:script|style)\\s*>|\\z)', '', 'g')"
    sql = f"regexp_replace({sql}, '[ \\t\\r\\n\\f]+', ' ', 'g')"
    sql = f"regexp_replace({sql}, '(?i)</?(?:{blocks})\\b[^>]*>', chr(10), 'g')"
    sql = f"regexp_replace({sql}, '</?[a-zA-Z][^>]*>|<[!?][^>]*>', '', 'g')"
    for name, char in _ENTITIES:
        sql = f"replace({sql}, '&{name};', '{char}')"
    sql = f"regexp_replace({sql}, ' *\\n[ \\n]*', chr(10), 'g')"
    sql = f"regexp_replace({sql}, ' {{2,}}', ' ', 'g')"
    return f"trim({sql}, ' ' || chr(10))"


_ARTICLE = "regexp_extract(html, '(?is)<article\\b[^>]*>(.*)</article>', 1)"
_HEADING = "regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"
_LINK = "split_part(url, '?', 1)"

_SIGHTINGS = f"""
sightings AS (
  SELECT event_id, ts, event_id % (SELECT count(*) FROM pages) AS page_id,
         {fx.LOCATION_SQL} AS location, {fx.EASY_APPLY_SQL} AS easy_apply
  FROM events),
today AS (SELECT max(ts) AS t FROM events)"""

_PARSED = f"""{_SIGHTINGS},
answers AS (SELECT *, {fx.RESPONSE_SQL} AS response FROM sightings),
bodies AS (SELECT *, regexp_extract(response, '(?s)\\{{.*\\}}') AS body FROM answers),
parsed AS (
  SELECT * EXCLUDE (obj), {', '.join(f"json_extract_string(obj, '$.{key}') AS {key}" for key in _KEYS).replace(' primary', ' "primary"')},
    CASE WHEN obj IS NULL THEN 'bad_json'
         WHEN NOT list_has_all(json_keys(obj), [{', '.join(f"'{key}'" for key in _KEYS)}]) THEN 'missing_key'
         WHEN json_extract_string(obj, '$.company') IS NULL THEN 'null_company' END AS parse_reason
  FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS obj FROM bodies)),
typed AS (
  SELECT * EXCLUDE ({_FLAGS}),
    CAST(trunc(TRY_CAST(trim(min_exp) AS DOUBLE)) AS INTEGER) AS min_exp_years,
    CAST(trunc(TRY_CAST(trim(max_exp) AS DOUBLE)) AS INTEGER) AS max_exp_years,
    {', '.join(f"CASE lower({flag}) WHEN 'true' THEN true WHEN 'false' THEN false END AS {flag}" for flag in _FLAGS.split(', '))}
  FROM parsed),
checked AS (
  SELECT *, coalesce(parse_reason, CASE WHEN min_exp NOT IN ('N/A', '') AND min_exp_years IS NULL
                                        THEN 'bad_min_exp' END) AS reason
  FROM typed),
usable AS (SELECT * FROM checked WHERE reason IS NULL),
suitable AS (
  SELECT * FROM usable
  WHERE (min_exp IS NULL OR min_exp IN ('N/A', '') OR min_exp_years <= 2)
    AND NOT citizenship_required AND NOT security_clearance_required AND visa_sponsorship)"""

_HEADINGS = f"headings AS (SELECT page_id, url, {_LINK} AS link, {_text(_HEADING)} AS heading FROM pages)"

_SCORES = """
scores AS (
  SELECT p.page_id, round(100 * list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4)
         AS match_score
  FROM pages p JOIN embeddings e ON e.vec_id = p.page_id % (SELECT count(*) FROM embeddings),
       (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""

_POSTINGS = f"""
htmls AS (SELECT page_id, url, replace(html, '</article>', ' ' || {fx.SENTENCE_SQL} || '</article>') AS html FROM pages),
postings AS (
  SELECT page_id, {_LINK} AS link, replace({_text(_HEADING)}, ',', '') AS title, {_text(_ARTICLE)} AS jd FROM htmls)"""

_WORDS = """
words AS (
  SELECT page_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place
  FROM (SELECT page_id, regexp_extract_all(lower(jd), '[a-z0-9+#]+') AS w FROM postings))"""

_RULES = f"""{_WORDS},
category_keyword(category, keyword) AS (VALUES
  {', '.join(f"('{c}', '{k}')" for c, k in _CATEGORIES)}),
grams AS (
  SELECT page_id, word AS gram FROM words
  UNION ALL
  SELECT a.page_id, a.word || ' ' || b.word FROM words a JOIN words b ON a.page_id = b.page_id AND b.place = a.place + 1),
counted AS (
  SELECT page_id, category, count(*) AS n FROM grams JOIN category_keyword ON gram = keyword GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, category) AS place FROM counted),
ruled AS (
  SELECT p.*,
    replace(regexp_extract(link, '^[a-z]+://([^/?#]+)', 1), ',', '') AS company,
    coalesce(nullif(regexp_extract(jd, '(?i)([0-9]+)\\s*(\\+|-|to)?\\s*([0-9]*)\\+?\\s*years', 1), ''), 'N/A') AS min_exp,
    coalesce(nullif(regexp_extract(jd, '(?i)([0-9]+)\\s*(\\+|-|to)?\\s*([0-9]*)\\+?\\s*years', 3), ''), 'N/A') AS max_exp,
    coalesce(a.category, 'SDE') AS overall, coalesce(a.category, 'SDE') AS "primary",
    coalesce(b.category, 'SDE') AS secondary,
    regexp_matches(jd, '(?i)(us citizenship required|must be a us citizen)') AS citizenship_required,
    regexp_matches(jd, '(?i)security clearance required') AS security_clearance_required,
    NOT regexp_matches(jd, '(?i)(no visa sponsorship|unable to sponsor)') AS visa_sponsorship
  FROM postings p LEFT JOIN placed a ON a.page_id = p.page_id AND a.place = 1
                  LEFT JOIN placed b ON b.page_id = p.page_id AND b.place = 2)"""

_TEXT_SCORES = f"""
profile AS (
  SELECT word, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all('{fx.PROFILE_TEXT}', '[a-z0-9+#]+')) AS word) GROUP BY word),
freq AS (SELECT page_id, word, count(*) AS n FROM words GROUP BY page_id, word),
text_scores AS (
  SELECT p.page_id, round(coalesce(s.match_score, 0), 4) AS match_score
  FROM postings p LEFT JOIN (
    SELECT f.page_id, 100.0 * sum(f.n * coalesce(q.n, 0))
           / (sqrt(sum(f.n * f.n)) * (SELECT sqrt(sum(n * n)) FROM profile)) AS match_score
    FROM freq f LEFT JOIN profile q ON q.word = f.word GROUP BY f.page_id) s ON s.page_id = p.page_id)"""

_LETTERS = """[CAST(length({text}) AS DOUBLE), length({text}) - length(replace({text}, 'a', '')),
  length({text}) - length(replace({text}, 'e', ''))]"""

_ENCODED_SCORES = f"""
encoded_scores AS (
  SELECT page_id, round(100 * list_cosine_similarity({_LETTERS.format(text='jd')}, p.vector), 4) AS match_score
  FROM postings, (SELECT {_LETTERS.format(text="'" + fx.PROFILE_TEXT + "'")} AS vector) p)"""

_GEO = f"""
geo_alias(alias, geo_id) AS (VALUES {', '.join(f"('{a}', '{g}')" for a, g in _PLACES)}),
located AS (
  SELECT s.event_id, s.location, coalesce(g.geo_id, '103644278') AS geo_id
  FROM sightings s LEFT JOIN geo_alias g ON lower(s.location) = g.alias)"""

_SCANS = """
listed AS (
  SELECT s.*, 0 AS scan_rank, '24H' AS scan FROM {source} s, today WHERE ts >= t - INTERVAL 1 DAY
  UNION ALL SELECT s.*, 1, '7D' FROM {source} s, today WHERE ts >= t - INTERVAL 7 DAY
  UNION ALL SELECT s.*, 2, '1M' FROM {source} s, today WHERE ts >= t - INTERVAL 30 DAY)"""


def _first(source: str, partition: str, order: str) -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {partition} ORDER BY {order}) = 1"


def _daily(source: str, found: str, best: str) -> str:
    """Best matches and three searches over `source`; `found` and `best` are page tables."""
    legs = [
        f"SELECT page_id, event_id, 0 AS scan_rank, place FROM {best}",
    ]
    for rank, (days, rows) in enumerate(((1, 50), (7, 25), (30, 25)), start=1):
        legs.append(
            f"""SELECT page_id, event_id, {rank}, row_number() OVER (ORDER BY ts DESC, event_id) AS place
            FROM {source} s JOIN located l USING (event_id) JOIN {found} f USING (page_id), today
            WHERE l.geo_id = '103644278' AND ts >= t - INTERVAL {days} DAY
            QUALIFY place <= {rows}"""
        )
    return " UNION ALL ".join(legs)


_RAW_ROWS = f"""
SELECT replace(heading, ',', '') AS title, replace(company, ',', '') AS company, min_exp, max_exp, overall, "primary",
       secondary, {_FLAGS}, match_score, link
FROM usable JOIN headings USING (page_id) JOIN scores USING (page_id)"""

# an empty value and none are the same in a CSV file
_RAW_ROWS_READ = _RAW_ROWS.replace("min_exp, max_exp", "nullif(min_exp, '') AS min_exp, max_exp")

_V1_ROWS = f"""
SELECT replace(heading, ',', '') AS title, replace(company, ',', '') AS company, min_exp, max_exp,
       min_exp_years IS NULL OR (min_exp_years <= 2 AND coalesce(max_exp_years, 1e9) >= 1.5) AS age_match,
       overall, "primary", secondary, {_FLAGS}, url AS link
FROM usable JOIN headings USING (page_id)"""

_DIGEST_ROWS = f"""
SELECT heading AS title, company, {{min_exp}}, max_exp, CAST(NULL AS BOOLEAN) AS age_match, overall, "primary", secondary,
       {_FLAGS}, url AS link
FROM suitable JOIN headings USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "scan_postings": f"SELECT page_id, url AS link, {_text(_HEADING)} AS title, {_ARTICLE} AS article FROM pages",
        "normalize_link": f"SELECT page_id, {_LINK} AS link FROM pages",
        "strip_commas": f"SELECT page_id, replace({_text(_HEADING)}, ',', '') AS title FROM pages",
        "html_to_text": f"SELECT page_id, {_text(_ARTICLE)} AS jd FROM pages",
        "date_stamp": "SELECT event_id, strftime(ts, '%d-%m-%Y') AS stamp FROM events",
        "strip_fence": f"WITH {_PARSED} SELECT event_id, body FROM bodies",
        "parse_response": f"""WITH {_PARSED} SELECT event_id, {', '.join(_KEYS).replace('primary', '"primary"')},
            CASE WHEN parse_reason IS NOT NULL THEN 'parse' END AS stage, parse_reason AS reason FROM parsed""",
        "typed_fields": f"WITH {_PARSED} SELECT event_id, min_exp_years, max_exp_years, {_FLAGS} FROM usable",
        "raw_record": f"WITH {_PARSED}, {_HEADINGS}, {_SCORES} {_RAW_ROWS}",
        "raw_record_v1": f"WITH {_PARSED}, {_HEADINGS} {_V1_ROWS}",
        "quarantine": f"""WITH {_PARSED} SELECT url AS link,
            CASE WHEN parse_reason IS NULL THEN 'suitability' ELSE 'parse' END AS stage, reason, response AS raw
            FROM checked JOIN pages USING (page_id) WHERE reason IS NOT NULL""",
        "digest_projection": f"WITH {_PARSED}, {_HEADINGS} {_DIGEST_ROWS.format(min_exp='min_exp')}",
        "time_window": "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
        "time_window_past": """SELECT event_id, ts FROM events
            WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-15 12:00:00'""",
        "geo_filter": f"WITH {_SIGHTINGS}, {_GEO} SELECT * FROM located WHERE geo_id = '102713980'",
        "keyword_filter": f"""WITH {_POSTINGS} SELECT page_id, title FROM postings
            WHERE contains(lower(title || ' ' || jd), 'python') AND contains(lower(title || ' ' || jd), 'django')""",
        "keyword_filter_indexed": f"""WITH {_POSTINGS} SELECT page_id, title FROM postings
            WHERE contains(lower(title || ' ' || jd), 'python') AND contains(lower(title || ' ' || jd), 'django')""",
        "easy_apply_filter": f"WITH {_SIGHTINGS} SELECT event_id FROM sightings WHERE easy_apply",
        "suitability": f"WITH {_PARSED} SELECT event_id, min_exp FROM suitable",
        "experience_bound": f"""WITH {_PARSED} SELECT event_id,
            min_exp IS NULL OR min_exp IN ('N/A', '') OR min_exp_years <= 2 AS within_bound FROM usable""",
        "age_match": f"""WITH {_POSTINGS}, {_RULES} SELECT page_id,
            CASE WHEN min_exp = 'N/A' THEN true
                 WHEN CAST(min_exp AS INTEGER) > 2 THEN false
                 WHEN max_exp = 'N/A' THEN true
                 ELSE CAST(max_exp AS INTEGER) >= 1.5 END AS age_match FROM ruled""",
        "geo_lookup": f"WITH {_SIGHTINGS}, {_GEO} SELECT * FROM located",
        "timeline_lookup": f"""SELECT event_id, code, CASE code WHEN '24H' THEN 86400 WHEN '7D' THEN 604800
            WHEN '1W' THEN 604800 WHEN '1M' THEN 2592000 END AS seconds
            FROM (SELECT event_id, {fx.TIMELINE_SQL} AS code FROM events)""",
        "new_since_last": f"""WITH {_PARSED},
            linked AS (SELECT event_id, ts, {_LINK} AS link FROM suitable JOIN pages USING (page_id)),
            before AS (SELECT link FROM linked WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 1 DAY),
            fresh AS (SELECT * FROM linked WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
            SELECT link, event_id FROM ({_first('fresh', 'link', 'ts DESC, event_id')})
            WHERE link NOT IN (SELECT link FROM before)""",
        "union_scans": f"""WITH {_SIGHTINGS}, {_SCANS.format(source='sightings')}
            SELECT event_id, ts, page_id, scan_rank, scan FROM listed""",
        "top_scans": f"""WITH {_SIGHTINGS}, {_SCANS.format(source='sightings')},
            numbered AS (SELECT *, row_number() OVER (PARTITION BY scan_rank ORDER BY ts DESC, event_id) - 1 AS seq FROM listed)
            SELECT event_id, ts, page_id, seq // 25 AS page, seq % 25 AS position, scan_rank, scan FROM numbered
            WHERE seq < CASE scan WHEN '24H' THEN 50 ELSE 25 END""",
        "first_seen_dedupe": f"""WITH {_PARSED}, {_SCANS.format(source='suitable')},
            linked AS (SELECT listed.*, {_LINK} AS link FROM listed JOIN pages USING (page_id))
            SELECT link, event_id, ts, scan_rank, min_exp
            FROM ({_first('linked', 'link', 'scan_rank, ts DESC, event_id')})""",
        "page_position": """SELECT event_id, ts, seq // 25 AS page, seq % 25 AS position
            FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS seq FROM events)""",
        "scan_position": f"""WITH {_SIGHTINGS}, {_SCANS.format(source='sightings')}
            SELECT event_id, ts, scan_rank, seq // 25 AS page, seq % 25 AS position FROM (
            SELECT *, row_number() OVER (PARTITION BY scan_rank ORDER BY ts DESC, event_id) - 1 AS seq FROM listed)""",
        "page_limit": f"WITH {_SIGHTINGS} SELECT event_id, ts, page_id FROM sightings ORDER BY ts DESC, event_id LIMIT 50",
        "long_list": f"""WITH {_SIGHTINGS}, numbered AS (
              SELECT event_id, ts, page_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS seq FROM sightings)
            SELECT event_id, ts, page_id, seq // 25 AS page, seq % 25 AS position FROM numbered WHERE seq < 1250""",
        "single_page": f"""WITH {_SIGHTINGS} SELECT event_id, ts, page_id FROM sightings
            ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25""",
        "extract_company": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS company FROM pages",
        "extract_experience": f"WITH {_POSTINGS}, {_RULES} SELECT page_id, min_exp, max_exp FROM ruled",
        "extract_flags": f"WITH {_POSTINGS}, {_RULES} SELECT page_id, {_FLAGS} FROM ruled",
        "classify": f'WITH {_POSTINGS}, {_RULES} SELECT page_id, overall, "primary", secondary FROM ruled',
        "match_score_vector": """SELECT e.vec_id, round(100 * list_cosine_similarity(CAST(e.embedding AS DOUBLE[]),
            CAST(q.embedding AS DOUBLE[])), 4) AS match_score
            FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""",
        "match_score_text": f"WITH {_POSTINGS}, {_WORDS}, {_TEXT_SCORES} SELECT page_id, match_score FROM text_scores",
        "read_raw_postings": f"""WITH {_PARSED}, {_HEADINGS}, {_SCORES}
            SELECT *, CAST(NULL AS VARCHAR) AS _corrupt_record FROM ({_RAW_ROWS_READ})""",
        "append_roundtrip": f"WITH {_PARSED}, {_HEADINGS}, {_SCORES} {_RAW_ROWS_READ} UNION ALL {_RAW_ROWS_READ}",
        "digest_roundtrip": f"""WITH {_PARSED}, {_HEADINGS}
            {_DIGEST_ROWS.format(min_exp="nullif(min_exp, '') AS min_exp")}""",
        "merge_raw": f"WITH {_PARSED}, {_HEADINGS}, {_SCANS.format(source='usable')} "
        + _V1_ROWS.replace("min_exp, max_exp,", "nullif(min_exp, '') AS min_exp, max_exp,", 1).replace(
            "FROM usable", "FROM listed"),
        "search": f"""WITH {_SIGHTINGS}, {_GEO}, {_POSTINGS}, {_RULES}, {_TEXT_SCORES},
            top AS (
              SELECT event_id, page_id FROM sightings JOIN located USING (event_id) JOIN postings USING (page_id), today
              WHERE geo_id = '103644278' AND easy_apply AND ts >= t - INTERVAL 30 DAY
                AND contains(lower(title || ' ' || jd), 'experience')
              ORDER BY ts DESC, event_id LIMIT 50)
            SELECT {_V2} FROM top JOIN ruled USING (page_id) JOIN text_scores USING (page_id)""",
        "search_written": f"""WITH {_SIGHTINGS}, {_GEO}, {_POSTINGS}, {_RULES}, {_TEXT_SCORES},
            top AS (
              SELECT event_id, page_id FROM sightings JOIN located USING (event_id) JOIN postings USING (page_id), today
              WHERE geo_id = '103644278' AND easy_apply AND ts >= t - INTERVAL 30 DAY
                AND contains(lower(title || ' ' || jd), 'experience')
              ORDER BY ts DESC, event_id LIMIT 50)
            SELECT {_V2} FROM top JOIN ruled USING (page_id) JOIN text_scores USING (page_id)""",
        "run_envelope": f"""WITH {_SIGHTINGS}, {_POSTINGS}, {_RULES}, {_TEXT_SCORES}, {_GEO},
            best AS (
              SELECT page_id, CAST(NULL AS BIGINT) AS event_id,
                row_number() OVER (ORDER BY match_score DESC, link, page_id) AS place
              FROM postings JOIN text_scores USING (page_id) QUALIFY place <= 25),
            found AS (SELECT page_id FROM postings WHERE contains(lower(title || ' ' || jd), 'spark')),
            picked AS ({_daily('sightings', 'found', 'best')})
            SELECT DISTINCT link, 'out/jobs_DAILY_' || strftime(t, '%d-%m-%Y') || '_103644278_False_spark.csv' AS path,
              36 AS id_length
            FROM picked JOIN ruled USING (page_id), today
            WHERE (min_exp = 'N/A' OR CAST(min_exp AS INTEGER) <= 2)
              AND NOT citizenship_required AND NOT security_clearance_required AND visa_sponsorship""",
        "read_profile": f"WITH {_POSTINGS}, {_WORDS}, {_TEXT_SCORES} SELECT page_id, match_score FROM text_scores",
        "search_answers": f"""WITH {_PARSED}, {_HEADINGS}, {_SCORES}, {_GEO},
            top AS (
              SELECT c.* FROM checked c JOIN located USING (event_id), today
              WHERE geo_id = '101282230' AND ts >= t - INTERVAL 7 DAY ORDER BY ts DESC, event_id LIMIT 75)
            SELECT replace(heading, ',', '') AS title, replace(company, ',', '') AS company, min_exp, max_exp, overall,
              "primary", secondary, {_FLAGS}, match_score, link
            FROM top JOIN headings USING (page_id) JOIN scores USING (page_id) WHERE parse_reason IS NULL""",
        "recommended": f"""WITH {_POSTINGS}, {_RULES}, {_SCORES}
            SELECT {_V2} FROM ruled JOIN scores USING (page_id) ORDER BY match_score DESC, link, page_id LIMIT 25""",
        "recommended_text": f"""WITH {_POSTINGS}, {_RULES}, {_TEXT_SCORES}
            SELECT {_V2} FROM ruled JOIN text_scores USING (page_id) ORDER BY match_score DESC, link, page_id LIMIT 25""",
        "daily_digest": f"""WITH {_PARSED}, {_POSTINGS}, {_SCORES}, {_GEO},
            best25 AS (
              SELECT page_id, row_number() OVER (ORDER BY match_score DESC, link, page_id) AS place
              FROM postings JOIN scores USING (page_id) QUALIFY place <= 25),
            newest AS ({_first('sightings', 'page_id', 'ts DESC, event_id')}),
            best AS (SELECT page_id, event_id, place FROM best25 JOIN newest USING (page_id)),
            found AS (SELECT page_id FROM postings WHERE contains(lower(title || ' ' || jd), 'experience')),
            picked AS ({_daily('sightings', 'found', 'best')}),
            kept AS (
              SELECT p.scan_rank, p.place, s.* EXCLUDE (ts) FROM picked p JOIN suitable s USING (event_id)),
            linked AS (
              SELECT k.*, link, title, match_score
              FROM kept k JOIN postings p ON p.page_id = k.page_id JOIN scores c ON c.page_id = k.page_id)
            SELECT title, replace(company, ',', '') AS company, min_exp, max_exp, CAST(NULL AS BOOLEAN) AS age_match, overall, "primary", secondary,
              {_FLAGS}, link, match_score
            FROM ({_first('linked', 'link', 'scan_rank, place')})""",
        "daily_digest_text": f"""WITH {_SIGHTINGS}, {_POSTINGS}, {_RULES}, {_TEXT_SCORES}, {_GEO},
            best AS (
              SELECT page_id, CAST(NULL AS BIGINT) AS event_id,
                row_number() OVER (ORDER BY match_score DESC, link, page_id) AS place
              FROM postings JOIN text_scores USING (page_id) QUALIFY place <= 25),
            found AS (SELECT page_id FROM postings WHERE contains(lower(title || ' ' || jd), 'spark')),
            picked AS ({_daily('sightings', 'found', 'best')}),
            kept AS (
              SELECT p.scan_rank, p.place, r.*, match_score
              FROM picked p JOIN ruled r USING (page_id) JOIN text_scores USING (page_id)
              WHERE (min_exp = 'N/A' OR CAST(min_exp AS INTEGER) <= 2)
                AND NOT citizenship_required AND NOT security_clearance_required AND visa_sponsorship)
            SELECT title, company, min_exp, max_exp, CAST(NULL AS BOOLEAN) AS age_match, overall, "primary", secondary,
              {_FLAGS}, link, match_score
            FROM ({_first('kept', 'link', 'scan_rank, place')})""",
        "model_hook": f"""WITH {_POSTINGS}
            SELECT page_id,
              CASE WHEN length(jd) % 10 <> 0 THEN 'n' || length(jd) END AS company,
              CASE WHEN length(jd) % 10 <> 0 THEN CAST(length(jd) % 7 AS VARCHAR) END AS min_exp,
              CASE WHEN length(jd) % 10 = 0 THEN 'bad_json' END AS reason
            FROM postings""",
        "encode_hook": f"""WITH {_POSTINGS}
            SELECT page_id, length(jd) AS v0, length(jd) - length(replace(jd, 'a', '')) AS v1,
              length(jd) - length(replace(jd, 'e', '')) AS v2 FROM postings""",
        "stream_digest": f"""WITH {_PARSED}, {_HEADINGS},
            linked AS (SELECT s.*, link, heading FROM suitable s JOIN headings USING (page_id))
            SELECT replace(heading, ',', '') AS title, replace(company, ',', '') AS company, min_exp, max_exp,
              CAST(NULL AS BOOLEAN) AS age_match, overall, "primary", secondary, {_FLAGS}, link
            FROM ({_first('linked', 'link', 'ts DESC, event_id')})""",
        "stream_quarantine": f"""WITH {_PARSED} SELECT {_LINK} AS link,
            CASE WHEN parse_reason IS NULL THEN 'suitability' ELSE 'parse' END AS stage, reason, response AS raw
            FROM checked JOIN pages USING (page_id) WHERE reason IS NOT NULL""",
    }
    # the same commands with the scores of an encoder in place of those of the text or the stored ones
    for name, like in (("search_encoded", "search"), ("recommended_encoded", "recommended_text")):
        sql[name] = sql[like].replace(_TEXT_SCORES, _ENCODED_SCORES).replace("text_scores", "encoded_scores")
    sql["daily_digest_encoded"] = (
        sql["daily_digest"].replace(_SCORES, _ENCODED_SCORES).replace("JOIN scores", "JOIN encoded_scores")
    )
    sql["match_score_encoded"] = f"WITH {_POSTINGS}, {_ENCODED_SCORES} SELECT page_id, match_score FROM encoded_scores"
    return sql
