"""SQL definitions of the registered queries, for DuckDB over the same tables.

Written independently of the operators, from what each is meant to return.
Page fixtures have a known layout, so their markup is read with plain patterns.
"""

from __future__ import annotations

from workload.fixtures import with_fixtures

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_fixtures(sql)


NOW = "TIMESTAMP '2024-01-02 00:00:00'"
NORMAL = r"""lower(trim(regexp_replace(regexp_replace(strip_accents({0}), '[^\x00-\x7F]+', '', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')))"""
CITIES = ["Bucuresti", "Cluj", "Timisoara", "Iasi", "Constanta", "Brasov", "Craiova", "Oradea", "Sibiu"]
# What the queries without a suffix table take for public suffixes.
PUBLIC = (
    "ro com.ro org.ro info.ro nom.ro store.ro shop.ro firm.ro com net org info biz eu shop store online io co "
    "de fr it es at hu bg pl nl be ch uk co.uk org.uk md com.md"
)
SUFFIXES = ", ".join(f"('{s}')" for s in PUBLIC.split())


def normal(column: str) -> str:
    return NORMAL.format(column)


def hint(column: str) -> str:
    cases = " ".join(rf"WHEN regexp_matches({column}, '(?i)\b{c}\b') THEN '{c}'" for c in CITIES)
    return f"CASE {cases} END"


def size(column: str) -> str:
    found = rf"regexp_extract({column}, '(?i)\d+(?:[.,]\d+)?\s*(?:cm|mm|m|l|ml|kg|g|buc|set|m2|m\^2)')"
    return rf"nullif(lower(regexp_replace(replace({found}, ',', '.'), '^(\d+(?:\.\d+)?)\s*', '\1 ')), '')"


def price_steps(source: str, text: str, keep: str = "*") -> str:
    """CTEs that parse column ``text`` of relation ``source`` into relation ``priced``."""
    return rf"""
    p1 AS (SELECT {keep}, CASE WHEN {text} <> '' THEN replace(trim({text}), chr(160), ' ') END AS t FROM {source}),
    p2 AS (SELECT *, coalesce(
        nullif(regexp_extract(t, '(?i)(\d{{1,3}}(?:[.,\s]\d{{3}})*(?:[.,]\d{{1,2}})?)\s*(?:lei|ron)', 1), ''),
        nullif(regexp_extract(t, '\d+(?:[.,]\d{{1,2}})?'), '')) AS found FROM p1),
    p3 AS (SELECT *, replace(found, ' ', '') AS d, length(replace(found, ' ', '')) AS n FROM p2),
    p4 AS (SELECT *, n - length(replace(d, ',', '')) AS commas, n - length(replace(d, '.', '')) AS dots FROM p3),
    p5 AS (SELECT *, CASE WHEN commas = 1 AND dots = 0 THEN replace(d, ',', '.')
        WHEN dots > 1 AND commas = 0 THEN replace(d, '.', '')
        WHEN dots >= 1 AND commas = 1 THEN replace(replace(d, '.', ''), ',', '.')
        ELSE replace(d, ',', '') END AS plain FROM p4),
    priced AS (SELECT * EXCLUDE (t, found, d, n, commas, dots, plain),
        CASE WHEN regexp_matches(plain, '^\d+(\.\d+)?$') THEN regexp_replace(plain, '^0+(\d)', '\1') END AS price_token,
        CAST(TRY_CAST(plain AS DECIMAL(12,2)) AS DOUBLE) AS price,
        CASE WHEN regexp_matches(t, '(?i)\b(ron|lei)\b') THEN 'RON' END AS parsed_currency FROM p5)"""


def domains(source: str, column: str = "url") -> str:
    """CTEs that add ``domain`` to relation ``source`` as relation ``with_domain``."""
    return rf"""
    h1 AS (SELECT *, replace(lower(regexp_extract({column}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), 'www.', '') AS host
           FROM {source}),
    h2 AS (SELECT DISTINCT host, regexp_replace(host, '^.*@|:\d*$', '', 'g') AS name FROM h1),
    suffixes(suffix) AS (VALUES {SUFFIXES}),
    h3 AS (SELECT host, name, max(length(suffix)) AS n FROM h2 LEFT JOIN suffixes
           ON name = suffix OR ends_with(name, '.' || suffix) GROUP BY host, name),
    h4 AS (SELECT host, CASE WHEN n IS NULL THEN host WHEN length(name) = n THEN '.' || name
             ELSE regexp_extract(left(name, length(name) - n - 1), '[^.]*$') || '.' || right(name, n) END AS domain FROM h3),
    with_domain AS (SELECT h1.* EXCLUDE (host), h4.domain FROM h1 JOIN h4 USING (host))"""


def score(url: str, domain: str, rest: str = "''") -> str:
    blob = f"lower({url} || ' ' || {rest})"
    preferred = "gradina|garden|flori|horti|plante|construct|diy|magazin|shop|market"
    return (
        f"(CASE WHEN ends_with({domain}, '.ro') THEN 3.0 ELSE 0 END"
        f" + CASE WHEN regexp_matches({blob}, '{preferred}') THEN 2.0 ELSE 0 END"
        f" + CASE WHEN regexp_matches({blob}, '/(produs|product|p|item|catalog)') THEN 1.5 ELSE 0 END"
        f" - CASE WHEN regexp_matches({blob}, 'forum|pdf|blog|wikipedia|manual') THEN 3.0 ELSE 0 END"
        f" - CASE WHEN contains({url}, '?') AND contains({url}, 'sort') THEN 1.0 ELSE 0 END)::DOUBLE"
    )


def distance(lat: str, lon: str) -> str:
    a = (
        f"(pow(sin(radians({lat} - 44.4268) / 2), 2) + cos(radians(44.4268)) * cos(radians({lat}))"
        f" * pow(sin(radians({lon} - 26.1025) / 2), 2))"
    )
    return f"round(6371 * 2 * atan2(sqrt({a}), sqrt(1 - {a})), 2)"


def inside(option: str, unknown: str, km: str, city: str) -> str:
    return (
        f"CASE WHEN {option} = 'All Romania' THEN true"
        f" WHEN {option} = 'Bucuresti' AND contains(lower(coalesce({city}, '')), 'bucure') THEN true"
        f" WHEN {km} IS NULL THEN {unknown}"
        f" ELSE {km} <= CASE {option} WHEN 'Bucuresti' THEN 15 WHEN '50' THEN 50 WHEN '100' THEN 100 ELSE 200 END END"
    )


# Sources and requests

oracle("read_pages", """
WITH crawls AS (SELECT *, CAST(1 AS BIGINT) AS crawl FROM pages
  UNION ALL SELECT page_id, url, '<!-- 2 -->' || html, CAST(2 AS BIGINT) FROM pages WHERE page_id % 3 = 0)
SELECT arg_max(page_id, crawl) AS page_id, url, max(crawl) AS crawl, md5(arg_max(html, crawl)) AS html_md5
FROM crawls GROUP BY url
""")
oracle("allowed_domains", r"""
WITH items AS (SELECT lower(trim(unnest(string_split(entries, ',')))) AS v FROM fx_domain_entries),
hosts AS (SELECT regexp_replace(split_part(replace(replace(v, 'https://', ''), 'http://', ''), '/', 1), '^www\.', '') AS domain
          FROM items)
SELECT DISTINCT domain FROM hosts WHERE domain <> ''
""")

REQUESTS = rf"""
clean AS (SELECT job_id, query AS raw, trim(regexp_replace(query, '\s+', ' ', 'g')) AS query, radius_option, include_unknown,
    coalesce(max_urls, 30) AS max_urls, coalesce(time_budget_seconds, 60) AS time_budget_seconds FROM fx_requests),
checked AS (SELECT job_id, query, {normal('query')} AS query_normalized, radius_option, include_unknown, max_urls,
    time_budget_seconds, concat_ws(',',
      CASE WHEN length(raw) NOT BETWEEN 2 AND 180 THEN 'query_length' END,
      CASE WHEN length(raw) BETWEEN 2 AND 180 AND query = '' THEN 'query_blank' END,
      CASE WHEN radius_option NOT IN ('Bucuresti', '50', '100', '200', 'All Romania') THEN 'radius_option' END,
      CASE WHEN max_urls NOT BETWEEN 10 AND 200 THEN 'max_urls' END,
      CASE WHEN time_budget_seconds NOT BETWEEN 60 AND 180 THEN 'time_budget_seconds' END) AS errors FROM clean),
valid AS (SELECT * EXCLUDE (errors) FROM checked WHERE errors = '')"""

oracle("validate_requests", f"WITH {REQUESTS} SELECT * FROM checked")

# Text, prices, sizes, cities

oracle("normalize_text", f"SELECT doc_id, {normal('text')} AS normalized FROM documents")
oracle("parse_price", f"""
WITH {price_steps('fx_offers', 'price_text', 'id')}
SELECT id, price, price_token, parsed_currency AS currency FROM priced
""")
oracle("extract_size", f"SELECT id, {size('size_text')} AS size, {size('price_text')} AS size_in_price FROM fx_offers")
oracle("city_hint", f"""
SELECT id, {hint('place')} AS hint,
  nullif(regexp_extract(place, '(?i)Bucuresti|București|Cluj|Timisoara|Timișoara|Iasi|Iași|Constanta|Constanța|Brasov|Brașov'), '')
    AS mention FROM fx_places
""")

# URLs

oracle("registered_domain", r"""
WITH given AS (SELECT url FROM fx_urls UNION ALL SELECT url FROM pages UNION ALL SELECT url FROM fx_hosts),
hosts AS (SELECT url, replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), 'www.', '') AS host FROM given),
names AS (SELECT DISTINCT host, regexp_replace(host, '^.*@|:\d*$', '', 'g') AS name FROM hosts),
ends(ending, labels) AS (VALUES ('.ro', 1), ('.com.ro', 2), ('.org.ro', 2), ('.shop.ro', 2), ('.com', 1), ('.net', 1), ('.uk', 1),
  ('.co.uk', 2), ('.hu', 1), ('.co.hu', 2), ('.tr', 1), ('.com.tr', 2), ('.cz', 1), ('.sk', 1), ('.au', 1), ('.com.au', 2)),
fitting AS (SELECT host, name, max(labels) AS plain FROM names LEFT JOIN ends ON ends_with('.' || name, ending) GROUP BY host, name),
chosen AS (SELECT host, name, string_split(name, '.') AS parts, CASE
    WHEN ends_with('.' || name, '.www.ck') THEN 1
    WHEN ends_with(name, '.ck') THEN 2 ELSE plain END AS labels FROM fitting),
named AS (SELECT host, CASE WHEN labels IS NULL THEN host WHEN labels = len(parts) THEN '.' || name
    ELSE array_to_string(parts[-(labels + 1):], '.') END AS domain FROM chosen)
SELECT url, domain FROM hosts JOIN named ON hosts.host = named.host
""")
oracle("score_url", f"""
WITH {domains('fx_urls')}
SELECT url, title, snippet, {score('url', 'domain', "title || ' ' || snippet")} AS score FROM with_domain
""")

# Pages

oracle("usable_pages", """
SELECT page, NOT (contains(lower(html), 'enable javascript') OR length(html) < 400) AS usable FROM fx_all_pages
""")

UNESCAPE = (
    "replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)),"
    " '&lt;', '<'), '&amp;', '&')"
)
VISIBLE = r"regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<!>', 'g')"


def text_of(source: str, separator: str = " ") -> str:
    nodes = f"list_transform(regexp_split_to_array({source}, '<[^>]*>'), lambda n: trim({UNESCAPE.format('n')}))"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), '{separator}')"


oracle("extract_links", rf"""
WITH anchors AS (SELECT page, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, a.anchor, a.pos FROM fx_all_pages,
    LATERAL (SELECT unnest(regexp_extract_all(html, '(?s)<a .*?</a>')) AS anchor,
      generate_subscripts(regexp_extract_all(html, '(?s)<a .*?</a>'), 1) - 1 AS pos) AS a),
links AS (SELECT page, pos, site, {UNESCAPE.format("regexp_extract(anchor, 'href=\"([^\"]*)\"', 1)")} AS href,
    {text_of('anchor')} AS text FROM anchors),
resolved AS (SELECT page, CAST(pos AS INT) AS pos, text,
    CASE WHEN starts_with(href, 'http') THEN href ELSE site || href END AS link_url
    FROM links WHERE NOT starts_with(href, 'mailto:')),
{domains('resolved', 'link_url')}
SELECT page, pos, link_url, domain AS link_domain, text FROM with_domain WHERE domain IN (SELECT domain FROM fx_page_domains)
""")

FIELDS = """product_name, price, price_token, {currency} AS currency, {size} AS size_text, {location} AS location_text,
  {canonical} AS canonical_url, '{kind}' AS extractor"""
HAS = {
    "jsonld": "contains(html, 'application/ld+json')",
    "microdata": "contains(html, 'itemtype=')",
    "opengraph": "contains(html, 'og:title')",
}


def product_sql(kind: str, where: str) -> str:
    if kind == "jsonld":
        found = rf"""
        SELECT page, regexp_extract(html, '"name":"([^"]*)"', 1) AS product_name,
          regexp_extract(html, '"price":"([^"]*)"', 1) || ' RON' AS price_raw,
          nullif(trim(regexp_extract(html, '"size":"([^"]*)"', 1)), '') AS size_raw,
          regexp_extract(html, '"brand":."name":"([^"]*)"', 1) AS place,
          regexp_extract(html, '"url":"([^"]*)"', 1) AS canonical FROM fx_all_pages WHERE {where}"""
        fields = FIELDS.format(
            currency="'RON'", size=f"coalesce({size('size_raw')}, size_raw)", location="place", canonical="canonical", kind=kind
        )
    elif kind == "microdata":
        found = rf"""
        SELECT page, name AS product_name, amount AS price_raw, coalesce(nullif(trim(sz), ''), name || ' ' || amount) AS size_raw
        FROM (SELECT page, regexp_extract(html, 'itemprop="name">([^<]*)<', 1) AS name,
          regexp_extract(html, 'itemprop="price">([^<]*)<', 1) AS amount,
          regexp_extract(html, 'itemprop="size">([^<]*)<', 1) AS sz FROM fx_all_pages WHERE {where}) AS m"""
        fields = FIELDS.format(
            currency="'RON'", size=f"coalesce({size('size_raw')}, size_raw)", location="CAST(NULL AS VARCHAR)",
            canonical="CAST(NULL AS VARCHAR)", kind=kind,
        )
    elif kind == "opengraph":
        found = rf"""
        SELECT page, regexp_extract(html, 'og:title" content="([^"]*)"', 1) AS product_name,
          regexp_extract(html, 'og:description" content="([^"]*)"', 1) AS price_raw,
          regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1) AS canonical FROM fx_all_pages WHERE {where}"""
        fields = FIELDS.format(
            currency="'RON'", size=size("price_raw"), location="price_raw", canonical="canonical", kind=kind
        )
    else:
        heading = text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
        title = text_of("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
        found = rf"""
        SELECT page, coalesce(nullif(h, ''), nullif(ti, '')) AS product_name,
          regexp_extract(blob, '(?i)(?:\d{{1,3}}(?:[.\s]\d{{3}})*(?:,\d{{1,2}})?|\d+(?:[.,]\d{{1,2}})?)\s*(?:lei|ron)') AS price_raw,
          blob, CASE WHEN link = '' THEN url ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || link END AS canonical
        FROM (SELECT page, url, {heading} AS h, {title} AS ti, left({text_of(VISIBLE)}, 5000) AS blob,
            regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1) AS link FROM fx_all_pages WHERE {where}) AS b"""
        place = "nullif(regexp_extract(blob, '(?i)Bucuresti|Cluj|Timisoara|Iasi|Constanta|Brasov'), '')"
        fields = FIELDS.format(
            currency="'RON'", size=size("blob"), location=place, canonical="canonical", kind=kind
        )
    return f"WITH found AS ({found}), {price_steps('found', 'price_raw')} SELECT page, {fields} FROM priced WHERE product_name <> ''"


for _kind, _where in HAS.items():
    oracle(f"extract_{_kind}", product_sql(_kind, _where))
oracle("extract_heuristic", product_sql("heuristic", "true"))

_PLAIN = " AND ".join(f"NOT {w}" for w in HAS.values())


def cascade(extra: str = "true") -> str:
    parts = [product_sql(k, f"{w} AND {extra}") for k, w in HAS.items()]
    parts.append(product_sql("heuristic", f"{_PLAIN} AND {extra}"))
    return " UNION ALL ".join(f"SELECT * FROM ({p}) AS part{i}" for i, p in enumerate(parts))


oracle("extract_products", cascade())

_RULED = "regexp_matches(url, '^https://patru[.]ro/')"
oracle("site_rules", f"""
WITH ruled AS (SELECT page, url, {text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS product_name,
    {text_of("regexp_extract(html, '(Pret [^<]*)', 1)")} AS price_raw FROM fx_all_pages WHERE {_RULED}),
{price_steps('ruled', 'price_raw')}
SELECT page, product_name, price, price_token, 'RON' AS currency, CAST(NULL AS VARCHAR) AS size_text,
  'Romania' AS location_text, url AS canonical_url, 'adapter:patru' AS extractor FROM priced WHERE product_name <> ''
UNION ALL SELECT * FROM ({cascade(f'NOT {_RULED}')}) AS others
""")

# Places

oracle("distance_from_center", f"SELECT id, {distance('lat', 'lon')} AS distance_km FROM fx_places")
oracle("radius_filter", f"""
WITH located AS (SELECT id, radius_option, include_unknown, {distance('lat', 'lon')} AS distance_km,
    {hint('place')} AS location_city FROM fx_places)
SELECT id, radius_option, distance_km, location_city FROM located
WHERE {inside('radius_option', 'include_unknown', 'distance_km', 'location_city')}
""")
_CLEAN_PLACE = r"nullif(left(trim(regexp_replace(place, '\s+', ' ', 'g')), 500), '')"
oracle("geocode_join", f"""
SELECT id, place, city, address, lat, lon, country FROM (SELECT id, place, {_CLEAN_PLACE} AS k FROM fx_places) AS p
LEFT JOIN fx_gazetteer ON k = raw_location
""")
oracle("geocode_misses", f"""
SELECT DISTINCT k AS raw_location FROM (SELECT {_CLEAN_PLACE} AS k FROM fx_places) AS p
WHERE k IS NOT NULL AND k NOT IN (SELECT raw_location FROM fx_gazetteer)
""")

# Caches

oracle("cache_hits", f"""
WITH hits AS (SELECT l.job_id, l.ord, l.radius_option, l.include_unknown, c.*,
    {distance('location_lat', 'location_lon')} AS distance_km
  FROM fx_lookups AS l JOIN fx_cached_results AS c
  ON c.query_normalized = l.query_normalized AND c.source_url = l.url AND expires_at >= {NOW})
SELECT job_id, ord, cache_key, product_name, {normal('product_name')} AS normalized_name, domain,
  source_url AS canonical_url, CAST(price AS DOUBLE) AS price, CAST(price AS VARCHAR) AS price_token, size_text,
  location_city, distance_km, location_lat IS NULL AS location_unknown, 'cache' AS extraction_method,
  {inside('radius_option', 'include_unknown', 'distance_km', 'location_city')} AS accepted FROM hits
""")
MISSES = f"""
SELECT job_id, ord, query_normalized, url FROM fx_lookups AS l WHERE NOT EXISTS (SELECT 1 FROM fx_cached_results AS c
  WHERE c.query_normalized = l.query_normalized AND c.source_url = l.url AND expires_at >= {NOW})
"""
oracle("cache_misses", MISSES)
oracle("lookup_buckets", MISSES)
oracle("url_cache_gate", f"""
WITH {REQUESTS}, counts AS (SELECT query_normalized, count(*) AS n FROM fx_cached_urls WHERE expires_at >= {NOW} GROUP BY ALL)
SELECT job_id, valid.query_normalized, max_urls, coalesce(n, 0) AS cached_urls,
  coalesce(n, 0) > 0 AND coalesce(n, 0) >= least(10, max_urls) AS use_cache
FROM valid LEFT JOIN counts ON valid.query_normalized = counts.query_normalized
""")
oracle("purge_expired", f"SELECT * FROM fx_cached_urls WHERE NOT expires_at < {NOW}")
oracle("purge_hours", f"SELECT * FROM fx_cached_urls WHERE NOT expires_at < {NOW}")
oracle("append_url_cache", f"""
SELECT query_normalized, 'manual' AS provider, url, score, {NOW} AS created_at, {NOW} + INTERVAL 24 HOUR AS expires_at
FROM fx_cached_urls
""")
_VALUES = ["product_name", "price", "currency", "size_text", "location_city", "location_address", "location_lat", "location_lon"]
UPSERT = f"""
WITH numbered AS (SELECT *, sha1(query_normalized || '|' || source_url) AS cache_key, row_number() OVER (
    PARTITION BY query_normalized, source_url ORDER BY batch DESC, seq DESC, l_suppkey DESC) AS n FROM fx_incoming),
last AS (SELECT * FROM numbered WHERE n = 1),
merged AS (SELECT coalesce(o.cache_key, i.cache_key) AS cache_key, coalesce(o.query_normalized, i.query_normalized) AS query_normalized,
  coalesce(o.domain, i.domain) AS domain, coalesce(o.source_url, i.source_url) AS source_url,
  {', '.join(f'CASE WHEN i.cache_key IS NULL THEN o.{c} ELSE i.{c} END AS {c}' for c in _VALUES)},
  CASE WHEN o.cache_key IS NULL THEN {NOW} ELSE o.created_at END AS created_at,
  CASE WHEN i.cache_key IS NULL THEN o.expires_at ELSE {NOW} + INTERVAL 24 HOUR END AS expires_at
FROM fx_cached_results AS o FULL JOIN last AS i ON o.cache_key = i.cache_key)
SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM merged
"""
oracle("upsert_results", UPSERT)
oracle("upsert_buckets", UPSERT)

# Discovery

oracle("allowed_semi", f"""
WITH {domains('fx_urls')}
SELECT ord, l_partkey, l_suppkey, url FROM with_domain WHERE domain IN (SELECT domain FROM fx_allowed_urls)
""")
oracle("robots_filter", r"""
WITH section AS (SELECT host, arg_min(agent, CASE WHEN agent = '*' THEN 1000000 ELSE 0 END + rule_no) AS agent
    FROM fx_robots WHERE agent IN ('*', 'OfferBot') GROUP BY host),
rules AS (SELECT r.host, r.rule_no, r.path, r.path = '' OR r.allow AS allow
    FROM fx_robots AS r JOIN section AS s ON r.host = s.host AND r.agent = s.agent),
targets AS (SELECT DISTINCT url, regexp_extract(url, '^https://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^https://[^/?#]*(.*)$', 1) AS target FROM fx_links),
verdicts AS (SELECT url, arg_min(allow, rule_no) AS allow FROM targets AS t JOIN rules AS r
    ON t.host = r.host AND starts_with(t.target, r.path) GROUP BY url)
SELECT l.* FROM fx_links AS l LEFT JOIN verdicts AS v ON l.url = v.url WHERE coalesce(v.allow, true)
""")

FIRST_LINKS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY seed_domain ORDER BY pos, url, text) AS link_no FROM fx_links),
first_links AS (SELECT * FROM numbered WHERE link_no <= 120)"""
oracle("first_links", f"WITH {FIRST_LINKS} SELECT * FROM first_links")

WORDS = """
words AS (SELECT DISTINCT query_normalized, token FROM (
    SELECT query_normalized, unnest(string_split(query_normalized, ' ')) AS token FROM valid) AS w WHERE length(token) >= 3)"""
oracle("request_link_match", f"""
WITH {REQUESTS}, {WORDS}
SELECT DISTINCT query_normalized, seed_domain, url FROM fx_links JOIN words
ON contains(lower(url), token) OR contains(lower(text), token)
""")

# Full product of queries and links, ranked as each request would do by itself.
RANKED = f"""
{REQUESTS}, {WORDS}, {FIRST_LINKS},
once AS (SELECT seed_domain, url, min(link_no) AS link_no, arg_min(text, link_no) AS text FROM first_links GROUP BY ALL),
{domains('once')},
scored AS (SELECT seed_domain, url, link_no, text, {score('url', 'domain', "text || ' '")} AS score FROM with_domain),
matched AS (SELECT DISTINCT query_normalized, seed_domain, url FROM scored JOIN words
    ON contains(lower(url), token) OR contains(lower(text), token)),
queries AS (SELECT DISTINCT query_normalized FROM valid),
every AS (SELECT q.query_normalized, s.seed_domain, s.url, s.link_no,
    s.score + CASE WHEN m.url IS NULL THEN 0 ELSE 2 END AS score
  FROM queries AS q CROSS JOIN scored AS s LEFT JOIN matched AS m
  ON m.query_normalized = q.query_normalized AND m.seed_domain = s.seed_domain AND m.url = s.url),
per_domain AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_normalized, seed_domain
    ORDER BY score DESC, link_no) AS rank FROM every) AS r WHERE rank <= 3),
winners AS (SELECT *, row_number() OVER (PARTITION BY query_normalized, url ORDER BY seed_domain, rank) AS n FROM per_domain),
positions AS (SELECT query_normalized, url, score, row_number() OVER (PARTITION BY query_normalized
    ORDER BY score DESC, seed_domain, rank) AS position FROM winners WHERE n = 1),
best AS (SELECT query_normalized, position, url, score FROM positions WHERE position <= 200)"""

oracle("top_links_per_domain", f"""
WITH {RANKED}
SELECT query_normalized, seed_domain, rank, url, score FROM per_domain
WHERE (query_normalized, seed_domain) IN (SELECT query_normalized, seed_domain FROM matched)
UNION ALL SELECT CAST(NULL AS VARCHAR), seed_domain, rank, url, score FROM (SELECT seed_domain, url, score,
    row_number() OVER (PARTITION BY seed_domain ORDER BY score DESC, link_no) AS rank FROM scored) AS base WHERE rank <= 3
""")
oracle("top_links", f"WITH {RANKED} SELECT * FROM best")
oracle("rank_candidates", f"""
WITH {RANKED},
wanted AS (SELECT DISTINCT query_normalized, max_urls FROM valid),
cut AS (SELECT w.query_normalized, w.max_urls, b.url, b.position FROM best AS b JOIN wanted AS w
    ON b.query_normalized = w.query_normalized AND b.position <= w.max_urls),
{domains('cut').replace('h1 AS', 'g1 AS').replace('FROM h1', 'FROM g1').replace('h1.*', 'g1.*')
  .replace('h2', 'g2').replace('h3', 'g3').replace('h4', 'g4').replace('with_domain', 'cut_domain')
  .replace('suffixes(suffix) AS (VALUES', 'suffixes2(suffix) AS (VALUES')},
kept AS (SELECT *, {score('url', 'domain')} AS score FROM cut_domain WHERE domain IN (SELECT domain FROM fx_allowed))
SELECT query_normalized, max_urls, rank, url, domain, score, CAST((rank - 1) // 25 AS INT) AS batch_no FROM (
  SELECT *, row_number() OVER (PARTITION BY query_normalized, max_urls ORDER BY score DESC, position) AS rank
  FROM kept WHERE score >= 1.0) AS r
""")

# Results

oracle("build_results", f"""
WITH products AS ({cascade("starts_with(page, 'x')")}),
asked AS (SELECT 'x' || CAST(page_id AS STRING) AS page, 'job' || CAST(page_id % 50 AS STRING) AS job_id, url,
    CASE page_id % 7 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN '50' WHEN 2 THEN '200' ELSE 'All Romania' END AS radius_option,
    page_id % 2 = 0 AS include_unknown FROM fx_product_pages),
located AS (SELECT p.*, a.job_id, a.url, a.radius_option, a.include_unknown, g.address, g.lat, g.lon,
    coalesce({hint('p.location_text')}, g.city) AS location_city, {distance('g.lat', 'g.lon')} AS distance_km
  FROM products AS p JOIN asked AS a USING (page) LEFT JOIN fx_gazetteer AS g ON trim(p.location_text) = g.raw_location),
{domains('located')}
SELECT job_id, product_name, {normal('product_name')} AS normalized_name, domain, url AS source_url, canonical_url, price,
  currency, size_text, location_city, address AS location_address, lat AS location_lat, lon AS location_lon, distance_km,
  lat IS NULL AS location_unknown, 'httpx' AS extraction_method, extractor FROM with_domain
WHERE {inside('radius_option', 'include_unknown', 'distance_km', 'location_city')}
""")
oracle("union_cached_fresh", """
SELECT job_id, rank, url, NOT is_cached AS is_fetched, CAST((rank - 1) // 25 AS INT) AS batch_no,
  CAST((rank - 1) // 25 * 50 + CASE WHEN is_cached THEN 0 ELSE 25 END + (rank - 1) % 25 AS BIGINT) AS ord FROM fx_ranked
""")

DEDUPE = """
WITH ordered AS (SELECT job_id, list({'ord': ord, 'p': l_partkey, 's': l_suppkey, 'n': normalized_name, 'd': domain,
    't': price_token, 'u': url, 'k': normalized_name || '|' || domain || '|' || price_token}
    ORDER BY ord, l_partkey, l_suppkey) AS rows FROM fx_candidates GROUP BY job_id),
kept AS (SELECT job_id, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda a, x:
    CASE WHEN list_contains(list_transform(a, lambda y: y.k), x[1].k) OR list_contains(list_transform(a, lambda y: y.u), x[1].u)
    THEN a ELSE list_concat(a, x) END)) AS r FROM ordered)
SELECT job_id, r.ord AS ord, r.p AS l_partkey, r.s AS l_suppkey, r.n AS normalized_name, r.d AS domain,
  r.t AS price_token, r.u AS url FROM kept
"""
oracle("dedupe_results", DEDUPE)
oracle("stream_dedupe", DEDUPE)
oracle("job_status", """
WITH counts AS (SELECT job_id, count(*) AS total, count(*) FILTER (processed) AS done, count(*) FILTER (found) AS found,
    count(*) FILTER (error) AS error FROM fx_items GROUP BY job_id)
SELECT j.job_id, status, coalesce(total, 0) AS total_candidate_urls, coalesce(done, 0) AS processed_urls,
  coalesce(found, 0) AS found_products, coalesce(error, 0) AS errors,
  CASE WHEN coalesce(total, 0) > 0 THEN round(least(100.0, CAST(done AS DOUBLE) / total * 100), 2)
    WHEN status = 'done' THEN 100.0 ELSE 0.0 END::DOUBLE AS progress
FROM fx_jobs AS j LEFT JOIN counts AS c ON j.job_id = c.job_id
""")
oracle("stream_progress", """
SELECT job_id, count(*) AS total_candidate_urls, count(*) FILTER (processed) AS processed_urls,
  count(*) FILTER (found) AS found_products, count(*) FILTER (error) AS errors FROM fx_items GROUP BY job_id
""")
oracle("filter_results", """
SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM fx_results
WHERE normalized_name LIKE '%red widget%' AND size_text ILIKE '%1_ c%' AND price >= 100.0 AND price <= 60000.0
""")
oracle("job_results", """
SELECT id, job_id, left(product_name, 500) AS product_name, left(normalized_name, 500) AS normalized_name, left(domain, 255) AS domain,
  source_url, CAST(price AS DOUBLE) AS price, left(currency, 10) AS currency, left(size_text, 180) AS size_text,
  left(location_city, 120) AS location_city, left(location_address, 500) AS location_address, distance_km, location_unknown,
  false AS truncated
FROM fx_results WHERE job_id = 'job7'
""")
oracle("result_total", "SELECT count(*) AS total FROM fx_results WHERE price >= 1000.0")
oracle("sort_results", """
SELECT id, domain, CAST(price AS DOUBLE) AS price FROM fx_results ORDER BY price DESC NULLS FIRST, id
""")
PAGE = """
SELECT id, domain, CAST(price AS DOUBLE) AS price FROM fx_results ORDER BY domain ASC NULLS LAST, id LIMIT 500 OFFSET 1000
"""
oracle("page_results", PAGE)
oracle("page_of_index", PAGE)
API = """
api AS (SELECT id, product_name AS productName, domain AS website, source_url AS sourceUrl, CAST(price AS DOUBLE) AS price,
    currency, size_text AS size, location_city AS locationCity, location_address AS locationAddress,
    distance_km AS distanceKm, location_unknown AS locationUnknown FROM fx_results)"""
oracle("api_rows", f"WITH {API} SELECT * FROM api")
oracle("table_view", f"""
WITH {API} SELECT * FROM api WHERE contains(lower(productName), 'red-w') AND contains(lower(coalesce(size, '')), ' l')
  AND price IS NOT NULL AND price <= 70000.0 ORDER BY lower(website), id
""")


def number_text(column: str) -> str:
    return rf"regexp_replace(CAST(CAST({column} AS DECIMAL(20,2)) AS VARCHAR), '\.?0+$', '')"


oracle("display_rows", f"""
WITH {API} SELECT id, productName, website,
  CASE WHEN price IS NULL THEN '-' ELSE {number_text('price')} || ' ' || coalesce(currency, 'RON') END AS "priceLabel",
  coalesce(size, '-') AS "sizeLabel",
  CASE WHEN locationUnknown THEN 'Necunoscut' ELSE coalesce(locationCity, 'Romania') ||
    CASE WHEN coalesce(distanceKm, 0) <> 0 THEN ' (' || {number_text('distanceKm')} || ' km)' ELSE '' END END AS "locationLabel",
  sourceUrl FROM api
""")
oracle("csv_export", f"""
WITH {API} SELECT productName AS "Produs", website AS "Site", coalesce({number_text('price')}, '') AS "Pret",
  coalesce(currency, '') AS "Moneda", coalesce(size, '') AS "Marime", coalesce(locationCity, '') AS "Oras locatie",
  coalesce(locationAddress, '') AS "Adresa locatie", coalesce({number_text('distanceKm')}, '') AS "Distanta km",
  sourceUrl AS "URL" FROM api
""")

SEARCH_STEPS = f"""
WITH {RANKED},
gate AS (SELECT v.*, coalesce(n, 0) > 0 AND coalesce(n, 0) >= least(10, max_urls) AS use_cache FROM valid AS v LEFT JOIN
    (SELECT query_normalized, count(*) AS n FROM fx_cached_urls WHERE expires_at >= {NOW} GROUP BY ALL) AS c
    ON c.query_normalized = v.query_normalized),
cached_list AS (SELECT query_normalized, url, row_number() OVER (PARTITION BY query_normalized
    ORDER BY score DESC, created_at, url) AS rank FROM fx_cached_urls WHERE expires_at >= {NOW}),
wanted AS (SELECT DISTINCT query_normalized, max_urls FROM gate WHERE NOT use_cache),
cut AS (SELECT w.query_normalized, w.max_urls, b.url, b.position, regexp_extract(b.url, '//(?:www[.])?([^/]*)', 1) AS dom
    FROM best AS b JOIN wanted AS w ON b.query_normalized = w.query_normalized AND b.position <= w.max_urls),
kept AS (SELECT *, {score('url', 'dom')} AS score FROM cut WHERE dom IN (SELECT domain FROM fx_allowed)),
discovered AS (SELECT query_normalized, url, max(score) AS score FROM kept WHERE score >= 1.0 GROUP BY query_normalized, url),
ranked AS (SELECT query_normalized, max_urls, url, row_number() OVER (PARTITION BY query_normalized, max_urls
    ORDER BY score DESC, position) AS rank FROM kept WHERE score >= 1.0),
candidates AS (
  SELECT g.*, c.url, c.rank FROM gate AS g JOIN cached_list AS c USING (query_normalized) WHERE use_cache AND c.rank <= max_urls
  UNION ALL SELECT g.*, r.url, r.rank FROM gate AS g JOIN ranked AS r USING (query_normalized, max_urls) WHERE NOT use_cache),
live AS (SELECT * FROM fx_search_cache WHERE expires_at >= {NOW}),
hits AS (SELECT c.job_id, c.rank, c.url, c.radius_option, c.include_unknown, l.product_name, l.domain,
    CAST(l.price AS DOUBLE) AS price, CAST(l.price AS VARCHAR) AS price_token, l.size_text, l.location_city,
    {distance('l.location_lat', 'l.location_lon')} AS distance_km, 'cache' AS extraction_method, 'cache' AS extractor, 0 AS fetched
  FROM candidates AS c JOIN live AS l ON l.query_normalized = c.query_normalized AND l.source_url = c.url),
misses AS (SELECT c.* FROM candidates AS c WHERE NOT EXISTS (
    SELECT 1 FROM live AS l WHERE l.query_normalized = c.query_normalized AND l.source_url = c.url)),
section AS (SELECT host, arg_min(agent, CASE WHEN agent = '*' THEN 1000000 ELSE 0 END + rule_no) AS agent
    FROM fx_robots WHERE agent IN ('*', 'OfferBot') GROUP BY host),
rules AS (SELECT r.host, r.rule_no, r.path, r.path = '' OR r.allow AS allow
    FROM fx_robots AS r JOIN section AS s ON r.host = s.host AND r.agent = s.agent),
verdicts AS (SELECT url, arg_min(allow, rule_no) AS allow FROM (SELECT DISTINCT url FROM misses) AS t JOIN rules AS r
    ON regexp_extract(url, '^https://([^/?#]*)', 1) = r.host
    AND starts_with(regexp_extract(url, '^https://[^/?#]*(.*)$', 1), r.path) GROUP BY url),
read AS (SELECT p.url, {text_of(VISIBLE)} AS blob FROM fx_link_pages AS p
    WHERE length(html) >= 400 AND url NOT IN (SELECT url FROM verdicts WHERE NOT allow)),
found AS (SELECT url, regexp_extract(blob, 'Oferta [0-9]+') AS product_name, regexp_extract(blob, '[0-9]+,50 lei') AS price_raw,
    {size('blob')} AS size_text, nullif(regexp_extract(blob, 'Bucuresti|Cluj|Brasov'), '') AS place FROM read),
{price_steps('found', 'price_raw')},
located AS (SELECT m.job_id, m.rank, m.url, m.radius_option, m.include_unknown, p.product_name,
    regexp_extract(m.url, '//(?:www[.])?([^/]*)', 1) AS domain, p.price, p.price_token, p.size_text, p.place AS location_city,
    {distance('g.lat', 'g.lon')} AS distance_km, 'httpx' AS extraction_method, 'heuristic' AS extractor, 1 AS fetched
  FROM misses AS m JOIN priced AS p ON p.url = m.url LEFT JOIN fx_gazetteer AS g ON g.raw_location = p.place),
offers AS (SELECT *, (rank - 1) // 25 * 50 + fetched * 25 + (rank - 1) % 25 AS ord,
    lower(product_name) || '|' || domain || '|' || CASE WHEN price = 0 THEN '' ELSE price_token END AS k
  FROM (SELECT * FROM hits UNION ALL SELECT * FROM located) AS merged
  WHERE {inside('radius_option', 'include_unknown', 'distance_km', 'location_city')}),
lists AS (SELECT job_id, list({{'ord': ord, 'k': k, 'u': url}} ORDER BY ord) AS rows FROM offers GROUP BY job_id),
first_ones AS (SELECT job_id, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda a, x:
    CASE WHEN list_contains(list_transform(a, lambda y: y.k), x[1].k) OR list_contains(list_transform(a, lambda y: y.u), x[1].u)
    THEN a ELSE list_concat(a, x) END)) AS r FROM lists),
results AS (SELECT o.job_id, o.rank, o.url AS source_url, product_name, domain, price, price_token, size_text, location_city, distance_km,
  extraction_method, extractor FROM offers AS o JOIN first_ones AS f ON f.job_id = o.job_id AND f.r.ord = o.ord),
fresh AS (SELECT DISTINCT sha1(m.query_normalized || '|' || o.url) AS cache_key, m.query_normalized, o.domain, o.url AS source_url,
    o.product_name, o.price, o.location_city FROM offers AS o JOIN misses AS m USING (job_id, rank) WHERE o.fetched = 1)
"""
FROM_PAGES = SEARCH_STEPS.replace("fx_links", "fx_seed_links")
oracle("search_requests", f"{SEARCH_STEPS} SELECT * FROM results")
oracle("search_from_pages", f"{FROM_PAGES} SELECT * FROM results")
oracle("search_status", f"""{FROM_PAGES}
SELECT job_id, 'done' AS status, (SELECT count(*) FROM candidates AS c WHERE c.job_id = v.job_id) AS total_candidate_urls,
  (SELECT count(*) FROM candidates AS c WHERE c.job_id = v.job_id) AS processed_urls,
  (SELECT count(*) FROM results AS r WHERE r.job_id = v.job_id) AS found_products,
  (SELECT count(*) FROM misses AS m WHERE m.job_id = v.job_id AND m.url NOT IN (SELECT url FROM read)) AS errors,
  CAST(100 AS DOUBLE) AS progress FROM valid AS v
""")
oracle("search_new_urls", f"""{FROM_PAGES}
SELECT query_normalized, 'manual' AS provider, url, score, {NOW} AS created_at, {NOW} + INTERVAL 1 DAY AS expires_at FROM discovered
""")
SEARCH_CACHE = f"""{SEARCH_STEPS}
SELECT cache_key, coalesce(o.query_normalized, f.query_normalized) AS query_normalized, coalesce(o.domain, f.domain) AS domain,
  coalesce(o.source_url, f.source_url) AS source_url,
  CASE WHEN f.domain IS NULL THEN o.product_name ELSE f.product_name END AS product_name,
  CASE WHEN f.domain IS NULL THEN CAST(o.price AS DOUBLE) ELSE f.price END AS price,
  CASE WHEN f.domain IS NULL THEN o.location_city ELSE f.location_city END AS location_city,
  coalesce(o.created_at, {NOW}) AS created_at, CASE WHEN f.domain IS NULL THEN o.expires_at ELSE {NOW} + INTERVAL 1 DAY END AS expires_at
FROM fx_search_cache AS o FULL JOIN fresh AS f USING (cache_key)
"""
oracle("search_cache", SEARCH_CACHE)
oracle("search_refresh", SEARCH_CACHE)

# Time-driven and incremental

RATE = """
WITH ordered AS (SELECT user_id AS key, list({'id': event_id, 'ts': ts, 'ok': false} ORDER BY ts, event_id) AS rows
    FROM events GROUP BY user_id),
decided AS (SELECT key, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda a, x: list_concat(a,
    [{'id': x[1].id, 'ts': x[1].ts, 'ok': len(list_filter(a, lambda y: y.ok AND y.ts >= x[1].ts - INTERVAL 1 DAY)) < 3}]),
    CAST([] AS STRUCT(id BIGINT, ts TIMESTAMP, ok BOOLEAN)[]))) AS r FROM ordered)
SELECT r.id AS event_id, key, r.ts AS ts, r.ok AS admitted FROM decided
"""
oracle("rate_limit", RATE)
oracle("stream_rate_limit", RATE)
oracle("stream_rate_limit_keyed", RATE)
oracle("stream_extract", f"""
SELECT CAST(substr(page, 2) AS BIGINT) AS page_id, * EXCLUDE (page) FROM ({cascade("starts_with(page, 'x')")}) AS p
""")
