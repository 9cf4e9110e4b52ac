"""Derived input tables, in SQL that Spark and DuckDB both accept.

The raw pages carry no product markup, so the queries run on tables derived
from the given ones; each grows with the table it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.plans.checkpoints import working_folder
from offerloom.sources.tables import spread, stream_table

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIXTURES: dict[str, str] = {}

FIXTURES["fx_offers"] = """
WITH b AS (
  SELECT p_partkey AS id, p_name AS name, p_size AS sz,
         CAST((p_partkey * 7919) % 500000 + 150 AS BIGINT) AS cents FROM part),
c AS (
  SELECT id, name, sz, CAST(floor(cents / 100) AS BIGINT) AS w,
         lpad(CAST(cents % 100 AS STRING), 2, '0') AS dd FROM b),
d AS (
  SELECT id, name, sz, w, dd,
         CAST(w AS STRING) AS ws,
         CASE WHEN w >= 1000 THEN CAST(CAST(floor(w / 1000) AS BIGINT) AS STRING) ELSE '' END AS k,
         CASE WHEN w >= 1000 THEN lpad(CAST(w % 1000 AS STRING), 3, '0') ELSE CAST(w AS STRING) END AS r FROM c)
SELECT id, name,
  CASE id % 8
    WHEN 0 THEN CASE WHEN w >= 1000 THEN k || '.' || r ELSE r END || ',' || dd || ' lei'
    WHEN 1 THEN ws || ',' || dd || ' lei'
    WHEN 2 THEN ws || '.' || dd || ' RON'
    WHEN 3 THEN CASE WHEN w >= 1000 THEN k || ' ' || r ELSE r END || ' lei'
    WHEN 4 THEN ws || 'lei'
    WHEN 5 THEN ws || ' EUR'
    WHEN 6 THEN 'Livrare 24h' END AS price_text,
  CASE id % 6
    WHEN 0 THEN 'Jardiniera ' || CAST(sz AS STRING) || ' cm lemn'
    WHEN 1 THEN 'Pamant ' || CAST(sz AS STRING) || 'L'
    WHEN 2 THEN CAST(sz AS STRING) || ',5 ml'
    WHEN 3 THEN 'set ' || CAST(sz AS STRING) || ' BUC'
    WHEN 4 THEN 'fara marime' END AS size_text
FROM d
"""

FIXTURES["fx_product_pages"] = """
WITH o AS (
  SELECT id, name, CAST(floor(id / 8) AS BIGINT) % 4 AS m, coalesce(price_text, 'la cerere') AS pt, coalesce(size_text, '') AS st,
    CASE id % 5 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN 'Cluj' WHEN 2 THEN 'Brasov'
                WHEN 3 THEN 'Iasi' ELSE 'Roma' END AS city,
    CASE id % 4 WHEN 0 THEN 'www.gradina-unu.ro' WHEN 1 THEN 'flori.doi.ro'
                WHEN 2 THEN 'shop.trei.com' ELSE 'patru.ro' END AS host
  FROM fx_offers)
SELECT id AS page_id,
  'https://' || host || CASE id % 3 WHEN 0 THEN '/produs/' WHEN 1 THEN '/blog/' ELSE '/articol?sort=' END
    || CAST(id AS STRING) AS url,
  CASE WHEN id % 20 = 19 THEN '<html><body><h1>' || name || '</h1>Please ENABLE JavaScript</body></html>'
  ELSE '<html><head><title>' || name || ' ' || CAST(id AS STRING) || '</title>' ||
    CASE m
      WHEN 0 THEN '<script type="application/ld+json">{"@type":"Product","name":"' || name || ' ' || CAST(id AS STRING)
        || '","size":"' || st || '","brand":{"name":"' || city || '"},"offers":{"price":"' || pt
        || '","priceCurrency":"RON"},"url":"/p/' || CAST(id AS STRING) || '"}</script></head><body>'
      WHEN 1 THEN '</head><body><div itemtype="https://schema.org/Product"><span itemprop="name">' || name
        || '</span><span itemprop="price">' || pt || '</span><span itemprop="size">' || st || '</span></div>'
      WHEN 2 THEN '<meta property="og:title" content="' || name || '"/><meta property="og:description" content="Pret '
        || pt || ' ' || st || ' ' || city || '"/><link rel="canonical" href="/c/' || CAST(id AS STRING) || '"/></head><body>'
      ELSE '</head><body><h1>' || name || '</h1><p>Pret ' || pt || ', ' || st || ', livrare ' || city || '</p>' END
    || '<a href="/produs/' || CAST(id + 1 AS STRING) || '">' || name || '</a><a href="mailto:x@y.ro">m</a>'
    || '<a href="https://patru.ro/shop/' || CAST(id % 50 AS STRING) || '">magazin</a>'
    || '<p>' || repeat('text ', 90) || '</p></body></html>' END AS html
FROM o
"""

FIXTURES["fx_gazetteer"] = """
SELECT raw_location, city, address, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, country FROM (VALUES
  ('Bucuresti', 'Bucuresti', 'Bucuresti, Romania', 44.4361, 26.1027, 'Romania'),
  ('Cluj', 'Cluj', 'Cluj, Romania', 46.7712, 23.6236, 'Romania'),
  ('Brasov', 'Brasov', 'Brasov, Romania', 45.6427, 25.5887, 'Romania'),
  ('Ploiesti', NULL, 'Ploiesti, Romania', 44.9367, 26.0129, 'Romania'),
  ('Iasi', 'Iasi', 'Iasi, Romania', 47.1585, 27.6014, 'Romania'))
  AS g(raw_location, city, address, lat, lon, country)
"""

FIXTURES["fx_requests"] = """
SELECT 'job' || CAST(c_custkey AS STRING) AS job_id,
  CASE c_custkey % 7 WHEN 0 THEN '  red   widget ' WHEN 1 THEN 'small ring' WHEN 2 THEN '   '
    WHEN 3 THEN 'x' WHEN 4 THEN 'magazin' ELSE lower(c_mktsegment) END AS query,
  CASE c_custkey % 6 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN '50' WHEN 2 THEN '100' WHEN 3 THEN '200'
    WHEN 4 THEN 'All Romania' ELSE '75' END AS radius_option,
  c_custkey % 2 = 0 AS include_unknown,
  CASE c_custkey % 5 WHEN 0 THEN CAST(NULL AS INT) WHEN 1 THEN 5 WHEN 2 THEN 250 ELSE 30 END AS max_urls,
  CASE c_custkey % 4 WHEN 0 THEN CAST(NULL AS INT) WHEN 1 THEN 59 ELSE 120 END AS time_budget_seconds
FROM customer
"""

FIXTURES["fx_candidates"] = """
SELECT 'job' || CAST(l_orderkey % 1000 AS STRING) AS job_id,
  l_orderkey * 10 + l_linenumber AS ord, l_partkey, l_suppkey,
  'name' || CAST(l_partkey % 25 AS STRING) AS normalized_name,
  'd' || CAST(l_suppkey % 3 AS STRING) || '.ro' AS domain,
  CASE WHEN l_partkey % 9 = 0 THEN '' ELSE CAST(l_partkey % 2 AS STRING) || '9.90' END AS price_token,
  'https://d' || CAST(l_suppkey % 3 AS STRING) || '.ro/p/' || CAST((l_partkey + l_suppkey) % 40 AS STRING) AS url
FROM lineitem
"""

FIXTURES["fx_places"] = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 12 WHEN 0 THEN 'Livrare in Bucuresti si Cluj' WHEN 1 THEN 'Cluj sau Bucuresti'
    WHEN 2 THEN 'str. BRASOV nr. ' || CAST(o_custkey AS STRING) WHEN 3 THEN 'Iasiul vechi'
    WHEN 4 THEN 'timisoara, CRAIOVA' WHEN 5 THEN 'Sibiu/Oradea' WHEN 6 THEN 'Pret ' || o_orderpriority
    WHEN 7 THEN '  Ploiesti  ' WHEN 8 THEN 'Roma' WHEN 9 THEN ' Iasi   ' WHEN 10 THEN '   '
    ELSE 'Bucuresti' END AS place,
  CASE o_orderkey % 5 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN '50' WHEN 2 THEN '100' WHEN 3 THEN '200'
    ELSE 'All Romania' END AS radius_option,
  o_custkey % 2 = 0 AS include_unknown,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(43.6 + CAST(o_custkey % 460 AS DOUBLE) / 100 AS DOUBLE) END AS lat,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(20.3 + CAST(o_orderkey % 940 AS DOUBLE) / 100 AS DOUBLE) END AS lon
FROM orders
"""

FIXTURES["fx_urls"] = """
SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey, l_suppkey,
  CASE l_partkey % 10 WHEN 0 THEN 'https://www.magazin' WHEN 1 THEN 'http://SHOP.firma' WHEN 2 THEN 'https://flori'
    WHEN 3 THEN 'https://a.b.c' WHEN 4 THEN 'http://forum' WHEN 5 THEN 'https://plante' WHEN 6 THEN 'https://u:p@x'
    WHEN 7 THEN 'HTTPS://www.www.y' WHEN 8 THEN '/fara/gazda' ELSE '//z' END
  || CASE WHEN l_partkey % 10 = 8 THEN '' ELSE CAST(l_suppkey AS STRING)
    || CASE l_linenumber % 7 WHEN 0 THEN '.ro' WHEN 1 THEN '.com.ro' WHEN 2 THEN '.co.uk' WHEN 3 THEN '.com:8080'
         WHEN 4 THEN '.intern' WHEN 5 THEN '.shop.ro' ELSE '.net' END END
  || CASE l_orderkey % 6 WHEN 0 THEN '/produs/' WHEN 1 THEN '/blog/' WHEN 2 THEN '/c?sort=' WHEN 3 THEN '/item/'
       WHEN 4 THEN '?q=' ELSE '/categorie/für ' END || CAST(l_partkey AS STRING) AS url,
  CASE l_quantity % 3 WHEN 0 THEN 'Horti ' || l_returnflag WHEN 1 THEN 'Manual PDF' ELSE '' END AS title,
  CASE WHEN l_linestatus = 'O' THEN 'diy' ELSE 'altceva' END AS snippet
FROM lineitem
"""

FIXTURES["fx_suffixes"] = """
SELECT suffix FROM (VALUES ('ro'), ('com.ro'), ('org.ro'), ('shop.ro'), ('com'), ('net'), ('uk'), ('co.uk'), ('hu'), ('co.hu'),
  ('tr'), ('com.tr'), ('cz'), ('sk'), ('au'), ('com.au'), ('*.ck'), ('!www.ck')) AS rules(suffix)
"""

FIXTURES["fx_hosts"] = """
SELECT 'https://www.' || CASE s_suppkey % 3 WHEN 0 THEN 'flori' WHEN 1 THEN 'a.b.flori' ELSE '' END
  || CASE WHEN s_suppkey % 3 = 2 THEN 'x' ELSE CAST(s_suppkey AS STRING) END
  || CASE s_suppkey % 10 WHEN 0 THEN '.co.hu' WHEN 1 THEN '.com.tr' WHEN 2 THEN '.cz' WHEN 3 THEN '.sk' WHEN 4 THEN '.com.au'
       WHEN 5 THEN '.ck' WHEN 6 THEN '.any.ck' WHEN 7 THEN '.m.www.ck' WHEN 8 THEN '.nowhere' ELSE '.hu' END || '/p' AS url
FROM supplier
"""

FIXTURES["fx_links"] = """
SELECT 's' || CAST(l_suppkey AS STRING) || '.ro' AS seed_domain,
  l_orderkey * 10 + l_linenumber AS pos,
  CASE l_partkey % 4 WHEN 0 THEN 'https://www.s' || CAST(l_suppkey AS STRING) || '.ro/produs/'
    WHEN 1 THEN 'https://s' || CAST(l_suppkey AS STRING) || '.ro/blog/'
    WHEN 2 THEN 'https://s' || CAST(l_partkey % 17 AS STRING) || '.ro/shop/'
    ELSE 'https://www.s' || CAST(l_suppkey AS STRING) || '.ro/lista?sort=' END
  || CASE l_orderkey % 3 WHEN 0 THEN 'ring-' WHEN 1 THEN 'furniture/' ELSE '' END
  || CAST(l_partkey % 211 AS STRING) AS url,
  CASE l_linenumber % 5 WHEN 0 THEN 'Red Widget ' || CAST(l_partkey % 13 AS STRING) WHEN 1 THEN 'Small bolt'
    WHEN 2 THEN 'Magazin de flori' WHEN 3 THEN 'Building kit' ELSE '' END AS text
FROM lineitem
"""

FIXTURES["fx_robots"] = """
SELECT 's' || CAST(s_suppkey AS STRING) || '.ro' AS host,
  CASE r WHEN 1 THEN 'OfferBot' WHEN 4 THEN 'OtherBot' WHEN 5 THEN 'OfferBot' ELSE '*' END AS agent,
  CAST(r AS INT) AS rule_no, (s_suppkey + r) % 3 = 0 AS allow,
  CASE (s_suppkey * 7 + r * 3) % 8 WHEN 0 THEN '/produs' WHEN 1 THEN '/blog/' WHEN 2 THEN '/shop/ring-1' WHEN 3 THEN '/'
    WHEN 4 THEN '*' WHEN 5 THEN '' WHEN 6 THEN '/lista?sort' ELSE '/shop' END AS path
FROM (SELECT s_suppkey, 1 AS r FROM supplier UNION ALL SELECT s_suppkey, 2 FROM supplier
  UNION ALL SELECT s_suppkey, 3 FROM supplier UNION ALL SELECT s_suppkey, 4 FROM supplier
  UNION ALL SELECT s_suppkey, 5 FROM supplier) AS k
WHERE s_suppkey % 4 <> 3 AND (s_suppkey % 2 = 0 OR r NOT IN (1, 5))
"""

FIXTURES["fx_lookups"] = """
SELECT 'job' || CAST(l_orderkey % 1000 AS STRING) AS job_id,
  l_orderkey * 10 + l_linenumber AS ord,
  CASE l_orderkey % 5 WHEN 0 THEN 'red widget' WHEN 1 THEN 'small ring' ELSE 'magazin' END AS query_normalized,
  'https://www.gradina-unu.ro/produs/' || CAST(l_partkey AS STRING) AS url,
  CASE l_orderkey % 4 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN '50' WHEN 2 THEN '200' ELSE 'All Romania' END AS radius_option,
  l_orderkey % 2 = 0 AS include_unknown
FROM lineitem
"""

FIXTURES["fx_cached_results"] = """
SELECT sha1(q || '|' || url) AS cache_key, q AS query_normalized, 'gradina-unu.ro' AS domain, url AS source_url,
  name AS product_name, CAST(CAST(id % 5000 AS DECIMAL(12,2)) / 4 AS DECIMAL(12,2)) AS price, 'RON' AS currency,
  CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 40 AS STRING) || ' cm' END AS size_text,
  CASE id % 4 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN 'Cluj' WHEN 2 THEN 'Brasov' ELSE NULL END AS location_city,
  CASE id % 4 WHEN 3 THEN NULL ELSE 'Romania' END AS location_address,
  CAST(CASE id % 4 WHEN 0 THEN 44.4361 WHEN 1 THEN 46.7712 WHEN 2 THEN 45.6427 ELSE NULL END AS DOUBLE) AS location_lat,
  CAST(CASE id % 4 WHEN 0 THEN 26.1027 WHEN 1 THEN 23.6236 WHEN 2 THEN 25.5887 ELSE NULL END AS DOUBLE) AS location_lon,
  day0 AS created_at,
  CASE id % 3 WHEN 0 THEN TIMESTAMP '2024-01-02 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-02 12:00:00'
    ELSE TIMESTAMP '2024-01-01 23:59:59' END AS expires_at
FROM (SELECT p_partkey AS id, p_name AS name, TIMESTAMP '2024-01-01 00:00:00' AS day0,
        'https://www.gradina-unu.ro/produs/' || CAST(p_partkey AS STRING) AS url,
        CASE p_partkey % 3 WHEN 0 THEN 'red widget' WHEN 1 THEN 'small ring' ELSE 'magazin' END AS q FROM part) AS p
"""

FIXTURES["fx_cached_urls"] = """
SELECT CASE l_orderkey % 9 WHEN 0 THEN 'red widget' WHEN 1 THEN 'small ring' WHEN 2 THEN 'magazin'
    ELSE 'rar ' || CAST(l_orderkey % 2000 AS STRING) END AS query_normalized,
  'manual' AS provider, 'https://s' || CAST(l_suppkey AS STRING) || '.ro/produs/' || CAST(l_partkey AS STRING) AS url,
  CAST(l_linenumber % 7 AS DOUBLE) + 0.5 AS score,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  CASE l_partkey % 3 WHEN 0 THEN TIMESTAMP '2024-01-02 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-02 12:00:00'
    ELSE TIMESTAMP '2024-01-01 23:59:59' END AS expires_at
FROM lineitem
"""

FIXTURES["fx_domain_entries"] = """
SELECT CASE c_custkey % 6
    WHEN 0 THEN ' https://www.S' || CAST(c_custkey % 90 AS STRING) || '.ro , s1.ro/path/x'
    WHEN 1 THEN 'http://shop.test' || CAST(c_custkey % 70 AS STRING) || '.ro,'
    WHEN 2 THEN ' ,  ,www.Flori' || CAST(c_nationkey AS STRING) || '.RO/'
    WHEN 3 THEN 'https://http://x' || CAST(c_custkey % 11 AS STRING) || '.ro/a/b,www.www.y.ro'
    WHEN 4 THEN lower(c_mktsegment) || '.com' ELSE 'HTTPS://Z.ro,/,https://' END AS entries
FROM customer
"""

FIXTURES["fx_allowed"] = """
SELECT 's' || CAST(s_suppkey AS STRING) || '.ro' AS domain FROM supplier WHERE s_suppkey % 9 <> 4
"""

FIXTURES["fx_allowed_urls"] = """
SELECT 'magazin' || CAST(s_suppkey AS STRING) || '.ro' AS domain FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'flori' || CAST(s_suppkey AS STRING) || '.com.ro' AS domain FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'c' || CAST(s_suppkey AS STRING) || '.net' AS domain FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'z' || CAST(s_suppkey AS STRING) || '.co.uk' AS domain FROM supplier WHERE s_suppkey % 2 = 0
"""

FIXTURES["fx_page_domains"] = """
SELECT domain FROM (VALUES ('gradina-unu.ro'), ('doi.ro'), ('patru.ro'), ('example.com'), ('example.org')) AS d(domain)
"""

FIXTURES["fx_all_pages"] = """
SELECT 'p' || CAST(page_id AS STRING) AS page, url, html FROM pages
UNION ALL SELECT 'x' || CAST(page_id AS STRING) AS page, url, html FROM fx_product_pages
"""

FIXTURES["fx_site_rules"] = """
SELECT host, rule, name_pattern, price_pattern, location FROM (VALUES
  ('patru.ro', 'patru', '<h1>(.*?)</h1>', '(Pret [^<]*)', 'Romania'),
  ('doi.ro', 'never', '<h1>(.*?)</h1>', '(Pret [^<]*)', 'Cluj'))
  AS r(host, rule, name_pattern, price_pattern, location)
"""

FIXTURES["fx_results"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    || '-' || CAST(l_suppkey AS STRING) AS id,
  'job' || CAST(l_orderkey % 1000 AS STRING) AS job_id,
  CASE l_partkey % 4 WHEN 0 THEN 'Red Widget ' WHEN 1 THEN 'RING "mic", ' WHEN 2 THEN 'Bolt ' ELSE 'red-widget ' END
    || CAST(l_partkey AS STRING) AS product_name,
  CASE l_partkey % 4 WHEN 0 THEN 'red widget ' WHEN 1 THEN 'ring mic ' WHEN 2 THEN 'bolt ' ELSE 'red widget ' END
    || CAST(l_partkey AS STRING) AS normalized_name,
  CASE WHEN l_suppkey % 2 = 0 THEN 'D' ELSE 'e' END || CAST(l_suppkey AS STRING) || '.ro' AS domain,
  'https://d' || CAST(l_suppkey AS STRING) || '.ro/p/' || CAST(l_partkey AS STRING) AS source_url,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL
    ELSE CAST(CAST((l_partkey * 37 + l_orderkey) % 400000 AS DECIMAL(12,2)) / 4 AS DECIMAL(12,2)) END AS price,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE 'RON' END AS currency,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_partkey % 60 AS STRING) || CASE WHEN l_suppkey % 2 = 0 THEN ' cm' ELSE ' L' END END AS size_text,
  CASE l_suppkey % 4 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN 'Cluj' WHEN 2 THEN NULL ELSE 'Iasi' END AS location_city,
  CASE l_suppkey % 3 WHEN 0 THEN NULL ELSE 'Strada ' || CAST(l_suppkey AS STRING) END AS location_address,
  CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(l_partkey % 500 AS DOUBLE) / 4 END AS distance_km,
  l_suppkey % 5 = 0 AS location_unknown
FROM lineitem
"""

FIXTURES["fx_jobs"] = """
SELECT 'job' || CAST(c_custkey AS STRING) AS job_id,
  CASE c_custkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status
FROM customer
"""

FIXTURES["fx_items"] = """
SELECT 'job' || CAST(l_orderkey % 1000 AS STRING) AS job_id,
  l_linenumber % 5 <> 0 OR l_orderkey % 3 = 0 AS processed,
  (l_linenumber % 5 <> 0 OR l_orderkey % 3 = 0) AND l_partkey % 4 = 1 AS found,
  (l_linenumber % 5 <> 0 OR l_orderkey % 3 = 0) AND l_partkey % 11 = 0 AS error
FROM lineitem
"""

FIXTURES["fx_ranked"] = """
SELECT 'job' || CAST(l_orderkey % 1000 AS STRING) AS job_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey % 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank,
  'https://d' || CAST(l_suppkey AS STRING) || '.ro/p/' || CAST(l_partkey AS STRING) AS url,
  l_partkey % 3 = 0 AS is_cached
FROM lineitem
"""

FIXTURES["fx_incoming"] = """
SELECT l_orderkey AS batch, l_linenumber AS seq, l_suppkey,
  CASE l_partkey % 3 WHEN 0 THEN 'red widget' WHEN 1 THEN 'small ring' ELSE 'magazin' END AS query_normalized,
  'gradina-unu.ro' AS domain,
  'https://www.gradina-unu.ro/produs/' || CAST(l_partkey * 2 AS STRING) AS source_url,
  'nou ' || CAST(l_suppkey AS STRING) AS product_name,
  CAST(CAST(l_suppkey AS DECIMAL(12,2)) / 4 AS DECIMAL(12,2)) AS price, 'RON' AS currency,
  CAST(l_linenumber AS STRING) || ' kg' AS size_text, 'Iasi' AS location_city, 'Iasi, Romania' AS location_address,
  CAST(47.1585 AS DOUBLE) AS location_lat, CAST(27.6014 AS DOUBLE) AS location_lon
FROM lineitem
"""

FIXTURES["fx_link_pages"] = """
SELECT url, CASE WHEN n % 17 = 0 THEN '<h1>scurt</h1>' ELSE '<html><head><title>t</title></head><body><h1>Oferta '
    || CAST(n % 400 AS STRING) || '</h1><p>Pret ' || CAST(n % 90 AS STRING) || ',50 lei, livrare '
    || CASE n % 4 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN 'Cluj' WHEN 2 THEN 'Brasov' ELSE 'Roma' END
    || '</p>' || repeat('<p>text</p>', 60) || '</body></html>' END AS html, 'httpx' AS fetch_method
FROM (SELECT url, min(pos) AS n FROM fx_links GROUP BY url) AS u
"""

# What the start pages below link to: allowed targets of allowed domains.
FIXTURES["fx_seed_links"] = """
SELECT seed_domain, pos, url, text FROM (
  SELECT l.*, CAST(substr(seed_domain, 2, length(seed_domain) - 4) AS BIGINT) AS n FROM fx_links AS l
  WHERE seed_domain IN (SELECT domain FROM fx_allowed)) AS seeded
WHERE n % 11 <> 3 AND replace(split_part(url, '/', 3), 'www.', '') IN (SELECT domain FROM fx_allowed)
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING) || '.ro' AS seed_domain, CAST(0 AS BIGINT) AS pos,
  CASE WHEN s_suppkey % 5 IN (0, 2) THEN 'http' ELSE 'https' END || '://s' || CAST(s_suppkey AS STRING) || '.ro' AS url, '' AS text
FROM supplier WHERE s_suppkey % 11 = 3 AND s_suppkey % 9 <> 4
"""

# Start pages under either scheme or both; https without source, or an http page that must not be read.
FIXTURES["fx_start_pages"] = """
WITH filled AS (SELECT seed_domain, listagg('<p><a href="' || url || '">' || text || '</a></p>', '')
    WITHIN GROUP (ORDER BY pos) AS body FROM fx_links GROUP BY seed_domain),
known AS (SELECT 's' || CAST(s_suppkey AS STRING) || '.ro' AS domain, s_suppkey AS n FROM supplier),
written AS (SELECT domain, n, CASE WHEN n % 11 = 3 THEN '<p>gol</p>' ELSE '<html><body>' || coalesce(body, '') || '</body></html>' END AS html
  FROM known LEFT JOIN filled ON seed_domain = domain)
SELECT CASE n % 5 WHEN 0 THEN 'http://' || domain || '/' WHEN 2 THEN 'http://' || domain ELSE 'https://' || domain END AS url,
  html, 'httpx' AS fetch_method FROM written
UNION ALL SELECT 'https://' || domain AS url, CAST(NULL AS STRING) AS html, 'httpx' AS fetch_method FROM known WHERE n % 5 = 0
UNION ALL SELECT 'http://' || domain AS url, '<a href="https://s1.ro/produs/magazin">Red ring</a>' AS html, 'httpx' AS fetch_method
  FROM known WHERE n % 5 = 1
"""

FIXTURES["fx_search_cache"] = """
SELECT sha1(query_normalized || '|' || url) AS cache_key, query_normalized, substr(url, 9, 3) AS domain, url AS source_url,
  'Cache ' || CAST(n % 30 AS STRING) AS product_name, CAST(CAST(n % 70 AS DECIMAL(12,2)) / 2 AS DECIMAL(12,2)) AS price,
  'RON' AS currency, CAST(NULL AS STRING) AS size_text, 'Cluj' AS location_city, 'Cluj, Romania' AS location_address,
  CAST(46.7712 AS DOUBLE) AS location_lat, CAST(23.6236 AS DOUBLE) AS location_lon,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-01 12:00:00' ELSE TIMESTAMP '2024-01-02 12:00:00' END AS expires_at
FROM (SELECT query_normalized, url, sum(CAST(score * 2 AS BIGINT)) + length(url) AS n FROM fx_cached_urls
  GROUP BY query_normalized, url) AS u
"""


def _uses(sql: str) -> list[str]:
    return [name for name in FIXTURES if re.search(rf"\b{name}\b", sql)]


def with_fixtures(sql: str) -> str:
    """Put the definitions of the fixtures a statement uses in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text):
            if name not in needed:
                visit(FIXTURES[name])
                needed.append(name)

    visit(sql)
    parts = [f"{name} AS ({FIXTURES[name]})" for name in needed]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one by its fixture name."""
    if name in BASE_TABLES:
        return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return derive(spark, sf_dir, f"SELECT * FROM {name}")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a statement over the given and derived tables."""
    text = with_fixtures(sql)
    for name in BASE_TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


# The order in which rows of a given table arrive as a stream.
ARRIVAL = {"events": "ts", "pages": "page_id", "lineitem": "l_orderkey"}
STREAM_SHARES = 3


def stream_of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over one given table that arrives in several shares, one per micro-batch.

    Each share is written by many tasks to as many files, and a micro-batch takes that many.
    """
    text = with_fixtures(sql)
    (source,) = [name for name in BASE_TABLES if re.search(rf"\b{name}\b", text)]
    given = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    order = ARRIVAL.get(source, given.columns[0])
    shares = [(k + 1) / STREAM_SHARES for k in range(STREAM_SHARES - 1)]
    cuts = given.agg(F.percentile_approx(order, shares, 1000)).first()[0] or []
    part = sum((F.when(F.col(order) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    folder, files = working_folder(spark, f"arriving-{source}"), spark.sparkContext.defaultParallelism
    for k in range(STREAM_SHARES):
        given.filter(part == k).repartition(files).write.mode("append").parquet(folder)
    stream_table(spark, folder, given.schema, files_per_trigger=files).createOrReplaceTempView(source)
    return spark.sql(text)
