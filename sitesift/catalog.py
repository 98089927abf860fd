"""The query catalogue: every operator of the survey as a query over the given
tables, each next to its DuckDB oracle SQL (None = rows-only check).

A query is ``fn(spark, sf_dir) -> DataFrame``. Timestamps are returned as
``yyyy-MM-dd HH:mm:ss.SSSSSS`` strings and doubles rounded to 6 places, so
the Spark and DuckDB results compare exactly.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import table
from .functions import text as tx
from .functions import urls as U
from .functions.jsonpath import json_path_text
from .operators import analytics as A
from .operators import merge as D
from .operators import validate as V
from .operators.extract_html import extract_html, extract_links
from .operators.extract_json import extract_json
from .operators.extract_xml import extract_rss
from .operators.joins import join_small, materialize
from .operators.resolve import resolve_site
from .operators.route import extract_records, stamp
from .sources import master_log as L
from .sources.silver import merge_into_master, read_master, sample_frame
from .sources.site_schema import site_schema_df
from .plans import crawl as C
from .plans.silver_flow import to_silver
from .sources.raw import landed_to_raw
from .session import scratch_path
from .streaming import stateful as S
from .streaming.ingest import run_to_master, stream_routed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def ts_str(c) -> "F.Column":
    """A timestamp as fixed-width text (TZ free for TIMESTAMP_NTZ)."""
    return F.date_format(c if not isinstance(c, str) else F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


# ---------------------------------------------------------------- SQL pieces
WS = tx.WS


def s_netloc(u: str) -> str:
    return f"replace(split_part(regexp_extract({u}, '(?s)^(?:.*?//)*(.*)$', 1), '/', 1), 'www.', '')"


def s_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def s_norm(x: str) -> str:
    return f"coalesce(nullif({s_collapse(x)}, ''), 'N/A')"


def s_title(x: str) -> str:
    return f"coalesce(nullif(regexp_replace({s_collapse(x)}, '^[0-9]+(\\.[0-9]+)?\\s*', ''), ''), 'N/A')"


def s_decode(x: str) -> str:
    out = x
    for ent, ch in tx.ENTITIES:
        lit = ch.replace(chr(39), chr(39) * 2)
        out = f"replace({out}, '{ent}', '{lit}')"
        name = ent[1:-1]
        if name in tx.LEGACY_NO_SEMICOLON:
            out = f"regexp_replace({out}, '&{name}([^A-Za-z0-9;]|$)', '{lit}\\1', 'g')"
    return out


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def s_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


S_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)

# raw_records / page helpers in DuckDB (twins of fixtures.py)
S_BLANK = ("CASE {k} WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL WHEN 3 THEN ' none ' "
           "ELSE {v} END")
S_RAW_RECORDS = f"""
raw_records AS (
  SELECT doc_id, source, lang,
    {S_BLANK.format(k='doc_id % 7', v='text')} AS title,
    text,
    {S_BLANK.format(k='(doc_id // 7) % 7', v="'https://' || source || '.example.com/doc/' || doc_id")} AS link,
    {S_BLANK.format(k='(doc_id // 49) % 7', v='source')} AS company,
    'https://' || source || '.example.com/list?page=' || (doc_id % 5) || '#' || lang AS source_url,
    CASE WHEN doc_id % 5 = 0 THEN 'N/A'
         ELSE '€' || n_chars || '.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') END AS price,
    CASE WHEN doc_id % 11 = 0 THEN NULL
         ELSE TIMESTAMP '2024-03-01 00:00:00' + to_hours(CAST(doc_id % 97 AS BIGINT)) END AS scraped_at
  FROM documents)"""

S_PRICE_TEXT = """
price_text AS (
  SELECT p_partkey, p_brand,
    CASE p_partkey % 11 WHEN 0 THEN 'N/A' WHEN 1 THEN '1.2.3' WHEN 2 THEN '' WHEN 3 THEN '-5'
      ELSE (CASE WHEN p_partkey % 2 = 0 THEN '£' ELSE '$' END) ||
        (CASE WHEN amt >= 1000 THEN CAST(CAST(floor(amt / 1000) AS BIGINT) AS VARCHAR) || ',' ||
                lpad(CAST(CAST(amt - floor(amt / 1000) * 1000 AS DECIMAL(6,2)) AS VARCHAR), 6, '0')
              ELSE CAST(amt AS VARCHAR) END) END AS price_text
  FROM (SELECT *, CAST(p_retailprice AS DECIMAL(12,2)) * p_size AS amt FROM part))"""

S_FRONTIER = """
frontier AS (
  SELECT page_id, page_no, page_url, cache_key, substr(md5(cache_key), 1, 16) AS url_hash
  FROM (SELECT page_id, page_no, page_url, split_part(page_url, '?', 1) AS cache_key
        FROM (SELECT page_id, page_no,
                CASE WHEN page_no <= 1 THEN url
                     ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/page/' || page_no || '/'
                END AS page_url
              FROM pages, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS page_no))))"""

S_GRID = """
grid AS (
  SELECT s.site, d.page, coalesce(b.items, 0) AS items
  FROM (SELECT DISTINCT user_id AS site FROM events) s
  CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS page) d
  LEFT JOIN (SELECT user_id AS site, CAST(dayofmonth(ts) AS INTEGER) AS page, count(*) AS items
             FROM events WHERE event_type = 'purchase' GROUP BY ALL) b
    ON b.site = s.site AND b.page = d.page)"""

S_HIST_BATCH = f"""
hist AS (SELECT event_id, ts, user_id, event_type, value, props FROM events
         WHERE ts < TIMESTAMP '{fx.SPLIT_HISTORY_BEFORE}'),
batch AS (SELECT event_id, ts, user_id, event_type, value FROM events
          WHERE ts >= TIMESTAMP '{fx.SPLIT_BATCH_FROM}')"""


# ====================================================================== URLs
@query("url_netloc", f"SELECT page_id, url, {s_netloc('url')} AS netloc FROM pages")
def q_url_netloc(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", U.netloc("url").alias("netloc"))


@query("url_hash", """
SELECT page_id, split_part(url, '?', 1) AS cache_key,
       substr(md5(split_part(url, '?', 1)), 1, 16) AS url_hash FROM pages""")
def q_url_hash(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", U.cache_key("url").alias("cache_key"),
                    U.url_hash(U.cache_key("url")).alias("url_hash"))


@query("url_strip_query", r"""
SELECT page_id, regexp_replace(url, '^([^#?]*)\?[^#]*', '\1') AS silver_url FROM pages""")
def q_url_strip_query(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", U.strip_query("url", True).alias("silver_url"))


PATTERN_ALL = "{base_clean}/page/{i}/?q={query}&from={base_url}"


@query("page_urls_pattern", r"""
SELECT page_id, page_no,
  CASE WHEN page_no <= 1 THEN url ELSE
    regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/page/' || page_no || '/?q=' ||
    coalesce(nullif(url_decode(regexp_extract(url, '[?&]k=([^&#]*)', 1)), ''),
             nullif(url_decode(regexp_extract(url, '[?&]q=([^&#]*)', 1)), ''), '') ||
    '&from=' || regexp_replace(url, '/+$', '') END AS page_url
FROM pages, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS page_no)""")
def q_page_urls_pattern(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return C.page_frontier(p, 3, pattern=PATTERN_ALL).select("page_id", "page_no", "page_url")


@query("page_urls_param", r"""
SELECT page_id, page_no,
  CASE WHEN page_no <= 1 THEN url ELSE
    regexp_replace(url, '[?#].*$', '') || '?' ||
    CASE WHEN regexp_matches(q, '(^|&)page=') THEN regexp_replace(q, '(^|&)page=[^&]*', '\1page=' || page_no)
         WHEN q = '' THEN 'page=' || page_no
         ELSE q || '&page=' || page_no END || frag END AS page_url
FROM (SELECT page_id, url, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag
      FROM pages), (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS page_no)""")
def q_page_urls_param(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return C.page_frontier(p, 3, pattern=None, param="page").select("page_id", "page_no", "page_url")


@query("storage_label", f"""
SELECT page_id, netloc, regexp_replace(netloc, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') AS label,
       split_part(regexp_replace(netloc, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), '.', 1) AS prefix
FROM (SELECT page_id, {s_netloc('url')} AS netloc FROM pages)""")
def q_storage_label(spark, sf):
    p = table(spark, sf, "pages").select("page_id", U.netloc("url").alias("netloc"))
    return p.select("page_id", "netloc", U.storage_label("netloc").alias("label"),
                    U.storage_prefix("netloc").alias("prefix"))


def _s_resolve() -> str:
    keys = list(fx.RESOLVE_SITES)
    exact = " ".join(f"WHEN netloc = '{k}' THEN '{k}'" for k in keys)
    sub = " ".join(f"WHEN contains(url, '{k}') THEN '{k}'" for k in keys)
    return f"""
SELECT page_id, url, netloc, CASE {exact} {sub} ELSE NULL END AS domain
FROM (SELECT page_id, url, {s_netloc('url')} AS netloc FROM pages)"""


@query("resolve_site", _s_resolve())
def q_resolve_site(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return resolve_site(p, fx.sites(fx.RESOLVE_SITES)).select(
        "page_id", "url", U.netloc("url").alias("netloc"), "domain")


@query("resolve_site_join", _s_resolve())
def q_resolve_site_join(spark, sf):
    """U2, the join of whole keys (forced here)."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return resolve_site(p, fx.sites(fx.RESOLVE_SITES), id_col="page_id", mode="join").select(
        "page_id", "url", U.netloc("url").alias("netloc"), "domain")


@query("resolve_site_automaton", _s_resolve())
def q_resolve_site_automaton(spark, sf):
    """U2, the gram index used for large schema lists (forced here)."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return resolve_site(p, fx.sites(fx.RESOLVE_SITES), mode="grams").select(
        "page_id", "url", U.netloc("url").alias("netloc"), "domain")


#: Rules in every spelling: a text, texts, a mapping, nothing, and the normal form.
RULE_SITES = {
    "example.net": {"strategy": "index", "container": "article, main", "fields": {
        "title": "h1", "link": {"selector": "a[href]", "attribute": "href"}, "text": ["p", "div.body, span"]}},
    "thther.example.org": {"fields": {"whole": None, "title": {"selector": ["h1 , h2", "h3"]}}},
    "blog.": {"strategy": "json", "container": "items", "start_page": 0, "pagination_param": "p",
              "fields": [{"name": "t", "selectors": ["a.b"], "attribute": None}]},
}


@query("schema_rules", f"""
WITH rules(domain, strategy, container, start_page, pagination_param, field, place, selectors, attribute) AS (VALUES
  ('example.net', 'index', 'article, main', 1, 'page', 'title', 0, 'h1', NULL),
  ('example.net', 'index', 'article, main', 1, 'page', 'link', 1, 'a[href]', 'href'),
  ('example.net', 'index', 'article, main', 1, 'page', 'text', 2, 'p|div.body|span', NULL),
  ('thther.example.org', 'detail', NULL, 1, 'page', 'whole', 0, '', NULL),
  ('thther.example.org', 'detail', NULL, 1, 'page', 'title', 1, 'h1|h2|h3', NULL),
  ('blog.', 'json', 'items', 0, 'p', 't', 0, 'a.b', NULL)),
hosts AS (SELECT page_id, url, {s_netloc('url')} AS netloc FROM pages)
SELECT page_id, r.* FROM (
  SELECT page_id, CASE WHEN netloc IN ('example.net', 'thther.example.org', 'blog.') THEN netloc WHEN contains(url, 'example.net') THEN 'example.net'
    WHEN contains(url, 'thther.example.org') THEN 'thther.example.org' WHEN contains(url, 'blog.') THEN 'blog.' END AS d FROM hosts) p
JOIN rules r ON r.domain = p.d""")
def q_schema_rules(spark, sf):
    """S6 + X6: the site schema as a table; the normalised field rules that
    hold for every page, a row each."""
    configs = fx.sites(RULE_SITES)
    p = resolve_site(table(spark, sf, "pages").select("page_id", "url"), configs).select("page_id", "domain")
    rules = site_schema_df(spark, configs)      # a row per site: configuration
    return join_small(p, rules, "domain").select(
        "page_id", "domain", "strategy", "container", "start_page", "pagination_param", F.posexplode("fields").alias("place", "rule")).select(
        "page_id", "domain", "strategy", "container", "start_page", "pagination_param", F.col("rule.name").alias("field"), "place",
        F.concat_ws("|", "rule.selectors").alias("selectors"), F.col("rule.attribute").alias("attribute"))


# ================================================================ extraction
@query("json_field", """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'N/A') AS k,
       'N/A' AS k_index, 'N/A' AS missing FROM events""")
def q_json_field(spark, sf):
    e = table(spark, sf, "events")
    v = F.call_function("try_parse_json", F.col("props"))
    return e.select("event_id", json_path_text(v, "k").alias("k"),
                    json_path_text(v, "k.0").alias("k_index"),
                    json_path_text(v, "x").alias("missing"))


@query("json_records", """
SELECT o_orderkey AS page_id, 'api.example.com' AS domain,
  'https://api.example.com/orders/' || o_orderkey || '?block=' || (l_linenumber // 8) AS source_url,
  CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE rn - 1 END AS INTEGER) AS ordinal,
  CAST(l_linenumber AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS part,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty, l_returnflag AS flag,
  l_linestatus AS status_tag, l_linestatus AS last_tag, 'N/A' AS missing
FROM (SELECT o_orderkey, l.*, row_number() OVER (PARTITION BY o_orderkey, l_linenumber // 8 ORDER BY l_linenumber, l_partkey,
        CAST(l_quantity AS INTEGER), l_returnflag, l_linestatus) AS rn
      FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey)
WHERE o_orderkey % 10 NOT IN (1, 2) AND (o_orderkey % 10 <> 0 OR rn = 1)""")
def q_json_records(spark, sf):
    pages = fx.order_json(spark, sf).withColumn("domain", F.lit("api.example.com"))
    return extract_json(pages, fx.sites(fx.ORDER_SITE))


@query("rss_records", f"""
SELECT doc_id // 8 AS page_id, 'feeds.example.com' AS domain,
  'https://feeds.example.com/feed/' || (doc_id // 8) AS source_url,
  CAST(row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS INTEGER) AS ordinal,
  {s_title("CAST(doc_id AS VARCHAR) || ' ' || source")} AS title,
  CASE WHEN (doc_id // 8) % 11 = 5 THEN 'N/A'
       ELSE 'https://feeds.example.com/' || source || '/' || doc_id END AS link,
  {s_norm('text')} AS description
FROM documents""")
def q_rss_records(spark, sf):
    feeds = fx.feed_xml(spark, sf).withColumn("domain", F.lit("feeds.example.com"))
    return extract_rss(feeds, fx.sites(fx.FEED_SITE)[0])


def _resolved_pages(spark, sf, site):
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    return resolve_site(p, fx.sites(site))


@query("html_h1", f"""
SELECT page_id, 'example' AS domain, url AS source_url, 0 AS ordinal,
  {s_title(s_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS title FROM pages""")
def q_html_h1(spark, sf):
    return extract_html(_resolved_pages(spark, sf, fx.ARTICLE_SITE), fx.sites(fx.ARTICLE_SITE))


S_HTML_RECORDS = f"""
SELECT page_id, 'example' AS domain, url AS source_url, 0 AS ordinal,
  {s_title(s_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS title,
  {s_norm(s_decode("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))} AS ad,
  {s_norm(s_decode("regexp_extract(html, '(?s)<nav>.*?<a href=\"([^\"]*)\"', 1)"))} AS first_link,
  {s_norm(s_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading,
  'N/A' AS price,
  {s_norm(s_decode("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"))} AS footer
FROM pages"""


@query("html_records", S_HTML_RECORDS)
def q_html_records(spark, sf):
    return extract_html(_resolved_pages(spark, sf, fx.PAGE_SITE), fx.sites(fx.PAGE_SITE), mode="static")


@query("html_dom_records", f"""
SELECT page_id, 'example' AS domain, url AS source_url, 0 AS ordinal, 'N/A' AS title,
  {s_norm(s_decode("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))} AS body_text
FROM pages
UNION ALL
SELECT page_id, 'example', url, 1,
  {s_title(s_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))},
  {s_norm("regexp_replace(" + s_decode("regexp_extract(html, '(?s)<article>(.*)</article>', 1)") + ", '<[^>]*>', '', 'g')")}
FROM pages""")
def q_html_dom_records(spark, sf):
    return extract_html(_resolved_pages(spark, sf, fx.DOM_SITE), fx.sites(fx.DOM_SITE), mode="dom")


@query("html_links", """
SELECT DISTINCT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)""")
def q_html_links(spark, sf):
    return extract_links(table(spark, sf, "pages"), container="body")


@query("page_title", f"""
SELECT page_id, {s_norm(s_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title
FROM pages""")
def q_page_title(spark, sf):
    p = table(spark, sf, "pages")
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return p.select("page_id", tx.normalize_text(tx.decode_entities(raw)).alias("title"))


@query("title_clean", f"SELECT doc_id, {s_title('text')} AS title FROM documents")
def q_title_clean(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_field("title", "text").alias("title"))


@query("raw_layer", f"""
SELECT url, {s_netloc('url')} AS netloc,
  CAST(CAST(fetched AS DATE) AS VARCHAR) AS fetch_date, {s_ts('fetched')} AS fetched_at,
  substr(md5(split_part(url, '?', 1)), 1, 16) AS url_hash,
  CASE WHEN ltrim(html) LIKE '{{%' OR ltrim(html) LIKE '[%' THEN 'json'
       WHEN regexp_matches(lower(html), '<(rss|feed)[\\s>]') THEN 'rss' ELSE 'html' END AS format,
  length(html) AS n_chars
FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS fetched FROM pages)""")
def q_raw_layer(spark, sf):
    p = table(spark, sf, "pages")
    fetched = F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    raw = landed_to_raw(p, fetched)
    return raw.select("url", "netloc", F.col("fetch_date").cast("string").alias("fetch_date"),
                      ts_str("fetched_at").alias("fetched_at"), "url_hash", "format",
                      F.length("body").cast("long").alias("n_chars"))


# ================================================================ validation
@query("soft_validate", f"""
WITH {S_RAW_RECORDS.strip()}
SELECT doc_id, CASE WHEN bad THEN 'N/A - Pending Review' ELSE title END AS title, link, company
FROM (SELECT *, (title IS NULL OR {s_strip('title')} IN ('', 'N/A')) AS bad,
             (coalesce(length(link), 0) > 0 OR coalesce(length(company), 0) > 0) AS fb
      FROM raw_records)
WHERE NOT bad OR fb""")
def q_soft_validate(spark, sf):
    r = fx.raw_records(spark, sf)
    return V.soft_validate(r, "title").select("doc_id", "title", "link", "company")


def _s_required(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL AND upper({s_strip(c)}) NOT IN ('N/A', 'NONE', '')" for c in cols)


@query("required_keys", f"""
WITH {S_RAW_RECORDS.strip()}
SELECT doc_id FROM raw_records WHERE {_s_required(['title', 'link', 'company'])}""")
def q_required_keys(spark, sf):
    return V.required_keys(fx.raw_records(spark, sf), ["title", "link", "company"]).select("doc_id")


@query("validation_metrics", f"""
WITH {S_RAW_RECORDS.strip()},
flags AS (SELECT source, (title IS NULL OR {s_strip('title')} IN ('', 'N/A')) AS bad,
            (coalesce(length(link), 0) > 0 OR coalesce(length(company), 0) > 0) AS fb,
            ({_s_required(['title', 'link', 'company'])}) AS req FROM raw_records)
SELECT source, count(*) AS n_in, count(*) FILTER (WHERE bad AND NOT fb) AS n_malformed,
  count(*) FILTER (WHERE bad AND fb) AS n_pending, count(*) FILTER (WHERE NOT bad OR fb) AS n_retained,
  count(*) FILTER (WHERE NOT req) AS n_key_failed
FROM flags GROUP BY source""")
def q_validation_metrics(spark, sf):
    r = fx.raw_records(spark, sf)
    return V.validation_metrics(r, "title", ["title", "link", "company"], ["source"])


# ===================================================================== money
S_MONEY = r"TRY_CAST(trim(regexp_replace(price_text, '[^0-9.]', '', 'g')) AS DOUBLE)"


@query("money_silver", f"""
WITH {S_PRICE_TEXT.strip()}
SELECT p_partkey, price_text, coalesce({S_MONEY}, 0.0) AS price FROM price_text""")
def q_money_silver(spark, sf):
    p = fx.price_text(spark, sf)
    return p.select("p_partkey", "price_text", tx.money_silver("price_text").alias("price"))


@query("money_report", f"""
WITH {S_PRICE_TEXT.strip()}
SELECT p_partkey, {S_MONEY} AS price FROM price_text""")
def q_money_report(spark, sf):
    p = fx.price_text(spark, sf)
    return p.select("p_partkey", tx.money_report("price_text").alias("price"))


# ============================================================== dedup/merge
@query("dedup_first", f"""
WITH {S_RAW_RECORDS.strip()}
SELECT doc_id, title, company, link, source_url FROM (
  SELECT *, row_number() OVER (PARTITION BY title, company, link, source_url ORDER BY doc_id) AS rn
  FROM raw_records) WHERE rn = 1""")
def q_dedup_first(spark, sf):
    r = fx.raw_records(spark, sf).select("doc_id", "title", "company", "link", "source_url")
    return D.dedup_first(r, ["doc_id"])


@query("dedup_newest", f"""
SELECT user_id, event_type, event_id, {s_ts('ts')} AS ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def q_dedup_newest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    out = D.dedup_newest(e, ["user_id", "event_type"], "ts", ["event_id"])
    return out.withColumn("ts", ts_str("ts"))


@query("merge_history", f"""
WITH {S_HIST_BATCH.strip()}
SELECT user_id, event_type, event_id, {s_ts('ts')} AS ts, value, props,
  '{fx.RUN_TS}' AS silver_processed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                               ORDER BY ts DESC NULLS LAST, b DESC, event_id DESC) AS rn
  FROM (SELECT *, 0 AS b FROM hist UNION ALL BY NAME SELECT *, 1 AS b FROM batch)) WHERE rn = 1""")
def q_merge_history(spark, sf):
    hist, batch = fx.events_split(spark, sf)
    batch = D.silver_stamp(batch, fx.RUN_TS)
    hist = D.silver_stamp(hist, fx.RUN_TS)
    out = D.merge_history(hist, batch, ["user_id", "event_type"], "ts", ["event_id"])
    return out.select("user_id", "event_type", "event_id", ts_str("ts").alias("ts"), "value", "props",
                      "silver_processed_at")


S_NEWEST = """
SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, b DESC, event_id DESC) AS rn FROM ({})) WHERE rn = 1"""
S_BOTH = "SELECT *, 0 AS b FROM hist UNION ALL BY NAME SELECT *, 1 AS b FROM batch"
EVENT_KEYS = ["user_id", "event_type"]


def _event_log(spark, sf) -> tuple[str, dict]:
    """A logged master of events: the history, then the batch as deltas."""
    root = scratch_path(spark, "master_log")
    how = {"keys": EVENT_KEYS, "ts_col": "ts", "tiebreak": ["event_id"]}
    for rows in fx.events_split(spark, sf):
        L.merge(rows, root, domain_col="event_type", buckets=4, **how)
    return root, how


@query("master_snapshot", f"""
WITH {S_HIST_BATCH.strip()}
SELECT 1 AS version, * FROM ({S_NEWEST.format("SELECT *, 0 AS b FROM hist")})
UNION ALL SELECT 2, * FROM ({S_NEWEST.format(S_BOTH)})""")
def q_master_snapshot(spark, sf):
    """S3: both snapshots of a master after two merges; the first stays
    readable as it was."""
    root, how = _event_log(spark, sf)
    cols = [*EVENT_KEYS, "event_id", ts_str("ts").alias("ts"), "value", "props"]
    each = [L.read(spark, root, version=v, **how).select(F.lit(v).alias("version"), *cols) for v in (1, 2)]
    return each[0].unionByName(each[1])


@query("delta_merge", f"""
WITH {S_HIST_BATCH.strip()}, now AS ({S_NEWEST.format(S_BOTH)})
SELECT 'deltas' AS state, * FROM now UNION ALL SELECT 'compacted', * FROM now""")
def q_delta_merge(spark, sf):
    """S3 + D4, merge-on-read: the merged master read from base and deltas,
    and again after compaction."""
    root, how = _event_log(spark, sf)
    L.compact(spark, root, domain_col="event_type", max_deltas=0, **how)
    cols = [*EVENT_KEYS, "event_id", ts_str("ts").alias("ts"), "value", "props"]
    each = [L.read(spark, root, version=v, **how).select(F.lit(n).alias("state"), *cols) for v, n in ((2, "deltas"), (3, "compacted"))]
    return each[0].unionByName(each[1])


@query("bad_history", f"""
WITH {S_HIST_BATCH.strip()}, now AS ({S_NEWEST.format(S_BOTH)}), old AS ({S_NEWEST.format("SELECT *, 0 AS b FROM hist")})
SELECT 'read' AS state, 2 AS problems, * FROM now WHERE event_type <> 'purchase'
UNION ALL SELECT 'read', 2, * FROM old WHERE event_type = 'purchase'
UNION ALL SELECT 'merged again', 0, * FROM now""")
def q_bad_history(spark, sf):
    """A master whose newest part of purchases is damaged and that has a
    part which was never committed. The version before is read and both are
    reported; merging the batch again mends it."""
    root = scratch_path(spark, "bad_master")
    hist, batch = fx.events_split(spark, sf)
    how = {"keys": EVENT_KEYS, "ts_col": "ts", "tiebreak": ["event_id"], "domain_col": "event_type"}
    for rows in (hist, batch):
        merge_into_master(spark, root, rows, **how)
    fx.damage_part(spark, root, "purchase", 2)
    fx.start_part(spark, root, "click", 3)
    cols = [*EVENT_KEYS, "event_id", ts_str("ts").alias("ts"), "value", "props"]

    def now(state: str) -> DataFrame:
        rows, problems = read_master(spark, root)
        return rows.select(F.lit(state).alias("state"), F.lit(len(problems)).alias("problems"), *cols)

    read = now("read")
    merge_into_master(spark, root, batch, **how)
    return read.unionByName(now("merged again"))


@query("snapshot_merge", f"""
WITH {S_HIST_BATCH.strip()}
SELECT user_id, event_type, event_id, CASE WHEN ts IS NULL THEN NULL ELSE {s_ts('ts')} END AS ts,
  value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                               ORDER BY ts DESC NULLS LAST, b DESC, event_id DESC) AS rn
  FROM (SELECT event_id, user_id, event_type, value, props, NULL::TIMESTAMP AS ts, 0 AS b FROM hist
        UNION ALL BY NAME SELECT *, 1 AS b FROM batch)) WHERE rn = 1""")
def q_snapshot_merge(spark, sf):
    hist, batch = fx.events_split(spark, sf)
    snapshot = hist.drop("ts")  # the day's sample has no timestamps
    out = D.snapshot_merge(snapshot, batch, ["user_id", "event_type"], strip=False, ts_col="ts",
                           tiebreak=["event_id"])
    return out.select("user_id", "event_type", "event_id", ts_str("ts").alias("ts"), "value", "props")


@query("silver_records", f"""
WITH {S_RAW_RECORDS.strip()},
clean AS (
  SELECT doc_id, 'example.com' AS domain, title, company, link,
    regexp_replace(source_url, '^([^#?]*)\\?[^#]*', '\\1') AS source_url,
    coalesce(TRY_CAST(trim(regexp_replace(price, '[^0-9.]', '', 'g')) AS DOUBLE), 0.0) AS price,
    scraped_at
  FROM raw_records WHERE {_s_required(['title', 'company'])})
SELECT doc_id, domain, title, company, link, source_url, price,
  CASE WHEN scraped_at IS NULL THEN NULL ELSE {s_ts('scraped_at')} END AS scraped_at,
  '{fx.RUN_TS}' AS silver_processed_at
FROM (SELECT *, row_number() OVER (PARTITION BY title, company
                                   ORDER BY scraped_at DESC NULLS LAST, doc_id DESC) AS rn FROM clean)
WHERE rn = 1""")
def q_silver_records(spark, sf):
    r = fx.raw_records(spark, sf).select("doc_id", "title", "company", "link", "source_url", "price",
                                         "scraped_at")
    out = to_silver(r, fx.sites(fx.SILVER_SITE), fx.RUN_TS, ts_col="scraped_at", tiebreak=["doc_id"])
    return out.select("doc_id", "domain", "title", "company", "link", "source_url", "price",
                      ts_str("scraped_at").alias("scraped_at"), "silver_processed_at")


# ==================================================================== crawl
@query("limit_per_site", f"""
SELECT page_id, site FROM (
  SELECT page_id, {s_netloc('url')} AS site,
         row_number() OVER (PARTITION BY {s_netloc('url')} ORDER BY page_id) AS rn FROM pages)
WHERE rn <= 2""")
def q_limit_per_site(spark, sf):
    p = table(spark, sf, "pages").select("page_id", U.netloc("url").alias("site"))
    return C.limit_per_site(p, "site", ["page_id"], 2)


@query("url_cap", f"""
WITH {S_FRONTIER.strip()}
SELECT page_id, page_no, page_url FROM frontier ORDER BY page_id, page_no LIMIT 160""")
def q_url_cap(spark, sf):
    return C.url_cap(fx.frontier(spark, sf).select("page_id", "page_no", "page_url"),
                     ["page_id", "page_no"])


@query("crawl_halt", f"""
WITH {S_GRID.strip()},
isl AS (SELECT *, sum(CASE WHEN items > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY page) AS island
        FROM grid),
streak AS (SELECT *, sum(CASE WHEN items = 0 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY site, island ORDER BY page) AS run FROM isl),
stops AS (SELECT site, min(page) AS stop_page FROM streak WHERE run >= 5 GROUP BY site)
SELECT g.site, g.page, g.items, CAST(s.stop_page AS DOUBLE) AS stop_page FROM grid g LEFT JOIN stops s USING (site)
WHERE s.stop_page IS NULL OR g.page <= s.stop_page""")
def q_crawl_halt(spark, sf):
    # stop_page is NULL for sites that never halt; DOUBLE keeps the nullable
    # number the same type on both sides of the comparison.
    return C.crawl_halt(fx.page_grid(spark, sf), "site", "page", "items").select(
        "site", "page", "items", F.col("stop_page").cast("double").alias("stop_page"))


@query("cache_fresh", f"""
WITH {S_FRONTIER.strip()},
cache AS (
  SELECT f.url_hash, e.ts AS fetched_at FROM
    (SELECT url_hash, unnest([page_id * 3 + page_no, page_id * 3 + page_no + 1]) AS event_id FROM frontier) f
    JOIN events e USING (event_id)),
cutoff AS (SELECT max(fetched_at) AS t FROM cache),
latest AS (SELECT url_hash, max(fetched_at) AS fetched_at FROM cache GROUP BY url_hash)
SELECT url_hash, {s_ts('fetched_at')} AS fetched_at,
  round((epoch_us(t) - epoch_us(fetched_at)) / 3.6e9, 6) AS age_hours
FROM latest, cutoff WHERE (epoch_us(t) - epoch_us(fetched_at)) / 3.6e9 < 4""")
def q_cache_fresh(spark, sf):
    cache = fx.cache_log(spark, sf)
    as_of = cache.agg(F.max("fetched_at")).scalar()
    fresh = C.fresh_cache(cache, as_of, 4)
    return fresh.select("url_hash", ts_str("fetched_at").alias("fetched_at"),
                        F.round("age_hours", 6).alias("age_hours"))


@query("to_fetch", f"""
WITH {S_FRONTIER.strip()},
cache AS (
  SELECT f.url_hash, e.ts AS fetched_at FROM
    (SELECT url_hash, unnest([page_id * 3 + page_no, page_id * 3 + page_no + 1]) AS event_id FROM frontier) f
    JOIN events e USING (event_id)),
cutoff AS (SELECT max(fetched_at) AS t FROM cache),
fresh AS (SELECT url_hash FROM (SELECT url_hash, max(fetched_at) AS fetched_at FROM cache GROUP BY url_hash), cutoff
          WHERE (epoch_us(t) - epoch_us(fetched_at)) / 3.6e9 < 4)
SELECT page_id, page_no, url_hash FROM frontier
WHERE url_hash NOT IN (SELECT url_hash FROM fresh) OR url_hash NOT IN (SELECT url_hash FROM frontier WHERE page_id % 5 <> 3)""")
def q_to_fetch(spark, sf):
    """What has no fresh copy, and what has one without a valid record
    (every fifth cached page has lost its article)."""
    cache = fx.cache_log(spark, sf)
    as_of = cache.agg(F.max("fetched_at")).scalar()
    fresh = C.fresh_cache(cache, as_of, 4)
    lost = F.regexp_replace("html", "</?article", "<section")
    cached = _resolved_pages(spark, sf, fx.ARTICLE_SITE).withColumn("html", F.when(F.col("page_id") % 5 == 3, lost).otherwise(F.col("html")))
    records = V.soft_validate_sites(extract_html(cached, fx.sites(fx.ARTICLE_SITE)), fx.sites(fx.ARTICLE_SITE))
    frontier = fx.frontier(spark, sf)
    valid = frontier.join(records.select("page_id").distinct(), "page_id", "left_semi").select("url_hash").distinct()
    return C.to_fetch(frontier, fresh, valid=valid).select("page_id", "page_no", "url_hash")


# ================================================================ analytics
def _s_stats(v: str, scale: int = 2) -> str:
    mean = f"CAST(sum(CAST({v} AS DECIMAL(38,{scale}))) AS DOUBLE) / count({v})"
    return (f"count(*) AS n_records, count({v}) AS n_valid, round(min({v}), 6) AS min_value, "
            f"round(max({v}), 6) AS max_value, round({mean}, 6) AS mean_value, "
            f"round(quantile_cont({v}, 0.5), 6) AS median_value, round(quantile_cont({v}, 0.9), 6) AS p90_value, "
            f"round(stddev_samp({v}), 6) AS std_value")


@query("price_distribution", f"""
WITH {S_PRICE_TEXT.strip()}
SELECT p_brand, {_s_stats('v')} FROM (SELECT p_brand, {S_MONEY} AS v FROM price_text) GROUP BY p_brand""")
def q_price_distribution(spark, sf):
    p = fx.price_text(spark, sf).withColumn("v", tx.money_report("price_text"))
    return A.price_stats(p, "v", ["p_brand"], decimal_scale=2)


@query("lineitem_price_distribution", f"""
SELECT l_returnflag, l_linestatus, {_s_stats('l_extendedprice')} FROM lineitem GROUP BY ALL""")
def q_lineitem_price_distribution(spark, sf):
    li = table(spark, sf, "lineitem")
    return A.price_stats(li, "l_extendedprice", ["l_returnflag", "l_linestatus"], decimal_scale=2)


S_WORDS = f"""
words AS (SELECT lang, doc_id, w AS word FROM
  (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents)
  WHERE w NOT IN ({S_STOP})),
counts AS (SELECT lang, word, count(*) AS n FROM words GROUP BY lang, word)"""


@query("keywords_top", f"""
WITH {S_WORDS.strip()}
SELECT lang, rank, word, n FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word ASC) AS INTEGER) AS rank FROM counts)
WHERE rank <= 5""")
def q_keywords_top(spark, sf):
    d = table(spark, sf, "documents")
    return A.top_keywords(A.keyword_counts(d, "text", ["lang"]), ["lang"], 5)


@query("keywords_low", f"""
WITH {S_WORDS.strip()},
st AS (SELECT lang, count(*) AS nd, max(n) AS maxn FROM counts GROUP BY lang)
SELECT lang, rank, word, n FROM (
  SELECT c.*, CAST(row_number() OVER (PARTITION BY c.lang ORDER BY n ASC, word DESC) AS INTEGER) AS rank
  FROM counts c JOIN st USING (lang) WHERE nd > 3 AND (n > 1 OR maxn = 1))
WHERE rank <= 3""")
def q_keywords_low(spark, sf):
    d = table(spark, sf, "documents")
    return A.low_keywords(A.keyword_counts(d, "text", ["lang"]), ["lang"], 3)


S_PAIRS = f"""{S_WORDS.strip()},
nd AS (SELECT count(*) AS n FROM documents),
dfreq AS (SELECT word, count(DISTINCT doc_id) AS df FROM words GROUP BY word HAVING count(DISTINCT doc_id) >= 5),
dw AS (SELECT DISTINCT doc_id, word FROM words WHERE word IN (SELECT word FROM dfreq)),
pairs AS (SELECT a.word AS word_a, b.word AS word_b, count(*) AS support
          FROM dw a JOIN dw b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL HAVING count(*) >= 5),
scored AS (SELECT word_a, word_b, support, round(support * nd.n / (fa.df * fb.df), 6) AS lift
           FROM pairs JOIN dfreq fa ON fa.word = word_a JOIN dfreq fb ON fb.word = word_b, nd)"""


@query("keyword_pairs", f"WITH {S_PAIRS} SELECT word_a, word_b, support, lift FROM scored")
def q_keyword_pairs(spark, sf):
    d = table(spark, sf, "documents")
    return A.keyword_pairs(d, "text", "doc_id", 5)


@query("entity_concentration", """
WITH per AS (SELECT o_orderpriority, c_name, count(*) AS n
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
agg AS (SELECT o_orderpriority, count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_records, sum(n * n) AS ss,
               max(n) AS top_n, arg_min(c_name, (-n, c_name)) AS top_entity FROM per GROUP BY o_orderpriority),
top3 AS (SELECT o_orderpriority, sum(n) AS t3 FROM (
           SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, c_name) AS r FROM per)
         WHERE r <= 3 GROUP BY o_orderpriority)
SELECT o_orderpriority, n_entities, n_records, top_entity, round(top_n / n_records, 6) AS top_share,
       round(t3 / n_records, 6) AS top3_share,
       round(ss / (n_records * n_records), 6) AS hhi FROM agg JOIN top3 USING (o_orderpriority)""")
def q_entity_concentration(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return A.concentration(j, "c_name", ["o_orderpriority"])


@query("outliers_3sigma", """
WITH st AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY event_type)
SELECT event_id, event_type, value, round(m, 6) AS group_mean, round(sd, 6) AS group_std,
       round((value - m) / sd, 6) AS z
FROM events JOIN st USING (event_type) WHERE sd > 0 AND abs(value - m) > 3 * sd""")
def q_outliers_3sigma(spark, sf):
    e = table(spark, sf, "events")
    return A.outliers(e, "value", ["event_type"], 3.0, id_cols=["event_id"])


GAP_FIELDS = ["lang", "n_chars", "quality", "toxic"]
S_GAPS = """
j AS (SELECT d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
st AS (SELECT source, 'lang' AS field, CAST(lang AS VARCHAR) AS value FROM j
       UNION ALL SELECT source, 'n_chars', CAST(n_chars AS VARCHAR) FROM j
       UNION ALL SELECT source, 'quality', CAST(quality AS VARCHAR) FROM j
       UNION ALL SELECT source, 'toxic', CAST(toxic AS VARCHAR) FROM j),
pv AS (SELECT source, field, value, count(*) AS n FROM st GROUP BY ALL),
prof AS (SELECT source, field, CAST(sum(n) AS BIGINT) AS n_rows,
    CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS n_missing,
    CAST(coalesce(sum(n) FILTER (WHERE value IN ('', 'N/A', 'N/A - Pending Review')), 0) AS BIGINT) AS n_placeholder,
    count(*) FILTER (WHERE value IS NOT NULL) AS n_distinct,
    coalesce(max(n) FILTER (WHERE value IS NOT NULL), 0) AS top
  FROM pv GROUP BY source, field)"""


@query("data_gaps", f"""
WITH {S_GAPS.strip()}
SELECT source, field, n_rows, n_missing, n_placeholder,
  round((n_missing + n_placeholder) / n_rows, 6) AS gap_rate, n_distinct,
  round(top / n_rows, 6) AS top_value_share FROM prof""")
def q_data_gaps(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    return A.data_gaps(j, GAP_FIELDS, ["source"])


@query("gap_question", f"""
WITH {S_GAPS.strip()},
g AS (SELECT source, field, n_rows, round((n_missing + n_placeholder) / n_rows, 6) AS gap_rate FROM prof
      ORDER BY gap_rate DESC, source ASC, field ASC LIMIT 1)
SELECT source, field, gap_rate,
  printf('{A.GAP_QUESTION.replace("'", "''")}', field, gap_rate * 100, n_rows, source) AS question FROM g""")
def q_gap_question(spark, sf):
    return A.gap_question(q_data_gaps(spark, sf), "source")


# ================================================================ streaming
@query("stream_merge", S_HTML_RECORDS)
def q_stream_merge(spark, sf):
    """Pages streamed (availableNow) into a versioned silver master under
    the shared checkpoint folder; returns the published master."""
    root = scratch_path(spark, "stream_merge")
    cols = ["page_id", "domain", "source_url", "ordinal", "title", "ad", "first_link", "heading",
            "price", "footer"]
    master = run_to_master(spark, sf, f"{root}/master", f"{root}/ckpt",
                           fx.sites(fx.PAGE_SITE), ["source_url", "ordinal"])
    return master.select(*cols)


def _landed(rows, slot, folder: str):
    """``rows`` written to ``folder`` as a stream of files, one slot after the
    other; the number of slots is fixed by the expression."""
    for k in [r[0] for r in rows.select(slot.alias("k")).distinct().orderBy("k").collect()]:
        rows.filter(slot == k).coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("stream_dedup", """
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id FROM (
  SELECT *, max(ts) OVER () AS last, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1 AND epoch_ms(ts) < epoch_ms(last) - 43200000""")
def q_stream_dedup(spark, sf):
    """R2: the first event of every (user, type) by event time, over files
    that overlap by up to twelve hours, each in reversed order; a first event
    is out once the watermark (twelve hours) has passed it."""
    root = scratch_path(spark, "stream_dedup")
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(43200))
    slot = F.floor((F.unix_timestamp("ts") + jitter) / (5 * 86400))
    stream = _landed(e.orderBy(F.desc("ts")), slot, f"{root}/in")
    out = S.drained(S.first_by_time(stream, ["user_id", "event_type"], "ts", "event_id", "12 hours"), root)
    return out.select("user_id", "event_type", ts_str("ts").alias("ts"), "event_id")


PROPS_SITE = {"props.example.com": {"strategy": "json", "container": "", "fields": {"k": "k"}}}
S_PROPS = """
props_pages AS (
  SELECT event_id AS page_id, CASE event_id % 11 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN '{"k":1,"k":2}'
    WHEN 2 THEN NULL WHEN 4 THEN ' \n ' WHEN 5 THEN rpad(props, 5000, ' ') ELSE props END AS html FROM events),
props_bad AS (
  SELECT page_id, CASE page_id % 11 WHEN 0 THEN 'unparsable' WHEN 1 THEN 'duplicate_key' WHEN 5 THEN 'oversize' ELSE 'missing' END AS reason,
    octet_length(encode(html))::BIGINT AS body_bytes, sha256(html) AS body_sha256
  FROM props_pages WHERE page_id % 11 IN (0, 1, 2, 4, 5))"""


def _props_pages(spark, sf):
    """Event properties as landed JSON payloads, some of them damaged."""
    k, body = F.col("event_id") % 11, F.col("props")
    html = (F.when(k == 0, F.expr("substr(props, 1, length(props) - 1)")).when(k == 1, F.lit('{"k":1,"k":2}'))
            .when(k == 2, F.lit(None).cast("string")).when(k == 4, F.lit(" \n ")).when(k == 5, F.rpad(body, 5000, " ")).otherwise(body))
    return table(spark, sf, "events").select(F.col("event_id").alias("page_id"), F.concat(
        F.lit("https://props.example.com/"), F.col("event_id").cast("string")).alias("url"), html.alias("html"))


@query("quality_rows", f"""
WITH {S_PROPS.strip()}
SELECT page_id, 'failed' AS kind, NULL AS k, reason, body_bytes::DOUBLE AS body_bytes, body_sha256 FROM props_bad
UNION ALL SELECT page_id, 'record', coalesce(json_extract_string(html, '$.k'), 'N/A'), NULL, NULL, NULL FROM props_pages
WHERE page_id NOT IN (SELECT page_id FROM props_bad)""")
def q_quality_rows(spark, sf):
    """S2 + X2: damaged payloads with their reason and digest beside the
    records, in one pass (bodies above 4,000 bytes count as oversize here)."""
    pages = _props_pages(spark, sf).withColumn("domain", F.lit("props.example.com"))
    rows = extract_json(pages, fx.sites(PROPS_SITE), quality=True, max_bytes=4000)
    kind = F.when(F.col("reason").isNull(), "record").otherwise("failed")
    return rows.select("page_id", kind.alias("kind"), "k", "reason", "body_bytes", "body_sha256")


@query("stream_routed", f"""
WITH {S_PROPS.strip()},
bad AS (SELECT 'props.example.com' AS domain, reason, count(*) AS n FROM props_bad WHERE reason <> 'oversize' GROUP BY ALL
        UNION ALL SELECT 'feeds.example.com', 'malformed_feed', count(DISTINCT doc_id // 8) FROM documents WHERE (doc_id // 8) % 11 = 5),
good AS (SELECT 'props.example.com' AS domain, count(*) AS n FROM props_pages WHERE page_id NOT IN (SELECT page_id FROM props_bad WHERE reason <> 'oversize')
         UNION ALL SELECT 'feeds.example.com', count(*) FROM documents
         UNION ALL SELECT 'example', count(*) FROM pages)
SELECT 'master' AS tbl, domain, '' AS what, n FROM good UNION ALL SELECT 'quality', domain, reason, n FROM bad WHERE n > 0
UNION ALL SELECT 'metrics', domain, 'records', n FROM good
UNION ALL SELECT 'metrics', domain, 'failed', coalesce((SELECT sum(n) FROM bad WHERE bad.domain = good.domain), 0)::BIGINT FROM good""")
def q_stream_routed(spark, sf):
    """R1 for all strategies: JSON, feed and HTML pages streamed in four
    files into master, quality and metrics tables."""
    root = scratch_path(spark, "stream_routed")
    landed = (table(spark, sf, "pages").select("page_id", "url", "html").unionByName(fx.feed_xml(spark, sf))
              .unionByName(_props_pages(spark, sf)))
    landed.withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(4))).repartition(4, "slot").drop("slot").write.parquet(f"{root}/in")
    roots = {t: f"{root}/{t}" for t in ("master", "quality", "metrics")}
    stream_routed(spark, f"{root}/in", roots, f"{root}/ckpt", fx.sites({**PROPS_SITE, **fx.FEED_SITE, **fx.ARTICLE_SITE}),
                  ["domain", "source_url", "ordinal"])
    read = lambda t, keys, ts: L.read(spark, roots[t], keys, ts)
    master = read("master", ["domain", "source_url", "ordinal"], "page_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    failed = read("quality", ["domain", "page_id", "reason"], "page_id").groupBy("domain", F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    metrics = read("metrics", ["domain", "epoch"], "epoch").groupBy("domain").agg(F.sum("n_records").alias("records"), F.sum("n_failed").alias("failed"))
    metrics = metrics.unpivot("domain", ["records", "failed"], "what", "n")
    each = [master.select(F.lit("master").alias("tbl"), "domain", F.lit("").alias("what"), "n"),
            failed.select(F.lit("quality"), "domain", "what", "n"), metrics.select(F.lit("metrics"), "domain", "what", "n")]
    return each[0].unionAll(each[1]).unionAll(each[2])


ROUTE_SITES = {**fx.ORDER_SITE, **fx.FEED_SITE, **fx.ARTICLE_SITE}
ROUTE_COLS = ["page_id", "domain", "source_url", "ordinal", "line", "part", "qty", "flag", "status_tag",
              "last_tag", "missing", "link", "description", "title", "scraped_at", "from_cache"]


def _routed(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    landed = pages.unionByName(fx.order_json(spark, sf)).unionByName(fx.feed_xml(spark, sf))
    recs = extract_records(landed, fx.sites(ROUTE_SITES))
    fetched = F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    return stamp(recs, fetched_at=ts_str(fetched), from_cache=F.lit(False))


def _s_routed() -> str:
    def pick(sql, cols):
        sel = ", ".join(c if c in cols else f"NULL AS {c}" for c in ROUTE_COLS[:-2])
        return f"SELECT {sel} FROM ({sql})"
    body = " UNION ALL ".join([
        pick(ORACLE["json_records"], {"page_id", "domain", "source_url", "ordinal", "line", "part", "qty",
                                      "flag", "status_tag", "last_tag", "missing"}),
        pick(ORACLE["rss_records"], {"page_id", "domain", "source_url", "ordinal", "title", "link",
                                     "description"}),
        pick(ORACLE["html_h1"], {"page_id", "domain", "source_url", "ordinal", "title"}),
    ])
    stamp_sql = s_ts("TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id)")
    return f"SELECT *, {stamp_sql} AS scraped_at, false AS from_cache FROM ({body})"


# ======================================================= routing + counts
@query("records_route", _s_routed())
def q_records_route(spark, sf):
    """X10 + X11: pages, JSON payloads and feeds landed together, routed by
    each URL's schema strategy (detail -> static HTML, json -> variant, rss
    -> from_xml) into one records table, stamped with the fetch time."""
    return _routed(spark, sf).select(*ROUTE_COLS)


@query("record_counts", f"""
SELECT domain, count(*) AS n_records FROM ({_s_routed()}) GROUP BY domain""")
def q_record_counts(spark, sf):
    """A1: records per site."""
    return A.record_count(_routed(spark, sf), ["domain"])


@query("daily_sample", ORACLE["silver_records"].replace(
    f"""  CASE WHEN scraped_at IS NULL THEN NULL ELSE {s_ts('scraped_at')} END AS scraped_at,
  '{fx.RUN_TS}' AS silver_processed_at""", "  '2024-02-01' AS snapshot_date"))
def q_daily_sample(spark, sf):
    """The rows of the daily CSV sample (provenance dropped, day added)."""
    out = sample_frame(q_silver_records(spark, sf), "2024-02-01")
    return out.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("keyword_clusters", f"""
WITH RECURSIVE {S_PAIRS},
edges AS MATERIALIZED (SELECT word_a AS src, word_b AS dst FROM scored WHERE lift > 1.5
          UNION ALL SELECT word_b, word_a FROM scored WHERE lift > 1.5),
nodes AS (SELECT word_a AS word FROM scored UNION SELECT word_b FROM scored),
labels(word, cluster) USING KEY (word) AS (
  SELECT word, word FROM nodes
  UNION
  SELECT e.dst, min(l.cluster) FROM labels l JOIN edges e ON e.src = l.word JOIN recurring.labels c ON c.word = e.dst
  WHERE l.cluster < c.cluster GROUP BY e.dst)
SELECT word, cluster FROM labels""")
def q_keyword_clusters(spark, sf):
    """A8 (clusters): components of the co-occurrence graph (lift > 1.5, at
    least 5 documents) over every word in at least 5 documents."""
    d = table(spark, sf, "documents")
    return A.keyword_clusters(A.keyword_pairs(d, "text", "doc_id", 5), 1.5, 5)


@query("crawl_run", f"""
WITH {S_GRID.strip()},
recs AS (SELECT user_id AS site, CAST(dayofmonth(ts) AS INTEGER) AS page, event_id FROM events WHERE event_type = 'purchase'),
isl AS (SELECT *, sum(CASE WHEN items > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY page) AS island
        FROM grid),
streak AS (SELECT *, sum(CASE WHEN items = 0 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY site, island ORDER BY page) AS run FROM isl),
stops AS (SELECT site, min(page) AS stop_page FROM streak WHERE run >= 5 GROUP BY site)
SELECT site, page, event_id FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.site ORDER BY r.page, r.event_id) AS rn
  FROM recs r LEFT JOIN stops s USING (site) WHERE s.stop_page IS NULL OR r.page <= s.stop_page)
WHERE rn <= 20""")
def q_crawl_run(spark, sf):
    """C1 + C3 composed (the crawl loop): purchases as records of a
    user x day crawl, halted after 5 empty days, 20 records per site."""
    grid = fx.page_grid(spark, sf).select("site", "page")
    e = table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    recs = e.select(F.col("user_id").alias("site"), F.dayofmonth("ts").alias("page"), "event_id")
    return C.crawl_run(grid, recs, 20, order_cols=["event_id"]).select("site", "page", "event_id")


@query("stream_crawl_halt", ORACLE["crawl_run"])
def q_stream_crawl_halt(spark, sf):
    """C3 + C1 while pages arrive: the crawl of ``crawl_run`` over a stream of
    page files that hold the days in shuffled order."""
    root = scratch_path(spark, "stream_crawl")
    grid = fx.page_grid(spark, sf).select("site", "page")
    e = table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    recs = e.groupBy(F.col("user_id").alias("site"), F.dayofmonth("ts").alias("page")).agg(F.collect_list("event_id").alias("records"))
    pages = grid.join(recs, ["site", "page"], "left").withColumn(
        "fetched_at", F.expr("timestampadd(DAY, page, TIMESTAMP'2024-01-01 00:00:00')"))
    stream = _landed(materialize(pages), F.pmod(F.xxhash64("site", "page"), F.lit(6)), f"{root}/in")
    out = S.drained(S.halt_crawl(stream, 20, "60 days"), root)
    return out.select("site", "page", F.col("record").alias("event_id"))


# ============================================================ sinks
@query("raw_write", ORACLE["raw_layer"])
def q_raw_write(spark, sf):
    """The raw layer written append-only, partitioned by netloc and fetch
    day, into the shared folder, then read back (S1 over the written layer)."""
    from .sources.raw import read_raw, write_raw
    path = scratch_path(spark, "raw")
    p = table(spark, sf, "pages")
    fetched = F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    write_raw(landed_to_raw(p, fetched), path)
    back = read_raw(spark, path)
    return back.select("url", "netloc", F.col("fetch_date").cast("string").alias("fetch_date"),
                       ts_str("fetched_at").alias("fetched_at"), "url_hash", "format",
                       F.length("body").cast("long").alias("n_chars"))


@query("checkpoint_records", ORACLE["dedup_first"])
def q_checkpoint_records(spark, sf):
    """The interim checkpoint (first-wins dedup in arrival order) written
    to the shared folder and read back."""
    from .sources.silver import save_checkpoint
    r = fx.raw_records(spark, sf).select("doc_id", "title", "company", "link", "source_url")
    return save_checkpoint(r, scratch_path(spark, "checkpoint"), ["doc_id"]).select(
        "doc_id", "title", "company", "link", "source_url")


# ===================================================================== A12
BRIEF_FIELDS = ["doc_id", "lang", "title", "text", "link", "company", "source_url", "price"]
S_VALUED = f"""WITH {S_RAW_RECORDS.strip()},
valued AS (SELECT *, TRY_CAST(trim(regexp_replace(price, '[^0-9.]', '', 'g')) AS DOUBLE) AS money_value
           FROM raw_records)"""


def _brief(spark, sf):
    r = fx.raw_records(spark, sf)
    return A.market_brief(r, "source", entity_col="company")


@query("brief_price_distribution", f"""
{S_VALUED}
SELECT source, {_s_stats('money_value', 6)} FROM valued GROUP BY source""")
def q_brief_price_distribution(spark, sf):
    """A12 table 1: price distribution per source."""
    return _brief(spark, sf)["price_distribution"]


@query("brief_keywords", f"""
WITH {S_RAW_RECORDS.strip()},
words AS (SELECT source, w AS word FROM
  (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM raw_records)
  WHERE w NOT IN ({S_STOP})),
counts AS (SELECT source, word, count(*) AS n FROM words GROUP BY source, word),
st AS (SELECT source, count(*) AS nd, max(n) AS maxn FROM counts GROUP BY source)
SELECT source, rank, word, n, 'dominant' AS kind FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word ASC) AS INTEGER) AS rank
  FROM counts) WHERE rank <= 5
UNION ALL
SELECT source, rank, word, n, 'low_density' FROM (
  SELECT c.*, CAST(row_number() OVER (PARTITION BY c.source ORDER BY n ASC, word DESC) AS INTEGER) AS rank
  FROM counts c JOIN st USING (source) WHERE nd > 3 AND (n > 1 OR maxn = 1)) WHERE rank <= 3""")
def q_brief_keywords(spark, sf):
    """A12 table 2: dominant and low-density keywords per source."""
    return _brief(spark, sf)["keywords"]


@query("brief_concentration", f"""
WITH {S_RAW_RECORDS.strip()},
per AS (SELECT source, company, count(*) AS n FROM raw_records WHERE company IS NOT NULL GROUP BY ALL),
agg AS (SELECT source, count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_records, sum(n * n) AS ss,
               max(n) AS top_n, arg_min(company, (-n, company)) AS top_entity FROM per GROUP BY source),
top3 AS (SELECT source, sum(n) AS t3 FROM (
           SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, company) AS r FROM per)
         WHERE r <= 3 GROUP BY source)
SELECT source, n_entities, n_records, top_entity, round(top_n / n_records, 6) AS top_share,
       round(t3 / n_records, 6) AS top3_share, round(ss / (n_records * n_records), 6) AS hhi
FROM agg JOIN top3 USING (source)""")
def q_brief_concentration(spark, sf):
    """A12 table 3: company concentration per source."""
    return _brief(spark, sf)["concentration"]


def _s_brief_gaps() -> str:
    stacked = " UNION ALL ".join(
        f"SELECT source, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM raw_records" for f in BRIEF_FIELDS)
    return f"""
{S_VALUED},
st AS ({stacked}),
pv AS (SELECT source, field, value, count(*) AS n FROM st GROUP BY ALL),
prof AS (SELECT source, field, CAST(sum(n) AS BIGINT) AS n_rows,
    CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS n_missing,
    CAST(coalesce(sum(n) FILTER (WHERE value IN ('', 'N/A', 'N/A - Pending Review')), 0) AS BIGINT) AS n_placeholder,
    count(*) FILTER (WHERE value IS NOT NULL) AS n_distinct,
    coalesce(max(n) FILTER (WHERE value IS NOT NULL), 0) AS top
  FROM pv GROUP BY source, field),
ost AS (SELECT source, avg(money_value) AS m, stddev_samp(money_value) AS sd FROM valued
        WHERE money_value IS NOT NULL GROUP BY source)
SELECT source, field, CAST(n_rows AS DOUBLE) AS n_rows, CAST(n_missing AS DOUBLE) AS n_missing,
  CAST(n_placeholder AS DOUBLE) AS n_placeholder, round((n_missing + n_placeholder) / n_rows, 6) AS gap_rate,
  CAST(n_distinct AS DOUBLE) AS n_distinct, round(top / n_rows, 6) AS top_value_share, 'gap' AS kind,
  NULL AS source_url, NULL::DOUBLE AS money_value, NULL::DOUBLE AS group_mean, NULL::DOUBLE AS group_std,
  NULL::DOUBLE AS z
FROM prof
UNION ALL
SELECT source, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'outlier', source_url, money_value,
  round(m, 6), round(sd, 6), round((money_value - m) / sd, 6)
FROM valued JOIN ost USING (source)
WHERE money_value IS NOT NULL AND sd > 0 AND abs(money_value - m) > 3 * sd"""


@query("brief_anomalies_and_gaps", _s_brief_gaps())
def q_brief_anomalies_and_gaps(spark, sf):
    """A12 table 4: gap profile (A11) and price outliers (A10) per source.
    Counts are shown as DOUBLE here: outlier rows leave them NULL, and a
    nullable count would change type between the two engines' frames."""
    t = _brief(spark, sf)["anomalies_and_gaps"]
    for c in ("n_rows", "n_missing", "n_placeholder", "n_distinct"):
        t = t.withColumn(c, F.col(c).cast("double"))
    return t


# ============================================================ crawl run
CRAWL_SITE = {"example": {"strategy": "index", "container": "article", "fields": {"title": "h1"}}}


@query("crawl_records", f"""
WITH p AS (SELECT page_id, url, html, regexp_extract(url, '/([a-z][a-z])/', 1) AS target FROM pages),
grid AS (SELECT t.target, CAST(g.page_no AS INTEGER) AS page_no, p.url, p.html
         FROM (SELECT DISTINCT target FROM p) t
         CROSS JOIN (SELECT unnest(range(1, (SELECT max(page_id) + 2 FROM pages))) AS page_no) g
         LEFT JOIN p ON p.target = t.target AND p.page_id = g.page_no - 1),
isl AS (SELECT *, sum(CASE WHEN url IS NOT NULL THEN 1 ELSE 0 END)
                  OVER (PARTITION BY target ORDER BY page_no) AS island FROM grid),
streak AS (SELECT *, sum(CASE WHEN url IS NULL THEN 1 ELSE 0 END)
                     OVER (PARTITION BY target, island ORDER BY page_no) AS run FROM isl),
stops AS (SELECT target, min(page_no) AS stop_page FROM streak WHERE run >= 5 GROUP BY target)
SELECT target, page_no, source_url, title FROM (
  SELECT g.target, g.page_no, g.url AS source_url,
         {s_title(s_decode("regexp_extract(g.html, '(?s)<h1>(.*?)</h1>', 1)"))} AS title,
         row_number() OVER (PARTITION BY g.target ORDER BY g.page_no) AS rn
  FROM grid g LEFT JOIN stops s USING (target)
  WHERE g.url IS NOT NULL AND (s.stop_page IS NULL OR g.page_no <= s.stop_page))
WHERE rn <= 5""")
def q_crawl_records(spark, sf):
    """The crawl loop end to end (U7 frontier, landed pages, X5 extraction,
    V1, C3 halting, C1 cap): one crawl per language path, page number =
    page id + 1, so each crawl meets the pages of other languages as pages
    that never landed; 5 records per crawl."""
    from .plans.run import crawl_records
    pages = table(spark, sf, "pages").select("page_id", "url", "html").withColumn(
        "target", F.regexp_extract("url", "/([a-z][a-z])/", 1))
    last = pages.agg(F.max("page_id") + 1).scalar()
    frontier = (pages.select("target").distinct()
                .select("target", F.explode(F.sequence(F.lit(1), last.cast("int"))).alias("page_no"))
                .join(pages.select("target", (F.col("page_id") + 1).cast("int").alias("page_no"), "url"),
                      ["target", "page_no"], "left")
                .select("target", "page_no", F.coalesce("url", F.concat(
                    F.lit("missing://"), F.col("target"), F.lit("/"), F.col("page_no").cast("string")))
                    .alias("page_url")))
    landed = pages.select(F.col("url").alias("page_url"), "html")
    recs = crawl_records(frontier, landed, fx.sites(CRAWL_SITE), 5, fetched_col=None)
    return recs.select("target", "page_no", "source_url", "title")
