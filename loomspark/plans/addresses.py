"""URLs, pages, texts, scores: scalar functions over pages, documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import rules, texts, urls
from loomspark.operators import grouping as g
from loomspark.operators import matching, reports
from loomspark.sources import pages as pg

from .registry import Tables, query

HOST = "lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
KEY = "nullif(lower(regexp_replace(regexp_replace(regexp_replace(trim(u), '^(?i:https?)://', ''), '^(?i:www)\\.', ''), '/+$', '')), '')"
BROKEN = "CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN replace(replace(url, 'https://', ''), 'http://', '') WHEN 2 THEN 'https:///' || page_id WHEN 3 THEN 'https://localhost/' || page_id WHEN 4 THEN 'https://site.x' WHEN 5 THEN replace(url, '.example', '_.example') WHEN 6 THEN NULL ELSE url END"


def _broken(t: Tables):
    plain = F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    k = F.col("page_id") % 8
    u = (
        F.when(k == 0, "").when(k == 1, plain).when(k == 2, F.concat(F.lit("https:///"), "page_id")).when(k == 3, F.concat(F.lit("https://localhost/"), "page_id"))
        .when(k == 4, "https://site.x").when(k == 5, F.replace("url", F.lit(".example"), F.lit("_.example"))).when(k == 6, None).otherwise(F.col("url"))
    )
    return t.pages.select("page_id", u.alias("u"))


@query("f6_url_validation", f"""
WITH x AS (SELECT page_id, trim(coalesce({BROKEN}, '')) AS u FROM pages), y AS (SELECT page_id, u, {HOST} AS h FROM x)
SELECT page_id, CASE WHEN u = '' THEN 'empty_url' WHEN NOT regexp_matches(u, '^https?://') THEN 'missing_scheme' WHEN h = '' THEN 'no_hostname'
  WHEN NOT contains(h, '.') THEN 'no_tld' WHEN length(regexp_extract(h, '([^.]*)$', 1)) < 2 THEN 'truncated_tld'
  WHEN NOT regexp_matches(u, '^https?://[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?(\\.[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?)*\\.[a-zA-Z]{{2,}}(/.*)?$') THEN 'invalid_format' ELSE '' END AS reason FROM y""")
def url_validation(t: Tables):
    return _broken(t).select("page_id", urls.url_problem(F.col("u")).alias("reason"))


@query("f7_junk_urls", "SELECT page_id, regexp_matches(u, 'yandex\\.ru/images/|yandex\\.ru/search/|google\\.\\w+/search|google\\.\\w+/maps|webcache\\.googleusercontent\\.com') AS junk FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://yandex.ru/search/?text=' || page_id WHEN 1 THEN 'https://google.com/maps/' || page_id ELSE url END AS u FROM pages)")
def junk_urls(t: Tables):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.concat(F.lit("https://yandex.ru/search/?text="), "page_id")).when(k == 1, F.concat(F.lit("https://google.com/maps/"), "page_id")).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.is_junk_url(u).alias("junk"))


@query("f8_directory_domains", f"SELECT page_id FROM (SELECT page_id, {HOST.replace('u,', 'url,')} AS h FROM pages) WHERE h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org'")
def directory_domains(t: Tables):
    return t.pages.filter(urls.is_directory_url(F.col("url"), ["example.com", "example.org"])).select("page_id")


@query("p8_p9_url_keys", f"SELECT page_id, {KEY.replace('trim(u)', 'trim(url)')} AS key, CASE WHEN regexp_extract(url, '^(https?://[^/?#]+)', 1) = '' THEN url ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' END AS root FROM pages")
def url_keys(t: Tables):
    return t.pages.select("page_id", urls.url_key(F.col("url")).alias("key"), urls.url_root(F.col("url")).alias("root"))


@query("p10_domain_fragment", """
WITH l AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://', ''), '^www\\.', ''), '/.*$', '', 's'), '\\.+$', ''), '.'), lambda x: x <> '') AS a FROM pages),
m AS (SELECT page_id, a, list_filter(a, lambda x: lower(x) NOT IN ('ru', 'com', 'org', 'net', 'рф', 'gov', 'www', 'http', 'https')) AS b FROM l)
SELECT page_id, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE a END, ' ') AS fragment FROM m""")
def domain_fragments(t: Tables):
    return t.pages.select("page_id", urls.domain_fragment(F.col("url")).alias("fragment"))


@query("p11_social_links", """
WITH x AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://vk.com/club' || page_id WHEN 1 THEN 'https://vk.com/wall-' || page_id WHEN 2 THEN 'https://ok.ru/group/' || page_id
  WHEN 3 THEN 'https://t.me/news_' || page_id || '/' WHEN 4 THEN 'https://vk.com/share' ELSE url END AS u FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'vk_group' WHEN 2 THEN 'ok_group' WHEN 3 THEN 'tg_channel' ELSE 'none' END AS kind,
  CASE page_id % 6 WHEN 0 THEN 'club' || page_id WHEN 2 THEN 'group/' || page_id WHEN 3 THEN 'news_' || page_id ELSE '' END AS slug,
  CASE WHEN page_id % 6 IN (0, 2) THEN page_id END AS numeric_id FROM x""")
def social_links(t: Tables):
    k = F.col("page_id") % 6
    u = (
        F.when(k == 0, F.concat(F.lit("https://vk.com/club"), "page_id")).when(k == 1, F.concat(F.lit("https://vk.com/wall-"), "page_id"))
        .when(k == 2, F.concat(F.lit("https://ok.ru/group/"), "page_id")).when(k == 3, F.concat(F.lit("https://t.me/news_"), "page_id", F.lit("/")))
        .when(k == 4, "https://vk.com/share").otherwise(F.col("url"))
    )
    return t.pages.select("page_id", urls.social_link(u).alias("s")).select("page_id", "s.*")


@query("p12_p13_scheme_repair", f"SELECT page_id, CASE WHEN u = '' THEN 'empty' WHEN contains(u, '@') THEN 'email' WHEN regexp_matches(u, '^https?://') THEN 'ok' ELSE 'fixed' END AS status, CASE WHEN u = '' OR contains(u, '@') OR regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS fixed FROM (SELECT page_id, trim(coalesce({BROKEN}, '')) AS u FROM pages)")
def scheme_repair(t: Tables):
    return _broken(t).select("page_id", urls.repaired_scheme(F.col("u")).alias("r")).select("page_id", "r.status", F.col("r.url").alias("fixed"))


@query("p14_contacts", r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}'))) AS n_phones, len(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}'))) AS n_emails FROM documents")
def contacts(t: Tables):
    c = texts.contacts(F.col("text"))
    return t.documents.select("doc_id", F.size(c["phones"]).cast("long").alias("n_phones"), F.size(c["emails"]).cast("long").alias("n_emails"))


@query("p1_clean_ids", "SELECT c_custkey, CASE WHEN length(d) IN (10, 12) THEN d END AS tax_id FROM (SELECT c_custkey, regexp_replace('ИНН ' || lpad(CAST(c_custkey AS VARCHAR), 9 + CAST(c_custkey % 4 AS INTEGER), '7') || '-', '\\D', '', 'g') AS d FROM customer)")
def clean_ids(t: Tables):
    raw = F.concat(F.lit("ИНН "), F.lpad(F.col("c_custkey").cast("string"), 9 + (F.col("c_custkey") % 4).cast("int"), F.lit("7")), F.lit("-"))
    return t.customer.select("c_custkey", texts.digits_of_length(raw, 10, 12).alias("tax_id"))


@query("p2_p3_address_parts", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Омская область' WHEN 1 THEN 'г. Тула' ELSE '' END AS region, CASE c_custkey % 3 WHEN 0 THEN 'Омск' WHEN 1 THEN 'Тула' ELSE 'Сочи' END AS city FROM customer")
def address_parts(t: Tables):
    k = F.col("c_custkey") % 3
    a = F.when(k == 0, "644000, Омская область, г. Омск, ул. Мира").when(k == 1, "300000, г. Тула, пр. Ленина").otherwise("Сочи")
    return t.customer.select("c_custkey", texts.region_of(a).alias("region"), texts.city_of(a).alias("city"))


@query("p19_references", "SELECT page_id, substr(sha256(url || '#' || substr(html, 1, 80)), 1, 32) AS ref FROM pages")
def references(t: Tables):
    return t.pages.select("page_id", texts.stable_reference(F.col("url"), F.col("html")).alias("ref"))


@query("p21_p22_lists", "SELECT event_id, array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> '' AND x <> 'None'), '|') AS items FROM (SELECT event_id, event_type || ', None, ,' || user_id AS v FROM events)")
def lists(t: Tables):
    v = F.concat("event_type", F.lit(", None, ,"), F.col("user_id").cast("string"))
    return t.events.select("event_id", F.array_join(texts.list_of(v), "|").alias("items"))


@query("p24_snippets", "SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS snippet, length(CASE WHEN length(text) <= 6000 THEN text ELSE substr(text, 1, 4000) || chr(10) || '...' || chr(10) || right(text, 2000) END) AS trimmed FROM documents")
def snippets(t: Tables):
    return t.documents.select("doc_id", texts.snippet(F.col("text")).alias("snippet"), F.length(texts.head_and_tail(F.col("text"))).cast("long").alias("trimmed"))


DECIDED = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'rejected' END AS decision, (n_chars % 100) / 100.0 AS score, doc_id % 3 <> 0 AS flag, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS existing FROM documents"


@query("p25_p26_p29_status_tier_action", f"""
SELECT doc_id, CASE WHEN decision = 'rejected' THEN 'rejected' WHEN decision = 'needs_review' THEN 'pending_review' WHEN decision = 'accepted' AND score >= 0.85 AND flag THEN 'approved'
  WHEN decision = 'accepted' THEN 'pending_review' ELSE 'draft' END AS status,
  CASE WHEN score >= 0.8 AND decision IS NOT DISTINCT FROM 'needs_review' THEN 'review' WHEN score >= 0.8 THEN 'auto' WHEN score >= 0.5 THEN 'review' ELSE 'reject' END AS tier,
  CASE WHEN decision = 'rejected' AND existing IS NOT NULL THEN 'mark_outdated' WHEN decision = 'rejected' THEN 'skipped' WHEN decision = 'accepted' AND existing IS NOT NULL THEN 'updated'
  WHEN decision = 'accepted' THEN 'created' WHEN existing IS NOT NULL THEN 'updated_needs_review' ELSE 'created_draft' END AS action FROM ({DECIDED})""")
def decisions(t: Tables):
    k = F.col("doc_id") % 5
    d = F.when(k <= 1, "accepted").when(k == 2, "needs_review").when(k == 3, "rejected")
    score, existing = (F.col("n_chars") % 100) / 100.0, F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    return t.documents.select("doc_id", rules.import_status(d, score, F.col("doc_id") % 3 != 0).alias("status"), rules.tier(score, d).alias("tier"), rules.sync_action(d, existing).alias("action"))


@query("p36_page_links", "SELECT page_id, href, place FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS l FROM pages))")
def page_links(t: Tables):
    return pg.link_rows(t.pages, keep=["page_id"]).select("page_id", "href", "place")


@query("p17_page_records")
def page_records(t: Tables):
    r = pg.page_records(t.pages)
    return r.select("page_id", "url", "title", F.size("headings").alias("n_headings"), F.size("paragraphs").alias("n_paragraphs"), F.size("links").alias("n_links"))


@query("p37_sections", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: trim(s)), lambda s: length(s) > 100)) FROM (SELECT doc_id, text FROM documents)) GROUP BY doc_id")
def page_sections(t: Tables):
    return pg.sections(t.documents, "text", ["doc_id"]).filter(F.length("content") > 100).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("w7_subpage_rank", "SELECT page_id, href, rank FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN contains(lower(href), 'contact') THEN 100 WHEN contains(lower(href), 'about') THEN 50 WHEN contains(lower(href), 'filial') THEN 25 ELSE 10 END DESC, place) AS rank FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS l FROM pages))) WHERE rank <= 3")
def subpage_rank(t: Tables):
    links = pg.link_rows(t.pages, keep=["page_id"])
    top = g.first_per(links, ["page_id"], [texts.page_rank(F.col("href"), F.lit("")).desc(), F.col("place")], 3)
    return top.select("page_id", "href", F.col("_rank").alias("rank"))


@query("w8_merge_pages", "SELECT h AS site, count(*) AS n_pages, CAST(sum(l) AS BIGINT) AS chars FROM (SELECT h, l, sum(l) OVER (PARTITION BY h ORDER BY page_id) AS s, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n FROM (SELECT page_id, length(substr(html, 1, 4000)) AS l, regexp_extract(url, 'example\\.([a-z]+)', 1) AS h FROM pages)) WHERE s <= 30000 OR n = 1 GROUP BY h")
def merged_pages(t: Tables):
    rows = t.pages.withColumn("site", F.regexp_extract("url", r"example\.([a-z]+)", 1))
    out = g.merge_pages(rows, "site", "page_id", "html", per_page=4000, mark="")
    return out.select("site", "n_pages", F.length("merged").cast("long").alias("chars"))


@query("w9_first_roots", "SELECT root, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' AS root FROM pages) GROUP BY root")
def first_roots(t: Tables):
    return t.pages.groupBy(urls.url_root(F.col("url")).alias("root")).agg(F.min("page_id").alias("page_id"))


@query("a10_duplicate_groups", "SELECT 'host' AS \"column\", count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS h, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1 AND h <> '') UNION ALL SELECT 'url', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT url, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1)")
def duplicate_groups(t: Tables):
    return reports.duplicate_summary(t.pages.withColumn("host", F.regexp_extract("url", "://([^/]+)", 1)), ["host", "url"])


SITES = f"SELECT DISTINCT {KEY.replace('trim(u)', 'trim(url)')} AS k FROM pages"


@query("j5_containment_join", f"WITH a AS (SELECT DISTINCT split_part(k, '.', 1) AS frag FROM ({SITES})), b AS ({SITES}) SELECT frag, k AS key FROM a, b WHERE frag <> '' AND (contains(k, frag) OR contains(frag, k))")
def containment(t: Tables):
    keys = t.pages.select(urls.url_key(F.col("url")).alias("key")).filter("key is not null").distinct()
    return matching.contained_pairs(keys.select(F.split_part("key", F.lit("."), F.lit(1)).alias("frag")), "frag", keys, "key")


@query("j6_new_sources", f"SELECT DISTINCT k AS key FROM (SELECT {KEY.replace('trim(u)', 'trim(url)')} AS k, page_id FROM pages) WHERE page_id % 2 = 1 EXCEPT SELECT {KEY.replace('trim(u)', 'trim(url)')} FROM pages WHERE page_id % 2 = 0")
def new_sources(t: Tables):
    rows = t.pages.select("page_id", urls.url_key(F.col("url")).alias("key"))
    return rows.filter("page_id % 2 = 1").select("key").distinct().join(rows.filter("page_id % 2 = 0"), "key", "left_anti")


@query("j7_site_consistency", """
WITH a AS (SELECT page_id % 40 AS id, regexp_extract(url, '://([^/]+)', 1) AS k FROM pages WHERE page_id % 3 <> 0 GROUP BY ALL), b AS (SELECT page_id % 40 AS id, regexp_extract(url, '://([^/]+)', 1) AS k FROM pages WHERE page_id % 5 <> 0 GROUP BY ALL),
c AS (SELECT coalesce(a.id, b.id) AS id, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS linked, count(*) FILTER (WHERE b.k IS NULL) AS missing, count(*) FILTER (WHERE a.k IS NULL) AS extra FROM a FULL JOIN b ON a.id = b.id AND a.k = b.k GROUP BY 1)
SELECT o.id, coalesce(linked, 0) AS linked, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra,
  CASE WHEN coalesce(missing, 0) = 0 AND coalesce(extra, 0) = 0 THEN 'perfect' WHEN coalesce(extra, 0) = 0 THEN 'missing' WHEN coalesce(missing, 0) = 0 THEN 'extra' ELSE 'partial' END AS verdict
FROM (SELECT DISTINCT page_id % 40 AS id FROM pages) o LEFT JOIN c ON o.id = c.id""")
def site_consistency(t: Tables):
    rows = t.pages.select("page_id", (F.col("page_id") % 40).alias("id"), F.regexp_extract("url", "://([^/]+)", 1).alias("key"))
    owners = rows.groupBy("id").agg(F.collect_set(F.when(F.col("page_id") % 3 != 0, F.col("key"))).alias("keys"))
    return matching.link_consistency(owners, "id", "keys", rows.filter("page_id % 5 <> 0"), "id", "key")


@query("j18_source_proposals", "SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE href NOT IN (SELECT '/' || split_part(text, ' ', 1) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY href")
def source_proposals(t: Tables):
    links = pg.link_rows(t.pages, keep=["page_id"])
    known = t.documents.filter("doc_id % 3 = 0 and text is not null").select(F.concat(F.lit("/"), F.split_part("text", F.lit(" "), F.lit(1))).alias("href"))
    return links.join(known, "href", "left_anti").groupBy("href").agg(F.count("*").alias("n"))
