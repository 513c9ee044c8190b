"""Import records, events, venues, sources, reviews and batch jobs on the star schema, pages and events.

Organisations are customers, directories are suppliers, venues are nations, sources and search hits are pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import cards as cd
from loomspark.functions import urls
from loomspark.functions.texts import stable_reference
from loomspark.operators import records, reviews
from loomspark.sources import pages as pg

from .addresses import HOST
from .registry import Tables, query

AS_OF = "2024-01-18 12:00:00"


def s(c):
    return c.cast("string")


ANSWER = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'S' || c_custkey WHEN c_custkey % 4 = 1 THEN ' ' END AS st, CASE WHEN c_custkey % 3 = 0 THEN ' C' || c_custkey END AS ct, CASE WHEN c_custkey % 5 <> 0 THEN 'R' || c_nationkey END AS rg, CASE WHEN c_custkey % 7 <> 1 THEN 'RU-' || c_nationkey END AS iso, CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE CAST(c_custkey % 90 AS VARCHAR) END AS la FROM customer"


@query("p20_address_answers", f"SELECT c_custkey, coalesce(nullif(trim(st), ''), trim(ct), rg) AS fias_id, CASE WHEN trim(st) <> '' THEN '6' WHEN ct IS NOT NULL THEN '4' WHEN rg IS NOT NULL THEN '1' END AS fias_level, coalesce(trim(ct), nullif(trim(st), ''), rg) AS city_fias_id, coalesce(trim(ct), rg) AS kladr_id, iso AS region_iso, CASE WHEN iso IS NULL THEN rg END AS region_code, TRY_CAST(la AS DOUBLE) AS geo_lat FROM ({ANSWER})")
def address_answers(t: Tables):
    st = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("S"), s(F.col("c_custkey")))).when(F.col("c_custkey") % 4 == 1, " ")
    ct, rg = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" C"), s(F.col("c_custkey")))), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("R"), s(F.col("c_nationkey"))))
    none = F.lit(None).cast("string")
    answer = F.struct(
        st.alias("settlement_fias_id"), ct.alias("city_fias_id"), rg.alias("region_fias_id"), F.when(F.col("c_custkey") % 7 != 1, F.concat(F.lit("RU-"), s(F.col("c_nationkey")))).alias("region_iso_code"),
        none.alias("house_kladr_id"), none.alias("street_kladr_id"), F.lit("").alias("settlement_kladr_id"), ct.alias("city_kladr_id"), rg.alias("region_kladr_id"), none.alias("kladr_id"),
        F.when(F.col("c_custkey") % 6 == 0, "x").otherwise(s(F.col("c_custkey") % 90)).alias("geo_lat"), F.lit("37.5").alias("geo_lon"),
    )
    return t.customer.select("c_custkey", answer.alias("a")).select("c_custkey", records.geocoded(F.col("a")).alias("g")).select("c_custkey", "g.*").drop("geo_lon")


@query("p30_code_checks", """
WITH r AS (SELECT c_custkey, ['14' || (c_custkey % 5), '16' || (c_custkey % 4)] AS a, CASE WHEN c_custkey % 6 < 2 THEN NULL WHEN c_custkey % 6 = 2 THEN '' WHEN c_custkey % 6 = 3 THEN '143' WHEN c_custkey % 6 = 4 THEN '999' ELSE '162' END AS o FROM customer),
k AS (SELECT c_custkey, list_filter(a, lambda x: x IN ('141', '142', '143')) AS good, list_filter(a, lambda x: x IN ('161', '162')) AS stray, list_filter(a, lambda x: x NOT IN ('141', '142', '143', '161', '162')) AS bad, nullif(o, '') AS o FROM r),
m AS (SELECT *, coalesce(o, stray[1]) AS w FROM k)
SELECT c_custkey, array_to_string(CASE WHEN w = '143' THEN list_append(good, w) ELSE good END, ',') AS types, CASE WHEN w = '143' THEN NULL ELSE w END AS ownership, array_to_string(list_concat(list_transform(bad, lambda x: 'type:' || x), CASE WHEN w = '999' THEN ['ownership:999'] ELSE [] END), ',') AS issues FROM m""")
def code_checks(t: Tables):
    k = F.col("c_custkey") % 6
    own = F.when(k < 2, None).when(k == 2, "").when(k == 3, "143").when(k == 4, "999").otherwise("162")
    types = F.array(F.concat(F.lit("14"), s(F.col("c_custkey") % 5)), F.concat(F.lit("16"), s(F.col("c_custkey") % 4)))
    rows = t.customer.select("c_custkey", records.checked_codes(types, own, ["141", "142", "143"], ["161", "162"]).alias("c"))
    return rows.select("c_custkey", F.array_join("c.types", ",").alias("types"), "c.ownership", F.array_join("c.issues", ",").alias("issues"))


@query("f18_p31_venue_payloads", "SELECT c_custkey, string_agg('a' || o_orderkey || ':' || coalesce(CASE WHEN i < 3 THEN o_orderpriority END, '-'), ',' ORDER BY i) AS venues, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY 1")
def venue_payloads(t: Tables):
    rows = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("o"))
    venues = F.transform("o", lambda x: F.struct(F.concat(F.lit("a"), s(x["o_orderkey"])).alias("address_raw"), F.when(x["o_orderstatus"] == "F", s(x["o_orderkey"])).alias("fias_id")))
    rows = rows.withColumn("v", venues).withColumn("g", F.slice(F.transform("o", lambda x: x["o_orderpriority"]), 1, 2))
    text = F.transform(records.with_geo(F.col("v"), F.col("g")), lambda x: F.concat(x["venue"]["address_raw"], F.lit(":"), F.coalesce(x["geo"], F.lit("-"))))
    return rows.select("c_custkey", F.array_join(text, ",").alias("venues"), F.size(records.verified_venues(F.col("v"))).cast("long").alias("verified"))


PAGE_REF = "substr(sha256(url || '#' || substr(t, 1, 80)), 1, 32)"


@query("p32_p33_event_ingestion", f"""
WITH n AS (SELECT page_id, url, t, {PAGE_REF} AS ref FROM (SELECT page_id, url, 'Note ' || page_id AS t FROM pages)),
raw AS (SELECT ref, 'org_website' AS kind, FALSE AS online, page_id AS k FROM n UNION ALL SELECT 'ev' || event_id, 'platform', event_id % 2 = 0, event_id FROM events WHERE event_type = 'signup'),
c AS (SELECT ref, CASE k % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'needs_review' END AS d, (k % 10) / 10.0::DOUBLE AS sc FROM raw WHERE k % 3 <> 0)
SELECT raw.ref AS source_reference, kind, coalesce(d, 'needs_review') AS decision, coalesce(sc, 0.5::DOUBLE) AS score, CASE WHEN online THEN 'online' ELSE 'offline' END AS mode, CASE WHEN kind = 'platform' THEN '2024-05-09T10:30:00+03:00' END AS start
FROM raw LEFT JOIN c ON raw.ref = c.ref WHERE d IS DISTINCT FROM 'rejected'""")
def event_ingestion(t: Tables):
    notes = t.pages.select("url", F.concat(F.lit("Note "), s(F.col("page_id"))).alias("title"), F.col("html").alias("content"), F.lit("site").alias("found_on"), F.col("page_id").alias("k"))
    e, none = t.events.filter("event_type = 'signup'"), F.lit(None).cast("string")
    listed = e.select(
        F.concat(F.lit("ev"), s(F.col("event_id"))).alias("source_reference"), F.col("event_type").alias("title"), F.col("props").alias("description"), F.lit("9 мая 2024 года, 10.30 - 12:15 (Мск)").alias("date_text"),
        none.alias("location"), none.alias("category"), (F.col("event_id") % 2 == 0).alias("is_online"), none.alias("registration_url"), none.alias("page_url"), F.col("event_id").alias("k"),
    )
    refs = notes.select(stable_reference(F.col("url"), F.col("title")).alias("source_reference"), "k").union(listed.select("source_reference", "k")).filter("k % 3 <> 0")
    k = F.col("k") % 4
    c = refs.select(
        "source_reference", F.when(k == 0, "accepted").when(k == 1, "rejected").otherwise("needs_review").alias("decision"), ((F.col("k") % 10) / 10).alias("score"), F.lit(True).alias("works_with_elderly"),
        none.alias("attendance_mode"), none.alias("online_url"), none.alias("starts"), none.alias("ends"),
    )
    raw = records.raw_events(notes, listed)
    out = records.ingested_events(raw, c, F.lit("2024-01-18").cast("date"))
    return out.select("source_reference", F.get("ai_metadata.ai_source_trace", 0)["source_kind"].alias("kind"), "ai_metadata.decision", F.col("ai_metadata.ai_confidence_score").alias("score"), F.col("attendance_mode").alias("mode"), F.col("start_datetime").alias("start"))


@query("p34_p35_minimal_records", """
WITH u AS (SELECT c_custkey, c_name, c_mktsegment, 8 || CAST(7 + c_custkey % 3 AS VARCHAR) AS g FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
SELECT 'registry_' || c_custkey AS source_reference, coalesce(s_name, c_name) AS title, 'ОКВЭД: ' || CASE c_custkey % 3 WHEN 0 THEN '87' WHEN 1 THEN '88' ELSE '89' END || '.10. Статус: ' || c_mktsegment || '.' AS description,
  CASE WHEN c_custkey % 3 = 0 THEN '142,141' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN '142,143' ELSE '142' END AS types, CASE WHEN s_suppkey IS NOT NULL OR c_custkey % 5 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_venues
FROM u LEFT JOIN supplier ON c_custkey = s_suppkey""")
def minimal(t: Tables):
    known = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    code = F.when(F.col("c_custkey") % 3 == 0, "87.10").when(F.col("c_custkey") % 3 == 1, "88.10").otherwise("89.10")
    orgs = t.customer.join(known, "c_custkey", "left_anti").select(
        s(F.col("c_custkey")).alias("inn"), F.lit(None).cast("string").alias("ogrn"), F.col("c_name").alias("full_name"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name")).alias("address"),
        code.alias("okved"), F.array("c_mktsegment").alias("statuses"), (F.col("c_custkey") % 2 == 0).alias("provider"),
    )
    geo = F.struct(s(F.col("s_nationkey")).alias("fias_id"))
    parties = t.supplier.select(s(F.col("s_suppkey")).alias("inn"), F.col("s_name").alias("name"), F.col("s_name").alias("address"), geo.alias("geo"))
    out = records.minimal_records(orgs, parties, "registry", "https://registry.example/")
    return out.select("source_reference", "title", "description", F.array_join("organization_type_codes", ",").alias("types"), F.size("venues").cast("long").alias("n_venues"))


@query("p38_source_defaults", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'N' || page_id ELSE regexp_replace(regexp_replace(url, '/+$', ''), '^https?://', '') END AS name, CASE WHEN page_id % 5 = 0 THEN 1 WHEN page_id % 2 = 0 THEN 30 ELSE 7 END AS crawl_period_days, 50 AS priority, 'pending' AS last_status FROM pages")
def new_source_rows(t: Tables):
    k = F.col("page_id")
    rows = t.pages.select("page_id", F.col("url").alias("base_url"), F.when(k % 2 == 0, "org_website").otherwise("vk_group").alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("N"), s(k))).alias("name"), F.when(k % 5 == 0, 1).alias("crawl_period_days"), F.lit(None).cast("int").alias("priority"))
    return records.source_defaults(rows).select("page_id", "name", "crawl_period_days", "priority", "last_status")


@query("j2_facet_membership", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R')) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (3, 7, 9))")
def facet_membership(t: Tables):
    links = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_suppkey")
    return records.in_facets(t.part.select("p_partkey"), "p_partkey", [(links, "l_returnflag", ["A", "R"]), (links, "l_suppkey", [3, 7, 9]), (links, "l_suppkey", [])])


@query("j13_venue_resolution", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = c_nationkey % 7) ELSE (SELECT min(n_nationkey) FROM nation WHERE n_name = 'NATION_' || (c_nationkey * 2)) END AS venue_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 3 = 0 THEN (SELECT min_by(n_name, n_nationkey) FROM nation WHERE n_regionkey = c_nationkey % 7) ELSE (SELECT min(n_name) FROM nation WHERE n_name = 'NATION_' || (c_nationkey * 2)) END AS region_iso FROM customer""")
def venue_resolution(t: Tables):
    nation = F.col("c_nationkey")
    new = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, s(nation % 7)).otherwise("").alias("fias_id"), F.concat(F.lit("NATION_"), s(nation * 2)).alias("address_raw"), F.when(F.col("c_custkey") % 4 == 0, "new").alias("region_iso"))
    known = t.nation.select(F.col("n_nationkey").alias("id"), s(F.col("n_regionkey")).alias("fias_id"), F.col("n_name").alias("address_raw"), F.col("n_name").alias("region_iso"))
    return records.resolved_venues(new, known, ["region_iso"]).select("c_custkey", "venue_id", "region_iso")


@query("m11_added_context", "SELECT c_custkey, CASE WHEN n IS NULL THEN c_name ELSE c_name || chr(10) || chr(10) || 'Orders: ' || n || '.' END AS description, CASE WHEN n IS NULL THEN 0 ELSE 1 END::BIGINT AS traces FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def added_context(t: Tables):
    n = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("Orders: "), s(F.count("*")), F.lit(".")).alias("sentence"), F.lit("orders").alias("entry"))
    orgs = t.customer.select("c_custkey", F.col("c_name").alias("description"), F.lit(None).cast("array<string>").alias("trace"))
    return records.with_context(orgs, n, "c_custkey").select("c_custkey", "description", F.size("trace").cast("long").alias("traces"))


@query("w10_event_limits", """
WITH l AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM (SELECT page_id, url, unnest(x) AS href, generate_subscripts(x, 1) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS x FROM pages))),
k AS (SELECT page_id, count(*) AS n, any_value(url) AS url FROM l WHERE n <= 2 GROUP BY 1)
SELECT page_id, n FROM (SELECT page_id, n, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) AS i FROM k) WHERE i <= 3""")
def event_limits(t: Tables):
    links = pg.link_rows(t.pages).withColumn("site", F.regexp_extract("url", "://([^/]+)", 1))
    return records.at_most(links, "page_id", "site", "place", 2, 3).groupBy("page_id").agg(F.count("*").alias("n"))


def _hits(t: Tables):
    k = F.col("page_id") % 6
    u = F.when(k == 0, "https://rusprofile.ru/id").when(k == 1, F.concat(F.lit("https://vk.com/club"), "page_id")).when(k == 2, "broken").otherwise(F.col("url"))
    return t.pages.select("page_id", (F.col("page_id") % 40).alias("org"), u.alias("url"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.lit("").alias("snippet"), (F.col("page_id") % 7 + 1).alias("position"), F.concat(F.lit("Site "), F.split_part("url", F.lit("."), F.lit(1))).alias("org_title"))


@query("j15_discovered_sources", "SELECT page_id % 40 AS org, count(*) FILTER (WHERE page_id % 6 = 1) AS social, count(*) FILTER (WHERE page_id % 6 = 0) AS directory, count(*) FILTER (WHERE page_id % 6 = 2) AS invalid, count(*) FILTER (WHERE page_id % 6 > 2) AS others FROM pages GROUP BY 1")
def discovered_sources(t: Tables):
    n = reviews.discovery_counts(reviews.discovered(_hits(t)), "org")
    return n.select("org", "social", "directory", "invalid", (F.col("official") + F.col("weak")).alias("others"))


@query("w5_best_replacement", f"""
WITH h AS (SELECT page_id % 31 AS org, u, CAST(page_id % 50 AS DOUBLE) AS score, page_id AS position, page_id % 7 <> 0 AS ok FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://2gis.ru/' || page_id WHEN page_id % 9 = 0 THEN 'broken' ELSE 'https://site' || page_id || '.ru/' END AS u FROM pages)),
v AS (SELECT *, position % 2 = 0 AS own, {HOST} = '2gis.ru' AS dir, row_number() OVER (PARTITION BY org, position % 2 = 0 ORDER BY score DESC, position) AS n FROM h WHERE u <> 'broken'),
b AS (SELECT org, own, min_by(u, n) AS u, min_by(score, n) AS score, min_by(dir, n) AS dir FROM v WHERE n <= 3 AND score >= 20 AND ok GROUP BY 1, 2),
j AS (SELECT coalesce(a.org, f.org) AS org, a.u AS au, a.score AS asc_, f.u AS fu, f.score AS fs, (a.org IS NULL OR a.dir) AND f.org IS NOT NULL AND NOT coalesce(f.dir, TRUE) AS sw FROM (SELECT * FROM b WHERE own) a FULL JOIN (SELECT * FROM b WHERE NOT own) f ON a.org = f.org)
SELECT org, CASE WHEN sw THEN fu ELSE au END AS url, CASE WHEN sw THEN fs ELSE asc_ END AS score, sw AS from_fallback FROM j WHERE sw OR au IS NOT NULL""")
def best_replacement(t: Tables):
    k = F.col("page_id")
    u = F.when(k % 4 == 0, F.concat(F.lit("https://2gis.ru/"), s(k))).when(k % 9 == 0, "broken").otherwise(F.concat(F.lit("https://site"), s(k), F.lit(".ru/")))
    hits = t.pages.select((k % 31).alias("org"), u.alias("url"), (k % 50).cast("double").alias("score"), k.alias("position"), (k % 7 != 0).alias("reachable"))
    return reviews.best_replacement(hits.filter("position % 2 = 0"), hits.filter("position % 2 = 1"), "org")


@query("m7_suggested_terms", """
WITH o AS (SELECT o_custkey AS owner, o_orderpriority AS dictionary, o_orderstatus AS term, 'old' AS reasoning, 'done' AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
n AS (SELECT o_custkey AS owner, o_orderpriority AS dictionary, o_orderstatus AS term, 'r' || o_orderkey AS reasoning FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey DESC) = 1)
SELECT coalesce(n.owner, o.owner) AS owner, coalesce(n.dictionary, o.dictionary) AS dictionary, coalesce(n.term, o.term) AS term, coalesce(n.reasoning, o.reasoning) AS reasoning, CASE WHEN n.owner IS NULL THEN o.status ELSE 'pending' END AS status
FROM o FULL JOIN n ON o.owner = n.owner AND o.dictionary = n.dictionary AND o.term = n.term""")
def suggested(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("dictionary"), F.col("o_orderstatus").alias("term"), F.col("o_orderkey").alias("seq"))
    old = rows.filter("seq % 2 = 0").select("owner", "dictionary", "term").distinct().withColumn("reasoning", F.lit("old")).withColumn("status", F.lit("done"))
    new = rows.filter("seq % 2 = 1").withColumn("reasoning", F.concat(F.lit("r"), s(F.col("seq")))).withColumn("term", F.when(F.col("seq") % 7 != 0, F.col("term")).otherwise(""))
    return reviews.suggested_terms(old, new, "seq")


@query("m8_dictionary_upsert", "WITH k AS (SELECT p_partkey AS code, p_name FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0) SELECT a.code, CASE WHEN a.code % 3 = 0 THEN upper(a.p_name) ELSE a.p_name END AS name, b.code AS parent_code FROM k a LEFT JOIN k b ON a.code % 3 = 0 AND a.code // 3 = b.code")
def dictionary(t: Tables):
    k = F.col("p_partkey")
    old = t.part.filter("p_partkey % 3 = 0 or p_partkey % 2 = 0").select(k.alias("code"), F.col("p_name").alias("name"), F.lit(None).cast("long").alias("parent_code"))
    new = t.part.filter("p_partkey % 3 = 0").select(k.alias("code"), F.upper("p_name").alias("name"), F.floor(k / 3).alias("parent_code"))
    return reviews.dictionary_upsert(old, new)


@query("m9_reviewed_patches", """
WITH items AS (SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://new.example/' || (page_id % 7) WHEN 2 THEN url ELSE 'https://own.example/' || page_id END AS u FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id + 1000000000, 'https://x.example/' FROM pages WHERE page_id % 50 = 1),
src AS (SELECT page_id AS id, page_id % 40 AS owner, url FROM pages),
j AS (SELECT i.id, i.u, s.owner, s.url FROM items i LEFT JOIN src s ON i.id = s.id)
SELECT id AS source_id, url AS old_url, u AS new_url, CASE WHEN u IS NULL THEN 'skipped' WHEN owner IS NULL THEN 'error' WHEN EXISTS (SELECT 1 FROM src x WHERE x.owner = j.owner AND x.url = j.u AND x.id <> j.id) OR EXISTS (SELECT 1 FROM j y WHERE y.owner = j.owner AND y.u = j.u AND y.id < j.id) THEN 'deduped' ELSE 'applied' END AS status FROM j""")
def reviewed(t: Tables):
    k = F.col("page_id")
    sources = t.pages.select(k.alias("source_id"), (k % 40).alias("owner"), "url")
    edited = F.when(k % 5 == 2, F.col("url"))
    verified = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat(F.lit("https://new.example/"), s(k % 7))).otherwise(F.concat(F.lit("https://own.example/"), s(k)))
    sheet = t.pages.select(k.alias("source_id"), verified.alias("verified_url"), edited.alias("edited_url"), (k % 3 != 0).alias("approved"))
    strange = t.pages.filter("page_id % 50 = 1").select((k + 1000000000).alias("source_id"), F.lit("https://x.example/"), F.lit(None).cast("string"), F.lit(True))
    return reviews.review_applied(sources, reviews.review_sheet(sheet.union(strange)))


@query("m13_card_batch", """
SELECT c_custkey AS id, '10' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS inn, coalesce(s_name, c_name) AS title, CASE WHEN s_suppkey IS NOT NULL AND c_custkey % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS n_phones, r_name AS region_name,
  CASE WHEN d IS NULL THEN 'errors' WHEN d = 'accepted' THEN 'accepted' ELSE 'rejected' END AS outcome
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN region ON r_regionkey = c_nationkey % 7
LEFT JOIN (SELECT user_id, CASE WHEN max_by(event_type, event_id) = 'purchase' THEN 'accepted' ELSE 'no' END AS d FROM events GROUP BY 1) ON user_id = c_custkey""")
def card_batch(t: Tables):
    inn = lambda c: F.concat(F.lit("10"), F.lpad(s(c), 8, F.lit("0")))
    phone = lambda c: F.array(F.concat(F.lit("+7 900 "), F.lpad(s(c), 7, F.lit("0"))))
    names = t.region.select(F.col("r_regionkey").alias("_r"), F.lower("r_name").alias("region"))
    cards = t.customer.join(names, F.col("_r") == F.col("c_nationkey") % 7, "left").select(F.col("c_custkey").alias("id"), F.concat(F.lit("ИНН "), inn(F.col("c_custkey"))).alias("inn"), F.col("c_name").alias("title"), phone(F.col("c_custkey")).alias("phones"), "region")
    supp = F.col("s_suppkey")
    directory = t.supplier.select(inn(supp).alias("inn"), F.col("s_name").alias("title"), F.when(supp % 2 == 0, phone(supp)).otherwise(phone(supp + 5000000)).alias("phones"))
    answers = t.events.select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("no").alias("decision"), F.col("event_id").alias("seq"))
    out = reviews.enriched_cards(cards, directory, answers, t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("position")))
    return out.select("id", "inn", "title", F.size("phones").cast("long").alias("n_phones"), "region_name", "outcome")


@query("r2_daily_dispatch", f"SELECT event_id AS source_id, CASE event_id % 4 WHEN 0 THEN 'empty_url' WHEN 1 THEN 'missing_scheme' ELSE '' END AS problem FROM events WHERE event_type <> 'error' AND (event_id % 5 = 0 OR ts + to_days(CAST(event_id % 9 AS INTEGER)) <= TIMESTAMP '{AS_OF}')")
def daily_dispatch(t: Tables):
    k = F.col("event_id")
    u = F.when(k % 4 == 0, " ").when(k % 4 == 1, "site.ru").otherwise(F.concat(F.lit("https://site"), s(k), F.lit(".ru/")))
    rows = t.events.select(k.alias("source_id"), u.alias("base_url"), F.col("user_id").alias("organizer_id"), F.when(k % 5 != 0, F.col("ts")).alias("last_crawled_at"), (k % 9).cast("int").alias("crawl_period_days"), (F.col("event_type") != "error").alias("is_active"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return reviews.dispatch(rows, F.lit(AS_OF).cast("timestamp_ntz")).select("source_id", "problem")


@query("p16_card_sections", "SELECT c_custkey, c_name || chr(10) || 'x' AS goals, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS geography, CAST(1000000000 + c_custkey AS VARCHAR) AS tax_id, 'https://s' || c_custkey || '.ru/' AS site FROM customer")
def card_sections(t: Tables):
    place = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n## География проекта:\n"), "c_mktsegment")).otherwise("")
    text = F.concat(F.lit("# Проект\n## Цели проекта\n"), "c_name", F.lit("\nx"), place, F.lit("\n**Контакты**\nСайт: https://s"), s(F.col("c_custkey")), F.lit(".ru/)\nИНН: "), s(F.col("c_custkey") + 1000000000))
    return t.customer.select("c_custkey", cd.card(text).alias("c")).select("c_custkey", "c.goals", "c.geography", "c.tax_id", "c.site")


@query("p18_platform_pages", f"SELECT page_id, 'Центр ' || page_id || ' второй' AS title, 'Центр' AS short_title, '644000, г. Омск, ул. Мира, ' || page_id AS address_raw, 'Имя ' || page_id AS director, 'a' || page_id || '@b.ru' AS emails, 'https://vk.com/c' || page_id AS vk_url FROM (SELECT page_id, {HOST.replace('u,', 'url,')} AS h FROM pages) WHERE h LIKE '%.example.org'")
def platform_pages(t: Tables):
    k = s(F.col("page_id"))
    text = F.concat(
        F.lit("[![logo](x)](y)\n\n[меню](z)\nЦентр "), k, F.lit("\nвторой\n[версия](v)\n**Директор:** Имя "), k, F.lit("\n## Контакты\n\n**Адрес:** 644000, г. Омск\nул. Мира, "), k,
        F.lit("\n\nПочта a"), k, F.lit("@b.ru, x@example.org https://vk.com/c"), k, F.lit("\n© «Центр» . 2024"),
    )
    rows = t.pages.filter(urls.url_host(F.col("url")).endswith(".example.org")).select("page_id", cd.platform_page(text, "example.org").alias("p"))
    return rows.select("page_id", "p.title", "p.short_title", "p.address_raw", "p.director", F.array_join("p.emails", ",").alias("emails"), "p.vk_url")
