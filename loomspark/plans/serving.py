"""Catalogue serving, ranking, joins and reports on the star schema and events.

Organisations are customers or suppliers, venues are nations and derived
points, sources and organisers are orders and line items, and results are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import dates, rules, urls
from loomspark.operators import grouping as g
from loomspark.operators import matching, merging, reports

from .registry import Tables, query

AS_OF = "2024-01-18 12:00:00"
POINT = "55.0 + (c_custkey % 97) / 100.0 AS lat, 37.0 + (c_custkey % 89) / 50.0 AS lon"


def metres(lat0: str, lon0: str, lat: str, lon: str) -> str:
    """SQL for the great-circle distance."""
    return f"2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({lat} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat})) * pow(sin(radians({lon} - {lon0}) / 2), 2), 1.0)))"


def _points(t: Tables):
    return t.customer.select("c_custkey", (55.0 + (F.col("c_custkey") % 97) / 100.0).cast("double").alias("lat"), (37.0 + (F.col("c_custkey") % 89) / 50.0).cast("double").alias("lon"))


@query("f10_f12_facets", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 AND (r_name = 'EUROPE' OR n_name = 'NATION_3') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def facets(t: Tables):
    where = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter((F.col("r_name") == "EUROPE") | (F.col("n_name") == "NATION_3")).select(F.col("n_nationkey").alias("c_nationkey"))
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    shown = t.customer.filter("c_acctbal > 0").join(where, "c_nationkey", "left_semi").select("c_custkey")
    shown = shown.join(orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "c_custkey", "left_semi")
    return shown.join(orders.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi")


@query("f11_city_facet", "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS city, CAST(c_nationkey AS VARCHAR) || '-x' AS fias FROM customer) WHERE city IN ('2', '19') OR (city IS NULL AND (fias LIKE '2%' OR fias LIKE '19%'))")
def city_facet(t: Tables):
    v = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string")).alias("city"), F.concat(F.col("c_nationkey").cast("string"), F.lit("-x")).alias("fias"))
    return v.filter(F.col("city").isin("2", "19") | (F.col("city").isNull() & (F.col("fias").startswith("2") | F.col("fias").startswith("19")))).select("c_custkey")


@query("f13_geo_radius", f"SELECT c_custkey FROM (SELECT c_custkey, {POINT} FROM customer) WHERE {metres('55.5', '37.6', 'lat', 'lon')} <= 25000")
def geo_radius(t: Tables):
    return _points(t).filter(rules.in_radius(F.col("lat"), F.col("lon"), 55.5, 37.6, 25.0)).select("c_custkey")


@query("f13_geo_pairs", f"WITH p AS (SELECT c_custkey, {POINT} FROM customer), c AS (SELECT c_custkey AS centre_id, lat AS lat0, lon AS lon0 FROM p WHERE c_custkey % 20 = 0) SELECT c_custkey AS point_id, centre_id FROM p, c WHERE {metres('lat0', 'lon0', 'lat', 'lon')} <= 10000")
def geo_pairs(t: Tables):
    p = _points(t).withColumnRenamed("c_custkey", "point_id")
    return matching.geo_pairs(p, p.filter("point_id % 20 = 0").withColumnRenamed("point_id", "centre_id"), 10.0).select("point_id", "centre_id")


@query("f14_time_frames", f"SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-18' THEN 'today' WHEN CAST(ts AS DATE) = DATE '2024-01-19' THEN 'tomorrow' WHEN date_trunc('week', ts) = date_trunc('week', TIMESTAMP '{AS_OF}') THEN 'this_week' WHEN date_trunc('month', ts) = date_trunc('month', TIMESTAMP '{AS_OF}') THEN 'this_month' END AS frame FROM events WHERE ts >= TIMESTAMP '{AS_OF}'")
def time_frames(t: Tables):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    day = F.col("ts").cast("date")
    frame = (
        F.when(day == F.to_date(now), "today").when(day == F.date_add(F.to_date(now), 1), "tomorrow")
        .when(F.date_trunc("week", "ts") == F.date_trunc("week", now), "this_week").when(F.date_trunc("month", "ts") == F.date_trunc("month", now), "this_month")
    )
    return t.events.filter(F.col("ts") >= now).select("event_id", frame.alias("frame"))


@query("f15_f16_incomplete", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 OR nullif(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END, '') IS NULL OR regexp_matches(CAST(s_suppkey AS VARCHAR) || '.1.24', '^\\d{1,2}\\.\\d{1,2}\\.\\d{2,4}$') AND s_suppkey > 90")
def incomplete(t: Tables):
    name = F.nullif(F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")), F.lit(""))
    dated = F.concat(F.col("s_suppkey").cast("string"), F.lit(".1.24")).rlike(r"^\d{1,2}\.\d{1,2}\.\d{2,4}$")
    return t.supplier.filter((F.col("s_acctbal") < 0) | name.isNull() | (dated & (F.col("s_suppkey") > 90))).select("s_suppkey")


@query("f17_event_policy", "SELECT event_id FROM events WHERE lower(event_type) IN ('view', 'signup') AND NOT coalesce(value > 50, false)")
def event_policy(t: Tables):
    return t.events.filter(F.lower("event_type").isin("view", "signup") & ~F.coalesce(F.col("value") > 50, F.lit(False))).select("event_id")


@query("f20_f22_search", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name ILIKE '%ation_1%' AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')")
def name_search(t: Tables):
    rows = t.supplier.join(t.nation.filter(F.col("n_name").ilike("%ation_1%")), F.col("s_nationkey") == F.col("n_nationkey"))
    sold = t.lineitem.filter("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_suppkey").alias("s_suppkey"))
    return rows.join(sold, "s_suppkey", "left_semi").select("s_suppkey", "n_name")


@query("f21_l1_due_queue", f"SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS last, CAST(event_id % 9 AS INTEGER) AS period, ts FROM events WHERE event_type <> 'error') WHERE last IS NULL OR last + to_days(period) <= TIMESTAMP '{AS_OF}' ORDER BY last ASC NULLS FIRST, ts DESC, event_id LIMIT 500")
def due_queue(t: Tables):
    s = t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("last_crawled_at"), (F.col("event_id") % 9).cast("int").alias("crawl_period_days"), "ts", (F.col("event_type") != "error").alias("is_active"), F.lit(None).cast("timestamp").alias("deleted_at"), F.col("user_id").alias("organizer_id"))
    due = merging.due_sources(s, F.lit(AS_OF).cast("timestamp_ntz"))
    return due.orderBy(F.asc_nulls_first("last_crawled_at"), F.desc("ts"), "event_id").limit(500).select("event_id")


@query("l2_page_and_meta", "SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40), (SELECT count(*) AS total, 3 AS page, 20 AS per_page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS last_page FROM orders)")
def page_and_meta(t: Tables):
    meta = g.page_meta(t.orders, 3, 20).withColumn("_one", F.lit(1))
    return g.page_of(t.orders, ["o_totalprice", "o_orderkey"], 3, 20).select("o_orderkey", F.lit(1).alias("_one")).join(meta, "_one").drop("_one")


@query("l3_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def sliced(t: Tables):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@query("l4_seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 60")
def seeded_sample(t: Tables):
    return g.sample_rows(t.customer, "c_custkey", 60, 42).select("c_custkey")


@query("j1_match_or_create", "WITH k AS (SELECT min(s_suppkey) AS id, s_name AS ref, s_nationkey AS nat FROM supplier GROUP BY s_name, s_nationkey), a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS ref, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS nat FROM customer) SELECT c_custkey, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_name = a.ref), (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = a.nat)) AS matched_id, CASE WHEN coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_name = a.ref), (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = a.nat)) IS NULL THEN 'created' ELSE 'matched' END AS action FROM a")
def match_or_create(t: Tables):
    ref = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    rows = t.customer.select("c_custkey", ref.alias("ref"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nat"))
    known = t.supplier.select("s_suppkey", F.col("s_name").alias("ref"), F.col("s_nationkey").alias("nat"))
    return matching.match_or_create(rows, known, ["ref", "nat"], "s_suppkey").select("c_custkey", "matched_id", "action")


@query("j3_without_sources", "SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48)")
def without_sources(t: Tables):
    big = t.lineitem.filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    busy = t.orders.join(big, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    return t.customer.select("c_custkey").join(busy, "c_custkey", "left_anti").join(first, "c_custkey", "left")


@query("j4_polymorphic_parent", "SELECT event_id, CASE event_id % 2 WHEN 0 THEN c_name ELSE s_name END AS parent FROM events LEFT JOIN customer ON event_id % 2 = 0 AND user_id = c_custkey LEFT JOIN supplier ON event_id % 2 = 1 AND user_id = s_suppkey")
def polymorphic_parent(t: Tables):
    kind = F.when(F.col("event_id") % 2 == 0, "organization").otherwise("person")
    owners = t.customer.select(F.lit("organization").alias("kind"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("parent")).union(t.supplier.select(F.lit("person"), "s_suppkey", "s_name"))
    return t.events.select("event_id", "user_id", kind.alias("kind")).join(owners, ["kind", "user_id"], "left").select("event_id", "parent")


@query("j8_j9_dictionary_codes", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dictionary_codes(t: Tables):
    tree = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.supplier.join(tree, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j10_uniqueness_guard", "SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1")
def uniqueness_guard(t: Tables):
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg((F.min("l_orderkey") < F.max("l_orderkey")).alias("clash")).filter("clash").select("l_suppkey", "l_partkey")


@query("j11_fuzzy_dictionary", """
WITH d AS (SELECT r_name AS name, r_regionkey AS pos, trim(regexp_replace(lower(r_name), '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS b FROM region),
t AS (SELECT DISTINCT term, trim(regexp_replace(lower(term), '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS b FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'asia!' WHEN 1 THEN 'north america' WHEN 2 THEN 'EUROPE' ELSE c_mktsegment END AS term FROM customer))
SELECT term, (SELECT name FROM d WHERE t.term = d.name OR (t.b <> '' AND d.b <> '' AND (contains(t.b, d.b) OR contains(d.b, t.b))) ORDER BY t.term <> d.name, pos LIMIT 1) AS match FROM t""")
def fuzzy_dictionary(t: Tables):
    k = F.col("c_custkey") % 4
    terms = t.customer.select(F.when(k == 0, "asia!").when(k == 1, "north america").when(k == 2, "EUROPE").otherwise(F.col("c_mktsegment")).alias("term"))
    return matching.dictionary_match(terms, "term", t.region, "r_name", "r_regionkey")


@query("j12_party_enrichment", "SELECT c_custkey, coalesce(s_name, c_name) AS title, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS BIGINT) ELSE CAST(s_acctbal AS BIGINT) END AS contact FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def party_enrichment(t: Tables):
    out = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return out.select("c_custkey", F.coalesce("s_name", "c_name").alias("title"), F.bround(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.col("s_acctbal"))).cast("long").alias("contact"))


@query("j14_two_hop_ids", "SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_returnflag = 'A'")
def two_hops(t: Tables):
    return t.lineitem.filter("l_linenumber = 1 and l_returnflag = 'A'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()


@query("j16_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def resume(t: Tables):
    return t.orders.select("o_orderkey").join(t.events.select(F.col("event_id").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("j17_nested_cards", "SELECT c_custkey, n_name, coalesce(orders, '') AS orders, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def nested_cards(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    out = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, "c_custkey", "left")
    text = F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",")
    return out.select("c_custkey", "n_name", F.coalesce(text, F.lit("")).alias("orders"), F.when(F.col("o").isNull(), 0).otherwise(F.size("o")).cast("long").alias("n_orders"))


@query("j19_related", "SELECT a.p_partkey AS part, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey GROUP BY 1")
def related(t: Tables):
    sizes = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("k"))
    return t.part.join(sizes, ["p_brand", "p_type"]).filter("k > 1").select(F.col("p_partkey").alias("part"), (F.col("k") - 1).alias("n"))


@query("w2_first_venue", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderkey) = 1")
def first_venue(t: Tables):
    return g.first_per(t.orders, ["o_custkey"], [(F.col("o_orderstatus") == "F").desc(), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w3_top_n", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5")
def top_n(t: Tables):
    return g.first_per(t.orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 5).select("o_custkey", "o_orderkey")


@query("w4_best_verified", "SELECT user_id, event_id FROM events WHERE event_type <> 'error' AND value >= 6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, value DESC, event_id) = 1")
def best_verified(t: Tables):
    ok = t.events.filter((F.col("event_type") != "error") & (F.col("value") >= 6))
    return g.first_per(ok, ["user_id"], [(F.col("event_type") == "purchase").desc(), F.desc("value"), "event_id"]).select("user_id", "event_id")


@query("w6_early_stop", "SELECT user_id, event_id FROM (SELECT user_id, event_id, coalesce(max(CASE WHEN event_type = 'purchase' AND value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE b = 0 AND n <= 10")
def early_stop(t: Tables):
    return g.early_stop(t.events, "user_id", "event_id", (F.col("event_type") == "purchase") & (F.col("value") > 20), 10).select("user_id", "event_id")


@query("w11_new_codes", "WITH k AS (SELECT DISTINCT p_name FROM part), o AS (SELECT p_name, min(p_partkey) AS code FROM part WHERE p_partkey < 30 GROUP BY 1) SELECT k.p_name, coalesce(code, (SELECT max(code) FROM o) + sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY k.p_name)) AS code FROM k LEFT JOIN o ON k.p_name = o.p_name")
def new_codes(t: Tables):
    old = t.part.filter("p_partkey < 30").groupBy("p_name").agg(F.min("p_partkey").alias("code"))
    new = g.numbered(t.part.select("p_name").distinct().join(old, "p_name", "left_anti"), "p_name", "_n")
    top = old.agg(F.max("code").alias("top"))
    return old.union(new.join(F.broadcast(top)).select("p_name", F.col("top") + F.col("_n")))


@query("a7_a8_run_metrics", """
SELECT user_id % 7 AS run, count(*) AS total, count(*) FILTER (WHERE ok) AS success, round_even(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 4) AS success_rate,
  count(*) FILTER (WHERE d = 'accepted') AS accepted, count(*) FILTER (WHERE d = 'rejected') AS rejected, count(*) FILTER (WHERE d = 'needs_review') AS needs_review,
  round_even(avg(CASE WHEN ok THEN c END), 4) AS avg_confidence, min(CASE WHEN ok THEN c END) AS min_confidence, max(CASE WHEN ok THEN c END) AS max_confidence,
  round_even((sum(k * 100) * 0.014::DOUBLE + sum(k) * 0.28::DOUBLE) / 1e6::DOUBLE, 6) AS cost, round_even(avg(CASE WHEN value > 0 THEN value END), 4) AS avg_seconds
FROM (SELECT *, event_type <> 'error' AS ok, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'rejected' WHEN 'click' THEN 'needs_review' END AS d,
  (event_id % 128) / 128.0::DOUBLE AS c, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def run_metrics(t: Tables):
    d = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "view", "rejected").when(F.col("event_type") == "click", "needs_review")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select((F.col("user_id") % 7).alias("run"), (F.col("event_type") != "error").alias("ok"), d.alias("decision"), ((F.col("event_id") % 128) / F.lit(128.0)).alias("confidence"), (k * 100).alias("tokens_in"), k.alias("tokens_out"), F.col("value").alias("seconds"))
    return reports.run_metrics(rows, "run")


@query("a9_catalogue_statistics", "SELECT count(*) AS total, count(*) FILTER (WHERE a) AS with_order, count(*) FILTER (WHERE b) AS with_big, count(*) FILTER (WHERE a AND b) AS ideal, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS a, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS b FROM customer)")
def statistics(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    f = reports.flagged(t.customer, "c_custkey", {"a": o.filter("o_orderstatus = 'O'"), "b": o.filter("o_totalprice > 450000")})
    return f.agg(F.count("*").alias("total"), F.count_if("a").alias("with_order"), F.count_if("b").alias("with_big"), F.count_if(F.expr("a and b")).alias("ideal"), F.count_if(F.expr("not a and not b")).alias("neither"))


@query("a11_buckets", "SELECT CASE WHEN a = 0 THEN 'no_organizer' WHEN b = 0 THEN 'no_venue' WHEN b > 1 THEN 'many_venues' WHEN c = 0 THEN 'no_source' WHEN c > 1 THEN 'many_sources' ELSE 'ideal' END AS bucket, count(*) AS n FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS a, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS b, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS c FROM customer) GROUP BY 1")
def buckets(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    n = reports.counted(t.customer, "c_custkey", {"a": o.filter("o_orderstatus = 'O'"), "b": o.filter("o_totalprice > 400000"), "c": o.filter("o_orderpriority = '1-URGENT'")})
    return n.groupBy(reports.bucket(F.col("a"), F.col("b"), F.col("c")).alias("bucket")).agg(F.count("*").alias("n"))


FLAGS = "SELECT s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1) AS a, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_tax < 0.01 AND l_linenumber = 2) AS b, s_acctbal > 5000 AS c FROM supplier"


def _flags(t: Tables):
    li = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    sides = {"a": li.filter("l_quantity > 49 and l_linenumber = 1"), "b": li.filter("l_discount > 0.09 and l_tax < 0.01 and l_linenumber = 2"), "c": t.supplier.filter("s_acctbal > 5000")}
    return reports.flagged(t.supplier, "s_suppkey", sides)


@query("a12_coverage", f"WITH f AS ({FLAGS}) SELECT 'a' AS flag, count(*) FILTER (WHERE a) AS n, round_even(count(*) FILTER (WHERE a) * 100.0::DOUBLE / count(*), 2) AS percent FROM f UNION ALL SELECT 'b', count(*) FILTER (WHERE b), round_even(count(*) FILTER (WHERE b) * 100.0::DOUBLE / count(*), 2) FROM f UNION ALL SELECT 'c', count(*) FILTER (WHERE c), round_even(count(*) FILTER (WHERE c) * 100.0::DOUBLE / count(*), 2) FROM f")
def coverage(t: Tables):
    return reports.coverage(_flags(t), ["a", "b", "c"])


@query("a12_combinations", f"SELECT a, b, c, count(*) AS n FROM ({FLAGS}) GROUP BY ALL ORDER BY n DESC, a, b, c LIMIT 15")
def combinations(t: Tables):
    return reports.combinations(_flags(t), ["a", "b", "c"])


@query("a13_crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def crosstab(t: Tables):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a14_run_counters", "SELECT user_id % 10 AS run, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def run_counters(t: Tables):
    out = t.events.groupBy((F.col("user_id") % 10).alias("run")).pivot("event_type", ["click", "error", "view"]).count()
    return out.na.fill(0)


@query("a15_a16_sessions_summary", "SELECT user_id, count(*) AS queries, count(*) FILTER (WHERE event_type = 'error') AS errors, round_even(avg(value), 3) AS mean_value, CAST(max(event_id) AS BIGINT) AS last_event FROM events GROUP BY 1")
def session_summary(t: Tables):
    return t.events.groupBy("user_id").agg(F.count("*").alias("queries"), F.count_if(F.col("event_type") == "error").alias("errors"), F.bround(F.avg("value"), 3).alias("mean_value"), F.max("event_id").alias("last_event"))


@query("a18_regional_rollup", "SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type, strftime(date_trunc('week', ts), '%Y-%m-%d'))")
def regional_rollup(t: Tables):
    rows = t.events.select("event_type", F.date_trunc("week", "ts").cast("date").cast("string").alias("week"), "user_id")
    return rows.rollup("event_type", "week").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("a19_eav_pivot", "SELECT c_custkey AS post_id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def eav_pivot(t: Tables):
    eav = t.customer.select(F.col("c_custkey").alias("post_id"), F.explode(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("meta_key", "meta_value"))
    return reports.wide(eav, "post_id", "meta_key", "meta_value", ["name", "segment", "nation"])


OLD = "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0)"
NEW = "(SELECT o_custkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS name, o_totalprice AS bal FROM orders WHERE o_custkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"


def _snapshot(t: Tables):
    old = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    batch = t.orders.filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("name"), F.col("o_totalprice").alias("bal"), F.col("o_orderkey").alias("seq"))
    return old, batch


@query("m1_m2_upsert", f"SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.bal ELSE n.bal END AS bal FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def upserted(t: Tables):
    old, batch = _snapshot(t)
    return merging.upsert(old, batch, ["id"], "seq")


@query("m6_m10_patch", f"SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def patched(t: Tables):
    old, batch = _snapshot(t)
    return merging.upsert(old, batch, ["id"], "seq", overwrite_nulls=False)


@query("m3_replace_sets", "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000) UNION ALL SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000")
def replaced_sets(t: Tables):
    pairs = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return merging.replace_sets(pairs.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority"), pairs.filter("o_orderstatus = 'P' and o_totalprice > 400000").select("o_custkey", "o_orderpriority"), "o_custkey")


@query("m4_attach_if_none", "SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice < 100000 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def attached(t: Tables):
    pairs = lambda c: t.orders.filter(c).select("o_custkey", "o_orderpriority")
    return merging.attach_if_none(pairs("o_totalprice > 300000"), pairs("o_totalprice < 100000"), "o_custkey")


@query("m5_insert_missing", "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'A')")
def inserted(t: Tables):
    part = lambda c: t.lineitem.filter(c).select("l_suppkey", "l_partkey")
    return merging.insert_missing(part("l_returnflag = 'A'"), part("l_returnflag = 'R'"), ["l_suppkey", "l_partkey"])


@query("m12_entity_resolution", """
WITH RECURSIVE r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey // 4 END AS a, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey // 20 END AS b FROM supplier),
e AS (SELECT x.id AS u, y.id AS v FROM r x JOIN r y ON x.a = y.a OR x.b = y.b), c AS (SELECT id AS u, id AS v FROM r UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u)
SELECT u AS id, min(v) AS entity FROM c GROUP BY u""")
def entities(t: Tables):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.floor(F.col("s_suppkey") / 4)).alias("a"), F.when(F.col("s_suppkey") % 5 == 0, F.floor(F.col("s_suppkey") / 20)).alias("b"))
    return matching.resolve_entities(rows, "id", ["a", "b"])


@query("m14_cleanup", "SELECT page_id, NOT url ILIKE '%example.com%' AS is_active FROM pages")
def cleanup(t: Tables):
    return t.pages.select("page_id", (~F.col("url").ilike("%example.com%")).alias("is_active"))


@query("m15_duplicate_merge", "SELECT page_id AS id, coalesce(min(page_id) OVER (PARTITION BY h), page_id) AS survivor FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS h FROM pages)")
def duplicates_merged(t: Tables):
    return matching.merge_duplicates(t.pages.select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("h")), "page_id", "h")


@query("p5_date_texts", "SELECT o_orderkey, strftime(d, '%Y-%m-%dT') || '10:30:00+03:00' AS start, strftime(d, '%Y-%m-%dT') || CASE WHEN o_orderkey % 2 = 0 THEN '12:15:00+03:00' ELSE '11:30:00+03:00' END AS \"end\" FROM (SELECT o_orderkey, CASE WHEN year(o_orderdate) < 2000 THEN make_date(2024, month(o_orderdate), day(o_orderdate)) ELSE o_orderdate END AS d FROM orders)")
def date_texts(t: Tables):
    months = F.array(*[F.lit(m) for m in dates.MONTHS_OF])
    rows = t.orders  # years before 2000 are not read as years, so that those dates are in the year of as_of
    day = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), F.get(months, F.month("o_orderdate") - 1), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" года, "))
    text = F.concat(day, F.when(F.col("o_orderkey") % 2 == 0, "10.30 - 12:15 (Мск)").otherwise("в 10:30"))
    return rows.select("o_orderkey", dates.date_text_range(text, F.lit("2024-01-01").cast("date")).alias("r")).select("o_orderkey", "r.start", "r.end")


@query("p7_freshness", "SELECT o_orderkey, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-06-01')) AS days FROM orders")
def freshness(t: Tables):
    months = F.array(*[F.lit(m) for m in dates.MONTHS_OF])
    text = F.concat(F.lit("Новости: "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), F.get(months, F.month("o_orderdate") - 1), F.lit(" "), F.year("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", dates.freshness_days(text, F.lit("2000-06-01").cast("date")).cast("long").alias("days"))


@query("p27_p28_hit_scores")
def hit_scores(t: Tables):
    hits = t.pages.select("page_id", "url", (F.col("page_id") % 7 + 1).alias("position"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    fragment = urls.domain_fragment(F.col("url"))
    repair = urls.repair_score(F.col("url"), F.col("title"), F.lit(""), F.col("position"), fragment, F.col("title"))
    return hits.select("page_id", repair["score"].alias("repair"), repair["reason"].alias("reason"), urls.official_score(F.col("url"), F.col("title"), F.lit(""), F.col("position"), F.col("title")).alias("official"))


@query("r1_occurrences", """
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS s, 1 + event_id % 2 AS every, CASE WHEN event_id % 3 = 0 THEN 6 END AS cnt FROM events),
d AS (SELECT e.*, CAST(unnest(generate_series(s, DATE '2024-04-14', INTERVAL 1 DAY)) AS DATE) AS day FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY day) AS n FROM d WHERE date_diff('day', CAST(date_trunc('week', s) AS DATE), day) // 7 % every = 0 AND isodow(day) IN (2, 4))
SELECT event_id, CAST(day AS VARCHAR) AS start_date FROM k WHERE (cnt IS NULL OR n <= cnt) AND day >= DATE '2024-01-15'""")
def occurrences(t: Tables):
    return _occurrences(t.events)


@query("r1_all_occurrences")
def all_occurrences(t: Tables):
    return _occurrences(t.events)


def _occurrences(events: DataFrame) -> DataFrame:
    rule = F.concat(F.lit("FREQ=WEEKLY;INTERVAL="), (1 + F.col("event_id") % 2).cast("string"), F.lit(";BYDAY=TU,TH"), F.when(F.col("event_id") % 3 == 0, ";COUNT=6").otherwise(""))
    rows = events.select("event_id", F.col("ts").cast("date").alias("start_date"), rule.alias("rule"))
    return merging.occurrences(rows, F.lit("2024-01-15").cast("date"), 90).select("event_id", F.col("start_date").cast("string"))


@query("x4_sessions")
def batch_sessions(t: Tables):
    from loomspark.streaming import jobs

    return jobs.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", gap="6 hours")
