"""Registry funnels: filters, entities, roll-ups, overlaps.

Entities are suppliers with their line items joined to parts, and customers
with their orders; codes and keywords are bound to those tables' values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import grouping as g

from .registry import Tables, query

CODE, WORDS = "CAST(split_part(p_brand, '#', 2) AS INTEGER) IN (7, 8)", "regexp_matches(p_name, '(?i)widget|ring')"
LINES = "lineitem JOIN part ON l_partkey = p_partkey"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _lines(t: Tables):
    lines = t.lineitem.select(*ORDER, "l_suppkey", "l_returnflag").join(t.part.select("p_partkey", "p_brand", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    code = F.split_part("p_brand", F.lit("#"), F.lit(2)).isin("7", "8")
    return lines, code, F.col("p_name").rlike("(?iuU)widget|ring")


@query("f1_registry_funnel", f"SELECT l_suppkey, count(*) AS n_rows, count(DISTINCT p_brand) AS n_brands, min(l_orderkey) AS first_order FROM {LINES} WHERE l_suppkey IN (SELECT l_suppkey FROM {LINES} WHERE {CODE} AND p_name LIKE 'small%' AND l_returnflag = 'R' AND l_linenumber = 1 OR p_name = 'red widget' AND l_linenumber = 2 AND l_returnflag = 'A') GROUP BY l_suppkey")
def funnel_entities(t: Tables):
    lines, code, _ = _lines(t)
    by_code = code & F.col("p_name").startswith("small") & (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    by_name = (F.col("p_name") == "red widget") & (F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "A")
    kept = g.keep_entities(lines, "l_suppkey", by_code | by_name)
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.count_distinct("p_brand").alias("n_brands"), F.min("l_orderkey").alias("first_order"))


@query("f1_code_prefix", f"SELECT p_partkey, p_brand FROM part WHERE {CODE}")
def code_prefix(t: Tables):
    return t.part.filter(F.split_part("p_brand", F.lit("#"), F.lit(2)).isin("7", "8")).select("p_partkey", "p_brand")


@query("f2_name_keywords", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)WIDGET|r[i]ng')")
def name_keywords(t: Tables):
    return t.part.filter(F.col("p_name").rlike("(?iuU)WIDGET|r[i]ng")).select("p_partkey", "p_name")


@query("f3_f4_f5_project_filters", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND lower(o_orderstatus) NOT LIKE '%p%' AND coalesce(o_orderpriority NOT IN ('2-HIGH'), true) AND regexp_matches(CAST(o_orderkey AS VARCHAR), '7|13')")
def project_filters(t: Tables):
    kept = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    kept = kept.filter(~F.lower("o_orderstatus").contains("p") & F.coalesce(~F.col("o_orderpriority").isin("2-HIGH"), F.lit(True)))
    return kept.filter(F.col("o_orderkey").cast("string").rlike("7|13")).select("o_orderkey", "o_custkey")


@query("a1_group_rows", f"SELECT l_suppkey, arg_min(p_name, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_extendedprice)) AS p_name, count(*) AS n_rows, min(l_orderkey) AS first_order FROM {LINES} GROUP BY l_suppkey")
def group_rows(t: Tables):
    lines, _, _ = _lines(t)
    return g.grouped_entities(lines, "l_suppkey", ORDER, ["p_name"]).select("l_suppkey", "p_name", "n_rows", F.col("_at.l_orderkey").alias("first_order"))


@query("a2_group_by_id_or_name", "SELECT key, count(*) AS n_rows, min(o_orderkey) AS first_order FROM (SELECT coalesce(nullif(CASE WHEN o_custkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END, ''), c_name) AS key, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY key")
def group_by_id_or_name(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("key", g.entity_key(F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.col("o_custkey").cast("string")), F.col("c_name")))
    return g.grouped_entities(rows, "key", ["o_orderkey"], ["c_name"]).select("key", "n_rows", F.col("_at.o_orderkey").alias("first_order"))


@query("a3_group_by_name", "SELECT coalesce(nullif(lower(trim(c_mktsegment)), ''), c_name) AS key, count(*) AS n_rows, min(c_custkey) AS first_row FROM customer GROUP BY 1")
def group_by_name(t: Tables):
    rows = t.customer.withColumn("key", g.entity_key(F.lower(F.trim("c_mktsegment")), F.col("c_name")))
    return g.grouped_entities(rows, "key", ["c_custkey"], ["c_name"]).select("key", "n_rows", F.col("_at.c_custkey").alias("first_row"))


@query("a4_rollups", """
SELECT o_custkey, bool_or(o_orderstatus = 'F') AS has_winner,
  arg_max(o_orderkey, struct_pack(w := CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, a := o_totalprice, b := -o_orderkey)) AS best_order,
  array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS directions FROM orders GROUP BY o_custkey""")
def rollups(t: Tables):
    won = F.col("o_orderstatus") == "F"
    best = g.best_member(won, F.col("o_totalprice"), F.col("o_totalprice"), ["o_orderkey"], F.col("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.bool_or(won).alias("has_winner"), best.alias("best_order"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("directions"))


@query("a5_funnel_counts", f"SELECT count(*) AS total_rows, count(DISTINCT l_suppkey) AS total_entities, count(*) FILTER (WHERE {CODE}) AS code_rows, count(DISTINCT l_suppkey) FILTER (WHERE {CODE}) AS code_entities, count(*) FILTER (WHERE {CODE} AND {WORDS}) AS name_rows, count(DISTINCT l_suppkey) FILTER (WHERE {CODE} AND {WORDS}) AS name_entities FROM {LINES}")
def funnel_counts(t: Tables):
    lines, code, words = _lines(t)
    return g.funnel(lines, [("code", code), ("name", words)], "l_suppkey")


@query("a5_breakdown", f"SELECT split_part(p_brand, '#', 2) AS code, count(*) AS n, count(DISTINCT l_suppkey) AS entities FROM {LINES} GROUP BY 1")
def breakdown(t: Tables):
    lines, _, _ = _lines(t)
    return lines.groupBy(F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("code")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("entities"))


@query("a6_overlap", "SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_first, count(*) FILTER (WHERE b AND NOT a) AS only_second FROM (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT' AND o_totalprice > 400000) AS a, bool_or(o_orderstatus = 'F' AND o_totalprice < 50000) AS b FROM orders GROUP BY 1)")
def overlap(t: Tables):
    return g.overlap(t.orders, "o_custkey", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000))


@query("u1_entity_union", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000 UNION SELECT o_custkey FROM orders WHERE o_totalprice < 5000)")
def entity_union(t: Tables):
    return g.keep_entities(t.orders, "o_custkey", (F.col("o_totalprice") > 490000) | (F.col("o_totalprice") < 5000)).select("o_orderkey", "o_custkey")


@query("u2_reject_minus_review", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000")
def difference(t: Tables):
    big = t.orders.filter("o_totalprice > 300000")
    return big.filter("o_orderstatus = 'P'").select("o_custkey").join(big.filter("o_orderstatus = 'O'").select("o_custkey"), "o_custkey", "left_anti").distinct()


@query("u3_union_log", "SELECT 'organization' AS kind, s_suppkey AS id, s_name AS title, CAST(NULL AS DOUBLE) AS value FROM supplier UNION ALL SELECT 'event', event_id, event_type, value FROM events")
def union_log(t: Tables):
    a = t.supplier.select(F.lit("organization").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    b = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("title"), "value")
    return a.unionByName(b, allowMissingColumns=True)


@query("u4_intersection", "SELECT o_custkey FROM orders WHERE o_totalprice > 450000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice < 20000")
def intersection(t: Tables):
    return g.in_both(t.orders, "o_custkey", F.col("o_totalprice") > 450000, F.col("o_totalprice") < 20000)


@query("a17_context_text", "SELECT o_custkey, 'Organisation ' || o_custkey || chr(10) || array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') || chr(10) || array_to_string((list('#' || o_orderkey ORDER BY o_orderkey))[1:5], '; ') AS context FROM orders GROUP BY o_custkey")
def context_text(t: Tables):
    w = g.first_per(t.orders, ["o_custkey"], ["o_orderkey"], 5).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("#"), k.cast("string"))), "; ").alias("firsts"))
    labels = t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ").alias("labels"))
    return w.join(labels, "o_custkey").select("o_custkey", F.concat_ws("\n", F.concat(F.lit("Organisation "), F.col("o_custkey").cast("string")), "labels", "firsts").alias("context"))
