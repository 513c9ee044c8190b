"""Jobs that change several tables: event import, migration, merges, purges, daily instances; and nested reports.

Organisations and organisers are customers, events are orders, dictionaries are nations and regions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import event_import, recurrence
from loomspark.sources.shared import new_folder

from .registry import Tables, query


def s(c):
    return c.cast("string")


# --- event import: two batches of payloads, of which the second updates events of the first

_PAYLOADS = """
p AS (SELECT o_orderkey AS seq, o_orderkey % 2 AS batch, CAST(o_custkey AS VARCHAR) AS organizer_id, 'r' || o_orderkey % 3 AS source_reference, o_orderpriority AS title,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS description, (o_orderkey % 100) / 100.0::DOUBLE AS score,
  CASE o_orderkey % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'needs_review' WHEN 2 THEN NULL ELSE 'accepted' END AS decision, o_orderkey % 3 = 0 AS elderly,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['none'] ELSE [CAST(o_orderkey % 30 AS VARCHAR), 'NATION_' || o_orderkey % 7, 'none'] END AS codes,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS starts, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS ends
  FROM orders WHERE o_orderkey % 11 <> 0),
k AS (SELECT *, md5(organizer_id || chr(10) || source_reference) AS h, row_number() OVER (PARTITION BY organizer_id, source_reference ORDER BY batch DESC, seq DESC) AS n FROM p),
e AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS event_id FROM k)"""


def _event_store(t: Tables):
    """The tables after two batches, the second of which is sent twice."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    codes = F.when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("none"))).when(k % 4 == 3, F.array(s(k % 30), F.concat(F.lit("NATION_"), s(k % 7)), F.lit("none")))
    day = s(F.col("o_orderdate").cast("date"))
    # every eleventh payload has no title, so that it is left out
    rows = t.orders.select(
        k.alias("seq"), s(F.col("o_custkey")).alias("organizer_id"), F.concat(F.lit("r"), s(k % 3)).alias("source_reference"), F.when(k % 11 != 0, F.col("o_orderpriority")).otherwise(" ").alias("title"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("description"), F.lit("offline").alias("attendance_mode"), none.alias("online_url"), none.alias("event_page_url"), none.alias("rrule_string"),
        F.lit(None).cast("array<string>").alias("target_audience"), (k % 100 / F.lit(100.0)).alias("score"), F.when(k % 7 == 0, "rejected").when(k % 7 == 1, "needs_review").when(k % 7 != 2, "accepted").alias("decision"),
        (k % 3 == 0).alias("works_with_elderly"), codes.alias("category_codes"), F.when(k % 2 == 0, F.array(s(k % 9))).alias("venue_ids"), day.alias("start_datetime"), F.when(k % 6 != 0, day).alias("end_datetime"),
    )
    owners = t.customer.select(s(F.col("c_custkey")).alias("organizer_id"), F.when(F.col("c_custkey") % 2 == 0, s(F.col("c_custkey") + 1000)).alias("organization_id"))
    categories = t.nation.select(s(F.col("n_nationkey") + 500).alias("category_id"), s(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("slug"))
    at = event_import.store(t.spark, new_folder(t.spark, "events"), buckets=16)
    for epoch in (0, 1, 1):
        event_import.import_batch(at, epoch, rows.filter(F.col("seq") % 2 == epoch), owners, categories)
    return at


@query("m2_events", f"""
WITH {_PAYLOADS}
SELECT event_id, organizer_id, source_reference, CASE WHEN CAST(organizer_id AS BIGINT) % 2 = 0 THEN CAST(CAST(organizer_id AS BIGINT) + 1000 AS VARCHAR) END AS organization_id, title, description, score,
  CASE WHEN decision = 'rejected' THEN 'rejected' WHEN decision = 'needs_review' THEN 'pending_review' WHEN score >= 0.85 AND elderly THEN 'approved' ELSE 'pending_review' END AS status FROM e WHERE n = 1""")
def imported_events(t: Tables):
    return _event_store(t).read("events").select("event_id", "organizer_id", "source_reference", "organization_id", "title", "description", "score", "status")


@query("m2_event_categories", f"""
WITH {_PAYLOADS}, l AS (SELECT event_id, codes, row_number() OVER (PARTITION BY event_id ORDER BY batch DESC, seq DESC) AS i FROM e WHERE len(codes) > 0),
c AS (SELECT event_id, unnest(codes) AS code FROM l WHERE i = 1)
SELECT DISTINCT event_id, CAST(n_nationkey + 500 AS VARCHAR) AS category_id FROM c JOIN nation ON code = CAST(n_nationkey AS VARCHAR) OR code = n_name""")
def imported_categories(t: Tables):
    return _event_store(t).read("categories")


@query("m2_event_instances", f"WITH {_PAYLOADS} SELECT DISTINCT event_id, starts AS start_datetime, ends AS end_datetime, 'scheduled' AS status FROM e WHERE ends IS NOT NULL")
def imported_instances(t: Tables):
    return _event_store(t).read("instances")


@query("r1_rolling_instances", """
WITH e AS (SELECT event_id, CAST(ts AS DATE) - CAST(event_id * 7 % 1500 AS INTEGER) AS s, event_id % 5 AS kind, 1 + event_id % 3 AS every, CASE WHEN event_id % 5 IN (0, 2, 3) AND event_id % 2 = 0 THEN 40 END AS cnt FROM events),
d AS (SELECT e.*, CAST(unnest(generate_series(s, CASE WHEN kind = 4 THEN DATE '2024-02-01' ELSE DATE '2024-04-15' END, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
f AS (SELECT *, CASE kind WHEN 0 THEN date_diff('day', CAST(date_trunc('week', s) AS DATE), day) // 7 % every = 0 AND isodow(day) IN (2, 4) WHEN 1 THEN date_diff('day', s, day) % every = 0
  WHEN 2 THEN day(day) = day(s) AND ((year(day) - year(s)) * 12 + month(day) - month(s)) % every = 0 WHEN 3 THEN date_diff('day', s, day) % every = 0 AND isodow(day) IN (1, 3, 5)
  ELSE date_diff('day', CAST(date_trunc('week', s) AS DATE), day) // 7 % every = 0 AND isodow(day) = isodow(s) END AS hit FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY day) AS n FROM f WHERE hit)
SELECT event_id, CAST(day AS VARCHAR) AS start_date, day > DATE '2024-04-13' AS added FROM k WHERE (cnt IS NULL OR n <= cnt) AND day >= DATE '2024-01-14'""")
def rolling_instances(t: Tables):
    k = F.col("event_id")
    every = F.concat(F.lit(";INTERVAL="), s(1 + k % 3))
    kind = F.when(k % 5 == 0, F.concat(F.lit("FREQ=WEEKLY;BYDAY=TU,TH"), every)).when(k % 5 == 1, F.concat(F.lit("FREQ=DAILY"), every)).when(k % 5 == 2, F.concat(F.lit("FREQ=MONTHLY"), every))
    kind = kind.when(k % 5 == 3, F.concat(F.lit("FREQ=DAILY;BYDAY=MO,WE,FR"), every)).otherwise(F.concat(F.lit("FREQ=WEEKLY;UNTIL=20240201T235959Z"), every))
    rule = F.concat(kind, F.when((k % 5).isin(0, 2, 3) & (k % 2 == 0), ";COUNT=40").otherwise(""))
    start = F.date_sub(F.col("ts").cast("date"), (k * 7 % 1500).cast("int"))
    rows = t.events.select("event_id", start.alias("start_date"), rule.alias("rule"), F.lit("2024-04-13").cast("date").alias("made_until"))
    none = t.spark.createDataFrame([], "event_id long, start_date date, added boolean")
    first = recurrence.rolled(none, rows, F.lit("2024-01-14").cast("date"), 90).withColumn("added", F.lit(False))
    day = F.lit("2024-01-16").cast("date")  # the job did not run on one day
    out = recurrence.rolled(first, rows, day, 90, "made_until")
    again = recurrence.rolled(out, rows, day, 90, "made_until")
    return again.select("event_id", s(F.col("start_date")).alias("start_date"), F.coalesce("added", F.lit(True)).alias("added"))


# --- legacy migration: listings are customers, whose attributes are (id, key, value) rows

_LISTINGS = r"""
raw AS (SELECT c_custkey AS post_id, c_name, c_mktsegment, c_nationkey, c_acctbal,
  CASE WHEN c_custkey % 11 = 0 THEN '123' WHEN c_custkey % 3 <> 0 THEN '77-' || lpad(CAST(c_custkey // 4 AS VARCHAR), 8, '0') END AS inn,
  CASE WHEN c_custkey % 5 = 0 THEN '1' || lpad(CAST(c_custkey // 20 AS VARCHAR), 12, '0') WHEN c_custkey % 97 = 3 THEN 'none' END AS ogrn FROM customer),
l AS (SELECT *, CASE WHEN inn = '123' THEN 'bad inn' WHEN ogrn = 'none' THEN 'bad ogrn' END AS reason, CASE WHEN inn <> '123' THEN replace(inn, '-', '') END AS tax, nullif(ogrn, 'none') AS reg FROM raw),
g AS (SELECT * FROM l WHERE reason IS NULL)"""
_ENTITIES = """
k AS (SELECT post_id, 'i' || tax AS key FROM g WHERE tax IS NOT NULL UNION ALL SELECT post_id, 'o' || reg FROM g WHERE reg IS NOT NULL),
lk AS (SELECT DISTINCT a.post_id AS u, b.post_id AS v FROM k a JOIN k b ON a.key = b.key),
c AS (SELECT post_id AS u, post_id AS v FROM g UNION SELECT c.u, lk.v FROM c JOIN lk ON c.v = lk.u),
ids AS (SELECT u AS post_id, md5('organization' || chr(10) || min(v)) AS organization_id FROM c GROUP BY u)"""
_VENUES = r"""
pl AS (SELECT post_id, CASE WHEN post_id % 4 <> 0 THEN 'ул. Мира, ' || post_id % 50 END AS address, c_mktsegment AS city, CAST(10 + c_nationkey AS INTEGER) AS region_code,
  CASE WHEN post_id % 6 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS latitude, CASE WHEN post_id % 6 <> 0 THEN CAST(post_id % 90 AS DOUBLE) END AS longitude FROM g),
v AS (SELECT *, md5('venue' || chr(10) || coalesce(address, '\') || chr(10) || city || chr(10) || region_code || chr(10) || coalesce(CAST(latitude AS VARCHAR), '\') || chr(10) || coalesce(CAST(longitude AS VARCHAR), '\')) AS venue_id
  FROM pl WHERE address IS NOT NULL OR latitude IS NOT NULL)"""


def _legacy(t: Tables):
    """posts, meta, relations, terms and dictionaries of the legacy schema."""
    k = F.col("c_custkey")
    inn = F.when(k % 11 == 0, "123").when(k % 3 != 0, F.concat(F.lit("77-"), F.lpad(s(F.floor(k / 4)), 8, "0")))
    ogrn = F.when(k % 5 == 0, F.concat(F.lit("1"), F.lpad(s(F.floor(k / 20)), 12, "0"))).when(k % 97 == 3, "none")
    values = {
        "hp_inn": inn, "hp_ogrn": ogrn, "hp_latitude": F.when(k % 6 != 0, s(k % 90)), "hp_longitude": F.when(k % 6 != 0, s(F.col("c_nationkey"))),
        "hp_phone": F.concat(F.lit("8 800 "), s(k), F.lit(", None,, 8 900 "), s(k)), "hp_email": F.concat(F.lit("a"), s(k), F.lit("@b.ru, not one,None")), "hp_website": F.lit("https://x.ru/"),
        "hp_address": F.when(k % 4 != 0, F.concat(F.lit(" ул. Мира, "), s(k % 50))), "hp_city": F.concat(F.lit("г. "), F.col("c_mktsegment")), "hp_region": F.concat(F.lit("RU-"), s(10 + F.col("c_nationkey"))),
    }
    meta = t.customer.select(k.alias("post_id"), F.explode(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])).alias("meta_key", "meta_value")).filter("meta_value is not null")
    posts = t.customer.select(k.alias("post_id"), F.col("c_name").alias("title"), F.lit(" ").alias("content"))
    relations = t.orders.select(F.col("o_custkey").alias("post_id"), (F.col("o_orderkey") % 60).alias("term_id"))
    taxonomy = F.element_at(F.array(*[F.lit(x) for x in ("hp_listing_category", "hp_listing_service", "hp_listing_type", "hp_listing_ownership", "post_tag")]), (F.col("id") % 5 + 1).cast("int"))
    terms = t.spark.range(60).select(F.col("id").alias("term_id"), taxonomy.alias("taxonomy"), s(F.floor(F.col("id") / 5) * 2 + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("code"))
    n = F.col("n_nationkey")
    kind = F.when(n % 4 == 0, "services").when(n % 4 == 1, "thematic_categories").when(n % 4 == 2, "organization_types").otherwise("ownership_types")
    dictionaries = t.nation.select(kind.alias("dictionary"), s(n).alias("code"), s(n + 100).alias("dictionary_id"))
    more = t.nation.filter(n % 6 == 0).select(F.lit("specialist_profiles"), s(n), s(n + 300))
    # codes 7 and 8 stand for what was 19 and 13
    return posts, meta, relations, terms, dictionaries.union(more).union(t.nation.filter(n.isin(7, 8)).select(F.lit("thematic_categories"), s(n), s(n + 200)))


def _migration(t: Tables):
    """The tables after one migration, without the store."""
    from loomspark.operators import migration

    none = {name: t.spark.createDataFrame([], schema) for name, (schema, _) in migration.TABLES.items()}
    return migration.migrated(none, *_legacy(t))


@query("m12_listings", f"WITH {_LISTINGS} SELECT post_id, c_name AS title, tax AS inn, reg AS ogrn, '8 800 ' || post_id || ';8 900 ' || post_id AS phones, 'a' || post_id || '@b.ru' AS emails, reason FROM l")
def legacy_listings(t: Tables):
    from loomspark.operators import migration

    out = migration.listings(*_legacy(t)[:2])
    return out.select("post_id", "title", "inn", "ogrn", F.array_join("phones", ";").alias("phones"), F.array_join("emails", ";").alias("emails"), "reason")


@query("m12_organizations", f"WITH RECURSIVE {_LISTINGS}, {_ENTITIES} SELECT organization_id, max_by(c_name, post_id) AS title, max_by(tax, post_id) FILTER (WHERE tax IS NOT NULL) AS inn, max_by(reg, post_id) FILTER (WHERE reg IS NOT NULL) AS ogrn, count(*) AS n_listings FROM ids JOIN g USING (post_id) GROUP BY 1")
def migrated_organizations(t: Tables):
    return _migration(t)["organizations"].select("organization_id", "title", "inn", "ogrn", "n_listings")


@query("m12_venues", f"WITH {_LISTINGS}, {_VENUES} SELECT DISTINCT venue_id, address, city, region_code, latitude, longitude FROM v")
def migrated_venues(t: Tables):
    return _migration(t)["venues"]


@query("m12_organization_venues", f"WITH RECURSIVE {_LISTINGS}, {_ENTITIES}, {_VENUES} SELECT organization_id, venue_id, venue_id = arg_min(arg_min(venue_id, post_id), min(post_id)) OVER (PARTITION BY organization_id) AS is_headquarters FROM v JOIN ids USING (post_id) GROUP BY organization_id, venue_id")
def migrated_venue_links(t: Tables):
    return _migration(t)["organization_venues"]


@query("m12_organization_terms", f"""
WITH RECURSIVE {_LISTINGS}, {_ENTITIES},
t AS (SELECT term_id, term_id % 5 AS kind, term_id // 5 * 2 + CASE WHEN term_id % 5 = 0 THEN 1 ELSE 0 END AS code FROM (SELECT unnest(range(60)) AS term_id)),
r AS (SELECT term_id, CASE WHEN kind = 0 AND code = 19 THEN 7 WHEN kind = 0 AND code = 13 THEN 8 ELSE code END AS code, kind FROM t),
d AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'services' WHEN 1 THEN 'thematic_categories' WHEN 2 THEN 'organization_types' ELSE 'ownership_types' END AS dictionary, n_nationkey AS code, n_nationkey + 100 AS id FROM nation
  UNION ALL SELECT 'specialist_profiles', n_nationkey, n_nationkey + 300 FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'thematic_categories', n_nationkey, n_nationkey + 200 FROM nation WHERE n_nationkey IN (7, 8)),
o AS (SELECT * FROM (VALUES (0, 'thematic_categories', 1), (0, 'services', 2), (1, 'organization_types', 1), (1, 'specialist_profiles', 2), (1, 'services', 3), (2, 'organization_types', 1), (3, 'ownership_types', 1)) x(kind, dictionary, pos)),
f AS (SELECT term_id, dictionary, id FROM r JOIN o USING (kind) JOIN d USING (dictionary, code) QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY pos) = 1)
SELECT DISTINCT organization_id, dictionary, CAST(id AS VARCHAR) AS dictionary_id FROM orders JOIN f ON o_orderkey % 60 = term_id JOIN ids ON o_custkey = post_id""")
def migrated_terms(t: Tables):
    return _migration(t)["organization_terms"]


@query("m12_provenance", f"WITH RECURSIVE {_LISTINGS}, {_ENTITIES} SELECT organization_id, post_id, 'WordPress Legacy' AS source FROM ids")
def migrated_provenance(t: Tables):
    from loomspark.operators import migration

    at = migration.store(t.spark, new_folder(t.spark, "migration"), 4)
    legacy = _legacy(t)
    for epoch in (0, 1):  # the second run takes its ids from the first one's map
        migration.migrate(at, epoch, *legacy)
    return at.read("provenance")


# --- duplicate merge: venues are parts, which lineitems link to suppliers

_MERGE = """
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey // 5 END AS a, CASE WHEN p_partkey % 20 = 4 THEN p_partkey // 40 END AS b FROM part),
x AS (SELECT id, 'a' || a AS key FROM r WHERE a IS NOT NULL UNION ALL SELECT id, 'b' || b FROM r WHERE b IS NOT NULL),
y AS (SELECT DISTINCT p.id AS u, q.id AS v FROM x p JOIN x q ON p.key = q.key),
z AS (SELECT id AS u, id AS v FROM r UNION SELECT z.u, y.v FROM z JOIN y ON z.v = y.u),
m AS (SELECT u AS id, min(v) AS survivor FROM z GROUP BY u)"""


def _venue_rows(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(k.alias("venue_id"), F.when(k % 3 != 0, s(F.floor(k / 5))).otherwise(" ").alias("fias_id"), F.when(k % 20 == 4, s(F.floor(k / 40))).alias("address_raw"), F.when(k % 4 == 3, F.col("p_name")).alias("phone"))


@query("m15_merged_venues", f"WITH RECURSIVE {_MERGE}, n AS (SELECT survivor, arg_min(p_name, p_partkey) AS phone FROM m JOIN part ON p_partkey = id WHERE id % 4 = 3 GROUP BY 1) SELECT m.id AS venue_id, m.survivor, coalesce(CASE WHEN p_partkey % 4 = 3 THEN p_name END, phone) AS phone, m.id <> m.survivor AS is_deleted FROM m JOIN part ON p_partkey = id LEFT JOIN n ON n.survivor = m.id")
def merged_venues(t: Tables):
    from loomspark.operators import duplicates

    rows = _venue_rows(t)
    out = duplicates.merged_rows(rows, "venue_id", duplicates.survivors(rows, "venue_id", ["fias_id", "address_raw"]), ["phone"], F.lit("2024-01-01"))
    return out.select("venue_id", "survivor", "phone", F.col("deleted_at").isNotNull().alias("is_deleted"))


@query("m15_repointed_links", f"WITH RECURSIVE {_MERGE} SELECT l_suppkey, survivor AS venue_id, bool_or(l_linenumber = 1) AS is_headquarters, count(*) AS n FROM lineitem JOIN m ON l_partkey = id GROUP BY 1, 2")
def repointed_links(t: Tables):
    from loomspark.operators import duplicates

    mapping = duplicates.survivors(_venue_rows(t), "venue_id", ["fias_id", "address_raw"])
    links = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("venue_id"), (F.col("l_linenumber") == 1).alias("is_headquarters"))
    return duplicates.repointed(links, "venue_id", mapping, ["l_suppkey", "venue_id"], {"is_headquarters": F.bool_or("is_headquarters"), "n": F.count("*")})


@query("m15_surplus_sources", "SELECT event_id, event_id % 10 = 9 OR coalesce(event_id > min(event_id) FILTER (WHERE event_id % 10 <> 9) OVER (PARTITION BY user_id % 20, event_type) AND event_id % 8 <> 0, false) AS is_deleted FROM (SELECT event_id, user_id, CASE WHEN event_id % 8 <> 0 THEN event_type ELSE 'own' || event_id END AS event_type FROM events)")
def surplus_sources(t: Tables):
    from loomspark.operators import duplicates

    k = F.col("event_id")
    rows = t.events.select("event_id", (F.col("user_id") % 20).alias("organizer_id"), F.when(k % 8 != 0, F.col("event_type")).alias("base_url"), F.when(k % 10 == 9, F.lit("2023-01-01").cast("timestamp")).alias("deleted_at"))
    return duplicates.surplus_deleted(rows, "event_id", ["organizer_id", "base_url"], F.lit("2024-01-01")).select("event_id", F.col("deleted_at").isNotNull().alias("is_deleted"))


# --- purge: test customers go with their orders, their orders' lines and their events

_GONE = """
c AS (SELECT c_custkey FROM customer WHERE c_custkey % 17 = 5), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
li AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 50 = 7)),
e AS (SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM c)), u AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 50 = 7)"""


def _purged(t: Tables):
    from loomspark.operators import duplicates

    tables = {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem, "events": t.events, "supplier": t.supplier, "nation": t.nation}
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "nation": "n_nationkey"}
    graph = [("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_suppkey", "supplier"), ("events", "user_id", "customer"), ("customer", "c_nationkey", "nation")]
    roots = {"customer": t.customer.filter("c_custkey % 17 = 5").select("c_custkey"), "supplier": t.supplier.filter("s_suppkey % 50 = 7").select("s_suppkey")}
    return duplicates.purge(tables, keys, graph, roots)


@query("m14_purge_counts", f"""
WITH {_GONE} SELECT 'customer' AS "table", (SELECT count(*) FROM c) AS removed, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS n_left
UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM li), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM li)
UNION ALL SELECT 'events', (SELECT count(*) FROM e), (SELECT count(*) FROM events) - (SELECT count(*) FROM e) UNION ALL SELECT 'supplier', (SELECT count(*) FROM u), (SELECT count(*) FROM supplier) - (SELECT count(*) FROM u)
UNION ALL SELECT 'nation', 0, (SELECT count(*) FROM nation)""")
def purge_counts(t: Tables):
    return _purged(t)[1]


@query("m14_lines_left", f"WITH {_GONE} SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) AND l_suppkey NOT IN (SELECT s_suppkey FROM u)")
def lines_left(t: Tables):
    return _purged(t)[0]["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey")


# --- activity by region and month: regions are order priorities, members are customers


def _activity(t: Tables):
    """The table of periods, made month by month: the years up to 1996 at once, then the others."""
    from loomspark.operators import activity

    at = new_folder(t.spark, "activity")
    rows = t.orders.select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("region"), F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") * 40).alias("member"))
    for first, last in (("1900-01", "1996-12"), ("1997-01", "2099-12"), ("1996-03", "1996-03")):
        activity.refresh(rows, at, "region", "day", "member", first, last)
    return activity.periods(t.spark.read.schema(activity.SCHEMA).parquet(at))


_ACTIVITY = """
a AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS region, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS member FROM orders),
x AS (SELECT 'region' AS level, region, month AS period, member FROM a UNION ALL SELECT 'region', region, month[:4], member FROM a UNION ALL SELECT 'total', NULL, month, member FROM a UNION ALL SELECT 'total', NULL, month[:4], member FROM a),
p AS (SELECT level, region, period, count(*) AS n, count(DISTINCT member) AS reach FROM x GROUP BY ALL)"""


@query("a18_activity_reach", f"WITH {_ACTIVITY} SELECT * FROM p")
def activity_reach(t: Tables):
    return _activity(t)


@query("a18_activity_dynamics", f"""
WITH {_ACTIVITY}, m AS (SELECT * FROM p WHERE length(period) = 7), c AS (SELECT strftime(unnest(generate_series(min(strptime(period || '-01', '%Y-%m-%d')), max(strptime(period || '-01', '%Y-%m-%d')), INTERVAL 1 month)), '%Y-%m') AS period FROM m),
g AS (SELECT s.level, s.region, c.period, coalesce(n, 0) AS n, coalesce(reach, 0) AS reach FROM (SELECT DISTINCT level, region FROM m) s CROSS JOIN c LEFT JOIN m ON m.level = s.level AND m.region IS NOT DISTINCT FROM s.region AND m.period = c.period)
SELECT *, n - lag(n) OVER w AS n_change, reach - lag(reach) OVER w AS reach_change FROM g WINDOW w AS (PARTITION BY level, region ORDER BY period)""")
def activity_dynamics(t: Tables):
    from loomspark.operators import activity

    return activity.dynamics(_activity(t))


# --- hierarchy: regions, nations, suppliers; nations 11 and 23 are each other's parent, and nation 7's is missing

_TREE = """
n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 12 = 11 THEN 'n' || (34 - n_nationkey) WHEN n_nationkey = 7 THEN 'none' ELSE 'r' || n_regionkey END, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"""


def _nodes(t: Tables):
    k = F.col("n_nationkey")
    parent = F.when(k % 12 == 11, F.concat(F.lit("n"), s(34 - k))).when(k == 7, "none").otherwise(F.concat(F.lit("r"), s(F.col("n_regionkey"))))
    top = t.region.select(F.concat(F.lit("r"), s(F.col("r_regionkey"))).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    return top.union(t.nation.select(F.concat(F.lit("n"), s(k)), parent, "n_name")).union(t.supplier.select(F.concat(F.lit("s"), s(F.col("s_suppkey"))), F.concat(F.lit("n"), s(F.col("s_nationkey"))), "s_name"))


@query("j9_hierarchy", f"""
WITH {_TREE}, l AS (SELECT a.id AS top, b.id, b.name FROM n a JOIN n b ON b.parent = a.id WHERE a.parent IS NULL), k AS (SELECT l.id, string_agg(n.id || '=' || n.name, ',' ORDER BY n.id) AS below FROM l JOIN n ON n.parent = l.id GROUP BY 1)
SELECT n.id, n.name, coalesce((SELECT string_agg(l.id || '=' || l.name || '(' || coalesce(below, '') || ')', ';' ORDER BY l.id) FROM l LEFT JOIN k ON k.id = l.id WHERE l.top = n.id), '') AS children FROM n WHERE parent IS NULL""")
def hierarchy_children(t: Tables):
    from loomspark.operators import hierarchy

    pair = lambda x: F.concat_ws("=", x["id"], x["name"])
    text = F.transform("children", lambda x: F.concat(pair(x), F.lit("("), F.array_join(F.transform(x["children"], pair), ","), F.lit(")")))
    return hierarchy.grouped(hierarchy.expanded(_nodes(t))).select("id", "name", F.array_join(text, ";").alias("children"))


@query("j9_circles", f"WITH {_TREE} SELECT id, CASE WHEN id IN ('n11', 'n23') THEN 'circle' WHEN parent IN ('n11', 'n23') THEN 'below a circle' ELSE 'no parent' END AS reason FROM n WHERE id IN ('n7', 'n11', 'n23') OR parent IN ('n7', 'n11', 'n23')")
def hierarchy_circles(t: Tables):
    from loomspark.operators import hierarchy

    return hierarchy.unreached(_nodes(t))


@query("j9_organizations_below", f"WITH {_TREE} SELECT n.id FROM n WHERE id = 'r2' OR parent = 'r2' OR parent IN (SELECT id FROM n WHERE parent = 'r2') OR id = 'n3' OR parent = 'n3'")
def hierarchy_below(t: Tables):
    from loomspark.operators import hierarchy

    return hierarchy.below(hierarchy.expanded(_nodes(t)), ["r2", "n3"])


# --- nested cards: events and articles are orders, venues are suppliers


@query("j17_organization_cards", """
WITH v AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 20 AS id FROM orders WHERE o_orderkey % 3 = 0), h AS (SELECT o_custkey AS c, o_orderkey % 20 AS id, bool_or(o_orderstatus = 'F') AS hq FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL),
i AS (SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS start FROM lineitem GROUP BY 1),
e AS (SELECT o_custkey AS c, o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT o_custkey AS c, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_totalprice > 200000),
k AS (SELECT c_custkey AS c, c_name, n_nationkey, n_name, r_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT k.c AS id, CAST(to_json({'title': c_name, 'ownership_type': {'id': n_nationkey, 'name': n_name}, 'coverage_level': {'id': r_regionkey, 'name': r_name},
  'services': coalesce((SELECT list({'id': p, 'name': p} ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_custkey = k.c)), []),
  'venues': coalesce((SELECT list({'id': h.id, 'address': s_name, 'fias_id': CASE WHEN h.id % 2 = 0 THEN s_address END, 'is_headquarters': hq} ORDER BY h.id) FROM h JOIN (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_address FROM supplier) ON h.id = s_suppkey WHERE h.c = k.c), []),
  'events': coalesce((SELECT list({'id': o_orderkey, 'title': o_orderpriority, 'attendance_mode': o_orderstatus, 'start_datetime': start} ORDER BY r) FROM e LEFT JOIN i ON l_orderkey = o_orderkey WHERE e.c = k.c AND r <= 10), []),
  'articles': coalesce((SELECT list({'id': o_orderkey, 'title': o_orderpriority, 'slug': 'a-' || o_orderkey, 'excerpt': NULL} ORDER BY r) FROM a WHERE a.c = k.c AND r <= 5), [])}) AS VARCHAR) AS card FROM k""")
def organization_cards(t: Tables):
    from loomspark.operators import details

    own, k = F.col("o_custkey").alias("id_"), F.col("o_orderkey")
    orgs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("c_custkey").alias("id_"), F.col("c_name").alias("title"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("ownership_type"),
        F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).alias("coverage_level"),
    )
    services = t.orders.select(own, F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("name"))
    links = t.orders.filter(k % 3 == 0).select(own, (k % 20).alias("venue_id"), (F.col("o_orderstatus") == "F").alias("is_headquarters"))
    venues = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("address"), F.when(F.col("s_suppkey") % 2 == 0, s(F.col("s_nationkey"))).alias("fias_id"))
    events = t.orders.select(own, k.alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("attendance_mode"), F.when(F.col("o_orderstatus") != "P", "approved").otherwise("draft").alias("status"), F.col("o_orderdate").alias("created_at"))
    instances = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_datetime"))
    articles = t.orders.select(own, k.alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("a-"), s(k)).alias("slug"), F.lit(None).cast("string").alias("excerpt"), F.when(F.col("o_totalprice") > 200000, "published").alias("status"), F.col("o_orderdate").alias("published_at"))
    cards = details.organization_cards(orgs, "id_", {"services": services}, [details.venues_of(venues, links, "id_"), details.events_of(events, instances, "id_"), details.articles_of(articles, "id_")])
    return cards.select(F.col("id_").alias("id"), F.to_json(F.struct(*[c for c in cards.columns if c != "id_"]), {"ignoreNullFields": "false"}).alias("card"))


# --- enrichment: organisations are customers, parties are suppliers

_ORGS = """
o AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'i' || c_custkey % 400 WHEN 1 THEN ' ' END AS inn, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN 'o' || c_custkey % 300 END AS ogrn, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN 'short' END AS short_title,
  CASE c_custkey % 2 WHEN 0 THEN ['1'] ELSE [] END AS phones FROM customer),
p AS (SELECT 'i' || s_suppkey AS inn, CASE WHEN s_suppkey % 7 <> 0 THEN 'o' || s_suppkey END AS ogrn, CASE WHEN s_suppkey % 6 <> 0 THEN ' ' || s_name || ' ' || repeat('x', 300) END AS f, CASE WHEN s_suppkey % 5 <> 0 THEN 'S' || s_suppkey END AS s, ['p' || s_suppkey] AS ph FROM supplier),
m AS (SELECT o.*, nullif(trim(o.inn), '') AS i, p.inn AS pi, p.ogrn AS po, coalesce(trim(f), s) AS t, s, ph FROM o LEFT JOIN p ON CASE WHEN trim(o.inn) <> '' THEN p.inn = o.inn ELSE p.ogrn = o.ogrn END),
w AS (SELECT id, 'inn' AS field, pi AS value FROM m WHERE i IS NULL AND pi IS NOT NULL UNION ALL SELECT id, 'ogrn', po FROM m WHERE ogrn IS NULL AND po IS NOT NULL),
h AS (SELECT 'inn' AS field, i AS value, min(id) AS holder FROM m WHERE i IS NOT NULL GROUP BY 2 UNION ALL SELECT 'ogrn', ogrn, min(id) FROM m WHERE ogrn IS NOT NULL GROUP BY 2),
c AS (SELECT w.*, coalesce(holder, nullif(min(id) OVER (PARTITION BY w.field, w.value), id)) AS holder FROM w LEFT JOIN h ON h.field = w.field AND h.value = w.value)"""


def _enriched(t: Tables):
    from loomspark.operators import enrichment

    k, n = F.col("c_custkey"), F.col("s_suppkey")
    none = F.array().cast("array<string>")
    orgs = t.customer.select(
        k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("i"), s(k % 400))).when(k % 3 == 1, " ").alias("inn"), F.when((k % 3 != 0) & (k % 5 != 0), F.concat(F.lit("o"), s(k % 300))).alias("ogrn"),
        F.col("c_name").alias("title"), F.when(k % 4 == 0, "short").alias("short_title"), F.when(k % 2 == 0, F.array(F.lit("1"))).otherwise(none).alias("phones"), F.lit(None).cast("array<string>").alias("emails"),
    )
    parties = t.supplier.select(
        F.concat(F.lit("i"), s(n)).alias("inn"), F.when(n % 7 != 0, F.concat(F.lit("o"), s(n))).alias("ogrn"), F.when(n % 6 != 0, F.concat(F.lit(" "), F.col("s_name"), F.lit(" "), F.repeat(F.lit("x"), 300))).alias("full_name"),
        F.when(n % 5 != 0, F.concat(F.lit("S"), s(n))).alias("short_name"), F.array(F.concat(F.lit("p"), s(n))).alias("phones"), none.alias("emails"),
    )
    return enrichment.enriched(orgs, parties)


@query("j12_enriched_parties", f"""
WITH {_ORGS}, g AS (SELECT id, max(value) FILTER (WHERE field = 'inn') AS ni, max(value) FILTER (WHERE field = 'ogrn') AS no FROM c WHERE holder IS NULL GROUP BY 1)
SELECT m.id, coalesce(ni, inn) AS inn, coalesce(no, ogrn) AS ogrn, coalesce(substr(t, 1, 255), title) AS title, coalesce(CASE WHEN s <> t THEN s END, short_title) AS short_title, array_to_string(CASE WHEN len(phones) = 0 AND ph IS NOT NULL THEN ph ELSE phones END, ',') AS phones FROM m LEFT JOIN g ON g.id = m.id""")
def enriched_parties(t: Tables):
    return _enriched(t)[0].select("id", "inn", "ogrn", "title", "short_title", F.array_join("phones", ",").alias("phones"))


@query("j10_j12_conflicts", f"WITH {_ORGS} SELECT id, field, value, holder FROM c WHERE holder IS NOT NULL")
def enrichment_conflicts(t: Tables):
    return _enriched(t)[1]


# --- sources are orders, organisers are customers; patches are lineitems, of which each order's last one counts

_SOURCES = """
so AS (SELECT o_orderkey AS source_id, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey % 100 END AS organizer_id, 'https://x' || o_orderkey % 40 || '.ru' AS base_url, CASE WHEN o_orderkey % 3 = 0 THEN 'vk_group' ELSE 'org_website' END AS kind, o_orderstatus AS last_status,
  o_orderkey % 10 = 9 AS deleted FROM orders WHERE o_orderkey % 4 <> 1),
pa AS (SELECT l_orderkey AS source_id, CAST(l_orderkey AS BIGINT) * 100000 + l_partkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'https://x' || l_partkey % 60 || '.ru' END AS url, CASE WHEN l_linenumber % 3 = 0 THEN 'S' || l_partkey % 7 END AS st FROM lineitem),
la AS (SELECT source_id, max_by(url, seq) FILTER (WHERE url IS NOT NULL) AS url, max_by(st, seq) FILTER (WHERE st IS NOT NULL) AS st, max(seq) AS seq FROM pa GROUP BY 1),
mo AS (SELECT la.*, so.source_id IS NOT NULL AS there, organizer_id, base_url, kind, CASE WHEN organizer_id IS NOT NULL AND url IS DISTINCT FROM base_url THEN url END AS move FROM la LEFT JOIN so ON so.source_id = la.source_id),
li AS (SELECT organizer_id, base_url, min(source_id) AS held FROM so WHERE NOT deleted AND organizer_id IS NOT NULL GROUP BY 1, 2),
ju AS (SELECT mo.*, CASE WHEN move IS NOT NULL THEN coalesce(held, nullif(arg_min(mo.source_id, seq) OVER (PARTITION BY mo.organizer_id, move), mo.source_id)) END AS conflicting_id FROM mo LEFT JOIN li ON li.organizer_id = mo.organizer_id AND li.base_url = move)"""


def _patched(t: Tables):
    from loomspark.operators import enrichment

    k = F.col("o_orderkey")
    site = lambda c: F.concat(F.lit("https://x"), s(c), F.lit(".ru"))
    sources = t.orders.filter(k % 4 != 1).select(
        k.alias("source_id"), F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey") % 100).alias("organizer_id"), site(k % 40).alias("base_url"), F.lit("n").alias("name"), F.when(k % 3 == 0, "vk_group").otherwise("org_website").alias("kind"),
        F.col("o_orderstatus").alias("last_status"), F.lit(True).alias("is_active"), F.when(k % 10 == 9, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"),
    )
    n = F.col("l_linenumber")
    patches = t.lineitem.select(F.col("l_orderkey").alias("source_id"), (F.col("l_orderkey").cast("long") * 100000 + F.col("l_partkey") * 10 + n).alias("seq"), F.when(n % 2 == 0, site(F.col("l_partkey") % 60)).alias("base_url"), F.when(n % 3 == 0, F.concat(F.lit("S"), s(F.col("l_partkey") % 7))).alias("last_status"))
    orgs = sources.filter("organizer_id % 2 = 0 and kind = 'org_website' and deleted_at is null").groupBy("organizer_id").agg(F.array_sort(F.collect_set("base_url")).alias("site_urls"))
    return enrichment.patched_sources(sources, patches, orgs)


@query("m6_j10_patch_answers", f"WITH {_SOURCES} SELECT source_id, CASE WHEN NOT there THEN 'error' WHEN conflicting_id IS NOT NULL THEN 'conflict' ELSE 'updated' END AS status, conflicting_id FROM ju")
def patch_answers(t: Tables):
    return _patched(t)[2]


@query("m6_patched_sources", f"WITH {_SOURCES} SELECT so.source_id, so.organizer_id, coalesce(ju.url, so.base_url) AS base_url, coalesce(ju.st, so.last_status) AS last_status FROM so LEFT JOIN ju ON ju.source_id = so.source_id AND ju.conflicting_id IS NULL")
def patched_sources(t: Tables):
    return _patched(t)[0].select("source_id", "organizer_id", "base_url", "last_status")


@query("m6_site_urls", f"""
WITH {_SOURCES}, og AS (SELECT organizer_id, list(DISTINCT base_url ORDER BY base_url) AS urls FROM so WHERE organizer_id % 2 = 0 AND kind = 'org_website' AND NOT deleted GROUP BY 1),
mv AS (SELECT organizer_id, base_url, move, seq FROM ju WHERE there AND conflicting_id IS NULL AND move IS NOT NULL AND kind = 'org_website'),
gn AS (SELECT organizer_id, list(base_url) AS gone FROM mv GROUP BY 1),
lf AS (SELECT og.organizer_id, CASE WHEN gone IS NULL THEN urls ELSE list_filter(urls, lambda u: NOT list_contains(gone, u)) END AS kept FROM og LEFT JOIN gn ON gn.organizer_id = og.organizer_id)
SELECT organizer_id, array_to_string(list_concat(kept, coalesce((SELECT list(move ORDER BY f) FROM (SELECT organizer_id, move, min(seq) AS f FROM mv GROUP BY 1, 2) n WHERE n.organizer_id = lf.organizer_id AND NOT list_contains(kept, move)), [])), ',') AS site_urls FROM lf""")
def site_urls(t: Tables):
    return _patched(t)[1].select("organizer_id", F.array_join("site_urls", ",").alias("site_urls"))
