"""Registry sheets, work lists, places, notes, schedules, social pages, the live log and hit scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import dates, places, texts, urls
from loomspark.operators import reports
from loomspark.sources import tables as files
from loomspark.sources.shared import new_folder
from loomspark.streaming import jobs

from .registry import Tables, query


def _sheet(t: Tables, rows, columns: list[str], name: str) -> str:
    """A sheet with a title for each column, as a registry exports it."""
    at = new_folder(t.spark, name)
    there = rows.columns
    rows.select(*[F.col(c) if c in there else F.lit("").alias(c) for c in columns]).write.option("header", True).csv(at)
    return at


@query("s1_nco_registry", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN '77' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE '99999' END AS inn, c_name AS full_name,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS short_name, c_mktsegment AS ogrn, '' AS okved FROM customer WHERE c_custkey % 3 <> 0""")
def nco_registry(t: Tables):
    k = F.col("c_custkey")
    inn = F.when(k % 3 == 0, F.lit(" 12 ")).when(k % 2 == 0, F.concat(F.lit(" 77"), F.lpad(k.cast("string"), 8, F.lit("0")), F.lit(" "))).otherwise("99999")
    rows = t.customer.select(inn.alias("inn"), F.concat(F.lit(" "), "c_name").alias("full_name"), F.when(k % 4 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("short_name"), F.concat("c_mktsegment", F.lit("  ")).alias("ogrn"))
    back = files.read_nco_registry(t.spark, _sheet(t, rows, files.NCO_COLUMNS, "nco"))
    return back.select("inn", "full_name", "short_name", "ogrn", "okved")


@query("s2_grant_registry", """
SELECT CAST(o_orderkey AS VARCHAR) AS application_number, o_orderpriority AS organization_name, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS budget_requested,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS start_date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS evaluation FROM orders""")
def grant_registry(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        k.cast("string").alias("application_number"), F.concat("o_orderpriority", F.lit(" ")).alias("organization_name"), F.when(k % 4 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("budget_requested"),
        F.when(k % 5 == 0, "soon").otherwise(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 00:00:00"))).alias("start_date"), F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("").alias("evaluation"),
    )
    back = files.read_grants(t.spark, _sheet(t, rows, files.GRANT_COLUMNS, "grants"))
    return back.select("application_number", "organization_name", "budget_requested", "start_date", "evaluation")


@query("s3_work_list", """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 <> 0 THEN 'https://' || c_custkey || '.example' END AS url, c_name AS title, c_mktsegment AS city,
  CASE WHEN c_custkey % 7 = 0 THEN 'url' ELSE '' END AS missing FROM customer""")
def work_list(t: Tables):
    at, k = new_folder(t.spark, "work"), F.col("c_custkey")
    url = F.when(k % 7 != 0, F.concat(F.lit("https://"), k.cast("string"), F.lit(".example")))
    older = F.struct(k.cast("string").alias("id"), url.alias("base_url"), F.col("c_name").alias("org_title"), F.col("c_mktsegment").alias("city_address"))
    newer = F.struct(k.cast("string").alias("id"), url.alias("url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("city"))
    item = F.when(k % 2 == 0, F.to_json(older)).otherwise(F.to_json(newer))
    arrays = t.customer.groupBy((k % 16).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(at)  # one array a file
    back = files.read_work_list(t.spark, at, ["id", "url"])
    return back.select("id", "url", "title", "city", F.array_join("missing", ",").alias("missing"))


def _has(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


_NOTE = "(['Вакансия: повар', 'Приглашаем на концерт', 'Новый день', 'Мастер-класс'])[1 + doc_id % 4]"


@query("f9_event_notes", f"""
WITH x AS (SELECT doc_id, {_NOTE} AS title, coalesce(text, '') AS content FROM documents)
SELECT doc_id, NOT {_has("lower(title || ' ' || substr(content, 1, 300))", texts.OTHER_MARKERS)} AND {_has("lower(title || ' ' || substr(content, 1, 500))", texts.EVENT_WORDS)}
  AND length(trim('# ' || title || chr(10) || chr(10) || content)) >= 50 AS is_note FROM x""")
def event_notes(t: Tables):
    title = F.get(F.array(*[F.lit(x) for x in ("Вакансия: повар", "Приглашаем на концерт", "Новый день", "Мастер-класс")]), (F.col("doc_id") % 4).cast("int"))
    return t.documents.select("doc_id", texts.is_event_note(title, F.coalesce("text", F.lit(""))).alias("is_note"))


@query("f19_fact_pages", f"""
WITH x AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) || CASE page_id % 5 WHEN 0 THEN '/O-nas' WHEN 1 THEN '/news/about' WHEN 2 THEN '/uslugi' ELSE '' END AS path,
  CASE WHEN page_id % 3 = 0 THEN 'Contacts' ELSE '' END AS label FROM pages)
SELECT page_id, NOT {_has("lower(path)", texts.BLOCKED_PATHS)} AND {_has("lower(path) || ' ' || lower(label)", texts.FACT_PATHS)} AS is_fact FROM x""")
def fact_pages(t: Tables):
    k = F.col("page_id")
    path = F.concat(urls.url_path(F.col("url")), F.when(k % 5 == 0, "/O-nas").when(k % 5 == 1, "/news/about").when(k % 5 == 2, "/uslugi").otherwise(""))
    return t.pages.select("page_id", texts.is_fact_page(path, F.when(k % 3 == 0, "Contacts").otherwise("")).alias("is_fact"))


@query("p4_geo_strings", r"""
WITH x AS (
  SELECT c_custkey, trim(CASE c_nationkey % 4 WHEN 0 THEN ' ru-mow' WHEN 1 THEN 'RU-KOS' WHEN 2 THEN '' ELSE 'RU-XXX' END) AS iso, c_mktsegment AS code,
    CASE c_custkey % 5 WHEN 0 THEN 'г. Кострома, ул. ' || c_custkey WHEN 1 THEN 'Москва, Арбат' WHEN 2 THEN 'ул Ленина 5' WHEN 4 THEN 'Россия, город Нижний Новгород' END AS a FROM customer
), y AS (
  SELECT c_custkey, coalesce(CASE upper(iso) WHEN 'RU-MOW' THEN 'Москва' WHEN 'RU-KOS' THEN 'Костромская область' END, nullif(iso, ''), code) AS r,
    trim(coalesce(nullif(regexp_extract(a, '(?:г\.?|город)\s+([А-Яа-яёЁ-]+(?:\s+[А-Яа-яёЁ-]+)?)\s*(?:,|$)', 1), ''), regexp_extract(a, '^([А-Яа-яёЁ-]+(?:\s+[А-Яа-яёЁ-]+)?)\s*,', 1), '')) AS town FROM x
), z AS (SELECT c_custkey, CASE WHEN town <> '' AND lower(town) <> lower(r) THEN r || ', ' || town ELSE r END AS geo FROM y)
SELECT c_custkey, geo, CASE WHEN contains(geo, ',') THEN trim(substr(geo, instr(geo, ',') + 1)) ELSE geo END AS query, trim(split_part(geo, ',', 1)) AS region,
  CAST(CASE lower(trim(split_part(geo, ',', 1))) WHEN 'москва' THEN 213 WHEN 'костромская область' THEN 44 END AS INTEGER) AS number FROM z""")
def geo_strings(t: Tables):
    n, k = F.col("c_nationkey") % 4, F.col("c_custkey")
    iso = F.when(n == 0, " ru-mow").when(n == 1, "RU-KOS").when(n == 2, "").otherwise("RU-XXX")
    address = F.when(k % 5 == 0, F.concat(F.lit("г. Кострома, ул. "), k.cast("string"))).when(k % 5 == 1, "Москва, Арбат").when(k % 5 == 2, "ул Ленина 5").when(k % 5 == 4, "Россия, город Нижний Новгород")
    rows = t.customer.select("c_custkey", places.geo_string(iso, F.col("c_mktsegment"), address).alias("geo"))
    return rows.select("c_custkey", "geo", places.geo_parts(F.col("geo")).alias("p"), places.search_region(F.col("geo")).alias("number")).select("c_custkey", "geo", "p.query", "p.region", "number")


@query("p6_schedules", "SELECT o_orderkey, strftime(d + h, '%Y-%m-%dT%H:%M:%S+03:00') AS start, strftime(d + h + INTERVAL 1 hour, '%Y-%m-%dT%H:%M:%S+03:00') AS \"end\" FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d, CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 630 minute WHEN 1 THEN INTERVAL 1410 minute ELSE INTERVAL 0 minute END AS h FROM orders)")
def schedules(t: Tables):
    k = F.col("o_orderkey") % 3
    time = F.when(k == 0, "10.30").when(k == 1, "23:30")
    return t.orders.select("o_orderkey", dates.schedule_range(F.col("o_orderdate").cast("date").cast("string"), time).alias("r")).select("o_orderkey", "r.start", "r.end")


@query("p23_legacy_places", """
SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS latitude, c_acctbal AS longitude, c_mktsegment AS city, CAST(CASE WHEN c_custkey > 9 THEN substr(CAST(c_custkey AS VARCHAR), 1, 2) END AS INTEGER) AS region_code FROM customer""")
def legacy_places(t: Tables):
    k = F.col("c_custkey") % 3
    town = F.concat(F.when(k == 0, "г. ").when(k == 1, "город ").otherwise(""), F.col("c_mktsegment"))
    made = places.legacy_place(F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"), town, F.concat(F.lit("R-"), F.col("c_custkey").cast("string")))
    return t.customer.select("c_custkey", made.alias("p")).select("c_custkey", "p.*")


@query("a20_social_pages", """
SELECT user_id, count(*) AS n_pages, coalesce(string_agg(event_type || '/' || event_id, ',' ORDER BY event_id) FILTER (WHERE event_id % 2 = 0 AND value >= 60), '') AS approved,
  coalesce(bool_or(event_id % 2 = 0 AND value >= 60), false) AS has_approved FROM events GROUP BY user_id""")
def social_pages(t: Tables):
    pages = t.events.select("user_id", "event_id", F.concat_ws("/", "event_type", "event_id").alias("url"), (F.col("event_id") % 2 == 0).alias("is_match"), (F.col("value") / 100).alias("confidence"))
    out = reports.approved_pages(pages, "user_id", "event_id", "url", F.col("is_match"), F.col("confidence"))
    return out.select("user_id", "n_pages", F.array_join("approved", ",").alias("approved"), "has_approved")


@query("a20_social_totals", "SELECT count(*) AS organisations, count(*) FILTER (WHERE n > 0) AS with_approved, CAST(sum(n) AS BIGINT) AS approved_pages FROM (SELECT user_id, count(*) FILTER (WHERE event_id % 2 = 0 AND value >= 60) AS n FROM events GROUP BY 1)")
def social_totals(t: Tables):
    out = reports.approved_pages(t.events, "user_id", "event_id", "event_type", F.col("event_id") % 2 == 0, F.col("value") / 100)
    return out.agg(F.count("*").alias("organisations"), F.count_if("has_approved").alias("with_approved"), F.sum(F.size("approved")).alias("approved_pages"))


@query("x1_live_run_log", "SELECT event_type AS tier, count(*) AS n FROM events GROUP BY 1")
def live_run_log(t: Tables):
    at, out, none = new_folder(t.spark, "log"), new_folder(t.spark, "log-counts"), F.lit(None).cast("string")
    rows = t.events.select(F.col("event_id").cast("string").alias("org_id"), none.alias("title"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tier"), none.alias("verified_url"), F.col("value").alias("confidence"), none.alias("error"))
    for part in (rows, rows.filter("confidence > 10")):  # some organisations are logged twice
        files.append_run_log(part, at)

    def put(batch, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{epoch}")
        batch.sparkSession.range(1).select(F.lit(epoch).cast("long").alias("epoch")).coalesce(1).write.mode("append").json(f"{out}/last")

    stream = jobs.live_run_log(t.spark, at, "400 days").writeStream.foreachBatch(put).option("checkpointLocation", new_folder(t.spark, "log-state"))
    stream.outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    last = t.spark.read.schema("epoch long").json(f"{out}/last").agg(F.max("epoch")).first()[0]
    return t.spark.read.schema("tier string, n long").parquet(f"{out}/{last}")


@query("p27_p28_scores", r"""
WITH x AS (
  SELECT page_id, url, page_id % 7 + 1 AS position, regexp_extract(html, '<title>([^<]*)', 1) AS title, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    CASE page_id % 3 WHEN 0 THEN 'example' WHEN 1 THEN 'example nowhere' ELSE 'nowhere' END AS fragment FROM pages
), y AS (
  SELECT *, string_split(fragment, ' ') AS parts, list_distinct(list_transform(list_filter(regexp_split_to_array(title, '\s+'), lambda w: length(w) > 3), lambda w: lower(w))) AS words, lower(title || ' ') AS told FROM x
), z AS (
  SELECT *, len(list_filter(parts, lambda p: contains(host, p))) / len(parts) AS ratio, len(list_filter(words, lambda w: contains(told, w))) AS seen, len(words) AS n_words FROM y
)
SELECT page_id, greatest(0.0, CASE WHEN ratio >= 0.8 THEN 50.0 WHEN ratio >= 0.5 THEN 25.0 ELSE 0.0 END + CASE WHEN n_words > 0 AND seen / n_words >= 0.3 THEN 30.0 ELSE 0.0 END
    + CASE WHEN starts_with(lower(url), 'https://') THEN 10.0 ELSE 0.0 END + CASE WHEN position <= 3 THEN 5.0 ELSE 0.0 END)::DOUBLE AS repair,
  array_to_string(list_filter([CASE WHEN ratio >= 0.8 THEN 'domain_match_100%' WHEN ratio >= 0.5 THEN 'partial_domain_50%' END, CASE WHEN n_words > 0 AND seen / n_words >= 0.3 THEN 'title_match_' || seen || '/' || n_words END,
    CASE WHEN starts_with(lower(url), 'https://') THEN 'https' END, CASE WHEN position <= 3 THEN 'top_' || position END], lambda v: v IS NOT NULL), '; ') AS reason,
  (CASE WHEN regexp_matches(host, '\.(ru|su|com|org|net)$') THEN 10.0 ELSE 0.0 END + CASE WHEN n_words > 0 THEN 30.0 * seen / n_words ELSE 0.0 END
    + CASE WHEN len(list_filter(words, lambda w: length(w) > 4 AND contains(replace(host, 'www.', ''), w))) > 0 THEN 20.0 ELSE 0.0 END + CASE WHEN starts_with(url, 'https://') THEN 5.0 ELSE 0.0 END
    + CASE WHEN position <= 3 THEN 10.0 ELSE 0.0 END)::DOUBLE AS official FROM z""")
def hit_scores(t: Tables):
    k = F.col("page_id") % 3
    hits = t.pages.select("page_id", "url", (F.col("page_id") % 7 + 1).alias("position"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.when(k == 0, "example").when(k == 1, "example nowhere").otherwise("nowhere").alias("fragment"))
    repair = urls.repair_score(F.col("url"), F.col("title"), F.lit(""), F.col("position"), F.col("fragment"), F.col("title"))
    return hits.select("page_id", repair["score"].alias("repair"), repair["reason"].alias("reason"), urls.official_score(F.col("url"), F.col("title"), F.lit(""), F.col("position"), F.col("title")).alias("official"))
