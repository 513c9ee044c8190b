"""Sources, sinks and streams: what is written and read again, on events, pages and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.sources import tables as files
from loomspark.sources.shared import new_folder
from loomspark.streaming import jobs

from .registry import Tables, query


@query("s4_run_log", "SELECT CAST(event_id AS VARCHAR) AS org_id, event_type AS tier, value AS confidence FROM events WHERE event_id % 10 <> 0")
def run_log(t: Tables):
    at, none = new_folder(t.spark, "log"), F.lit(None).cast("string")
    rows = t.events.select(
        F.when(F.col("event_id") % 10 != 0, F.col("event_id").cast("string")).alias("org_id"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("tier"), none.alias("verified_url"), F.col("value").alias("confidence"), none.alias("error"), F.col("event_id"),
    )
    for k in (0, 1):
        files.append_run_log(rows.filter(F.col("event_id") % 2 == k), at)
    return files.read_run_log(t.spark, at).select("org_id", "tier", "confidence")


@query("s6_stored_answers", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 6 = 2 THEN 'accepted' ELSE 'rejected' END AS decision FROM events")
def stored_answers(t: Tables):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).when(k % 6 == 2, "It is Accepted").otherwise("no")
    rows = t.events.select("event_id", text.alias("a"))
    return rows.select("event_id", files.parsed_answer(F.col("a"), "k bigint")["k"].alias("k"), files.answer_decision(F.col("a")).alias("decision"))


@query("s5_search_hits", "SELECT page_id, u AS url, p AS position, 'found ' || page_id || ' more' AS snippet FROM (SELECT page_id, unnest(['https://a.ru/' || page_id, 'https://b.ru/' || page_id]) AS u, unnest([1, 2]) AS p FROM pages)")
def search_hits(t: Tables):
    doc = lambda host: F.concat(F.lit(f"<group><doc><url>https://{host}/"), k, F.lit("</url><title> t </title><passages><passage>found <hlword>"), k, F.lit("</hlword></passage><passage>more</passage></passages></doc></group>"))
    k = F.col("page_id").cast("string")
    xml = F.concat(F.lit("<yandexsearch><response><results><grouping>"), doc("a.ru"), doc("b.ru"), F.lit("</grouping></results></response></yandexsearch>"))
    return files.search_hits(t.pages.select("page_id", xml.alias("x")), "x", "page_id").select("page_id", "url", "position", "snippet")


@query("s7_s8_tiers", "SELECT CASE WHEN value / 100 >= 0.8 THEN 'auto' WHEN value / 100 >= 0.5 THEN 'review' ELSE 'reject' END AS tier, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def tiers(t: Tables):
    from loomspark.functions.rules import tier

    at = new_folder(t.spark, "tiers")
    files.write_tiers(t.events.select("event_id", tier(F.col("value") / 100).alias("tier")), at)
    back = t.spark.read.schema("event_id long, tier string").json(at)
    return back.groupBy("tier").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s9_csv_log", "SELECT o_orderkey, o_orderpriority FROM orders")
def csv_log(t: Tables):
    at = new_folder(t.spark, "csv")
    for k in (0, 1):
        files.append_csv(t.orders.filter(F.col("o_orderkey") % 2 == k).select("o_orderkey", "o_orderpriority"), at)
    return t.spark.read.schema("o_orderkey long, o_orderpriority string").option("header", True).csv(at)


@query("s10_dictionary_export", "SELECT a.n_nationkey AS id, CAST(a.n_nationkey + 140 AS VARCHAR) AS code, CASE WHEN b.n_nationkey IS NOT NULL THEN CAST(b.n_nationkey + 140 AS VARCHAR) END AS parent_code FROM nation a LEFT JOIN nation b ON a.n_regionkey + 10 = b.n_nationkey AND b.n_nationkey % 4 <> 0 WHERE a.n_nationkey % 4 <> 0 AND a.n_nationkey <> 11")
def dictionary_export(t: Tables):
    at = new_folder(t.spark, "dictionary")
    key = F.col("n_nationkey").cast("long")
    rows = t.nation.select(key.alias("id"), (key + 140).cast("string").alias("code"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 10).cast("long").alias("parent_id"), F.when(key % 4 == 0, False).alias("is_active"))
    rows.write.json(at)
    return files.with_parent_code(files.read_dictionary(t.spark, at)).select("id", "code", "parent_code")


@query("s12_mapped_answer", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS amount FROM events")
def mapped_answers(t: Tables):
    body = F.concat(F.lit('{"data": {"items": ['), "props", F.lit("]}}"))
    return files.mapped_answer(t.events.select("event_id", body.alias("body")), "body", ["data", "items"], {"amount": "k"}, "event_id")


def _stream(t: Tables):
    """events as a stream of files."""
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.at}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(t: Tables, rows, name: str):
    """What a stream gives once it has read all that is there."""
    out, schema = new_folder(t.spark, name), rows.schema
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(t.spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(out)


@query("x2_windowed_metrics", "SELECT CAST(epoch(w) AS BIGINT) AS started, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS success FROM (SELECT *, time_bucket(INTERVAL 1 hour, ts) AS w FROM events) WHERE w + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minute FROM events) GROUP BY 1")
def windowed_metrics(t: Tables):
    d = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "view", "rejected").otherwise("needs_review")
    rows = _stream(t).select("ts", (F.col("event_type") != "error").alias("ok"), d.alias("decision"), F.col("value").alias("confidence"), F.lit(1).alias("tokens_in"), F.lit(1).alias("tokens_out"), F.col("value").alias("seconds"))
    out = _drained(t, jobs.windowed_metrics(rows).select(F.col("window.start").alias("start"), "total", "success"), "metrics")
    return out.select(F.col("start").cast("long").alias("started"), "total", "success")


@query("x4_session_stream", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minute THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started, count(*) AS n FROM s GROUP BY user_id, i HAVING max(ts) + INTERVAL 30 minute <= (SELECT max(ts) - INTERVAL 10 minute FROM events)""")
def session_stream(t: Tables):
    out = _drained(t, jobs.sessions(_stream(t).select("user_id", "ts"), "user_id"), "sessions")
    return out.select("user_id", F.unix_micros("start").alias("started"), "n")


@query("x3_continuous_import", "SELECT user_id AS id, max_by(event_type, event_id) AS name FROM events GROUP BY 1")
def continuous_import(t: Tables):
    at = new_folder(t.spark, "snapshot")
    rows = _stream(t).select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"))
    jobs.continuous_import(rows, t.spark, at, ["id"], "seq", new_folder(t.spark, "snapshot-state")).trigger(availableNow=True).start().awaitTermination()
    return jobs.read_snapshot(t.spark, at, "id long, name string")


@query("x4_run_progress", """
WITH r AS (SELECT user_id % 40 AS run, ts FROM events), g AS (SELECT run, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minute THEN 0 ELSE 1 END AS b FROM r WINDOW w AS (PARTITION BY run ORDER BY ts)),
s AS (SELECT run, ts, sum(b) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g),
c AS (SELECT run, min(ts) AS a, max(ts) AS z, count(*) AS n FROM s GROUP BY run, i HAVING max(ts) + INTERVAL 30 minute <= (SELECT max(ts) - INTERVAL 10 minute FROM events)),
w AS (SELECT o_custkey % 50 AS run, count(DISTINCT o_orderkey) AS n_items FROM orders WHERE o_custkey % 50 <> 3 GROUP BY 1),
d AS (SELECT c.run, a, n, n_items, sum(n) OVER o AS done, sum(epoch_us(z)::DOUBLE / 1e6::DOUBLE - epoch_us(a)::DOUBLE / 1e6::DOUBLE) OVER o AS secs FROM c LEFT JOIN w ON w.run = c.run WINDOW o AS (PARTITION BY c.run ORDER BY a ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, done / greatest(secs, 1.0::DOUBLE) * 60 AS rate, CASE WHEN n_items IS NOT NULL THEN greatest(n_items - done, 0) END AS pending FROM d)
SELECT run, CAST(epoch_us(a) AS BIGINT) AS started, n, n_items, CAST(done AS BIGINT) AS done, CAST(pending AS BIGINT) AS pending, round_even(rate, 6) AS rate, round_even(pending / greatest(rate, 0.1::DOUBLE), 6) AS minutes_left FROM e""")
def run_progress(t: Tables):
    work = t.orders.filter("o_custkey % 50 <> 3").select((F.col("o_custkey") % 50).alias("run"), F.col("o_orderkey").alias("item"))
    rows = _stream(t).select((F.col("user_id") % 40).alias("run"), "ts")
    out = jobs.estimates(_drained(t, jobs.progress(rows, work, "run"), "progress"), "run")
    return out.select("run", F.unix_micros("start").alias("started"), "n", "n_items", "done", "pending", F.bround("rate", 6).alias("rate"), F.bround("minutes_left", 6).alias("minutes_left"))
