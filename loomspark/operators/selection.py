"""Selections: registry rows by codes, names and topics, incomplete records, passes, sources, proposals, related articles; and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import texts, urls

from .grouping import first_per
from .records import filled

# Kinds of sources that list events of many; levels of an address registry at which a settlement is known.
LISTING_KINDS = ["event_aggregator", "platform_silverage_events", "afisha"]
SETTLEMENT_LEVELS = ["4", "6"]
#: Registry columns that a complete venue has.
VENUE_FIELDS = ["fias_id", "fias_level", "city_fias_id", "region_iso"]


def by_activity(code: Column, broader: bool = False) -> Column:
    """Whether the first part of an activity code is one of care, or with `broader` of those that may be near to it; null codes are not."""
    return F.coalesce(texts.code_group(code).isin(texts.CARE_CODES + (texts.BROADER_CODES if broader else [])), F.lit(False))


def by_name(name: Column) -> Column:
    """Whether an organisation's name has a stem of care for the elderly."""
    return F.coalesce(texts.has_stem(name, texts.NAME_STEMS), F.lit(False))


def directions_like(part: str | None) -> list[str]:
    """The directions whose names hold `part`, whatever the case; all without one."""
    return [d for d in texts.DIRECTIONS if not part or part.lower() in d.lower()]


def by_direction(direction: Column, part: str | None = None) -> Column:
    """Whether a grant's direction is one of those wanted."""
    return F.coalesce(direction.isin(directions_like(part)), F.lit(False))


def still_good(status: Column, evaluation: Column) -> Column:
    """Whether a project is neither withdrawn nor badly evaluated; a status or evaluation that is missing is no fault."""
    return ~F.lower(F.coalesce(status, F.lit(""))).contains(texts.WITHDRAWN_STEM) & ~F.coalesce(evaluation.isin(texts.BAD_EVALUATIONS), F.lit(False))


def by_topic(title: Column, organisation: Column | None = None) -> Column:
    """Whether a project's title, or title and organisation, has a stem of work for the elderly."""
    text = title if organisation is None else F.concat_ws(" ", title, organisation)
    return F.coalesce(texts.has_stem(text, texts.TOPIC_STEMS), F.lit(False))


def venue_gaps() -> Column:
    """struct of flags of a venue (address_raw, latitude, longitude and VENUE_FIELDS): what an enrichment would take it up for.

    incomplete: a registry field is blank or a coordinate missing; by_address and by_geo: incomplete, with an address, or without one but with coordinates;
    new_region: no region; unsettled: no registry id, or a level that is known and is not a settlement's.
    """
    blank = lambda c: filled(F.col(c)).isNull()
    nowhere = F.col("latitude").isNull() | F.col("longitude").isNull()
    lacking = nowhere
    for c in VENUE_FIELDS:
        lacking = lacking | blank(c)
    level = filled(F.col("fias_level"))
    return F.struct(
        lacking.alias("incomplete"), (lacking & ~blank("address_raw")).alias("by_address"), (lacking & blank("address_raw") & ~nowhere).alias("by_geo"), blank("region_iso").alias("new_region"),
        (blank("fias_id") | F.coalesce(~level.isin(SETTLEMENT_LEVELS), F.lit(False))).alias("unsettled"),
    )


def has_registry_id(inn: Column, ogrn: Column) -> Column:
    return filled(inn).isNotNull() | filled(ogrn).isNotNull()


def only_a_date(title: Column) -> Column:
    """Whether a title is nothing but a date like 1.12.24."""
    return F.coalesce(title.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2,4}$"), F.lit(False))


def own_event_pass(kind: Column, done: Column) -> Column:
    """Whether a source gets an event pass of its own: it lists events of many, and its organisation's run has not found them already."""
    return F.coalesce(F.lower(kind).isin(LISTING_KINDS), F.lit(False)) & ~F.coalesce(done, F.lit(False))


def organisations_in(orgs: DataFrame, id_col: str, links: DataFrame, categories: DataFrame, venues: DataFrame, town: str) -> DataFrame:
    """orgs that have any of the categories (links: id, category_id) and a venue (id, address_raw) whose address names the town, whatever the case."""
    near = venues.filter(F.contains(F.lower("address_raw"), F.lit(town.lower()))).select(id_col)
    return orgs.join(links.join(categories, "category_id", "left_semi").select(id_col), id_col, "left_semi").join(near, id_col, "left_semi")


def sources_of(sources: DataFrame, organizer, kind: str | None = None, active: bool | None = None) -> DataFrame:
    """An organiser's sources that are not deleted, of one kind and activity if told, by kind and id."""
    out = sources.filter((F.col("organizer_id") == organizer) & F.col("deleted_at").isNull())
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if active is not None:
        out = out.filter(F.col("is_active") == active)
    return out.orderBy("kind", "source_id")


def search_statistics(queries: DataFrame, *keys: str) -> DataFrame:
    """Queries, results, errors and mean seconds (three places, 0 without queries). queries: n_results, seconds, failed."""
    mean = F.bround(F.coalesce(F.avg("seconds"), F.lit(0.0)), 3)
    return queries.groupBy(*keys).agg(F.count("*").alias("total_queries"), F.coalesce(F.sum("n_results"), F.lit(0)).alias("total_results"), F.count_if("failed").alias("errors"), mean.alias("avg_time_s"))


def run_summary(log: DataFrame) -> DataFrame:
    """Accepted, rejected and failed cards, total and mean seconds of each run. log: run_id, decision, seconds; a decision that is neither is a failure."""
    kinds = [F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "rejected")]
    failed = F.count_if(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False))).alias("errors")
    return log.groupBy("run_id").agg(*kinds, failed, F.bround(F.coalesce(F.sum("seconds"), F.lit(0.0)), 2).alias("total_seconds"), F.bround(F.coalesce(F.avg("seconds"), F.lit(0.0)), 2).alias("mean_seconds"))


def sites_to_sources(owners: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New website sources, and (source_id, organizer_id) of sources that change hands, from organisations' site addresses.

    owners: organizer_id, site_urls; sources: source_id, organizer_id, kind, base_url. An address is known if a website source has it or its
    normal form (no scheme, no www.); of several such sources that with the least id counts, and it goes to the greatest organiser that names the address.
    Other addresses become sources with the usual defaults, one for each normal form, of the least organiser that names it. Addresses without a normal form are passed over.
    """
    named = owners.select("organizer_id", F.explode("site_urls").alias("base_url")).withColumn("_key", urls.url_key(F.col("base_url"))).filter("_key is not null and organizer_id is not null").distinct()
    known = sources.filter("kind = 'org_website'").withColumn("_key", urls.url_key(F.col("base_url"))).filter("_key is not null").groupBy("_key").agg(F.min_by(F.struct("source_id", F.col("organizer_id").alias("was")), "source_id").alias("_s"))
    found = named.join(known, "_key", "left")
    moved = found.filter("_s is not null").groupBy(F.col("_s.source_id").alias("source_id")).agg(F.max("organizer_id").alias("organizer_id"), F.any_value("_s.was").alias("was"))
    fresh = found.filter("_s is null").groupBy("_key").agg(F.min(F.struct("organizer_id", "base_url")).alias("n")).select("n.organizer_id", "n.base_url", F.substring("_key", 1, 255).alias("name"))
    made = fresh.withColumns({"kind": F.lit("org_website"), "is_active": F.lit(True), "last_status": F.lit("pending"), "crawl_period_days": F.lit(30)})
    return made, moved.filter(~F.col("was").eqNullSafe(F.col("organizer_id"))).select("source_id", "organizer_id")


def codes_to_ids(rows: DataFrame, id_col: str, codes: str, dictionary: DataFrame) -> DataFrame:
    """(id, value_id) for codes of an array column that are a code or a slug of the dictionary (value_id, code, slug); others go, each pair comes once."""
    keys = dictionary.select("value_id", F.explode(F.array_distinct(F.array_compact(F.array("code", "slug")))).alias("_code")).distinct()
    return rows.select(id_col, F.explode(F.array_distinct(codes)).alias("_code")).join(keys, "_code").select(id_col, "value_id").distinct()


def source_proposals(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(url, n, score): addresses linked in texts that are no source's yet, how often, and their best score; the first spelling of each normal form.

    links: href, score; sources: base_url. Addresses that can't be crawled are left out.
    """
    rows = links.withColumn("_key", urls.url_key(F.col("href"))).filter(F.col("_key").isNotNull() & (urls.url_problem(F.col("href")) == ""))
    known = sources.select(urls.url_key(F.col("base_url")).alias("_key")).filter("_key is not null").distinct()
    return rows.join(known, "_key", "left_anti").groupBy("_key").agg(F.min("href").alias("url"), F.count("*").alias("n"), F.max("score").alias("score")).drop("_key")


def accepted_proposals(proposals: DataFrame, least: float) -> DataFrame:
    """Proposals of at least a score as new sources, with the usual defaults."""
    good = proposals.filter(F.col("score") >= least).select(F.col("url").alias("base_url"))
    return good.withColumns({"kind": F.lit("org_website"), "crawl_period_days": F.lit(30), "priority": F.lit(50), "last_status": F.lit("pending"), "is_active": F.lit(True)})


def related_articles(org_links: DataFrame, articles: DataFrame, most: int = 5) -> DataFrame:
    """(org, article_id, rank): each organisation's newest articles that share a category or a service with it.

    org_links: org, kind (category or service), term; articles: article_id, kind, term, published_at. An organisation and an article
    that share several terms are one pair. Only the newest articles of a term can be among an organisation's `most`, so that no term's articles all meet its organisations.
    """
    order = W.partitionBy("kind", "term").orderBy(F.col("published_at").desc_nulls_last(), "article_id")
    newest = articles.filter("term is not null").dropDuplicates(["kind", "term", "article_id"]).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    pairs = org_links.filter("term is not null").select("org", "kind", "term").distinct().join(newest, ["kind", "term"]).groupBy("org", "article_id").agg(F.max("published_at").alias("published_at"))
    return first_per(pairs, ["org"], [F.col("published_at").desc_nulls_last(), "article_id"], most).select("org", "article_id", F.col("_rank").alias("rank"))
