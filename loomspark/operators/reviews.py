"""Search hits to sources, reviews with an audit, dictionaries and batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import texts, urls

from . import matching, merging
from .grouping import first_per, last_writes


def discovered(hits: DataFrame, least: float = 30.0) -> DataFrame:
    """What each search hit is worth: kind is invalid, directory, social, official or weak, with a confidence.

    hits: url, title, snippet, position, org_title. Rules hold in that order; an official
    site needs a score of `least`, and its confidence is a hundredth of the score.
    """
    u = F.col("url")
    score = urls.official_score(u, F.col("title"), F.col("snippet"), F.col("position"), F.col("org_title"))
    out = hits.withColumn("_score", score).withColumn("social", urls.social_link(u)["kind"])
    kind = F.when(urls.url_problem(u) != "", "invalid").when(urls.is_directory_url(u), "directory").when(F.col("social") != "none", "social").when(F.col("_score") >= least, "official").otherwise("weak")
    out = out.withColumn("kind", kind)
    return out.withColumn("confidence", F.when(F.col("kind") == "social", 0.7).when(F.col("kind") == "official", F.least(F.col("_score") / 100, F.lit(1.0)))).drop("_score")


def discovery_counts(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("official", "social", "directory", "invalid", "weak")])


def best_replacement(hits: DataFrame, fallback: DataFrame, key: str, least: float = 20.0, checked: int = 3) -> DataFrame:
    """(key, url, score, from_fallback): the best valid hit for a broken address.

    hits and fallback: key, url, score, position, reachable (null: not checked). The best has `least` points and is
    reachable among the first `checked`, by score, then place; where it is a directory or there is none, the
    fallback's best takes over unless that is a directory too.
    """

    def best(rows: DataFrame, name: str) -> DataFrame:
        valid = rows.filter(urls.url_problem(F.col("url")) == "")
        top = first_per(valid, [key], [F.desc("score"), "position", "url"], checked)
        top = top.filter((F.col("score") >= least) & F.coalesce("reachable", F.lit(True)))
        return top.groupBy(key).agg(F.min_by(F.struct("url", "score", urls.is_directory_url(F.col("url")).alias("directory")), "_rank").alias(name))

    both = best(hits, "own").join(best(fallback, "other"), key, "full")
    use = (F.col("own").isNull() | F.col("own.directory")) & F.col("other").isNotNull() & ~F.col("other.directory")
    use = F.coalesce(use, F.lit(False))
    pick = F.when(use, F.col("other")).otherwise(F.col("own"))
    return both.select(key, pick.alias("p"), use.alias("from_fallback")).filter("p is not null").select(key, "p.url", "p.score", "from_fallback")


def suggested_terms(old: DataFrame, payloads: DataFrame, seq: str) -> DataFrame:
    """The table of suggested terms after payloads (owner, dictionary, term, reasoning, seq): told again is pending again.

    Rows without a dictionary or a term go. One row per (owner, dictionary, term); the last write counts.
    """
    new = payloads.filter("coalesce(dictionary, '') <> '' and coalesce(term, '') <> ''").withColumn("status", F.lit("pending"))
    return merging.upsert(old, new, ["owner", "dictionary", "term"], seq)


def dictionary_upsert(old: DataFrame, items: DataFrame) -> DataFrame:
    """The dictionary (code, name, parent_code) after items of the same form, and whether each parent is there.

    An item's code and parent replace the old row's. A parent that is in neither is null.
    """
    merged = merging.upsert(old, items.withColumn("_seq", F.lit(0)), ["code"], "_seq")
    parents = merged.select(F.col("code").alias("_p"))
    return merged.join(parents, F.col("parent_code") == F.col("_p"), "left").select("code", "name", F.col("_p").alias("parent_code"))


def review_sheet(items: DataFrame) -> DataFrame:
    """Items with the columns that a reviewer fills in; what is there already stays."""
    made = {"approved": F.lit(False), "notes": F.lit(""), "edited_url": F.coalesce("verified_url", F.lit(""))}
    return items.withColumns({k: v for k, v in made.items() if k not in items.columns})


def review_applied(sources: DataFrame, sheet: DataFrame) -> DataFrame:
    """An audit row per approved item: source_id, old_url, new_url and status.

    The new address is the edited one, else the verified one; without any the item is skipped. A source that is
    not there is an error. An address that another source of the owner had before this batch, or that
    an earlier item (by source_id) of the batch takes, is deduped; the others are applied.
    """
    fill = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    items = sheet.filter("approved").select("source_id", F.coalesce(fill("edited_url"), fill("verified_url")).alias("new_url")).dropDuplicates(["source_id"])
    rows = items.join(sources.select("source_id", "owner", F.col("url").alias("old_url")), "source_id", "left")
    held = sources.groupBy(F.col("owner").alias("_o"), F.col("url").alias("_u")).agg(F.min("source_id").alias("_low"), F.max("source_id").alias("_high"))
    rows = rows.join(held, (F.col("owner") == F.col("_o")) & (F.col("new_url") == F.col("_u")), "left")
    there = rows.filter("owner is not null and new_url is not null").groupBy(F.col("owner").alias("_o2"), F.col("new_url").alias("_u2")).agg(F.min("source_id").alias("_first"))
    rows = rows.join(there, (F.col("owner") == F.col("_o2")) & (F.col("new_url") == F.col("_u2")), "left")
    taken = F.coalesce((F.col("_low") != F.col("source_id")) | (F.col("_high") != F.col("source_id")), F.lit(False)) | F.coalesce(F.col("_first") != F.col("source_id"), F.lit(False))
    status = F.when(F.col("new_url").isNull(), "skipped").when(F.col("owner").isNull(), "error").when(taken, "deduped").otherwise("applied")
    return rows.select("source_id", "old_url", "new_url", status.alias("status"))


def enriched_cards(cards: DataFrame, directory: DataFrame, answers: DataFrame, regions: DataFrame) -> DataFrame:
    """Cards cleaned, joined with a directory and stored answers, matched with a dictionary, with their outcome.

    cards: id, inn, title, phones, region; directory (one an inn): inn, title, phones; answers (last write of an id
    counts): id, decision, seq. Outcomes are accepted, rejected or errors (no answer).
    """
    clean = cards.withColumn("inn", texts.digits_of_length(F.col("inn"), 10, 12))
    d = directory.select("inn", F.col("title").alias("d_title"), F.col("phones").alias("d_phones"))
    rows = clean.join(d, "inn", "left").join(last_writes(answers, ["id"], "seq").select("id", "decision"), "id", "left")
    terms = matching.dictionary_match(rows, "region", regions, "name", "position").withColumnRenamed("term", "region").withColumnRenamed("match", "region_name")
    none = F.array().cast("array<string>")
    phones = texts.distinct_phones(F.array_union(F.coalesce("phones", none), F.coalesce("d_phones", none)))
    outcome = F.when(F.col("decision") == "accepted", "accepted").when(F.col("decision").isNotNull(), "rejected").otherwise("errors")
    return rows.join(terms, "region", "left").select("id", "inn", F.coalesce("d_title", "title").alias("title"), phones.alias("phones"), "region_name", outcome.alias("outcome"))


def dispatch(sources: DataFrame, as_of: Column) -> DataFrame:
    """Work items of due sources, never crawled ones first, with the reason why an address can't be crawled (empty: it can)."""
    due = merging.due_sources(sources, as_of)
    item = F.to_json(F.struct(F.col("source_id"), F.col("base_url").alias("url"), F.col("organizer_id")))
    return due.select("source_id", "last_crawled_at", urls.url_problem(F.col("base_url")).alias("problem"), item.alias("item"))
