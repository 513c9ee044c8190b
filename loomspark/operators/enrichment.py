"""Enrichment from a directory of parties, and changes of sources with the sites of their organisations kept in step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import filled, source_defaults

#: What ids that name a source look like.
UUID = "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: Fields of a source that a patch may change.
PATCHED = ["base_url", "name", "kind", "last_status", "last_crawled_at", "is_active"]


def _empty(c: Column) -> Column:
    return F.coalesce(F.size(c) <= 0, F.lit(True))


def matched_parties(orgs: DataFrame, parties: DataFrame) -> DataFrame:
    """orgs with the party of their tax id, or of their registration id if they have no tax id, as columns p_*.

    A tax id that the directory lacks is not made good by the registration id. Blank ids match nothing; of parties with
    one id the first by name and id counts.
    """
    fields = [c for c in parties.columns]
    sides = []
    for kind in ("inn", "ogrn"):
        one = parties.filter(filled(F.col(kind)).isNotNull()).groupBy(filled(F.col(kind)).alias("_key")).agg(F.min(F.struct(*[F.col(c).alias(f"p_{c}") for c in fields])).alias("_p"))
        sides.append(one.select(F.concat(F.lit(f"{kind}:"), "_key").alias("_key"), "_p"))
    inn, ogrn = filled(F.col("inn")), filled(F.col("ogrn"))
    key = F.coalesce(F.concat(F.lit("inn:"), inn), F.concat(F.lit("ogrn:"), ogrn))
    return orgs.withColumn("_key", key).join(sides[0].union(sides[1]), "_key", "left").drop("_key").select("*", "_p.*").drop("_p")


def enriched(orgs: DataFrame, parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """orgs as the directory has them, and (id, field, value, holder) for ids that could not be filled in.

    orgs: id, inn, ogrn, title, short_title, phones, emails. parties: inn, ogrn, full_name, short_name, phones,
    emails. The directory's full name, else its short one, is the title (255 characters at most); a short name that differs is the short
    title (100 at most), else that stays. An id that is missing is filled in if no other organisation has it;
    of several in one batch that would get the same, that with the least id does, and for the others it is the holder. Phones and e-mails are
    filled in only where there are none.
    """
    m = matched_parties(orgs, parties)
    full, short = filled(F.col("p_full_name")), filled(F.col("p_short_name"))
    title = F.coalesce(full, short)
    new_short = F.when(title.isNotNull() & short.isNotNull() & (short != title), F.substring(short, 1, 100))
    own = m.select("id", *[filled(F.col(c)).alias(c) for c in ("inn", "ogrn")], *[filled(F.col(f"p_{c}")).alias(f"p_{c}") for c in ("inn", "ogrn")])
    wishes = None
    for kind in ("inn", "ogrn"):
        part = own.filter(F.col(kind).isNull() & F.col(f"p_{kind}").isNotNull()).select("id", F.lit(kind).alias("field"), F.col(f"p_{kind}").alias("value"))
        wishes = part if wishes is None else wishes.union(part)
    held = None
    for kind in ("inn", "ogrn"):
        part = own.filter(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("value")).agg(F.min("id").alias("_holder")).select(F.lit(kind).alias("field"), "value", "_holder")
        held = part if held is None else held.union(part)
    first = wishes.groupBy("field", "value").agg(F.min("id").alias("_first"))
    claims = wishes.join(first, ["field", "value"]).join(held, ["field", "value"], "left").withColumn("holder", F.coalesce("_holder", F.when(F.col("id") != F.col("_first"), F.col("_first"))))
    conflicts = claims.filter("holder is not null").select("id", "field", "value", "holder")
    given = claims.filter("holder is null").groupBy("id").agg(*[F.max(F.when(F.col("field") == k, F.col("value"))).alias(f"_new_{k}") for k in ("inn", "ogrn")])
    out = m.join(given, "id", "left").select(
        *[c for c in orgs.columns if c not in ("inn", "ogrn", "title", "short_title", "phones", "emails")],
        F.coalesce("_new_inn", "inn").alias("inn"), F.coalesce("_new_ogrn", "ogrn").alias("ogrn"), F.coalesce(F.substring(title, 1, 255), F.col("title")).alias("title"), F.coalesce(new_short, F.col("short_title")).alias("short_title"),
        *[F.when(_empty(F.col(c)) & ~_empty(F.col(f"p_{c}")), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) for c in ("phones", "emails")],
    )
    return out.select(*orgs.columns), conflicts


def synced_sites(orgs: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """orgs (organizer_id, site_urls) without the sites of gone (organizer_id, url) and with those of new (organizer_id, url, seq) at the end, each once."""
    lost = gone.groupBy("organizer_id").agg(F.collect_set("url").alias("_gone"))
    more = new.groupBy("organizer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "url"))), lambda x: x["url"]).alias("_new"))
    out = orgs.join(lost, "organizer_id", "left").join(more, "organizer_id", "left")
    had = F.coalesce("site_urls", F.array().cast("array<string>"))
    left = F.when(F.col("_gone").isNull(), had).otherwise(F.filter(had, lambda u: ~F.array_contains("_gone", u)))
    added = F.filter(F.array_distinct(F.coalesce("_new", F.array().cast("array<string>"))), lambda u: ~F.array_contains(left, u))
    return out.withColumn("site_urls", F.when(F.col("_gone").isNull() & F.col("_new").isNull(), F.col("site_urls")).otherwise(F.concat(left, added))).drop("_gone", "_new")


def patched_sources(sources: DataFrame, patches: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, organisations' sites, and an answer for each source that a patch names, after a batch of patches.

    sources: source_id, organizer_id, deleted_at and the fields of PATCHED. patches: source_id, seq and any of these fields; values that are not null
    overwrite, of several patches the last one's that is told. orgs: organizer_id, site_urls. Answers (source_id, status, conflicting_id): error if the
    source is not there; conflict, and nothing of the patch is applied, if another live source of its organiser has the new address, or an earlier
    patch of the batch has claimed it; else updated. An address that a patch of the same batch frees is still taken. Sites follow the
    addresses of organisations' own websites, in order of seq.
    """
    told = [c for c in PATCHED if c in patches.columns]
    last = patches.filter("source_id is not null").groupBy("source_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"n_{c}") for c in told], F.max("seq").alias("_seq"))
    rows = last.join(sources.withColumn("_there", F.lit(True)), "source_id", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    url = F.nullif(F.col("n_base_url"), F.lit("")) if "base_url" in told else F.lit(None).cast("string")
    moves = rows.withColumn("_url", F.when(F.col("organizer_id").isNotNull() & ~url.eqNullSafe(F.col("base_url")), url))
    live = sources.filter("deleted_at is null and organizer_id is not null").groupBy("organizer_id", F.col("base_url").alias("_url")).agg(F.min("source_id").alias("_held"))
    claimed = moves.filter("_url is not null").groupBy("organizer_id", "_url").agg(F.min_by("source_id", F.struct("_seq", "source_id")).alias("_first"))
    judged = moves.join(live, ["organizer_id", "_url"], "left").join(claimed, ["organizer_id", "_url"], "left")
    other = F.coalesce("_held", F.when(F.col("_first") != F.col("source_id"), F.col("_first")))
    judged = judged.withColumn("conflicting_id", F.when(F.col("_url").isNotNull(), other))
    judged = judged.withColumn("status", F.when(~F.col("_there"), "error").when(F.col("conflicting_id").isNotNull(), "conflict").otherwise("updated"))
    good = judged.filter("status = 'updated'")
    fields = good.select("source_id", *[f"n_{c}" for c in told])
    out = sources.join(fields, "source_id", "left").withColumns({c: F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")) if c == "base_url" else F.col(f"n_{c}"), F.col(c)) for c in told}).select(*sources.columns)
    kind = F.coalesce("n_kind", "kind") if "kind" in told else F.col("kind")
    moved = good.filter(F.col("_url").isNotNull() & (kind == "org_website"))
    sites = synced_sites(orgs, moved.select("organizer_id", F.col("base_url").alias("url")), moved.select("organizer_id", F.col("_url").alias("url"), F.col("_seq").alias("seq")))
    return out, sites, judged.select("source_id", "status", "conflicting_id")


def crawl_outcomes(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """sources with the status and time of their last crawl: of outcomes (source_id, last_status, last_crawled_at) the latest; ids that are no UUIDs are passed over."""
    good = outcomes.filter(F.col("source_id").rlike(UUID))
    last = good.groupBy("source_id").agg(F.max_by(F.struct(F.col("last_status").alias("s"), F.col("last_crawled_at").alias("t")), "last_crawled_at").alias("_o"))
    out = sources.join(last, "source_id", "left")
    return out.withColumns({"last_status": F.coalesce("_o.s", "last_status"), "last_crawled_at": F.coalesce("_o.t", "last_crawled_at")}).select(*sources.columns)


def created_sources(sources: DataFrame, new: DataFrame, orgs: DataFrame, source_id: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, organisations' sites, and an answer for each row of new, after a batch of new sources.

    new: seq, organizer_id, base_url, kind, name, priority, crawl_period_days. A row whose organiser has a live source of that address, there or earlier in the
    batch, makes none (exists, with that source's id); others are made with what is missing filled in (created); source_id is the
    new id as a column over organizer_id and base_url. Sites get the addresses of organisations' own websites.
    """
    live = sources.filter("deleted_at is null").groupBy("organizer_id", "base_url").agg(F.min("source_id").alias("_held"))
    asked = new.withColumn("_id", source_id).join(live, ["organizer_id", "base_url"], "left")
    first = new.groupBy("organizer_id", "base_url").agg(F.min("seq").alias("_first"))
    asked = asked.join(first, ["organizer_id", "base_url"])
    fresh = F.col("_held").isNull() & (F.col("seq") == F.col("_first"))
    made = source_defaults(asked.filter(fresh)).withColumn("source_id", F.col("_id"))
    rows = sources.unionByName(made.select(*[F.col(c) if c in made.columns else F.lit(None).alias(c) for c in sources.columns]))
    web = made.filter("kind = 'org_website'")
    sites = synced_sites(orgs, web.limit(0).select("organizer_id", F.col("base_url").alias("url")), web.select("organizer_id", F.col("base_url").alias("url"), "seq"))
    return rows, sites, asked.select("seq", F.coalesce("_held", "_id").alias("source_id"), F.when(fresh, "created").otherwise("exists").alias("status"))
