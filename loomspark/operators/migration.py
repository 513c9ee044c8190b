"""Legacy migration: listings kept as (id, key, value) rows become organisations, venues and links with ids of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import places, texts
from loomspark.sources.snapshots import Snapshot

from .duplicates import orphans
from .matching import resolve_entities
from .records import filled
from .reports import wide

# Keys of the legacy attributes, by our names; the name of the source of migrated rows.
META = {
    "inn": "hp_inn", "ogrn": "hp_ogrn", "latitude": "hp_latitude", "longitude": "hp_longitude", "phones": "hp_phone", "emails": "hp_email",
    "sites": "hp_website", "address": "hp_address", "city": "hp_city", "region": "hp_region",
}
LEGACY = "WordPress Legacy"
# Dictionaries that a taxonomy's terms belong to, tried in order; codes of categories that have changed.
ROUTES = {
    "hp_listing_category": ["thematic_categories", "services"], "hp_listing_service": ["organization_types", "specialist_profiles", "services"],
    "hp_listing_type": ["organization_types"], "hp_listing_ownership": ["ownership_types"],
}
CHANGED = {("hp_listing_category", "19"): "7", ("hp_listing_category", "13"): "8"}

TABLES = {
    "ids": ("post_id long, organization_id string", "post_id"),
    "retired": ("organization_id string, replaced_by string", "organization_id"),
    "organizations": ("organization_id string, title string, description string, inn string, ogrn string, phones array<string>, emails array<string>, sites array<string>, n_listings long", "organization_id"),
    "venues": ("venue_id string, address string, city string, region_code int, latitude double, longitude double", "venue_id"),
    "organization_venues": ("organization_id string, venue_id string, is_headquarters boolean", "organization_id"),
    "organization_terms": ("organization_id string, dictionary string, dictionary_id string", "organization_id"),
    "provenance": ("organization_id string, post_id long, source string", "organization_id"),
    "rejected": ("post_id long, reason string", "post_id"),
}
KEYS = {"ids": "post_id", "organizations": "organization_id", "venues": "venue_id", "organization_venues": "organization_id", "organization_terms": "organization_id", "provenance": "organization_id"}
#: Which columns hold ids of which table.
GRAPH = [
    ("ids", "organization_id", "organizations"), ("organization_venues", "organization_id", "organizations"), ("organization_venues", "venue_id", "venues"),
    ("organization_terms", "organization_id", "organizations"), ("provenance", "organization_id", "organizations"), ("provenance", "post_id", "ids"),
]


def listings(posts: DataFrame, meta: DataFrame) -> DataFrame:
    """posts (post_id, title, content) with the attributes of meta (post_id, meta_key, meta_value), cleaned, and `reason` where a listing is not taken.

    Ids keep their digits if these are as many as such ids have; one that is given and has not is the reason
    why a listing is left out. Comma lists become arrays; e-mails that are none go. The two coordinates stand the wrong
    way round in the legacy table. Of several values of one key the greatest counts.
    """
    rows = posts.join(wide(meta, "post_id", "meta_key", "meta_value", list(META.values())), "post_id", "left")
    raw = {k: F.col(v) for k, v in META.items()}
    inn, ogrn = texts.digits_of_length(raw["inn"], 10, 12), texts.digits_of_length(raw["ogrn"], 13, 15)
    place = places.legacy_place(raw["latitude"], raw["longitude"], raw["city"], raw["region"])
    bad = lambda name, clean: F.when(filled(raw[name]).isNotNull() & clean.isNull(), f"bad {name}")
    return rows.select(
        "post_id", filled(F.col("title")).alias("title"), filled(F.col("content")).alias("description"), inn.alias("inn"), ogrn.alias("ogrn"),
        texts.list_of(raw["phones"]).alias("phones"), F.filter(texts.list_of(raw["emails"]), lambda e: e.rlike(f"^{texts.EMAIL}$")).alias("emails"), texts.list_of(raw["sites"]).alias("sites"),
        filled(raw["address"]).alias("address"), place.alias("place"), F.coalesce(bad("inn", inn), bad("ogrn", ogrn)).alias("reason"),
    )


def new_id(kind: str, *parts: Column) -> Column:
    """An id that its parts alone decide."""
    return F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\\")) for p in parts]).cast("binary"))


def id_map(old: DataFrame, rows: DataFrame) -> DataFrame:
    """(post_id, organization_id) for all listings of rows (post_id, inn, ogrn) and of the map so far.

    Listings that share either id, or are joined by such, are one organisation. An organisation that the map knows keeps its id, the
    one of its least listing that has any, whatever listings join later; a new one's follows from its least listing. So a rerun
    gives the same ids.
    """
    entities = resolve_entities(rows, "post_id", ["inn", "ogrn"]).select(F.col("id").alias("post_id"), "entity")
    both = entities.join(old, "post_id", "full")
    # a listing that is no longer there keeps its place in the map
    known = both.filter("entity is not null").groupBy("entity").agg(F.min_by("organization_id", F.when(F.col("organization_id").isNotNull(), F.col("post_id"))).alias("_known"))
    out = both.join(known, "entity", "left")
    made = F.when(F.col("entity").isNotNull(), F.coalesce("_known", new_id("organization", F.col("entity")))).otherwise(F.col("organization_id"))
    return out.select("post_id", made.alias("organization_id"))


def retired_ids(old_map: DataFrame, new_map: DataFrame, old: DataFrame) -> DataFrame:
    """(organization_id, replaced_by): ids that no listing has any more, because organisations have turned out to be one; chains are followed."""
    used = new_map.select("organization_id").distinct()
    moved = old_map.join(new_map.select("post_id", F.col("organization_id").alias("replaced_by")), "post_id").filter("organization_id <> replaced_by")
    moved = moved.groupBy("organization_id").agg(F.min("replaced_by").alias("replaced_by")).join(used, "organization_id", "left_anti")
    further = moved.select(F.col("organization_id").alias("replaced_by"), F.col("replaced_by").alias("_next"))
    return old.join(further, "replaced_by", "left").select("organization_id", F.coalesce("_next", "replaced_by").alias("replaced_by")).unionByName(moved.join(old, "organization_id", "left_anti"))


def organizations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per organisation: the last listing's fields, and of both ids the last one that is told."""
    own = rows.join(ids, "post_id")
    last = F.struct("title", "description", "phones", "emails", "sites")
    told = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("post_id"))).alias(c)
    out = own.groupBy("organization_id").agg(F.max_by(last, "post_id").alias("r"), told("inn"), told("ogrn"), F.count("*").alias("n_listings"))
    return out.select("organization_id", "r.title", "r.description", "inn", "ogrn", "r.phones", "r.emails", "r.sites", "n_listings")


def venues(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of all listings that tell an address or coordinates, once each, and their links to organisations.

    Venues are the same if address, town, region and coordinates are. An organisation's headquarters is the place of its first listing that has one.
    """
    p = F.col("place")
    told = rows.filter(F.col("address").isNotNull() | (p["latitude"].isNotNull() & p["longitude"].isNotNull()))
    made = new_id("venue", F.col("address"), p["city"], p["region_code"], p["latitude"], p["longitude"])
    told = told.select("post_id", made.alias("venue_id"), "address", "place.city", "place.region_code", "place.latitude", "place.longitude")
    every = told.drop("post_id").dropDuplicates(["venue_id"])
    links = told.select("post_id", "venue_id").join(ids, "post_id")
    first = links.groupBy("organization_id").agg(F.min_by("venue_id", "post_id").alias("_first"))
    links = links.select("organization_id", "venue_id").distinct().join(first, "organization_id")
    return every, links.select("organization_id", "venue_id", (F.col("venue_id") == F.col("_first")).alias("is_headquarters"))


def term_links(relations: DataFrame, terms: DataFrame, dictionaries: DataFrame, ids: DataFrame) -> DataFrame:
    """(organization_id, dictionary, dictionary_id) from relations (post_id, term_id) and terms (term_id, taxonomy, code).

    A taxonomy's terms go to the first dictionary of its route that has their code, after codes that have changed are
    replaced; terms without any go. dictionaries: dictionary, code, dictionary_id.
    """
    now = F.col("code")
    for (taxonomy, before), after in CHANGED.items():
        now = F.when((F.col("taxonomy") == taxonomy) & (F.col("code") == before), after).otherwise(now)
    route = F.create_map(*[x for t, names in ROUTES.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])
    tried = terms.select("term_id", now.alias("code"), F.posexplode(F.try_element_at(route, F.col("taxonomy"))).alias("_at", "dictionary"))
    found = tried.join(dictionaries, ["dictionary", "code"]).groupBy("term_id").agg(F.min_by(F.struct("dictionary", "dictionary_id"), "_at").alias("d"))
    links = relations.join(found, "term_id").join(ids, "post_id")
    return links.select("organization_id", "d.dictionary", "d.dictionary_id").distinct()


def migrated(old: dict[str, DataFrame], posts: DataFrame, meta: DataFrame, relations: DataFrame, terms: DataFrame, dictionaries: DataFrame) -> dict[str, DataFrame]:
    """All tables of the new schema, from the legacy tables and the map of ids so far."""
    every = listings(posts, meta)
    rows = every.filter("reason is null")
    ids = id_map(old["ids"], rows)
    own = ids.join(rows.select("post_id"), "post_id", "left_semi")  # listings that are still there
    places_, links = venues(rows, own)
    return {
        "ids": own,
        "retired": retired_ids(old["ids"], ids, old["retired"]),
        "organizations": organizations(rows, own),
        "venues": places_,
        "organization_venues": links,
        "organization_terms": term_links(relations, terms, dictionaries, own),
        "provenance": own.select("organization_id", "post_id", F.lit(LEGACY).alias("source")),
        "rejected": every.filter("reason is not null").select("post_id", "reason"),
    }


def store(spark: SparkSession, root: str, buckets: int = 64) -> Snapshot:
    """The migrated tables below a folder."""
    return Snapshot(spark, root, TABLES, buckets)


def migrate(at: Snapshot, epoch: int, *legacy: DataFrame) -> bool:
    """Migrates the whole legacy tables as version `epoch` of all new ones, which become visible together.

    legacy: posts, meta, relations, terms, dictionaries. The map of ids comes from the version before. A version whose links do not all
    lead somewhere is an error, and never comes into force.
    """

    def change(old):
        new = migrated(old, *legacy)
        kept = {}
        for name, df in new.items():  # each table is computed once, then checked and written from that
            kept[name] = df.persist()
        held.extend(kept.values())
        lost = orphans({k: kept[k] for k in KEYS}, KEYS, GRAPH).filter("n > 0").collect()
        if lost:
            raise ValueError(f"rows without a parent: {lost}")
        return kept

    held: list[DataFrame] = []
    try:
        return at.commit(epoch, None, change)
    finally:
        for df in held:
            df.unpersist()
